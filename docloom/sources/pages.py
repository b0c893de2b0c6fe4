"""Files to page images: PNG and multi-frame TIFF are decoded here, other kinds by functions that the caller plugs in.

A decoder is bytes -> list of uint8 arrays (rows, columns) or (rows, columns, 3), one a page. Those given to
``page_images`` come before the ones here, so that a PDF or Office library (``{".pdf": ...}``) is one entry.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import media_extension

Decoder = Callable[[bytes], list[np.ndarray]]
# First bytes of a PNG file; channels of its colour types; TIFF tags used and bytes of their number types.
_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
_NUMBERS = {1: "B", 3: "H", 4: "I"}


def _flattened(image: np.ndarray) -> np.ndarray:
    """Without transparency, which is taken for white paper; one channel as a plain array."""
    if image.shape[2] in (2, 4):
        colour, alpha = image[..., :-1].astype(np.float64), image[..., -1:] / 255.0
        image = np.rint(colour * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return image[..., 0] if image.shape[2] == 1 else image


def png_pages(data: bytes) -> list[np.ndarray]:
    """The image of a PNG file with eight bits a channel, not interlaced and without a palette."""
    if not data.startswith(_PNG):
        raise ValueError("not a PNG file")
    at, body, head = len(_PNG), [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only PNG files with eight bits a channel, no palette and no interlacing are read here")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int64)  # a row and a column of zeros before the image
    for y in range(height):
        line, kind = rows[y, 1:].reshape(width, channels).astype(np.int64), rows[y, 0]
        up = out[y]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = line.cumsum(axis=0) % 256
        elif kind == 2:
            out[y + 1, 1:] = (line + up[1:]) % 256
        else:
            row = out[y + 1]
            for x in range(1, width + 1):
                left, above, corner = row[x - 1], up[x], up[x - 1]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    far = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))
                    guess = np.choose(far.argmin(axis=0), [left, above, corner])  # ties go to the first
                row[x] = (line[x - 1] + guess) % 256
    return [_flattened(out[1:, 1:].astype(np.uint8))]


def as_png(image: np.ndarray) -> bytes:
    """A gray or colour image as a PNG file."""
    image = image[..., None] if image.ndim == 2 else image
    height, width, channels = image.shape
    body = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)), (b"IDAT", zlib.compress(body, 6)), (b"IEND", b"")]
    return _PNG + b"".join(struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x)) for kind, x in chunks)


def _unpacked(data: bytes) -> bytes:
    """Byte runs of a PackBits strip."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def tiff_pages(data: bytes) -> list[np.ndarray]:
    """All frames of a TIFF file: one or eight bits a channel in strips, uncompressed, PackBits or deflate."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    pages, seen = [], set()
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at and at not in seen:
        seen.add(at)
        entries = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(entries):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in _NUMBERS:
                form = f"{order}{n}{_NUMBERS[kind]}"
                place = at + 10 + 12 * k
                tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0])
        pages.append(_frame(data, tags))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * entries)[0]
    return pages


def _frame(data: bytes, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    unpack = {1: bytes, 32773: _unpacked, 8: zlib.decompress, 32946: zlib.decompress}.get(tags.get(_COMPRESSION, (1,))[0])
    bits, channels, ink = tags.get(_BITS, (1,))[0], tags.get(_SAMPLES, (1,))[0], tags.get(_PHOTOMETRIC, (1,))[0]
    if unpack is None or bits not in (1, 8) or (bits == 1 and channels != 1) or ink not in (0, 1, 2) or _OFFSETS not in tags:
        raise ValueError("this kind of TIFF frame isn't read here: plug a decoder in")
    width, height = tags[_WIDTH][0], tags[_HEIGHT][0]
    raw = np.frombuffer(b"".join(unpack(data[s : s + n]) for s, n in zip(tags[_OFFSETS], tags[_COUNTS], strict=True)), np.uint8)
    if bits == 1:
        image = np.unpackbits(raw.reshape(height, -1), axis=1)[:, :width, None] * np.uint8(255)
    else:
        image = raw[: height * width * channels].reshape(height, width, channels)
        if tags.get(_PREDICTOR, (1,))[0] == 2:
            image = image.cumsum(axis=1, dtype=np.int64).astype(np.uint8)
    return _flattened(255 - image if ink == 0 else image)


def page_images(files: DataFrame, decoders: dict[str, Callable[[], Decoder]] | None = None) -> DataFrame:
    """path, page_number, width, height and content (PNG) of every page of files (path, content); a kind without a decoder is an error.

    decoders: extension (`.pdf`) -> factory of a decoder, called once a task. A page is a row, and batches go out page by page,
    so a task holds one file's pages at a time.
    """
    factories = {".png": lambda: png_pages, ".tif": lambda: tiff_pages, ".tiff": lambda: tiff_pages, **(decoders or {})}
    names = ["path", "page_number", "width", "height", "content"]
    types = [pa.string(), *[pa.int32()] * 3, pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Decoder] = {}
        for batch in batches:
            for path, kind, data in zip(*[batch.column(c).to_pylist() for c in ("path", "kind", "content")], strict=True):
                if kind not in factories:
                    raise ValueError(f"no decoder for {path}")
                decode = ready[kind] if kind in ready else ready.setdefault(kind, factories[kind]())
                for number, image in enumerate(decode(data), 1):
                    page = (path, number, image.shape[1], image.shape[0], as_png(image))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(page, types, strict=True)], names)

    kinds = files.select("path", media_extension(F.col("path")).alias("kind"), "content")
    return kinds.mapInArrow(rows, "path string, page_number int, width int, height int, content binary")
