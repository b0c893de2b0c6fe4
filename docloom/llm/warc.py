"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained once on a bounded, documented sample of the
records (`sample` of them, picked by hash). Every archive begins with a
skippable frame that embeds it; each record is a frame of its own, so any one
can be read alone. Of records with equal payloads of at least `min_bytes`, that
with the smallest id is the response and the others revisit it: the smallest id
per digest is pre-aggregated, so a payload that many pages share moves as one
row a task.

Each task writes its archive under a temporary name and renames it, so a task
that runs again replaces whole files only. Reading decompresses frame by frame.

Defined results: a null payload is empty; payloads under `min_bytes` are all
responses; repeated ids are records of their own, where those that share the
smallest id of a payload are all responses; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_dir, sample_cut, shuffle_parts

#: Fixed values of the format: magic numbers of a skippable frame and of a dictionary.
SKIPPABLE, DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
_DATE = "2024-01-01T00:00:00Z"
_RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def train_dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary, or with too few samples to train on, the samples themselves as raw content (perhaps empty)."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def _urn(page: object) -> str:
    return f"<urn:docloom:page:{'' if page is None else quote(str(page), safe='')}>"


def _page(urn: str) -> str | None:
    return unquote(urn.rstrip(">").rpartition(":")[2]) or None


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the response it repeats."""
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    return fields, rest[:n]


def frame_of(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


def _encoder(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    zdict = _dictionary(dictionary)
    zdict.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=zdict)


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one record in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    zdict = _dictionary(stream.read(size))
    decoder = zstandard.ZstdDecompressor(dict_data=zdict)
    data = b""
    while True:
        one = decoder.decompressobj()
        out = []
        while not one.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    if out:
                        raise ValueError("the archive ends inside a record")
                    return
            out.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield parse(b"".join(out))


def _writer(root: str, shared, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(root)
        number = TaskContext.get().partitionId()
        final = f"{folder}/part-{number:06d}.warc.zst"
        hidden = f"{folder}/.part-{number:06d}-{uuid.uuid4().hex}"
        encoder = _encoder(shared.value, level)
        out, n = None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "revisit")]
            for k in range(batch.num_rows):
                page, url, payload, digest, refers_to, revisit = (c[k].as_py() for c in columns)
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(hidden, compression=None)
                    out.write(frame_of(shared.value))
                out.write(encoder.compress(record(page, url, payload, digest, refers_to, revisit)))
                n += 1
        if out is not None:
            out.close()
            system.move(hidden, final)
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/part-{number:06d}.warc.zst"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return write


def spread_pieces(payload: Column, size: Column, most: int, pieces: int = 8) -> Column:
    """At most `most` bytes of the payload: all of a short one, else pieces spread evenly from its beginning to its end."""
    piece = most // pieces
    starts = [F.floor((size - piece) * k / (pieces - 1)).cast("int") + 1 for k in range(pieces)]
    return F.when(size <= most, payload).otherwise(F.concat(*[F.substr(payload, s, F.lit(piece)) for s in starts]))


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, sample: int = 1000, sample_bytes: int = 32_768, dictionary_bytes: int = 65_536, level: int = 3
) -> DataFrame:
    """Write the archives to a new shared folder; path and n_records of each. sample, sample_bytes: the dictionary is fitted to so many payloads, of so many bytes at most, from all over each."""
    spark = pages.sparkSession
    bound_batches(spark)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("size"))
    # The sample's last hash first, so that tasks send the driver hashes and then only the payloads that are in it.
    order = F.xxhash64("page_id", "payload_digest")
    last = sample_cut(rows, order, sample)
    spread = spread_pieces(F.col("payload"), F.col("size"), sample_bytes).alias("spread")
    picked = rows.where(order <= last).select("page_id", "url", spread, "payload_digest").limit(2 * sample).collect() if last is not None else []
    shared = spark.sparkContext.broadcast(train_dictionary([record(r["page_id"], r["url"], bytes(r["spread"]), r["payload_digest"], None, False) for r in picked], dictionary_bytes))

    long = rows.where(F.col("size") >= min_bytes)
    first = long.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1").select(F.col("payload_digest").alias("shared_digest"), "first_page")
    joined = rows.join(first, (F.col("payload_digest") == F.col("shared_digest")) & (F.col("size") >= min_bytes), "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    joined = joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, F.col("first_page")).alias("refers_to"), revisit.alias("revisit"))
    root = new_dir(spark, "warc")
    made = joined.mapInArrow(_writer(root, shared, level), "path string, n_records long")
    made.write.parquet(f"{root}-list")  # runs the writers once; later reads take this list
    return spark.read.schema("path string, n_records long").parquet(f"{root}-list")


def _reader(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        n = 5 + payloads
        columns = list(zip(*rows, strict=True))[:n]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][:n]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][:n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for fields, block in read_archive(stream):
                        said, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(block).hexdigest() != said or len(block) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"a payload in {path} differs from its digest")
                        refers_to = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_page(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), said, kind, refers_to, block if payloads and kind == "response" else None))
                        held += len(block)
                        if held > 4_000_000 or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_archives(spark: SparkSession, paths: DataFrame, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """Every record of the archives at `path`: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits).

    Each response's digest and length are checked against its payload in any case. Archives hold ids as text: id_type is what they
    were (an empty text is null).
    """
    bound_batches(spark)
    spread = paths.select("path").repartition(shuffle_parts(spark), "path")
    found = spread.mapInArrow(_reader(payloads), _RECORD + ", payload binary" * payloads)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def roundtrip_bytes(payloads: list[bytes], dictionary: bytes, level: int = 3) -> tuple[bytes, list[bytes]]:
    """An archive of the payloads in memory and the payloads read back from it."""
    encoder = _encoder(dictionary, level)
    data = frame_of(dictionary) + b"".join(encoder.compress(record(k, "", p, hashlib.sha256(p).hexdigest(), None, False)) for k, p in enumerate(payloads))
    return data, [block for _, block in read_archive(io.BytesIO(data))]
