"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct w-word shingles. Documents with equal sets form
a class, of which the one with the smallest id goes on under the class's number;
ids take no part in links, as an id may have several texts. A class's signature has
`POSITIONS` b-bit values; two sets of Jaccard similarity s differ in a position
with probability 1 - s. `radius` is the distance that a pair at the threshold
exceeds with probability `MISS` at most. The positions are cut into chunks so
many that, by pigeonhole, a pair within the radius has a chunk with at most one
error; every class enumerates, for each chunk, the keys that leave one position
out. So every pair within the radius shares a key.

Keys are range-partitioned with the classes in an order of the key's own, which
spreads a key that very many classes hold. A small bucket gives all its pairs. A
large one gives each member with the bucket's first (a star: linear in the
bucket); as every key has an order of its own, a class meets about as many
others as it has large buckets. Pairs are filtered by a longer signature and by
size, and confirmed on the full sets, recomputed from whole texts. The large
buckets' members that are still in different components are then compared in
blocks of at most 2 * `BLOCK` members, so no link is lost to the star; those of
a bucket's commonest component only meet the others, however many they are.

Defined results: null and empty texts and texts without words have no set and no
link; rows with a null id are linked with nothing and are kept; repeated rows
are in one class; a row's component is that of its text, also where its id has
other texts; of a component's documents one is kept, that with the smallest id,
then text hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_HASH, identified, identity, release, shuffle_parts, stored, text_runs
from .components import components

POSITIONS, LONG, WIDE, MISS = 64, 128, 1024, 2e-5
SMALL, BLOCK, ORDERS, SALTS = 8, 2048, 16, 16
_U64 = np.uint64
_MIX1, _MIX2, _ODD = _U64(0xFF51AFD7ED558CCD), _U64(0xC4CEB9FE1A85EC53), _U64(0x9E3779B97F4A7C15)
_PAIR = ("a", "b")
_PAIRS = "a long, b long"


def radius(positions: int, differ: float, miss: float = MISS) -> int:
    """The smallest r with P(Binomial(positions, differ) > r) <= miss."""
    tail, r = 1.0, -1
    while tail > miss:
        r += 1
        tail -= comb(positions, r) * differ**r * (1 - differ) ** (positions - r)
    return r


def chunks(similarity: float) -> list[np.ndarray]:
    """Places of each chunk: with r + 1 <= 2 * chunks, one of them has at most one error."""
    return np.array_split(np.arange(POSITIONS), -(-(radius(POSITIONS, 1 - similarity) + 1) // 2))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _MIX1
    x = (x ^ (x >> _U64(33))) * _MIX2
    return x ^ (x >> _U64(33))


class _WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. bytes.lower() changes A-Z only; bytes.split() splits at ASCII spaces only."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=_U64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=_U64)
    if len(_words) > 500_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), dtype=_U64, count=len(words))
    n = len(h) - width + 1
    total = np.zeros(n, dtype=_U64)
    for k in range(width):
        total = total * _ODD + h[k : n + k]
    return np.unique(mix(total))


def _factors(n: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(n)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def _minima(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = factors
    x = (hashes >> _U64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 4096):
        low = np.minimum(low, (x[k : k + 4096, None] * a + b).min(axis=0))
    return mix(low.astype(_U64) + _ODD)


def _nibbles(mixed: np.ndarray) -> bytes:
    nibbles = (mixed >> _U64(40)).astype(np.uint8) & 15
    return (nibbles[::2] | nibbles[1::2] << 4).tobytes()


def signature(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    """16 bits of each of the first POSITIONS minima, and 4 bits of each of LONG minima."""
    mixed = _minima(hashes, factors)
    return (mixed[:POSITIONS] & _U64(0xFFFF)).astype("<u2").tobytes(), _nibbles(mixed)


def _set_rows(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for whole in batches:
            for batch in text_runs(whole):
                texts = batch.column("text")
                n, digests, positions, sigs = [], [], [], []
                for k in range(batch.num_rows):
                    x = shingles(texts[k].as_buffer().to_pybytes(), width)
                    n.append(len(x))
                    digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                    p, s = signature(x, factors)
                    positions.append(p)
                    sigs.append(s)
                halves = np.frombuffer(b"".join(digests), dtype=">i8").astype("i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column(TEXT_HASH), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(n, pa.int32()), pa.array(positions, pa.binary()), pa.array(sigs, pa.binary())],
                    ["doc_id", TEXT_HASH, "k1", "k2", "n", "positions", "sig"],
                )

    return rows


def _wide_rows(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(WIDE)
        for batch in batches:
            texts = batch.column("text")
            sigs = [_nibbles(_minima(shingles(texts[k].as_buffer().to_pybytes(), width), factors)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigs, pa.binary())], ["id", "wide"])

    return rows


def chunk_keys(positions: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """(rows, POSITIONS) keys: of each chunk with each of its positions left out in turn."""
    out = np.empty(positions.shape, dtype=_U64)
    values = positions.astype(_U64)
    for part in parts:
        for gone in part:
            acc = np.full(len(values), int(gone) + 1, dtype=_U64)
            for k in part:
                if k != gone:
                    acc = mix((acc + values[:, k]) * _ODD)
            out[:, gone] = acc
    return out


def _key_rows(parts: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                positions = np.frombuffer(b"".join(part.column("positions").to_pylist()), dtype="<u2").reshape(-1, POSITIONS)
                keys = chunk_keys(positions, parts).view("i8")
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), POSITIONS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["key", "id"])

    return rows


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, id): a pair (a, b), or a member of a bucket that isn't done with (b null, key set)."""
    out: list[tuple[int, int | None, int | None]] = []
    key, run, large, first = None, [], False, True

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "key"])
        out.clear()
        return batch

    def close(edge: bool) -> None:
        """A run at the partition's edge may go on next door, so its members stay open; large runs have left theirs."""
        if large:
            return
        if edge:
            out.extend((x, None, key) for x in run)
        for k, x in enumerate(run):
            out.extend((min(x, y), max(x, y), None) for y in run[:k] if x != y)

    for batch in batches:
        for k, x in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), strict=True):
            if k != key:
                close(edge=first)
                first = first and key is None
                key, run, large = k, [], False
            if large:
                out += [(x, None, key), (min(x, run[0]), max(x, run[0]), None)]
                continue
            run.append(x)
            if len(run) > SMALL:
                large = True
                out.extend((y, None, key) for y in run)
                out.extend((min(y, run[0]), max(y, run[0]), None) for y in run[1:])
        if len(out) > 5000:
            yield flush()
    close(edge=True)
    yield flush()


_NIBBLE = _U64(0x1111111111111111)


def nibble_distance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Differing 4-bit values between rows of 8 words each."""
    x = one ^ many
    x = x | x >> _U64(2)
    x = (x | x >> _U64(1)) & _NIBBLE
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _near_wide(one: bytes | None, other: bytes | None, most: int) -> bool:
    if one is None or other is None:
        return True
    x, y = (np.frombuffer(w, dtype="<u8") for w in (one, other))
    return int(nibble_distance(x, y)) <= most


def _filter_rows(most: int, most_wide: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8").reshape(-1, LONG // 16) for c in ("sig_a", "sig_b")]
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            near = (nibble_distance(*sig) <= most) & (100 * np.minimum(*n) >= percent * np.maximum(*n))
            wide = [batch.column(c) for c in ("wide_a", "wide_b")]
            for k in np.flatnonzero(near).tolist():
                near[k] = _near_wide(wide[0][k].as_py(), wide[1][k].as_py(), most_wide)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in _PAIR], _PAIR)

    return rows


def _block_rows(parts: list[np.ndarray], most: int, most_wide: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of members sorted by (key, block): the near pairs between components. Of the keys that a pair shares only the first gives it."""

    def pairs(key: int, rows: list[tuple]) -> Iterator[tuple[int, ...]]:
        ids, comps, n, sides = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1, 2, 3))
        sig = np.frombuffer(b"".join(r[5] for r in rows), dtype="<u8").reshape(-1, LONG // 16)
        wide = np.frombuffer(b"".join(r[6] for r in rows), dtype="<u8").reshape(-1, WIDE // 16)
        keys = chunk_keys(np.frombuffer(b"".join(r[4] for r in rows), dtype="<u2").reshape(-1, POSITIONS), parts)
        here = int(np.argmax(keys[0].view("i8") == key))
        values, counts = np.unique(comps, return_counts=True)
        common = values[np.argmax(counts)]
        # every pair between components has a member outside the commonest one
        for i in np.flatnonzero(comps != common):
            other = (comps != comps[i]) & ((comps == common) | (np.arange(len(ids)) > i)) & (sides != sides[i] if sides.any() else True)
            other &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
            at = np.flatnonzero(other)
            at = at[nibble_distance(sig[i], sig[at]) <= most]
            at = at[nibble_distance(wide[i], wide[at]) <= most_wide]
            at = at[np.argmax(keys[at] == keys[i], axis=1) == here]
            for j in at.tolist():
                low, high = (i, j) if ids[i] < ids[j] else (j, i)
                yield ids[low], ids[high]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(_PAIR)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _PAIR)
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "block", "id", "component", "n", "side", "positions", "sig", "wide")]
            for key, block, *row in zip(*columns, strict=True):
                if (key, block) != group:
                    if len(held) > 1:
                        out.extend(pairs(group[0], held))
                        yield flush()
                    group, held = (key, block), []
                held.append(row)
        if len(held) > 1:
            out.extend(pairs(group[0], held))
        yield flush()

    return rows_of


def _confirm(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                sets = []
                for side in "ab":
                    node = batch.column(side)[k].as_py()
                    if last.get(side, (None,))[0] != node:
                        last[side] = node, shingles(batch.column(f"text_{side}")[k].as_buffer().to_pybytes(), width)
                    sets.append(last[side][1])
                common = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(100 * common >= percent * (len(sets[0]) + len(sets[1]) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], ["a", "b"])

    return rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text hash, n_shingles, component_id (smallest id reachable) and kept of every row of docs."""
    docs = identified(docs, id_col, text_col)
    spark, parts = docs.sparkSession, chunks(percent / 100)
    differ = (1 - percent / 100) * 15 / 16  # 4-bit values agree by chance once in 16
    most = radius(LONG, differ)

    sets = stored(docs.mapInArrow(_set_rows(width), f"{identity(docs)}, k1 long, k2 long, n int, positions binary, sig binary"), "sets")
    usable = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", TEXT_HASH)).alias("r"))
    # A class's number is its node's id from here on; it is fixed by being stored.
    reps = reps.select("k1", "k2", F.monotonically_increasing_id().alias("id"), F.col("r.doc_id").alias("rep_id"), F.col(f"r.{TEXT_HASH}").alias("rep_hash"))
    reps = stored(reps, "classes")
    lead = reps.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "id", "rep_id", "rep_hash")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("doc_id") == F.col("rep_id")) & (F.col(TEXT_HASH) == F.col("rep_hash"))
    nodes = stored(usable.join(lead, same).select("id", "rep_id", "rep_hash", "n", "positions", "sig").dropDuplicates(["id"]), "nodes")

    keys = nodes.select("id", "positions").mapInArrow(_key_rows(parts), "key long, id long")
    order = [F.col("key"), F.xxhash64("id", F.pmod("key", F.lit(ORDERS))), F.col("id")]
    keys = keys.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    found = stored(keys.mapInArrow(_pair_rows, "a long, b long, key long"), "pairs")

    # Members of large buckets have very many candidates; for them alone a signature of WIDE positions is made, which leaves few that aren't similar.
    wanted = found.where("b is null").select(F.col("a").alias("id")).distinct().join(nodes.select("id", "rep_id", "rep_hash"), "id")
    wide = docs.join(wanted, (F.col("doc_id") == F.col("rep_id")) & (F.col(TEXT_HASH) == F.col("rep_hash"))).select("id", "text")
    wide = stored(wide.mapInArrow(_wide_rows(width), "id long, wide binary").dropDuplicates(["id"]), "wide")
    most_wide = radius(WIDE, differ)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose full sets, from whole texts, are similar enough."""
        for side in "ab":
            pairs = pairs.join(nodes.select(F.col("id").alias(side), F.col("rep_id").alias(f"doc_{side}"), F.col("rep_hash").alias(f"hash_{side}")), side)
            texts = docs.select(F.col("doc_id").alias(f"doc_{side}"), F.col(TEXT_HASH).alias(f"hash_{side}"), F.col("text").alias(f"text_{side}"))
            pairs = pairs.join(texts, [f"doc_{side}", f"hash_{side}"])
        return stored(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a long, b long").distinct(), name)

    pairs, known = found.where("b is not null").select("a", "b").distinct(), nodes.join(wide, "id", "left")
    for side in "ab":
        pairs = pairs.join(known.select(F.col("id").alias(side), *(F.col(c).alias(f"{new}_{side}") for c, new in (("n", "n"), ("sig", "sig"), ("wide", "wide")))), side)
    near = stored(pairs.mapInArrow(_filter_rows(most, most_wide, percent), _PAIRS), "near")
    links = confirmed(near, "confirmed")
    labels = components(links)

    open_ = found.where("b is null").select("key", F.col("a").alias("id")).distinct()
    open_ = open_.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("components")).where("components > 1")
    cuts = [F.ceil(n / BLOCK).cast("int").alias(c) for n, c in ((F.col("most.n"), "commons"), (F.col("size") - F.col("most.n"), "others"))]
    # A bucket may hold very many members: both sides of the join are salted.
    mixed = mixed.select("key", "size", F.col("most.component").alias("common"), *cuts, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(mixed, ["key", "salt"])
    # Where a bucket has more than BLOCK members, each cut of the commonest component meets each cut of the others, and these meet each other.
    place = F.xxhash64("id", F.lit(1))
    common, cut = F.col("component") == F.col("common"), F.pmod(place, F.when(F.col("component") == F.col("common"), F.col("commons")).otherwise(F.col("others"))).cast("int")

    def block(at, side) -> Column:
        return F.struct(at.cast("int").alias("block"), (side if isinstance(side, Column) else F.lit(side)).cast("int").alias("side"))

    of_common = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: block(F.col("cut") * F.col("others") + o, 1))
    of_other = F.transform(F.sequence(F.lit(0), F.col("commons") - 1), lambda c: block(c * F.col("others") + F.col("cut"), 2))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: block(-1 - (F.least("cut", o) * F.col("others") + F.greatest("cut", o)), F.when(F.col("cut") > o, 1).when(F.col("cut") < o, 2).otherwise(0)))
    blocks = F.when(F.col("size") <= BLOCK, F.array(block(F.lit(0), 0))).when(common, of_common).otherwise(F.concat(of_other, among))
    open_ = open_.withColumn("cut", cut).select("key", "id", "component", F.explode(blocks).alias("x")).select("key", "id", "component", "x.block", "x.side")
    open_ = open_.join(nodes.select("id", "n", "positions", "sig").join(wide, "id"), "id")
    open_ = open_.repartition(shuffle_parts(spark), "key", "block").sortWithinPartitions("key", "block")
    late = open_.mapInArrow(_block_rows(parts, most, most_wide, percent), _PAIRS).distinct()
    late = stored(late.join(near, ["a", "b"], "left_anti"), "late")
    if not late.isEmpty():
        labels = components(links.unionByName(confirmed(late, "confirmed-late")))
    release(found, nodes, wide, near, links, late)

    # The component's first document takes the place of its class number.
    classes = reps.select("k1", "k2", "id", F.struct("rep_id", "rep_hash").alias("r"))
    firsts = labels.join(classes, "id").groupBy("component").agg(F.min("r").alias("first"))
    firsts = labels.join(firsts, "component").select("id", "first")
    classes = classes.join(firsts, "id", "left").withColumn("r", F.coalesce("first", "r"))
    classes = classes.select("k1", "k2", F.col("r.rep_id").alias("component"), F.col("r.rep_hash").alias("first_hash"))
    out = sets.join(classes, ["k1", "k2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    kept = alone | ((F.col("component") == F.col("doc_id")) & (F.col("first_hash") == F.col(TEXT_HASH)))
    return out.select("doc_id", TEXT_HASH, F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
