"""Splits of examples that keep the examples of a document together."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .folds import fold_sorted

NAMES = ("train", "val", "test")


def hash_split(examples: DataFrame, group: str = "document_id", fractions: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, ordinal: str | None = None) -> DataFrame:
    """examples with `split` by a hash of the group: no shuffle, any size; fractions hold on average. A null group is a group of its own example."""
    _check(fractions)
    plain = [c for c, kind in examples.dtypes if "map<" not in kind]  # maps can't be hashed
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("example-"), F.col(ordinal).cast("string") if ordinal else F.xxhash64(*plain).cast("string")))
    digest = F.md5(F.concat(key, F.lit(f":{seed}")))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % 1_000_000 / 1_000_000.0
    return examples.withColumn("split", F.when(u < fractions[0], NAMES[0]).when(u < fractions[0] + fractions[1], NAMES[1]).otherwise(NAMES[2]))


def balanced_split(examples: DataFrame, group: str = "document_id", fractions: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, parts: int | None = None) -> DataFrame:
    """examples with `split`: groups in the order of a hash, each to the split that is least full for its target.

    A group's split depends on all groups before it. The order is cut into `parts` (unset: as many as shuffle partitions),
    which are filled at once, each from an estimate of what the splits hold where it begins; a part that began from
    anything but what the one before it ended with is filled again. A greedy fill forgets small errors of its start, so
    that a few rounds settle all parts, and every round settles at least the first that isn't. The result is the
    sequential one, whatever `parts` is. The driver sees a few numbers a part and at most 4 * parts + 1 large groups.
    A null group is one group; groups that are equal as strings are in the order of their own values.
    """
    _check(fractions)
    spark = examples.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts
    if not 1 <= parts <= 1 << 16:
        raise ValueError("parts must be between 1 and 65536")
    key = F.md5(F.concat(F.coalesce(F.col("__group").cast("string"), F.lit("None")), F.lit(f":{seed}")))
    part = F.shiftrightunsigned(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * parts, 32).cast("int")
    sizes = examples.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("n")).withColumn("__key", key).withColumn("__part", part)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    sizes = sizes.select("__part", "__key", "__group", "n").repartitionById(parts, F.col("__part")).checkpoint()
    total = sizes.agg(F.sum("n")).first()[0] or 0
    targets = [f * total for f in fractions]
    begun = _estimates(sizes, parts, total, targets)
    ended: dict[int, tuple] = {}
    stale = list(range(parts))
    while stale:
        fill = _filling(begun, targets, summary=True)
        found = fold_sorted(sizes.where(F.col("__part").isin(stale)), ["__part"], ["__key", "__group"], fill, "filled array<bigint>, picked array<boolean>", dealt=True).collect()
        ended.update({r["__part"]: (begun[r["__part"]], tuple(r["filled"]), tuple(r["picked"])) for r in found})
        begun, before = _chained(begun, ended), begun
        stale = [p for p in range(parts) if p in ended and begun[p] != before[p]]
    rows = fold_sorted(sizes, ["__part"], ["__key", "__group"], _filling(begun, targets, summary=False), f"__group {dict(sizes.dtypes)['__group']}, split string", dealt=True)
    return examples.join(rows.drop("__part"), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def _filling(begun: list[tuple], targets: list[float], summary: bool):
    """A fold over one part's groups: each group's split, or what the splits hold in the end and which of them took any."""

    def fill(rows: Iterator[tuple]) -> Iterator[tuple]:
        filled, picked = None, [False] * len(NAMES)
        for part, _, group, n in rows:
            if filled is None:
                filled = list(begun[part])
            full = [f / t if t else math.inf for f, t in zip(filled, targets, strict=True)]
            k = full.index(min(full))
            filled[k] += n
            picked[k] = True
            if not summary:
                yield group, NAMES[k]
        if summary:
            yield filled, picked

    return fill


def _estimates(sizes: DataFrame, parts: int, total: int, targets: list[float]) -> list[tuple]:
    """About what the splits hold where each part begins: large groups one by one, what lies between them as if it were a liquid.

    Estimates are multiples of the sizes' common divisor, as what splits really hold, for else no fill could come to agree with them.
    """
    large = total // (4 * parts) + 1

    def weigh(rows: Iterator[tuple]) -> Iterator[tuple]:
        liquid = divisor = 0
        for _, _, _, n in rows:
            divisor = math.gcd(divisor, n)
            if n >= large:
                yield liquid, n, divisor
                liquid = 0
            else:
                liquid += n
        yield liquid, 0, divisor

    found = fold_sorted(sizes, ["__part"], ["__key", "__group"], weigh, "liquid bigint, n bigint, divisor bigint", dealt=True)
    steps: dict[int, list] = {}
    divisor = 0
    for r in found.withColumn("__at", F.monotonically_increasing_id()).collect():
        steps.setdefault(r["__part"], []).append((r["__at"], r["liquid"], r["n"]))
        divisor = math.gcd(divisor, r["divisor"])
    levels, so_far, out = [0.0] * len(NAMES), 0, []
    for part in range(parts):
        exact = [round(x / divisor) * divisor if divisor else 0 for x in levels]
        exact[targets.index(max(targets))] += so_far - sum(exact)
        out.append(tuple(exact))
        for _, liquid, n in sorted(steps.get(part, [])):
            levels = _poured(levels, liquid, targets)
            levels[min(range(len(NAMES)), key=lambda i: levels[i] / targets[i] if targets[i] else math.inf)] += n
            so_far += liquid + n
    return out


def _poured(levels: list[float], amount: float, targets: list[float]) -> list[float]:
    """Levels after an amount is spread over the splits that are least full for their targets."""
    order = sorted((i for i, t in enumerate(targets) if t), key=lambda i: levels[i] / targets[i])
    for n in range(1, len(order) + 1):
        low = order[:n]
        height = (sum(levels[i] for i in low) + amount) / sum(targets[i] for i in low)
        if n == len(order) or height <= levels[order[n]] / targets[order[n]]:
            return [height * targets[i] if i in low else x for i, x in enumerate(levels)]
    return levels


def _chained(begun: list[tuple], ended: dict[int, tuple]) -> list[tuple]:
    """Where each part begins if the one before it ends as it did; where that began from elsewhere, what splits that it didn't touch held is carried through."""
    out, now = [], begun[0]
    for part in range(len(begun)):
        out.append(now)
        if part not in ended:  # no groups
            continue
        start, filled, picked = ended[part]
        if now == start:
            now = filled
            continue
        new = [f if p else x for f, p, x in zip(filled, picked, now, strict=True)]
        new[max(i for i, p in enumerate(picked) if p)] += sum(filled) - sum(new)
        now = tuple(new)
    return out


def _check(fractions: tuple[float, ...]) -> None:
    if abs(sum(fractions) - 1.0) > 1e-8:
        raise ValueError("the fractions must sum to 1")
