"""Mixing sources to target weights, in column expressions only.

Weights. A source's share of all tokens is raised to an exponent and the
results are normalised: 1 keeps the shares, 0 makes all sources equal. The
exponent is bisected: for a target entropy (a part of the greatest, log of the
number of sources) it falls from 1 until the mix is so even, and it doesn't fall
further than the repetition limit allows (no source's quota, weight * budget,
may exceed `max_repeats` times its tokens). Where even the shares themselves
exceed the limit the budget is cut to what they allow.

Realisation. Documents are hashed into blocks of about `block_tokens` tokens of
their source, however many that gives. A source's quota is so many whole passes
over its blocks and a part of another; each pass is its own permutation of the
blocks, and documents are permuted within their block. The last pass ends within
a block, at the last document that fits the quota, so at most one document's
tokens are missing from each source. Running totals are taken over lots (as many
as the root of the number of blocks), over the blocks within a lot, and over
documents only within the one block where a source ends, so a source that holds
a third of all rows is no task of its own.

Defined results: a null source is a source of its own; null and empty texts have
no tokens and come with every pass that their block is in; repeated rows are
copies of their own (each row counts); a table without tokens gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Bisection steps; documents a block has at most, on average, where texts are short.
STEPS, BLOCK_DOCS = 50, 1000
#: Sources that one row holds while the exponent is found, some 50 bytes each.
MOST_SOURCES = 2_000_000


def n_tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, "[ \\t-\\r]+"))).otherwise(0).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), the value being computed once: within a lambda, what stands outside would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _powered(shares: Column, exponent: Column) -> Column:
    """Normalised powers of positive shares; a share of 0 stays 0."""
    raised = F.transform(shares, lambda p: F.when(p > 0, F.pow(p, exponent)).otherwise(0.0))
    whole = _let(raised, lambda r: F.struct(r.alias("r"), F.aggregate(r, F.lit(0.0), lambda a, y: a + y).alias("sum")))
    return _let(whole, lambda s: F.transform(s["r"], lambda x: x / s["sum"]))


def _entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.ln(w)).otherwise(0.0))


def _bisect(enough) -> Column:
    """The smallest exponent in [0, 1] for which `enough` holds, if it holds from some exponent on upwards; 1 if it never does."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        return _let(enough(middle), lambda ok: F.struct(F.when(ok, s["lo"]).otherwise(middle).alias("lo"), F.when(ok, middle).otherwise(s["hi"]).alias("hi")))

    return F.when(enough(F.lit(0.0)), 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda s: s["hi"]))


def weights(sources: DataFrame, budget: float | None = None, target_entropy: float | None = 0.95, max_repeats: float = 4.0) -> DataFrame:
    """source, tokens, share, weight, quota (tokens), exponent and entropy; sources has a row (source, tokens) for each source.

    One row holds all sources while the exponent is bisected: their number, not the documents', is its size, and MOST_SOURCES its limit.
    The row with the exponent is stored, so that no column made of it can have the bisection computed again.
    budget: tokens of the mix, default as many as there are.
    """
    if (n := sources.count()) > MOST_SOURCES:
        raise ValueError(f"{n} sources; {MOST_SOURCES} at most share a row")
    one = sources.agg(F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("tokens")))).alias("s"))
    tokens = F.transform("s", lambda x: x["tokens"])
    one = one.withColumn("total", F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x)).where("total > 0")
    one = one.withColumn("shares", F.transform(tokens, lambda x: x / F.col("total"))).withColumn("budget", F.least(F.lit(budget) if budget else F.col("total"), F.col("total") * max_repeats))
    shares = F.col("shares")

    one = one.withColumn("tokens", tokens)

    def within(exponent: Column) -> Column:
        """No source repeats more often than allowed."""
        pairs = F.arrays_zip(_powered(shares, exponent).alias("w"), F.col("tokens").alias("t"))
        return F.forall(pairs, lambda x: x["w"] * F.col("budget") <= x["t"] * max_repeats + 1e-6)

    one = one.withColumn("least", _bisect(within))
    if target_entropy is None:
        one = one.withColumn("exponent", F.col("least"))
    else:
        goal = target_entropy * F.ln(F.size(F.filter(shares, lambda p: p > 0)))
        # entropy grows as the exponent falls: the smallest exponent that is too uneven bounds it from above
        uneven = _bisect(lambda e: _entropy(_powered(shares, e)) <= goal)
        one = one.withColumn("exponent", F.greatest("least", uneven))
    one = stored(one.select("s", "shares", "budget", "exponent"), "mix-exponent")
    one = one.withColumn("w", _powered(shares, F.col("exponent"))).withColumn("entropy", _entropy(F.col("w")))
    rows = one.select("exponent", "entropy", "budget", F.explode(F.arrays_zip("s", "shares", "w")).alias("x"))
    return rows.select("x.s.source", F.col("x.s.tokens").alias("tokens"), F.col("x.shares").alias("share"), F.col("x.w").alias("weight"), (F.col("x.w") * F.col("budget")).alias("quota"), "exponent", "entropy")


def _digest(*parts) -> Column:
    """A pseudo-random order: the MD5 of the parts, a null being empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, target_entropy: float | None = 0.95, max_repeats: float = 4.0, block_tokens: int = 200_000, seed: int = 0, max_sources: int = 100_000
) -> DataFrame:
    """doc_id, source, n_tokens, epoch (pass over the source, from 0), block, order (position key within the mix) for every copy of a document in the mix."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), n_tokens(F.col(text_col)).alias("n_tokens"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))  # null is a source too
    rows = stored(rows.withColumn("source_key", key), "mix-rows")  # texts are read once; from here on rows are counts
    totals = stored(rows.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-totals")
    quotas = weights(totals.select(F.col("source_key").alias("source"), "tokens"), budget, target_entropy, max_repeats)
    n_blocks = F.ceil(F.greatest(F.col("tokens") / block_tokens, F.col("docs") / BLOCK_DOCS, F.lit(1.0)))
    quotas = quotas.join(totals.select(F.col("source_key").alias("source"), "docs"), "source").select(F.col("source").alias("q_source"), "tokens", "quota", n_blocks.alias("n_blocks"))
    quotas = stored(quotas, "mix-quotas")
    if quotas.count() <= max_sources:  # a row a source: broadcast while they are so few, else AQE splits the hot ones
        quotas = F.broadcast(quotas)
    rows = rows.join(quotas.select("q_source", "n_blocks"), F.col("source_key") == F.col("q_source")).drop("q_source")
    rows = rows.withColumn("block", F.conv(F.substring(_digest(seed, "block", F.col("doc_id"), F.col("text_hash")), 1, 12), 16, 10).cast("long") % F.col("n_blocks")).drop("n_blocks")

    blocks = rows.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("block_sum"))
    passes = quotas.select("q_source", "quota", "tokens", F.ceil(F.sqrt("n_blocks")).alias("n_lots"), F.explode(F.sequence(F.lit(0), F.floor(F.col("quota") / F.greatest("tokens", F.lit(1.0))).cast("int"))).alias("epoch"))
    turns = blocks.join(passes, F.col("source_key") == F.col("q_source")).drop("q_source")
    turns = turns.withColumn("turn", _digest(seed, "turn", F.col("source_key"), F.col("epoch"), F.col("block")))
    left = F.col("quota") - F.col("epoch") * F.col("tokens")  # tokens of this pass and those after it
    turns = turns.withColumn("left", left).where((F.col("left") > 0) | (F.col("epoch") == 0))
    lot = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * F.col("n_lots") / 2.0**32)  # lots follow each other as turns do
    turns = turns.withColumn("lot", lot)
    lots = turns.groupBy("source_key", "epoch", "lot").agg(F.sum("block_sum").alias("lot_sum"))
    earlier = F.sum("lot_sum").over(W.partitionBy("source_key", "epoch").orderBy("lot").rowsBetween(W.unboundedPreceding, -1))
    lots = lots.select("source_key", "epoch", "lot", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    before = F.sum("block_sum").over(W.partitionBy("source_key", "epoch", "lot").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1))
    turns = turns.withColumn("before", F.coalesce(before, F.lit(0))).join(lots, ["source_key", "epoch", "lot"]).withColumn("before", F.col("before") + F.col("earlier"))
    # a whole pass takes every block; in the last one blocks go in while they fit, and the block that doesn't is cut
    turns = turns.withColumn("room", F.when(F.col("left") >= F.col("tokens"), F.col("block_sum") + 1.0).otherwise(F.col("left") - F.col("before"))).where("room > 0")
    turns = turns.select(F.col("source_key").alias("t_source"), F.col("block").alias("t_block"), "epoch", "turn", "room", (F.col("room") < F.col("block_sum")).alias("cut"))

    taken = rows.join(turns, (F.col("source_key") == F.col("t_source")) & (F.col("block") == F.col("t_block"))).drop("t_source", "t_block")
    taken = taken.withColumn("place", _digest(seed, "place", F.col("epoch"), F.col("doc_id"), F.col("text_hash")))
    whole = taken.where(~F.col("cut"))
    within = W.partitionBy("source_key", "block", "epoch").orderBy("place", "doc_id", "text_hash")
    part = taken.where("cut").withColumn("so_far", F.sum("n_tokens").over(within.rowsBetween(W.unboundedPreceding, 0))).where("so_far <= room").drop("so_far")
    order = F.concat_ws("-", F.substring("turn", 1, 16), F.substring("place", 1, 16))
    return whole.unionByName(part).select("doc_id", "source", "n_tokens", "epoch", F.col("block").cast("long").alias("block"), order.alias("order"))
