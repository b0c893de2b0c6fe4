"""Token tables: confidence gates, blank pages, lines, chunks of a model's window and their stitching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stripped

# Lowest confidence kept, tokens under which a page may be blank, confidence under which it then is.
LEAST_CONFIDENCE, LEAST_TOKENS, BLANK_CONFIDENCE = 25.0, 3, 30.0
MODEL_TOKENS, MOST_OVERLAP = 512, 64


def confidence_gate(tokens: DataFrame, least: float = LEAST_CONFIDENCE, conf: str = "conf_pct") -> DataFrame:
    """Tokens at or over the least confidence; a raw confidence of -1 counts as 0."""
    value = F.when(F.col(conf) == -1, 0.0).otherwise(F.col(conf))
    return tokens.withColumn(conf, value).where(F.col(conf) >= least)


def blank_pages(pages: DataFrame, tokens: DataFrame, page: str = "page_id", conf: str = "conf_pct") -> DataFrame:
    """Pages (rows of `pages`) with under LEAST_TOKENS gated tokens, none of them good: all under 30 and none at exactly 25."""
    per = tokens.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.max(conf).alias("best"), F.bool_or(F.col(conf) == LEAST_CONFIDENCE).alias("boundary"))
    joined = pages.select(page).distinct().join(per, page, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    blank = (F.col("n") < LEAST_TOKENS) & ((F.col("n") == 0) | ((F.col("best") < BLANK_CONFIDENCE) & ~F.col("boundary")))
    return joined.where(blank).select(page, F.col("n").cast("bigint").alias("n_tokens"))


def kept_tokens(tokens: DataFrame, page: str = "page_id") -> DataFrame:
    """The gated tokens of pages that aren't blank."""
    gated = confidence_gate(tokens)
    return gated.join(blank_pages(tokens, gated, page), page, "left_anti")


def usable(tokens: DataFrame, token: str = "token", box: str = "bbox") -> DataFrame:
    return tokens.where((stripped(F.col(token)) != "") & (F.size(box) == 4))


def lines(tokens: DataFrame, keys: tuple[str, ...] = ("document_id", "page_id")) -> DataFrame:
    """One row per (block, paragraph, line) with its text, tokens joined by a space in order."""
    ordered = F.array_sort(F.collect_list(F.struct("token_index", "token")))
    text = F.array_join(F.transform(ordered, lambda x: x["token"]), " ")
    return tokens.groupBy(*keys, "block_num", "paragraph_num", "line_num").agg(text.alias("text"), F.count(F.lit(1)).alias("n_tokens"))


def page_text(lines_: DataFrame, keys: tuple[str, ...] = ("document_id", "page_id")) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("block_num", "paragraph_num", "line_num", "text")))
    return lines_.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def line_counts(tokens: DataFrame, page: str = "page_id") -> DataFrame:
    return tokens.groupBy(page).agg(F.countDistinct("block_num", "paragraph_num", "line_num").alias("n_lines"))


def chunk_sizes(model_tokens: int = MODEL_TOKENS) -> tuple[int, int]:
    """Tokens of a chunk and of the overlap of neighbours."""
    size = max(1, model_tokens - 2)
    return size, max(1, min(MOST_OVERLAP, size // 4)) if size > 1 else 0


def chunk_ranges(pages: DataFrame, n: str = "n_tokens", model_tokens: int = MODEL_TOKENS) -> DataFrame:
    """A row (chunk_start, chunk_end) for each overlapping chunk of a page; one chunk where all fits, also without tokens."""
    size, overlap = chunk_sizes(model_tokens)
    step = max(1, size - overlap)
    last = F.when(F.col(n) > size, F.ceil((F.col(n) - size) / step) * step).otherwise(0).cast("int")
    starts = pages.withColumn("chunk_start", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    return starts.withColumn("chunk_end", F.least(F.col(n), F.col("chunk_start") + size).cast("int"))


def stitch(predictions: DataFrame, page: str = "page_id") -> DataFrame:
    """The most confident prediction of each token; of equals that of the earlier chunk, then of the earlier sub-token."""
    indexed = predictions.withColumn("token_index", F.col("chunk_start") + F.col("local_index"))
    best = F.max_by(F.struct("token", "label", "confidence"), F.struct("confidence", -F.col("chunk_start"), -F.col("sub_index")))
    return indexed.groupBy(page, "token_index").agg(best.alias("best")).select(page, "token_index", "best.token", "best.label", "best.confidence")


def fill_gaps(tokens: DataFrame, stitched: DataFrame, page: str = "page_id", label: str = "hitl") -> DataFrame:
    """Every token with its prediction; one that the model left out is up for review with confidence 0."""
    found = stitched.select(page, "token_index", F.col("label").alias("__label"), F.col("confidence").alias("__confidence"))
    joined = tokens.join(found, [page, "token_index"], "left")
    return joined.withColumn("label", F.coalesce("__label", F.lit(label))).withColumn("confidence", F.coalesce("__confidence", F.lit(0.0))).drop("__label", "__confidence")


def by_label(predictions: DataFrame, page: str = "page_id") -> DataFrame:
    """A page's tokens and mean confidence, each as a map by label."""
    per = predictions.groupBy(page, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_index", "token"))), lambda x: x["token"]).alias("tokens"), F.avg("confidence").alias("mean"))
    entries = F.array_sort(F.collect_list(F.struct("label", "tokens", "mean")))
    return per.groupBy(page).agg(entries.alias("e")).select(
        page,
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["label"], x["tokens"]))).alias("entities"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["label"], x["mean"]))).alias("mean_confidence_by_label"),
    )


def align_subtokens(subtokens: DataFrame, seq: str = "seq_id") -> DataFrame:
    """label_id of sub-tokens: the first of a word has the word's, the others and special ones (no word) -100."""
    before = F.lag("word_id").over(W.partitionBy(seq).orderBy("pos"))
    first = F.col("word_id").isNotNull() & ~F.col("word_id").eqNullSafe(before)
    return subtokens.withColumn("label_id", F.when(first, F.col("word_label")).otherwise(-100))


def attach_layout(predictions: DataFrame, tokens: DataFrame, page: str = "page_id") -> DataFrame:
    """Predictions with the block, paragraph and line of the token at the same index."""
    return predictions.join(tokens.select(page, "token_index", "block_num", "paragraph_num", "line_num"), [page, "token_index"])


def ocr_only(tokens: DataFrame) -> DataFrame:
    """What stands for a model's predictions where there is no model."""
    return tokens.withColumn("label", F.lit("OCR")).withColumn("confidence", F.lit(0.0))


def quality(tokens: DataFrame, page: str = "page_id", conf: str = "conf_pct") -> DataFrame:
    """Count, mean and median confidence of a page and how many tokens are under 50."""
    return tokens.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean"), F.percentile(conf, F.lit(0.5)).alias("median"), F.count_if(F.col(conf) < 50).alias("below_50"))


def quality_sketches(tokens: DataFrame, page: str = "page_id", conf: str = "conf_pct", width: float = 1.0) -> DataFrame:
    """A page's confidences as `bins` (bin, n, total, below_50) of one width: a table to store, of which any pages are merged later.

    What is under 0 or over 100 shares a bin at either end, so a page has at most 100 / width + 3 bins; nulls and NaN have one without a number.
    """
    if not 0 < width <= 100:
        raise ValueError("width must be over 0 and at most 100")
    value = F.when(~F.isnan(F.col(conf).cast("double")), F.col(conf).cast("double"))
    place = F.when(value.isNotNull(), F.greatest(F.lit(-1), F.least(F.lit(math.ceil(100 / width)), F.floor(value / width))))
    rows = tokens.select(page, value.alias("__value"), place.cast("int").alias("bin"))
    counts = rows.groupBy(page, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("__value").alias("total"), F.count_if(F.col("__value") < 50).alias("below_50"))
    return counts.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "total", "below_50"))).alias("bins"))


def merged_quality(sketches: DataFrame, by: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """by, n, mean, quantiles (unset: the median) and below_50 of all pages that share `by`, from their sketches alone.

    A quantile is off by less than a bin's width, and not at all where a bin's values are equal (whole percents in bins of one).
    Only bins are shuffled, summed on the way: what a group costs doesn't grow with its pages. Without a confidence the mean and quantiles are null.
    """
    bins = sketches.select(by, F.explode("bins").alias("b")).groupBy(F.col(by), F.col("b.bin").alias("bin")).agg(*[F.sum(f"b.{c}").alias(c) for c in ("n", "total", "below_50")])
    known = F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n", "total"))))
    rows = bins.groupBy(by).agg(F.sum("n").alias("n"), F.sum("total").alias("__total"), F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).alias("__known"), F.sum("below_50").alias("below_50"), known.alias("__bins"))

    def ranked(rank: Column) -> Column:
        """The value of a rank (from 0): the mean of the bin that it lies in."""
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("value"))
        step = lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.coalesce(a["value"], F.when(a["seen"] + b["n"] > rank, b["total"] / b["n"])).alias("value"))
        return F.aggregate("__bins", start, step, lambda a: a["value"])

    def quantile(q: float) -> Column:
        at = (F.col("__known") - 1) * F.lit(float(q))
        low = ranked(F.floor(at))
        return low + (ranked(F.ceil(at)) - low) * (at - F.floor(at))

    return rows.select(by, "n", (F.col("__total") / F.col("__known")).alias("mean"), *[quantile(q).alias(name) for name, q in (quantiles or {"median": 0.5}).items()], "below_50")


def let(value: Column, use) -> Column:
    """use(value), the value being computed once."""
    return F.get(F.transform(F.array(value), use), 0)
