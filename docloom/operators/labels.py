"""Labels: aliases by document type, vocabularies, ids and document types by keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import label_key, stripped
from ..schemas import UNKNOWN_TYPE

#: Aliases that are sent to every executor at most.
MOST_BROADCAST = 100_000


def normalize_labels(rows: DataFrame, aliases: DataFrame, document_type: str = "document_type", label: str = "label") -> DataFrame:
    """rows with normalized_label: the alias's field for the (lower-cased) type, else the label stripped and lower-cased, else as it was."""
    known = aliases.select(F.col("document_type").alias("__type"), F.col("alias").alias("__alias"), "canonical")
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # so that rows aren't shuffled; a larger table is joined as the planner likes
        known = F.broadcast(known)
    key = label_key(F.col(label))
    joined = rows.join(known, (F.lower(document_type) == F.col("__type")) & (key == F.col("__alias")), "left")
    plain = F.when(key != "", key).otherwise(F.col(label))
    return joined.withColumn("normalized_label", F.coalesce("canonical", plain)).drop("__type", "__alias", "canonical")


def classify(documents: DataFrame, keywords: DataFrame, key: str = "document_id", text: str = "text", name: str | None = None, most: int = 10_000) -> DataFrame:
    """key, document_type, confidence, best_score and total_score: the type whose keywords score most; ties go to the first declared.

    keywords (document_type, ordinal, keyword, weight) is a small dimension table and is collected into one literal, so
    documents are scanned where they lie: no join and no shuffle. More than `most` keywords are refused.
    """
    words = keywords.orderBy("ordinal", "keyword").limit(most + 1).collect()
    if len(words) > most:
        raise ValueError(f"more than {most} keywords")
    hay = F.lower(F.concat_ws(" ", F.coalesce(F.col(name), F.lit("")) if name else F.lit(""), F.coalesce(F.col(text), F.lit(""))))
    types = {}
    for r in words:
        types.setdefault((r["ordinal"], r["document_type"]), []).append(F.when(F.contains(F.col("__hay"), F.lit(r["keyword"].lower())), r["weight"]).otherwise(0))
    scores = F.array(*[F.struct(sum(hits[1:], hits[0]).cast("int").alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for (k, t), hits in types.items()])
    rows = documents.select(key, hay.alias("__hay")).select(key, scores.alias("s"))
    best = F.array_max("s")
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["score"])
    rows = rows.select(key, best.alias("best"), total.alias("total_score"))
    conf = F.when(F.col("total_score") > 0, F.col("best.score") / F.col("total_score")).otherwise(0.0)
    return rows.select(key, F.when(F.col("best.score") > 0, F.col("best.type")).otherwise(UNKNOWN_TYPE).alias("document_type"), conf.alias("confidence"), F.col("best.score").alias("best_score"), "total_score")


def vocabulary(*groups: DataFrame, label: str = "label") -> DataFrame:
    """The distinct non-empty labels of all groups, with ids in alphabetical order."""
    rows = groups[0].select(label)
    for more in groups[1:]:
        rows = rows.unionByName(more.select(label))
    rows = rows.where(F.col(label).isNotNull() & (stripped(F.col(label)) != "")).distinct()
    # one row a label: a vocabulary is a dimension, not data
    return rows.withColumn("label_id", F.row_number().over(W.orderBy(label)) - 1)


def head_labels(fields: DataFrame) -> DataFrame:
    """Labels of a type's classification head: `other`, then its expected fields."""
    return fields.groupBy("document_type").agg(F.concat(F.array(F.lit("other")), F.array_sort(F.collect_set("field"))).alias("labels"))


def merged_aliases(*maps: DataFrame) -> DataFrame:
    """Union of alias tables (document_type, alias, canonical); a later table overrides an earlier one."""
    rows = maps[0].withColumn("rank", F.lit(0))
    for k, more in enumerate(maps[1:], 1):
        rows = rows.unionByName(more.withColumn("rank", F.lit(k)))
    return rows.groupBy("document_type", "alias").agg(F.max_by("canonical", "rank").alias("canonical"))
