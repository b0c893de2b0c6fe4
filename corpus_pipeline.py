"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage but the last returns the columns of `documents`. Between stages the
rows are written to the shared folder and read again. A stage of which nothing is
left gives an empty table, and so do those after it; nulls, empty texts, repeated
rows and further columns are treated as each operator states (further columns of
`documents` don't come out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, line_dedup, minhash, mixing, toxicity
from docloom.llm.common import TEXT_HASH, by_document, identified, intermediates, new_dir, remove
from docloom.llm.queries import fold, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=fold(3) != 1)
    return toxicity.score(docs.select(*COLUMNS), model).where("__score < 0.7").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; documents stay, with n_chars of what is left."""
    docs = docs.select(*COLUMNS)
    maps = line_dedup.keep_bitmaps(docs, min_docs=10)
    rows = identified(docs, "doc_id", "text", "lang", "source")
    return line_dedup.apply_bitmaps(rows, maps).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id; of rows that repeat it, all."""
    docs = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id", TEXT_HASH).distinct()
    rows = identified(docs, "doc_id", "text", "lang", "source", "n_chars")
    return by_document(rows, kept, "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontam.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), n=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every copy of a document in it."""
    return mixing.mix(docs, target_entropy=0.98, max_repeats=4.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage scores by a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; what a stage stored on its way, and the documents before it, are deleted once its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, f"stage-{name}")
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
