"""Every dealt query against its SQL on the smallest tables, and every operator on awkward rows."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontam, fingerprint, langid, line_dedup, minhash, mixing, pii, queries, suffix_dedup, toxicity, warc
from tests.conftest import SMALL, same_rows

LONG = " ".join(f"word{k % 977}" for k in range(60_000))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"op13_graph_search"}))
def test_query_without_sql_keeps_documents(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert got.select("doc_id").distinct().count() <= n if name == "op3_mixing" else got.count() == n


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, an id with two texts, and columns named as operators might name theirs."""
    rows = [
        (1, "a b c d e f g h", "en", "s"), (1, "a b c d e f g h", "en", "s"), (1, "another text of the same id", "en", "s"),
        (2, None, "en", None), (3, "", None, "s"), (None, "no id at all here", "de", "t"), (None, None, None, None),
        (4, LONG, "en", "s"), (5, LONG + " end", "en", "s"), (6, "\n\n \t\n", "fr", "t"), (7, "é" * 500 + " x", "fr", "t"),
    ]
    clashing = {c: F.lit(0) for c in ("h", "key", "id", "spans", "n", "component", "positions", "n_lines", "kind", "__th", "block", "tokens", "found", "scores", "items")}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(clashing)


def operators(spark, docs, names=None):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    if names:
        bench, labels = bench.withColumn("item_id", F.concat(F.lit("mmlu/"), "item_id")), labels.withColumn("doc_id", F.concat(F.lit(names), "doc_id"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    return {
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]),
        "warc": lambda: warc.read_archives(spark, warc.write_archives(pages), id_type="string" if names else "long"),
        "line_dedup": lambda: line_dedup.drop_shared_lines(docs, min_docs=2),
        "minhash": lambda: minhash.near_duplicates(docs),
        "suffix_dedup": lambda: suffix_dedup.remove_repeats(docs, length=64),
        "langid": lambda: langid.predict(docs, langid.fit(docs, train_docs=10)),
        "fingerprint": lambda: fingerprint.edited_with_next(docs),
        "trees": lambda: fingerprint.trees(docs),
        "pii": lambda: pii.find(docs),
        "redact": lambda: pii.redact(docs),
        "decontam": lambda: decontam.contamination(docs, bench),
        "decontam_blocks": lambda: decontam.contamination(docs, bench, block_words=2),
        "clean": lambda: decontam.clean_documents(docs.select("doc_id", "text", "lang"), bench.limit(0)),
    }


@pytest.mark.parametrize("name", ["toxicity", "warc", "line_dedup", "minhash", "suffix_dedup", "langid", "fingerprint", "trees", "pii", "redact", "decontam", "decontam_blocks", "clean"])
def test_awkward_rows_are_all_answered(spark, name):
    docs = awkward(spark)
    assert operators(spark, docs)[name]().count() == docs.count()


@pytest.mark.parametrize("name", ["toxicity", "warc", "line_dedup", "minhash", "suffix_dedup", "langid", "fingerprint", "trees", "pii", "redact", "decontam", "decontam_blocks", "clean"])
def test_ids_may_be_strings(spark, name):
    """String ids give what the numbers give that they were made of."""
    docs = awkward(spark)
    named = docs.withColumn("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    of_numbers, of_strings = operators(spark, docs)[name](), operators(spark, named, "d/")[name]()
    assert of_strings.count() == of_numbers.count()
    same = [c for c in ("n_dropped", "n_lines", "n_shingles", "kept", "n_bytes", "spans", "n_words", "n_hit", "contaminated", "text", "payload_bytes", "record_type") if c in of_numbers.columns]
    assert sorted(map(str, of_strings.select(*same).collect())) == sorted(map(str, of_numbers.select(*same).collect()))


@pytest.mark.parametrize("name", ["toxicity", "warc", "line_dedup", "minhash", "suffix_dedup", "langid", "fingerprint", "trees", "pii", "redact", "decontam", "clean"])
def test_empty_tables_give_empty_results(spark, name):
    assert operators(spark, awkward(spark).limit(0))[name]().count() == 0


def test_mixing_on_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix(docs, target_entropy=None, max_repeats=1.0)
    assert got.count() <= docs.count() and got.where("source is null").count() == 2
    assert mixing.mix(docs.limit(0)).count() == 0
