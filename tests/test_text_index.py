"""Search through the trigram index finds what the search without it finds, and reads less."""

import uuid

import pytest
from pyspark.sql import functions as F

from docloom.operators import search, text_index
from docloom.sources import tables

DOCUMENTS = "id long, name string, format string, extracted_attributes string, owner_id string, status string, document_type string, timestamp timestamp, extra int"
ATTRIBUTES = "id long, document_id long, entity_type_label string, extracted_value string, extra int"


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("id")
    docs = spark.range(2000).select(
        "id", F.concat(F.lit("File "), F.md5(i.cast("string"))).alias("name"), F.when(i % 7 > 0, F.lit("pdf")).alias("format"), F.when(i % 3 > 0, F.concat(F.lit('{"Total": "'), i, F.lit('"}'))).alias("extracted_attributes"),
        F.when(i % 5 > 0, F.lit("me")).alias("owner_id"), F.lit("PROCESSED").alias("status"), F.lit("t").alias("document_type"), F.timestamp_seconds(i).alias("timestamp"), F.lit(1).alias("extra"))
    attributes = spark.range(6000).select(
        "id", (i % 2000).alias("document_id"), F.when(i % 4 > 0, F.lit("Größe ÄÖ")).alias("entity_type_label"), F.when(i % 9 > 0, F.concat(F.sha1(i.cast("string")), F.lit(" 50% a_b\\c"))).alias("extracted_value"), F.lit(1).alias("extra"))
    index = text_index.TextIndex(spark, f"{tables.shared_folder(spark)}/texts-{uuid.uuid4().hex}").build(docs, attributes, files=12)
    return docs, attributes, index


@pytest.mark.parametrize("q", ["abc", "ABCD", "ab", "e", "größe äö", "total\": \"19", "0% A_B\\", "a%bcd", "f1_e2", "nowhere at all", "pdf", "%", "%%ile 1%"])
def test_the_index_changes_no_result(data, q):
    docs, attributes, index = data
    wanted = {r["id"] for r in search.find_documents(docs, attributes, "me", q=q).collect()}
    got = index.find_documents("me", q).collect()
    assert {r["id"] for r in got} == wanted and len(got) == len(wanted)
    assert got == [] or set(got[0].asDict()) == set(docs.columns)


def test_a_rare_needle_reads_few_files(spark, data):
    docs, attributes, index = data
    name = docs.where("id = 1234").first()["name"][5:17]
    assert [r["id"] for r in index.find_documents("me", name).collect()] == [1234]
    assert index.candidates(name).count() < 20
    found = index.find_documents("me", name)
    assert len(found.inputFiles()) < len(search.find_documents(index.documents.read(), index.attributes.read(), "me", q=name).inputFiles())
    assert len(index.counts.lookup(gram=["abc"]).inputFiles()) <= 2
    assert index.rarest("ab") is None and index.rarest("nowhere at all") == []


def test_empty_tables(spark):
    docs, attributes = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], ATTRIBUTES)
    index = text_index.TextIndex(spark, f"{tables.shared_folder(spark)}/texts-{uuid.uuid4().hex}").build(docs, attributes, files=2)
    assert index.find_documents("me", "abc").count() == 0 and index.find_documents("me", "a").count() == 0


@pytest.mark.parametrize("kind", ["long", "int", "string", "decimal(20,2)", "date"])
def test_lists_hold_each_document_of_a_gram(spark, kind):
    """Ids of any type and far apart, in several blocks, rows out of order and texts that repeat; rare grams and ones of all documents."""
    spread = {"long": "(id - 1250) * 7205759403792793", "date": "date_add(date'1970-01-01', int(id))"}.get(kind, f"cast(id as {kind})")
    docs = spark.range(2000, numPartitions=3).selectExpr(f"{spread} AS id", "concat('Ärger ', id % 37, '😀b', id) AS name", "if(id % 3 = 0, null, 'pdf') AS format", "named_struct('k', id % 5) AS extracted_attributes")
    more = spark.range(6000, numPartitions=3).selectExpr(f"{spread.replace('id', '(id * 7 % 2500)')} AS document_id", "concat('L', id % 11) AS entity_type_label", "if(id % 4 = 0, null, concat('Wert ', id % 97)) AS extracted_value")
    more = more.unionByName(more.selectExpr("cast(null AS " + more.schema["document_id"].dataType.simpleString() + ") AS document_id", "'nobody' AS entity_type_label", "'nowhere' AS extracted_value"))
    texts = [(r[0], t) for r in docs.selectExpr("id", "array(name, format, to_json(extracted_attributes)) AS t").collect() for t in r[1]]
    texts += [(r[0], t) for r in more.collect() for t in r[1:] if r[0] is not None]
    wanted = {(t.lower()[i : i + 3], k) for k, t in texts if t for i in range(len(t) - 2)}
    lists = text_index.postings(docs, more)
    assert {tuple(r) for r in text_index.listed(lists).collect()} == wanted
    rows = lists.selectExpr("gram", "first", "n").collect()
    assert len(rows) < len(wanted) / 5 and sum(r["n"] for r in rows) >= len(wanted) and {(r["gram"], r["first"]) for r in rows} <= wanted


def test_blocks_are_bounded_and_change_nothing(spark, data, monkeypatch):
    docs, attributes, _ = data
    monkeypatch.setattr(text_index, "_BLOCK", 500)
    monkeypatch.setattr(text_index, "_ROWS", 7)
    small = text_index.postings(docs.limit(300), attributes.limit(300))
    most = small.groupBy("gram").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most > 10
    monkeypatch.undo()
    whole = text_index.postings(docs.limit(300), attributes.limit(300))
    assert set(text_index.listed(small).collect()) == set(text_index.listed(whole).collect())


def test_no_single_posting_is_shuffled_and_only_searched_columns_are_copied(data):
    docs, attributes, index = data
    plan = text_index.postings(docs, attributes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    single = text_index.listed(index.postings.read()).distinct().count()
    assert index.postings.read().count() < single / 3
    assert "extra" in index.documents.read().columns and index.attributes.read().columns == ["id", "document_id", "entity_type_label", "extracted_value"]
