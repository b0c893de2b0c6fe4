"""The engine's relations as views over the star-schema tables, in SQL that both Spark and the oracle's engine run.

``VIEWS`` holds the text; ``view`` runs one in Spark, ``with_views`` puts those that an oracle uses before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # events as uploaded documents
    "v_uploads": """
        SELECT event_id AS id, 'doc_' || CAST(event_id AS VARCHAR(20)) || CASE event_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.PNG' ELSE '.txt' END AS name,
               CASE event_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'png' ELSE 'txt' END AS format,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'user' || CAST(user_id AS VARCHAR(20)) END AS owner_id, event_type AS document_type,
               CAST(1 + event_id % 4 AS INT) AS page_count, ts AS timestamp, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS processing_finished_at, value AS processing_duration_seconds,
               CASE event_id % 7 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'APPROVED' WHEN 4 THEN 'CANCELED' ELSE 'PROCESSED' END AS status, props AS extracted_attributes
        FROM events""",
    # orders as documents, line items as their attributes
    "v_documents": """
        SELECT o_orderkey AS id, 'order_' || CAST(o_orderkey AS VARCHAR(20)) || '.pdf' AS name, CASE o_orderkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'png' END AS format,
               CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE 'user' || CAST(o_custkey % 50 AS VARCHAR(20)) END AS owner_id, o_orderpriority AS document_type, CAST(3 AS INT) AS page_count,
               o_orderdate AS timestamp, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS processing_finished_at, o_totalprice AS processing_duration_seconds,
               CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'O' THEN 'QUEUED' ELSE 'APPROVED' END AS status, '{"staged": ' || CAST(o_orderkey % 100 AS VARCHAR(20)) || '}' AS extracted_attributes
        FROM orders""",
    "v_attributes": """
        SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS id, l_orderkey * 4 + l_linenumber % 3 AS page_id, l_orderkey AS document_id,
               l_returnflag || '_' || l_linestatus AS entity_type_label, p_name AS extracted_value, CAST((l_partkey * 37 + l_suppkey * 11) % 101 AS DOUBLE) / 100 AS confidence_score,
               CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'HITL' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'VALIDATED' WHEN 4 THEN 'CORRECTED' ELSE 'PROCESSED' END AS validation_status,
               CASE WHEN l_suppkey % 5 = 0 THEN 'manual' ELSE 'model' END AS source,
               CAST(l_partkey * 7 % 900 AS INT) AS x0, CAST(l_suppkey * 13 % 900 AS INT) AS y0, CAST(l_partkey * 7 % 900 + 20 + l_quantity AS INT) AS x1, CAST(l_suppkey * 13 % 900 + 15 + l_linenumber AS INT) AS y1
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_pages": "SELECT DISTINCT l_orderkey * 4 + l_linenumber % 3 AS id, l_orderkey AS document_id, CAST(1 + l_linenumber % 3 AS INT) AS page_number FROM lineitem",
    # an approved or corrected attribute has one or two corrections
    "v_corrections": """
        SELECT a.id * 2 + k AS id, a.id AS attribute_id, a.extracted_value AS original_prediction, a.extracted_value || ' v' || CAST(k AS VARCHAR(2)) AS corrected_value,
               'op' || CAST(a.id % 7 AS VARCHAR(2)) AS operator_user, CASE WHEN k = 1 THEN 'CORRECTED' END AS validation_status
        FROM v_attributes a JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) n ON k <= a.page_id % 4
        WHERE a.validation_status IN ('APPROVED', 'CORRECTED')""",
    # line items of an order as the boxes of a page, and moved a little as its tokens
    "v_boxes": """
        SELECT document_id AS page_id, id AS box_order, entity_type_label AS label, x0, y0, x1, y1 FROM v_attributes""",
    "v_boxed_tokens": """
        SELECT document_id AS page_id, id AS token_index, extracted_value AS token, x0 + 3 AS x0, y0 + 2 AS y0, x1 + 5 AS x1, y1 + 4 AS y1 FROM v_attributes""",
    # labels joined to documents: quality is the truth, length and language the prediction
    "v_eval": """
        SELECT CAST(d.doc_id AS VARCHAR(20)) AS key, d.doc_id AS pos, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS t_label,
               CASE WHEN n_chars > 400 THEN 'good' WHEN lang = 'en' THEN 'bad' ELSE 'unsure' END AS p_label
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    # turns as token sequences with true and predicted labels
    "v_sequences": """
        SELECT conv_id AS seq_id, turn AS pos, CASE CAST(FLOOR(turn / 2) AS BIGINT) % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'O' ELSE 'date' END AS ref,
               CASE (conv_id + CAST(FLOOR(turn / 3) AS BIGINT)) % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'O' ELSE 'date' END AS pred, (conv_id + turn) % 7 = 0 AS ignored, role, text
        FROM conversations""",
    # overlapping chunk predictions of a conversation's turns; the model leaves out short ones
    "v_chunks": """
        SELECT conv_id AS page_id, CAST(c * 3 AS INT) AS chunk_start, CAST(turn - c * 3 AS INT) AS local_index, CAST(s AS INT) AS sub_index, role AS token,
               CASE (conv_id + turn + c + s) % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'date' WHEN 2 THEN 'total' ELSE 'other' END AS label, CAST((conv_id * 7 + turn * 13 + c * 5 + s * 3) % 11 AS DOUBLE) / 10 AS confidence
        FROM conversations JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) k ON turn >= c * 3 AND turn < c * 3 + 5 JOIN (SELECT 0 AS s UNION ALL SELECT 1) q ON s <= turn % 2
        WHERE length(text) > 100""",
    # turns as attributes of pages
    "v_staged": """
        SELECT conv_id AS document_id, turn AS ordinal, CAST(1 + FLOOR(turn / 2) AS INT) AS page_number, CASE WHEN conv_id % 5 = 0 THEN 'OCR' ELSE 'f' || CAST(FLOOR(turn / 4) AS INT) END AS entity_type_label,
               role || CAST(turn AS VARCHAR(9)) AS extracted_value, CAST((conv_id * 3 + turn * 17) % 101 AS DOUBLE) / 100 AS confidence_score
        FROM conversations""",
    "v_status_events": """
        SELECT user_id AS document_id, event_id AS seq, CASE event_id % 8 WHEN 0 THEN 'queued ' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'PROCESSED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'APPROVED' WHEN 5 THEN 'CANCELED' WHEN 6 THEN 'QUEUED' ELSE 'DONE' END AS target,
               CAST(event_id % 3 AS INT) AS page_rows, CAST(event_id % 2 + 1 AS INT) AS page_count, value > 20 AS has_started, value > 50 AS has_timing
        FROM events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table as it is."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = {n for n in (*TABLES, *VIEWS) if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}
    for n in used:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in used})


def with_views(sql: str) -> str:
    """sql with the definitions of the views it uses."""
    names: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if n not in names and re.search(rf"\b{n}\b", text):
                add(VIEWS[n])
                if n not in names:
                    names.append(n)

    add(sql)
    if not names:
        return sql
    return _before(sql, ", ".join(f"{n} AS ({VIEWS[n]})" for n in names))


def _before(sql: str, definitions: str) -> str:
    """sql with further definitions in front of its own."""
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{definitions}, {body[len(start):]}"
    return f"WITH {definitions} {body}"


#: Bytes of the stored documents whose tokens one partition holds: as rows, sorted and gathered, they take over a hundred times that.
_DEALT = 2 << 20


def tokens(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """documents.text as tokens: a line feed ends a line, a space a word, four lines are a paragraph. Positions come from the text alone: no shuffle.

    by_page: documents are dealt out by id before they are split, so that what is grouped or ordered by page later needs no
    shuffle of tokens; partitions grow in number with the table, never in size.
    """
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    if by_page:
        parts = -(-storage.size_of(spark, f"{sf_dir}/documents.parquet") // _DEALT)
        docs = docs.repartition(max(spark.sparkContext.defaultParallelism, parts), "doc_id")
    split = F.transform(F.split("text", "\n"), lambda line, k: F.transform(F.split(line, " "), lambda w, j: F.struct(k.alias("line"), j.alias("word"), w.alias("token"))))
    rows = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.filter(F.flatten(split), lambda t: t["token"] != "")).alias("token_index", "t"))
    line, word, n = F.col("t.line"), F.col("t.word"), F.length("t.token")
    x0, y0 = word * 37 % 900, line * 29 % 950
    return rows.select("document_id", F.col("document_id").alias("page_id"), "token_index", F.col("t.token").alias("token"), ((F.col("document_id") * 31 + F.col("token_index") * 17) % 101).cast("double").alias("conf_pct"),
                       x0.alias("x0"), y0.alias("y0"), (x0 + n * 8).alias("x1"), (y0 + 12).alias("y1"), F.lit(1).alias("block_num"), F.floor(line / 4 + 1).cast("int").alias("paragraph_num"), (line + 1).alias("line_num"), (word + 1).alias("word_num"))


#: The same rows for the oracle.
TOKENS_SQL = """
    SELECT document_id, document_id AS page_id, token_index, token, ((document_id * 31 + token_index * 17) % 101)::DOUBLE AS conf_pct, (word * 37 % 900)::INT AS x0, (line * 29 % 950)::INT AS y0,
           (word * 37 % 900 + len(token) * 8)::INT AS x1, (line * 29 % 950 + 12)::INT AS y1, 1 AS block_num, (line // 4 + 1)::INT AS paragraph_num, (line + 1)::INT AS line_num, (word + 1)::INT AS word_num
    FROM (SELECT document_id, line, word, token, row_number() OVER (PARTITION BY document_id ORDER BY line, word) - 1 AS token_index
          FROM (SELECT document_id, line, unnest(words) AS token, unnest(range(len(words))) AS word
                FROM (SELECT document_id, string_split(unnest(lines), ' ') AS words, unnest(range(len(lines))) AS line FROM (SELECT doc_id AS document_id, string_split(text, chr(10)) AS lines FROM documents)))
          WHERE token <> '')"""


def with_tokens(sql: str) -> str:
    return _before(sql, f"tokens AS ({TOKENS_SQL})")
