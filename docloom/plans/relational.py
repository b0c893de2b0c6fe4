"""Search, list, export, review and scoping queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import labels, review, search, text_index
from ..sources import readers, tables, writers
from .adapters import view, with_views

USER, PREFIX = "user7", "user"
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that defines its result."""
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def _v(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [view(spark, d, f"v_{n}") for n in names]


_FOUND = f"""
    FROM v_attributes a JOIN v_documents d ON a.document_id = d.id LEFT JOIN (SELECT DISTINCT attribute_id FROM v_corrections) c ON c.attribute_id = a.id
    WHERE d.owner_id = '{USER}' AND a.validation_status IN ('APPROVED', 'PROCESSED')"""


@query(f"SELECT a.id, d.name AS document_name, entity_type_label, extracted_value, confidence_score, c.attribute_id IS NOT NULL AS corrected {_FOUND} AND (entity_type_label ILIKE '%r%' OR extracted_value ILIKE '%r%') AND confidence_score BETWEEN 0.2 AND 0.95 ORDER BY confidence_score DESC, a.id LIMIT 20")
def search_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The page of an attribute search."""
    a, docs, c = _v(spark, d, "attributes", "documents", "corrections")
    _, page = search.search_attributes(a, docs, c, USER, q="r", min_conf=0.2, max_conf=0.95)
    return page.select("id", "document_name", "entity_type_label", "extracted_value", "confidence_score", "corrected")


@query(f"SELECT count(*) AS total {_FOUND} AND (entity_type_label ILIKE '%r%' OR extracted_value ILIKE '%r%')")
def search_attributes_count(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    return search.search_attributes(*_v(spark, d, "attributes", "documents", "corrections"), USER, q="r")[0]


@query("""SELECT a.id, a.entity_type_label, c.id AS correction_id FROM v_attributes a JOIN v_documents d ON a.document_id = d.id JOIN v_corrections c ON c.attribute_id = a.id
          WHERE d.owner_id = 'user7' AND a.validation_status IN ('APPROVED', 'PROCESSED')""")
def search_attributes_corrected(spark: SparkSession, d: str) -> DataFrame:
    """A row for every correction."""
    a, docs, c = _v(spark, d, "attributes", "documents", "corrections")
    found = search.find_attributes(a, docs, c, USER, corrected=True, dedup=True)
    return found.join(c.select(F.col("id").alias("correction_id"), "attribute_id"), found["id"] == F.col("attribute_id")).select(found["id"], "entity_type_label", "correction_id")


@query("""SELECT count(*) AS n, count(DISTINCT a.id) AS n_attributes FROM v_attributes a JOIN v_documents d ON a.document_id = d.id JOIN v_corrections c ON c.attribute_id = a.id
          WHERE d.owner_id = 'user7' AND a.validation_status IN ('APPROVED', 'PROCESSED')""")
def search_attributes_multiplied(spark: SparkSession, d: str) -> DataFrame:
    """The total counts corrections."""
    a, docs, c = _v(spark, d, "attributes", "documents", "corrections")
    return search.find_attributes(a, docs, c, USER, corrected=True).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_attributes"))


@query("""SELECT a.id, a.extracted_value, a.confidence_score FROM v_attributes a JOIN v_documents d ON a.document_id = d.id
          WHERE d.owner_id = 'user7' AND a.validation_status IN ('APPROVED', 'PROCESSED') AND NOT EXISTS (SELECT 1 FROM v_corrections c WHERE c.attribute_id = a.id)""")
def search_attributes_uncorrected(spark: SparkSession, d: str) -> DataFrame:
    """J5."""
    return search.find_attributes(*_v(spark, d, "attributes", "documents", "corrections"), USER, corrected=False).select("id", "extracted_value", "confidence_score")


_DOC_MATCH = """(name ILIKE '%ring%' OR format ILIKE '%ring%' OR extracted_attributes ILIKE '%ring%'
    OR EXISTS (SELECT 1 FROM v_attributes a WHERE a.document_id = d.id AND (a.entity_type_label ILIKE '%ring%' OR a.extracted_value ILIKE '%ring%')))"""


@query(f"""SELECT id, name, document_type, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS created FROM v_documents d
           WHERE owner_id = 'user7' AND status IN ('APPROVED', 'PROCESSED') AND {_DOC_MATCH} ORDER BY timestamp DESC, id DESC LIMIT 20""")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """A page of a document search."""
    docs, a = _v(spark, d, "documents", "attributes")
    _, page = search.search_documents(docs, a, USER, q="ring")
    return page.select("id", "name", "document_type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))


@query(f"SELECT count(*) AS total FROM v_documents d WHERE owner_id = 'user7' AND status IN ('APPROVED', 'PROCESSED') AND {_DOC_MATCH}")
def search_documents_count(spark: SparkSession, d: str) -> DataFrame:
    """A1 J3."""
    return search.search_documents(*_v(spark, d, "documents", "attributes"), USER, q="ring")[0]


@query("SELECT status, count(*) AS n FROM v_uploads WHERE owner_id LIKE 'user1%' AND status = 'FAILED' GROUP BY status")
def search_documents_status(spark: SparkSession, d: str) -> DataFrame:
    """a given status replaces the default."""
    docs, a = _v(spark, d, "uploads", "attributes")
    rows = docs.where(F.col("owner_id").startswith("user1")).withColumn("owner_id", F.lit(USER))
    return search.find_documents(rows, a, USER, status="FAILED").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, owner_id FROM v_uploads WHERE owner_id = 'user7' AND status IN ('APPROVED', 'PROCESSED') AND document_type = 'click' AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59.999999'")
def date_end_of_day(spark: SparkSession, d: str) -> DataFrame:
    """A bare end date means the end of that day."""
    return search.find_documents(*_v(spark, d, "uploads", "attributes"), USER, document_type="click", start="2024-01-03", end="2024-01-20").select("id", "owner_id")


@query("SELECT DISTINCT document_type FROM v_documents WHERE owner_id = 'user7' AND document_type IS NOT NULL")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return search.document_types(*_v(spark, d, "documents"), USER)


@query("SELECT DISTINCT entity_type_label FROM v_attributes a JOIN v_documents d ON a.document_id = d.id WHERE d.owner_id = 'user7' AND entity_type_label IS NOT NULL")
def attribute_names(spark: SparkSession, d: str) -> DataFrame:
    """A2 J1."""
    return search.attribute_names(*_v(spark, d, "attributes", "documents"), USER)


@query("""WITH listed AS (SELECT * FROM v_documents WHERE owner_id = 'user7' ORDER BY timestamp DESC, id DESC LIMIT 50),
          x AS (SELECT l.id AS doc, a.*, p.page_number, row_number() OVER (PARTITION BY l.id ORDER BY p.page_number, a.id) AS k FROM listed l JOIN v_attributes a ON a.document_id = l.id JOIN v_pages p ON p.id = a.page_id)
          SELECT l.id, any_value(coalesce(processing_finished_at, timestamp))::DATE::VARCHAR AS shown, count(x.doc) AS attribute_count, coalesce(string_agg(extracted_value, '|' ORDER BY k) FILTER (k <= 6), '') AS first_six,
                 any_value(l.name) || ' ' || any_value(format) || ' ' || any_value(document_type) || ' ' || any_value(status) || ' ' || coalesce(string_agg(entity_type_label, ' ' ORDER BY k), '') || ' ' || coalesce(string_agg(extracted_value, ' ' ORDER BY k), '') AS search_text
          FROM listed l LEFT JOIN x ON x.doc = l.id GROUP BY l.id""")
def list_documents_summary(spark: SparkSession, d: str) -> DataFrame:
    """F4 J16 O3 O6 P5 X11."""
    docs, pages, a = _v(spark, d, "documents", "pages", "attributes")
    rows = search.list_documents(docs, pages, a, USER)
    return rows.select("id", F.col("shown_at").cast("date").cast("string").alias("shown"), "attribute_count", F.array_join(F.transform("attribute_summaries", lambda x: x["value"]), "|").alias("first_six"), "search_text")


@query("""SELECT id, attribute_count FROM (SELECT d.id, (SELECT count(*) FROM v_attributes a WHERE a.document_id = d.id) AS attribute_count FROM v_documents d WHERE owner_id = 'user7' AND
          (name ILIKE '%pending%' OR format ILIKE '%pending%' OR document_type ILIKE '%pending%' OR status ILIKE '%pending%' OR CAST(page_count AS VARCHAR) ILIKE '%pending%' OR extracted_attributes ILIKE '%pending%'
           OR EXISTS (SELECT 1 FROM v_attributes a WHERE a.document_id = d.id AND (entity_type_label ILIKE '%pending%' OR extracted_value ILIKE '%pending%' OR validation_status ILIKE '%pending%'))) ORDER BY timestamp DESC, id DESC LIMIT 200)""")
def exists_or_text(spark: SparkSession, d: str) -> DataFrame:
    """Existence under OR, the query trimmed and lower-cased."""
    docs, pages, a = _v(spark, d, "documents", "pages", "attributes")
    return search.list_documents(docs, pages, a, USER, q="  PENDING ", limit=200).select("id", "attribute_count")


@query("""SELECT a.document_id, d.name AS document_name, page_id, page_number, a.id AS attribute_id, extracted_value, validation_status FROM v_attributes a JOIN v_pages p ON p.id = a.page_id JOIN v_documents d ON d.id = a.document_id
          WHERE validation_status IN ('APPROVED', 'VALIDATED', 'CORRECTED') AND owner_id = 'user7'""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """F8 J6 O4."""
    a, p, docs = _v(spark, d, "attributes", "pages", "documents")
    return search.export_rows(a, p, docs, USER).select("document_id", "document_name", "page_id", "page_number", "attribute_id", "extracted_value", "validation_status")


@query("""SELECT a.id AS attribute_id, '[[' || x0 || '.0,' || y0 || '.0]]' AS bounding_boxes, d.name AS document_name, NULL::VARCHAR AS page_spans FROM v_attributes a JOIN v_pages p ON p.id = a.page_id JOIN v_documents d ON d.id = a.document_id
          WHERE validation_status IN ('APPROVED', 'VALIDATED', 'CORRECTED') AND owner_id = 'user7'""")
def export_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nested columns as JSON."""
    a, p, docs = _v(spark, d, "attributes", "pages", "documents")
    a = a.withColumn("bounding_boxes", F.array(F.array(F.col("x0").cast("double"), F.col("y0").cast("double"))))
    return writers.as_csv_rows(search.export_rows(a, p, docs, USER)).select("attribute_id", "bounding_boxes", "document_name", "page_spans")


@query("""SELECT a.document_id, '{"document_id":' || a.document_id || ',"attributes":[' || string_agg('{"page_number":' || page_number || ',"attribute_id":' || a.id || ',"extracted_value":"' || extracted_value || '"}', ',' ORDER BY page_number, a.id) || ']}' AS json
          FROM v_attributes a JOIN v_pages p ON p.id = a.page_id JOIN v_documents d ON d.id = a.document_id WHERE validation_status IN ('APPROVED', 'VALIDATED', 'CORRECTED') AND owner_id = 'user7' GROUP BY a.document_id""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """K3."""
    a, p, docs = _v(spark, d, "attributes", "pages", "documents")
    return writers.as_json_documents(search.export_rows(a, p, docs, USER).select("document_id", "page_number", "attribute_id", "extracted_value"))


@query("SELECT a.id, d.name AS document_name, document_type, page_number, extracted_value FROM v_attributes a JOIN v_documents d ON d.id = a.document_id JOIN v_pages p ON p.id = a.page_id WHERE owner_id = 'user7'")
def attribute_detail(spark: SparkSession, d: str) -> DataFrame:
    """J2 P6 S2."""
    a, p, docs = _v(spark, d, "attributes", "pages", "documents")
    return search.attribute_detail(a, p, docs, USER).select("id", "document_name", "document_type", "page_number", "extracted_value")


@query("""SELECT d.id, coalesce(string_agg('/documents/' || d.id || '/pages/' || page_number || '/image', ' ' ORDER BY page_number), '') AS urls FROM v_documents d LEFT JOIN v_pages p ON p.document_id = d.id WHERE owner_id = 'user7' GROUP BY d.id""")
def document_detail(spark: SparkSession, d: str) -> DataFrame:
    """P3 J16 X11."""
    docs, p = _v(spark, d, "documents", "pages")
    urls = F.array_join(F.transform(F.coalesce("pages", F.array().cast("array<struct<page_number:int,page_id:bigint,image_url:string>>")), lambda x: x["image_url"]), " ")
    return search.document_detail(docs, p, USER).select("id", urls.alias("urls"))


@query("SELECT p.id, document_id, page_number FROM v_pages p WHERE EXISTS (SELECT 1 FROM v_documents d WHERE d.id = p.document_id AND d.owner_id = 'user7')")
def rls_pages(spark: SparkSession, d: str) -> DataFrame:
    """J17 D9."""
    p, docs = _v(spark, d, "pages", "documents")
    return search.scoped(p, docs, USER).select("id", "document_id", "page_number")


@query("SELECT a.id, entity_type_label FROM v_attributes a WHERE EXISTS (SELECT 1 FROM v_documents d WHERE d.id = a.document_id AND d.owner_id = 'user7')")
def rls_attributes(spark: SparkSession, d: str) -> DataFrame:
    """J17."""
    a, docs = _v(spark, d, "attributes", "documents")
    return search.scoped(a, docs, USER).select("id", "entity_type_label")


@query("SELECT c.id, operator_user FROM v_corrections c WHERE EXISTS (SELECT 1 FROM v_attributes a JOIN v_documents d ON d.id = a.document_id WHERE a.id = c.attribute_id AND d.owner_id = 'user7')")
def rls_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Two hops."""
    c, a, docs = _v(spark, d, "corrections", "attributes", "documents")
    return search.scoped_corrections(c, a, docs, USER).select("id", "operator_user")


@query("""WITH last AS (SELECT attribute_id, arg_max(row(corrected_value, validation_status, operator_user), id) AS c, count(*) AS n FROM v_corrections GROUP BY attribute_id)
          SELECT a.id, CASE WHEN n IS NULL THEN a.extracted_value ELSE c[1] END AS extracted_value, coalesce(c[2], a.validation_status) AS validation_status, coalesce(n, 0) AS correction_count, c[3] AS operator_user
          FROM v_attributes a LEFT JOIN last ON attribute_id = a.id""")
def latest_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The latest correction over each attribute."""
    a, c = _v(spark, d, "attributes", "corrections")
    return review.apply_corrections(a, c).select("id", "extracted_value", "validation_status", "correction_count", "operator_user")


@query("""WITH s AS (SELECT * FROM v_staged WHERE confidence_score >= 0.8), v AS (SELECT * FROM v_staged WHERE confidence_score < 0.4)
          SELECT document_id, ordinal, 'staged' AS origin, CASE WHEN document_id IN (SELECT document_id FROM v) THEN 'saved' ELSE 'draft' END AS review_state FROM s
          UNION ALL SELECT document_id, ordinal, 'saved', 'saved' FROM v WHERE document_id NOT IN (SELECT document_id FROM s)""")
def staged_or_saved(spark: SparkSession, d: str) -> DataFrame:
    """U5 P4."""
    (rows,) = _v(spark, d, "staged")
    return review.staged_or_saved(rows.where("confidence_score >= 0.8"), rows.where("confidence_score < 0.4")).select("document_id", "ordinal", "origin", "review_state")


@query("""WITH s AS (SELECT 't' || document_id || '-' || ordinal AS temp_id, * FROM v_staged)
          SELECT temp_id, document_id, document_id * 100 + page_number AS page_id, 'APPROVED' AS validation_status, CASE WHEN ordinal % 4 = 0 THEN 0.5 ELSE confidence_score END AS confidence_score, CASE WHEN ordinal % 4 = 0 THEN 'manual' ELSE 'model' END AS source FROM s WHERE confidence_score >= 0.5""")
def save_selected(spark: SparkSession, d: str) -> DataFrame:
    """D6 J14 J15."""
    (rows,) = _v(spark, d, "staged")
    none = F.array().cast("array<array<double>>")
    staged = rows.withColumn("temp_id", F.concat(F.lit("t"), F.col("document_id"), F.lit("-"), F.col("ordinal"))).withColumn("bounding_boxes", none)
    chosen = staged.where("confidence_score >= 0.5").select("temp_id", "document_id", "page_number", F.concat(F.lit(" "), "entity_type_label").alias("entity_type_label"), "extracted_value", "bounding_boxes", F.lit(0.5).alias("confidence_score"), F.expr("CASE WHEN ordinal % 4 = 0 THEN 'manual' ELSE 'model' END").alias("source"))
    pages = rows.select((F.col("document_id") * 100 + F.col("page_number")).alias("id"), "document_id", "page_number").distinct()
    saved, _ = review.save_selected(staged, chosen, pages)
    return saved.select("temp_id", "document_id", "page_id", "validation_status", "confidence_score", "source")


@query("SELECT 't' || document_id || '-' || ordinal AS temp_id FROM v_staged WHERE confidence_score < 0.5")
def staged_remaining(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a partial save."""
    (rows,) = _v(spark, d, "staged")
    staged = rows.withColumn("temp_id", F.concat(F.lit("t"), F.col("document_id"), F.lit("-"), F.col("ordinal"))).withColumn("bounding_boxes", F.array().cast("array<array<double>>"))
    chosen = staged.where("confidence_score >= 0.5").withColumn("source", F.lit("model"))
    pages = rows.select((F.col("document_id") * 100 + F.col("page_number")).alias("id"), "document_id", "page_number").distinct()
    _, left = review.save_selected(staged, chosen, pages)
    return left.select("temp_id")


@query("""WITH RECURSIVE e AS (SELECT document_id, upper(trim(target)) AS target, page_rows, page_count, has_started, has_timing, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS k FROM v_status_events),
          edges AS (SELECT unnest(['PENDING','PENDING','QUEUED','QUEUED','PROCESSING','PROCESSING','PROCESSING','PROCESSED','PROCESSED','FAILED','APPROVED','CANCELED']) AS a, unnest(['QUEUED','CANCELED','PROCESSING','CANCELED','PROCESSED','FAILED','CANCELED','APPROVED','PROCESSING','QUEUED','PROCESSING','QUEUED']) AS b),
          ok AS (SELECT e.*, CASE target WHEN 'PROCESSING' THEN has_started WHEN 'PROCESSED' THEN page_rows > 0 AND page_rows = page_count AND has_timing WHEN 'FAILED' THEN has_timing WHEN 'APPROVED' THEN page_rows > 0 ELSE target <> 'DONE' END AS meets FROM e),
          fold AS (
              SELECT DISTINCT document_id, 0::BIGINT AS k, 'PENDING' AS status, 0::BIGINT AS good FROM e
              UNION ALL
              SELECT f.document_id, o.k, CASE WHEN o.meets AND (o.target = f.status OR EXISTS (SELECT 1 FROM edges WHERE a = f.status AND b = o.target)) THEN o.target ELSE f.status END,
                     f.good + CASE WHEN o.meets AND (o.target = f.status OR EXISTS (SELECT 1 FROM edges WHERE a = f.status AND b = o.target)) THEN 1 ELSE 0 END
              FROM fold f JOIN ok o ON o.document_id = f.document_id AND o.k = f.k + 1
          ) SELECT document_id, arg_max(status, k) AS status, max(good) AS n_accepted, max(k) - max(good) AS n_rejected FROM fold GROUP BY document_id""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    """A status machine folded over each document's events."""
    return review.fold_status(*_v(spark, d, "status_events"))


@query("SELECT id, status FROM v_uploads WHERE status IN ('CANCELED', 'FAILED')")
def reprocessable(spark: SparkSession, d: str) -> DataFrame:
    """D3."""
    return review.reprocessable(*_v(spark, d, "uploads")).select("id", "status")


@query("""WITH p AS (SELECT * FROM v_pages WHERE page_number <= 2), c AS (SELECT * FROM v_corrections), a AS (SELECT * FROM v_attributes WHERE source = 'model'), d AS (SELECT * FROM v_documents WHERE status <> 'QUEUED')
          SELECT 'page_without_document' AS "constraint", count(*) AS n FROM p WHERE document_id NOT IN (SELECT id FROM d)
          UNION ALL SELECT 'attribute_without_document', count(*) FROM a WHERE document_id NOT IN (SELECT id FROM d)
          UNION ALL SELECT 'attribute_without_page', count(*) FROM a WHERE page_id NOT IN (SELECT id FROM p)
          UNION ALL SELECT 'attribute_page_of_other_document', count(*) FROM a JOIN p ON p.id = a.page_id WHERE p.document_id <> a.document_id
          UNION ALL SELECT 'correction_without_attribute', count(*) FROM c WHERE attribute_id NOT IN (SELECT id FROM a)
          UNION ALL SELECT 'repeated_page', count(*) FROM (SELECT document_id, id FROM p GROUP BY ALL HAVING count(*) > 1)""")
def dq_orphans(spark: SparkSession, d: str) -> DataFrame:
    """D8."""
    docs, p, a, c = _v(spark, d, "documents", "pages", "attributes", "corrections")
    return review.orphans(docs.where("status <> 'QUEUED'"), p.where("page_number <= 2"), a.where("source = 'model'"), c)


@query("SELECT a.id, (SELECT count(*) FROM v_corrections c WHERE c.attribute_id = a.id) AS n FROM v_attributes a WHERE a.source <> 'manual'")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Attributes and their corrections without the deleted ones."""
    a, c = _v(spark, d, "attributes", "corrections")
    left, logs = review.delete_attributes(a, c, a.where("source = 'manual'").select("id"))
    return left.join(logs.groupBy("attribute_id").agg(F.count(F.lit(1)).alias("n")), F.col("id") == F.col("attribute_id"), "left").select("id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("WITH f AS (SELECT document_id, ordinal FROM v_staged WHERE confidence_score > 0.9) SELECT document_id, ordinal, 'new' AS version FROM f UNION ALL SELECT document_id, ordinal, 'old' FROM v_staged WHERE document_id NOT IN (SELECT document_id FROM f)")
def replace_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the new rows replace their old ones."""
    (rows,) = _v(spark, d, "staged")
    old, new = (x.select("document_id", "ordinal", F.lit(v).alias("version")) for x, v in ((rows, "old"), (rows.where("confidence_score > 0.9"), "new")))
    return review.replace_documents(old, new)


@query("SELECT id, (epoch_us(timestamp + to_microseconds(CAST(floor(processing_duration_seconds) AS BIGINT) * 1000000)) - epoch_us(timestamp)) / 1000000.0::DOUBLE AS seconds, lower(status) AS status FROM v_uploads")
def processing_duration(spark: SparkSession, d: str) -> DataFrame:
    """X16."""
    (docs,) = _v(spark, d, "uploads")
    end = F.timestamp_add("SECOND", F.floor("processing_duration_seconds").cast("int"), F.col("timestamp"))
    return docs.select("id", text.seconds_between(F.col("timestamp"), end).alias("seconds"), F.lower("status").alias("status"))


@query("""SELECT id, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.5 THEN 'low' ELSE 'very_low' END AS tone, CASE WHEN s >= 0.9 THEN 'good' WHEN s >= 0.75 THEN 'fair' ELSE 'poor' END AS border,
          CASE WHEN s > 1 THEN s ELSE s * 100 END AS percent, CASE status WHEN 'QUEUED' THEN 35 WHEN 'PROCESSING' THEN 67 WHEN 'PROCESSED' THEN 100 WHEN 'FAILED' THEN 100 ELSE 20 END AS progress FROM (SELECT *, processing_duration_seconds / 100 AS s FROM v_uploads)""")
def presentation_buckets(spark: SparkSession, d: str) -> DataFrame:
    """P8."""
    (docs,) = _v(spark, d, "uploads")
    s = F.col("processing_duration_seconds") / 100
    return docs.select("id", text.confidence_tone(s).alias("tone"), text.border_tone(s).alias("border"), text.percent_shown(s).alias("percent"), text.progress(F.col("status")).alias("progress"))


@query("SELECT id, format IN ('pdf', 'docx', 'png') AS is_valid FROM v_uploads")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    """S15."""
    (docs,) = _v(spark, d, "uploads")
    types = F.create_map(*[F.lit(x) for pair in (("pdf", schemas.FORMATS[".pdf"]), ("docx", schemas.FORMATS[".docx"].upper()), ("png", "image/png"), ("txt", "text/plain")) for x in pair])
    return readers.check_uploads(docs.withColumn("media_type", F.element_at(types, F.col("format")))).select("id", "is_valid")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'set' || page_id % 10 || '/sub' ELSE regexp_replace(path, '\\.[a-z]+$', '') END AS document, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 1 END AS page_number
          FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'img/p' || page_id || '.png' END AS path FROM pages)""")
def dataset_identity(spark: SparkSession, d: str) -> DataFrame:
    """S16 X12 X22."""
    rows = view(spark, d, "pages")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("set"), F.col("page_id") % 10, F.lit("\\sub\\PAGE-"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".png"))).otherwise(F.concat(F.lit("img/p"), F.col("page_id"), F.lit(".png")))
    document, page = text.dataset_identity(path)
    return rows.select("page_id", document.alias("document"), page.cast("bigint").alias("page_number"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id || ':' || page_id * 2 WHEN page_id % 3 = 1 THEN page_id || ':7' WHEN page_id % 2 = 0 THEN 'r' || page_id ELSE CAST(page_id AS VARCHAR) END AS key, regexp_matches(split_part(url, '/', 3), '^[A-Za-z0-9_-]{16,128}$') AS is_device FROM pages""")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    """X14 X22."""
    rows, p = view(spark, d, "pages"), F.col("page_id")
    key = text.record_key(F.when(p % 3 < 2, p), F.when(p % 3 == 0, p * 2), F.when(p % 3 == 1, F.lit(7)), F.when(p % 2 == 0, F.concat(F.lit("r"), p)).otherwise(""), p)
    return rows.select("page_id", key.alias("key"), text.is_device_id(F.split_part("url", F.lit("/"), F.lit(3))).alias("is_device"))


@query("SELECT id, extracted_value FROM v_attributes WHERE contains(lower(entity_type_label || ' ' || extracted_value || ' ' || validation_status), 'ring a')")
def client_filter(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    return search.filter_text(*_v(spark, d, "attributes"), "Ring A").select("id", "extracted_value")


@query("SELECT d.id, name FROM v_documents d WHERE id IN (SELECT DISTINCT document_id FROM v_attributes WHERE source = 'manual' AND confidence_score > 0.9)")
def favourites(spark: SparkSession, d: str) -> DataFrame:
    """F14."""
    docs, a = _v(spark, d, "documents", "attributes")
    return search.favourites(docs, a.where("source = 'manual' AND confidence_score > 0.9").select(F.col("document_id").alias("id"))).select("id", "name")


@query("SELECT * EXCLUDE k FROM (SELECT document_type, id, timestamp::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY document_type ORDER BY timestamp DESC, id DESC) AS k FROM v_documents) WHERE k <= 8")
def recent_per_type(spark: SparkSession, d: str) -> DataFrame:
    """The newest of each type."""
    (docs,) = _v(spark, d, "documents")
    return search.top_per_group(docs, "document_type", [F.col("timestamp").desc(), F.col("id").desc()], 8).select("document_type", "id", F.col("timestamp").cast("date").cast("string").alias("day"))


@query("SELECT document_type, CASE WHEN min_c < 0.01 THEN 'low' ELSE 'high' END AS canonical FROM (SELECT entity_type_label AS document_type, min(confidence_score) AS min_c FROM v_attributes GROUP BY 1)")
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    """U4: later tables override earlier ones."""
    (a,) = _v(spark, d, "attributes")
    base = a.select(F.col("entity_type_label").alias("document_type"), F.lit("x").alias("alias"), F.lit("high").alias("canonical")).distinct()
    more = a.where("confidence_score < 0.01").select(F.col("entity_type_label").alias("document_type"), F.lit("x").alias("alias"), F.lit("low").alias("canonical")).distinct()
    return labels.merged_aliases(base, more).select("document_type", "canonical")


# --- tables of snapshots


def _table(spark: SparkSession, rows: DataFrame, name: str, *keys: str) -> tables.SnapshotTable:
    table = tables.SnapshotTable(spark, f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    table.replace(rows, *keys)  # as many files as the rows need, so that no task sorts more as the table grows
    return table


@query("""WITH listed AS (SELECT id, name FROM v_documents WHERE owner_id = 'user7' ORDER BY timestamp DESC, id DESC LIMIT 20)
          SELECT a.id, listed.name, a.entity_type_label, a.extracted_value, a.confidence_score FROM v_attributes a JOIN listed ON a.document_id = listed.id""")
def lookup_owner_page(spark: SparkSession, d: str) -> DataFrame:
    """The attributes of an owner's newest documents, from the files of two laid-out tables that may hold them."""
    a, docs = _v(spark, d, "attributes", "documents")
    by_owner, by_document = _table(spark, docs, "documents", "owner_id", "id"), _table(spark, a, "attributes", "document_id", "id")
    page = by_owner.lookup(owner_id=USER).orderBy(F.desc("timestamp"), F.desc("id")).limit(20).select("id", "name").collect()  # a page of results
    listed = spark.createDataFrame([tuple(r) for r in page], "document_id long, name string")
    return by_document.lookup(document_id=[r["id"] for r in page]).join(F.broadcast(listed), "document_id").select("id", "name", "entity_type_label", "extracted_value", "confidence_score")


@query("""WITH again AS (SELECT id FROM v_documents WHERE status = 'QUEUED' AND document_type = '1-URGENT'),
          now AS (SELECT a.id, CASE WHEN document_id IN (SELECT id FROM again) THEN 'PENDING' ELSE validation_status END AS validation_status, confidence_score FROM v_attributes a WHERE NOT (document_id IN (SELECT id FROM again) AND confidence_score < 0.5))
          SELECT 2::BIGINT AS version, validation_status, count(*) AS n, sum(round(confidence_score * 100))::BIGINT AS percents FROM now GROUP BY validation_status
          UNION ALL SELECT 3::BIGINT, validation_status, count(*), sum(round(confidence_score * 100))::BIGINT FROM v_attributes GROUP BY validation_status""")
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents processed again replace their attributes in one commit, and a roll-back undoes it."""
    a, docs = _v(spark, d, "attributes", "documents")
    table = _table(spark, a, "attributes", "document_id", "id")
    again = docs.where("status = 'QUEUED' AND document_type = '1-URGENT'").select(F.col("id").alias("document_id"))
    rows = table.read(1).join(again.distinct().withColumn("__again", F.lit(True)), "document_id", "left")  # one join: the attributes are shuffled once
    rows = rows.where("__again IS NULL OR confidence_score >= 0.5").withColumn("validation_status", F.when(F.col("__again"), "PENDING").otherwise(F.col("validation_status"))).drop("__again")
    table.replace(rows, "document_id", "id", base=1)
    table.roll_back(1)
    summed = [table.read(v).groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence_score") * 100)).cast("bigint").alias("percents")).select(F.lit(v).cast("bigint").alias("version"), "*") for v in (2, 3)]
    return summed[0].unionByName(summed[1])


@query(f"SELECT id, name FROM v_documents d WHERE owner_id = 'user7' AND status IN ('APPROVED', 'PROCESSED') AND {_DOC_MATCH}")
def search_documents_indexed(spark: SparkSession, d: str) -> DataFrame:
    """All that a document search finds, through an index of trigrams."""
    docs, a = _v(spark, d, "documents", "attributes")
    index = text_index.TextIndex(spark, f"{tables.shared_folder(spark)}/texts-{uuid.uuid4().hex}").build(docs, a)  # as many files as the rows need
    return index.find_documents(USER, "ring").select("id", "name")
