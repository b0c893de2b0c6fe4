"""Token, geometry, clustering, evaluation and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import cluster, evaluate, export, labels, split
from ..operators import tokens as tok
from ..schemas import line_label_map
from ..sources import boundary
from .adapters import tokens, view, with_tokens, with_views

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, on_tokens: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_tokens(sql) if on_tokens else with_views(sql)
        return f

    return add


# --- tokens


@query("SELECT page_id, count(*) AS n, sum(conf_pct) AS total FROM tokens WHERE conf_pct >= 25 GROUP BY page_id", on_tokens=True)
def ocr_confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """F9."""
    return tok.confidence_gate(tokens(spark, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("conf_pct").alias("total"))


@query("""WITH t AS (SELECT document_id * 100000 + line_num AS page_id, token_index, conf_pct FROM tokens), g AS (SELECT * FROM t WHERE conf_pct >= 25), p AS (SELECT DISTINCT page_id FROM t)
          SELECT page_id, count(g.token_index) AS n_tokens FROM p LEFT JOIN g USING (page_id) GROUP BY page_id HAVING count(g.token_index) = 0 OR (count(g.token_index) < 3 AND max(conf_pct) < 30 AND NOT bool_or(conf_pct = 25))""", on_tokens=True)
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    """every line as a page of its own."""
    rows = tokens(spark, d).withColumn("page_id", F.col("document_id") * 100000 + F.col("line_num"))
    return tok.blank_pages(rows, tok.confidence_gate(rows))


@query("SELECT document_id, paragraph_num, line_num, string_agg(token, ' ' ORDER BY token_index) AS text, count(*) AS n_tokens FROM tokens GROUP BY ALL", on_tokens=True)
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    return tok.lines(tokens(spark, d, by_page=True)).select("document_id", "paragraph_num", "line_num", "text", "n_tokens")


@query("WITH l AS (SELECT document_id, line_num, string_agg(token, ' ' ORDER BY token_index) AS text FROM tokens GROUP BY ALL) SELECT document_id, md5(string_agg(text, chr(10) ORDER BY line_num)) AS digest FROM l GROUP BY ALL", on_tokens=True)
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """A6 W11."""
    return tok.page_text(tok.lines(tokens(spark, d, by_page=True))).select("document_id", F.md5("text").alias("digest"))


@query("SELECT page_id, count(DISTINCT line_num) AS n_lines FROM tokens GROUP BY page_id", on_tokens=True)
def line_count(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    return tok.line_counts(tokens(spark, d))


@query("SELECT page_id, count(*) AS n, avg(conf_pct) AS mean, median(conf_pct) AS median, count(*) FILTER (conf_pct < 50) AS below_50 FROM tokens GROUP BY page_id", on_tokens=True)
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return tok.quality(tokens(spark, d))


@query("SELECT source, count(*) AS n, avg(conf_pct) AS mean, median(conf_pct) AS median, quantile_cont(conf_pct, 0.1) AS p10, count(*) FILTER (conf_pct < 50) AS below_50 FROM tokens JOIN documents ON doc_id = document_id GROUP BY source", on_tokens=True)
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """pages' sketches merged by source."""
    owner = view(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "source")
    return tok.merged_quality(tok.quality_sketches(tokens(spark, d, by_page=True)).join(owner, "page_id"), "source", {"median": 0.5, "p10": 0.1})


@query("""SELECT page_id, s::INT AS chunk_start, least(n, s + 510)::INT AS chunk_end FROM (SELECT page_id, n, unnest(range(0, CASE WHEN n > 510 THEN (ceil((n - 510) / 446.0) * 446)::BIGINT ELSE 0 END + 1, 446)) AS s FROM (SELECT page_id, count(*) AS n FROM tokens GROUP BY page_id))""", on_tokens=True)
def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    pages = tokens(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n_tokens"))
    return tok.chunk_ranges(pages).select("page_id", "chunk_start", "chunk_end")


@query("SELECT page_id, token_index, label, confidence FROM (SELECT *, chunk_start + local_index AS token_index, row_number() OVER (PARTITION BY page_id, chunk_start + local_index ORDER BY confidence DESC, chunk_start, sub_index) AS k FROM v_chunks) WHERE k = 1")
def chunk_stitch(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    return tok.stitch(view(spark, d, "v_chunks")).select("page_id", "token_index", "label", "confidence")


@query("""WITH s AS (SELECT page_id, token_index, label, confidence FROM (SELECT *, chunk_start + local_index AS token_index, row_number() OVER (PARTITION BY page_id, chunk_start + local_index ORDER BY confidence DESC, chunk_start, sub_index) AS k FROM v_chunks) WHERE k = 1)
          SELECT conv_id AS page_id, turn AS token_index, coalesce(label, 'hitl') AS label, coalesce(confidence, 0) AS confidence FROM conversations LEFT JOIN s ON page_id = conv_id AND token_index = turn""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """W9."""
    all_tokens = view(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("token_index"))
    return tok.fill_gaps(all_tokens, tok.stitch(view(spark, d, "v_chunks"))).select("page_id", "token_index", "label", "confidence")


@query("""WITH s AS (SELECT page_id, chunk_start + local_index AS i, arg_max(row(token, label, confidence), row(confidence, -chunk_start, -sub_index)) AS b FROM v_chunks GROUP BY ALL)
          SELECT page_id, string_agg(label || '=' || words || '=' || round(mean, 6), ';' ORDER BY label) AS layout FROM (SELECT page_id, b[2] AS label, string_agg(b[1], ' ' ORDER BY i) AS words, sum(round(b[3] * 10)) / 10 / count(*) AS mean FROM s GROUP BY ALL) GROUP BY page_id""")
def mean_confidence_by_label(spark: SparkSession, d: str) -> DataFrame:
    """A5 X20."""
    maps = tok.by_label(tok.stitch(view(spark, d, "v_chunks")))
    entry = F.transform(F.array_sort(F.map_keys("entities")), lambda k: F.concat_ws("=", k, F.array_join(F.element_at("entities", k), " "), F.round(F.element_at("mean_confidence_by_label", k), 6).cast("string")))
    return maps.select("page_id", F.array_join(entry, ";").alias("layout"))


@query("SELECT seq_id, pos, CASE WHEN pos % 3 = 2 THEN -100 WHEN pos % 3 = 1 THEN -100 ELSE pos + 1 END AS label_id FROM v_sequences")
def subtoken_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Words of two sub-tokens with a special one after each."""
    rows = view(spark, d, "v_sequences").select("seq_id", "pos", F.when(F.col("pos") % 3 < 2, F.floor(F.col("pos") / 3)).alias("word_id"), (F.col("pos") + 1).alias("word_label"))
    return tok.align_subtokens(rows).select("seq_id", "pos", "label_id")


# --- geometry


@query("""SELECT document_id, token_index, greatest(0, least(1000, round_even(1000.0::DOUBLE * x0 / 640, 0)))::INT AS x0, greatest(0, least(1000, round_even(1000.0::DOUBLE * y0 / 900, 0)))::INT AS y0,
          greatest(0, least(1000, round_even(1000.0::DOUBLE * x1 / 640, 0)))::INT AS x1, greatest(0, least(1000, round_even(1000.0::DOUBLE * y1 / 900, 0)))::INT AS y1 FROM tokens""", on_tokens=True)
def normalize_bbox(spark: SparkSession, d: str) -> DataFrame:
    """X3."""
    rows = tokens(spark, d)
    box = geometry.normalized([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(640), F.lit(900))
    return rows.select("document_id", "token_index", *[b.alias(c) for b, c in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


def _scaled(k: int) -> str:
    v, side = f"b[{k + 1}]", ("800", "1200")[k % 2]
    return f"greatest(0, least(1000, round_even(CASE WHEN m <= 1 THEN {v} * 1000 WHEN m > 1000 OR m > 1200 THEN {v} * 1000 / {side} ELSE {v} END, 0)))::INT AS {('x0', 'y0', 'x1', 'y1')[k]}"


@query(f"SELECT id, {', '.join(_scaled(k) for k in range(4))} FROM (SELECT id, b, list_max(b) AS m FROM (SELECT id, [x / CASE id % 3 WHEN 0 THEN 2048.0 WHEN 1 THEN 0.5 ELSE 1.0 END FOR x IN [x0::DOUBLE, y0::DOUBLE, x1::DOUBLE, y1::DOUBLE]] AS b FROM v_attributes))")
def attr_box_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Fractions, pixels and normalised boxes; malformed ones go."""
    a = view(spark, d, "v_attributes")
    unit = F.when(F.col("id") % 3 == 0, 2048.0).when(F.col("id") % 3 == 1, 0.5).otherwise(1.0)
    raw = F.transform(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]), lambda x: x / unit)
    boxes = F.array(F.slice(raw, 1, 3), raw, F.array(*[F.lit(float("nan"))] * 4))
    out = a.select("id", F.get(geometry.attribute_boxes(boxes, F.lit(800), F.lit(1200)), F.lit(0)).alias("b"))
    return out.select("id", *[F.get("b", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("""SELECT id, greatest(0, least(2000, y0))::INT AS sx0, greatest(0, least(1500, 999 - x1))::INT AS sy0, greatest(0, least(2000, y1))::INT AS sx1, greatest(0, least(1500, 999 - x0))::INT AS sy1 FROM v_attributes""")
def affine_box(spark: SparkSession, d: str) -> DataFrame:
    """The inverse of a turn by 90 degrees."""
    a = view(spark, d, "v_attributes")
    turn = geometry.orientation(F.lit(90), F.lit(800), F.lit(1000))
    box = geometry.affine_box([F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")], geometry.inverse_affine(turn), F.lit(2000), F.lit(1500))
    return a.select("id", *[b.alias(c) for b, c in zip(box, ("sx0", "sy0", "sx1", "sy1"), strict=True)])


_INTER = "greatest(0, least(t.x1, b.x1) - greatest(t.x0, b.x0)) * greatest(0, least(t.y1, b.y1) - greatest(t.y0, b.y0))"
_IOU = f"({_INTER})::DOUBLE / ((t.x1 - t.x0) * (t.y1 - t.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER})"


@query(f"SELECT t.page_id, token_index, box_order, round({_IOU}, 9) AS iou FROM v_boxed_tokens t JOIN v_boxes b ON t.page_id = b.page_id WHERE {_INTER} > 0")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """X1 F15."""
    t, b = view(spark, d, "v_boxed_tokens"), view(spark, d, "v_boxes")
    side = b.select(F.col("page_id").alias("__page"), "box_order", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    boxes = [[F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")] for p in ("", "b_")]
    return evaluate.overlapping(t, side).select("page_id", "token_index", "box_order", F.round(geometry.iou(*boxes), 9).alias("iou"))


@query(f"""WITH p AS (SELECT t.page_id, token_index, label, {_IOU} AS iou, row_number() OVER (PARTITION BY t.page_id, token_index ORDER BY {_IOU} DESC, box_order, label DESC) AS k FROM v_boxed_tokens t JOIN v_boxes b ON t.page_id = b.page_id WHERE {_INTER} > 0)
           SELECT t.page_id, t.token_index, CASE WHEN iou >= 0.1 THEN label ELSE 'O' END AS label FROM (SELECT DISTINCT page_id, token_index FROM v_boxed_tokens) t LEFT JOIN p ON p.page_id = t.page_id AND p.token_index = t.token_index AND k = 1""")
def best_iou_labels(spark: SparkSession, d: str) -> DataFrame:
    """J7 J8."""
    return evaluate.best_overlap_labels(view(spark, d, "v_boxed_tokens"), view(spark, d, "v_boxes"), distinct=True).select("page_id", "token_index", "label")


@query(f"SELECT t.page_id, token_index, arg_max(label, row(box_order, label)) AS label, count(*) AS n_boxes FROM v_boxed_tokens t JOIN v_boxes b ON t.page_id = b.page_id WHERE {_INTER} > 0 GROUP BY ALL")
def token_attribute_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The last overlapping box wins."""
    return evaluate.overlap_index(view(spark, d, "v_boxed_tokens"), view(spark, d, "v_boxes"))


@query(f"""WITH b AS (SELECT a.document_id AS page_id, a.id AS box_order, CASE WHEN document_type = '1-URGENT' AND entity_type_label = 'A_F' THEN 'approved_field' ELSE lower(entity_type_label) END AS label,
                  least(x0, 1000) AS x0, least(y0, 1000) AS y0, least(x1, 1000) AS x1, least(y1, 1000) AS y1 FROM v_attributes a JOIN v_documents d ON d.id = a.document_id WHERE validation_status = 'APPROVED'),
           p AS (SELECT t.page_id, token_index, label, {_IOU} AS iou, row_number() OVER (PARTITION BY t.page_id, token_index ORDER BY {_IOU} DESC, box_order, label DESC) AS k FROM v_boxed_tokens t JOIN b ON t.page_id = b.page_id WHERE {_INTER} > 0)
           SELECT t.page_id AS document_id, t.page_id, string_agg(token, '|' ORDER BY t.token_index) AS tokens, string_agg(CASE WHEN iou >= 0.1 THEN label ELSE 'O' END, '|' ORDER BY t.token_index) AS labels, string_agg(t.x0::VARCHAR, '|' ORDER BY t.token_index) AS lefts
           FROM v_boxed_tokens t LEFT JOIN p ON p.page_id = t.page_id AND p.token_index = t.token_index AND k = 1 WHERE t.page_id IN (SELECT page_id FROM b) GROUP BY t.page_id""")
def training_records(spark: SparkSession, d: str) -> DataFrame:
    """K2: token records of pages with approved attributes."""
    a = view(spark, d, "v_attributes").withColumn("bounding_boxes", F.array(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])))
    t = view(spark, d, "v_boxed_tokens").withColumn("document_id", F.col("page_id"))
    a = a.withColumn("page_id", F.col("document_id"))
    aliases = spark.createDataFrame([("1-urgent", "a_f", "approved_field")], "document_type string, alias string, canonical string")
    records = export.training_records(t, a, view(spark, d, "v_documents"), aliases)
    return records.select("document_id", "page_id", *[F.array_join(c, "|").alias(c) for c in ("tokens", "labels")], F.array_join(F.transform("bboxes", lambda x: F.get(x, F.lit(0)).cast("string")), "|").alias("lefts"))


# --- classification and labels

#: Frequent words of the corpus's four languages, as keyword lists for the classifier.
_WORDS = {"english": ["the", "and of", "with"], "german": ["der", "und die", "nicht"], "french": ["le", "et les", "dans"], "spanish": ["el", "y los", "para"]}
_SCORES = ", ".join(f"{' + '.join(f'CASE WHEN contains(t, {chr(39)}{w}{chr(39)}) THEN {2 if chr(32) in w else 1} ELSE 0 END' for w in words)} AS {lang}" for lang, words in _WORDS.items())


@query(f"""WITH s AS (SELECT doc_id, {_SCORES} FROM (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents)), b AS (SELECT *, greatest(english, german, french, spanish) AS best, english + german + french + spanish AS total FROM s)
           SELECT doc_id, CASE WHEN best <= 0 THEN 'unknown' WHEN english = best THEN 'english' WHEN german = best THEN 'german' WHEN french = best THEN 'french' ELSE 'spanish' END AS document_type,
                  CASE WHEN total > 0 THEN best::DOUBLE / total ELSE 0 END AS confidence, best::INT AS best_score FROM b""")
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    """A8 O8 X9."""
    rows = [(lang, k, w, 2 if " " in w else 1) for k, (lang, words) in enumerate(_WORDS.items()) for w in words]
    table = spark.createDataFrame(rows, "document_type string, ordinal int, keyword string, weight int")
    return labels.classify(view(spark, d, "documents"), table, "doc_id", name="source").select("doc_id", "document_type", "confidence", "best_score")


@query("""SELECT id, CASE WHEN document_type = 'click' AND l = 'pdf' THEN 'portable' WHEN document_type = 'error' AND l = 'png' THEN 'picture' ELSE l END AS normalized_label FROM (SELECT id, document_type, lower(format) AS l FROM v_uploads)""")
def normalize_labels(spark: SparkSession, d: str) -> DataFrame:
    """J13 X7."""
    aliases = spark.createDataFrame([("click", "pdf", "portable"), ("error", "png", "picture")], "document_type string, alias string, canonical string")
    rows = view(spark, d, "v_uploads").select("id", F.upper("document_type").alias("document_type"), F.concat(F.lit("\t "), F.upper("format"), F.lit("\n")).alias("label"))
    return labels.normalize_labels(rows, aliases).select("id", "normalized_label")


@query("SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM (SELECT ref AS label FROM v_sequences UNION ALL SELECT entity_type_label FROM v_staged) WHERE label <> '')")
def label_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """A14 U3 X24."""
    return labels.vocabulary(view(spark, d, "v_sequences").select(F.col("ref").alias("label")), view(spark, d, "v_staged").select(F.col("entity_type_label").alias("label")))


# --- folds

def _labelled_tokens(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("name", "date", "total", ""))), ((F.col("line_num") + F.floor(F.col("word_num") / 5)) % 4 + 1).cast("int"))
    return tokens(spark, d, by_page=True).withColumn("label", label).withColumn("confidence", F.col("conf_pct") / 100.0)


#: A fold along each page's tokens of a label: what the cluster's first token (f...) and its last one (l...) are decides whether the next one joins.
_CLUSTERS = """
    WITH RECURSIVE l AS (SELECT *, (['name', 'date', 'total', ''])[(line_num + (word_num // 5)) % 4 + 1] AS label FROM tokens),
    r AS (SELECT page_id, label, token, conf_pct, token_index, block_num, paragraph_num, line_num, x0, y0, x1, y1, row_number() OVER (PARTITION BY page_id, label ORDER BY block_num, paragraph_num, line_num, y0, x0, token_index) AS k,
                 min(token_index) OVER (PARTITION BY page_id, label) AS seen FROM l WHERE label <> ''),
    fold AS (
        SELECT page_id, label, k, block_num AS fb, paragraph_num AS fp, line_num AS fl, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1, 1 AS run FROM r WHERE k = 1
        UNION ALL SELECT page_id, label, k, CASE WHEN joins THEN fb ELSE block_num END, CASE WHEN joins THEN fp ELSE paragraph_num END, CASE WHEN joins THEN fl ELSE line_num END, x0, y0, x1, y1, CASE WHEN joins THEN run ELSE run + 1 END
        FROM (SELECT r.*, fb, fp, fl, run, CASE WHEN fl = line_num AND fb = block_num AND fp = paragraph_num THEN x0 - lx1 <= 1.5 * greatest(lx1 - lx0, x1 - x0, 0)
                     ELSE fb = block_num AND y0 >= ly1 AND y0 - ly1 <= 1.75 * greatest(ly1 - ly0, y1 - y0, 0) AND abs(x0 - lx0) <= 2 * greatest(lx1 - lx0, x1 - x0, 0) END AS joins
              FROM fold JOIN r ON r.page_id = fold.page_id AND r.label = fold.label AND r.k = fold.k + 1)
    ),
    t AS (SELECT *, CASE WHEN lag(token) OVER w IS NULL THEN '' WHEN lag(paragraph_num) OVER w <> paragraph_num THEN chr(10) || chr(10) WHEN lag(line_num) OVER w <> line_num THEN chr(10) ELSE ' ' END AS sign
          FROM (SELECT r.*, run FROM r JOIN fold USING (page_id, label, k)) WINDOW w AS (PARTITION BY page_id, label, run ORDER BY k)),
    c AS (SELECT page_id, label, run, md5(string_agg(sign || token, '' ORDER BY k)) AS digest, count(*)::INT AS n_tokens, avg(conf_pct / 100.0) AS conf, sum(conf_pct)::BIGINT AS percents, min(k) AS k, min(seen) AS seen FROM t GROUP BY ALL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_num, paragraph_num, line_num, y0, x0, c.seen, token_index) AS cluster_index, label AS entity_type_label, digest, n_tokens,
           percents, CASE WHEN round(conf, 9) >= 0.75 THEN 'APPROVED' ELSE 'HITL' END AS validation_status
    FROM c JOIN r USING (page_id, label, k)"""


@query(_CLUSTERS, on_tokens=True)
def spatial_clusters(spark: SparkSession, d: str) -> DataFrame:
    """W1 W2 O5 F11 A4."""
    return cluster.spatial_clusters(_labelled_tokens(spark, d), dealt=True).select("page_id", "cluster_index", "entity_type_label", F.md5("extracted_value").alias("digest"), F.size("bounding_boxes").alias("n_tokens"), F.round(F.col("confidence_score") * F.size("bounding_boxes") * 100).cast("bigint").alias("percents"), "validation_status")


@query("""WITH RECURSIVE p AS (SELECT page_id, paragraph_num, token, conf_pct, token_index, row_number() OVER (PARTITION BY page_id, paragraph_num ORDER BY token_index) AS k FROM tokens),
          fold AS (SELECT page_id, paragraph_num, k, len(token) AS used, 0 AS chunk FROM p WHERE k = 1
                   UNION ALL SELECT p.page_id, p.paragraph_num, p.k, CASE WHEN used + 1 + len(token) > 600 THEN len(token) ELSE used + 1 + len(token) END, chunk + CASE WHEN used + 1 + len(token) > 600 THEN 1 ELSE 0 END
                   FROM fold JOIN p ON p.page_id = fold.page_id AND p.paragraph_num = fold.paragraph_num AND p.k = fold.k + 1),
          c AS (SELECT page_id, paragraph_num, chunk, md5(string_agg(token, ' ' ORDER BY k)) AS digest, count(*) AS n_tokens FROM fold JOIN p USING (page_id, paragraph_num, k) GROUP BY ALL),
          n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY paragraph_num, chunk) AS i, count(*) OVER (PARTITION BY page_id) AS total FROM c)
          SELECT page_id, i AS chunk_index, CASE WHEN total > 1 THEN 'ocr_text_' || i ELSE 'ocr_text' END AS entity_type_label, digest, n_tokens FROM n""", on_tokens=True)
def pack_600(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return cluster.packed_paragraphs(tokens(spark, d, by_page=True), dealt=True).select("page_id", "chunk_index", "entity_type_label", F.md5("extracted_value").alias("digest"), "n_tokens")


def _lines_sql() -> str:
    """A fold along each page's lines: how many fields there are, what is open (1 a field, 2 a letter's body) and the body's paragraph."""
    known = ", ".join(f"('{kind}', '{label}', '{field}')" for kind, labels_ in line_label_map().items() for label, field in labels_.items())
    return f"""
    WITH RECURSIVE known(kind, name, field) AS (VALUES {known}),
    rows AS (SELECT page_id, paragraph_num, line_num, token_index, conf_pct, (['letter', 'invoice', 'form'])[document_id % 3 + 1] AS kind,
                    CASE WHEN word_num = 1 AND line_num % 3 = 0 THEN (['Date:', 'subject', 'TO:', 'Invoice'])[(line_num // 3) % 4 + 1] ELSE token END AS token FROM tokens),
    texts AS (SELECT page_id, kind, paragraph_num, line_num, trim(string_agg(token, ' ' ORDER BY token_index)) AS t, list(conf_pct / 100.0 ORDER BY token_index) AS confs FROM rows GROUP BY ALL),
    keyed AS (SELECT *, lower(trim(CASE WHEN instr(t, ':') > 0 THEN t[:instr(t, ':') - 1] ELSE t END)) AS by_colon, lower(trim(CASE WHEN instr(t, ' ') > 0 THEN t[:instr(t, ' ') - 1] ELSE t END)) AS by_space,
                     CASE WHEN instr(t, ':') > 0 THEN t[instr(t, ':') + 1:] ELSE '' END AS after_colon, CASE WHEN instr(t, ' ') > 0 THEN trim(t[instr(t, ' ') + 1:]) ELSE '' END AS after_space FROM texts WHERE t <> ''),
    found AS (SELECT k.*, a.field AS at_colon, coalesce(a.field, b.field) AS field, trim(CASE WHEN a.field IS NULL AND b.field IS NOT NULL THEN after_space ELSE after_colon END) AS value
              FROM keyed k LEFT JOIN known a ON a.kind = k.kind AND a.name = by_colon LEFT JOIN known b ON b.kind = k.kind AND b.name = by_space),
    marked AS (SELECT *, field IS NOT NULL AND ((at_colon IS NOT NULL AND instr(t, ':') > 0) OR value <> '') AS opens, len(regexp_extract_all(value, '[^ ]+')) AS words FROM found),
    line AS (SELECT page_id, kind, paragraph_num, field, opens, CASE WHEN opens THEN value ELSE t END AS part, CASE WHEN opens AND words > 0 AND len(confs) >= words THEN confs[len(confs) - words + 1:] ELSE confs END AS confs,
                    row_number() OVER (PARTITION BY page_id ORDER BY paragraph_num, line_num) AS k FROM marked),
    fold AS (
        SELECT page_id, 0::BIGINT AS k, 0 AS n, 0 AS open, 0 AS para, 0 AS number, NULL::VARCHAR AS label FROM (SELECT DISTINCT page_id FROM line)
        UNION ALL SELECT page_id, k, n + CASE WHEN act IN (1, 5) THEN 1 ELSE 0 END, CASE act WHEN 1 THEN 1 WHEN 3 THEN CASE WHEN open = 1 THEN 0 ELSE open END WHEN 5 THEN 2 ELSE open END, CASE WHEN act = 5 THEN paragraph_num ELSE para END,
               CASE WHEN act IN (1, 5) THEN n + 1 WHEN act = 4 OR (act = 2 AND open = 1) THEN n END, CASE act WHEN 1 THEN field WHEN 5 THEN 'body_' || (n + 1) END
        FROM (SELECT line.*, n, open, para, CASE WHEN opens THEN 1 WHEN kind <> 'letter' THEN 2 WHEN field IS NOT NULL THEN 3 WHEN open = 2 AND para = paragraph_num THEN 4 ELSE 5 END AS act
              FROM fold JOIN line ON line.page_id = fold.page_id AND line.k = fold.k + 1)
    ),
    fields AS (SELECT page_id, number, max(label) AS label, trim(string_agg(part, chr(10) ORDER BY k) FILTER (part <> '')) AS v, flatten(list(confs ORDER BY k)) AS confs FROM line JOIN fold USING (page_id, k) WHERE number IS NOT NULL GROUP BY ALL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY number) AS field_index, label AS entity_type_label, md5(v) AS digest, len(confs)::INT AS n_boxes, round(list_sum(confs) * 100)::BIGINT AS percents,
           CASE WHEN round(list_avg(confs), 9) >= 0.75 THEN 'APPROVED' ELSE 'HITL' END AS validation_status
    FROM fields WHERE v <> ''"""


@query(_lines_sql(), on_tokens=True)
def labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every third line of a document begins with a label."""
    word = F.element_at(F.array(*map(F.lit, ("Date:", "subject", "TO:", "Invoice"))), (F.floor(F.col("line_num") / 3) % 4 + 1).cast("int"))
    first = (F.col("word_num") == 1) & (F.col("line_num") % 3 == 0)
    rows = tokens(spark, d, by_page=True).withColumn("token", F.when(first, word).otherwise(F.col("token"))).withColumn("document_type", F.element_at(F.array(*map(F.lit, ("letter", "invoice", "form"))), (F.col("document_id") % 3 + 1).cast("int")))
    return cluster.labelled_lines(rows, dealt=True).select("page_id", "field_index", "entity_type_label", F.md5("extracted_value").alias("digest"), F.size("bounding_boxes").alias("n_boxes"), F.round(F.col("confidence_score") * F.size("bounding_boxes") * 100).cast("bigint").alias("percents"), "validation_status")


@query("""SELECT page_id, label, string_agg(sign || token, '' ORDER BY token_index) AS value FROM (
            SELECT *, CASE WHEN lag(token) OVER w IS NULL THEN '' WHEN lag(paragraph_num) OVER w <> paragraph_num THEN chr(10) || chr(10) WHEN lag(line_num) OVER w <> line_num THEN chr(10) ELSE ' ' END AS sign
            FROM (SELECT *, word_num % 3 AS label FROM tokens) WINDOW w AS (PARTITION BY page_id, label ORDER BY token_index)) GROUP BY ALL""", on_tokens=True)
def cluster_text(spark: SparkSession, d: str) -> DataFrame:
    """W2."""
    rows = tokens(spark, d, by_page=True).withColumn("label", (F.col("word_num") % 3).cast("bigint"))
    run = F.array_sort(F.collect_list(F.struct("token_index", "token", "paragraph_num", "line_num")))
    return rows.groupBy("page_id", "label").agg(run.alias("run")).select("page_id", "label", cluster.joined_text(F.col("run")).alias("value"))


@query("""WITH RECURSIVE r AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, ordinal) AS k, page_number, entity_type_label AS label, extracted_value AS v, confidence_score AS c FROM v_staged),
          fold AS (SELECT document_id, k, 0::BIGINT AS row_index, page_number, label, v, c FROM r WHERE k = 1
                   UNION ALL SELECT r.document_id, r.k, CASE WHEN m THEN row_index ELSE row_index + 1 END, CASE WHEN m THEN f.page_number ELSE r.page_number END, r.label, CASE WHEN m THEN f.v || chr(10) || chr(10) || r.v ELSE r.v END, CASE WHEN m THEN least(f.c, r.c) ELSE r.c END
                   FROM (SELECT fold.*, n.label = fold.label AND upper(n.label) <> 'OCR' AND n.page_number = fold.page_number + 1 AS m FROM fold JOIN r n ON n.document_id = fold.document_id AND n.k = fold.k + 1) f JOIN r ON r.document_id = f.document_id AND r.k = f.k + 1)
          SELECT document_id, row_index, arg_max(label, k) AS entity_type_label, arg_max(v, k) AS extracted_value, arg_max(page_number, k) AS page_number, arg_max(c, k) AS confidence_score FROM fold GROUP BY ALL""")
def merge_continuations(spark: SparkSession, d: str) -> DataFrame:
    """W6."""
    rows = view(spark, d, "v_staged").withColumn("validation_status", cluster.gate(F.col("confidence_score"))).withColumn("bounding_boxes", F.array().cast("array<array<int>>"))
    return cluster.merge_continuations(rows).select("document_id", F.col("row_index").cast("bigint").alias("row_index"), "entity_type_label", "extracted_value", "page_number", "confidence_score")


# --- evaluation


@query("SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (SELECT t_label AS label, count(*) FILTER (t_label = p_label) AS tp, 0 AS fp, count(*) FILTER (t_label <> p_label) AS fn FROM v_eval GROUP BY 1 UNION ALL SELECT p_label, 0, count(*), 0 FROM v_eval WHERE t_label <> p_label GROUP BY 1) GROUP BY label")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return evaluate.confusion(view(spark, d, "v_eval"))


@query("""WITH c AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT t_label AS label, count(*) FILTER (t_label = p_label) AS tp, 0 AS fp, count(*) FILTER (t_label <> p_label) AS fn FROM v_eval GROUP BY 1 UNION ALL SELECT p_label, 0, count(*), 0 FROM v_eval WHERE t_label <> p_label GROUP BY 1) GROUP BY label)
          SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(p + r, 1e-12), 9) AS f1 FROM (SELECT label, tp::DOUBLE / greatest(tp + fp, 1) AS p, tp::DOUBLE / greatest(tp + fn, 1) AS r FROM c)""")
def label_prf(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    out = evaluate.precision_recall(evaluate.confusion(view(spark, d, "v_eval")))
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH p AS (SELECT t.page_id, t.token_index, {_IOU} AS iou, t.x0 % 4 = b.x0 % 4 AS same FROM v_boxed_tokens t JOIN v_boxes b ON t.page_id = b.page_id AND t.token_index = b.box_order)
           SELECT count(*) AS token_count, count(*) FILTER (same)::DOUBLE / greatest(count(*), 1) AS token_accuracy, count(*) FILTER (iou >= 0.5)::DOUBLE / greatest(count(*), 1) AS bbox_iou_match_rate FROM p""")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    sides = [view(spark, d, n).select(F.col("page_id").alias(f"{s}_page"), F.col(k).alias(f"{s}_at"), (F.col("x0") % 4).alias(f"{s}_label"), *[F.col(c).alias(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")]) for n, k, s in (("v_boxed_tokens", "token_index", "t"), ("v_boxes", "box_order", "p"))]
    return evaluate.token_scores(sides[0].join(sides[1], (F.col("t_page") == F.col("p_page")) & (F.col("t_at") == F.col("p_at"))))


@query("""WITH t AS (SELECT conv_id AS key, role || turn AS field, ' ' || role AS value FROM conversations), p AS (SELECT conv_id AS key, role || turn AS field, CASE WHEN turn % 3 = 0 THEN 'other' ELSE role || ' ' END AS value FROM conversations WHERE length(text) > 200)
          SELECT count(*) AS comparable, count(*) FILTER (trim(t.value) = trim(coalesce(p.value, ''))) AS exact, count(*) FILTER (trim(t.value) = trim(coalesce(p.value, '')))::DOUBLE / count(*) AS rate FROM t LEFT JOIN p ON t.key = p.key AND t.field = p.field WHERE t.key IN (SELECT key FROM p)""")
def field_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """A11 X20."""
    rows = view(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.concat("role", "turn").alias("field"), "turn", "role", "text")
    t = rows.select("key", "field", F.concat(F.lit(" "), "role").alias("value"))
    p = rows.where("length(text) > 200").select("key", "field", F.when(F.col("turn") % 3 == 0, "other").otherwise(F.concat("role", F.lit(" "))).alias("value"))
    return evaluate.field_match(t, p)


@query("SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_predictions(spark: SparkSession, d: str) -> DataFrame:
    """J10 O9 U1."""
    return evaluate.missing_keys(view(spark, d, "documents").select(F.col("doc_id").alias("key")), view(spark, d, "labels").select(F.col("doc_id").alias("key")))


@query("SELECT conv_id AS key, arg_max(role, turn) AS role, max(turn) AS ordinal FROM conversations GROUP BY conv_id")
def last_record_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of repeated keys the last record counts."""
    return evaluate.last_by_key(view(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ordinal"), "role")).select("key", "role", "ordinal")


@query("SELECT conv_id AS key, count(*) AS n, count(*) FILTER (turn % 3 = 0) AS matching FROM conversations GROUP BY conv_id HAVING count(*) > 4")
def aligned_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Only records that both sides have, token by token."""
    rows = view(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("token"), F.lit("a").alias("label"))
    long = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 4").select("key")
    p = rows.join(long, "key", "left_semi").withColumn("label", F.when(F.col("pos") % 3 == 0, "a").otherwise("b"))
    pairs = evaluate.aligned(rows, p)
    return pairs.groupBy(F.col("t_key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t_label") == F.col("p_label")).alias("matching"))


@query("""WITH e AS (SELECT quality AS t, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id), l AS (SELECT unnest([0, 1, 2]) AS label),
          c AS (SELECT label, (SELECT count(*) FROM e WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM e WHERE t <> label AND p = label) AS fp, (SELECT count(*) FROM e WHERE t = label AND p <> label) AS fn FROM l),
          m AS (SELECT label::VARCHAR AS label, tp::DOUBLE / greatest(tp + fp, 1) AS precision, tp::DOUBLE / greatest(tp + fn, 1) AS recall, (tp + fn)::BIGINT AS support FROM c), f AS (SELECT label, precision, recall, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1, support FROM m),
          u AS (SELECT * FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f UNION ALL SELECT 'weighted avg', sum(precision * support) / greatest(sum(support), 1), sum(recall * support) / greatest(sum(support), 1), sum(f1 * support) / greatest(sum(support), 1), sum(support)::BIGINT FROM f
                UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT count(*) FILTER (t = p)::DOUBLE / count(*) AS a, count(*) AS n FROM e))
          SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM u""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("k"), F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("prediction"))
    pairs = view(spark, d, "labels").join(docs, F.col("doc_id") == F.col("k")).select(F.col("quality").alias("reference"), "prediction")
    out = evaluate.classification_report(pairs, spark.createDataFrame([(0,), (1,), (2,)], "label int"))
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT seq_id, pos, CASE WHEN ref = 'O' THEN 'O' WHEN lag(ref) OVER w = ref THEN 'I-' || ref ELSE 'B-' || ref END AS bio FROM v_sequences WINDOW w AS (PARTITION BY seq_id ORDER BY pos)")
def bio_tags(spark: SparkSession, d: str) -> DataFrame:
    """W5."""
    return evaluate.bio_tags(view(spark, d, "v_sequences"), label="ref").select("seq_id", "pos", "bio")


def _islands(c: str) -> str:
    return f"""(SELECT seq_id, {c} AS label, min(i) AS s, max(i) AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY seq_id, {c} ORDER BY i) AS g FROM k) WHERE {c} <> 'O' GROUP BY seq_id, {c}, g)"""


@query(f"""WITH k AS (SELECT seq_id, ref, pred, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS i FROM v_sequences WHERE NOT ignored), t AS {_islands('ref')}, p AS {_islands('pred')},
           c AS (SELECT count(*) FILTER (t.s IS NOT NULL AND p.s IS NOT NULL) AS tp, count(*) FILTER (t.s IS NULL) AS fp, count(*) FILTER (p.s IS NULL) AS fn FROM t FULL JOIN p ON t.seq_id = p.seq_id AND t.label = p.label AND t.s = p.s AND t.e = p.e)
           SELECT tp, fp, fn, round(tp::DOUBLE / greatest(tp + fp, 1), 9) AS precision, round(tp::DOUBLE / greatest(tp + fn, 1), 9) AS recall, round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 9)::DOUBLE AS f1 FROM c""")
def entity_prf(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    out = evaluate.entity_scores(view(spark, d, "v_sequences"))
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH k AS (SELECT seq_id, ref, pred, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS i FROM v_sequences WHERE NOT ignored), t AS {_islands('ref')}, p AS {_islands('pred')},
           c AS (SELECT coalesce(t.label, p.label) AS label, count(*) FILTER (t.s IS NOT NULL AND p.s IS NOT NULL) AS tp, count(*) FILTER (t.s IS NULL) AS fp, count(*) FILTER (p.s IS NULL) AS fn
                 FROM t FULL JOIN p ON t.seq_id = p.seq_id AND t.label = p.label AND t.s = p.s AND t.e = p.e GROUP BY 1),
           e AS (SELECT label, tp, fp, fn FROM c UNION ALL SELECT 'micro avg', sum(tp), sum(fp), sum(fn) FROM c),
           r AS (SELECT label, tp::DOUBLE / greatest(tp + fp, 1) AS precision, tp::DOUBLE / greatest(tp + fn, 1) AS recall, 2.0::DOUBLE * tp / greatest(2 * tp + fp + fn, 1) AS f1, (tp + fn)::BIGINT AS support FROM e),
           w AS (SELECT 'weighted avg' AS label, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, sum(support)::BIGINT AS support FROM r WHERE label <> 'micro avg'),
           m AS (SELECT 'macro avg' AS label, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(support)::BIGINT AS support FROM r WHERE label <> 'micro avg')
           SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (FROM r UNION ALL FROM m UNION ALL FROM w)""")
def entity_report(spark: SparkSession, d: str) -> DataFrame:
    """Span scores by label, with averages."""
    out = evaluate.entity_report(view(spark, d, "v_sequences"))
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT vec_id, label, list_position(e, list_max(e)) - 1 AS predicted, round(1 / list_sum([exp(x - list_max(e)) FOR x IN e]), 6) AS confidence FROM (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding[1:10]] AS e FROM embeddings)")
def logit_argmax(spark: SparkSession, d: str) -> DataFrame:
    """X17."""
    e = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    rows = view(spark, d, "embeddings").select("vec_id", "label", e.alias("e"))
    return rows.select("vec_id", "label", evaluate.argmax_id(F.col("e")).alias("predicted"), F.round(F.array_max(evaluate.softmax(F.col("e"))), 6).alias("confidence"))


# --- splits and boundary


@query("""SELECT conv_id, turn, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split
          FROM (SELECT conv_id, turn, ('0x' || md5(conv_id::VARCHAR || ':7')[1:12])::BIGINT % 1000000 / 1000000.0 AS u FROM conversations)""")
def group_split_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every example once, all of a group in the same split."""
    return split.hash_split(view(spark, d, "conversations"), "conv_id", seed=7).select("conv_id", "turn", "split")


@query("""WITH RECURSIVE g AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY md5(conv_id::VARCHAR || ':7')) AS k FROM conversations GROUP BY conv_id),
          t AS (SELECT 0.6::DOUBLE * sum(n) AS a, 0.2::DOUBLE * sum(n) AS b, 0.2::DOUBLE * sum(n) AS c FROM g),
          fold AS (SELECT 0::BIGINT AS k, 0::BIGINT AS conv_id, 0::BIGINT AS n, 0::HUGEINT AS a, 0::HUGEINT AS b, 0::HUGEINT AS c, -1 AS pick
                   UNION ALL SELECT k, conv_id, n, a + CASE WHEN pick = 0 THEN n ELSE 0 END, b + CASE WHEN pick = 1 THEN n ELSE 0 END, c + CASE WHEN pick = 2 THEN n ELSE 0 END, pick
                   FROM (SELECT g.k, g.conv_id, g.n, fold.a, fold.b, fold.c, CASE WHEN fold.a / t.a <= fold.b / t.b AND fold.a / t.a <= fold.c / t.c THEN 0 WHEN fold.b / t.b <= fold.c / t.c THEN 1 ELSE 2 END AS pick
                         FROM fold JOIN g ON g.k = fold.k + 1, t))
          SELECT conv_id, n, CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM fold WHERE k > 0""")
def group_split_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Sequential assignment to the least filled split."""
    rows = split.balanced_split(view(spark, d, "conversations"), "conv_id", (0.6, 0.2, 0.2), seed=7)
    return rows.groupBy("conv_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, token_index, (['O', 'name', 'date', 'total'])[code % 4 + 1] AS label, (code // 7 % 101)::DOUBLE / 100 AS confidence
          FROM (SELECT page_id, token_index, ('0x' || md5(token)[1:8])::BIGINT AS code FROM tokens)""", on_tokens=True)
def model_predictions(spark: SparkSession, d: str) -> DataFrame:
    """UDF1 W7 W8 W9: chunks through the predictor boundary, stitched and filled."""
    rows = tokens(spark, d, by_page=True).withColumn("document_type", F.lit("unknown"))
    return boundary.label_pages(rows, boundary.stub_predictor(), dealt=True)


@query("SELECT page_id, token_index, 'OCR' AS label, 0.0::DOUBLE AS confidence, least(1, greatest(0, conf_pct / 100)) AS unit FROM tokens", on_tokens=True)
def ocr_only_predictions(spark: SparkSession, d: str) -> DataFrame:
    """UDF1 X23."""
    return tok.ocr_only(tokens(spark, d)).select("page_id", "token_index", "label", "confidence", text.unit_confidence(F.col("conf_pct")).alias("unit"))


@query("SELECT page_id, token_index, label, line_num FROM (SELECT page_id, token_index, word_num % 2 AS label, line_num FROM tokens)", on_tokens=True)
def attach_layout(spark: SparkSession, d: str) -> DataFrame:
    """J12."""
    rows = tokens(spark, d)
    predictions = rows.select("page_id", "token_index", (F.col("word_num") % 2).alias("label"))
    return tok.attach_layout(predictions, rows).select("page_id", "token_index", "label", "line_num")
