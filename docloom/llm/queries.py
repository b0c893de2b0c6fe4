"""The subpackage's registered queries (``QUERIES``) and their SQL (``ORACLE``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, filter_audit, fingerprint, graph_search, langid, line_dedup, minhash, mixing, pii, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), target_entropy=0.98, max_repeats=4.0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=fold(3) != 1)
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs, learn=fold(5) != 0))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=100)
    return warc.read_archives(spark, archives, payloads=False)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return out.drop(minhash.TEXT_HASH)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, passage=250, passage_words=50)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited_with_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", F.round("near_edited", 6).alias("near_edited"), F.round("near_next", 6).alias("near_next"), F.size("changed").cast("long").alias("n_changed"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind, *_ in pii.KINDS[: pii.BASE]]  # noqa: B023  called at once
    base = F.sha2(pii.listed(F.filter(spans, lambda x: x["rank"] < pii.BASE)), 256)
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", *counts, base.alias("base_sha256"), pii.listed(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given to the user, as crc32 of `conv_id:turn` has it; nulls become a space."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = rows.withColumn("lot", lot).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = conversations.Repair(damaged(rows))
    named = lambda df, c: df.withColumnRenamed("conv_id", c)
    out = rows.select("conv_id").distinct().join(named(repair.report(), "r"), F.col("conv_id").eqNullSafe(F.col("r")), "left")
    out = out.join(named(conversations.digests(repair.turns()), "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    out = filter_audit.audit(table(spark, sf_dir, "documents"), filter_audit.standard_filters(), table(spark, sf_dir, "labels"), marked, copies="E")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_search.Index(vectors, keep=20).search(vectors.where("vec_id % 20 = 0"), k=20)


QUERIES = {
    "op13_graph_search": op13_graph_search,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op5_minhash": op5_minhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_fingerprint": op8_fingerprint,
    "op9_pii": op9_pii,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op10_decontamination": op10_decontamination,
}

#: chr(9) to chr(13) and the space, for trim().
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _pii_oracle() -> str:
    """Positions come from the pieces between matches; patterns as in the contract."""
    part = "0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    twice = "(ascii(d[i]) - 48) * (CASE WHEN (len(d) - i) % 2 = 1 THEN 2 ELSE 1 END)"
    luhn = f"len(d) BETWEEN 14 AND 19 AND list_sum([CASE WHEN v > 9 THEN v - 9 ELSE v END FOR v IN [{twice} FOR i IN range(1, len(d) + 1)]]) % 10 = 0"
    turned = "(replace(m, ' ', '')[5:] || m[:4])"
    step = f"CASE WHEN ascii({turned}[i]) < 58 THEN r * 10 + ascii({turned}[i]) - 48 ELSE r * 100 + ascii({turned}[i]) - 55 END % 97"
    mod97 = f"list_reduce([0::BIGINT] || range(1, len({turned}) + 1), lambda r, i: {step}) = 1"
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(m, '{part}(\.{part}){{3}}')"),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 10 AND 15"),
        ("iban", rf"\b{pii.IBAN_CORE}\b", mod97),
        ("ssn", pii.SSN, f"regexp_matches(lower(t[greatest(s - 40, 0) + 1:s] || ' ' || t[s + len(m) + 1:s + len(m) + 40]), '{pii.CONTEXT['ssn']}')"),
        ("secret", pii.SECRET.replace("'", "''"), "regexp_matches(m, '[0-9]')"),
    )
    tables = []
    for rank, (kind, pattern, test) in enumerate(kinds):
        tables.append(f"""
            SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + len(m) AS e FROM (
                SELECT doc_id, t, m, {digits} AS d,
                       list_sum([len(x) FOR x IN g[:k]])::BIGINT + coalesce(list_sum([len(x) FOR x IN f[:k - 1]]), 0)::BIGINT AS s
                FROM (SELECT doc_id, t, f, string_split_regex(t, '{pattern}') AS g, unnest(f) AS m, unnest(range(1, len(f) + 1)) AS k
                      FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS f FROM docs))
            ) WHERE {test}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in kinds[:4])
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(tables)}),
        per AS (
            SELECT doc_id, {counts},
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) AS n_spans
            FROM spans GROUP BY doc_id
        )
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in kinds[:4])},
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
        FROM docs LEFT JOIN per USING (doc_id)"""


def _fingerprint_oracle(section: int = 8, most: int = 16, block: int = 16, sketch: int = 32) -> str:
    def tree(t: str) -> str:
        paras = f"string_split({t}, chr(10))"
        size = f"({section} * pow(2, greatest(ceil(log2(len({paras}) / {section * most}.0)), 0)))::INT"
        cut = f"[({paras})[k * {size} + 1:(k + 1) * {size}] FOR k IN range(0, (len({paras}) - 1) // {size} + 1)]"
        node = "sha256(array_to_string([sha256(p) FOR p IN s], ''))"
        blocks = f"flatten([regexp_extract_all(p, '[^\\n]{{1,{block}}}') FOR p IN s])"
        parts = f"[{{'node': {node}, 'n': len({blocks}), 'sketch': list_sort(list_distinct([md5(b)[1:6] FOR b IN {blocks}]))[:{sketch}]}} FOR s IN {cut}]"
        return f"{parts} AS {t}_s, sha256(array_to_string([{node} FOR s IN {cut}], '')) AS {t}_root"

    def union(a: str, b: str) -> str:
        return f"list_sort(list_distinct(list_concat({a}, {b})))[:{sketch}]"

    def shared(a: str, b: str) -> str:
        return f"(len(list_intersect({union(a, b)}, list_intersect({a}, {b})))::DOUBLE / greatest(len({union(a, b)}), 1))"

    def near(b: str) -> str:
        x, y, places = "t_s[k]", f"{b}_s[k]", f"range(1, greatest(len(t_s), len({b}_s)) + 1)"
        n = f"greatest(coalesce({x}.n, 0), coalesce({y}.n, 0))"
        part = shared(f"coalesce({x}.sketch, []::VARCHAR[])", f"coalesce({y}.sketch, []::VARCHAR[])")
        down = f"list_sum([{n} * CASE WHEN {x}.node = {y}.node THEN 1.0::DOUBLE ELSE {part} END FOR k IN {places}]) / greatest(list_sum([{n} FOR k IN {places}]), 1)"
        all_a, all_b = (f"list_sort(list_distinct(flatten([y.sketch FOR y IN {t}_s])))[:{sketch}]" for t in ("t", b))
        return f"CASE WHEN t_root = {b}_root THEN 1.0::DOUBLE ELSE round(greatest({down}, {shared(all_a, all_b)}), 6) END"

    def shown(t: str) -> str:
        return f"{t}_root || ':' || array_to_string([x.node[1:16] || '-' || x.n || '-' || array_to_string(x.sketch, '') FOR x IN {t}_s], ',')"

    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        follow AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS n FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
        edit AS (SELECT *, t[:len(t) - len(t) // 3] || n[:len(t) // 3] AS e FROM follow),
        trees AS (SELECT *, {tree("t")}, {tree("e")}, {tree("n")} FROM edit)
        SELECT doc_id, len(t)::BIGINT AS n_chars, sha256(e) AS edited_sha256, {shown("t")} AS fingerprint,
               {shown("e")} AS edited_fingerprint, {near("e")} AS near_edited, {near("n")} AS near_next,
               len([1 FOR k IN range(1, greatest(len(t_s), len(e_s)) + 1) IF t_s[k].node IS DISTINCT FROM e_s[k].node])::BIGINT AS n_changed
        FROM trees"""


def _repeats_oracle(length: int = 400, passage: int = 250, words: int = 50) -> str:
    def islands(name: str, n: int) -> str:
        """Runs of bytes that are covered by windows of n bytes which occur more than once."""
        return f"""{name}_win AS (
            SELECT doc_id, i, hash(b[i + 1:i + {n}]) AS w FROM (SELECT doc_id, b, unnest(range(n - {n - 1})) AS i FROM doc WHERE n >= {n})
        ), {name} AS (
            SELECT doc_id, min(i) AS s, max(i) + {n} AS e FROM (
                SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
                    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {n} THEN 0 ELSE 1 END AS fresh
                    FROM {name}_win WHERE w IN (SELECT w FROM {name}_win GROUP BY w HAVING count(*) > 1)
                )
            ) GROUP BY doc_id, g
        )"""

    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
        WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
        {islands("islands", length)}, {islands("runs", passage)},
        gaps AS (
            SELECT doc_id, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM islands WINDOW w AS (PARTITION BY doc_id ORDER BY s)
            UNION ALL SELECT doc_id, coalesce(max(islands.e), 0) AS s, any_value(n) AS e FROM doc LEFT JOIN islands USING (doc_id) GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(substr(hex(b), 2 * s + 1, 2 * (gaps.e - s)), '' ORDER BY s) AS h FROM gaps JOIN doc USING (doc_id) GROUP BY doc_id
        ), per AS (SELECT doc_id, sum(e - s)::BIGINT AS removed, count(*) AS spans FROM islands GROUP BY doc_id),
        words AS (
            SELECT doc_id, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k) AS e, size FROM (
                SELECT doc_id, unnest(range(len(w))) AS k, unnest([octet_length(encode(x)) FOR x IN w]) AS size, unnest([len(x) FOR x IN g[:len(w)]]) AS gap
                FROM (SELECT doc_id, regexp_extract_all(t, '{word}') AS w, string_split_regex(t, '{word}') AS g FROM doc WHERE doc_id IN (SELECT doc_id FROM runs))
            )
        ), passages AS (
            SELECT doc_id, count(*) AS passages FROM (
                SELECT runs.doc_id, runs.s FROM runs JOIN words ON words.doc_id = runs.doc_id AND words.e - size >= runs.s AND words.e <= runs.e GROUP BY ALL HAVING count(*) >= {words}
            ) GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256, coalesce(passages, 0) AS n_passages
        FROM doc JOIN kept USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN passages USING (doc_id)"""


def _mixing_oracle(target: float = 0.98, repeats: float = 4.0, block: int = 200_000) -> str:
    def powered(e: str) -> str:
        return f"[x / list_sum([pow(y, {e}) FOR y IN shares]) FOR x IN [pow(y, {e}) FOR y IN shares]]"

    def entropy(e: str) -> str:
        return f"-list_sum([w * ln(w) FOR w IN {powered(e)}])"

    within = f"list_bool_and([z[1] * total <= z[2] * {repeats} + 1e-6 FOR z IN list_zip({powered('EXP')}, tokens)])"
    uneven = f"{entropy('EXP')} <= {target} * ln(len(shares))"
    steps = [f"CASE WHEN {ok.replace('EXP', '((lo + hi) / 2)')} THEN {{'lo': lo, 'hi': (lo + hi) / 2}} ELSE {{'lo': (lo + hi) / 2, 'hi': hi}} END" for ok in (within, uneven)]
    tables = []
    for name, step, ok in (("least", steps[0], within), ("even", steps[1], uneven)):
        tables.append(f"""{name}_steps AS (
            SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
            SELECT k + 1, s.lo, s.hi FROM (SELECT k, {step} AS s FROM {name}_steps, arrays WHERE k < 50)
        ), {name} AS (SELECT CASE WHEN {ok.replace('EXP', '0.0')} THEN 0.0 ELSE (SELECT hi FROM {name}_steps WHERE k = 50) END AS e FROM arrays)""")
    return f"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, source, md5(coalesce(text, '')) AS h, coalesce('=' || source, 'null') AS s, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS n FROM documents
        ), src AS (SELECT s, sum(n)::DOUBLE AS t, count(*) AS docs FROM doc GROUP BY s),
        arrays AS (SELECT list(s ORDER BY s) AS names, list(t ORDER BY s) AS tokens, sum(t) AS total, list(t / all_t ORDER BY s) AS shares FROM (SELECT *, sum(t) OVER () AS all_t FROM src) WHERE t > 0),
        {", ".join(tables)}, quota AS (
            SELECT unnest(names) AS s, unnest([w * total FOR w IN {powered("e")}]) AS q FROM arrays, (SELECT greatest(a.e, b.e) AS e FROM least a, even b)
        ), plan AS (SELECT src.s, t, q, ceil(greatest(t / {block}, docs / 1000, 1))::BIGINT AS nb FROM src JOIN quota USING (s)),
        row AS (SELECT doc.*, ('0x' || md5('0:block:' || coalesce(doc_id::VARCHAR, '') || ':' || h)[1:12])::BIGINT % nb AS b FROM doc JOIN plan USING (s)),
        turn AS (
            SELECT s, b, epoch, t, q - epoch * t AS have, bs, md5('0:turn:' || s || ':' || epoch || ':' || b) AS turn
            FROM (SELECT s, b, sum(n) AS bs FROM row GROUP BY ALL) JOIN (SELECT s, t, q, unnest(range(floor(q / greatest(t, 1))::BIGINT + 1)) AS epoch FROM plan) USING (s)
            WHERE q - epoch * t > 0 OR epoch = 0
        ), room AS (
            SELECT s, b, epoch, turn, bs, CASE WHEN have >= t THEN bs + 1.0 ELSE have - coalesce(sum(bs) OVER (PARTITION BY s, epoch ORDER BY turn, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS room FROM turn
        ), copy AS (
            SELECT row.*, epoch, turn, room, room < bs AS cut, md5('0:place:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || h) AS place FROM row JOIN room USING (s, b) WHERE room > 0
        ), run AS (SELECT *, sum(n) OVER (PARTITION BY s, b, epoch ORDER BY place, doc_id, h ROWS UNBOUNDED PRECEDING) AS so_far FROM copy)
        SELECT doc_id, source, n AS n_tokens, epoch::INT AS epoch, b AS block, turn[1:16] || '-' || place[1:16] AS "order" FROM run WHERE NOT cut OR so_far <= room"""


def _repair_oracle() -> str:
    """The least (cost, letters) to the end by state, row by row from the last."""

    def least(*paths: str) -> str:
        return f"list_sort([{', '.join(paths)}])[1]"

    def then(path: str, cost: str, letter: str, line: str | None) -> str:
        return f"{{'c': {path}.c + {cost}, 's': '{letter}' || {path}.s, 't': {f'list_prepend({line}, {path}.t)' if line else f'{path}.t'}}}"

    def layer(x: str) -> str:
        """With what may be put in."""
        return f"""SELECT g, i, {least(f"{x}0", "c2i")} AS b0, {least(f"{x}1", "c2i")} AS b1, c2 AS b2, {least(f"{x}3", "c2i")} AS b3 FROM (
            SELECT *, {then("c2", "5", "I", "'user:'")} AS c2i FROM (SELECT *, {least(f"{x}2", then(f"{x}3", "5", "I", "'assistant:'"))} AS c2 FROM"""

    far, none = "{'c': 1000000000::BIGINT, 's': '', 't': []::VARCHAR[]}", "{'c': 0::BIGINT, 's': '', 't': []::VARCHAR[]}"
    stay = "CASE WHEN fault IN (2, 3) THEN 1000000000 WHEN fault = 1 THEN 5 ELSE 0 END"
    own = "role || ':' || text"

    def kept(to: dict[str, int]) -> str:
        cases = " ".join(f"WHEN starts_with(role, '{r}') THEN {then(f'b{q}', stay, 'K', own)}" for r, q in to.items())
        return f"CASE {cases} ELSE {far} END"

    rows = [({"s": 1, "u": 2}, "user", 2), ({"u": 2}, "user", 2), ({"a": 3}, "assistant", 3), ({"u": 2}, "user", 2)]
    raw = ", ".join(f"""{least(then(f"b{q}", "2", "D", None), kept(to), then(f"b{after}", f"1 + {stay}", "R", f"'{name}:' || text"))} AS r{q}""" for q, (to, name, after) in enumerate(rows))
    crc = "xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(k[j])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR j IN range(1, len(k) + 1)]), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    return f"""
        WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        lots AS (SELECT *, {crc} % 20 AS lot FROM raw),
        dam AS (
            SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
            FROM lots WHERE lot <> 0
        ), placed AS (
            SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM dam
        ), faults AS (
            SELECT *, CASE WHEN final = '' THEN 3 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
                   coalesce(role[1] || lead(role[1]) OVER (PARTITION BY g ORDER BY i) NOT IN ('su', 'ua', 'au'), false) AS odd FROM placed
        ), counts AS (
            SELECT g, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
                   count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (odd) AS illegal FROM faults GROUP BY g
        ), dp AS (
            {layer("r")} (SELECT g, n AS i, {none} AS r0, {far} AS r1, {far} AS r2, {none} AS r3 FROM counts)))
            UNION ALL
            {layer("r")} (SELECT dp.g, dp.i - 1 AS i, {raw} FROM dp JOIN faults ON faults.g = dp.g AND faults.i = dp.i WHERE dp.i > 0)))
        ), done AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, b0 FROM dp JOIN counts USING (g) WHERE dp.i = 0)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(b0.c, 0) AS cost, coalesce(b0.s, '') AS audit, sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id"""


def _audit_oracle() -> str:
    return """
        WITH lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        firsts AS (SELECT t, min(doc_id) AS f FROM doc GROUP BY t),
        masks AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > f, false)::INT AS mask
            FROM doc JOIN firsts USING (t) LEFT JOIN lab USING (doc_id)
        ), counts AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM masks GROUP BY ALL),
        bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
        orders AS (
            SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS s FROM bits v, bits w, bits x, bits y, bits z WHERE v.b + w.b + x.b + y.b + z.b = 31
              AND len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
        ), steps AS (SELECT filter_order, step, s[step] AS own, coalesce(list_sum(s[:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
        sums AS (
            SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(g) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
            FROM counts, steps GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums"""


ORACLE = {
    "op11_conversation_repair": _repair_oracle(),
    "op12_filter_audit": _audit_oracle(),
    "op3_mixing": _mixing_oracle(),
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (d)""",
    "op5_minhash": f"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM doc WHERE len(w) > 0)
        ), size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        rare AS (SELECT *, hash(s) AS h FROM sets),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
            FROM rare a JOIN rare b ON a.h = b.h AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
        ), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
        SELECT reach.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, min(reach.b) = reach.a AS kept
        FROM reach LEFT JOIN size ON size.doc_id = reach.a GROUP BY reach.a""",
    "op6_suffix_dedup": _repeats_oracle(),
    "op8_fingerprint": _fingerprint_oracle(),
    "op9_pii": _pii_oracle(),
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS k FROM lines
        ), shared AS (
            SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(shared.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (shared.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id""",
    "op10_decontamination": f"""
        WITH item AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM item WHERE len(w) > 0)
        ), doc AS (
            SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
        ), gram AS (
            SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM win))
        ), hit AS (
            SELECT doc_id, k, win.n, item_id FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
        )
        SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
