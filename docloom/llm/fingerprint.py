"""Merkle trees over paragraphs and sections, in column expressions only.

A paragraph is a line; its leaf is the SHA-256 of its text. A section is a run of
paragraphs; its node hashes their leaves; the root hashes the sections. A text
has at most `SECTIONS` sections: of `SECTION` paragraphs each, or where that would
be too many, of twice, four times, ... as many. Equal roots: equal texts.

The fingerprint holds the root and for each section its node, its number of
blocks (up to `BLOCK` code points within a paragraph) and a sketch: the `SKETCH`
smallest hashes of its distinct blocks. So its size is bounded, however long the
text is. Two fingerprints are compared from the root downwards (``likeness``):
equal roots are 1; equal sections count whole; of those that differ the sketches
estimate how much they share. As what moved to another section would be lost
that way, all sections' sketches together give a second estimate, and the larger
one holds. ``changed_sections`` gives the branches in which two fingerprints
differ, ``changed_paragraphs`` follows them down to the paragraphs.

Defined results: null is the empty text; two empty texts are equal; repeated
rows get the same fingerprint; in ``edited_with_next`` ties of the id are
ordered by the text's hash and null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_parts, stored

SECTION, SECTIONS, BLOCK, SKETCH = 8, 16, 16, 32
#: Documents of a range of ids, on average; ranges at most (their bounds are all that comes to the driver).
RANGE_DOCS, MOST_RANGES = 128, 16_384


def let(value: Column, use) -> Column:
    """use(value), the value being computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def leaves(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.sha2(p, 256))


def section_size(n: Column, section: int = SECTION, most: int = SECTIONS) -> Column:
    """Paragraphs of a section where a text has n: section * 2**k with the smallest k that gives no more than `most` sections."""
    return (F.pow(2.0, F.greatest(F.ceil(F.log2(n / (1.0 * section * most))), F.lit(0))) * section).cast("int")


def _slices(rows: Column, size: Column) -> Column:
    """An array cut into runs of `size`."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int")), lambda k: F.slice(rows, k * size + 1, size))


def sections(leaf: Column, section: int = SECTION, most: int = SECTIONS) -> Column:
    return let(leaf, lambda x: F.transform(_slices(x, section_size(F.size(x), section, most)), lambda s: F.sha2(F.array_join(s, ""), 256)))


def root(section: Column) -> Column:
    return F.sha2(F.array_join(section, ""), 256)


def least(hashes: Column, n: int = SKETCH) -> Column:
    """The n smallest of distinct hashes."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, n)


def tree(text: Column, section: int = SECTION, most: int = SECTIONS, block: int = BLOCK, sketch: int = SKETCH) -> Column:
    """struct<root, sections: array<struct<node, n, sketch>>> of a text."""

    def branch(paras: Column) -> Column:
        blocks = F.flatten(F.transform(paras, lambda p: F.regexp_extract_all(p, F.lit(f"[^\\n]{{1,{block}}}"), F.lit(0))))
        node = F.sha2(F.array_join(F.transform(paras, lambda p: F.sha2(p, 256)), ""), 256)
        return let(blocks, lambda b: F.struct(node.alias("node"), F.size(b).alias("n"), least(F.transform(b, lambda x: F.substring(F.md5(x), 1, 6)), sketch).alias("sketch")))

    found = let(paragraphs(text), lambda p: F.transform(_slices(p, section_size(F.size(p), section, most)), branch))
    return let(found, lambda s: F.struct(root(F.transform(s, lambda x: x["node"])).alias("root"), s.alias("sections")))


def fingerprint(tree_: Column) -> Column:
    """root:node-n-sketch,... with 16 digits of each node."""
    parts = F.transform(tree_["sections"], lambda s: F.concat_ws("-", F.substring(s["node"], 1, 16), s["n"].cast("string"), F.array_join(s["sketch"], "")))
    return F.concat(tree_["root"], F.lit(":"), F.array_join(parts, ","))


def shared_part(a: Column, b: Column, sketch: int = SKETCH) -> Column:
    """The sketches' estimate of the part of distinct blocks that both have; 0 where there are none."""
    both = F.array_intersect(a, b)
    return let(least(F.concat(a, b), sketch), lambda u: F.size(F.array_intersect(u, both)) / F.greatest(F.size(u), F.lit(1)))


def likeness(a: Column, b: Column, sketch: int = SKETCH) -> Column:
    """0 to 1, from two trees: down the branches that differ, or by all sections' sketches together."""
    none = F.array().cast("array<string>")

    def weight(x: Column) -> Column:
        n, m = F.coalesce(x["a"]["n"], F.lit(0)), F.coalesce(x["b"]["n"], F.lit(0))
        part = F.when(x["a"]["node"] == x["b"]["node"], 1.0).otherwise(shared_part(F.coalesce(x["a"]["sketch"], none), F.coalesce(x["b"]["sketch"], none), sketch))
        return let(F.greatest(n, m), lambda w: F.struct(w.alias("n"), (w * part).alias("same")))

    pairs = F.transform(F.arrays_zip(a["sections"].alias("a"), b["sections"].alias("b")), weight)
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("same"))
    down = F.aggregate(pairs, start, lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["same"] + x["same"]).alias("same")), lambda s: s["same"] / F.greatest(s["n"], F.lit(1)))
    whole = [least(F.flatten(F.transform(t["sections"], lambda s: s["sketch"])), sketch) for t in (a, b)]
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.greatest(down, shared_part(*whole, sketch)))


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers of the sections in which two trees differ by place."""
    pairs = F.arrays_zip(a["sections"].alias("a"), b["sections"].alias("b"))
    marked = F.transform(pairs, lambda x, k: F.when(~x["a"]["node"].eqNullSafe(x["b"]["node"]), k))
    return F.filter(marked, lambda k: k.isNotNull())


def changed_paragraphs(leaf_a: Column, leaf_b: Column, section: int = SECTION) -> Column:
    """Numbers of the paragraphs that differ by place; a section whose node is equal isn't looked into."""
    pairs = F.arrays_zip(sections(leaf_a, section, 1 << 30).alias("a"), sections(leaf_b, section, 1 << 30).alias("b"))
    differing = F.filter(F.transform(pairs, lambda x, k: F.struct(k.alias("k"), (~x["a"].eqNullSafe(x["b"])).alias("d"))), lambda x: x["d"])
    inside = F.flatten(F.transform(differing, lambda x: F.sequence(x["k"] * section, x["k"] * section + (section - 1))))
    return F.filter(inside, lambda p: ~F.get(leaf_a, p).eqNullSafe(F.get(leaf_b, p)))


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, tree and fingerprint of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.select("doc_id", tree(F.col("text"), **options).alias("tree")).withColumn("fingerprint", fingerprint(F.col("tree")))


def _ranges(docs: DataFrame, docs_each: int = RANGE_DOCS) -> Column:
    """The number of the range in which a row (id, text) lies; ranges rise with ids, and hold no more than about docs_each rows.

    Their bounds are every so-manieth row of a range partitioning of (id, hash of the text): so ids may be of any type with an order
    and spread in any way, and rows of one id are told apart. About MOST_RANGES bounds at most come through the driver.
    """
    key = F.struct("id", F.bitwise_not(F.xxhash64("text")).alias("h"))
    rows = stored(docs.select(key.alias("k")).select("k.id", "k.h"), "fingerprint-ids")  # texts are read once for it
    each = max(docs_each, -(-rows.count() // MOST_RANGES))
    rows = rows.repartitionByRange(shuffle_parts(docs.sparkSession), "id", "h").sortWithinPartitions("id", "h")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the partition
    bounds, n_bounds = rows.withColumn("place", place).where(F.col("place") % each == 0).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "h")))), F.count(F.lit(1))).first()
    # the number of bounds that aren't above the row, by bisection; bounds needn't be exact, only the same for all rows
    table = F.from_json(F.lit(bounds), f"array<struct<id:{dict(docs.dtypes)['id']},h:bigint>>")  # a constant of the plan: read once
    start = F.struct(F.lit(0).alias("lo"), F.lit(n_bounds).cast("int").alias("hi"), key.alias("key"))

    def halve(s: Column, _: Column) -> Column:
        return let(F.floor((s["lo"] + s["hi"]) / 2).cast("int"), lambda m: F.when(s["lo"] >= s["hi"], s).when(F.get(table, m) <= s["key"], F.struct((m + 1).alias("lo"), s["hi"].alias("hi"), s["key"].alias("key"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"), s["key"].alias("key"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(int(n_bounds).bit_length())), start, halve, lambda s: s["lo"])


def _with_next(docs: DataFrame, docs_each: int = RANGE_DOCS) -> DataFrame:
    """docs (id, text) with next_text, the text of the next lower id, after the lowest the highest.

    Ids are dealt into ranges, so that no task sorts more than a range's documents. Only the last document of a range
    has to look into the next one, found over the ranges alone: MOST_RANGES rows at most.
    """
    docs = docs.withColumn("range", _ranges(docs, docs_each))
    text_hash = F.xxhash64("text")
    order = W.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), text_hash)
    inner = docs.withColumn("next_text", F.lead("text").over(order))

    # a row a range: which document comes first in it, and which range comes next
    firsts = docs.groupBy("range").agg(F.max(F.struct("id", F.bitwise_not(text_hash).alias("h"))).alias("first"))
    whole = W.orderBy(F.col("range").desc())
    top = F.max_by("first", "range").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    step = firsts.select(F.col("range").alias("from_range"), F.coalesce(F.lead("first").over(whole), top).alias("next"))
    step = F.broadcast(step.select("from_range", F.col("next.id").alias("n_id"), F.bitwise_not("next.h").alias("n_hash")))
    after = docs.join(step, F.col("id").eqNullSafe(F.col("n_id")) & (text_hash == F.col("n_hash"))).select("from_range", F.col("text").alias("first_text")).dropDuplicates(["from_range"])

    # only a range's last document has no next one in it; the join keeps the rows where the window has put them
    joined = inner.join(after, (F.col("range") == F.col("from_range")) & F.col("next_text").isNull(), "left")
    return joined.select("id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def edited_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document (descending id).

    The edited text has its last third (rounded down) replaced by as much of the next document's beginning.
    Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next and changed (numbers of the sections that the edit changed).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    out = _with_next(docs).select(F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "edited", *(tree(F.col(c)).alias(f"{c}_tree") for c in ("text", "edited", "next_text")))
    own, new, following = (F.col(f"{c}_tree") for c in ("text", "edited", "next_text"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(own).alias("fingerprint"),
        fingerprint(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        changed_sections(own, new).alias("changed"),
    )
