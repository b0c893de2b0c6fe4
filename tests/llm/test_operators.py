"""Operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import components, decontam, fingerprint, langid, line_dedup, minhash, mixing, pii, queries, suffix_dedup, toxicity, warc
from tests.conftest import SMALL, same_rows


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- toxicity


def brute_segments(scores):
    """Maximal segments by recursion on the best one."""
    if not len(scores):
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1], x[2]))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute_segments(scores[:i]) + [round(best[0], 6)] + brute_segments(scores[j:])


def test_maximal_segments_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        scores = np.array([rng.choice([-3.1, -1.7, -0.4, 0.9, 2.3, 4.2]) for _ in range(rng.randrange(0, 14))])
        assert sorted(round(s, 6) for *_, s in toxicity.maximal_segments(scores)) == sorted(brute_segments(list(scores)))


def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    held = [(got[i]["predicted"], t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert sum(p and not t for p, t in held) <= 1
    assert sum(p and t for p, t in held) >= 0.7 * sum(t for _, t in held)


def test_scores_of_the_query_equal_brute_force(spark):
    import math

    rng = random.Random(41)
    rows = [(k, " ".join([rng.choice(["good", "day", "sun", "tree", "river"]) for _ in range(rng.randrange(1, 12))] + (["vile", "scum"] * rng.randrange(1, 3) if k % 4 == 0 else []))) for k in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int"))
    assert model.curve is not None

    def plain(text):
        scores = list(model.token_scores(text or ""))
        e = [model.scale * len(scores) * math.exp(-model.decay * s) for s in brute_segments(scores)]
        logs = [-math.log(x) for x in e if x < model.e_value]
        return 1 / (1 + math.exp(-float(model.curve @ [1.0, math.log(1 + sum(logs)), min(30.0, max(logs, default=0.0)) / 10])))

    got = {r["doc_id"]: r["__score"] for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert got == pytest.approx({k: plain(t) for k, t in rows}, abs=1e-4)
    assert min(got[k] for k in range(0, 200, 4)) > 0.7 > max(got[k] for k, _ in rows if k % 4)


def test_repeated_rows_are_one_document_to_the_model(spark):
    rows = [(k, "vile scum here" if k % 4 == 0 else "good day to all") for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, toxic int")
    plain_, repeated = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows + [(0, "vile scum here")] * 500))
    assert plain_.share == repeated.share == 0.25
    assert plain_.curve.tolist() == pytest.approx(repeated.curve.tolist())


def test_lambda_is_the_root():
    from collections import Counter

    bins = Counter({-15: 90, 20: 10})
    decay = toxicity.karlin(bins)
    assert sum(c * np.exp(decay * k / 10) for k, c in bins.items()) == pytest.approx(100, rel=1e-6)


# --- WARC


def test_archive_round_trip_and_single_records():
    payloads = [f"<html><p>{k} common words in every page</p></html>".encode() * (k % 5 + 1) for k in range(300)] + [b"", "é\r\n\r\nx".encode()]
    dictionary = warc.train_dictionary([warc.record(k, "", p, hashlib.sha256(p).hexdigest(), None, False) for k, p in enumerate(payloads)], 4096)
    data, back = warc.roundtrip_bytes(payloads, dictionary)
    assert back == payloads
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and data[8 : 8 + len(dictionary)] == dictionary
    plain, _ = warc.roundtrip_bytes(payloads, b"")
    assert len(data) - len(dictionary) < len(plain)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(io.BytesIO(data[:-3])))


def test_revisits(spark):
    same = "x" * 150
    pages = spark.createDataFrame([(5, "u", same), (3, "u", same), (9, "u", same), (1, "u", "short"), (2, "u", "short"), (4, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None)}
    assert got[5]["payload_bytes"] == 150 and got[5]["payload"] is None and bytes(got[4]["payload"]) == b""


def test_dictionary_holds_what_recurs_at_the_end_of_long_pages(spark):
    rng = random.Random(31)
    footer = rng.randbytes(400).hex()
    pages = spark.createDataFrame([(k, "u", rng.randbytes(20_000).hex() + footer) for k in range(12)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, sample_bytes=8192)
    path = archives.first()["path"].removeprefix("file://")
    with open(path, "rb") as archive:
        assert footer[200:600].encode() in archive.read(8 + 65_536)
    payload = F.encode("html", "UTF-8")
    sizes = pages.select(F.octet_length(warc.spread_pieces(payload, F.octet_length(payload), 8192)).alias("n")).distinct().collect()
    assert [r["n"] for r in sizes] == [8192]
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, archives).collect()} == {r["page_id"]: r["html"].encode() for r in pages.collect()}


# --- mixing


def test_weights_meet_entropy_and_limit(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    tokens = np.array([900.0, 90.0, 10.0])

    def power(e):
        w = (tokens / tokens.sum()) ** e
        return w / w.sum()

    def entropy(w):
        return float(-(w * np.log(w)).sum())

    rows = {r["source"]: r for r in mixing.weights(sources, target_entropy=0.7, max_repeats=100.0).collect()}
    w = np.array([rows[k]["weight"] for k in "abc"])
    assert entropy(w) == pytest.approx(0.7 * np.log(3), abs=1e-6) and w == pytest.approx(power(rows["a"]["exponent"]))
    rows = {r["source"]: r for r in mixing.weights(sources, target_entropy=0.999, max_repeats=4.0).collect()}
    assert rows["c"]["quota"] == pytest.approx(40, rel=1e-3) and all(r["quota"] <= 4 * r["tokens"] + 1e-3 for r in rows.values())


def test_mix_realises_quotas_once_per_pass(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, rng.randrange(1, 30)), "abc"[min(2, int(rng.expovariate(1.5)))]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, target_entropy=0.97, max_repeats=3.0, block_tokens=400).collect()
    quota = {r["source"]: r for r in mixing.weights(docs.groupBy("source").agg(F.sum(mixing.n_tokens(F.col("text"))).alias("tokens")), target_entropy=0.97, max_repeats=3.0).collect()}
    longest = 30
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    for s, q in quota.items():
        assert q["quota"] - longest <= sum(r["n_tokens"] for r in got if r["source"] == s) <= q["quota"] + 1e-6
        whole = int(q["quota"] // q["tokens"])
        assert all(sum(r["epoch"] == e and r["source"] == s for r in got) == sum(x[2] == s for x in rows) for e in range(whole))


# --- line dedup


def test_lines_across_partition_edges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice(["Hot line ", "\thot LINE", f"line {rng.randrange(30)}", f"own {k}", ""]) for _ in range(rng.randrange(1, 6)))) for k in range(300)]
    seen = {}
    for k, t in rows:
        for line in t.split("\n"):
            seen.setdefault(line.strip(" \t").lower(), set()).add(k)
    drop = {x for x, docs in seen.items() if x and len(docs) >= 10}
    wanted = {k: "\n".join(x for x in t.split("\n") if x.strip(" \t").lower() not in drop) for k, t in rows}
    got = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == wanted
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- MinHash


def jaccard_components(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def exact_components(texts, width, percent):
    """Components of all links, by an index of prefixes: of each set its rarest elements, so many that two sets at the threshold share one."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    number, members, count = {}, {}, collections.Counter()
    for k, t in sorted(texts.items()):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        grams = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        members.setdefault(frozenset(number.setdefault(g, len(number)) for g in grams), []).append(k)
    for x in members:
        count.update(x)
    sets, links = [x for x in members if x], 0
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    index = {}
    for n, x in enumerate(sets):
        for k in members[x][1:]:
            link(members[x][0], k)
        rare = sorted(x, key=lambda g: (count[g], g))[: len(x) - -(-len(x) * percent // 100) + 1]
        for m in {m for g in rare for m in index.get(g, ())}:
            shared = len(x & sets[m])
            if 100 * shared >= percent * (len(x) + len(sets[m]) - shared):
                links += 1
                link(members[x][0], members[sets[m]][0])
        for g in rare:
            index.setdefault(g, []).append(n)
    return {k: find(k) for k in texts}, links


def test_no_link_is_lost_on_all_documents(spark):
    """Recall of op5 on the whole table: its components are those of an exact similarity join."""
    folder = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    wanted, links = exact_components(texts, 4, 80)
    got = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op5_minhash"](spark, folder).select("doc_id", "component_id").collect()}
    assert links > 100 and got == wanted


def test_components_equal_brute_force_with_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    base = words(rng, 120, 400).split()
    rows = []
    for k in range(160):  # near copies of near copies, at all similarities around the threshold
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(copy)))
    rows += [(200 + k, words(rng, rng.randrange(0, 40), 400)) for k in range(60)] + [(300 + k, rows[k][1]) for k in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == jaccard_components(rows, 4, 80)


def test_texts_of_one_id_are_linked_each_on_its_own(spark):
    rng = random.Random(17)
    texts = [words(rng, 60, 5000) for _ in range(4)]
    rows = [(5, texts[0]), (5, texts[1]), (2, texts[0] + " end"), (9, texts[1] + " end"), (7, texts[2]), (7, texts[2] + " end"), (8, texts[3])]
    got = minhash.near_duplicates(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string"), width=4, percent=80)
    hashes = {r["h"]: r["text"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    found = {(r["doc_id"], hashes[r[minhash.TEXT_HASH]]): (r["component_id"], r["kept"]) for r in got.collect()}
    assert got.count() == 8
    assert [found[x] for x in rows[:4]] == [(2, False), (5, True), (2, True), (5, False)]
    assert [found[x][0] for x in rows[4:6]] == [7, 7] and sorted(found[x][1] for x in rows[4:6]) == [False, True]
    assert found[rows[6]] == (8, True)


def test_pigeonhole_covers_the_radius():
    parts = minhash.chunks(0.8)
    r = minhash.radius(minhash.POSITIONS, 0.2)
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 65536, minhash.POSITIONS).astype("<u2")
        b = a.copy()
        b[rng.choice(minhash.POSITIONS, r, replace=False)] += 1
        keys = minhash.chunk_keys(np.stack([a, b]), parts)
        assert (keys[0] == keys[1]).any()


def test_long_chain_is_one_component(spark):
    links = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    got = components.components(links).collect()
    assert len(got) == 200 and {r["component"] for r in got} == {0}


# --- repeated strings


def brute_repeats(rows, length):
    seen = {}
    for k, t in rows:
        b = t.encode()
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    gone = {k: set() for k, _ in rows}
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + length))
    return {k: bytes(c for i, c in enumerate(t.encode()) if i not in gone[k]) for k, t in rows}


def repeat_rows(rng):
    passage = [words(rng, 40, 5000) for _ in range(4)]
    rows = [(k, words(rng, rng.randrange(0, 30), 5000) + " ".join(rng.choice(passage)[rng.randrange(0, 60) : rng.randrange(100, 240)] + "é" for _ in range(rng.randrange(0, 3))) + words(rng, 9, 5000)) for k in range(120)]
    return rows + [(500, "ab" * 200), (501, "a" * 300), (502, rows[0][1]), (503, "z" + "a" * 90)]


@pytest.mark.parametrize("group", [512, 6, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # small: groups are dealt out
    rows = repeat_rows(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for passage in (64, 80):
        got = suffix_dedup.remove_repeats(docs, length=80, passage=passage, passage_words=12).collect()
        assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute_repeats(rows, 80)
        assert {r["doc_id"]: r["passages"] for r in got} == brute_passages(rows, passage, 12)


def brute_passages(rows, passage, n_words):
    import re

    seen = {}
    for k, t in rows:
        b = t.encode()
        for i in range(len(b) - passage + 1):
            seen.setdefault(b[i : i + passage], []).append((k, i))
    covered = {k: set() for k, _ in rows}
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                covered[k].update(range(i, i + passage))
    out = {}
    for k, t in rows:
        runs = [[x, x + 1] for x in sorted(covered[k])]
        joined = []
        for s, e in runs:
            if joined and joined[-1][1] == s:
                joined[-1][1] = e
            else:
                joined.append([s, e])
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
        out[k] = [r for r in joined if sum(r[0] <= s and e <= r[1] for s, e in at) >= n_words]
    return out


@pytest.mark.parametrize("segment", [7, 100, 777])
def test_anchors_do_not_depend_on_segments(monkeypatch, segment):
    text = words(random.Random(23), 700, 5000).encode()
    whole = list(suffix_dedup.anchors(text, 64))
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", segment)
    found = list(suffix_dedup.anchors(text, 64))
    assert len({p for *_, p in found}) == len(found) and found == whole
    assert [x for _, a, b, _ in found for x in range(a, b + 1)] == list(range(len(text) - 63))


def test_repeat_groups_have_all_occurrences():
    text = ["xxabcdefyy", "zzabcdefqq", "kkabcdefyy"]
    rows = [(t[:2][::-1].encode(), t[2:].encode()) for t in text]
    found = {(left, right): sorted(group) for left, right, group in suffix_dedup.repeat_groups(rows, 6)}
    assert found == {(0, 8): [0, 2], (0, 6): [0, 1, 2]}


@pytest.mark.parametrize("group", [512, 6])
def test_repeat_groups_are_equal_strings_and_cover_what_is_removed(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = repeat_rows(random.Random(12))
    text = {k: t.encode() for k, t in rows}
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), length=80, groups=True).collect()
    strings, members, gone = {}, {}, {k: set() for k in text}
    for r in got:
        strings.setdefault(r["repeat"], set()).add(text[r["doc_id"]][r["s"] : r["e"]])
        members.setdefault(r["repeat"], set()).add((r["doc_id"], r["s"]))
        gone[r["doc_id"]].update(range(r["s"], r["e"]))
    assert all(len(x) == 1 for x in strings.values()) and all(len(x) > 1 for x in members.values())
    assert {k: bytes(c for i, c in enumerate(t) if i not in gone[k]) for k, t in text.items()} == brute_repeats(rows, 80)


# --- language


def test_languages_on_held_out_rows(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right, n = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.97


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    tagger = langid.Tagger(["a", "b", "c"], np.zeros((langid.BUCKETS, 3), np.float32), rng.normal(size=(3, 3)))
    lengths = np.array([3, 1, 4])
    emissions = rng.normal(size=(8, 3))
    got, at = tagger.marginals(emissions, lengths), 0
    for n in lengths:
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            score = np.exp(sum(emissions[at + i, y] for i, y in enumerate(path)) + sum(tagger.transitions[x, y] for x, y in itertools.pairwise(path)))
            for i, y in enumerate(path):
                total[i, y] += score
        assert got[at : at + n] == pytest.approx(total / total.sum(axis=1, keepdims=True), rel=1e-6)
        at += n


def test_predictions_equal_enumeration(spark):
    rng = random.Random(8)
    tagger = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), train_docs=200)
    known = [w for t in ("the of and in", "der die und nicht", "le la les des", "el los que una") for w in t.split()]
    rows = [(str(k), " ".join(rng.choice(known) for _ in range(rng.randrange(1, 6)))) for k in range(40)] + [("x", None), ("y", "12 !"), ("z", "")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(rows, "doc_id string, text string"), tagger).collect()}
    for k, text in rows:
        w = langid.words_of(text or "")
        if not w:
            assert got[k] == ("und", 0.0)
            continue
        emissions = np.array([tagger.weights[langid.features(x)].sum(axis=0) for x in w])
        sums = np.zeros(len(tagger.labels))
        for path in itertools.product(range(len(tagger.labels)), repeat=len(w)):
            p = np.exp(sum(emissions[i, y] for i, y in enumerate(path)) + sum(tagger.transitions[x, y] for x, y in itertools.pairwise(path)))
            for y in path:
                sums[y] += p
        sums /= sums.sum()
        assert got[k][0] == tagger.labels[int(sums.argmax())] and got[k][1] == pytest.approx(sums.max(), abs=1e-4)


def test_rare_languages_are_learned(spark):
    rows = [(k, "en", f"the old house of word{k}") for k in range(3000)] + [(9000 + k, "xx", f"zuqa wuqi buqo kuqe{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    tagger = langid.fit(docs, train_docs=100)
    assert tagger.labels == ["en", "xx"]
    assert langid.predict(docs.where("lang = 'xx'"), tagger).first()["lang_pred"] == "xx"


def test_code_switching_is_followed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = langid.fit(docs, train_docs=400)
    tags = [lang for _, lang, _ in langid.tag_words("the thing is that with the der und die nicht ein und das der", tagger)]
    assert tags[:5] == ["en"] * 5 and tags[-5:] == ["de"] * 5


# --- fingerprints


def test_branches_locate_edits(spark):
    a = "\n".join(f"line {k}" for k in range(40))
    b = a.replace("line 17", "line X").replace("line 39", "line 39\nnew")
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.changed_paragraphs(fingerprint.leaves(F.col("a")), fingerprint.leaves(F.col("b"))).alias("x")).first()
    assert row["x"] == [17, 40]


@pytest.mark.parametrize("docs_each", [1, 2, 3, 100])
def test_next_document_over_ranges(spark, docs_each):
    rng = random.Random(docs_each)
    ids = sorted({5, 900, 901, 70_000, 70_001, 140_000, 3_000_000, *(rng.randrange(-(2**62), 2**62) for _ in range(300))})
    docs = spark.createDataFrame([(k, f"text{k}") for k in ids], "id long, text string")
    got = {r["id"]: r["next_text"] for r in fingerprint._with_next(docs, docs_each).collect()}
    assert got == {k: f"text{ids[n - 1]}" for n, k in enumerate(ids)}


IDS = {
    "numbers": lambda k: F.when(k < 1000, k).otherwise(F.xxhash64(k)), "prefixed": lambda k: F.format_string("https://example.org/document-%08d", k), "doubles": lambda k: k / 4001,
    "dates": lambda k: F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int")), "times": lambda k: F.timestamp_millis(k * 1000 + 7), "binary": lambda k: F.unhex(F.sha2(k.cast("string"), 256)),
    "decimals": lambda k: (k.cast("decimal(38,0)") * F.lit("1000000000000000000000000000").cast("decimal(28,0)")).cast("decimal(38,0)"), "one": lambda k: F.lit("same"),
}


@pytest.mark.parametrize("kind", IDS)
def test_ranges_are_even_however_ids_are_spread(spark, kind):
    docs = spark.range(4000).select(IDS[kind](F.col("id")).alias("id"), F.concat(F.lit("t"), "id").alias("text")).repartition(5)
    sizes = {r["range"]: r["count"] for r in docs.withColumn("range", fingerprint._ranges(docs, 100)).groupBy("range").count().collect()}
    assert 40 <= len(sizes) <= 48 and max(sizes.values()) <= 101
    ends = docs.withColumn("range", fingerprint._ranges(docs, 100)).groupBy("range").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("range").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(ends, ends[1:], strict=False))


def test_fingerprints_are_bounded_and_compared_down_the_tree(spark):
    rng = random.Random(5)
    long = "\n".join(words(rng, 12, 5000) for _ in range(4000))
    lines = long.split("\n")
    edited = "\n".join([*lines[:2000], "changed", *lines[2001:]])
    df = spark.createDataFrame([(1, long), (2, edited), (3, words(rng, 3000, 5000)), (4, None), (5, ""), (6, long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.trees(df).collect()}
    assert all(len(r["fingerprint"]) <= 64 + 16 * (16 + 12 + 32 * 6) for r in got.values())
    assert got[1]["fingerprint"] == got[6]["fingerprint"] != got[2]["fingerprint"] and got[4]["fingerprint"] == got[5]["fingerprint"]
    t = fingerprint.trees(df)
    pairs = t.alias("a").crossJoin(t.alias("b")).select("a.doc_id", F.col("b.doc_id").alias("other"), fingerprint.likeness(F.col("a.tree"), F.col("b.tree")).alias("x"), fingerprint.changed_sections(F.col("a.tree"), F.col("b.tree")).alias("c"))
    near = {(r["doc_id"], r["other"]): (r["x"], r["c"]) for r in pairs.collect()}
    assert near[1, 6] == (1.0, []) and near[1, 2][1] == [7] and near[1, 2][0] > 0.97 and near[1, 3][0] < 0.3 and near[4, 5][0] == 1.0


# --- personal data


def test_account_numbers_by_length_and_boundary(spark):
    texts = {
        "IBAN ES91 2100 0418 4502 0005 1332 EUR paid": ["ES91 2100 0418 4502 0005 1332"], "ES9121000418450200051332 EUR": ["ES9121000418450200051332"], "PL61 1090 1014 0000 0712 1981 2874 BANK": ["PL61 1090 1014 0000 0712 1981 2874"],
        "XXDE89370400440532013000": [], "DE89370400440532013000X": [], "x DE89370400440532013000, NO93 8601 1117 947.": ["DE89370400440532013000", "NO93 8601 1117 947"], "ZZ8937040044053201300": [], "MT84 MALT 0110 0001 2345 MTLC AST0 01S": ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
    }
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["text"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] for r in got} == texts


def test_redaction_is_linear_in_the_spans(spark):
    import time

    def took(n):
        text = " ".join(f"é{k}.b@c{k}.org" for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.redact(df).first()["text"] == " ".join("é[EMAIL]" for _ in range(n))
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 15


def test_redaction_of_spans_that_overlap(spark):
    texts = ["call +49 30 1234567 or a@b.c", "4111 1111 1111 1111 " * 200 + "+1 4111 1111 1111 1111 x", "1.2.3.4@a.b " * 150, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df).collect()}
    for r in pii.redact(df).collect():
        text, at, out = texts[r["doc_id"]] or "", 0, ""
        for s in found[r["doc_id"]]["spans"]:
            if s["start"] >= at:
                out, at = out + text[at : s["start"]] + f"[{s['kind'].upper()}]", s["end"]
        assert r["text"] == out + text[at:]


def test_spans_and_scores(spark):
    text = "é mail me: Ann.B@ex-ample.co.uk_x@y.z, ip 10.0.0.256 or 10.0.0.255, card 4111 1111 1111 1111, +1 (555) 010-9999. IBAN GB82WEST12345698765432 ssn 078-05-1120 and 078-05-1121; or DE89 3704 0044 0532 0130 00. " + "x" * 50 + " 078-05-1122 (SSN) " + "y" * 50 + " 078-05-1123 " + "z" * 50 + ' api_key: "abcdefgh12345678" token = abcdefghijklmnopqrst'
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    found = [(s["kind"], text[s["start"] : s["end"]]) for s in got]
    assert found == [("email", "Ann.B@ex-ample.co.uk"), ("email", "_x@y.z"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999"), ("iban", "GB82WEST12345698765432"), ("ssn", "078-05-1120"), ("ssn", "078-05-1121"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "078-05-1122"), ("secret", 'api_key: "abcdefgh12345678')]
    assert "[CARD]" in pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]


def test_very_many_numbers_are_answered(spark):
    import time

    cards = "4111 1111 1111 1111, " * 100_000
    numbers = " a ".join(map(str, range(1_000_000)))
    began = time.time()
    got = {r["doc_id"]: (r["n"], r["last"]) for r in pii.find(spark.createDataFrame([(1, numbers), (2, cards)], "doc_id long, text string")).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("last")).where("n > 0").collect()}
    assert got == {2: (100_000, 21 * 100_000 - 2)}
    assert time.time() - began < 120


@pytest.mark.parametrize("kind", range(4))
def test_patterns_equal_the_contract(spark, kind):
    import re

    base = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"][kind]
    rng = random.Random(kind)
    texts = ["".join(rng.choice("aé1.0 -@+()_\n") for _ in range(rng.randrange(0, 60))) for _ in range(800)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in rows.select("t", pii.matches(F.col("t"), pii.KINDS[kind][1]).alias("m")).collect():
        assert [(m["start"], m["end"]) for m in r["m"]] == [x.span() for x in re.finditer(base, r["t"])]


# --- decontamination


def test_blocks_equal_one_broadcast(spark):
    rng = random.Random(4)
    bench = spark.createDataFrame([(k, words(rng, rng.choice([0, 3, 15, 40]), 12)) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, words(rng, rng.randrange(0, 200), 12)) for k in range(60)], "doc_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    one, many = (sorted(map(str, decontam.contamination(docs, bench, n=5, block_words=b).select(*columns).collect())) for b in (1_000_000, 20))
    assert one == many
    clean = {r["doc_id"] for r in decontam.clean_documents(docs, bench, n=5).collect()}
    assert clean == {r["doc_id"] for r in decontam.clean_documents(docs, bench, n=5, block_words=20).collect()} == {r["doc_id"] for r in decontam.contamination(docs, bench, n=5).where("not contaminated").collect()}


@pytest.mark.parametrize("block_words", [1_000_000, 4])
def test_items_without_id_hit_as_in_the_sql(spark, monkeypatch, block_words):
    import duckdb

    rng = random.Random(29)
    long = [words(rng, 16, 5000) for _ in range(3)]
    items = [(None, "alpha beta"), (None, "gamma"), (10, "alpha beta"), (9, "delta"), (None, long[0]), (9, long[1])]
    rows = [(1, "x alpha beta y"), (2, "gamma"), (3, "delta z gamma"), (4, "clean"), (5, long[0] + " " + words(rng, 9, 9)), (6, long[1]), (7, long[2]), (8, None)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: {"documents": docs, "benchmark": bench}[name])
    monkeypatch.setattr(queries.decontam, "contamination", lambda d, b, n, real=decontam.contamination: real(d, b, n=n, block_words=block_words))
    con = duckdb.connect()
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    con.executemany("insert into documents values (?, ?)", rows)
    wanted = con.execute(queries.ORACLE["op10_decontamination"]).df()
    assert wanted.contaminated.sum() == 5
    same_rows(queries.op10_decontamination(spark, "").toPandas(), wanted)
    monkeypatch.undo()
    kept = decontam.clean_documents(docs, bench, block_words=block_words).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(wanted[~wanted.contaminated].doc_id)


def test_passages_are_removed(spark):
    bench = spark.createDataFrame([(1, "The QUICK brown fox"), (2, "é à ô")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "See: the quick, BROWN-fox! jumps; É-à-ô é À ô"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontam.remove_passages(docs, bench, n=4).collect()}
    assert got == {1: "See: ! jumps; É-à-ô é À ô", 2: "clean", 3: ""}


# --- pipeline


def plain_segments(scores):
    """Scores of the maximal segments: the best one, then those on either side of it."""
    todo, out = [(0, len(scores))], []
    while todo:
        low, high = todo.pop()
        best, total, start, found = 0.0, 0.0, low, None
        for k in range(low, high):
            if total <= 0:
                total, start = 0.0, k
            total += scores[k]
            if total > best + 1e-12:
                best, found = total, (start, k + 1)
        if found:
            out.append(best)
            todo += [(low, found[0]), (found[1], high)]
    return out


def toxic_by_brute_force(p, spark, docs):
    """Ids of documents with a probability of 0.7 or more, by the stage's model and plain loops."""
    import math

    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), learn=queries.fold(3) != 1)
    out = set()
    for r in docs.collect():
        scores = list(model.token_scores(r["text"] or ""))
        e = [model.scale * len(scores) * math.exp(-model.decay * s) for s in plain_segments(scores)]
        if model.probability([x for x in e if x < model.e_value]) >= 0.7:
            out.add(r["doc_id"])
    return out


def test_pipeline_stages_by_brute_force(spark):
    import duckdb

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        if name != "mixing":
            assert sorted(docs.columns) == sorted(p.COLUMNS)
        con = duckdb.connect()
        con.register("documents", before.toPandas())
        con.execute(f"create view benchmark as select * from '{SMALL}/benchmark.parquet'")
        ids = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            assert ids == {r["doc_id"] for r in before.collect()} - toxic_by_brute_force(p, spark, before) and len(ids) < before.count()
        elif name == "line_dedup":
            wanted = con.execute(queries.ORACLE["op4_line_dedup"]).df()
            assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()} == dict(zip(wanted.doc_id, wanted.kept_sha256, strict=True))
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "near_duplicates":
            groups = jaccard_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert ids == {k for k, g in groups.items() if k == g}
        elif name == "decontamination":
            wanted = con.execute(queries.ORACLE["op10_decontamination"]).df()
            assert ids == set(wanted[~wanted.contaminated].doc_id)
        else:
            same_rows(docs.toPandas(), con.execute(queries.ORACLE["op3_mixing"]).df())


def test_pipeline_run_gives_its_stages_result(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
    same_rows(p.run(spark, SMALL).toPandas(), docs.toPandas())


def test_texts_over_the_batch_and_segment_limits(spark):
    """A text of more than 8 MB: over an Arrow batch, and over several segments of the repeated strings."""
    from docloom.llm import common

    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(1_050_000)) + " " + passage
    assert len(long) > common.BATCH_BYTES > suffix_dedup._SEGMENT
    docs = spark.createDataFrame([(1, long), (2, "start " + passage), (3, "\n".join(["line"] * 3)), (4, long + " end")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n"]) for r in suffix_dedup.remove_repeats(docs.where("doc_id < 4")).select("doc_id", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").alias("n")).collect()}
    assert got == {1: (len(passage) + 1, 1), 2: (len(passage) + 1, 1), 3: (0, 0)}
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r["doc_id"]: r["n_lines"] for r in line_dedup.drop_shared_lines(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontam.contamination(docs, bench).collect()} == {1: 80, 2: 80, 3: 0, 4: 80}


def test_intermediates_can_be_removed(spark):
    import os

    from docloom.llm import common

    kept = common.stored(spark.range(3).toDF("x"), "kept")
    assert kept.count() == 3 and common.sample_cut(kept, F.xxhash64("x"), 2) is not None
    folder = common.application_dir(spark).removeprefix("file://")
    assert os.listdir(folder)
    common.remove_intermediates(spark)
    assert not os.path.exists(folder)


def test_a_mix_of_a_hundred_thousand_sources(spark):
    """The exponent is found once: not again for each source, as when the plan drops the columns that hold it."""
    import time

    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.when(F.col("id") % 3 == 0, "b c")).alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    began = time.perf_counter()
    got = mixing.mix(docs, target_entropy=0.98, max_repeats=4.0).agg(F.countDistinct("source").alias("sources"), F.sum("n_tokens").alias("tokens")).first()
    assert got["sources"] > 30_000 and abs(got["tokens"] / 166_668 - 1) < 0.5
    assert time.perf_counter() - began < 150
    with pytest.raises(ValueError):
        limit, mixing.MOST_SOURCES = mixing.MOST_SOURCES, 10
        try:
            mixing.mix(docs)
        finally:
            mixing.MOST_SOURCES = limit
