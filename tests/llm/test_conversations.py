"""Repair of conversations: against an enumeration of edits, over many partitions, and on awkward rows."""

import hashlib
import random
from functools import lru_cache

import pytest

from docloom.llm import conversations
from docloom.llm.conversations import Repair, digests

SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
WRITE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def plain(rows):
    """(report, repaired lines) of one conversation by recursion on (cost, letters)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.sha256(y[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def rest(k, state, puts=2):
        ways = []
        if k == len(rows):
            if state in (0, 3):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[k]
            cost, letters, lines = rest(k + 1, state)
            ways.append((cost + 2, "D" + letters, lines))
            if faults[k] in ("", "truncated"):
                more = 5 if faults[k] else 0
                if role[:1] in NEXT[state]:
                    cost, letters, lines = rest(k + 1, NEXT[state][role[:1]])
                    ways.append((cost + more, "K" + letters, (f"{role}:{text}", *lines)))
                name, to = WRITE[state]
                cost, letters, lines = rest(k + 1, to)
                ways.append((cost + 1 + more, "R" + letters, (f"{name}:{text}", *lines)))
        if puts:
            name, to = WRITE[state]
            cost, letters, lines = rest(k, to, puts - 1)
            ways.append((cost + 5, "I" + letters, (f"{name}:", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, letters, lines = rest(0, 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def mended(spark, rows, schema="conv_id long, turn long, role string, text string"):
    repair = Repair(spark.createDataFrame(rows, schema))
    report = {r["conv_id"]: tuple(r)[1:] for r in repair.report().collect()}
    hashes = {r["conv_id"]: r["sha256"] for r in digests(repair.turns()).collect()}
    return {c: (x, hashes.get(c, hashlib.sha256(b"").hexdigest())) for c, x in report.items()}


def expected(rows):
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    return {c: plain(x) for c, x in by.items()}


def drawn(rng, conv, n):
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?", None, "é。", "It is so.\n"]
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_edits_are_the_least_of_all(spark, partitions):
    """With 13 partitions nearly every conversation crosses an edge, one of them many."""
    rng = random.Random(partitions)
    rows = [row for c in range(40) for row in drawn(rng, c, rng.randrange(1, 9))] + drawn(rng, 99, 60) + drawn(rng, None, 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert mended(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_conversation_holds_almost_all_rows(spark):
    rng = random.Random(5)
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}." if rng.random() < 0.9 else "cut") for k in range(3000)] + drawn(rng, 8, 6)
    got = mended(spark, rows)
    import sys

    sys.setrecursionlimit(20_000)
    assert got == expected(rows)


def test_repeated_rows_are_duplicates_but_for_the_first(spark):
    rows = [(1, 0, "user", "Hello.")] * 500 + [(1, 1, "assistant", "Yes.")]
    (report, _) = mended(spark, rows)[1]
    assert report == (0, 0, 499, 0, 499, 998, "K" + "D" * 499 + "K")


def test_walks_over_parts_equal_a_walk_over_all():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(1, 12)
        codes, copies = [rng.randrange(16) for _ in range(n)], [rng.choice([1, 1, 3]) for _ in range(n)]
        cost, ((_, _, letters, _),) = conversations.walk(codes, copies, conversations.START, conversations.END, True)
        costs = conversations.transfer(codes, copies)[:4]
        assert cost == min(c + e for c, e in zip(costs, conversations.END, strict=True))
        assert sum({"K": 0, "R": 1, "D": 2, "I": 5}[x] for x in "".join(letters)) <= cost


@pytest.mark.parametrize("kind", ["string", "date", "binary", "decimal(38,0)", "double", "boolean"])
def test_ids_of_any_type_and_clashing_names(spark, kind):
    from pyspark.sql import functions as F

    rows = [(0, 0, "user", "a."), (0, 1, "assistant", "b."), (1, 0, "user", "c"), (None, 3, "assistant", "d.")]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    ident = F.make_date(F.lit(2020), F.lit(1), F.col("conv_id") + 1) if kind == "date" else F.col("conv_id").cast("string").cast("binary") if kind == "binary" else F.col("conv_id").cast(kind)
    df = df.withColumn("conv_id", ident).withColumns({c: F.lit(0) for c in ("seq", "pid", "rows", "digest", "copies", "code", "c", "first")})
    repair = Repair(df)
    assert sorted(r["audit"] for r in repair.report().collect()) == ["D", "D", "KK"]
    assert repair.turns().count() == 2


def test_an_empty_table_gives_nothing(spark):
    repair = Repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.report().count() == repair.turns().count() == digests(repair.turns()).count() == 0
