"""Conversations of which rows are missing, damaged or out of turn, mended at the least cost.

Rows of a conversation are taken by turn (nulls first), then role, then SHA-256
of the text. A row is blank, a duplicate (its role and text came before),
truncated, or sound; the first of these counts. It may be kept (0), rewritten as
the user's or the assistant's (1), or deleted (2); blank rows and duplicates
have to be deleted, a truncated row that stays costs 5 more, and an empty turn
of the user or the assistant may be put anywhere (5). What is left has to read
as pairs of user and assistant, with a system's turn before them if there is one.

Method. A node of the graph is (rows consumed, state of the role pattern), an arc
an edit. Minimum costs forward from the start and backward from the end tell
which arcs are tight, that is, on some cheapest path. A set of nodes then walks
the tight arcs and takes the arcs of the least letter at each step, which gives
the ASCII-least of all cheapest edit strings. The role pattern is deterministic,
so the letters say what each turn's role becomes.

Scale. Rows are range-partitioned by the whole order, so one conversation may
fill any number of partitions; its part of one is a run. A run's effect on costs
is a 4 x 4 matrix (min-plus), so the costs at runs' borders are products over a
conversation's runs (no more than there are partitions), and then all runs are
walked at once, each from every state that a cheapest path may enter it by; the
chain of entered states is settled last. Only conversations that cross a
partition's edge take part in these steps. Rows that repeat everything are
counted before any shuffle; first occurrences are found by a partial minimum.
Texts are moved only for turns that stay.

Defined results: a null role or text is one space (so such a text is blank); a
null id is a conversation like any other; rows that repeat id, turn, role and
text are duplicates but for the first; an empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shuffle_parts, stored

#: Fixed by the contract: white space, what ends a sentence, costs.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
SOUND, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3
ROLES = "sua"  # initials; any other role is 3
NAMES = {"u": "user", "a": "assistant"}
#: The role pattern: states are what came last (nothing, s, u, a).
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTED, FAR = range(4), (0, 3), 1 << 60
#: What may be written in a state, and the state after that.
WRITTEN = {q: next((r, STEP[q, r]) for r in NAMES if (q, r) in STEP) for q in STATES}


def _arcs(role: int, fault: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of all arcs over a row."""
    out = [("D", q, q, DELETE) for q in STATES]
    if fault in (SOUND, TRUNCATED):
        more = CUT if fault == TRUNCATED else 0
        out += [("K", q, STEP[q, r], KEEP + more) for q in STATES for r in ROLES[role : role + 1] if (q, r) in STEP]
        out += [("R", q, WRITTEN[q][1], REROLE + more) for q in STATES]
    return out


#: By code: 4 * role + fault.
ARCS = [_arcs(code // 4, code % 4) for code in range(16)]
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _onwards(costs: Sequence[int]) -> list[int]:
    """Least costs of a layer's nodes, insertions within it included."""
    out = list(costs)
    for _ in STATES:
        for q, (_, to) in WRITTEN.items():
            out[to] = min(out[to], out[q] + INSERT)
    return out


def _homewards(costs: Sequence[int]) -> list[int]:
    """The same for costs to the end."""
    out = list(costs)
    for _ in STATES:
        for q, (_, to) in WRITTEN.items():
            out[q] = min(out[q], out[to] + INSERT)
    return out


def _over(costs: Sequence[int], code: int, more: int) -> list[int]:
    out = [FAR] * len(STATES)
    for _, q, to, cost in ARCS[code]:
        out[to] = min(out[to], costs[q] + cost + more)
    return out


def _back(costs: Sequence[int], code: int, more: int) -> list[int]:
    out = [FAR] * len(STATES)
    for _, q, to, cost in ARCS[code]:
        out[q] = min(out[q], costs[to] + cost + more)
    return out


START = [0, FAR, FAR, FAR]
END = _homewards([0 if q in ACCEPTED else FAR for q in STATES])


def transfer(codes: Sequence[int], copies: Sequence[int]) -> list[int]:
    """16 least costs, from each state before a run to each state after its last row."""
    out: list[int] = []
    for q in STATES:
        costs = [0 if p == q else FAR for p in STATES]
        for code, n in zip(codes, copies, strict=True):
            costs = _over(_onwards(costs), code, DELETE * (n - 1))
        out += costs
    return out


def walk(codes: Sequence[int], copies: Sequence[int], before: Sequence[int], after: Sequence[int], last: bool) -> tuple[int, list[tuple[int, int, list[str], list[list[str]]]]]:
    """The least cost, and for each state by which a cheapest path may enter this run (state, state after it, letters a row, roles a row).

    before: costs at the run's start; after: costs from its end on. Roles of a row: those put before it ("+user"), its own
    ("=": unchanged, "": deleted), and behind the last row of a conversation those put at its end.
    """
    n = len(codes)
    ahead = [_onwards(before)]
    for k in range(n):
        ahead.append(_onwards(_over(ahead[k], codes[k], DELETE * (copies[k] - 1))))
    behind = [list(after)]
    for k in reversed(range(n)):
        behind.append(_homewards(_back(behind[-1], codes[k], DELETE * (copies[k] - 1))))
    behind.reverse()
    best = min(b + c for b, c in zip(before, behind[0], strict=True))
    out = []
    for entered in STATES:
        if before[entered] + behind[0][entered] != best:
            continue
        nodes, letters, roles = {entered}, [], []
        for k in range(n):
            more, said, put = DELETE * (copies[k] - 1), "", []
            while True:
                tight = [(letter, q, to) for letter, q, to, cost in ARCS[codes[k]] if q in nodes and ahead[k][q] + cost + more + behind[k + 1][to] == best]
                tight += [("I", q, WRITTEN[q][1]) for q in nodes if ahead[k][q] + INSERT + behind[k][WRITTEN[q][1]] == best]
                least = min(letter for letter, *_ in tight)
                came = [q for letter, q, _ in tight if letter == least]
                nodes = {to for letter, _, to in tight if letter == least}
                said += least
                if least == "I":
                    put.append("+" + NAMES[WRITTEN[came[0]][0]])
                    continue
                put.append(NAMES[WRITTEN[came[0]][0]] if least == "R" else {"D": "", "K": "="}[least])
                break
            letters.append(said + "D" * (copies[k] - 1))  # a copy has to go, and D is less than I
            roles.append(put)
        while last and not any(q in ACCEPTED for q in nodes):
            q = min(nodes)
            letters[-1] += "I"
            roles[-1].append("+" + NAMES[WRITTEN[q][0]])
            nodes = {WRITTEN[q][1]}
        out.append((entered, min(nodes), letters, roles))
    return best, out


def role_class(role: Column) -> Column:
    return F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)


_KEY = ("conv_id", "turn", "role", "digest")


def _runs(rows: DataFrame) -> DataFrame:
    """conv_id, pid, rows: the runs, with each different row's place, turn, role, digest, code and number of copies in order."""
    inner = F.rtrim("text", F.lit(SPACE))
    light = rows.select("conv_id", "turn", "role", "digest", (F.length(inner) == 0).alias("blank"), (~F.substring(inner, -1, 1).isin(*ENDS)).alias("cut"))
    light = light.groupBy(*_KEY, "blank", "cut").agg(F.count(F.lit(1)).alias("copies"))
    first = light.groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"))
    first = first.select(F.col("conv_id").alias("c"), F.when(~F.col("none"), F.col("least")).alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), F.lit(True).alias("first"))
    on = light["conv_id"].eqNullSafe(first["c"]) & light["turn"].eqNullSafe(first["t"]) & (light["role"] == first["r"]) & (light["digest"] == first["d"])
    light = light.join(first, on, "left").drop("c", "t", "r", "d")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    light = light.select(*_KEY, (4 * role_class(F.col("role")) + fault).alias("code"), "copies")
    light = light.repartitionByRange(shuffle_parts(rows.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    light = stored(light.withColumn("seq", F.monotonically_increasing_id()), "conversation-rows")  # rises along the order; its upper bits are the partition
    runs = light.groupBy("conv_id", F.shiftright("seq", 33).alias("pid")).agg(F.array_sort(F.collect_list(F.struct("seq", "turn", "role", "digest", "code", "copies"))).alias("rows"))
    return stored(runs, "conversation-runs")


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Fields of the array `rows`, a list for each run."""
    runs = batch.column("rows")
    at = runs.offsets.to_pylist()
    flat = [pc.struct_field(runs.flatten(), name).to_pylist() for name in names]
    return [[values[a - at[0] : b - at[0]] for a, b in zip(at, at[1:], strict=False)] for values in flat]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, copies, turns = _columns(batch, "code", "copies", "turn")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"), batch.column("pid"), pa.array([transfer(c, n) for c, n in zip(codes, copies, strict=True)], pa.list_(pa.int64())),
                pa.array([c[0] // 4 for c in codes], pa.int32()), pa.array([c[-1] // 4 for c in codes], pa.int32()), pa.array([t[-1] for t in turns], pa.int64()),
            ],
            ["conv_id", "pid", "costs", "first_role", "last_role", "last_turn"],
        )


def _borders(runs: pa.Table) -> pa.Table:
    """Costs before and after each run of a conversation, and what the run before it ended with."""
    runs = runs.sort_by("pid")
    n = runs.num_rows
    steps = [[c[4 * q : 4 * q + 4] for q in STATES] for c in runs["costs"].to_pylist()]
    before, after = [START], [END]
    for m in steps[:-1]:
        before.append([min(FAR, *(before[-1][q] + m[q][to] for q in STATES)) for to in STATES])
    for m in reversed(steps[1:]):
        after.append([min(FAR, *(m[q][to] + after[-1][to] for to in STATES)) for q in STATES])
    shifted = lambda name: [None, *runs[name].to_pylist()[:-1]]
    return pa.table(
        {"conv_id": runs["conv_id"], "pid": runs["pid"], "before": pa.array(before, pa.list_(pa.int64())), "after": pa.array(after[::-1], pa.list_(pa.int64())), "prior_role": pa.array(shifted("last_role"), pa.int32()), "prior_turn": pa.array(shifted("last_turn"), pa.int64()), "last": pa.array([k == n - 1 for k in range(n)])}
    )


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, copies, turns = _columns(batch, "code", "copies", "turn")
        borders = [batch.column(c).to_pylist() for c in ("before", "after", "prior_role", "prior_turn", "last")]
        at, out = [], []
        for k, (before, after, role, turn, last) in enumerate(zip(*borders, strict=True)):
            cost, paths = walk(codes[k], copies[k], before or START, after or END, last is None or last)
            faults = [0] * 4
            illegal = sum(copies[k]) - len(codes[k])  # a copy beside the first
            for code, n in zip(codes[k], copies[k], strict=True):
                faults[code % 4] += 1
                faults[BLANK if code % 4 == BLANK else DUPLICATE] += n - 1
                illegal += role is not None and (role, code // 4) not in LEGAL
                role = code // 4
            numbered = [t for t in turns[k] if t is not None]
            numbers = (min(numbered), max(numbered), len(set(numbered)) - (numbered[0] == turn)) if numbered else (None, None, 0)
            for entered, left, letters, roles in paths:
                at.append(k)
                out.append((entered, left, cost, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, *numbers, letters, roles))
        names = ["entered", "left", "cost", "blank", "duplicate", "truncated", "illegal", "least", "most", "turns", "letters", "roles"]
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        kept = batch.select(["conv_id", "pid", "rows"]).take(pa.array(at, pa.int64()))
        split = pa.array([borders[-1][k] is not None for k in at], pa.bool_())
        yield pa.RecordBatch.from_arrays([*kept.columns, split, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["conv_id", "pid", "rows", "split", *names])


def _chain(runs: pa.Table) -> pa.Table:
    """Which of a run's walks the conversation takes: each run is entered by the state in which the one before was left."""
    state, taken = START.index(0), []
    found = {(pid, entered): left for pid, entered, left in zip(*(runs[c].to_pylist() for c in ("pid", "entered", "left")), strict=True)}
    pids = sorted({pid for pid, _ in found})
    for pid in pids:
        taken.append(state)
        state = found[pid, state]
    return pa.table({"conv_id": pa.array([runs["conv_id"][0].as_py()] * len(pids), runs["conv_id"].type), "pid": pa.array(pids, pa.int64()), "entered": pa.array(taken, pa.int32())})


class Repair:
    """The least edits of a table of conversations; ``report`` and ``turns`` are its results."""

    def __init__(self, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        bound_batches(rows.sparkSession)
        space = F.lit(" ")
        rows = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
        self._rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
        runs = _runs(self._rows)
        ident = f"conv_id {runs.schema['conv_id'].dataType.simpleString()}"
        several = runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
        edges = runs.join(several, runs["conv_id"].eqNullSafe(several["c"]), "left_semi")
        edges = edges.mapInArrow(_summaries, f"{ident}, pid long, costs array<long>, first_role int, last_role int, last_turn long")
        borders = edges.groupBy("conv_id").applyInArrow(_borders, f"{ident}, pid long, before array<long>, after array<long>, prior_role int, prior_turn long, last boolean")
        # at most the first and the last run of each partition belong to conversations that cross its edges: two rows a partition
        runs = self._beside(runs, borders, "left", "before", "after", "prior_role", "prior_turn", "last")
        rows_type = runs.schema["rows"].dataType.simpleString()
        counts = "cost long, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long"
        walks = stored(runs.mapInArrow(_walks, f"{ident}, pid long, rows {rows_type}, split boolean, entered int, left int, {counts}, letters array<string>, roles array<array<string>>"), "conversation-walks")
        chain = walks.where("split").select("conv_id", "pid", "entered", "left").groupBy("conv_id").applyInArrow(_chain, f"{ident}, pid long, entered int")
        chosen = self._beside(walks, chain.withColumnRenamed("entered", "taken"), "left", "taken")
        self._walks = chosen.where(~F.col("split") | (F.col("entered") == F.col("taken"))).drop("taken")

    @staticmethod
    def _beside(runs: DataFrame, few: DataFrame, how: str, *names: str) -> DataFrame:
        few = F.broadcast(few.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), *names))
        return runs.join(few, runs["conv_id"].eqNullSafe(few["c"]) & (runs["pid"] == few["p"]), how).drop("c", "p")

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (the edits' letters) of each conversation."""
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
        parts = F.array_sort(F.collect_list(F.struct("pid", F.array_join("letters", "").alias("letters"))))
        per = self._walks.groupBy("conv_id").agg(*sums, F.max("cost").alias("cost"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("turns").alias("turns"), parts.alias("parts"))
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
        return per.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.array_join(F.transform("parts", lambda x: x["letters"]), "").alias("audit"))

    def turns(self) -> DataFrame:
        """conv_id, place, part (rising along the conversation), turn (null: put in), role and text of the repaired conversations."""
        rows = self._walks.select("conv_id", F.explode(F.arrays_zip("rows", "roles")).alias("x"))
        rows = rows.select("conv_id", F.col("x.rows.seq").alias("place"), "x.rows.turn", "x.rows.role", "x.rows.digest", F.posexplode("x.roles").alias("part", "as_role"))
        put = rows.where(F.col("as_role").startswith("+"))
        put = put.select("conv_id", "place", "part", F.lit(None).cast("long").alias("turn"), F.substring("as_role", 2, 99).alias("role"), F.lit("").alias("text"))
        stay = rows.where((F.col("as_role") != "") & ~F.col("as_role").startswith("+"))
        texts = self._rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
        texts = texts.select(*[F.col(c).alias(f"t_{c}") for c in _KEY], "text")
        on = stay["conv_id"].eqNullSafe(texts["t_conv_id"]) & stay["turn"].eqNullSafe(texts["t_turn"]) & (stay["role"] == texts["t_role"]) & (stay["digest"] == texts["t_digest"])
        role = F.when(F.col("as_role") == "=", F.col("role")).otherwise(F.col("as_role"))
        return put.unionByName(stay.join(texts, on).select("conv_id", "place", "part", "turn", role.alias("role"), "text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, the SHA-256 of each conversation's `role:text` lines; a text at a time is held."""
    key, state, kind = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if state is None or conv != key:
                if state is not None:
                    yield done()
                key, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
    if state is not None:
        yield done()


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 of `role:text` of all its turns, joined by line feeds.

    A hash has to read a conversation from its start to its end, so one task streams it, in constant memory.
    """
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select("conv_id", "role", "text")
    return turns.mapInArrow(_hashed, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, sha256 string")
