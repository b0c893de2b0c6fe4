"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only column expressions (no Python on the executors, no shuffle). The text
between the matches of a pattern (``split``) and the matches themselves
(``regexp_extract_all``) give every match's place in code points.

Kinds `email`, `ip`, `card` and `phone` are the base: what passes its test is
always kept, whatever its score. `iban` (as long as its country has them, mod-97; unbroken or in groups of four),
`ssn` (needs a context word on either side) and `secret` (a name such as token,
a sign and a value with a digit) are added where their score reaches `min_score`.

Places are running sums over the matches. As a fold copies what it has gathered
at each step, sums are taken within runs of `CHUNK`, over the runs, and over runs
of runs, so time stays linear in the number of matches.

Defined results: a null or empty text has no spans; repeated rows each get the
same result; any other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's patterns, written so that they can't backtrack over long runs (same leftmost matches).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Added kinds. The countries' account numbers by their length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Country, two digits and as many more characters as the country's numbers have, unbroken or in groups of four."""
    kinds = []
    for length, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        kinds.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return f"(?:{'|'.join(kinds)})"


IBAN_CORE = _iban()
#: Not within a longer run of letters and digits.
IBAN = rf"(?<![A-Za-z0-9_])(?=[A-Z]{{2}}[0-9]{{2}}){IBAN_CORE}(?![A-Za-z0-9_])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SECRET = r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']? ?[:=] ?[\"']?[A-Za-z0-9_./+=-]{16,}"

_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Values that one fold gathers.
CHUNK = 64
#: Context words looked for in the `reach` code points before and after a span, by kind.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|payment|credit",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security",
    "secret": "login|config|env|auth",
}


def let(value: Column, use) -> Column:
    """use(value), the value being computed once: within a lambda, what stands outside would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        digit = F.ascii(F.substr(digits, k, F.lit(1))) - 48
        twice = F.when((n - k) % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    return let(F.replace(iban, F.lit(" ")), _mod97)


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substr(turned, k, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: kind, pattern, cheap test that a text may hold one, confirmation of a match, score of a confirmed match without context.
KINDS = (
    ("email", EMAIL, "@", lambda m: F.lit(True), 0.8),
    ("ip", IP, "", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6),
    ("card", CARD, "", lambda m: F.when(F.length(m) < 14, False).otherwise(let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))), 0.7),
    ("phone", PHONE, "+", lambda m: F.length(_digits(m)).between(10, 15), 0.5),
    ("iban", IBAN, "", mod97, 0.7),
    ("ssn", SSN, "-", lambda m: F.lit(True), 0.3),
    ("secret", SECRET, "", lambda m: m.rlike("[0-9]"), 0.6),
)
BASE = 4
#: What a text must hold for a kind to be looked for, where no single sign tells.
POSSIBLE = {"ip": r"[0-9]\.[0-9]", "card": "[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[:=] ?[\"']?[A-Za-z0-9_./+=-]{16}"}


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<g, m>>: what stands before each match, and the match; the last has the text's rest and no match."""
    return F.arrays_zip(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def _fold_sums(sizes: Column) -> Column:
    """Of each value the sum of those before it, by one fold."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def sums_before(sizes: Column, levels: int = 3) -> Column:
    """Of each value of an array<int> the sum of those before it."""
    if not levels:
        return _fold_sums(sizes)

    def runs(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda k: F.slice(values, k, F.lit(CHUNK)))

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x))
        both = F.arrays_zip(parts.alias("part"), sums_before(totals, levels - 1).alias("at"))
        return F.flatten(F.transform(both, lambda z: F.transform(_fold_sums(z["part"]), lambda x: x + z["at"])))

    return let(sizes, lambda values: let(runs(values), summed))


def placed(cut: Column, test) -> Column:
    """array<struct<k, start, end>> of the matches that pass the test: number, place in code points, end exclusive."""
    sized = F.transform(cut, lambda x, k: F.struct(k.alias("k"), F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("n"), (x["m"].isNotNull() & test(x["m"])).alias("ok")))

    def spans(rows: Column) -> Column:
        zipped = F.arrays_zip(rows.alias("x"), sums_before(F.transform(rows, lambda x: x["gap"] + x["n"])).alias("at"))
        found = F.filter(zipped, lambda z: z["x"]["ok"])
        return F.transform(found, lambda z: F.struct(z["x"]["k"].alias("k"), (z["at"] + z["x"]["gap"]).alias("start"), (z["at"] + z["x"]["gap"] + z["x"]["n"]).alias("end")))

    return let(sized, spans)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of every match, in code points, end exclusive."""
    return let(pieces(text, pattern), lambda cut: F.transform(placed(cut, lambda m: F.lit(True)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(cut, x["k"])["m"].alias("m"))))


def _around(cut: Column, k: Column, reach: int) -> Column:
    """Up to `reach` code points on each side of match k, from the pieces nearest to it (so no text is counted through), with a space between."""
    side = lambda n, name: F.coalesce(F.get(cut, k + n)[name], F.lit(""))
    near = [F.get(F.transform(F.array(k - n), lambda at: F.when(at >= 0, F.concat(F.get(cut, at)["g"], F.get(cut, at)["m"]))), 0) for n in (4, 3, 2, 1)]
    before = F.concat(*[F.coalesce(x, F.lit("")) for x in near], side(0, "g"))
    after = F.concat(*[side(n, name) for n in (1, 2, 3, 4) for name in ("g", "m")])
    return F.concat(F.right(before, F.lit(reach)), F.lit(" "), F.left(after, F.lit(reach)))


def _of_kind(text: Column, rank: int, reach: int, min_score: float) -> Column:
    kind, pattern, sign, test, base = KINDS[rank]
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")

    def spans(cut: Column) -> Column:
        def full(x: Column) -> Column:
            score = F.lit(base) + F.when(F.lower(_around(cut, x["k"], reach)).rlike(CONTEXT[kind]), 0.2).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.round(score, 2).alias("score"))

        found = F.transform(placed(cut, test), full)
        return F.filter(found, lambda x: x["score"] >= min_score) if rank >= BASE else found

    possible = text.contains(sign) if sign else text.rlike(POSSIBLE[kind])
    return F.when(possible, let(pieces(text, pattern), spans)).otherwise(none)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 40, min_score: float = 0.5) -> DataFrame:
    """doc_id, text and spans: array<struct<start, rank, end, kind, score>>, by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return docs.withColumn("spans", F.array_sort(F.concat(*[_of_kind(F.col("text"), k, reach, min_score) for k in range(len(KINDS))])))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and text with each span replaced by [KIND]; of overlapping spans, the first stays."""
    found = find(docs, id_col, text_col, **options)
    whole = F.col("text")

    def chunk(acc: Column, part: Column) -> Column:
        """Spans of a chunk are cut out of the piece of text that they lie in, so that no span is counted up to from the text's start."""
        end = F.greatest(acc["at"], F.array_max(F.transform(part, lambda x: x["end"])))

        def within(piece: Column) -> Column:
            def add(state: Column, x: Column) -> Column:
                gap = F.substr(piece, state["at"] - acc["at"] + 1, x["start"] - state["at"])
                new = F.struct(x["end"].alias("at"), F.concat(state["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
                return F.when(x["start"] >= state["at"], new).otherwise(state)

            return F.aggregate(part, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), add)

        done = let(F.substr(whole, acc["at"] + 1, end - acc["at"]), within)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out")))

    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("spans"), F.lit(1)), F.lit(CHUNK)), lambda k: F.slice("spans", k, F.lit(CHUNK)))
    text = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), chunk, lambda acc: F.concat(acc["out"], F.substr(whole, acc["at"] + 1)))
    return found.select("doc_id", F.when(F.size("spans") > 0, text).otherwise(whole).alias("text"))
