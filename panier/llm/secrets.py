"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong findings are assignments, access identifiers and long hexadecimal runs.  A credential often comes in parts: an access
identifier, its secret and an endpoint.  Parts that are too common to report alone (random-looking words, hosts) are weak candidates.
They are linked to the parts near them: each part's scope is the REACH characters to either side, scopes are joined as intervals
within the document, and a weak candidate is reported only where a complementary part stands in its scope: a secret word where there
is an access identifier; an endpoint where there is a secret word with its access identifier, or an assignment.

Positions come from the pieces between matches, so that all work on a text stays in its row, without shuffle.

Edge cases: a null or empty text has no spans; a text of any length is read whole, and its parts are swept in their order, so work grows
with them and not with their pairs; ties of one start are in the order of KINDS; repeated rows have equal results; a null
doc_id is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak: 24 or more characters of base64 with no other such character around.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Weak: an address or a host with a port.
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}\b"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
REACH = 256
CODES = "array<bigint>"
SPAN = "array<struct<start:int,ord:int,end:int>>"


FOLD = 256


def folded(items: Column, zero: Column, step, out: str) -> Column:
    """The arrays (of type ``out``) that ``step`` (state, item to state, array) gives one after another, as one array.

    Items are folded in blocks, so that what has been found is copied once a block and not once an item."""
    empty = F.array().cast(out)
    blocks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")), lambda b: F.slice(items, b * FOLD + 1, F.lit(FOLD)))).otherwise(F.array())

    def one(acc, x):
        state, new = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["out"], new).alias("out"))

    def block(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["s"].alias("s"), empty.alias("out")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    return F.flatten(F.aggregate(blocks, F.struct(zero.alias("s"), F.array().cast(f"array<{out}>").alias("out")), block, lambda acc: acc["out"]))


def spans(text: Column, pattern: str, order: int, keep=None) -> Column:
    """Start and end (code points) of the matches of a pattern that never matches nothing; ``keep`` tells by the matched text."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))

    def add(at, x):
        lo = at + x["gap"]
        hi = lo + F.length(x["m"])
        one = F.array(F.struct(lo.alias("start"), F.lit(order).alias("ord"), hi.alias("end")))
        return hi, one if keep is None else F.when(keep(x["m"]), one).otherwise(_none())

    return folded(steps, F.lit(0), add, SPAN)


def _none() -> Column:
    return F.array().cast(SPAN)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, base (spans of the strong kinds) and linked (reported weak parts), each as sorted structs (start, ord, end)."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    text = F.col("text")
    # A cheap test first: few texts hold what a kind needs.
    if_has = lambda test, then: F.when(test, then).otherwise(_none())
    value_long = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    rows = rows.withColumns(
        {
            "assign": if_has(text.rlike(ASSIGN), spans(text, ASSIGN, 0, value_long)),
            "access": if_has(text.contains("AKIA"), spans(text, ACCESS, 1)),
            "hex": if_has(text.rlike(HEX), spans(text, HEX, 2)),
        }
    )
    # Weak parts matter only beside strong ones of two kinds.
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    rows = rows.withColumn("word", if_has(F.size("access") > 0, spans(text, WORD, 3, mixed)))
    rows = rows.withColumn("host", if_has((F.size("access") > 0) | (F.size("assign") > 0), spans(text, ENDPOINT, 4)))
    return _linked(rows, reach).select("doc_id", "assign", "access", "hex", "secret", "endpoint")


def coded(span: Column) -> Column:
    """Start and end in one number: sets of numbers are hashed, sets of structs would be compared in pairs."""
    return F.shiftleft(span["start"].cast("long"), 31) + span["end"]


def near(parts: Column, others: Column, reach: int) -> Column:
    """The parts (coded) whose scope an interval of ``others`` overlaps that does not overlap the part itself: an interval join by two sweeps.

    One goes up over the ends of the others and the starts of the parts, in one order, and knows the last end before each part; one goes
    down over starts and ends, and knows the next start after it."""

    def sweep(place: str, own: str, sign: int) -> Column:
        end = F.transform(others, lambda o: F.struct((sign * o[place]).alias("key"), F.lit(0).alias("is"), o["start"].alias("start"), o["ord"].alias("ord"), o["end"].alias("end")))
        part = F.transform(parts, lambda p: F.struct((sign * p[own]).alias("key"), F.lit(1).alias("is"), p["start"].alias("start"), p["ord"].alias("ord"), p["end"].alias("end")))

        def step(last, x):
            hit = (x["is"] == 1) & (last > x["key"] - reach)
            return F.when(x["is"] == 0, x["key"]).otherwise(last), F.when(hit, F.array(coded(x))).otherwise(F.array().cast(CODES))

        return folded(F.array_sort(F.concat(end, part)), F.lit(-(1 << 30)), step, CODES)

    return F.when((F.size(parts) > 0) & (F.size(others) > 0), F.array_union(sweep("end", "start", 1), sweep("start", "end", -1))).otherwise(F.array().cast(CODES))


def _linked(rows: DataFrame, reach: int) -> DataFrame:
    """Adds secret and endpoint: weak parts that stand beside what complements them."""
    word, host = F.col("word"), F.col("host")
    beside = F.array_intersect(near(host, F.col("access"), reach), near(host, word, reach))
    parts = lambda codes, order: F.transform(F.array_sort(codes), lambda c: F.struct(F.shiftright(c, 31).cast("int").alias("start"), F.lit(order).alias("ord"), (c % (1 << 31)).cast("int").alias("end")))
    return rows.withColumns({"secret": parts(near(word, F.col("access"), reach), 3), "endpoint": parts(F.array_union(near(host, F.col("assign"), reach), beside), 4)})


def _text(order: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), order + 1)


def joined(spans_: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans_), lambda x: F.concat_ws(":", _text(x["ord"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan(docs, id_col, text_col)
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "secret", "endpoint")).alias("spans"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[3:]],
    )
