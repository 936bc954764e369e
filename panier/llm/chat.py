"""Chat formatting with linked tool calls.

Messages hold tool calls or tool results as JSON.  Calls and results are hash-joined by conversation and identifier; items are put in
a topological order (a result after its call, a call after the calls it names in ``after``) that keeps the order of turns wherever it
can; arguments are validated against the tools' schemas; and each item is serialised as canonical JSON (keys sorted, no white space).

The order is a key, (place, depth, turn): place is the largest turn among an item and what it depends on, depth counts dependencies
within one place.  Where no dependency contradicts the turns they are the order.  Otherwise dependencies, without their texts, are put in
order by layers, in tasks that take a bounded number: what waits for nothing is settled, and what is left in the end waits for a cycle.
Small conversations share a task, which settles chains of any depth at once; one of more than ``BLOCK`` dependencies is divided by turns
among tasks that work in rounds, as many as a chain has changes of task.

Edge cases: repeated rows are one item with a count; a result without call is 'orphan', a call without result 'open', a second call of
one identifier 'repeated'; what depends on a cycle is 'cycle' and keeps its turn; calls named in ``after`` that are not there are no
dependencies; bad JSON and null or empty texts are plain messages, texts of any length are kept whole; a null conversation is one of its
own; a null turn comes before all others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}
#: The tool that ``turns_as_calls`` speaks of.
REPLY = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
#: Dependencies that a task puts in order at once (a chain of as many took 120 MB and 0.9 s): a conversation of more is divided.
BLOCK = 1 << 18
ORDER = "item binary, place long, depth int, cyclic boolean"


def items(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text to items: kind (message, call, result), call_id, name, arguments, after, text, copies."""
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    like_json = F.col("text").rlike(r"^\s*\{")
    rows = rows.withColumn("calls", F.when(like_json & (F.col("role") == "assistant"), F.from_json("text", f"tool_calls {CALL}")["tool_calls"]))
    rows = rows.withColumn("result", F.when(like_json & (F.col("role") == "tool"), F.from_json("text", "tool_call_id string, content string")))
    base = ("conv_id", "turn", "role", "copies")
    calls = rows.where("size(calls) > 0").select(*base, "text", F.posexplode("calls").alias("n", "c")).select(*base, "n", F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"), F.lit(None).cast("string").alias("text"))
    kind = F.when(F.col("result.tool_call_id").isNotNull(), "result").otherwise("message")
    none = F.lit(None).cast("string")
    rest = rows.where("calls IS NULL OR size(calls) = 0").select(*base, F.lit(0).alias("n"), kind.alias("kind"), F.col("result.tool_call_id").alias("call_id"), none.alias("name"), none.alias("arguments"), F.lit(None).cast("array<string>").alias("after"), F.when(kind == "result", F.col("result.content")).otherwise(F.col("text")).alias("text"))
    return calls.unionByName(rest)


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Conversations without tools as items, with links, orders and arguments of all sorts, by conversation and turn.

    A user's turn is a call and the assistant's a result: of the turn before, or in every fourth conversation of the turn after.  In the
    others a call names the calls of the two turns before it in ``after``, or of the two turns after it, or those of turns 0 and 2 name
    each other.  Calls are of the tool ``reply``, every seventh of one that is not there; its arguments are a prompt and the turn, of
    which some lack the prompt, have the turn as a text, or one parameter more."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    name = lambda by: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + by).cast("string"))
    user, reply, sort, mix = F.col("role") == "user", F.col("role") == "assistant", F.pmod("conv_id", F.lit(4)), F.col("conv_id") + F.col("turn")
    prompt, turn = F.coalesce("text", F.lit("")).alias("prompt"), F.col("turn")
    arguments = (
        F.when(mix % 5 == 1, F.to_json(F.struct("turn"))).when(mix % 5 == 2, F.to_json(F.struct(prompt, turn.cast("string").alias("turn"))))
        .when(mix % 5 == 3, F.to_json(F.struct(F.lit(1).alias("n"), prompt, "turn"))).otherwise(F.to_json(F.struct(prompt, "turn")))
    )
    after = (
        F.when(sort == 0, F.array(name(-2), name(-1))).when(sort == 1, F.array(name(1), name(2)))
        .when((sort == 2) & (turn == 0), F.array(name(2))).when((sort == 2) & (turn == 2), F.array(name(-2)))
    )
    return rows.select(
        "conv_id", "turn", "role", "copies", F.lit(0).alias("n"), F.when(user, "call").when(reply, "result").otherwise("message").alias("kind"),
        F.when(user, name(0)).when(reply & (sort == 3), name(1)).when(reply, name(-1)).alias("call_id"), F.when(user & (mix % 7 == 6), "search").when(user, "reply").alias("name"),
        F.when(user, arguments).alias("arguments"), F.when(user, after).alias("after"), F.when(~user, F.col("text")).alias("text"),
    )


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, as texts; ``schemas``: tool to parameter to (JSON type, required)."""
    v = F.try_parse_json(arguments)
    found = F.array(F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.lit("unknown tool")))
    bad = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("arguments are no object")))
    for tool, params in schemas.items():
        checks = []
        for p, (kind, required) in params.items():
            x = F.try_variant_get(v, f"$.{p}", "variant")
            missing = F.when(x.isNull(), F.lit(f"{p} is missing") if required else F.lit(None))
            checks.append(missing.when(x.isNotNull() & ~F.schema_of_variant(x).rlike(TYPES[kind]), f"{p} is no {kind}"))
        keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
        extra = F.transform(F.array_sort(F.filter(keys, lambda k: ~k.isin(*params))), lambda k: F.concat(k, F.lit(" is unknown")))
        found = F.when(name == tool, F.coalesce(bad, F.concat(F.array(*checks), F.coalesce(extra, F.array().cast("array<string>"))))).otherwise(found)
    return F.filter(found, lambda x: x.isNotNull())


def _hashed(df: DataFrame) -> DataFrame:
    """The side of a join that has one row a key: its tasks hold it as a hash table."""
    return df.hint("shuffle_hash")


def _layers(whole: bool):
    """Settles what it can of a block's dependencies (parent, child, tc, place, depth), layer by layer, in a time linear in them.

    place and depth are the parent's where it is settled already (depth null: not so).  ``whole``: a block depends on no other, so that
    a parent which is no child has its own turn (in place) as place, what is not settled waits for a cycle, and only items that turns do
    not put in order are returned.  Otherwise all settled ones are."""

    def run(edges):
        import pyarrow as pa

        n, least = len(edges), float("-inf")  # a null turn comes before all others
        ids = pa.concat_arrays([*edges["parent"].chunks, *edges["child"].chunks]).dictionary_encode()
        at = ids.indices.to_pylist()
        turns, places, depths = ([least if x is None else x for x in edges["tc"].to_pylist()], [least if x is None else x for x in edges["place"].to_pylist()], edges["depth"].to_pylist())
        own: list = [None] * len(ids.dictionary)
        for child, turn in zip(at[n:], turns, strict=True):
            own[child] = (turn, 0)
        state, waits, follow = own[:], [0] * len(own), {}
        for parent, child, place, depth in zip(at[:n], at[n:], places, depths, strict=True):
            if depth is None and not (whole and own[parent] is None):
                follow.setdefault(parent, []).append(child)
                waits[child] += 1
            else:
                state[child] = max(state[child], (place, (depth or 0) + 1))
        settled: list[int] = []
        layer = [x for x, s in enumerate(own) if s is not None and not waits[x]]
        while layer:
            settled += layer
            after = []
            for parent in layer:
                place, depth = state[parent]
                for child in follow.pop(parent, ()):
                    state[child] = max(state[child], (place, depth + 1))
                    waits[child] -= 1
                    if not waits[child]:
                        after.append(child)
            layer = after
        found = [(x, *state[x], False) for x in settled if not whole or state[x] != own[x]]
        if whole:
            found += [(x, *own[x], True) for x, w in enumerate(waits) if w]
        which, place, depth, cyclic = zip(*found, strict=True) if found else ((),) * 4
        return pa.table({
            "item": ids.dictionary.take(pa.array(which, pa.int64())), "place": pa.array([None if x == least else x for x in place], pa.int64()),
            "depth": pa.array(depth, pa.int32()), "cyclic": pa.array(cyclic, pa.bool_()),
        })

    return run


def _in_blocks(edges: DataFrame, parts: int) -> DataFrame:
    """As ``_ordered``, of conversations of any size: blocks are ranges of turns.  In each round a block settles all it can, and says so to
    those that wait for it; there are as many rounds as a chain has changes of block, and only blocks with news take part."""
    blocks = common.written(edges.repartitionByRange(parts, "conv", "tc", "child").withColumn("block", F.spark_partition_id()), "blocks")
    children = blocks.select(F.col("child").alias("parent"), F.lit(True).alias("waits")).distinct()
    first = blocks.join(_hashed(children), "parent", "left").withColumns({"place": F.when(F.col("waits").isNull(), F.col("tp")), "depth": F.when(F.col("waits").isNull(), F.lit(0))})
    left = common.written(first.select("block", "parent", "child", "tc", "place", "depth", F.lit(True).alias("news")), "left")
    settled: list[DataFrame] = []
    while True:
        active = left.join(F.broadcast(left.where("news").select("block").distinct()), "block", "left_semi")
        got = common.written(active.select("block", "parent", "child", "tc", "place", "depth").groupBy("block").applyInArrow(_layers(False), ORDER), "got")
        if got.isEmpty():
            break
        settled.append(got)
        known = got.select(F.col("item").alias("parent"), F.col("place").alias("p"), F.col("depth").alias("d"))
        rest = left.join(_hashed(got.select(F.col("item").alias("child"))), "child", "left_anti").join(_hashed(known), "parent", "left")
        news = F.col("d").isNotNull()
        last, left = left, common.written(rest.select("block", "parent", "child", "tc", F.when(news, F.col("p")).otherwise(F.col("place")).alias("place"), F.coalesce("d", "depth").alias("depth"), news.alias("news")), "left")
        common.done(last)
        if len(settled) > 16:
            before, settled = settled, [common.written(reduce(DataFrame.unionByName, settled), "settled")]
            common.done(*before)
    cyclic = left.select(F.col("child").alias("item"), F.col("tc").alias("place"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic")).distinct()
    return reduce(DataFrame.unionByName, [cyclic, *settled])


def _ordered(edges: DataFrame) -> DataFrame | None:
    """item, place, depth, cyclic of the items that turns do not put in order; ``edges`` (conv, parent, child, tp, tc)."""
    spark = edges.sparkSession
    common.tune(spark)
    edges = common.written(edges, "dependencies")
    sizes = edges.groupBy("conv").agg(F.count("*").alias("c"), F.max(F.expr("tc IS NULL OR tp >= tc")).alias("wrong"))
    total, most, wrong = sizes.agg(F.sum("c"), F.max("c"), F.max("wrong")).first()
    if not wrong:
        return None
    large = sizes.where(F.col("c") > BLOCK) if most > BLOCK else None  # no more than one for so many dependencies
    small = edges if large is None else edges.join(F.broadcast(large.select("conv")), "conv", "left_anti")
    n = max(-(-4 * total // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    small = small.select(F.pmod(F.xxhash64("conv"), F.lit(n)).alias("block"), "parent", "child", "tc", F.col("tp").alias("place"), F.lit(None).cast("int").alias("depth"))
    order = small.groupBy("block").applyInArrow(_layers(True), ORDER)
    if large is None:
        return order
    many = edges.join(F.broadcast(large.where("wrong").select("conv")), "conv", "left_semi")
    return order.unionByName(_in_blocks(many, -(-total // BLOCK)))


def linked(rows: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """conv_id, place, depth, turn, n, kind, call_id, status, problems, copies, json."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    # 128 bits of all that tells items apart, nulls in their places.
    same = F.unhex(F.md5(F.to_json(F.struct("conv_id", "turn", "n", "role", "kind", "call_id", "name", "arguments", "text"), {"ignoreNullFields": "false"})))
    rows = common.written(rows.withColumns({"conv": key, "item": same}), "items")
    calls = rows.where("kind = 'call' AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "n", "item")).alias("c")).select("conv", "call_id", F.col("c.item").alias("parent"), F.col("c.turn").alias("tp"))
    calls = common.written(calls, "calls")
    answered = rows.where("kind = 'result'").groupBy("conv", "call_id").agg(F.count("*").alias("results"))
    after = rows.where("kind = 'call'").select("conv", "item", "turn", F.explode("after").alias("call_id"))
    needs = rows.where("kind = 'result'").select("conv", "item", "turn", "call_id").unionByName(after).distinct()
    edges = needs.join(_hashed(calls), ["conv", "call_id"]).select("conv", "parent", F.col("item").alias("child"), "tp", F.col("turn").alias("tc"))
    order = _ordered(edges)
    out = rows.join(_hashed(calls.drop("tp")), ["conv", "call_id"], "left").join(_hashed(answered), ["conv", "call_id"], "left")
    if order is None:
        out = out.withColumns({"place": F.col("turn"), "depth": F.lit(0), "cyclic": F.lit(False)})
    else:
        out = out.join(_hashed(order), "item", "left").withColumns({"place": F.coalesce("place", "turn"), "depth": F.coalesce("depth", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))})
    wrong = F.when(F.col("kind") == "call", problems(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(F.col("cyclic"), "cycle").when((F.col("kind") == "result") & F.col("parent").isNull(), "orphan").when((F.col("kind") == "call") & (F.col("parent") != F.col("item")), "repeated")
        .when(F.size("problems") > 0, "invalid").when((F.col("kind") == "call") & F.col("results").isNull(), "open").otherwise("ok")
    )
    out = out.withColumn("problems", wrong).withColumn("status", status)
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("x"))))
    # Keys in order: arguments, id, name; content, role, tool_call_id.
    q = lambda c: F.to_json(F.try_parse_json(F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)))
    call = F.concat(F.lit('{"role":'), q("role"), F.lit(',"tool_calls":[{"arguments":'), arguments, F.lit(',"id":'), q("call_id"), F.lit(',"name":'), q("name"), F.lit("}]}"))
    result = F.concat(F.lit('{"content":'), q("text"), F.lit(',"role":"tool","tool_call_id":'), q("call_id"), F.lit("}"))
    message = F.concat(F.lit('{"content":'), q("text"), F.lit(',"role":'), q("role"), F.lit("}"))
    return out.select("conv_id", "place", "depth", "turn", "n", "kind", "call_id", "status", F.array_join("problems", "; ").alias("problems"), "copies", F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message).alias("json"))
