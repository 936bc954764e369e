"""Operators 1, 2, 4, 5, 8 and the pipeline against brute force, round trips and held-out labels."""

import zlib
from collections import Counter

import numpy as np
import pytest

from panier.llm import chat, common, components, deobfuscation, packing, simhash, token_store, toxicity
from panier.llm.encoding import Encoder
from panier.llm.queries import tokenizer

from .helpers import TEXTS, docs, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return common.columns(common.table(spark, SF, "documents"), "doc_id", "text")


def ids_of(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    from tokenizers import Tokenizer

    enc, library = Encoder(tokenizer(name), most=40), Tokenizer.from_file(tokenizer(name))
    for t in [x or "" for _, x in TEXTS] + ["it's  x", " a b", "x\n\ny", "a\tb", "<|endoftext|> x", "a <|endoftext|> b", "a<|startoftext|>b c", "<|ENDOFTEXT|> x", "1.2,3 4.", "y" * 100_000, "many words " * 20_000, "a’s b", "x. .y", "İstanbul ΣΑΣ.", "don't. 's", "a\x85b c"]:
        assert np.frombuffer(enc.bytes_of(t), enc.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


@pytest.mark.parametrize("which", ["small", "edge"])
def test_token_files(spark, small, which):
    df = small if which == "small" else docs(spark)
    rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for (d, _), ids in zip(rows, ids_of("byte_bpe_50k.json", [t for _, t in rows]), strict=True):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in token_store.write_store(df, tokenizer("byte_bpe_50k.json"), 2).per_document().collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files_empty(spark):
    assert token_store.write_store(empty(spark), tokenizer("byte_bpe_50k.json"), 2).per_document().count() == 0


@pytest.mark.parametrize("which", ["small", "edge"])
def test_packing(spark, small, which):
    df = small if which == "small" else docs(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = Counter((d, crc(i), len(i)) for (d, _), i in zip(rows, ids_of("word_bpe_49k.json", [t for _, t in rows]), strict=True))
    got = packing.pack(df, tokenizer("word_bpe_49k.json")).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(d for d, _, _ in want.elements())
    assert sum(r.length for r in got) == sum(n * c for (_, _, n), c in want.items())
    whole = Counter((r.doc_id, r.ids_crc32, r.doc_tokens) for r in got if r.length == r.doc_tokens)
    assert all(want[k] >= n for k, n in whole.items())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at
    assert padding < packing.WINDOW
    if which == "small":
        ids = dict(zip([d for d, _ in rows], ids_of("word_bpe_49k.json", [t for _, t in rows]), strict=True))
        assert all(crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got)
    assert packing.pack(empty(spark), tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_plan_uses_each_length_once():
    rng = np.random.default_rng(0)
    hist = np.zeros(4096, np.int64)
    for n in rng.integers(1, 4096, 30000):
        hist[n] += 1
    slots, sequences, stream = packing.plan(hist)
    for n in np.flatnonzero(hist):
        own = slots[slots.len == n].sort_values("lo")
        assert own.lo.iloc[0] == 0 and own.hi.iloc[-1] == hist[n] and (own.lo.to_numpy()[1:] == own.hi.to_numpy()[:-1]).all()
    assert sequences * 4096 + stream == (hist * np.arange(4096)).sum() and sequences * 4096 > 0.5 * (hist * np.arange(4096)).sum()


def classes(ids, linked):
    """(id, smallest id reachable) for rows ``ids`` (some null), by the pairs of row numbers that are linked."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    return [(d, least[find(i)]) for i, d in enumerate(ids)]


def brute_components(rows, k, radius):
    import xxhash

    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    found = classes([d for d, _ in rows], [(i, j) for i, f in enumerate(fps) for j in range(i) if (fps[j] ^ f).bit_count() <= radius])
    return sorted(((d, format(f, "016x"), c) for f, (d, c) in zip(fps, found, strict=True)), key=str)


@pytest.mark.parametrize("which", ["small", "edge"])
def test_simhash(spark, small, which):
    near = [(30 + i, " ".join(f"w{j}" if j != i else "other" for j in range(60))) for i in range(8)]
    df = small if which == "small" else docs(spark, TEXTS + near)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute_components(rows, 3, 3)


def test_simhash_blocks_and_empty(spark, small):
    rows = simhash.fingerprints(small, 3).distinct()
    whole, cut = (components.components(simhash.links(rows, 20, block=b)).collect() for b in (10**6, 16))
    assert sorted((bytes(r.node), bytes(r.root)) for r in whole) == sorted((bytes(r.node), bytes(r.root)) for r in cut)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.similar_documents(empty(spark)).count() == 0


def test_similar_documents_in_blocks(spark, small, monkeypatch):
    """Blocks of a few rows give the components that one block gives."""
    whole = {(r.doc_id, r.component_id) for r in simhash.similar_documents(small).collect()}
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 8)
    monkeypatch.setattr(simhash, "STRIP", 3)
    monkeypatch.setattr(simhash, "SPAN", 5)
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(small).collect()} == whole


def test_candidates_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (40, 4), dtype=np.uint64)
    a, b = (np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 60, base.shape).astype(np.uint64)) for _ in range(4)]) for _ in range(2))
    na, nb = (rng.integers(50, 120, len(a)) for _ in range(2))
    for first, radius in ((3, 6), (4, 8), (47, 80)):
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                d = [int(x ^ y).bit_count() for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True)]
                if sum(d[:2]) <= first and sum(d) <= radius and min(na[i], nb[j]) >= 0.8 * max(na[i], nb[j]) - 1e-9:
                    want.add((i, j))
        got = [(int(x), int(y)) for u, v in simhash._candidates(a, b, na, nb, first, radius, 0.8) for x, y in zip(u, v, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 50)) and got[201] == 200 and 7 in got


def test_deobfuscation():
    table = deobfuscation.class_table()
    model = deobfuscation.Model(deobfuscation.trigram_counts(["you idiot stop", "such a moron", "pathetic loser", "hello there world"] * 50, table))
    for disguised, plain in [("p@thetic", "pathetic"), ("m0r0n", "moron"), ("1d10t", "idiot"), ("l-o-s-e-r", "loser"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("m.o.r.o.n", "moron")]:
        assert model.restore(f"so, {disguised}, b").split(", ")[1] == plain, disguised
        assert deobfuscation.suspicious(disguised)
    for same in ("hello there", "4785380592391139 (743) 555-3824", "see you at 10", ""):
        assert model.restore(same) == same


MODEL_TEXTS = ["you idiot stop", "such a moron", "pathetic loser", "hello there world", "you are a stupid idiot"] * 50


@pytest.fixture(scope="module")
def model():
    return deobfuscation.Model(deobfuscation.trigram_counts(MODEL_TEXTS, deobfuscation.class_table()))


def test_deobfuscation_of_any_length(model):
    """Spans over any length, other separators, other scripts."""
    for disguised, plain in [
        ("p  a  t  h  e  t  i  c  m  o  r  o  n", "pathetic moron"), ("m-o-r-o-n-p-a-t-h-e-t-i-c", "moron pathetic"), ("idi" + "o" * 40 + "t", "idiot"), ("i.d-i o_t", "idiot"), ("i d i o t  y o u", "idiot you"),
        ("1 d 1 0 t", "idiot"), ("м0локо", "мо" + "локо"), ("y o u a r e a s t u p i d i d i o t", "you are a stupid idiot"),
    ]:
        assert model.restore(disguised) == plain, disguised
        assert deobfuscation.suspicious(disguised)
    long = "i d i o t " * 20_000
    assert set(model.restore(long).split()) == {"idiot"} and len(model.restore("x" * 300_000)) <= 3
    assert model.restore("5 - 3 - 1 - 2") == "5 - 3 - 1 - 2"


def test_viterbi_by_brute_force(model):
    """The best of all readings of short lattices."""
    from itertools import product

    log_p = np.array(model.log).reshape(64, 64, 64)
    for span in ("1d10t", "m0r-n", "st@pp", "l.0 s", "ii1", "0б3", "a_!t"):
        parts = deobfuscation.lattice(span)
        best = -np.inf
        scores = {}
        for path in product(*parts):
            a = b = 0
            s, text, ok = 0.0, "", True
            for x, c, cost in path:
                s -= cost
                if c == 0 and b == 0:
                    ok = False
                if c >= 0:
                    s += log_p[a, b, c]
                    a, b = b, c
                text += x
            if ok:
                s += log_p[a, b, 0] if b else 0.0
                scores[text] = max(scores.get(text, -np.inf), s)
                best = max(best, s)
        assert abs(scores[model.viterbi(parts)] - best) < 1e-9


def test_toxicity_sees_words_within_spaced_letters():
    weights = toxicity.Weights({"moron": 0.9, "idio*": 0.8})
    assert weights.within("suchamoronhere") == ["moron"]
    table = deobfuscation.class_table()
    plain = deobfuscation.Model(deobfuscation.trigram_counts(["hello there"], table))
    assert toxicity.evidence("q z m o r o n x k", plain, weights)[0] == 0.9 and toxicity.evidence("hello", plain, weights)[0] == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(common.columns(df, "doc_id", "text"), labels).collect()}
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.8


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark), none).collect()
    assert len(got) == len(TEXTS) and len({r.score for r in got}) == 1 and not any(r.predicted for r in got)
    some = spark.createDataFrame([(0, 1), (1, None), (2, 0), (99, 1), (0, 1)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs(spark), some).collect()) == len(TEXTS)
    assert toxicity.toxicity(empty(spark), none).count() == 0
    # Repeated ids on both sides teach no more than the bound.
    many = spark.createDataFrame([(1, f"text {i}") for i in range(30)], "doc_id long, text string")
    counts = toxicity.character_model(many)
    toxicity.train(many, spark.createDataFrame([(1, 1)] * 20, "doc_id long, label int"), counts, rows=5)


CALLS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":"{\\"y\\":2,\\"x\\":1}"},{"id":"b","name":"add","arguments":"{\\"x\\":\\"q\\"}","after":["a"]}]}'),
    (1, 2, "tool", '{"tool_call_id":"a","content":"3"}'),
    (1, 3, "tool", '{"tool_call_id":"zz","content":"3"}'),
    (2, 0, "tool", '{"tool_call_id":"c","content":"early"}'),
    (2, 1, "assistant", '{"tool_calls":[{"id":"c","name":"nope","arguments":"[]","after":["d"]}]}'),
    (2, 2, "assistant", '{"tool_calls":[{"id":"d","name":"add","arguments":"{\\"x\\":1,\\"y\\":1.5,\\"z\\":0}","after":["d2"]},{"id":"d2","name":"add","arguments":"{\\"x\\":1,\\"y\\":1}"}]}'),
    (3, 0, "assistant", '{"tool_calls":[{"id":"p","name":"add","arguments":"{}","after":["q"]},{"id":"q","name":"add","arguments":"{}","after":["p"]}]}'),
    (None, 0, "user", None),
    (4, 0, "user", "dup"),
    (4, 0, "user", "dup"),
    (4, 1, "assistant", "{bad"),
]
SCHEMA = {"add": {"x": ("integer", True), "y": ("number", True)}}


def test_chat_links_order_and_schemas(spark):
    df = spark.createDataFrame(CALLS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS item", "'k' AS kind")
    rows = sorted(chat.linked(chat.items(df), SCHEMA).collect(), key=lambda r: (r.conv_id or 0, r.place, r.depth, r.turn, r.n))
    status = {(r.conv_id, r.kind, r.call_id): r.status for r in rows}
    assert status[1, "call", "a"] == "ok" and status[1, "call", "b"] == "invalid" and status[1, "result", "zz"] == "orphan"
    assert status[2, "call", "d2"] == "open" and status[3, "call", "p"] == status[3, "call", "q"] == "cycle"
    order = [(r.kind, r.call_id) for r in rows if r.conv_id == 2]
    assert order == [("call", "d2"), ("call", "d"), ("call", "c"), ("result", "c")]
    by = {(r.conv_id, r.kind, r.call_id): r for r in rows}
    assert by[1, "call", "a"].json == '{"role":"assistant","tool_calls":[{"arguments":{"x":1,"y":2},"id":"a","name":"add"}]}'
    assert by[1, "call", "b"].problems == "x is no integer; y is missing" and by[2, "call", "c"].problems == "unknown tool" and by[2, "call", "d"].problems == "z is unknown"
    assert [r.copies for r in rows if r.conv_id == 4] == [2, 1] and len(rows) == 14
    assert chat.linked(chat.items(df.limit(0)), SCHEMA).count() == 0


def test_chat_of_conversations(spark):
    """The derived items reach every status, several depths and every problem, and the JSON is canonical."""
    import json

    df = common.table(spark, "/root/testdata/sf0.01", "conversations")
    got = chat.linked(chat.turns_as_calls(df), chat.REPLY).collect()
    assert len(got) == df.count() and {r.status for r in got} == {"ok", "open", "orphan", "invalid", "cycle"}
    assert len({r.depth for r in got}) > 2 and any(r.place != r.turn for r in got)
    assert {r.problems for r in got} == {"", "unknown tool", "prompt is missing", "turn is no integer", "n is unknown"}
    assert all(json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json for r in got)


def test_chat_orders_random_graphs(spark):
    """Places, depths and cycles of random dependencies against plain Python."""
    import json
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        size = rng.randrange(2, 12)
        turns = [rng.randrange(8) for _ in range(size)]
        after = [[rng.randrange(size) for _ in range(rng.choice([0, 0, 1, 1, 2]))] for _ in range(size)]
        if conv % 3:  # without cycles: by a hidden order that turns know nothing of
            after = [[x for x in xs if x < i] for i, xs in enumerate(after)]
        for i in range(size):
            rows.append((conv, turns[i], "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "add", "arguments": "{}", "after": [f"c{x}" for x in after[i]]}]})))
        up = [{i} for i in range(size)]
        for _ in range(size):
            up = [u | {y for x in u for y in after[x]} for u in up]
        loops = {i for i in range(size) if any(i in up[x] for x in after[i])}
        for i in range(size):
            if up[i] & loops:
                want[conv, f"c{i}"] = (turns[i], 0, True)
                continue

            def state(x):
                return max([(turns[x], 0), *((p, d + 1) for p, d in map(state, after[x]))])

            want[conv, f"c{i}"] = (*state(i), False)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): (r.place, r.depth, r.status == "cycle") for r in chat.linked(chat.items(df), SCHEMA).collect()}
    assert got == want and any(c for *_, c in want.values()) and max(d for _, d, _ in want.values()) > 2


def test_chat_orders_deep_chains(spark):
    """One item out of place moves all that depends on it, however deep."""
    names, turns = "ABCDEF", [10, 1, 2, 3, 4, 5]
    rows = [(1, t, "assistant", f'{{"tool_calls":[{{"id":"{n}","name":"add","arguments":"{{}}"' + (f',"after":["{names[i - 1]}"]' if i else "") + "}]}") for i, (n, t) in enumerate(zip(names, turns, strict=True))]
    got = chat.linked(chat.items(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), SCHEMA).collect()
    assert [r.call_id for r in sorted(got, key=lambda r: (r.place, r.depth, r.turn))] == list(names) and "cycle" not in {r.status for r in got}


def chain(names, turns):
    """Calls of one conversation, each after the one before it."""
    call = '{{"tool_calls":[{{"id":"{}","name":"add","arguments":"{{}}","after":{}}}]}}'
    return [(1, t, "assistant", call.format(x, f'["{names[i - 1]}"]' if i else "[]")) for i, (x, t) in enumerate(zip(names, turns, strict=True))]


def test_chat_orders_long_conversations_at_once(spark, monkeypatch):
    """A chain against the turns takes no more tables, and so no more of the driver, when it has more turns."""
    made, written = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: made.append(name) or written(df, name))
    names = [f"c{i}" for i in range(60)]
    got = chat.linked(chat.items(spark.createDataFrame(chain(names, range(60, 0, -1)), "conv_id long, turn long, role string, text string")), SCHEMA).collect()
    assert {r.call_id: (r.place, r.depth) for r in got} == {x: (60, i) for i, x in enumerate(names)} and "cycle" not in {r.status for r in got}
    assert len(made) < 10


def test_chat_orders_conversations_of_many_blocks(spark, monkeypatch):
    """Conversations divided among tasks have the same order as undivided ones; a null turn comes before all others."""
    import json
    import random

    rng = random.Random(8)
    rows = chain([f"c{i}" for i in range(200)], range(200, 0, -1))  # in some twenty blocks, one after the other
    for conv in range(2, 7):
        for i in range(40):  # with cycles in every second one, and with items that are not divided
            after = [f"c{rng.randrange(i or 1) if conv % 2 else rng.randrange(40)}" for _ in range(rng.choice([0, 1, 1, 2]) if i else 0)]
            call = {"id": f"c{i}", "name": "add", "arguments": "{}", "after": after}
            rows.append((conv, rng.choice([None, *range(9)]), "assistant", json.dumps({"tool_calls": [call]})))
    rows += [(7, 2, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": "{}", "after": ["b"]}]})), (7, 3, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "add", "arguments": "{}"}]}))]
    rows.append((7, None, "tool", json.dumps({"tool_call_id": "b", "content": "x"})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda: sorted(((r.conv_id, r.kind, r.call_id, r.place, r.depth, r.status) for r in chat.linked(chat.items(df), SCHEMA).collect()), key=repr)
    want = key()
    assert {(7, "call", "a", 3, 1, "invalid"), (7, "result", "b", 3, 1, "ok")} <= set(want) and any(x[5] == "cycle" for x in want)
    monkeypatch.setattr(chat, "BLOCK", 10)
    assert key() == want
