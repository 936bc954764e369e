"""The stages one after another against plain Python over their own inputs."""

import random
import re

import pytest

from panier.llm import common, pseudonyms, simhash, toxicity

from .test_text_ops import brute_hits
from .test_token_ops import classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w)} if len(w) <= 5 else set(zip(*(w[i:] for i in range(5)), strict=False))


def brute_similar(rows):
    """(id, smallest id reachable) by the exact similarity of five-word shingles of all pairs."""
    sets = [shingles(t) for _, t in rows]

    def linked():
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                same = len(a & b)
                if same >= 0.8 * (len(a) + len(b) - same) - 1e-9:
                    yield i, j

    return classes([d for d, _ in rows], linked())


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.written(stage(spark, kept[-1], SF), f"test-{name}"))
        assert kept[-1].columns == columns
    rows = [{r.doc_id: r for r in x.collect()} for x in kept]
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, common.table(spark, SF, "labels")).collect()}
    assert set(rows[1]) == {d for d in rows[0] if not scores[d]}
    assert set(rows[2]) == {c for _, c in brute_similar([(d, r.text) for d, r in rows[1].items()])}
    hits = brute_hits([(d, r.text) for d, r in rows[2].items()], [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()])
    assert set(rows[3]) == {h[0] for h in hits if not h[5]}
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        assert r.n_chars == len(r.text) and not re.search(r"@mail\d\.example", r.text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    assert {p.doc_id for p in pieces} == set(rows[4])
    assert pseudonyms.KEY


def test_stages_keep_rows_without_ids(spark):
    rows = [(None, "one two three four five six"), (None, "seven eight nine ten eleven"), (None, "one two three four five six"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    out = corpus_pipeline.one_of_near_duplicates(spark, df, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(None, rows[0][1]), (None, rows[1][1]), (1, None)], key=str)
    assert len(corpus_pipeline.drop_contaminated(spark, df, SF).collect()) == 5
    assert corpus_pipeline.pseudonymise(spark, df, SF).columns == df.columns


def test_near_duplicates_are_similar(spark):
    """Against exact Jaccard similarity: pairs a little below 0.8 stay, pairs of 0.8 or more go, whatever their length or repeats."""
    rows = []

    def pair(tag, common_words, extra):
        words = [f"{tag}w{i}" for i in range(common_words)]
        rows.extend([(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words + [f"{tag}x{i}" for i in range(extra)]))])

    for t in range(40):
        pair(f"a{t}", 8, 1)  # 4 and 5 shingles: 0.8
        pair(f"b{t}", 104, 34)  # 100 and 134: 0.746
        pair(f"c{t}", 104, 25)  # 100 and 125: 0.8
    line = " ".join(f"r{i}" for i in range(40))
    rows += [(len(rows), line), (len(rows) + 1, f"{line} {line} {line}")]  # 36 and 40 distinct: 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_duplicates(spark, df, SF).collect()}
    sets = [shingles(t) for _, t in rows]
    for i in range(0, len(rows), 2):
        similar = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8
        assert i in kept and (i + 1 in kept) == (not similar), (i, rows[i][1][:20])


def test_near_duplicates_of_documents(spark):
    """All documents of the smallest table against the exact similarity of all pairs."""
    df = common.table(spark, SF, "documents")
    want = {c for _, c in brute_similar([(r.doc_id, r.text) for r in df.collect()])}
    assert {r.doc_id for r in corpus_pipeline.one_of_near_duplicates(spark, df, SF).collect()} == want


def test_near_duplicates_recall_and_precision(spark):
    """Texts of 6 to 900 words, each with edited copies; every pair of 0.8 or more is found, no other is."""
    rng = random.Random(7)
    rows = []
    for g in range(160):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(int(6 * 1.22 ** (g % 26)))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 60)):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(at, "new"), lambda: copy.insert(at, "more"), lambda: copy.pop(at) if len(copy) > 6 else None])()
            rows.append((len(rows), " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    share = lambda a, b: len(a & b) / len(a | b)
    similar = [(i, j) for i in range(len(rows)) for j in range(i - i % 4, i) if share(sets[i], sets[j]) >= 0.8]
    below = [(i, j) for i in range(len(rows)) for j in range(i - i % 4, i) if 0.6 <= share(sets[i], sets[j]) < 0.8]
    assert len(similar) >= 200 and len(below) >= 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert sorted(of.items()) == sorted(brute_similar(rows))
    assert all(of[i] == of[j] for i, j in similar)


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    extra = "score predicted held_out pii row key th node fp n keep label of d h none id nth kind item _pii_ _key_ _text_".split()
    return df.selectExpr("*", *[f"'{c}{i}' AS {c}" for i, c in enumerate(extra)])


@pytest.mark.parametrize("which", ["rows", "empty"])
def test_stages_keep_columns(spark, which):
    """Further columns whose names the operators use, nulls, copies, a very long text, one without white space, an empty table."""
    mail = "write to a.b@example.com or call +1 (743) 555-3824 now"
    rows = [(1, mail), (2, None), (3, ""), (4, "x" * 300_000), (5, "long words here " * 40_000), (5, "long words here " * 40_000), (None, "no id"), (7, "  ")]
    df = clashing(spark, rows if which == "rows" else [])
    before = sorted(df.collect(), key=str)
    out = {name: sorted(stage(spark, df, SF).collect(), key=str) for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns
    assert out["toxicity"] == before and out["decontamination"] == before
    if which == "rows":
        near = out["near_duplicates"]
        assert sorted(map(str, ((r.doc_id, (r.text or "")[:9]) for r in near))) == sorted(map(str, [(1, "write to "), (2, ""), (4, "x" * 9), (5, "long word"), (None, "no id")]))
        assert all(r in before for r in near)
        for old, new in zip(sorted(before, key=lambda r: str((r.doc_id, r.text))), sorted(out["pseudonyms"], key=lambda r: str((r.doc_id, r.text))), strict=True):
            for c in df.columns:
                assert getattr(new, c) == getattr(old, c) or c in ("text", "n_chars")
            assert new.n_chars == (None if new.text is None else len(new.text)) and (new.text == old.text) == (old.doc_id != 1)
        pieces = corpus_pipeline.pack(spark, df, SF).collect()
        assert len({p.doc_id for p in pieces}) == len({r.doc_id for r in before})
    else:
        assert not any(out.values()) and corpus_pipeline.pack(spark, df, SF).count() == 0
