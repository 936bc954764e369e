"""Toxicity scores of deobfuscated text.

A character trigram model is counted over all documents.  With it each text is restored (see deobfuscation) and cut into words.
Evidence is the words and their beginnings of four to six letters, which catch inflected forms.  The classifier is fitted on a
bounded sample of the labelled rows outside the held-out third: the TRAIN_ROWS of them with the smallest hash.  A feature's weight
is a lower bound of the share of toxic texts among those that have it.  How strong and how dense the evidence is makes six numbers
a text, which a logistic regression joins.  Its coefficients come from one half of the sample with weights from the other half.

Edge cases: a null or empty text has no words and gets the score of no evidence; repeated rows get the same score; a label that is
null or whose document is missing teaches nothing; without labels every score is that of no evidence; equal rows of ``labels`` count
once, and of documents of one doc_id one text teaches; a text of any length is read whole, and a word of any length is one; letters of
any script are letters; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, deobfuscation

TRAIN_ROWS = 12_000
THRESHOLD = 0.7
NO_EVIDENCE = 0.02
INNER = 5
WORD = re.compile(r"[^\W\d_]+")


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts; the table is at most 64 cubed, whatever the input."""

    def run(batches):
        table, total = deobfuscation.class_table(), np.zeros(deobfuscation.SIZE, np.int64)
        for b in batches:
            total += deobfuscation.trigram_counts([t or "" for t in b.column(0).to_pylist()], table)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "n"])
        common.release()

    out = np.zeros(deobfuscation.SIZE, np.int64)
    for k, n in docs.select(text_col).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def words(text: str, model: deobfuscation.Model) -> tuple[Counter, list[str]]:
    """The words of the text as it stands and of its disguised spans as restored, with counts; and the letters of each span of lone
    letters, in which nothing tells where a word ends."""
    plain = text.lower()
    out, joined = Counter(WORD.findall(plain)), []
    if deobfuscation.suspicious(plain):
        for m in deobfuscation.SPAN.finditer(plain):
            found = WORD.findall(model.decode(m.group()))
            out.update(found)
            if m["spaced"]:
                joined.append("".join(found))
    return out, joined


def _beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]


class Weights:
    """Each word's strongest feature; words without any are remembered, up to a number, as they come again and again."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        self.weights, self.most = weights, most
        self.longest = max((len(f) for f in weights), default=0)
        self.none: set[str] = set()

    def of(self, found: Counter) -> list[tuple[str, float]]:
        if len(self.none) > self.most:
            self.none.clear()
        out, get = [], self.weights.get
        for w in found.keys() - self.none:
            p = max(get(w, 0.0), get(w[:4] + "*", 0.0), get(w[:5] + "*", 0.0), get(w[:6] + "*", 0.0))
            if p:
                out.append((w, p))
            else:
                self.none.add(w)
        return out

    def within(self, letters: str) -> list[str]:
        """Feature words (whole ones, of INNER letters or more) anywhere in a run of letters."""
        get = self.weights
        return [w for i in range(len(letters)) for n in range(INNER, min(self.longest, len(letters) - i) + 1) if (w := letters[i : i + n]) in get]


def evidence(text: str | None, model: deobfuscation.Model, weights: Weights) -> list[float]:
    """Strongest and second word, number and density of words of some weight, sum and density of weights."""
    found, joined = words(text or "", model)
    size = found.total()
    for letters in joined:
        found.update(w for w in weights.within(letters) if w not in found)
    strong = sorted(weights.of(found))
    hits = sum(found[w] for w, _ in strong)
    total = sum(found[w] * p for w, p in strong)
    best = sorted([0.0, 0.0, *(p for _, p in strong)])[-2:]
    return [best[1], best[0], np.log1p(hits), 10 * hits / (size + 10), np.log1p(total), 10 * total / (size + 10)]


def _weights(texts: DataFrame, counts: np.ndarray) -> dict[str, float]:
    def run(batches):
        model, toxic, clean = deobfuscation.Model(counts), Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                found, _ = words(text or "", model)
                (toxic if label else clean).update({x for w in found for x in (w, *_beginnings(w))})
        for tally, t in ((toxic, True), (clean, False)):
            n, none = pa.array(list(tally.values()), pa.int64()), pa.array([0] * len(tally), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), n if t else none, none if t else n], names=["f", "t", "c"])

    z2 = 2.25  # square of the bound's z
    n, share = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    bound = (share + z2 / (2 * n) - F.sqrt(z2 * share * (1 - share) / n + z2 * z2 / (4 * n * n))) / (1 + z2 / n)  # Wilson
    found = texts.select("text", "label").mapInArrow(run, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 4")
    # A feature stands in four toxic texts of the sample at least, so there are no more than a quarter of its texts' words and beginnings.
    return {r.f: r.p for r in found.withColumn("p", bound).where("p >= 0.3").select("f", "p").collect()}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps on the ridge-penalised likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    keep = ridge * np.diag([*[1.0] * (x.shape[1] - 1), 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Feature weights and coefficients from at most ``rows`` labelled documents; ``labels`` (doc_id, label)."""
    chosen = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    # At most `rows` short rows: a proven bound.  Of documents of one id one text teaches, so texts are no more either.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = texts.select("text", F.col("label").cast("int").alias("label"), (F.crc32(F.col("doc_id").cast("string")) % 2).alias("half"))
    texts = common.written(texts, "labelled")
    half = _weights(texts.where("half = 0"), counts)

    def run(batches):
        model, own = deobfuscation.Model(counts), Weights(half)
        for b in batches:
            got = [evidence(t, model, own) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column("label")], names=["x", "label"])

    fitted = texts.where("half = 1").select("text", "label").mapInArrow(run, "x array<double>, label int").collect()  # at most `rows` rows of six numbers
    y = np.array([r.label for r in fitted], float)
    if len(set(y.tolist())) < 2:
        return {}, np.array([0.0] * 6 + [np.log(NO_EVIDENCE)])
    x = np.array([r.x for r in fitted])
    order = np.lexsort(x.T)
    return _weights(texts, counts), _logistic(x[order], y[order])


def scores(docs: DataFrame, counts: np.ndarray, weights: dict[str, float], coef: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (none of them ``score``) and score, from ``text``."""
    kept = docs.select(*keep, F.struct("text").alias("of"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        model, own = deobfuscation.Model(counts), Weights(weights)
        for b in batches:
            x = np.array([evidence(t, model, own) for t in b.column(len(keep)).field(0).to_pylist()]).reshape(-1, len(coef) - 1)
            got = 1 / (1 + np.exp(-np.clip((x * coef[:-1]).sum(1) + coef[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(got, pa.float64())], names=[*keep, "score"])
        del model, own
        common.release()

    return kept.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document ``keep`` and score.  Rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 3 is 1 are never read from."""
    common.tune(docs.sparkSession)
    counts = character_model(docs)
    weights, coef = train(docs, labels.where(common.crc_mod("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label")), counts)
    return scores(docs, counts, weights, coef, keep)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document doc_id, held_out, score and predicted."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
