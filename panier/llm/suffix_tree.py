"""Language-model scores by a probabilistic suffix tree over the characters of running texts.

Training counts every character of the training texts by occurrence.  The tree's contexts are the last up to ORDER characters before it,
across words; its symbols are the 62 commonest characters, an escape for all others, and the boundary that ends each word and
precedes each text.  A context is kept if it has MIN_COUNT occurrences and its next-symbol distribution diverges from that of its longest
kept suffix by enough bits (count times Kullback-Leibler divergence); its distribution is smoothed with that suffix's.  A text is words
followed by one end token: each token is the end or a word by their shares in training, and a word has the probability of its characters
and its boundary, each from the longest kept suffix.  open_score is that of every token, seen or not.  base_score has one outcome for all
words outside the vocabulary, so no probability of spelt words compares with it: score is open_score with those words as one class of
Good and Turing's probability, the share of training words seen once.

Contexts are counted and tested in groups of equal last two characters, so neither the driver nor a task holds all of them.  Those kept
are written as sorted shared files, which tasks map: the tree grows with the corpus.  Of the base score, HOT, the number of commonest
words that every task holds, is bounded; all other words reach theirs by a join.

Edge cases: a null or empty text has the end token only; a text or word of any length is scored whole; repeated rows get the same scores each; a null doc_id counts as the empty
text for the split; an empty table gives no rows; without training texts every count is 0 and the tree is uniform.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 5
SYMBOLS = 64  # 0: boundary, 1 to 62: characters, 63: any other
ESCAPE = math.log10(0x110000)
MIN_COUNT, MIN_GAIN, SMOOTH = 4, 12.0, 4.0
STRIP = 4096  # contexts at a time when the tree is built
HOT = 50_000
DEAD = 2.0**-60
BACKOFF = SYMBOLS  # in the place of a next symbol: what a kept context leaves to its suffix
MEMO = 2_000_000  # grams whose scores a task remembers


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c, over ``docs`` (text)."""

    def run(batches):
        tally: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "c"])
            tally.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                tally.update(words_of(text))
            if len(tally) > 400_000:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Alphabet:
    def __init__(self, commonest: list[int]):
        self.code = np.full(0x110000, SYMBOLS - 1, np.int64)
        self.code[commonest] = np.arange(1, len(commonest) + 1)
        self.code[32] = 0

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol to predict: its text's index, and the ORDER symbols before it, the nearest lowest, with itself below them."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(w) for w in texts], np.int64)
        # ORDER boundaries before each text and one after it.
        ends = np.cumsum(sizes + ORDER + 1)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        place = np.arange(len(flat)) - np.repeat(ends - sizes - ORDER - 1, sizes + ORDER + 1)
        body = place >= ORDER
        real = body.copy()
        real[ends - 1] = False
        flat[real] = self.code[points]
        gram = flat.copy()
        for k in range(1, ORDER + 1):
            gram[k:] |= flat[:-k] << (6 * k)
        return np.repeat(np.arange(len(texts)), sizes + 1), gram[body]


def running(text: str | bytes | None) -> str:
    """The words of a text, lower case, with one space between."""
    return b" ".join(words_of(text) if not isinstance(text, bytes) else text.lower().split()).decode("utf-8", "surrogatepass")


def gram_counts(texts: DataFrame, alphabet: list[int]) -> DataFrame:
    """gram (ORDER symbols and the next) and n, over all characters of the first column."""

    def run(batches):
        code = Alphabet(alphabet)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            return summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

        for b in batches:
            u, n = np.unique(code.grams([t for t in map(running, b.column(0).to_pylist()) if t])[1], return_counts=True)
            held.append((u, n))
            size += len(u)
            if size > 4_000_000:
                held[:] = [merged()]
                size = 0
        if held:
            u, n = merged()
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(n[i : i + 100_000].astype(np.int64))], names=["gram", "n"])

    return texts.select(texts.columns[0]).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at)


def levels(grams: DataFrame, most: int) -> DataFrame:
    """key (length, context, next) and n for the contexts of up to ``most`` symbols."""
    each = F.explode(F.array(*[F.col("gram").bitwiseAND(F.lit((1 << 6 * (k + 1)) - 1)) + F.lit(k << 42) for k in range(most + 1)]))
    return grams.select(each.alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))


def context_counts(texts: DataFrame, alphabet: list[int]) -> DataFrame:
    """key (length, context, next) and n over all characters of the first column, by occurrence."""
    return levels(gram_counts(texts, alphabet), ORDER)


class Tree:
    """Kept contexts of each length, sorted, with a row of next-symbol probabilities each; ``top``: the tree of the shorter ones."""

    def __init__(self, alphabet: list[int], keys: np.ndarray, counts: np.ndarray, top: Tree | None = None, most: int = ORDER):
        self.alphabet = alphabet
        length, ctx, nxt = keys >> 42, (keys >> 6) & ((1 << 36) - 1), keys & 63
        self.contexts: list[np.ndarray] = list(top.contexts) if top else []
        self.rows: list[np.ndarray] = list(top.rows) if top else []
        entries = [(np.empty(0, np.int64), np.empty(0, np.float32))]
        for k in range(len(self.contexts), most + 1):
            at = length == k
            own, where = np.unique(ctx[at], return_inverse=True)
            if k == 0:
                n = np.bincount(nxt[at], weights=counts[at], minlength=SYMBOLS)
                self.contexts.append(np.zeros(1, np.int64))
                self.rows.append(((n + 1) / (n.sum() + SYMBOLS)).astype(np.float32)[None])
                continue
            order = np.argsort(where, kind="stable")
            where, symbol, number = where[order], nxt[at][order], counts[at][order]
            kept, rows = [np.empty(0, np.int64)], [np.empty((0, SYMBOLS), np.float32)]
            for lo in range(0, len(own), STRIP):
                some = own[lo : lo + STRIP]
                a, b = np.searchsorted(where, (lo, lo + len(some)))
                table = np.zeros((len(some), SYMBOLS))
                np.add.at(table, (where[a:b] - lo, symbol[a:b]), number[a:b])
                parent = self._longest(some, k - 1)
                n = table.sum(1)[:, None]
                raw = table / n
                gain = (n * np.where(raw > 0, raw * np.log2(np.maximum(raw, DEAD) / parent), 0)).sum(1)
                keep = (gain >= MIN_GAIN) & (n[:, 0] >= MIN_COUNT)
                kept.append(some[keep])
                new = ((table + SMOOTH * parent) / (n + SMOOTH))[keep]
                rows.append(new.astype(np.float32))
                # Symbols never seen after a context have the suffix's probability times what the context leaves to it.
                x, y = np.nonzero(table[keep])
                base = (np.int64(k) << 43) | (some[keep] << 7)
                entries += [(base[x] | y, np.log10(new[x, y])), (base | BACKOFF, np.log10(SMOOTH / (n[keep, 0] + SMOOTH)))]
            self.contexts.append(np.concatenate(kept))
            self.rows.append(np.concatenate(rows))
        keys, values = (np.concatenate([e[i] for e in entries]) for i in (0, 1))
        order = np.argsort(keys)
        #: Keys (length, context, next or BACKOFF) of this tree's own levels, and log10 probabilities.
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def _longest(self, ctx: np.ndarray, most: int) -> np.ndarray:
        out = np.tile(self.rows[0][0], (len(ctx), 1))
        for k in range(1, most + 1):
            own = self.contexts[k]
            if len(own):
                low = ctx & ((1 << 6 * k) - 1)
                at = np.minimum(np.searchsorted(own, low), len(own) - 1)
                hit = own[at] == low
                out[hit] = self.rows[k][at[hit]]
        return out

    def score(self, words: list[str], code: Alphabet) -> np.ndarray:
        return Prices(self.rows[0][0], [(self.keys, self.values)]).score(words, code)

    def size(self) -> int:
        return sum(map(len, self.contexts))


class Prices:
    """log10 probabilities of grams from sorted tables that follow on one another, of keys and values as a tree has them."""

    def __init__(self, root: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.root = np.log10(root.astype(float)) - ESCAPE * (np.arange(SYMBOLS) == SYMBOLS - 1)
        self.tables = [t for t in tables if len(t[0])]
        self.firsts = np.array([t[0][0] for t in self.tables], np.int64)
        self.known = (np.empty(0, np.int64), np.empty(0))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: whether a table has them, and the values."""
        hit, value = np.zeros(len(keys), bool), np.zeros(len(keys))
        cuts = [*np.searchsorted(keys, self.firsts).tolist(), len(keys)]
        for (own, values), a, b in zip(self.tables, cuts[:-1], cuts[1:], strict=True):
            if a < b:
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                hit[a:b] = own[at] == keys[a:b]
                value[a:b] = values[at]
        return hit, value

    def _of(self, grams: np.ndarray, k: int) -> np.ndarray:
        """For sorted distinct grams of k symbols and the next."""
        if not k:
            return self.root[grams]
        less, back = np.unique(grams & ((1 << 6 * k) - 1), return_inverse=True)
        out = self._of(less, k - 1)[back]
        base = (np.int64(k) << 43) | ((grams >> 6) << 7)
        kept, left = self._find(base | BACKOFF)
        out[kept] += left[kept]
        seen, own = self._find(base | (grams & 63))
        out[seen] = own[seen] - ESCAPE * ((grams[seen] & 63) == SYMBOLS - 1)
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """For sorted distinct grams; those met before are remembered, up to a number."""
        keys, values = self.known
        at = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
        old = keys[at] == grams if len(keys) else np.zeros(len(grams), bool)
        out = np.empty(len(grams))
        out[old] = values[at[old]]
        new = grams[~old]
        out[~old] = priced = self._of(new, ORDER)
        if len(keys) + len(new) > MEMO:
            self.known = (grams, out)
        else:
            where = np.searchsorted(keys, new)
            self.known = (np.insert(keys, where, new), np.insert(values, where, priced))
        return out

    def _symbols(self, grams: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(grams, return_inverse=True)
        return self.of(distinct)[at]

    def score(self, texts: list[str], code: Alphabet) -> np.ndarray:
        """log10 probability of each text's characters and of its last word's end."""
        if not texts:
            return np.zeros(0)
        owner, grams = code.grams(texts)
        return np.bincount(owner, weights=self._symbols(grams), minlength=len(texts))

    def words(self, texts: list[str], code: Alphabet) -> np.ndarray:
        """log10 probability of each word of the texts (as ``running`` has them) with its end, one text after another."""
        if not texts:
            return np.zeros(0)
        _, grams = code.grams(texts)
        ends = np.flatnonzero((grams & 63) == 0) + 1
        return np.add.reduceat(self._symbols(grams), np.concatenate([[0], ends[:-1]]))


def kept_contexts(grams: DataFrame, alphabet: list[int], top: Tree) -> DataFrame:
    """key and value of the kept contexts longer than those of ``top`` (0 and 1), by groups of equal last two symbols."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        g, n = df["gram"].to_numpy(), df["n"].to_numpy()
        each = [summed(g & ((1 << 6 * (k + 1)) - 1), n) for k in range(2, ORDER + 1)]
        keys = np.concatenate([x[0] | (k << 42) for k, x in enumerate(each, 2)])
        tree = Tree(alphabet, keys, np.concatenate([x[1] for x in each]).astype(float), top)
        return pd.DataFrame({"key": tree.keys, "value": tree.values})

    last = F.shiftright("gram", 6).bitwiseAND(F.lit(4095))
    return grams.withColumn("g", last).groupBy("g").applyInPandas(run, "key long, value float")


def store(kept: DataFrame, folder: str) -> list[str]:
    """Writes a table of keys and values as sorted shared files; their names, in order of keys."""

    def run(batches):
        from pyspark import TaskContext

        held = [(b.column("key").to_numpy(), b.column("value").to_numpy()) for b in batches if b.num_rows]
        if held:
            name = f"{folder}/{TaskContext.get().partitionId():06d}"
            for end, i in (("keys", 0), ("values", 1)):
                common.put_file(f"{name}.{end}", *[np.ascontiguousarray(h[i]).tobytes() for h in held])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(held[0][0][0])], pa.int64())], names=["name", "first"])

    kept = common.written(kept, "kept")
    parts = max(1, kept.sparkSession.sparkContext.defaultParallelism)
    dealt = kept.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return [r.name for r in sorted(dealt.mapInArrow(run, "name string, first long").collect(), key=lambda r: r.first)]


def _alphabet(vocab: DataFrame) -> list[int]:
    """The commonest characters of the words of the first column, each counted as often as the column c says, if there is one."""

    def run(batches):
        for b in batches:
            words = [w.decode("utf-8", "surrogatepass") for w in b.column(0).to_pylist()]
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
            u, at = np.unique(points, return_inverse=True)
            n = np.bincount(at, weights=np.repeat(b.column(1).to_numpy(), [len(w) for w in words]), minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(n.astype(np.int64))], names=["p", "n"])

    weighed = vocab.select("word", "c" if "c" in vocab.columns else F.lit(1).cast("long").alias("c"))
    top = weighed.mapInArrow(run, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(SYMBOLS - 2)
    return [r.p for r in top.collect()]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, open_score."""
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("held_out", common.crc_mod("doc_id", 7) == 2)
    train = docs.where(~F.col("held_out"))
    known = common.written(word_counts(train), "words")
    n_words, v, once = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first()
    ends = train.count()
    total, distinct = n_words + ends, v + (1 if ends else 0)
    alphabet = _alphabet(known)
    grams = common.written(gram_counts(train.select("text"), alphabet), "grams")
    # At most SYMBOLS + SYMBOLS**2 rows.
    rows = levels(grams, 1).orderBy("key").toPandas()
    top = Tree(alphabet, rows["key"].to_numpy(np.int64), rows["n"].to_numpy(float), most=1)
    files = store(kept_contexts(grams, alphabet, top), common.scratch(spark, "tree"))
    norm = total + distinct + 1
    log_end = math.log10(max(ends, 0.5) / max(total, 1)) if total else math.log10(0.5)
    log_word = math.log10(max(n_words, 0.5) / max(total, 1)) if total else math.log10(0.5)
    unseen = min(0.9, max(1e-3, once / max(1, n_words)))
    log_seen, log_unseen = log_word + math.log10(1 - unseen), log_word + math.log10(unseen)
    base_new, base_end = math.log10(1 / norm), math.log10((ends + 1) / norm)
    priced = known.select("word", F.log10((F.col("c") + 1) / norm).alias("base"))
    # base falls with c: the commonest HOT words, whatever the corpus.
    hot = priced.orderBy(F.desc("base"), "word").limit(HOT).toPandas()
    hot_words = spark.sparkContext.broadcast(dict(zip(hot["word"].map(bytes), hot["base"].tolist(), strict=True)))
    root, short = top.rows[0][0], (top.keys, top.values)

    def split(batches):
        """For each document a row of what its common words add, and one for each other word."""
        table, code = hot_words.value, Alphabet(alphabet)
        prices = Prices(root, [short, *((common.mapped(f"{f}.keys", np.int64), common.mapped(f"{f}.values", np.float32)) for f in files)])
        for b in batches:
            ids, hashes, words, ns, base, lp, free, kn, tok = ([] for _ in range(9))
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            spelt = prices.words([b" ".join(t).decode("utf-8", "surrogatepass") for t in texts if t], code).tolist()
            at = 0
            for (doc, th), text in zip(zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), strict=True), texts, strict=True):
                size = len(text)
                own = spelt[at : at + size]
                at += size
                rare: dict[bytes, float] = {}
                tally: Counter = Counter()
                x = y = 0.0
                for w, q in zip(text, own, strict=True):
                    if (got := table.get(w)) is not None:
                        x += got
                        y += q
                    else:
                        rare[w] = rare.get(w, 0.0) + q
                        tally[w] += 1
                ids += [doc] * (len(rare) + 1)
                hashes += [th] * (len(rare) + 1)
                # A word has no space; what begins with one is no word and different for each text, so that no task gets them all.
                words += [*rare, b" " + th.to_bytes(8, "little", signed=True)]
                ns += [*tally.values(), 0]
                z = size - tally.total()
                base += [0.0] * len(rare) + [x + base_end]
                lp += [*rare.values(), y + z * log_seen + log_end]
                free += [0.0] * len(rare) + [sum(own) + size * log_word + log_end]
                kn += [0] * len(rare) + [z + (1 if ends else 0)]
                tok += [0] * len(rare) + [size + 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(words, pa.binary()), pa.array(ns, pa.int32()), pa.array(base, pa.float64()), pa.array(lp, pa.float64()), pa.array(free, pa.float64()), pa.array(kn, pa.int64()), pa.array(tok, pa.int64())], names=["doc_id", "th", "word", "n", "base0", "lp0", "open0", "known0", "tokens"])

    # Two rows of one id and different texts stay apart; equal rows have equal results, once for each copy.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    parts = keyed.mapInArrow(split, "doc_id long, th long, word binary, n int, base0 double, lp0 double, open0 double, known0 long, tokens long")
    text, new = F.col("n") == 0, F.col("base").isNull()
    got = (
        parts.join(priced, "word", "left").groupBy("doc_id", "th").agg(
            F.sum(F.col("base0") + F.col("n") * F.coalesce("base", F.lit(base_new))).alias("b"),
            F.sum(F.when(text, F.col("lp0")).when(new, F.col("n") * log_unseen).otherwise(F.col("lp0") + F.col("n") * log_seen)).alias("s"),
            F.sum("open0").alias("o"),
            F.sum(F.col("known0") + F.when(new, 0).otherwise(F.col("n"))).alias("k"),
            F.sum("tokens").alias("t"),
            F.count(F.when(text, 1)).alias("copies"),
        )
    )
    each = lambda c: F.col(c) / F.col("copies")
    out = got.select(
        "doc_id", (common.crc_mod("doc_id", 7) == 2).alias("held_out"), F.expr("t div copies").alias("n_tokens"), F.expr("k div copies").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), each("b").alias("base_score"), each("s").alias("score"), each("o").alias("open_score"), "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
