"""Packing by non-negative least squares over shallow length combinations.

A document of over 4096 ids gives full windows and a remainder.  The histogram of remainders (at most 4095 lengths, whatever the
input) goes to the driver, which enumerates combinations of two to four lengths that fill a window exactly, solves
``min |A x - h|, x >= 0`` for the repeat counts, rounds them down and adds what the histogram still allows.  What is left, in
descending length, is packed greedily: laid end to end and cut at window ends, so that only the last window has padding.

A document finds its place by its rank among the remainders of its length.  Ranks are local counters plus prefix sums by
(part, length), so that a length which a third of all documents share never meets in one task.

Edge cases: a null text is an empty one and has the end id only; repeated rows and rows of null or equal doc_id are packed once each;
documents of equal length are in order of part and place in it, which settles ties; a text of any length is as many full windows as it
takes and a remainder; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_store import part_name, write_store

WINDOW = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(hist: np.ndarray, window: int, heads3: int = 96, heads4: int = 24) -> list[tuple[int, ...]]:
    """Combinations of lengths that sum to the window: all pairs, triples of two of the ``heads3`` commonest lengths and fours of three of
    the ``heads4`` commonest with any that completes them.  The bounds keep the enumeration shallow; they drop no document, as what no
    combination takes is packed greedily."""
    there = hist > 0
    lengths = np.flatnonzero(there)
    out = {(int(window - a), int(a)) for a in lengths if a <= window - a and there[window - a]}
    out |= {(window // k,) * k for k in (3, 4) if window % k == 0 and hist[window // k] >= k}
    frequent = [int(x) for x in lengths[np.argsort(-hist[lengths], kind="stable")]]
    for i, a in enumerate(frequent[:heads3]):
        for b in frequent[i:heads3]:
            if 0 < (c := window - a - b) < window and there[c]:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    for i, a in enumerate(top := frequent[:heads4]):
        for j, b in enumerate(top[i:], i):
            for c in top[j:]:
                if 0 < (d := window - a - b - c) < window and there[d]:
                    out.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(out)


def solve(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts by accelerated projected gradient on the non-negative least squares problem."""
    width = max(map(len, patterns))
    cells = np.zeros((len(patterns), width), np.int64)
    for i, p in enumerate(patterns):
        cells[i, : len(p)] = p  # length 0 is a dummy row of A
    h = hist.astype(float)
    use = cells > 0
    degree = np.bincount(cells[use], minlength=len(h)).astype(float)
    step = 1 / np.where(use, degree[cells], 0).sum(1).max()  # 1 / (largest row sum of |A'A|) bounds the curvature
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        made = np.bincount(cells.ravel(), weights=np.repeat(y, width), minlength=len(h))
        rest = h - made
        rest[0] = 0
        new = np.maximum(0, y + step * rest[cells].sum(1))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[pd.DataFrame, int, int]:
    """Slots (len, lo, hi, seq, offset): the document of rank k in lo..hi-1 goes to sequence seq + (k - lo) at that offset; for the
    rest (offset -1) seq is the stream position of rank lo.  Also the number of combined sequences and the length of the stream."""
    left = hist.astype(np.int64).copy()
    patterns = combinations(hist, window)
    slots: list[tuple[int, int, int, int, int]] = []
    used = np.zeros_like(left)
    sequences = 0
    if patterns:
        x = solve(patterns, hist)
        order = np.argsort(-x, kind="stable")
        counts = np.zeros(len(patterns), np.int64)
        for whole in (True, False):
            for i in order:
                need: dict[int, int] = {}
                for n in patterns[i]:
                    need[n] = need.get(n, 0) + 1
                r = min(left[n] // m for n, m in need.items())
                if whole:
                    r = min(r, int(x[i]))
                if r > 0:
                    counts[i] += r
                    for n, m in need.items():
                        left[n] -= r * m
        for i in np.flatnonzero(counts):
            r, at = int(counts[i]), 0
            for n in patterns[i]:
                slots.append((n, int(used[n]), int(used[n]) + r, sequences, at))
                used[n] += r
                at += n
            sequences += r
    stream = 0
    for n in np.flatnonzero(left)[::-1]:
        slots.append((int(n), int(used[n]), int(used[n] + left[n]), stream, -1))
        stream += int(n) * int(left[n])
    return pd.DataFrame(slots, columns=["len", "lo", "hi", "seq", "at"]), sequences, stream


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; each id of each document lies in exactly one."""
    spark = docs.sparkSession
    store = write_store(docs, tokenizer, end_id, ordered=False, id_col=id_col, text_col=text_col)
    root, dtype = store.root, store.dtype
    # A window over (part, length) ranks the documents; its groups are no larger than a part's documents.
    rem = F.col("n_tokens") % window
    meta = store.meta.withColumns({"rem": rem, "windows": F.floor(F.col("n_tokens") / window)})
    meta = meta.repartition("part")
    by_part = Window.partitionBy("part").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    by_rem = Window.partitionBy("part", "rem").orderBy("idx")
    ranked = common.written(meta.withColumns({"before": F.coalesce(F.sum("windows").over(by_part), F.lit(0)), "rank": F.row_number().over(by_rem).cast("long") - 1}).drop("idx"), "ranked")
    cells = ranked.groupBy("part", "rem").agg(F.count("*").alias("n"))
    hist = np.zeros(window, np.int64)
    for n, c in cells.groupBy("rem").agg(F.sum("n")).collect():  # at most `window` rows
        hist[n] = c
    hist[0] = 0
    slots, sequences, stream = plan(hist, window)
    # Bases of the full windows: prefix sums over a row per part.
    full = ranked.groupBy("part").agg(F.sum("windows").alias("w")).select("part", (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("full"))
    first_full = sequences + -(-stream // window)
    bases = cells.withColumn("base", F.sum("n").over(Window.partitionBy("rem").orderBy("part")) - F.col("n")).select("part", "rem", "base")
    placed = ranked.join(bases.repartition("part"), ["part", "rem"]).join(full, "part").withColumn("k", F.col("base") + F.col("rank"))
    if len(slots) == 0:
        slots = pd.DataFrame([(-1, 0, 0, 0, 0)], columns=slots.columns)
    # At most a few slots for each combination enumerated and one for each length: bounded by the window, not by the documents.
    table = F.broadcast(spark.createDataFrame(slots, "len long, lo long, hi long, seq long, at long"))
    placed = placed.join(table, (F.col("rem") == F.col("len")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")), "left")
    piece = lambda start, length, seq, at: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), seq.cast("long").alias("sequence_id"), at.cast("long").alias("offset"))
    zero, w = F.lit(0), F.lit(window)
    done = F.col("windows") * window
    fulls = F.when(F.col("windows") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1), lambda i: piece(i * window, w, F.lit(first_full) + F.col("full") + F.col("before") + i, zero)))
    at = F.col("seq") + (F.col("k") - F.col("lo")) * F.col("rem")  # in the stream
    head = F.least(F.col("rem"), w - at % window)
    row = F.lit(sequences) + F.floor(at / window)
    rest = (
        F.when(F.col("rem") == 0, F.array())
        .when(F.col("at") >= 0, F.array(piece(done, F.col("rem"), F.col("seq") + F.col("k") - F.col("lo"), F.col("at"))))
        .when(head == F.col("rem"), F.array(piece(done, F.col("rem"), row, at % window)))
        .otherwise(F.array(piece(done, head, row, at % window), piece(done + head, F.col("rem") - head, row + 1, zero)))
    )
    kind = "array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"
    pieces = placed.select("doc_id", "part", "pos", F.col("n_tokens").alias("doc_tokens"), F.explode(F.concat(F.coalesce(fulls.cast(kind), F.array().cast(kind)), rest.cast(kind))).alias("p")).select("doc_id", "part", "pos", "doc_tokens", "p.*")

    def read(batches):
        ids = common.Maps(dtype)
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("part", "pos", "start", "length")}
            crcs = [common.crc32(np.asarray(ids[f"{root}/{part_name(part)}.bin"][pos + start : pos + start + n], "<u4").tobytes()) for part, pos, start, n in zip(*c.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("length"), pa.array(crcs, pa.int64()), *(b.column(n) for n in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.sortWithinPartitions("part", "pos").mapInArrow(read, PIECES)
