"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy exclusive-or and bit counts, tile against tile.

``near_duplicates`` links 64-bit fingerprints within a radius.  Tiles hold fingerprints of equal population counts (of the low and the
high half, two counts to a tile), in blocks of bounded size; two tiles whose counts differ by more than the radius in sum cannot hold a
link and are skipped, and so are, within a tile pair, rows whose counts by 16 bits differ by more.

``similar_documents`` links texts by the Jaccard similarity of their shingles.  Its fingerprints are of distinct shingles, and so wide
and with such a radius that their population counts tell nothing; the population that prunes is that of the shingles: with a similarity
s no link joins sets whose sizes differ by more than a factor s, so tiles are bands of sizes.  The fingerprints give candidates, of
which each is verified from the shingles themselves.

Equal texts are one node, so copies are never compared.  A tile pair gives a spanning forest of its links, not all of them, so that a
group of n near copies costs n rows and not n squared; what is reachable stays the same.

Edge cases: a null, empty or blank text has no shingle and fingerprint zero, and links like any other (Jaccard: with its like only);
fewer words than a shingle are one shingle; a text of any length, with or without spaces, is one row of shingles, counted in strips;
repeated rows get the same result each; rows of null doc_id take part, and a component's id is the smallest that is not null; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Rows of a block of 64-bit fingerprints, which counts prune well.
BLOCK = 131072
#: Wide ones: a block is a SHARE-th of all rows, within these limits, so that up to MOST_BLOCK each row goes to as many tasks whatever the
#: input; a task holds two blocks.
LEAST_BLOCK, MOST_BLOCK, SHARE = 1024, 131072, 16
SEED = 42
STRIP, SPAN = 32, 4096  # rows and columns compared at a time
PAIRS = 1 << 16  # candidates verified at a time
DEVIATIONS = 5  # of a binomial: what lies beyond has a probability of about 1e-6
PARITY = 256  # bits that tell of how many shingles two sets differ at least


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word derived from a hash: the hash itself, then outputs of the SplitMix64 finaliser (published constants)."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, words: int) -> bytes:
    """Big-endian fingerprint of 64 bits a word."""
    return majority(shingle_hashes(text, shingle), words)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, "<u8")
    if len(w) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(x), SEED) for x in zip(*(w[i:] for i in range(shingle)), strict=False)]
    return np.array(hashes, "<u8")


def majority(h: np.ndarray, words: int) -> bytes:
    n = len(h)
    out = np.empty(words, ">u8")
    for k in range(words):
        bits = np.zeros(64, np.int64)
        for i in range(0, n, 4096):
            bits += np.unpackbits(_mixed(h[i : i + 4096], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits((2 * bits > n).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out.tobytes()


def parities(h: np.ndarray) -> bytes:
    """For each of PARITY classes of hashes whether their number is odd: two sets differ in as many shingles as these bits, or more."""
    return np.packbits((np.bincount((h >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (binary)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle, words) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "fp"])

    common.tune(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fp binary")


def _tiles(batches):
    for b in batches:
        fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), ">u8").astype("<u8")
        counts = np.bitwise_count(fp.view("<u4").reshape(-1, 2)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(counts[:, 0] // 2), pa.array(counts[:, 1] // 2)], names=["fp", "x", "y"])


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[int]:
    """Indexes of the links that form a spanning forest."""
    root = list(range(size))
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def _near(fa: np.ndarray, fb: np.ndarray, radius: int):
    """Index pairs of 64-bit fingerprints within the radius, by cells of equal counts by 16 bits: only cells within the radius in sum are compared."""
    qa, qb = (np.bitwise_count(f[:, None].copy().view("<u2")).astype(np.int16) for f in (fa, fb))
    scale = np.array([1, 32, 1024, 32768], np.int64)
    ka, kb = qa @ scale, qb @ scale
    order, rder = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ua, sa = np.unique(ka[order], return_index=True)
    ub, sb = np.unique(kb[rder], return_index=True)
    sa, sb = np.append(sa, len(ka)), np.append(sb, len(kb))
    ca, cb = qa[order][sa[:-1]], qb[rder][sb[:-1]]
    for i in range(len(ua)):
        rows = order[sa[i] : sa[i + 1]]
        near = np.flatnonzero(np.abs(cb - ca[i]).sum(1) <= radius)
        if len(near):
            cols = np.concatenate([rder[sb[j] : sb[j + 1]] for j in near])
            for at in range(0, len(rows), 1024):
                x, y = np.nonzero(np.bitwise_count(fa[rows[at : at + 1024], None] ^ fb[cols][None, :]) <= radius)
                yield rows[at + x], cols[y]


def _compare(radius: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        fp = np.frombuffer(b"".join(df["fp"]), ">u8").astype("<u8")
        side = df["side"].to_numpy()
        ia = np.flatnonzero(side <= 1)
        ib = np.flatnonzero(side >= 1)  # 1: the one block of a tile pair with itself
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(ia) and len(ib):
            for x, y in _near(fp[ia], fp[ib], radius):
                x, y = ia[x], ib[y]
                keep = x < y if side[0] == 1 else x != y
                x, y = x[keep], y[keep]
                f = _forest(x, y, len(df))
                a.append(x[f])
                b.append(y[f])
        a, b = np.concatenate(a), np.concatenate(b)
        f = _forest(a, b, len(df))
        col = df["fp"].to_numpy()
        return pd.DataFrame({"a": col[a[f]], "b": col[b[f]]})

    return run


def _by_tile_pairs(tiled: DataFrame, offsets: list[tuple[int, int]], block: int, by: str, compare) -> DataFrame:
    """``compare`` (rows of one or two blocks with their ``side``, to links a, b) for each pair of blocks whose tiles (x, y) differ by
    one of ``offsets``.  A tile's rows are dealt to its blocks by a hash of ``by``, so a tile that has most rows is many tasks."""
    counted = tiled.groupBy("x", "y").agg(F.count("*").alias("c"))  # as many as tiles: some hundreds, whatever the input
    blocks = counted.select("x", "y", "c", F.greatest(F.ceil(F.col("c") / block), F.lit(1)).cast("int").alias("blocks"))
    numbered = blocks.select("x", "y", (F.col("c") / F.col("blocks")).alias("size"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    pairs = (
        numbered.select("x", "y", "k", "size", F.explode(offs).alias("o"))
        .select("x", "y", "k", "size", (F.col("x") + F.col("o.i")).alias("x2"), (F.col("y") + F.col("o.j")).alias("y2"))
        .join(numbered.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("k").alias("k2"), F.col("size").alias("size2")), ["x2", "y2"])
        .where("(x2, y2) <> (x, y) OR k2 >= k")
    )
    same = F.expr("x = x2 AND y = y2 AND k = k2")
    pairs = common.written(pairs.withColumns({"same": same, "task": F.concat_ws("/", "x", "y", "k", "x2", "y2", "k2")}), "tile-pairs")
    tasks, rows = pairs.agg(F.count("*"), F.coalesce(F.sum(F.col("size") + F.when(F.col("same"), 0).otherwise(F.col("size2"))), F.lit(0))).first()
    one = pairs.select("x", "y", "k", "task", F.when(F.col("same"), 1).otherwise(0).alias("side"))
    two = pairs.where("NOT same").select(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("k2").alias("k"), "task", F.lit(2).alias("side"))
    goes = one.unionByName(two).groupBy("x", "y", "k").agg(F.collect_list(F.struct("task", "side")).alias("tasks"))
    dealt = tiled.join(F.broadcast(blocks.drop("c")), ["x", "y"]).withColumn("k", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).join(goes, ["x", "y", "k"])
    dealt = dealt.drop("x", "y", "k", "blocks").select("*", F.explode("tasks").alias("t")).select("*", "t.task", "t.side").drop("tasks", "t")
    # The bytes of a task say little of its work, so its number of tasks is not left to them.
    parts = int(max(1, min(tasks, 8 * tiled.sparkSession.sparkContext.defaultParallelism), rows // 500_000))
    return dealt.repartition(parts, "task").groupBy("task").applyInPandas(compare, "a binary, b binary")


def links(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct 64-bit fingerprints (fp): for each pair of tiles a spanning forest of those within the radius."""
    least = lambda i: max(0, 2 * abs(i) - 1)  # noqa: E731  the counts of two halved counts that differ by i differ by that much
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if least(i) + least(j) <= radius and (i, j) >= (0, 0)]
    tiled = common.written(distinct.select("fp").mapInArrow(_tiles, "fp binary, x int, y int"), "tiles")
    return _by_tile_pairs(tiled, offsets, block, "fp", _compare(radius))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id and n_linked (distinct fingerprints of the component)."""
    rows = common.written(fingerprints(docs, shingle, 1, id_col, text_col), "fingerprints")
    distinct = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(common.written(links(distinct, radius), "near"))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_linked"))
    of = common.written(known.drop("first").join(ids, "root").select("fp", "component_id", "n_linked"), "classes")
    return rows.join(of, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "n_linked")


@functools.cache
def worst_share(similarity: float, most: int = 40) -> float:
    """The largest expected share of differing bits of two distinct shingle sets of that Jaccard similarity or more: by counting for unions
    of up to ``most`` shingles, and in the limit."""
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi

    def ones(n):
        return [math.comb(n, k) / 2**n for k in range(n + 1)]

    for union in range(2, most + 1):
        both = math.ceil(similarity * union - 1e-9)
        for a in range((union - both) // 2 + 1):
            b, p = union - both - a, 0.0
            for k, pk in enumerate(ones(both)):
                x = sum(q for i, q in enumerate(ones(a)) if 2 * (k + i) > both + a)
                y = sum(q for i, q in enumerate(ones(b)) if 2 * (k + i) > both + b)
                p += pk * (x * (1 - y) + y * (1 - x))
            worst = max(worst, p)
    return worst


def bound(share: float, bits: int) -> int:
    """Differing bits that DEVIATIONS standard deviations above the expected number do not pass."""
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def _sets(docs: DataFrame, shingle: int, words: int, folder: str) -> DataFrame:
    """doc_id, th (a digest of the text), node (one of its distinct shingles), fp of them followed by their parities, n, and where in the
    shared files they are (part, at)."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        part, at = TaskContext.get().taskAttemptId(), 0
        with common.sink(f"{folder}/{part}") as out:
            for b in batches:
                sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
                size = [len(h) for h in sets]
                places = (at + np.cumsum([0, *size])[:-1]).tolist()
                at += sum(size)
                for h in sets:
                    out.write(h.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("th"), pa.array([xxhash.xxh128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([majority(h, words) + parities(h) for h in sets], pa.binary()), pa.array(size, pa.int64()), pa.array([part] * len(sets), pa.int64()), pa.array(places, pa.int64())],
                    names=["doc_id", "th", "node", "fp", "n", "part", "at"],
                )
        common.release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_digest(docs["text"]).alias("th"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, th binary, node binary, fp binary, n long, part long, at long")


def text_digest(text):
    """128 bits that tell texts apart; a null is no empty text."""
    return F.unhex(F.md5(F.concat(F.when(text.isNull(), "0").otherwise("1"), F.coalesce(text, F.lit("")))))


def _candidates(fa: np.ndarray, fb: np.ndarray, na: np.ndarray, nb: np.ndarray, first: int, radius: int, ratio: float, odd: tuple[np.ndarray, np.ndarray] | None = None):
    """Index pairs within ``first`` in the first two words and within the radius in all, whose sizes differ by no more than the ratio, and
    whose parities ``odd`` differ in no more shingles than the ratio allows; about PAIRS at a time.  A strip of rows is compared with the
    columns of its window of sizes only."""
    order = np.argsort(nb, kind="stable")
    nb, fb = nb[order], fb[order]
    oa, ob = (odd[0], odd[1][order]) if odd else (None, None)
    differ = (1 - ratio) / (1 + ratio)  # of both sizes, where the similarity is the ratio
    left, right = np.searchsorted(nb, np.ceil(na * ratio - 1e-9)), np.searchsorted(nb, np.floor(na / ratio + 1e-9), "right")
    by_n = np.argsort(na, kind="stable")
    words = [np.ascontiguousarray(fb[:, k]) for k in range(2)]
    diff, count, total, close = (np.empty(STRIP * SPAN, t) for t in (np.uint64, np.uint8, np.uint8, bool))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for at in range(0, len(by_n), STRIP):
        rows = by_n[at : at + STRIP]
        lo, hi = int(left[rows].min()), int(right[rows].max())
        own = [fa[rows, k][:, None] for k in range(2)]
        for c in range(lo, hi, SPAN):
            shape = len(rows), min(SPAN, hi - c)
            cells = shape[0] * shape[1]
            d, n, t = (x[:cells].reshape(shape) for x in (diff, count, total))
            np.bitwise_xor(own[0], words[0][None, c : c + shape[1]], out=d)
            np.bitwise_count(d, out=t)
            np.bitwise_xor(own[1], words[1][None, c : c + shape[1]], out=d)
            np.bitwise_count(d, out=n)
            np.add(t, n, out=t)
            np.less_equal(total[:cells], np.uint8(first), out=close[:cells])
            close[cells : -(-cells // 8) * 8] = False
            eights = np.flatnonzero(close[: -(-cells // 8) * 8].view(np.uint64))
            if not len(eights):
                continue
            hit = (eights[:, None] * 8 + np.arange(8)).ravel()
            x, y = np.divmod(hit[close[hit]], shape[1])
            for p in range(0, len(x), PAIRS):
                u, v = rows[x[p : p + PAIRS]], c + y[p : p + PAIRS]
                ok = (v >= left[u]) & (v < right[u])
                u, v = u[ok], v[ok]
                ok = np.bitwise_count(fa[u] ^ fb[v]).sum(1) <= radius
                u, v = u[ok], v[ok]
                if odd:
                    ok = np.bitwise_count(oa[u] ^ ob[v]).sum(1) <= differ * (na[u] + nb[v]) + 1e-6
                    u, v = u[ok], v[ok]
                held.append((u, order[v]))
                size += len(u)
                if size >= PAIRS:
                    yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held, size = [], 0
    if size:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _verify(words: int, similarity: float, folder: str):
    """As ``_compare``, but a candidate is a link only if its shingle sets are that similar; those already connected are not looked at."""
    share = worst_share(similarity)
    radius, first = bound(share, 64 * words), bound(share, 128)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        both = np.frombuffer(b"".join(df["fp"]), ">u8").reshape(-1, words + PARITY // 64).astype("<u8")
        fp, odd = np.ascontiguousarray(both[:, :words]), np.ascontiguousarray(both[:, words:])
        n, side, part, at, node = (df[c].to_numpy() for c in ("n", "side", "part", "at", "node"))
        ia, ib = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        label, maps, a, b = np.arange(len(df)), common.Maps("<u8"), [], []
        shingles = lambda i: np.asarray(maps[f"{folder}/{part[i]}"][at[i] : at[i] + n[i]])
        if len(ia) and len(ib):
            for x, y in _candidates(fp[ia], fp[ib], n[ia], n[ib], first, radius, similarity, (odd[ia], odd[ib])):
                x, y = ia[x], ib[y]
                keep = ((x < y) if side[0] == 1 else (x != y)) & (label[x] != label[y])
                for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                    if label[i] == label[j]:
                        continue
                    same = len(np.intersect1d(shingles(i), shingles(j), assume_unique=True))
                    if same >= similarity * (n[i] + n[j] - same) - 1e-9:
                        label[label == label[j]] = label[i]
                        a.append(node[i])
                        b.append(node[j])
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return run


def similar_documents(docs: DataFrame, shingle: int = 5, words: int = 4, similarity: float = 0.8) -> DataFrame:
    """doc_id, th, component_id (the smallest doc_id of the component) and keep: whether the row is the first of its component, by doc_id
    and th, components being those of the links of a Jaccard similarity of the distinct shingles of ``similarity`` or more.

    Fingerprints of ``words`` (two or more) times 64 bits give the candidates: their radius is wide enough for sets of any size (bound,
    worst_share).  Every link is verified, first by parities, which can only rule out, then from the shingles.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.scratch(spark, "sets")
    rows = common.written(_sets(docs, shingle, words, folder), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    place = F.min(F.struct("part", "at")).alias("place")
    nodes = common.written(rows.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("n").alias("n"), place), "nodes")
    width = math.log(1 / similarity)
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / width + 1e-9).cast("int")
    tiled = common.written(nodes.select("node", "fp", "n", "place.part", "place.at", band.alias("x"), F.lit(0).alias("y")), "tiles")
    block = min(MOST_BLOCK, max(LEAST_BLOCK, tiled.count() // SHARE))
    found = common.written(_by_tile_pairs(tiled, [(0, 0), (1, 0)], block, "node", _verify(words, similarity, folder)), "near")
    common.remove(spark, folder)
    common.done(tiled)
    roots = components(found)
    known = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = known.join(known.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", "least")
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    return rows.select("node", "doc_id", "th").join(of, "node").select("doc_id", "th", F.col("least.doc_id").alias("component_id"), same.alias("keep"))
