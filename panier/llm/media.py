"""Media columns in content-defined chunks.

A payload is stored as a WAV file of 8-bit samples (canonical 44-byte header).  A rolling gear hash cuts each file where its low bits
are zero, so that equal passages give equal chunks wherever they stand.  The store keeps each chunk once:

1. Every task appends the chunks it has not met before, each compressed, to a pack file in the shared folder, and gives each
   document's list of (digest, length).
2. Spark joins settle which pack owns a digest that several have: digests, not payloads, are shuffled.
3. Packs that hold chunks owned by others are rewritten without them.

A document's ordered list of (digest, pack, offset, size) rebuilds its file, whose SHA-256 must be the one recorded.  A lost task
writes its pack again under the same name.

Edge cases: a null text is an empty payload of 64 zero bytes; equal texts have equal files; repeated rows share all chunks; a text of any
length is one file, put together in memory when it is read; a file or chunk that very many documents share is spread over tasks; a null
doc_id is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, BLOCK = 8000, 64
MIN, MAX, MASK = 1024, 32768, (1 << 12) - 1
SEED = 20240917


def gear_table() -> np.ndarray:
    """A random number for each byte value, from a seed."""
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def wav(samples: bytes) -> bytes:
    """RIFF/WAVE, PCM, one channel of 8-bit samples."""
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + samples


def samples_of(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this kind")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def cuts(data: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks.  The gear hash of 32 bytes is the sum of their numbers, each shifted by its age, found here by doubling."""
    n = len(data)
    if n <= MIN:
        return [n]
    h = gear[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    at = np.flatnonzero((h & np.uint32(MASK)) == 0) + 1
    out, last = [], 0
    while n - last > MIN:
        i = np.searchsorted(at, last + MIN)
        end = int(at[i]) if i < len(at) else n
        last = min(end, last + MAX, n)
        out.append(last)
    if not out or out[-1] < n:
        out.append(n)
    return out


def feature(samples: bytes) -> str:
    """Mean, root mean square about 128 and crossings of it, over the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x.astype(float) ** 2).mean()):.4f};crossings={crossings}"


CHUNK = "array<struct<digest:binary,offset:bigint,size:int>>"
LISTS = f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, pack int, chunks {CHUNK}"


def _pack_name(root: str, kind: str, pack: int) -> str:
    return f"{root}/{kind}-{pack:05d}.pack"


def _chunked(root: str):
    def run(batches):
        import zstandard

        gear, press = gear_table(), zstandard.ZstdCompressor(level=3)
        part, out, at = TaskContext.get().partitionId(), None, 0
        half = f"{_pack_name(root, 'raw', part)}.{TaskContext.get().taskAttemptId()}.half"
        known: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload, n = payload_of(text)
                media, lists, lo = wav(payload), [], 0
                for hi in cuts(media, gear):
                    digest = hashlib.sha256(media[lo:hi]).digest()
                    if digest not in known:
                        if out is None:
                            out = common.sink(half)
                        z = press.compress(media[lo:hi])
                        out.write(z)
                        known[digest] = (at, len(z))
                        at += len(z)
                    lists.append({"digest": digest, "offset": known[digest][0], "size": known[digest][1]})
                    lo = hi
                rows.append((doc, n, len(media), hashlib.sha256(media).hexdigest(), part, lists))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("digest", pa.binary()), ("offset", pa.int64()), ("size", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "pack", "chunks"])
        if out is not None:
            out.close()
            common.rename_file(half, _pack_name(root, "raw", part))

    return run


def _compacted(root: str):
    """Copies a pack's own chunks to its place in the store and deletes the pack, so that no more than a few are there twice.

    What it returns follows from the sizes alone, so a task that runs again after its pack is gone returns the same.  The pack goes only
    when its copy has its name: a second attempt finds the copy, or is one that another has overtaken."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("offset")
        pack = int(df["pack"].iloc[0])
        old, name = _pack_name(root, "raw", pack), _pack_name(root, "store", pack)
        at = np.concatenate([[0], np.cumsum(df["size"].to_numpy())])
        if not common.exists(name):  # else an earlier attempt came as far as this
            raw = common.mapped(old, np.uint8)
            half = f"{name}.{TaskContext.get().taskAttemptId()}.half"
            out = common.sink(half)
            for lo, n in zip(df["offset"], df["size"], strict=True):
                out.write(raw[lo : lo + n].tobytes())
            out.close()
            common.rename_file(half, name)
        common.delete_file(old)
        return pd.DataFrame({"digest": df["digest"], "pack": df["pack"], "offset": at[:-1], "size": df["size"]})

    return run


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """The store's folder and its documents: doc_id, n_bytes, media_bytes, media_sha256 and the ordered chunks (pack, offset, size)."""
    spark = docs.sparkSession
    common.tune(spark)
    root = common.scratch(spark, "media")
    lists = common.written(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_chunked(root), LISTS), "chunk-lists")
    here = lists.select("pack", F.explode("chunks").alias("c")).select("pack", "c.*").distinct()
    owners = here.groupBy("digest").agg(F.min(F.struct("pack", "offset", "size")).alias("o")).select("digest", "o.*")
    # A group is the chunks of one task's input: bounded by the size of a partition.
    index = common.written(owners.groupBy("pack").applyInPandas(_compacted(root), "digest binary, pack int, offset long, size int"), "chunk-index")
    # Equal files have equal lists: a list is put together once for each file, then joined to the documents.
    files = lists.groupBy("media_sha256").agg(F.first("chunks").alias("chunks"))
    each = common.written(files.select("media_sha256", F.posexplode("chunks").alias("seq", "c")).select("media_sha256", "seq", "c.digest"), "chunks")
    ordered = common.spread_join(each, index, "digest").groupBy("media_sha256").agg(F.array_sort(F.collect_list(F.struct("seq", "pack", "offset", "size"))).alias("chunks"))
    return root, common.spread_join(lists.drop("chunks", "pack"), ordered, "media_sha256")


def read_media(root: str, stored: DataFrame) -> DataFrame:
    """Rebuilds each file from its chunks, verifies it, and describes what was read."""

    def run(batches):
        import zstandard

        press, packs = zstandard.ZstdDecompressor(), common.Maps(np.uint8, 256)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                parts = []
                for c in r["chunks"]:
                    z = packs[_pack_name(root, "store", c["pack"])][c["offset"] : c["offset"] + c["size"]]
                    parts.append(press.decompress(z.tobytes()))
                media = b"".join(parts)
                sha = hashlib.sha256(media).hexdigest()
                if sha != r["media_sha256"]:
                    raise ValueError(f"document {r['doc_id']}: its chunks do not rebuild it")
                x = samples_of(media)
                rows.append((r["doc_id"], r["n_bytes"], len(x), hashlib.sha256(x).hexdigest(), common.crc32(x[-64:]), len(media), sha, feature(x), len(parts)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int")
