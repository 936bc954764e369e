"""Token-ID output: flat unsigned integer files plus 64-bit document offsets.

A store is a folder with, per partition, ``part-NNNNN.bin`` (ids, little-endian, 16 bits where the vocabulary allows, else 32) and
``part-NNNNN.idx`` (64-bit offsets of the part's documents, one more than documents), a Parquet table ``meta`` with a row per
document, and ``manifest.json`` with each part's base, the prefix sum of the ids before it.  Readers memory-map the files.

Edge cases: a null text is an empty one (its only id is the end id); equal doc_ids are ordered by text; a null doc_id comes first;
a text of any length is encoded whole; an empty table gives a store without parts; further columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

META = "doc_id long, part int, idx long, pos long, n_tokens long"


def part_name(part: int) -> str:
    return f"part-{part:05d}"


def _encode(root: str, tokenizer: str, end_id: int):
    def run(batches):
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        name, half = f"{root}/{part_name(part)}", None
        offsets, size = [0], enc.dtype.itemsize
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                half = f"{name}.{TaskContext.get().taskAttemptId()}.half"
                out = common.sink(half)
            first = len(offsets) - 1
            for text in batch.column(1).to_pylist():
                ids = enc.bytes_of(text or "") + end
                out.write(ids)
                offsets.append(offsets[-1] + len(ids) // size)
            here = np.asarray(offsets[first:], np.int64)
            n = len(here) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n, dtype=np.int64)), pa.array(here[:-1]), pa.array(np.diff(here))],
                names=["doc_id", "part", "idx", "pos", "n_tokens"],
            )
        if out is not None:
            out.close()
            common.put_file(f"{name}.idx", np.asarray(offsets, "<u8").tobytes())
            common.rename_file(half, f"{name}.bin")

    return run


@dataclass
class TokenStore:
    root: str
    meta: DataFrame
    bases: dict[int, int]
    dtype: str

    def per_document(self) -> DataFrame:
        """doc_id, start, n_tokens and the crc32 of the ids (as 32-bit little-endian integers), all read back from the files."""
        root, bases, dtype = self.root, self.bases, self.dtype

        def read(batches):
            ids, offsets = common.Maps(dtype), common.Maps("<u8")
            for b in batches:
                starts, counts, crcs = [], [], []
                for part, i in zip(b.column("part").to_pylist(), b.column("idx").to_pylist(), strict=True):
                    name = f"{root}/{part_name(part)}"
                    lo, hi = (int(x) for x in offsets[f"{name}.idx"][i : i + 2])
                    starts.append(bases[part] + lo)
                    counts.append(hi - lo)
                    crcs.append(common.crc32(np.asarray(ids[f"{name}.bin"][lo:hi], "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return self.meta.select("doc_id", "part", "idx").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_store(docs: DataFrame, tokenizer: str, end_id: int, ordered: bool = True, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encodes ``docs`` into a store.  ``ordered``: in ascending doc_id order over all parts, by a range partitioning of the ids.

    Only one number per part comes to the driver: their count is that of the partitions.  A retried task writes its part again.
    """
    spark = docs.sparkSession
    common.tune(spark)
    root = common.scratch(spark, "tokens")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    if ordered:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with common.freed_shuffles(spark):
        rows.mapInArrow(_encode(root, tokenizer, end_id), META).write.option("compression", "zstd").parquet(f"{root}/meta")
    meta = spark.read.schema(META).parquet(f"{root}/meta")
    bases, total = {}, 0
    for part, n in sorted(tuple(r) for r in meta.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases[part] = total
        total += n
    dtype = encoder(tokenizer).dtype.str
    common.put_file(f"{root}/manifest.json", json.dumps({"dtype": dtype, "tokens": total, "bases": bases}).encode())
    return TokenStore(root, meta, bases, dtype)
