"""Token ids in ORC files.

Documents are dealt out by ranges of doc_id, so files follow each other in ascending order.
ORC run-length encodes the ids (version 2 of its integer encoding), keeps a row index and a
Bloom filter on doc_id in each stripe, and stripes are read in parallel; a look-up by doc_id
prunes files and stripes by their statistics and filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import Scratch, stored_bytes, texts
from ._text import lean, list_array
from .tokens import encoder, forget, groups

SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


def _files(docs: DataFrame, file_bytes: int) -> int:
    """How many files: one for file_bytes of input, but a few for each core as long as they hold 1 MB."""
    size = stored_bytes(docs)
    if size is None:
        return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // file_bytes), min(3 * docs.sparkSession.sparkContext.defaultParallelism, size >> 20))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, file_bytes: int = 12 << 20, stripe_bytes: int = 16 << 20, stride: int = 10_000) -> None:
    """Writes doc_id, part (rank of the file), at (ids before it in the file), n_tokens, ids.

    A task sorts and writes one file, so file_bytes of input bounds what it holds; a store that
    wants fewer files takes more of them, and stripes keep reads parallel.
    Null and empty texts are the end id alone; null doc_ids come first, repeated rows follow
    each other by a hash of their text, then the text.  An empty table gives a folder without rows.
    """

    def run(batches):
        coder, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, some in groups(batch.column(1)):
                raw = [x + end for x in coder.encode(some)]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                before = at + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                at += int(n.sum())
                flat = np.frombuffer(b"".join(raw), "<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.array(np.full(len(some), part, np.int32)), pa.array(before), pa.array(n), list_array(flat, n, pa.int32())], names=["doc_id", "part", "at", "n_tokens", "ids"])

    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = texts(docs).repartitionByRange(partitions or _files(docs, file_bytes), *order[:2]).sortWithinPartitions(*order)
    out = dealt.mapInArrow(lean(run), SCHEMA).write.mode("overwrite")
    out = out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
    out.option("orc.row.index.stride", str(stride)).option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").option("orc.compression.zstd.level", "1").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of files by write()."""
    rows = spark.read.schema(SCHEMA).orc(path)
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    # base has a row of 12 bytes a file, and files have file_bytes
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; row indexes and Bloom filters skip what cannot hold them."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _digest(batches):
    forget()  # the pieces that the worker kept while it wrote
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(3)
        flat, offs = memoryview(col.values.to_numpy().astype("<i4", copy=False)).cast("B"), (4 * col.offsets.to_numpy().astype(np.int64)).tolist()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs, reads the files back, and returns doc_id, start, n_tokens, ids_crc32 from them."""
    scratch = Scratch(docs.sparkSession, "token-file")
    write(docs, scratch.path("ids"), tokenizer)
    return read(docs.sparkSession, scratch.path("ids")).mapInArrow(lean(_digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
