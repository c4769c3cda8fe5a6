"""Packing by concatenation and cutting.

Pass 1 tokenizes every document once, ends it with id 1, writes the ids to the
shared folder and notes for each document its partition and the tokens before
it there. The totals per partition (a row per partition) are summed up to
global offsets. Pass 2 adds the two sums and cuts the stream at every
``window`` tokens; a document across a cut leaves a boundary record on either
side, so every id is in exactly one piece. The rest after the last whole window
is cut at powers of two (1300 = 1024 + 256 + 16 + 4), which needs no padding.

The written ids make pass 2 independent of pass 1: a lost executor repeats
only its tasks, and offsets never change.

Nulls and ties: a null text is an empty document of the one id 1; a null
doc_id stays null; repeated rows are packed each; an empty table gives an
empty result; texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.llm.common import python_workers
from fleetwear.llm.tokens import byte_bpe
from fleetwear.session import stage

WINDOW = 2048
END = 1  # the id that ends a document
SLICE = 512  # rows handled at once


def tokenized(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Rows (key, part, before, n, ids): 16-bit ids with the end id; ``before`` counts within the partition."""
    python_workers(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(folder)
        part, before = TaskContext.get().partitionId(), 0
        end = END.to_bytes(2, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                ids = [tokenizer.ids(t or "") + end for t in rows.column(1).to_pylist()]
                n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    ["key", "part", "before", "n", "ids"],
                )

    return df.select(F.col(key), F.col(text)).mapInArrow(encode, f"key {kind}, part int, before long, n long, ids binary")


def tail_edges(total: int, window: int = WINDOW) -> list[int]:
    """Where sequences begin after the last whole window: cuts at powers of two."""
    at, edges = total // window * window, []
    while at < total:
        edges.append(at)
        at += 1 << (total - at).bit_length() - 1
    return edges


def cut(start: int, length: int, window: int, edges: list[int], total: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (start in the document, length, sequence, offset) of one document at ``start`` of the stream."""
    full = total // window * window
    at, stop = start, start + length
    k = 0
    while at < stop:
        if at < full:
            sequence, first = divmod(at, window)
            first = at - first
            end = first + window
        else:
            while k + 1 < len(edges) and edges[k + 1] <= at:
                k += 1
            sequence, first = full // window + k, edges[k]
            end = edges[k + 1] if k + 1 < len(edges) else total
        end = min(end, stop)
        yield at - start, end - at, sequence, at - first
        at = end


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, folder: str | None = None
) -> DataFrame:
    """Rows (key, start, length, ids, doc_tokens, sequence_id, offset): one per piece; ids as 32-bit binary."""
    if window < 1:
        raise ValueError("window must be positive")
    ids = stage(tokenized(df, key, text, folder), "packing-ids")
    parts = stage(ids.groupBy("part").agg(F.sum("n").alias("n")), "packing-parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A row per partition of the input, so one ordered window and the
    # broadcast stay small: a million partitions are 12 MB.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = ids.join(F.broadcast(offsets), "part").select("key", (F.col("before") + F.col("offset")).alias("at"), "n", "ids")
    edges = tail_edges(total, window)
    kind = dict(df.dtypes)[key]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                rows = batch.slice(first, SLICE)
                out: list[tuple] = []
                source = []
                for i, (at, n, packed) in enumerate(
                    zip(*[rows.column(c).to_pylist() for c in (1, 2)], rows.column(3), strict=True)
                ):
                    stream = np.frombuffer(packed.as_buffer(), "<u2")
                    for start, length, sequence, offset in cut(at, n, window, edges, total):
                        out.append((start, length, stream[start:start + length].astype("<u4").tobytes(), n, sequence, offset))
                        source.append(i)
                keys = rows.column(0).take(pa.array(source, pa.int64()))
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [keys, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    made = placed.mapInArrow(
        pieces, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return made.withColumnRenamed("key", key)


def digest(packed: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids."""
    return packed.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in packed.columns])


