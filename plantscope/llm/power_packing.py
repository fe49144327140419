"""Packing by power-of-two decomposition: documents are cut into pieces of binary lengths, and equal lengths share sequences.

A document of T ids (its end id included) gives ``T // capacity`` pieces of ``capacity`` ids and then one piece for every bit
set in ``T % capacity``, longest first, so each of its ids lies in exactly one piece and no piece crosses documents. Pieces of
one length 2^j fill sequences of ``capacity / 2^j`` pieces each: every sequence is full but the last of each length, so the
whole result has less than ``capacity`` ids of padding for each of the log2(capacity) + 1 lengths, whatever the corpus.

One pass encodes the texts and numbers each task's pieces per length; the pieces (seven numbers a row) are written once.
A table of one row per task and length gives every piece its rank among the pieces of its length, and the rank its
sequence and place. Nothing but that table, whose size is bounded by tasks times lengths, is broadcast; no row is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.llm.encoding import BYTE_BPE, encoder
from plantscope.llm.registry import query, table
from plantscope.llm.scratch import write_once

CAPACITY = 1024
END_ID = 0
#: The table of ranks is broadcast while it has at most so many rows (tasks times lengths); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, part int, local long"


def binary_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces, in order: ``capacity`` as often as it fits, then the powers of two of the rest, longest first."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut(path: str, capacity: int):
    """Pieces of every text of the task's batches, numbered within the task by length; NULL texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity.bit_length(), np.int64)  # pieces of each length so far in this task
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf["id"], enc.encode(pdf["text"])):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                start = 0
                for k, length in enumerate(binary_lengths(len(ids), capacity)):
                    j = length.bit_length() - 1
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), part, seen[j]))
                    seen[j] += 1
                    start += length
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "part", "local"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def power_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE, capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document's ids are those of the tokenizer (no added special tokens) and then ``END_ID``; doc_tokens counts them all, start is the
    piece's place in them and piece its number from 0. ``capacity`` must be a power of two. A sequence holds pieces of one length,
    gaplessly from offset 0; sequences of longer pieces come first. NULL and empty texts are one piece of the end id alone. Ids may be
    NULL or repeat: every row is packed. Other columns are not looked at; an empty table gives an empty result.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut_rows = rows.mapInPandas(cut(path, capacity), PIECES)
    tasks = cut_rows.rdd.getNumPartitions()
    pieces = write_once(cut_rows, "power-pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # rows: one for each task and length
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = per_part.select("part", "length", before.alias("base"), F.sum("n").over(Window.partitionBy("length")).alias("total"))
    sequences = F.expr(f"(total + {capacity} div length - 1) div ({capacity} div length)")
    # rows: one for each length, at most log2(capacity) + 1
    earlier = F.coalesce(F.sum("sequences").over(Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = ranks.select("length", "total").distinct().select("length", sequences.alias("sequences")).select("length", earlier.alias("first"))
    table_ = ranks.join(lengths, "length").select("part", "length", "base", "first")
    if tasks * capacity.bit_length() <= BROADCAST_ROWS:
        table_ = F.broadcast(table_)
    placed = pieces.join(table_, ["part", "length"])
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "doc_tokens",
        F.expr(f"first + (base + local) div ({capacity} div length)").alias("sequence_id"),
        F.expr(f"(base + local) % ({capacity} div length) * length").alias("offset"),
    )


@query("op13_power_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power_pack(table(spark, sf_dir, "documents"))
