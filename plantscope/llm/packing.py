"""Best-fit packing of token sequences into bins of fixed capacity, in bulk.

Documents are range-sorted by length in Spark. The gaps of the open bins are held sorted as well, as runs of
neighbouring bins with equal gaps; the capacity bounds their number, not the data. In each round the longest
documents left, all of one length, are matched with their successors among the gaps in one sweep: a document's rank among
its equals decides which bin of which run it gets, so no two want the same place. The gaps are updated and
the next round follows. That gives what best-fit decreasing gives one document at a time. Every
document then finds its bin from its length and rank by one search in the list of matches.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.llm.encoding import WORD_BPE, encoder
from plantscope.llm.registry import query, table
from plantscope.session import materialize

CAPACITY = 2048


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Matches (length, first rank, documents, first bin, documents per bin, offset) and the number of bins.

    ``counts``: documents by length, 1 to ``capacity``. Document ``first rank + i`` of the match goes to bin ``first bin + i // per bin``
    at ``offset + i % per bin * length``. A run of bins with one gap is split at most twice a round, and its gap at least halves
    with every match, so matches are a small multiple of the capacity.
    """
    gaps: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, bins)
    out, bins = [], 0

    def free(gap, first, n):
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)  # the successor: the smallest gap that holds the document
            if at == len(gaps):
                per = capacity // length
                gap, first, n = capacity, bins, -(-left // per)
                bins += n
            else:
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
                per = gap // length
            full, some = divmod(min(left, per * n), per)
            out.append((length, rank, full * per + some, first, per, capacity - gap))
            free(gap - per * length, first, full)
            free(gap - some * length, first + full, int(some > 0))
            free(gap, first + full + (some > 0), n - full - (some > 0))
            rank += full * per + some
            left -= full * per + some
    return out, bins


def pieces_of(path: str, capacity: int, remember: bool = True):
    """Pieces of every text; unless ``remember``, the worker drops the parts it has encoded when the task ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            rows = []
            for i, ids in zip(pdf["id"], enc.encode(pdf["text"])):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            out["id"] = out["id"].astype("Int64")
            yield out
        if not remember:
            enc.forget()

    return run


def assigned(matches: list[tuple[int, ...]]):
    """Bins and offsets by (length, rank); the matches are bounded by the capacity."""
    m = np.array(matches, np.int64).reshape(-1, 6)
    m = m[np.lexsort((m[:, 1], m[:, 0]))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            key = length << 44 | rank
            row = m[np.searchsorted(m[:, 0] << 44 | m[:, 1], key, side="right") - 1] if len(pdf) else m[:0]
            i = rank - row[:, 1]
            out = pdf.drop(columns=["rank"])
            out["sequence_id"] = row[:, 3] + i // np.maximum(row[:, 4], 1)
            out["offset"] = row[:, 5] + i % np.maximum(row[:, 4], 1) * length
            yield out

    return run


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with columns id, piece, start, length, ids_crc32) with sequence_id and offset."""
    by = ["length", "id", "piece", "start", "ids_crc32"]
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one range-sorted table, written so that all that follows sees the same places
    order = materialize(pieces.repartitionByRange(partitions, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "pieces")
    parts = order.groupBy(F.shiftright("place", 33).alias("part"), "length").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rows: one for each partition, and one more for each length; far fewer than pieces
    offsets = parts.select("part", "length", (before - F.col("first")).alias("shift"))
    ranked = order.withColumn("part", F.shiftright("place", 33)).join(offsets, ["part", "length"]).withColumn("rank", F.col("place") + F.col("shift"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    matches, _ = best_fit(counts, capacity)
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(assigned(matches), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, capacity: int = CAPACITY, remember: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each row of ``docs``.

    A text's ids end in id 0; texts of more than ``capacity`` ids are cut into pieces of that many, the last may be shorter. NULL and empty
    texts are the end id alone. Ids may be NULL or repeat: every row is packed. Sequences are filled without gaps from offset
    0. Other columns are not looked at; an empty table gives an empty result. ``remember``: idle workers keep the parts of texts
    they have encoded for later tasks; without it their memory is free for other work between tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # written first: the range partitioning reads its rows twice, for its sample and for the rows, and texts are to be encoded once
    pieces = materialize(rows.mapInPandas(pieces_of(path, capacity, remember), PIECES), "encoded-pieces")
    return packed(pieces, capacity).withColumnRenamed("id", id_col)


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
