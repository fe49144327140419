"""Token ids in compressed files that are decoded in parallel: interleaved rANS blocks under one shared frequency table.

A file row is one block: the ids of neighbouring documents, coded by LANES independent range asymmetric
coders that take turns, so that numpy advances all of them at once. Frequencies are counted over the
whole corpus, scaled to 2 ** BITS and written once beside the blocks. A block holds its documents' ids and sizes, the
final states of its lanes, checkpoints (the lanes' states and places every STRIDE symbols a lane), and checksums of its words and of its ids; it can be
decoded without any other block, and from any of its checkpoints. Blocks name their place in their range of the
documents' order; the places of the ranges are a small table of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.llm.encoding import BYTE_BPE, encoder
from plantscope.llm.registry import query, table
from plantscope.llm.scratch import discard, write_once
from plantscope.session import scratch_path

LANES = 4096
BITS = 18  # the sum of all frequencies; at least twice the vocabulary
BLOCK = 1 << 20  # ids in a block, but for documents that are longer
STRIDE = 64
_LOW = np.uint64(1 << 31)  # states lie in [2**31, 2**63) and words of 32 bits are moved


def scaled(counts: dict[int, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in order, and their frequencies: at least 1 each, 2 ** bits in all."""
    symbols = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in symbols], np.float64)
    if not len(symbols):
        return symbols, np.zeros(0, np.int64)
    if len(symbols) > 1 << bits:
        raise ValueError(f"{len(symbols)} symbols don't fit a table of 2 ** {bits}")
    spare = (1 << bits) - len(symbols)
    freq = 1 + np.floor(n / n.sum() * spare).astype(np.int64)
    freq[np.argmax(n)] += (1 << bits) - freq.sum()
    return symbols, freq


class Coder:
    """Encodes and decodes arrays of the table's symbols."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, bits: int = BITS):
        self.symbols, self.bits = symbols, np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.begin = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(symbols)), freq)
        self.place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int32)  # by symbol; symbols are ids of a vocabulary
        self.place[symbols] = np.arange(len(symbols))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, first states, and the states and word places of the checkpoints, all in the order in which the decoder meets them.

        Symbol i is coded by lane i % LANES in step i // LANES; steps are coded from the last to the first.
        """
        at = self.place[ids]
        steps = -(-len(ids) // LANES)
        state = np.full(LANES, _LOW, np.uint64)
        words, marks, sizes = [], [], []
        freq, begin = self.freq[at], self.begin[at]
        limit = freq << np.uint64(63 - int(self.bits))
        for step in range(steps - 1, -1, -1):
            f, b, top = (x[step * LANES : (step + 1) * LANES] for x in (freq, begin, limit))
            s = state[: len(f)]
            over = s >= top
            out = s[over]
            words.append(out.astype(np.uint32))
            s[over] = out >> np.uint64(32)
            q = s // f
            s[:] = (q << self.bits) + (s - q * f) + b
            sizes.append(len(out))
            if step and step % STRIDE == 0:
                marks.append((step, state.copy()))
        sizes = np.cumsum(sizes[::-1])  # words that the decoder has taken after each step
        places = np.array([sizes[k - 1] for k, _ in reversed(marks)], np.uint32)
        states = np.array([m for _, m in reversed(marks)], np.uint64).reshape(-1, LANES)
        stream = np.concatenate([*words[::-1], np.zeros(0, np.uint32)])
        return stream, state, states, places

    def decode(self, words: np.ndarray, state: np.ndarray, n: int) -> np.ndarray:
        """The next ``n`` ids from lanes in ``state``; ``words`` begin at the first that they take."""
        state, out, at = state.astype(np.uint64), np.zeros(n, np.int64), 0
        mask = np.uint64((1 << int(self.bits)) - 1)
        for a in range(0, n, LANES):
            s = state[: min(LANES, n - a)]
            low = s & mask
            k = self.slot[low.astype(np.int64)]
            out[a : a + len(s)] = k
            s[:] = self.freq[k] * (s >> self.bits) + low - self.begin[k]
            short = np.flatnonzero(s < _LOW)
            s[short] = (s[short] << np.uint64(32)) | words[at : at + len(short)].astype(np.uint64)
            at += len(short)
        if at != len(words) or not (state == _LOW).all():
            raise ValueError("the words and the lanes of a block don't end together")
        return self.symbols[out]


def _width(enc) -> str:
    """How ids travel until they are coded: in two bytes where the vocabulary allows it."""
    return "<u2" if len(enc.edge) <= 1 << 16 else "<u4"


TOKENS = "id long, n long, ids binary, symbols array<int>, counts array<long>"


def _tokens(path: str, end_id: int):
    """A row for each text, and one last row a task that counts the symbols of all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        kind, total = _width(enc), np.zeros(0, np.int64)
        for pdf in batches:
            ids = [np.append(x, np.uint32(end_id)).astype(kind) for x in enc.encode(pdf["text"])]
            for a in range(0, len(ids), 500):
                n = np.bincount(np.concatenate(ids[a : a + 500]), minlength=len(total))
                n[: len(total)] += total
                total = n
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids], "symbols": None, "counts": None})
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": pd.array([None], "Int64"), "n": pd.array([None], "Int64"), "ids": [None], "symbols": [some.astype(np.int32)], "counts": [total[some]]})

    return run


BLOCKS = "part int, first_start long, n_ids long, ids binary, sizes binary, words binary, lanes binary, marks binary, places binary, words_crc32 long, ids_crc32 long"


def _blocks(symbols: np.ndarray, freq: np.ndarray, path: str):
    def block(coder, part, first_start, rows):
        ids = np.frombuffer(b"".join(r[2] for r in rows), _width(encoder(path))).astype("<u4")
        words, lanes, marks, places = coder.encode(ids)
        names = pd.array([r[0] for r in rows], dtype="Int64")
        null = names.isna()
        raw = words.astype("<u4").tobytes()
        return pd.DataFrame({
            "part": np.array([part], np.int32), "first_start": [first_start], "n_ids": [len(ids)], "ids": [np.where(null, 0, names.fillna(0)).astype("<i8").tobytes() + null.astype(np.uint8).tobytes()],
            "sizes": [np.array([r[1] for r in rows], "<u4").tobytes()], "words": [raw], "lanes": [lanes.astype("<u8").tobytes()],
            "marks": [marks.astype("<u8").tobytes()], "places": [places.astype("<u4").tobytes()], "words_crc32": [zlib.crc32(raw)], "ids_crc32": [zlib.crc32(ids.tobytes())],
        })

    def run(batches):
        coder, held, size, at, now = Coder(symbols, freq), [], 0, 0, None  # at: ids of the part before those held
        for pdf in batches:
            for part, i, n, ids in pdf[["part", "id", "n", "ids"]].itertuples(index=False):
                if held and (part != now or size + n > BLOCK):
                    yield block(coder, now, at, held)
                    held, size, at = [], 0, at + size
                if part != now:
                    at, now = 0, part
                held.append((i, n, ids))
                size += n
        if held:
            yield block(coder, now, at, held)

    return run


def _read(symbols: np.ndarray, freq: np.ndarray, with_ids: bool):
    def run(batches):
        coder = Coder(symbols, freq)
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                if zlib.crc32(b.words) != b.words_crc32:
                    raise ValueError("a block's words don't match their checksum")
                sizes = np.frombuffer(b.sizes, "<u4").astype(np.int64)
                ids = coder.decode(np.frombuffer(b.words, "<u4"), np.frombuffer(b.lanes, "<u8"), int(sizes.sum())).astype("<u4")
                if zlib.crc32(ids.tobytes()) != b.ids_crc32:
                    raise ValueError("a block's ids don't match their checksum")
                n = len(sizes)
                names = pd.array(np.frombuffer(b.ids[: 8 * n], "<i8"), dtype="Int64")
                names[np.frombuffer(b.ids[8 * n :], np.uint8).astype(bool)] = pd.NA
                ends = np.cumsum(sizes)
                parts = np.split(ids, ends[:-1])
                out = pd.DataFrame({"id": names, "start": b.before + b.first_start + ends - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts]})
                if with_ids:
                    out["token_ids"] = [p.astype(np.int32) for p in parts]
                yield out

    return run


def decode_from(block: dict, coder: Coder, mark: int) -> np.ndarray:
    """The ids of a block (a row of its file) from checkpoint ``mark`` on: id (mark + 1) * STRIDE * LANES and all that follow."""
    words = np.frombuffer(block["words"], "<u4")
    state = np.frombuffer(block["marks"], "<u8").reshape(-1, LANES)[mark]
    place = int(np.frombuffer(block["places"], "<u4")[mark])
    n = int(np.frombuffer(block["sizes"], "<u4").astype(np.int64).sum()) - (mark + 1) * STRIDE * LANES
    return coder.decode(words[place:], state, n)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE, end_id: int = 0) -> None:
    """Writes ``folder``/table, ``folder``/blocks and ``folder``/parts: the ids of all texts, each ending in ``end_id``, in order of the documents' ids.

    Rows without id come first; rows with one id are ordered by their token ids. NULL and empty texts are the end id alone. Other columns are not looked at.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens = write_once(rows.mapInPandas(_tokens(path, end_id), TOKENS), "tokens")
    each = tokens.where("symbols is not null").select(F.explode(F.arrays_zip("symbols", "counts")).alias("c"))  # at most a row for each task and symbol
    histogram = each.groupBy(F.col("c.symbols").cast("long").alias("symbol")).agg(F.sum("c.counts").alias("n"))
    counts = {r["symbol"]: r["n"] for r in histogram.collect()}  # at most a row for each symbol of the vocabulary
    symbols, freq = scaled(counts)
    spark.createDataFrame(pd.DataFrame({"symbol": symbols, "frequency": freq}), "symbol long, frequency long").coalesce(1).write.parquet(f"{folder}/table")

    # blocks know where they begin in their range-sorted part; where each part begins follows from what was written
    # (the sample of the range partitioning holds only the beginnings of the ids)
    texts = tokens.where("symbols is null").select("id", "n", "ids")
    order = texts.repartitionByRange(partitions, "id", F.expr("substring(ids, 1, 64)")).sortWithinPartitions("id", "ids").withColumn("part", F.spark_partition_id())
    order.mapInPandas(_blocks(symbols, freq, path), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(tokens)
    parts = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", before.alias("before")).coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32, token_ids) of every document in a folder of :func:`write_tokens`; blocks are decoded independently and checked."""
    found = spark.read.parquet(f"{folder}/table").toPandas().sort_values("symbol")  # a row for each symbol
    shape = "id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids
    decode = _read(found["symbol"].to_numpy(), found["frequency"].to_numpy(), with_ids)
    parts = spark.read.schema("part int, before long").parquet(f"{folder}/parts")
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").join(F.broadcast(parts), "part").mapInPandas(decode, shape).withColumnRenamed("id", id_col)


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, with_ids=False)
