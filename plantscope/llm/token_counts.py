"""Token counts of whole texts under a sentencepiece BPE vocabulary, by rank-synchronous merging.

Texts are cut where no piece goes across. The parts that a worker hasn't met
are laid end to end in one array of symbols; in every round each part merges all
places of its best-ranked pair at once, and the symbols left at the end are counted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.piece_model import PieceModel, piece_model
from plantscope.llm.registry import query, table

#: Counts a worker remembers; beyond it, it starts afresh.
REMEMBERED = 500_000
SLICE = 2_000_000
NEVER = np.int32(2**31 - 1)


class Merges:
    """Pairs of symbols whose union is a piece, sorted for search, with the piece's rank."""

    def __init__(self, model: PieceModel):
        symbols = list(model.pieces) + sorted({c for p in model.pieces for c in p} - model.pieces.keys())
        number = {s: i for i, s in enumerate(symbols)}
        self.n, self.n_pieces = len(symbols), len(model.pieces)
        self.chars = np.sort(np.array([ord(s) for s in symbols if len(s) == 1], np.int64))
        self.char_symbol = np.array([number[chr(c)] for c in self.chars], np.int64)
        order = sorted((p for p in model.pieces if len(p) > 1), key=lambda p: -model.scores[p])
        found = [
            (number[p[:i]] * self.n + number[p[i:]], rank, number[p])
            for rank, p in enumerate(order) for i in range(1, len(p)) if p[:i] in number and p[i:] in number
        ]
        self.keys, self.ranks, self.made = np.array(sorted(found), np.int64).T.copy()
        self.ranks = self.ranks.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[at], NEVER), self.made[at]


def count_symbols(units: list[str], merges: Merges) -> np.ndarray:
    """Symbols left of each unit after all merges; a character that is no piece counts its UTF-8 bytes."""
    total = np.zeros(len(units), np.int64)
    code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(merges.chars, code), len(merges.chars) - 1)
    symbol = np.where(merges.chars[at] == code, merges.char_symbol[at], -1)
    weight = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    unit = np.repeat(np.arange(len(units)), [len(u) for u in units])

    def ranked(i):  # the pair that starts at each place i
        j = np.minimum(i + 1, len(symbol) - 1)
        r, made = merges.rank(symbol[i], symbol[j])
        return np.where((i < len(symbol) - 1) & (unit[i] == unit[j]), r, NEVER), made

    if len(symbol):
        rank, made = ranked(np.arange(len(symbol)))
    while len(symbol):
        start = np.flatnonzero(np.diff(unit, prepend=-1))
        best = np.minimum.reduceat(rank, start)
        size = np.diff(start, append=len(unit))
        done = np.repeat(best == NEVER, size)
        if done.any():  # units without a pair leave
            left = np.where((symbol[done] >= 0) & (symbol[done] < merges.n_pieces), 1, weight[done])
            total += np.bincount(unit[done], left, len(units)).astype(np.int64)
            symbol, weight, unit, rank, made = (x[~done] for x in (symbol, weight, unit, rank, made))
            best, size = best[best != NEVER], size[best != NEVER]
            if not len(symbol):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        run = np.cumsum(np.diff(hit, prepend=-2) > 1)  # of places that overlap, every other one merges, from the left
        first = np.flatnonzero(np.diff(run, prepend=0))
        hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(first, append=len(hit)))) % 2 == 0]
        symbol[hit] = made[hit]
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        symbol, weight, unit, rank, made = (x[keep] for x in (symbol, weight, unit, rank, made))
        changed = np.unique(np.concatenate([place[hit], np.maximum(place[hit] - 1, 0)]))
        rank[changed], made[changed] = ranked(changed)
    return total


@functools.lru_cache(maxsize=2)
def _tables(path: str | None) -> tuple[PieceModel, Merges, dict[str, int]]:
    model = piece_model(path)
    return model, Merges(model), {}


def _counts(texts: list[str | None], path: str | None) -> list[int]:
    model, merges, known = _tables(path)
    out, held, size = [], [], 0

    def settle():
        new = list(set().union(*held).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*held))
        known.update(zip(new, count_symbols(new, merges).tolist()))
        out.extend(sum(map(known.__getitem__, u)) for u in held)
        held.clear()

    for t in texts:
        held.append(model.units(t or ""))
        size += len(t or "")
        if size > SLICE:
            settle()
            size = 0
    settle()
    return out


def token_count(text: Column, model: str | None = None) -> Column:
    """Tokens of whole texts as the sentencepiece library counts them, without begin, end or added tokens.

    NULL and empty texts have 0. ``model``: path of the model file; by default the public one of 32,000 pieces.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_counts(s.tolist(), model), dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model: str | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row; no shuffle.

    NULL texts count as empty: 0 bytes, 0 tokens. Ids may be NULL or repeat; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), model).alias("n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
