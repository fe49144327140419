"""Encoding texts into pieces of the best total score, and decoding them, with an Aho-Corasick automaton.

The automaton holds all pieces. It is driven once over a text; at each position the output links name every piece
that ends there, and each relaxes the best score of that position (Viterbi in one pass). Characters that
no piece covers fall back to their bytes, or to the unknown piece. Texts are cut where no piece goes across
and each distinct part is encoded once per worker.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.piece_model import MARK, PieceModel, piece_model
from plantscope.llm.registry import query, table

REMEMBERED = 300_000
SLICE = 2_000_000
#: What a character outside the pieces costs below the lowest score.
PENALTY = 10.0


class Automaton:
    """Trie of the pieces in arrays; failure links are followed while it is built, output links while it runs."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]  # (characters, id, score) of the piece that ends here
        for p, i in ids.items():
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(None)
                at = to
            self.piece[at] = (len(p), i, scores[p])
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)
        queue = list(self.next[0].values())
        for at in queue:
            for c, to in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                queue.append(to)
            f = self.fail[at]
            self.output[at] = f if self.piece[f] else self.output[f]
        self.low = min(scores.values(), default=0.0) - PENALTY

    def best(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of the segmentation with the largest sum of scores; id -1 for a character that no piece covers.

        Of equal sums the one that ends in the longer piece is taken, at every position.
        """
        score, back = [0.0], [(0, -1)]
        at = 0
        for end, c in enumerate(text, 1):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            top, via = score[end - 1] + self.low, (end - 1, -1)
            node = at if self.piece[at] else self.output[at]
            first = True
            while node:
                n, i, s = self.piece[node]
                total = score[end - n] + s
                if first and total >= top or total > top:
                    top, via, first = total, (end - n, i), False
                node = self.output[node]
            score.append(top)
            back.append(via)
        out, end = [], len(text)
        while end:
            start, i = back[end]
            out.append((start, end, i))
            end = start
        return out[::-1]


class Pieces:
    def __init__(self, model: PieceModel):
        self.model = model
        self.automaton = Automaton(model.scores, model.pieces)
        self.known: dict[str, tuple[int, ...]] = {}
        self.text = {i: p for p, i in model.pieces.items()}
        self.byte = {i: b for b, i in model.bytes.items()}

    def part(self, unit: str) -> tuple[int, ...]:
        ids: list[int] = []
        for a, b, i in self.automaton.best(unit):
            if i >= 0:
                ids.append(i)
            else:
                raw = unit[a:b].encode("utf-8", "surrogatepass")
                ids.extend(self.model.bytes[x] for x in raw) if self.model.bytes else ids.append(self.model.unknown)
        return tuple(ids)

    def encode(self, text: str | None) -> np.ndarray:
        out: list[int] = []
        for unit in self.model.units(text or ""):
            ids = self.known.get(unit)
            if ids is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                ids = self.known[unit] = self.part(unit)
            out.extend(ids)
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD, ids of the unknown piece too."""
        out = bytearray()
        for i in np.asarray(ids).tolist():
            if i in self.byte:
                out.append(self.byte[i])
            else:
                out += self.text.get(i, "�").encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def _pieces(path: str | None) -> Pieces:
    return Pieces(piece_model(path))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id_col, piece_ids) for every row: ids of the pieces of the whole text, without begin, end or added ids. No shuffle.

    NULL and empty texts have an empty list. Ids may be NULL or repeat; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pieces(model)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                yield pd.DataFrame({"id": part["id"].astype("Int64"), "piece_ids": [p.encode(t) for t in part["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, piece_ids array<int>").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "piece_ids", model: str | None = None) -> DataFrame:
    """(id_col, text) for every row of piece ids; NULL lists give NULL."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = _pieces(model)
        for s in batches:
            yield s.map(lambda x: None if x is None else p.decode(x))

    return rows.select(F.col(id_col), text(F.col(ids_col)).alias("text"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, their checksum, and whether decoding gives the text again (with U+2581 read as a space)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pieces(None)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                ids = p.encode(text)
                rows.append((i, len((text or "").encode()), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p.decode(ids) == (text or "").replace(MARK, " ")))
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])
            yield out.assign(id=out["id"].astype("Int64"))

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rows.mapInPandas(run, "id long, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean").withColumnRenamed("id", "doc_id")
