"""The vocabulary of a sentencepiece model as plain tables, and the safe places to cut a text for it."""

from __future__ import annotations

import functools
import re

import public_tokenizers

MARK = "▁"
DEFAULT = "piece_bpe_32k.model"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceModel:
    """Ordinary pieces with their ids and scores, ids of the byte pieces, and the unknown id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.pieces = {sp.id_to_piece(i): i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.scores = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        probe = "a\tb  ﬁ  c "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models that keep texts as they are, with a leading mark, are supported")
        # a text may be cut before a mark, and around a line feed, where no piece goes across
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.pieces) and not any("\n" in p for p in self.pieces)

    def units(self, text: str) -> list[str]:
        """The marked text in parts that no piece goes across; joined, they are the marked text."""
        if not text:
            return []
        if not self.cut:
            return [MARK + text.replace(" ", MARK)]
        spread = text.replace("\n", " \n")
        if "  " in spread or spread[0] == " " or MARK in text:
            return _RUNS.findall(MARK + text.replace(" ", MARK))
        return [u if u[:1] == "\n" else MARK + u for u in spread.split(" ")]


@functools.lru_cache(maxsize=2)
def piece_model(path: str | None = None) -> PieceModel:
    return PieceModel(path or public_tokenizers.path(DEFAULT))
