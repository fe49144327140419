"""Token ids of whole texts by the tokenizers library, each distinct part of a text encoded once per worker.

A text is cut only where the library's own pre-tokenizer would cut as well, so the ids of its parts,
one after another, are the ids of the text.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import public_tokenizers

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Parts a worker remembers; beyond it, it starts afresh.
REMEMBERED = 2_000_000
SLICE = 2_000_000
_MARK = "\0"
#: Neither an apostrophe, which may begin a contraction, nor what special tokens are made of.
_SIGNS = ".,;:!?#$%&*"
_WORD_STARTS = re.compile(r"(?<=\S)(?= )")


class _Numbers(dict):
    """Numbers parts in the order of their first lookup."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part):
        self[part] = n = len(self)
        self.new.append(part)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_bytes = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and "Split" not in str(self.tokenizer.pre_tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # ids that begin a word after a space, or end a word
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t[:1] == "Ġ" if self.by_bytes else t[-4:] == "</w>")]] = True
        self.forget()

    def forget(self):
        """Drops all remembered parts."""
        self.numbers = _Numbers()
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.end = 0

    def units(self, text: str) -> list[str]:
        """Parts of the text. A part stands for itself with a space before it, but a mark at its start says that it stands for itself alone."""
        if not self.by_bytes:  # white space only separates words
            if "<|" not in text:
                try:  # letters up to U+00FF are the same to the library in lower case
                    text.encode("latin-1")
                    text = text.lower()
                except UnicodeEncodeError:
                    pass
            return text.replace("\n", " ").split(" ")
        flat = text.replace("\n", " ")
        if not flat.isprintable() or "  " in flat or flat[:1] in ("", " ") or flat[-1] == " ":
            return [_MARK + u for u in _WORD_STARTS.split(text)]
        # every space and line feed stands alone between other characters, and there is no other white space
        return (_MARK + text.replace("\n", f" {_MARK}\n")).split(" ")

    def _flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has.

        Words of letters are one pre-token each, so the library gets many of them as one text; where one
        ends shows in its ids. The other words are texts of their own.
        """
        plain = [k for k, w in enumerate(words) if (x := w[1:] if self.by_bytes and w[:1] == " " else w).isalpha() and (w[:1] == " ") == self.by_bytes and (x.isascii() or max(x) < "\u0100")]
        glue = "" if self.by_bytes else "\n"
        lines = [glue.join([words[k] for k in plain[i : i + 200]]) for i in range(0, len(plain), 200)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        edge = np.flatnonzero(self.edge[ids])
        if len(edge) != len(plain):
            raise ValueError("a word of letters is not one pre-token to this tokenizer")
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = np.diff(edge, append=len(ids)) if self.by_bytes else np.diff(edge, prepend=-1)
        seen = np.zeros(len(words), bool)
        seen[plain] = True
        rest = np.flatnonzero(~seen)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        sizes[rest] = np.fromiter(map(len, found), np.int64, len(found))
        out = np.zeros(int(sizes.sum()), np.uint32)
        of_plain = np.repeat(seen, sizes)
        out[of_plain] = ids
        out[~of_plain] = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        return out, sizes

    def _learn(self, n: int):
        new, self.numbers.new = self.numbers.new, []
        # signs after a letter are a pre-token of their own, so the word before them is encoded once for all
        stems = [s if (s := u.rstrip(_SIGNS))[-1:].isalpha() and s[-1:] < "\u0100" else u for u in new]
        ended = np.fromiter(map(len, stems), np.int64, len(new)) < np.fromiter(map(len, new), np.int64, len(new))
        alone = _MARK if self.by_bytes else ""
        signs = [alone + new[k][len(stems[k]) :] for k in np.flatnonzero(ended)]
        known: dict[str, int] = {}
        at = np.arange(len(new)) + np.cumsum(ended) - ended  # where each part's words begin
        of = np.zeros(len(new) + len(signs), np.int64)
        of[at] = np.fromiter((known.setdefault(u, len(known)) for u in stems), np.int64, len(stems))
        of[at[ended] + 1] = np.fromiter((known.setdefault(u, len(known)) for u in signs), np.int64, len(signs))
        words = list(known)
        if self.by_bytes:
            words = [u[1:] if u[:1] == _MARK else " " + u for u in words]
        flat, sizes = self._flat(words)
        each = sizes[of]  # a part is one word, or one and its signs
        total = int(each.sum())
        out = flat[np.arange(total) + np.repeat((np.cumsum(sizes) - sizes)[of] - (np.cumsum(each) - each), each)]
        size = np.add.reduceat(each, at)
        while n + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.end + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.end : self.end + total] = out
        self.size[n : n + len(new)] = size
        self.start[n : n + len(new)] = self.end + np.cumsum(size) - size
        self.end += total

    def _settle(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        n = len(self.numbers)
        parts = [self.units(t) for t in texts]
        at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(parts)), np.int64)
        if self.numbers.new:
            self._learn(n)
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)]
        cuts = np.concatenate([[0], ends])[np.cumsum([len(p) for p in parts])]
        return np.split(ids, cuts[:-1])

    def encode(self, texts):
        """Yields an array of ids for each text; NULL counts as empty."""
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > SLICE:
                yield from self._settle(held)
                held, size = [], 0
        if held:
            yield from self._settle(held)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """``path``: a tokenizer's file, or the name of one of the public ones."""
    return Encoder(path if os.path.sep in path else public_tokenizers.path(path))
