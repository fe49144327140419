"""Collocations: phrases of two and three words that occur together far more often than their parts do, per language.

A phrase that occurs ``least`` times has only neighbouring pairs that do, so pairs are settled before phrases are shuffled as text.
Texts are written once in slices of some million characters. Each slice sends the hashes of its distinct pairs of neighbouring words
with their counts, four bytes and one a pair, to the bucket of the hash; the bucket adds the counts up over all slices and answers
every slice with one bit a pair: may occur ``least`` times or not. Words get their bits in the same way. Pairs that share a hash
are added together, so a bit can be set too often but never be missing. A slice then sends its phrases of one to three words whose
words and pairs all have their bits, as packed text with exact counts, again by bucket, where they are added up; whatever occurs less
than ``least`` times goes there. Nothing is left out: counts of phrases that stay are over all their places.

A candidate's cuts then meet their parts: the left parts (which begin where the phrase begins) in prefix order, the right
parts (which end where it ends) in suffix order, and three-word candidates meet their two-word parts, which gives the
extension counts. All three meetings are sort-merge joins of sorted streams, hinted so that no hash table is built.
A part held by very many candidates, such as a frequent first word, is split across tasks by adaptive execution's
skew handling; the parts side is one row a key.

Scores are exact: ``1000000 * a * a`` and ``l * r`` are 38-digit decimals and their quotient is taken by integer division.
The first ``top`` of each language are chosen in two levels, first within salted groups, then within the language,
so no task sorts all candidates of a language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.llm.registry import query, table
from plantscope.llm.scratch import write_once

# fixed values of the contract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_BREAKS = re.compile(r"[.,;:!?\x0A-\x0D]")
UNKNOWN_LANG = "und"
LEAST, TOP, SCALE = 10, 2000, 1_000_000
#: Salted groups of a language in which the first ``top`` are chosen before the language is.
SALTS = 64
#: Characters of a slice of texts; a longer text is a slice of its own.
SLICE = 4_000_000
#: Characters of all texts to a bucket of hashes.
PER_BUCKET = 8_000_000
_OFFSET = np.uint64(0x9E3779B97F4A7C15)
_SLICES = "slice long, langs binary, lang_of binary, sizes binary, body binary"
_ASKED = "bucket int, slice long, keys binary, counts binary"
_ANSWER = "slice long, bucket int, bits binary"


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts, lower-cased in A-Z, as slices: each text by its length in bytes and the number of its language."""
    lower = str.maketrans(UPPER, LOWER)

    def packed(rows):
        langs = list(dict.fromkeys(lang for _, lang, _ in rows))
        number = {lang: k for k, lang in enumerate(langs)}
        texts = [t.encode() for _, _, t in rows]
        return pd.DataFrame({
            "slice": [rows[0][0]],
            "langs": [_joined(langs)],
            "lang_of": [np.array([number[lang] for _, lang, _ in rows], "<u4").tobytes()],
            "sizes": [np.array([len(t) for t in texts], "<u8").tobytes()],
            "body": [zlib.compress(b"".join(texts), 1)],
        })

    rows, size = [], 0
    for pdf in batches:
        for n, lang, text in zip(pdf["n"], pdf["lang"], pdf["text"]):
            if rows and size + len(text) > SLICE:
                yield packed(rows)
                rows, size = [], 0
            rows.append((n, lang, text.translate(lower)))
            size += len(text)
    if rows:
        yield packed(rows)


def _joined(words: list[str]) -> bytes:
    parts = [w.encode() for w in words]
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _parted(held: bytes) -> list[str]:
    n = int(np.frombuffer(held, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(held, "<u4", n, 4)).tolist()
    body = held[4 + 4 * n :]
    return [body[a:b].decode() for a, b in zip([0, *ends], ends)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Places:
    """The word places of a slice: ``words`` (language number, word) and, of every place, ``at`` (its word) and ``left`` (places to its piece's end)."""

    def __init__(self, langs: bytes, lang_of: bytes, sizes: bytes, body: bytes):
        self.langs = _parted(langs)
        at: list[int] = []
        lengths: list[int] = []
        held, begin = zlib.decompress(body), 0
        known: list[dict[str, int]] = [{} for _ in self.langs]  # the languages' words are numbered apart
        self.words: list[tuple[int, str]] = []
        for lang, size in zip(np.frombuffer(lang_of, "<u4").tolist(), np.frombuffer(sizes, "<u8").tolist()):
            numbers = known[lang]
            for piece in PIECE_BREAKS.split(held[begin : begin + size].decode().replace("\t", " ")):
                found = [w for w in piece.split(" ") if w]
                if not found:
                    continue
                for w in found:
                    k = numbers.get(w)
                    if k is None:
                        k = numbers[w] = len(self.words)
                        self.words.append((lang, w))
                    at.append(k)
                lengths.append(len(found))
            begin += size
        self.at = np.array(at, np.int64)
        ends = np.cumsum(lengths)
        self.left = np.repeat(ends, lengths) - np.arange(len(at))
        seeds = [zlib.crc32(x.encode()) for x in self.langs]
        texts = pd.util.hash_array(np.array([w for _, w in self.words], object), categorize=False) if self.words else np.zeros(0, np.uint64)
        own = np.array([seeds[k] for k, _ in self.words], np.uint64)
        self.hash = _mixed(texts + own * _OFFSET)

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, of so many bits, of the word of every place and of the pair that begins there; a place without one has the word's."""
        one = self.hash[self.at]
        two = one.copy()
        begin = np.flatnonzero(self.left > 1)
        two[begin] = _mixed(one[begin] * np.uint64(3) + one[begin + 1] + _OFFSET)
        down = np.uint64(64 - bits)
        return one >> down, two >> down

    def distinct(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, their counts, and for every place the places of its word and its pair among them."""
        one, two = self.keys(bits)
        paired = self.left > 1
        found, place, counts = np.unique(np.concatenate([one, two[paired]]), return_inverse=True, return_counts=True)
        second = place[: len(one)].copy()
        second[paired] = place[len(one) :]
        return found, counts, place[: len(one)], second


_BODY = ["langs", "lang_of", "sizes", "body"]


def _asking(buckets: int, least: int):
    """The distinct hashes of a slice with their counts, by bucket (their upper bits); only the lower 32 bits are sent."""
    bits, most = 32 + buckets.bit_length() - 1, min(least, 255)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, *rest in zip(pdf["slice"], *[pdf[c] for c in _BODY]):
                found, counts, _, _ = _Places(*rest).distinct(bits)
                counts = np.minimum(counts, most).astype(np.uint8) if least <= 255 else np.minimum(counts, 2**31).astype("<u4")
                cuts = np.searchsorted(found >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                low = found.astype("<u4")
                rows = [(k, number, low[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["bucket", "slice", "keys", "counts"])

    return run


def _answering(least: int):
    """The bits of every slice in one bucket: does the hash occur ``least`` times over all slices?"""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["keys"]])
        counts = np.concatenate([np.frombuffer(x, np.uint8 if least <= 255 else "<u4") for x in pdf["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        enough = np.add.reduceat(counts, starts, dtype=np.int64) >= least
        answer = np.empty(len(keys), bool)
        answer[order] = np.repeat(enough, np.diff(np.append(starts, len(keys))))
        ends = np.cumsum([len(x) // 4 for x in pdf["keys"]])
        return pd.DataFrame({
            "slice": pdf["slice"], "bucket": pdf["bucket"],
            "bits": [np.packbits(answer[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends)],
        })

    return run


def _telling(buckets: int):
    """Phrases of a slice whose words and pairs all have their bits, with their counts, by language and bucket."""
    bits = 32 + buckets.bit_length() - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for answers, *rest in zip(pdf["answers"], *[pdf[c] for c in _BODY]):
                places = _Places(*rest)
                if not len(places.at):
                    continue
                found, _, first, second = places.distinct(bits)
                cuts = np.searchsorted(found >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                enough = np.zeros(len(found), bool)
                for r in answers:
                    a, b = cuts[r["bucket"]], cuts[r["bucket"] + 1]
                    enough[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a)
                at = (found >> np.uint64(32)).astype(np.int64)
                yield _phrases(places, enough[first], enough[second] & (places.left > 1), at[first], at[second])

    return run


def _phrases(places: _Places, single: np.ndarray, pair: np.ndarray, one: np.ndarray, two: np.ndarray) -> pd.DataFrame:
    """The phrases at the places that ``single`` and ``pair`` mark, packed by language and bucket (``one`` for words, ``two`` for longer ones).

    Phrases that begin alike follow one another, so they pack well. The empty phrase holds the number of words of a language.
    """
    words, at = places.words, places.at
    lang = np.array([k for k, _ in words])
    held, totals = np.unique(lang[at], return_counts=True)
    texts, counts, langs, buckets = [""] * len(held), [totals], [held], [np.zeros(len(held), np.int64)]
    following = np.append(pair[1:], False)
    for size, begin in ((1, single), (2, pair), (3, pair & following & (places.left > 2))):
        spots = np.flatnonzero(begin)
        if not len(spots):
            continue
        rows = np.stack([at[spots + k] for k in range(size)])
        order = np.lexsort(rows[::-1])
        rows = rows[:, order]
        starts = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0))))
        texts += [" ".join([words[k][1] for k in key]) for key in rows[:, starts].T.tolist()]
        counts.append(np.diff(np.append(starts, len(spots))))
        langs.append(lang[rows[0, starts]])
        buckets.append((one if size == 1 else two)[spots[order[starts]]])
    count, lang, bucket = (np.concatenate(x) for x in (counts, langs, buckets))
    order = np.lexsort((bucket, lang))
    cuts = np.flatnonzero(np.diff(lang[order]) | np.diff(bucket[order])) + 1
    out = []
    for some in np.split(order, cuts):
        body = "\n".join([texts[k] for k in some.tolist()]).encode()  # no word holds a line feed, and no phrase of words is empty
        out.append((places.langs[lang[some[0]]], int(bucket[some[0]]), zlib.compress(body, 1), zlib.compress(count[some].astype("<u8").tobytes(), 1)))
    return pd.DataFrame(out, columns=["lang", "bucket", "phrases", "counts"])


def _adding(least: int):
    """Exact counts of the phrases of one language and bucket over all slices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f: dict[str, int] = {}
        for body, counts in zip(pdf["phrases"], pdf["counts"]):
            for p, n in zip(zlib.decompress(body).decode().split("\n"), np.frombuffer(zlib.decompress(counts), "<u8").tolist()):
                f[p] = f.get(p, 0) + n
        rows = [(p, p.count(" ") + 1 if p else 0, n) for p, n in f.items() if n >= least or not p]
        out = pd.DataFrame(rows, columns=["phrase", "size", "f"])
        out.insert(0, "lang", pdf["lang"].iloc[0])
        return out

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, f): phrases of one to three words that occur ``least`` times or more; size 0 holds the number of words.

    A-Z are lower-cased, NULL texts have no words, NULL languages are ``und``. The slices are written once, as both passes must see
    the same ones; a slice is named by the row number of its first text.
    """
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG))
    rows = docs.select(F.monotonically_increasing_id().alias("n"), lang.alias("lang"), text.alias("text"))
    slices = write_once(rows.mapInPandas(_sliced, _SLICES), "slices")
    total = slices.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = 1 << max(4, int(3 * total // PER_BUCKET).bit_length())
    asked = slices.mapInPandas(_asking(buckets, least), _ASKED)
    answers = asked.groupBy("bucket").applyInPandas(_answering(least), _ANSWER)
    by_slice = answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    told = slices.join(by_slice.hint("merge"), "slice").mapInPandas(_telling(buckets), "lang string, bucket int, phrases binary, counts binary")
    return told.groupBy("lang", "bucket").applyInPandas(_adding(least), "lang string, phrase string, size int, f long")


def exact_score(a: str = "a", l: str = "l", r: str = "r") -> Column:
    """``floor(1000000 a^2 / (l r))`` of the named long columns, in 38-digit decimals and integer division; no double on the way."""
    big = "decimal(38,0)"
    return F.expr(f"(cast({a} as {big}) * cast({a} as {big}) * cast({SCALE} as {big})) div (cast({l} as {big}) * cast({r} as {big}))")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` collocations of each language.

    Texts are lower-cased in A-Z only, cut at ``. , ; : ! ?`` and line breaks (0x0A-0x0D) into pieces, and those at spaces and tabs
    into words. n: word occurrences of the language; a: occurrences of the phrase inside pieces, overlaps included. Candidates have
    two or three words and a >= ``least``. Of the cuts after the first k words, with l and r the counts of the two parts, the one of
    lowest ``floor(1000000 a^2 / (l r))`` counts, ties to the smallest k. A two-word candidate that begins or ends a three-word
    candidate with ``100 f >= 50 a`` goes. Order: score, then a, descending, then phrase in UTF-8 byte order; rank from 1.

    NULL texts have no words; NULL languages are ``und``; repeated rows count as often as they occur; other columns are not looked
    at; an empty table or one without candidates gives an empty result.
    """
    counts = write_once(phrase_counts(docs, text_col, lang_col, least), "phrase-counts")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    candidates = counts.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left_part"),
        F.array_join(F.slice("w", F.col("k") + 1, F.lit(3)), " ").alias("right_part"))
    parts = counts.where("size between 1 and 2")
    left = parts.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    met = cuts.join(left.hint("merge"), ["lang", "left_part"]).join(right.hint("merge"), ["lang", "right_part"])
    scored = met.withColumn("score", exact_score())
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select(
        "lang", "phrase", "a", "b.l", "b.r", "b.score")
    longer = candidates.where(F.size("w") == 3).select(
        "lang", F.col("a").alias("f3"), F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    extended = longer.groupBy("lang", "phrase").agg(F.max("f3").alias("f3"))
    kept = best.join(extended.hint("merge"), ["lang", "phrase"], "left").where(F.col("f3").isNull() | (100 * F.col("f3") < 50 * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\t]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d)),
g AS (
  SELECT lang, unnest(list_concat(list_concat(
    list_transform(range(1, len(w) + 1), lambda i: w[i]),
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase
  FROM p),
c AS (SELECT lang, phrase, count(*) AS f FROM g GROUP BY lang, phrase),
nn AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
cand AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE f >= 10 AND len(string_split(phrase, ' ')) >= 2),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM cand)),
sc AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.k, cl.f AS l, cr.f AS r,
         (1000000::HUGEINT * cuts.a * cuts.a) // (cl.f::HUGEINT * cr.f) AS score
  FROM cuts JOIN c cl ON cl.lang = cuts.lang AND cl.phrase = cuts.lp JOIN c cr ON cr.lang = cuts.lang AND cr.phrase = cuts.rp),
best AS (
  SELECT lang, phrase, a, l, r, score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc) WHERE o = 1),
ext AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS sub, a AS f3 FROM cand WHERE len(w) = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS sub, a AS f3 FROM cand WHERE len(w) = 3),
kept AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.lang = b.lang AND e.sub = b.phrase AND 100 * e.f3 >= 50 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (
  SELECT kept.lang, kept.phrase, kept.a::BIGINT AS a, kept.l::BIGINT AS l, kept.r::BIGINT AS r, nn.n::BIGINT AS n,
         kept.score::BIGINT AS score,
         row_number() OVER (PARTITION BY kept.lang ORDER BY kept.score DESC, kept.a DESC, kept.phrase) AS rank
  FROM kept JOIN nn ON nn.lang = kept.lang)
WHERE rank <= 2000
"""


@query("op11_phrase_collocations", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
