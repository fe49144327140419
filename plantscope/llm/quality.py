"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Everything per text is one projection of built-in functions, without a shuffle.
What reaches the driver is the number of texts for each pattern of votes, at
most 3 ** (number of rules) rows whatever the corpus holds; expectation-maximisation
runs on those counts and covers all texts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.registry import query, table
from plantscope.session import materialize

SPACES = r"[\x20\x09-\x0D]"
WINDOW = 5
#: A word of letters, with marks inside it or punctuation after it, or a number.
PLAIN = r"""^["'(]?(\p{L}[\p{L}\p{M}'’-]*|[0-9][0-9.,:]*)[.,;:!?"')]*$"""
#: Pseudo-counts of the EM: a rule that never errs in the data isn't taken for infallible.
PRIOR = 1.0

#: (name, says that a text is bad, says that it is good); between the two a rule abstains.
RULES = (
    ("length", "n_words < 10", "n_words >= 50"),
    ("repetition", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words and n_words >= 10"),
    ("lines", "100 * n_dup_lines > 40 * n_lines", "100 * n_dup_lines <= 10 * n_lines and n_lines >= 3"),
    ("symbols", "100 * n_symbols > 20 * n_words", "100 * n_symbols <= 3 * n_words and n_words > 0"),
    ("plain_words", "100 * n_plain_words < 70 * n_words", "100 * n_plain_words >= 90 * n_words and n_words > 0"),
    ("capitals", "100 * n_capitals > 25 * word_chars", "100 * n_capitals <= 10 * word_chars and word_chars > 0"),
    ("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words and n_words > 0"),
)


def text_features(docs: DataFrame, text_col: str = "text", into: str = "quality_features") -> DataFrame:
    """``docs`` with a struct of counts over the whole text; NULL counts as empty.

    Repeated windows are found by 64-bit hashes of five words. Only texts in
    which a hash occurs twice have their windows sorted.
    """
    names = docs.columns
    taken = {c.lower() for c in names}

    def free(name):  # a name that no column of docs has
        while name.lower() in taken:
            name = f"_{name}"
        return name

    t, w, h, s, p = (free(f"_{x}") for x in ("text", "words", "windows", "sorted", "places"))
    q = lambda c: F.col(f"`{c.replace('`', '``')}`")
    step = docs.withColumn(t, F.coalesce(q(text_col).cast("string"), F.lit("")))
    step = step.withColumn(w, F.filter(F.split(t, SPACES + "+"), lambda x: x != ""))
    hashes = free("_hashes")
    step = step.withColumn(hashes, F.transform(w, lambda x: F.xxhash64(x)))
    step = step.withColumn(h, F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))),
    )).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    step = step.withColumn(p, F.array_sort(F.transform(F.filter(
        s, lambda x, j: (x["h"] == F.get(F.col(s), j - 1)["h"]) | (x["h"] == F.get(F.col(s), j + 1)["h"]),
    ), lambda x: x["i"])))
    lines = free("_lines")
    step = step.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain_words"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    return step.select(*[q(c) for c in names], counts.alias(into))


def _inside(rule: str, struct: str) -> Column:
    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"{struct}.\1", rule))


def vote_pattern(struct: str, rules=RULES) -> Column:
    """The votes as one number: digit k in base 3 is 0 if rule k abstains, 1 if it says bad, 2 if it says good."""
    total = F.lit(0)
    for k, (_, bad, good) in enumerate(rules):
        total = total + F.when(_inside(bad, struct), 1).when(_inside(good, struct), 2).otherwise(0) * 3**k
    return total


def base_failed(struct: str) -> Column:
    return _inside("n_words < 10 or 100 * n_repeat_words > 20 * n_words", struct)


def expectation_maximisation(counts: dict[int, int], n_rules: int, rounds: int = 200) -> tuple[list[float], float, list[list[list[float]]]]:
    """Posterior of being good for every vote pattern, the share of good texts, and P(vote | class) of each rule.

    Two classes; given the class, rules err independently; an abstention says nothing.
    Starts from texts with any bad vote being probably bad. Without texts every posterior is one half or follows the prior.
    """
    digits = {p: [(p // 3**k) % 3 for k in range(n_rules)] for p in range(3**n_rules)}
    good = {p: 0.1 if 1 in digits[p] else 0.9 for p in counts}
    share, table_ = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(n * good[p] for p, n in counts.items()) + PRIOR) / (total + 2 * PRIOR)
        table_ = []
        for k in range(n_rules):
            row = []
            for cls in (0, 1):
                hit = [PRIOR * (1 if cls else 2), PRIOR * (2 if cls else 1)]  # a rule is right rather than wrong
                for p, n in counts.items():
                    if v := digits[p][k]:
                        hit[v - 1] += n * (good[p] if cls else 1 - good[p])
                row.append([x / sum(hit) for x in hit])
            table_.append(row)

        def posterior(p):
            odds = math.log(share) - math.log(1 - share)
            for k, v in enumerate(digits[p]):
                if v:
                    odds += math.log(table_[k][1][v - 1]) - math.log(table_[k][0][v - 1])
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))

        new = {p: posterior(p) for p in counts}
        moved = max((abs(new[p] - good[p]) for p in counts), default=0.0)
        good = new
        if moved < 1e-9:
            break
    return [posterior(p) for p in range(3**n_rules)], share, table_


def fit(features: DataFrame, struct: str = "quality_features") -> list[float]:
    """Posteriors by vote pattern, from the votes on all rows of ``features``."""
    found = features.groupBy(vote_pattern(struct).alias("pattern")).count().collect()  # at most 3 ** len(RULES) rows
    return expectation_maximisation({r["pattern"]: r["count"] for r in found}, len(RULES))[0]


def good_probability(posteriors: list[float], struct: str = "quality_features") -> Column:
    return F.get(F.array(*[F.lit(x) for x in posteriors]), vote_pattern(struct))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, counts, base_failed, good_probability, kept) for every row of ``docs``.

    NULL, empty and blank texts have no words and fail. Ids may be NULL or repeat: every row is judged by its own text. Other
    columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    features = materialize(text_features(rows, "text", "f").select("id", "f"), "quality")
    scored = features.select(F.col("id").alias(id_col), "f.*", base_failed("f").alias("base_failed"), good_probability(fit(features, "f"), "f").alias("good_probability"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= least))


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; texts are read twice and never shuffled."""
    taken = {c.lower() for c in docs.columns}
    name, number = "_q", "_n"
    while name in taken:
        name = f"_{name}"
    while number in taken:
        number = f"_{number}"
    features = text_features(docs, text_col, name)
    posteriors = fit(features, name)
    # the row number, which the filter names, keeps the optimizer from repeating the counts inside it
    numbered = features.withColumn(number, F.monotonically_increasing_id())
    good = ~base_failed(name) & (good_probability(posteriors, name) >= least)
    return numbered.where((F.col(number) >= 0) & good).drop(name, number)


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))
