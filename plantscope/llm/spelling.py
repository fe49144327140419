"""Spelling variants: words that differ by one edit from a word used at least twice as often, grouped under it.

Candidates come from asymmetric q-chunks. Of a pair at one edit, let s be the longer word (or either, if equal): s gives
two disjoint chunks, its first and its last ``len(s) // 2`` code points, and t gives all its positional grams of those lengths.
One edit (a replacement, or the deletion that turns s into t) touches at most one of the two chunks, and moves the other by
at most one place to the left. So s's chunks are joined with t's grams on (gram, place) for the shifts 0 and -1, and the
join keeps only pairs at exactly one edit by Spark's bounded Levenshtein distance; no pair of a chunk's group is written
out unless it is near. A word's form is its most frequent near word, if that is at least twice as frequent; roots follow forms by
pointer jumping, each round written to the shared folder, and since counts at least double along a chain, rounds are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.registry import query, table
from plantscope.llm.scratch import discard, write_once

# fixed values of the contract
RUN = r"[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MODULUS, LEAST_LENGTH, LEAST_COUNT, FACTOR = 97, 5, 3, 2


def spelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): one row per run of letters of every text, A-Z lower-cased, with the contract's deterministic deletion applied.

    h = unsigned crc32 of the UTF-8 of ``<id>:<run>``; when 97 divides h, the code point at h mod length goes. A NULL id gives no h,
    and the run stays as it is. NULL texts have no runs.
    """
    runs = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(F.regexp_extract_all(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run")).cast("binary")))
    k = F.col("h") % F.char_length("run")
    cut = F.concat(F.expr("substr(run, 1, h % char_length(run))"), F.expr("substr(run, h % char_length(run) + 2)"))
    return hashed.select(F.when((F.col("h") % MODULUS == 0) & k.isNotNull(), cut).otherwise(F.col("run")).alias("word"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): both orders of every pair of ``words`` (word, n, size) at exactly one inserted, deleted or replaced code point."""
    q = F.floor(F.col("size") / 2).cast("int")
    chunks = words.select("word", "size", F.explode(F.array(
        F.struct(F.expr("substr(word, 1, size div 2)").alias("chunk"), F.lit(0).alias("place")),
        F.struct(F.expr("substr(word, size - size div 2 + 1)").alias("chunk"), (F.col("size") - q).alias("place")),
    )).alias("c")).select("word", "size", "c.chunk", F.explode(F.array(F.col("c.place"), F.col("c.place") - 1)).alias("place"))
    chunks = chunks.where("place >= 0")
    # t's grams of the lengths that a longer or equal s may use: size // 2 and (size + 1) // 2
    lengths = F.array_distinct(F.array(F.floor(F.col("size") / 2), F.floor((F.col("size") + 1) / 2)).cast("array<int>"))
    grams = words.select(F.col("word").alias("other"), F.col("size").alias("other_size"), F.explode(lengths).alias("q")).select(
        "other", "other_size", F.explode(F.sequence(F.lit(0), F.col("other_size") - F.col("q"))).alias("place"), "q").select(
        "other", "other_size", "place", F.expr("substr(other, place + 1, q)").alias("chunk"))
    met = chunks.join(grams, ["chunk", "place"]).where(
        (F.col("size") - F.col("other_size")).between(0, 1) & (F.col("word") != F.col("other"))
        & (F.levenshtein("word", "other", 1) == 1))
    one = met.select("word", "other").distinct()
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of at least 5 code points met at least 3 times in all texts.

    n: occurrences; n_near: words at exactly one edit (code points); form: of those, the one of largest n, ties to the smallest
    in code-point order, if its n is at least twice the word's, else NULL; form_n its n; root: the last word on the chain of forms,
    the word itself when it has none. Repeated rows count as often as they occur; other columns are not looked at; an empty
    table gives an empty result.
    """
    counted = spelled(docs, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = write_once(counted.where((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
                       .withColumn("size", F.char_length("word")), "spelling-words")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"))
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("b.m") >= FACTOR * F.col("n"), F.col("b.other")).alias("form"),
        F.when(-F.col("b.m") >= FACTOR * F.col("n"), -F.col("b.m")).cast("long").alias("form_n"))
    forms = write_once(rows.withColumn("root", F.coalesce("form", "word")), "spelling-forms")
    roots, old = forms.select("word", "root"), None
    while True:  # pointer jumping: a word's root becomes its root's root; the chains at most halve each round
        step = roots.alias("a").join(roots.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(
            F.col("a.word"), F.coalesce(F.col("b.root"), F.col("a.root")).alias("root"), (F.col("b.root") != F.col("a.root")).alias("moved"))
        step = write_once(step, "spelling-roots")
        if old is not None:
            discard(old)
        roots = old = step
        if not step.where("moved").limit(1).count():
            break
    out = forms.drop("root").join(roots.select("word", "root"), "word")
    return out.select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
