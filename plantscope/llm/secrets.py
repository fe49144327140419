"""Secrets in texts: fixed patterns, and Markov models of characters that tell random strings from identifiers.

All of it is built-in functions. Matches keep their places because a text split
by a pattern and the list of what the pattern matched have lengths that add up.
The two models are tables of transitions between characters, and between kinds of characters,
counted from labelled strings; a candidate is a secret where the random model
explains it so much better that the ratio of likelihoods, per character and in all, passes two limits.
Where a run of candidate characters fails as a whole, its segments between separators and its best-scoring stretches are judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.registry import query, table

# Fixed patterns of the contract; the letters of the first in either case.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: runs, so the length may stand in the pattern
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
CANDIDATE = r"[A-Za-z0-9+/=_-]{16,}"
#: Labelled strings used for training, at most so many of each class.
SAMPLE = 20_000
#: Candidates need this log-likelihood ratio in all, and on average per character.
LEAST_TOTAL, LEAST_MEAN = 10.0, 0.35
LEAST_LENGTH = 16
SEPARATORS = "/=_-"  # join a random string to the text beside it


def labelled_strings(spark: SparkSession, docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(value, is_random): strings drawn at random from three alphabets, and identifiers made of the corpus' words.

    The random ones come from SHA-512 of a counter, written in base 64 (and its letters and digits only). Identifiers
    are words of the ``sample`` texts with the smallest hashes, alone and joined as snake_case, camelCase, kebab-case and paths.
    Bounded by ``sample``; labels follow from how the strings are made.
    """
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 512)
    base64 = F.base64(F.unhex(digest))
    drawn = spark.range(sample // 2).select(F.explode(F.array(
        F.substring(base64, 1, 40), F.substring(F.regexp_replace(base64, "[+/=]", ""), 1, 32),
    )).alias("value"), F.lit(True).alias("is_random"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")).orderBy(F.xxhash64("t"), "t").limit(sample // 100)
    words = texts.select(F.expr(rf"filter(split(regexp_replace(t, '{ASSIGN.replace(chr(39), chr(92) + chr(39))}', ' '), '[^A-Za-z]+'), x -> length(x) between 2 and 14)").alias("w"))
    words = words.where(F.size("w") >= 3).select(F.explode(F.sequence(F.lit(0), F.least(F.size("w") - 3, F.lit(99)))).alias("i"), "w")
    three = [F.get(F.col("w"), F.col("i") + k) for k in range(3)]
    named = words.select(F.explode(F.array(
        F.lower(F.concat_ws("_", *three)), F.concat(F.lower(three[0]), F.initcap(three[1]), F.initcap(three[2])),
        F.lower(F.concat_ws("-", *three)), F.concat_ws("/", *three), F.upper(F.concat_ws("_", *three[:2])),
        F.concat(F.initcap(three[0]), F.initcap(three[1]), (F.col("i") % 100).cast("string")),
    )).alias("value"), F.lit(False).alias("is_random")).limit(sample)
    return drawn.unionByName(named)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of every step between two characters of ALPHABET (row by row), smoothed by one.

    ``labelled``: (value, is_random). Only the counts, at most two for each pair of characters, reach the driver.
    NULL values and characters outside the alphabet are passed over.
    """
    chars = labelled.where("value is not null and is_random is not null").select("is_random", F.split("value", "").alias("c"))
    steps = chars.where(F.size("c") >= 2).select("is_random", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> concat(get(c, i - 1), get(c, i)))")).alias("step"))
    counts = {(r["is_random"], r["step"]): r["count"] for r in steps.where(F.col("step").rlike("^[A-Za-z0-9+/=_-]{2}$")).groupBy("is_random", "step").count().collect()}
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in ALPHABET]
    size = {k: kind.count(k) for k in kind}
    log: dict[bool, list[float]] = {}
    for cls in (True, False):
        n = [[counts.get((cls, a + b), 0) + 1 for b in ALPHABET] for a in ALPHABET]
        by_kind: dict[tuple[str, str], int] = {}
        for a, row in zip(kind, n):
            for b, x in zip(kind, row):
                by_kind[a, b] = by_kind.get((a, b), 0) + x
        total = {a: sum(x for (k, _), x in by_kind.items() if k == a) for a in size}
        # half of the weight goes to kinds of characters, for letters that training has seldom seen together
        log[cls] = [math.log(0.5 * x / sum(row) + 0.5 * by_kind[a, b] / total[a] / size[b]) for a, row in zip(kind, n) for b, x in zip(kind, row)]
    return [r - o for r, o in zip(log[True], log[False])]


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, by code points, end exclusive; empty where there is none."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    sizes = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(sizes, 1, F.size(found)).alias("gap")), none,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))).alias("out")))
    return F.when(F.rlike(text, p), walked["out"]).otherwise(none["out"])


def _of_kind(k: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))


_SPANS = "array<struct<start:int,end:int>>"


def _uncovered(run: Column, base: Column) -> Column:
    """Array of (start, end): what is left of a run without the matches in ``base`` (sorted by start), separators beside them taken off."""
    none = F.struct(run["start"].alias("at"), F.array().cast(_SPANS).alias("out"))
    upto = lambda acc, end: F.when(end > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))).cast(_SPANS))).otherwise(acc["out"])
    return F.aggregate(
        F.filter(base, lambda y: (run["start"] < y["end"]) & (y["start"] < run["end"])), none,
        lambda acc, y: F.struct(F.greatest(acc["at"], y["end"]).alias("at"), upto(acc, y["start"]).alias("out")),
        lambda acc: upto(acc, run["end"]))


def _parts(run: Column, base: Column) -> Column:
    """The uncovered parts of a run as (start, end, value), long enough ones only."""
    cut = F.transform(_uncovered(run, base), lambda y: F.struct(
        y["start"].alias("start"), y["end"].alias("end"), F.substring(run["value"], y["start"] - run["start"] + 1, y["end"] - y["start"]).alias("value")))
    # a part that begins behind a match loses the separators before it
    lead = lambda y: F.when(y["start"] > run["start"], F.length(F.regexp_extract(y["value"], f"^[{SEPARATORS}]*", 0))).otherwise(0)
    cut = F.transform(cut, lambda y: F.struct((y["start"] + lead(y)).alias("start"), y["end"].alias("end"), F.substring(y["value"], lead(y) + 1, F.length(y["value"])).alias("value")))
    return F.filter(cut, lambda y: y["end"] - y["start"] >= LEAST_LENGTH)


def _ratios(codes: Column, model: str) -> Column:
    """The model's ratio of the step to each character; 0 for the first."""
    return F.transform(codes, lambda c, i: F.when(i == 0, 0.0).otherwise(F.coalesce(F.get(F.col(model), F.get(codes, i - 1) * len(ALPHABET) + c), F.lit(0.0))))


def _total(ratios: Column) -> Column:
    return F.aggregate(ratios, F.lit(0.0), lambda acc, r: acc + r)


def _passes(total: Column, length: Column) -> Column:
    return (total >= LEAST_TOTAL) & (total >= LEAST_MEAN * length)


def _stretches(ratios: Column) -> Column:
    """Array of (start, end) of all stretches whose ratios pass: a running sum ends where it falls to zero or LEAST_TOTAL below its maximum."""
    none = F.struct(
        F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), F.array().cast(_SPANS).alias("out"))
    closed = lambda acc: F.when(
        _passes(acc["best"], acc["end"] - acc["start"]), F.concat(acc["out"], F.array(F.struct(acc["start"], acc["end"])).cast(_SPANS))).otherwise(acc["out"])

    def step(acc, r):
        now = acc["sum"] + r
        ends = (now <= 0) | (acc["best"] - now >= LEAST_TOTAL)
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(ends, 0.0).otherwise(now).alias("sum"), F.when(ends, acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(ends, 0.0).otherwise(F.greatest(acc["best"], now)).alias("best"),
            F.when(ends | (now > acc["best"]), acc["at"] + 1).otherwise(acc["end"]).alias("end"), F.when(ends, closed(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ratios, none, step, closed)


def _segments(x: Column) -> Column:
    """Array of (start, end) of the segments of a part that pass by themselves. Steps from and to separators are not theirs."""
    pieces = F.split(x["value"], f"[{SEPARATORS}]", -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc, piece):
        n = F.length(piece)
        total = _total(F.slice(x["ratios"], acc["at"] + 2, F.greatest(n - 1, F.lit(0))))
        good = F.when(n >= LEAST_LENGTH, _passes(total, n)).otherwise(False)
        return F.struct((acc["at"] + n + 1).alias("at"), F.when(good, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))).cast(_SPANS))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, none, step, lambda acc: acc["out"])


def _random_in(x: Column) -> Column:
    """Array of (start, end) inside a part: all of it where it passes as a whole, else its random segments and stretches, overlapping ones as one."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(x["value"]).alias("end"))).cast(_SPANS)
    # a stretch covers the segments in which it begins and ends
    wide = F.transform(_stretches(x["ratios"]), lambda y: F.struct(
        (y["start"] - F.length(F.regexp_extract(F.substring(x["value"], F.lit(1), y["start"]), f"[^{SEPARATORS}]*$", 0))).alias("start"),
        (y["end"] + F.length(F.regexp_extract(F.substring(x["value"], y["end"] + 1, F.length(x["value"])), f"^[^{SEPARATORS}]*=*", 0))).alias("end")))
    both = F.array_sort(F.concat(_segments(x), F.filter(wide, lambda y: y["end"] - y["start"] >= LEAST_LENGTH)).cast(_SPANS))
    none = F.array().cast(_SPANS)
    joined = F.aggregate(both, none, lambda acc, y: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > y["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], y["end"]).alias("end"))).cast(_SPANS)),
    ).otherwise(F.concat(acc, F.array(y).cast(_SPANS))))
    return F.when(_passes(_total(x["ratios"]), F.length(x["value"])), whole).otherwise(joined)


def find_secrets(docs: DataFrame, model: list[float], text_col: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array of (start, kind, end, value): every match of the patterns, and the random strings beside them.

    Places count code points from 0, the end is exclusive; the array is sorted by start, then by kind as in KINDS, whose index
    ``kind`` is. An ``assign`` match counts when what is assigned has 6 characters or more. A random string is 16 or more
    characters of ALPHABET that overlap no pattern's match: what is left of a run beside the matches, or segments and stretches of that. NULL and empty texts have an empty array.
    The column ``into`` must be new; all other columns stay. No shuffle.
    """
    q = lambda c: F.col(f"`{c.replace('`', '``')}`")
    taken = {c.lower() for c in docs.columns}

    def free(name):
        while name.lower() in taken:
            name = f"_{name}"
        return name

    t, m, base, more, like = (free(x) for x in ("_text", "_model", "_base", "_more", "_like"))
    shape = "array<struct<start:int,kind:int,end:int,value:string>>"
    step = docs.withColumn(t, F.coalesce(q(text_col).cast("string"), F.lit(""))).withColumn(m, F.array(*[F.lit(x) for x in model]))
    tagged = []
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        found = _places(F.col(t), pattern)
        if k == 0:
            found = F.filter(found, lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6)
        c = free(f"_kind{k}")
        step = step.withColumn(c, found)
        tagged.append(F.transform(c, _of_kind(k)))
    step = step.withColumn(base, F.concat(*tagged).cast(shape))
    step = step.withColumn(like, _places(F.col(t), CANDIDATE))
    parts = F.flatten(F.transform(like, lambda x: _parts(x, F.array_sort(F.col(base)))))
    coded = F.transform(parts, lambda x: F.struct(
        x["start"].alias("start"), x["value"].alias("value"), F.transform(F.split(x["value"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1).alias("codes")))
    rated = F.transform(coded, lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), _ratios(x["codes"], m).alias("ratios")))
    step = step.withColumn(more, F.flatten(F.transform(rated, lambda x: F.transform(_random_in(x), lambda y: F.struct(
        (x["start"] + y["start"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + y["end"]).alias("end"),
        F.substring(x["value"], y["start"] + 1, y["end"] - y["start"]).alias("value"))))))
    only = F.col(more).cast(shape)
    return step.select(*[q(c) for c in docs.columns], F.array_sort(F.concat(base, only)).alias(into))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans, found) for every row of ``docs``.

    ``found`` holds the spans with their values. Ids may be NULL or repeat; other columns are not looked at.
    """
    if model is None:
        model = train(labelled_strings(docs.sparkSession, docs, text_col))
    rows = find_secrets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, into="found")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == F.lit(k))).cast("long")
    base = written(F.filter("found", lambda x: x["kind"] < 3))
    return rows.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), "found")


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); NULL texts stay NULL, all columns keep their places."""
    if model is None:
        model = train(labelled_strings(docs.sparkSession, docs, text_col))
    name = "_spans"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    q = lambda c: F.col(f"`{c.replace('`', '``')}`")
    text = q(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        name, start,
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).when(x["start"] < acc["at"], F.struct(x["end"].alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size(name) > 0, done).otherwise(text)
    return find_secrets(docs, model, text_col, name).select(*[clean.alias(c) if c == text_col else q(c) for c in docs.columns])


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")
