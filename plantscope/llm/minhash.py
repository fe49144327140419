"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact confirmation.

Every document is hashed into ``REGISTERS`` buckets. A bucket keeps the smallest
hash it saw, compressed to its count of leading zeros and its next ten bits.
Empty buckets copy a full one in an order fixed for all documents, so short
texts band as well as long ones. Six neighbouring registers make a band: texts
of similarity 0.8 miss all 48 bands once in two million.

Texts with equal sets form one class, of which only the smallest id goes on. Every bucket of
a band names two pivots, the member that meets most others and the smallest id; a document is
compared with the best of each that its buckets name, so a group of n copies costs 2 n comparisons. Members of a bucket that are not connected by then are compared where their sets
share one of their rarest shingles: of n shingles, two sets of that size and similarity 0.8
share one of the n / 9 rarest. Estimates settle clear misses, full sets decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.llm.graph import connected_components
from plantscope.llm.registry import query, table
from plantscope.llm.scratch import discard, write_once
from plantscope.llm.shingles import chunks, mix, shingle_sets

REGISTERS, ROWS = 288, 6
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: A pair is dropped on its estimate only when that is this many deviations below the threshold.
DEVIATIONS = 6.0

# ORDER[i]: the buckets in which an empty bucket i looks for a full one.
ORDER = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of compressed registers per sorted set of 64-bit hashes; zeros for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.zeros((len(sets), REGISTERS), bool)
    if sum(map(len, sets)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        h = np.concatenate(sets)
        m, half = np.uint64(REGISTERS), np.uint64(32)  # bucket: the upper word of h * REGISTERS, in order of h; the lower word is the hash in it
        bucket = (((h >> half) * m + ((h & np.uint64(0xFFFFFFFF)) * m >> half)) >> half).astype(np.int64)
        key = row * REGISTERS + bucket
        first = np.flatnonzero(np.diff(key, prepend=-1))  # sets are sorted, so a bucket's first hash is its smallest
        rest = (h[first] * m >> np.uint64(11)) | np.uint64(1)  # 53 bits, which a double holds
        zeros = 53 - np.frexp(rest.astype(np.float64))[1]
        lead = rest << (zeros + 11).astype(np.uint64)
        bits = (lead << np.uint64(1)) >> np.uint64(64 - MANTISSA)
        out.reshape(-1)[key[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | bits).astype(np.uint16)
        full.reshape(-1)[key[first]] = True
    some = full.any(axis=1)
    todo_row, todo = np.nonzero(~full & some[:, None])
    for step in range(REGISTERS):
        if not len(todo):
            break
        source = ORDER[todo, step]
        hit = full[todo_row, source]
        out[todo_row[hit], todo[hit]] = out[todo_row[hit], source[hit]]
        todo_row, todo = todo_row[~hit], todo[~hit]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less those expected to be equal by accident."""
    zeros = np.arange(54)
    high, low = 2.0**-zeros, np.where(zeros == 53, 0.0, 2.0 ** -(zeros + 1.0))

    def chance(n):  # that a bucket's smallest hash has so many leading zeros
        n = np.maximum(n[:, None] / REGISTERS, 1.0)
        return (1 - low) ** n - (1 - high) ** n

    accident = (chance(n_a) * chance(n_b)).sum(axis=1) / 2**MANTISSA
    share = (a == b).mean(axis=1)
    return (share - accident) / (1 - accident)


def _featured(width: int, with_sets: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, at = pdf["id"], 0
            for docs in chunks(pdf["text"]):
                sets = shingle_sets(docs, width)
                spread = [mix(s ^ np.uint64(0x5851F42D4C957F2D)) for s in sets]
                out = pd.DataFrame({
                    "id": ids.iloc[at : at + len(docs)].to_numpy(),
                    "n": [len(s) for s in sets],
                    "d1": np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in spread], np.uint64).astype(np.int64),
                    "d2": np.array([s.sum(dtype=np.uint64) for s in spread], np.uint64).astype(np.int64),
                    "sig": [r.tobytes() for r in registers(sets)],
                })
                out["id"] = out["id"].astype("Int64")
                if with_sets:
                    out["members"] = [s.tobytes() for s in sets]
                at += len(docs)
                yield out

    return run


FEATURES = "id long, n long, d1 long, d2 long, sig binary"


def _likely(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
                n_a, n_b = pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()
                # a set of few shingles fills few buckets, and says as little as they do
                slack = DEVIATIONS * (threshold * (1 - threshold) / np.minimum(np.minimum(n_a, n_b), REGISTERS)) ** 0.5
                keep = estimate(a, b, n_a, n_b) >= threshold - slack
                yield pdf.loc[keep, ["a", "b"]]

    return run


def _linked(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["set_a"], pdf["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    side = lambda c, *more: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(m).alias(f"{n}_{c}") for m, n in more])
    sized = pairs.join(side("a", ("sig", "sig")), "a").join(side("b", ("sig", "sig")), "b")
    sized = sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = write_once(sized.mapInPandas(_likely(percent / 100), "a long, b long").distinct(), "likely")
    whole = likely.join(side("a", ("members", "set")), "a").join(side("b", ("members", "set")), "b").select("a", "b", "set_a", "set_b")
    links = write_once(whole.mapInPandas(_linked(percent), "a long, b long"), "confirmed")
    discard(likely)
    return links


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            sets = [np.frombuffer(m, np.int64) for m in part["members"]]
            size = [len(x) for x in sets]
            yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), size), "d1": np.repeat(part["d1"].to_numpy(), size), "n": np.repeat(size, size), "token": np.concatenate(sets)})


def _sharing_rare(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets from different components that may reach the threshold; none that does is missing.

    With all shingles in one order, rarest first, sets of n >= m shingles that reach it have more than n - c in
    common, c = percent * (n + m) / (100 + percent), so the first n - c + 1 of one and the first of the other meet.
    Sizes are met class by class, for the fewer shingles have to be looked at the closer the sizes are.
    """
    ratio = 1.02
    need = lambda n, m: F.ceil(percent * (n + m) / F.lit(100 + percent) - F.lit(1e-9)).cast("long")
    group = lambda n: F.floor(F.log(n) / F.log(F.lit(ratio))).cast("int")
    tokens = sets.join(placed, "id", "left_semi").select("id", "d1", "members").mapInPandas(_tokens, "id long, d1 long, n long, token long")
    tokens = write_once(tokens, "tokens")
    ranked = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("held")), "token")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("id", "d1").orderBy("held", "token")))
    ranked = ranked.where((F.col("held") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    rare = write_once(ranked.join(placed, "id"), "rare")
    discard(tokens)
    n = F.col("n")
    small = rare.where(F.col("place") <= n - need(n, n) + 1).select("token", group(n).alias("sizes"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("in_b"))
    least = F.ceil(n * percent / 100).cast("long")
    large = rare.withColumn("sizes", F.explode(F.sequence(group(least) - 1, group(n))))
    low = F.greatest(least, F.floor(F.pow(F.lit(ratio), F.col("sizes"))).cast("long") - 1)
    large = large.where(F.col("place") <= n - need(n, low) + 1).select("token", "sizes", F.col("id").alias("a"), "n", F.col("component").alias("in_a"))
    met = large.join(small, ["token", "sizes"]).where(f"in_a != in_b and (m < n or m = n and a != b) and 100 * m >= {percent} * n")
    out = write_once(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "sharing")
    discard(rare)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Words are separated by ASCII white space, A-Z count as a-z. Texts are linked when the
    Jaccard similarity of their sets of ``width``-word shingles is at least
    ``percent`` hundredths; component_id is the smallest id reachable.

    Null and empty texts, and texts of white space, have 0 shingles and are linked
    with nothing. A row without id is linked with nothing: its component_id is NULL and it is
    kept. Rows with one id are one node, linked by each of their texts, and get one answer
    each. Other columns are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = write_once(rows.mapInPandas(_featured(width, False), FEATURES), "registers")
    classes = features.where("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    classes = write_once(classes, "classes")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = classes.select("id", "sig", band).select(
        "id", F.xxhash64("band", F.expr(f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = write_once(bands.join(shared, "key"), "members")

    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    best = F.max(F.struct("met", (-F.col("id")).alias("id")))
    pivots = members.join(met, "id").groupBy("key").agg(best.alias("p"), F.min("id").alias("q"))
    # of all its pivots a member is compared with the one that meets most others and with the smallest
    own = members.select("key", "id").join(pivots, "key").groupBy("id").agg(
        F.max(F.when(-F.col("p.id") != F.col("id"), F.col("p"))).alias("p"), F.min(F.when(F.col("q") != F.col("id"), F.col("q"))).alias("q"))
    pairs = own.select("id", F.explode(F.array(-F.col("p.id"), F.col("q"))).alias("other")).where("other is not null")
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()

    wanted = members.select("id").distinct()
    sets = rows.join(wanted, "id", "left_semi").mapInPandas(_featured(width, True), FEATURES + ", members binary")
    sets = write_once(sets.where("n > 0").dropDuplicates(["id", "d1", "d2"]), "sets")
    pairs = write_once(pairs, "pairs")
    first = _confirmed(pairs, sets, percent)
    found = connected_components(first)

    # members of a bucket that no pivot has brought together
    placed = members.join(found, members.id == found.node, "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    placed = write_once(placed.join(split, "key").select("id", "component").distinct(), "apart")
    sharing = _sharing_rare(placed, sets, percent)
    second = _confirmed(sharing.join(pairs, ["a", "b"], "left_anti"), sets, percent)
    discard(found, placed, pairs, sets, members, sharing)
    # an id that stands for several texts ties their classes together
    keyed = features.where("n > 0 and id is not null").select("id", F.struct("n", "d1", "d2").alias("text"))
    double = keyed.groupBy("id").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low != high").select("id")
    tied = keyed.join(double, "id").select("id", "text.*").join(classes.withColumnRenamed("id", "b"), ["n", "d1", "d2"]).select(F.col("id").alias("a"), "b")
    found = connected_components(first.unionByName(second).unionByName(tied))
    discard(first, second)

    classed, classes = classes, classes.join(found, classes.id == found.node, "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component"))
    done = features.join(classes, ["n", "d1", "d2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    done = write_once(done.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "answers")
    discard(features, classed, found)
    return done


SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) = 1 then [words[1]]
    else list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1]) end) as items
  from w),
e as (select doc_id, unnest(items) as item from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.item = b.item and a.doc_id < b.doc_id group by all),
l as (
  select a, b from c join s x on x.doc_id = a join s y on y.doc_id = b
  where 100 * n >= 80 * (len(x.items) + len(y.items) - n)),
g as (select a, b from l union all select b, a from l),
"""
ORACLE = "with recursive " + SQL.strip()[5:] + """
r(node, reach) as (
  select doc_id, doc_id from documents union select g.a, r.reach from r join g on g.b = r.node)
select s.doc_id, cast(len(items) as bigint) as n_shingles, m.component_id, s.doc_id = m.component_id as kept
from s join (select node, min(reach) as component_id from r group by node) m on m.node = s.doc_id
"""


@query("op1_minhash_near_dedup", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
