"""Near-duplicate vectors by a flat, robustly pruned proximity graph built on overlapping shards.

Vectors of one label are dealt to the shards of their nearest centres, each to several, so that
neighbours share a shard. Every shard builds its part of the graph, keeping of each vector's candidates
those that no closer neighbour stands before (robust pruning); the lists of a vector from all its shards are then united.
The search for vectors in range starts from what shares a shard and leaves it: each vector lies in one block, blocks are
compared in pairs by products in double precision, and wherever a vector of one block is in range of one of the other,
the blocks of that one's neighbours in the graph are compared next. Rounds go on until no new pair of blocks comes up, each
written once; so a cluster may be spread over any number of shards. Pairs are counted where they are found and never listed.
Recall is measured against brute force for the vectors whose id is divisible by twenty.

Equal vectors of a label are one class, searched once. Centres are as many as the vectors ask for and start from
members, so a dense cluster is cut into shards of about the same size as any other; shards that stay too large are dealt again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.graph import connected_components
from plantscope.llm.registry import query, table
from plantscope.llm.scratch import discard, write_once
from plantscope.session import materialize

#: Vectors of a label on which its centres are fitted, at most; all vectors are dealt.
SAMPLE = 4_000
SHARD = 800  # vectors in a shard, on average
OVERLAP = 4  # shards of a vector
DEGREE = 24
POOL = 64  # candidates of a vector in a shard, before pruning
ALPHA = 1.2
SLACK = 0.02  # expansion goes through vectors this far out of range
LARGEST = 4  # shards of so many times the average size are dealt again


def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors in double precision; none where a vector is NULL, empty, zero or not finite throughout."""
    for pdf in batches:
        out = []
        for v in pdf["vector"]:
            x = None if v is None else np.array([np.nan if e is None else e for e in v], np.float64)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            x = x / np.abs(x).max()  # else the squares of very large or small numbers leave the range
            out.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
        yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "label": pdf["label"], "unit": out})


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced members."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _nearest(unit: pd.Series, c: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` nearest centres of each vector, nearest first."""
    far = -(np.frombuffer(b"".join(unit), np.float64).reshape(len(unit), -1) @ c.T)
    near = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def _deal(models: dict[str, np.ndarray]):
    """Shards of each vector, the home shard first: its OVERLAP nearest centres of its label and dimension."""

    def run(batches):
        for pdf in batches:
            shards = pd.Series([[g] for g in pdf["shard"]], index=pdf.index, dtype=object)
            for group, part in pdf.groupby("shard"):
                if group in models:
                    near = _nearest(part["unit"], models[group], min(OVERLAP, len(models[group])))
                    shards.loc[part.index] = pd.Series([[f"{k}/{group}" for k in row] for row in near], index=part.index, dtype=object)
            yield pdf.assign(shards=shards, home=shards.str[0])[["id", "copies", "unit", "home", "shards"]]

    return run


def _deal_again(models: dict[str, np.ndarray]):
    """Members of shards that are too large go to the two nearest of that shard's own centres."""

    def run(batches):
        for pdf in batches:
            for group, part in pdf.groupby("shard"):
                if group in models:
                    near = _nearest(part["unit"], models[group], min(2, len(models[group])))
                    part = part.loc[part.index.repeat(near.shape[1])].copy()
                    part["shard"] = [f"{k}/{group}" for k in near.ravel()]
                yield part

    return run


def _models(rows: DataFrame, sizes: DataFrame, each: int) -> dict[str, np.ndarray]:
    """Centres of every shard in ``sizes`` (shard, count), one for ``each`` rows, from the members with the smallest hashes."""
    cut = rows.select("shard", "unit", F.xxhash64("unit").alias("h")).join(sizes, "shard").where(
        (F.col("h") % F.greatest(F.lit(1).cast("long"), F.floor(F.col("count") / (SAMPLE // 2)))) == 0)

    def fit(key, pdf):
        few = list(pdf["unit"].iloc[:SAMPLE])
        x = np.frombuffer(b"".join(few), np.float64).reshape(len(few), -1)
        k = max(2, int(pdf["count"].iloc[0]) // each)
        return pd.DataFrame({"shard": key[0], "size": [len(few[0])], "centres": [centres(x, min(k, len(x))).tobytes()]})

    fitted = cut.select("shard", "unit", "count").groupBy("shard").applyInPandas(fit, "shard string, size int, centres binary")
    return {r["shard"]: np.frombuffer(r["centres"], np.float64).reshape(-1, r["size"] // 8) for r in fitted.collect()}


def pruned(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, least: float = -2.0) -> list[np.ndarray]:
    """Adjacency lists: of the POOL nearest vectors with cosine ``least`` or more, nearest first, those that no kept one is ``alpha`` times closer to."""
    n = len(x)
    out = []
    for a in range(0, n, 256):
        near = x[a : a + 256] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        k = min(POOL, n - 1)
        pool = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(near), 0), int)
        for row, cand in zip(near, pool):
            cand = cand[row[cand] >= least]
            cand = cand[np.argsort(-row[cand], kind="stable")]
            between = np.sqrt(np.maximum(2 - 2 * (x[cand] @ x[cand].T), 0))
            away = np.sqrt(np.maximum(2 - 2 * row[cand], 0))
            alive, kept = np.ones(len(cand), bool), []
            for i in range(len(cand)):
                if alive[i]:
                    kept.append(cand[i])
                    if len(kept) == degree:
                        break
                    alive &= alpha * between[i] > away
            out.append(np.array(kept, int))
    return out


def _build(least: float):
    """A shard's part of the graph: (id, blocks of its neighbours), and the pairs of blocks (s, t) that hold vectors in range of each other.

    Neighbours so far away that no vector can be in range of both ends are of no use to the search and are left out.
    """
    reach = float(np.cos(min(np.pi, 2 * np.arccos(np.clip(least - SLACK, -1, 1))))) - 1e-9

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        code, names = pd.factorize(pdf["block"])
        ids, out = pdf["id"].to_numpy(), []
        for i, near in enumerate(pruned(x, least=reach)):
            beside = np.setdiff1d(code[near], code[i])
            if len(beside):
                out.append((ids[i], list(names[beside]), None, None))
        pairs = set()
        for a in range(0, len(x), 256):
            i, j = np.nonzero(x[a : a + 256] @ x.T >= least - SLACK)
            pairs.update(np.unique(code[a + i] * len(names) + code[j]).tolist())
        out += [(None, None, names[p // len(names)], names[p % len(names)]) for p in pairs if names[p // len(names)] < names[p % len(names)]]
        return pd.DataFrame(out, columns=["id", "blocks", "s", "t"]).astype({"id": "Int64"})

    return run


def _pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A block as one row."""
    out = {"block": key[0], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()]}
    return pd.DataFrame(out | {"units": [b"".join(pdf["unit"])], "blocks": [[[] if b is None else list(b) for b in pdf["blocks"]]]})


def in_range(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows have cosine ``least`` or more, and which reach it but for SLACK."""
    g = x @ y.T
    hit = g >= least
    for i, j in zip(*np.nonzero(np.abs(g - least) < 1e-9)):  # products of matrices round otherwise than those of two vectors
        hit[i, j] = float(x[i] @ y[j]) >= least
    return hit, g >= least - SLACK


def stars(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together the rows and columns (columns counted after the rows) that ``hit`` ties together: a star for each component."""
    n = len(hit)
    root = np.full(n + hit.shape[1], -1)
    for start in np.nonzero(hit.any(axis=1))[0]:
        rows = np.array([start]) if root[start] < 0 else np.zeros(0, int)
        while len(rows):
            root[rows] = start
            cols = np.nonzero(hit[rows].any(axis=0) & (root[n:] < 0))[0]
            root[n + cols] = start
            rows = np.nonzero(hit[:, cols].any(axis=1) & (root[:n] < 0))[0]
    ends = np.nonzero(root >= 0)[0]
    return root[ends], ends


COUNT, LINK, PAIR, NEXT = range(4)
_FOUND = "kind int, a long, b long, s string, t string"


def _compare(least: float, every: int | None):
    """Rows of two blocks: COUNT (a has b more vectors in range), LINK (a and b are in one component), NEXT (blocks s and t have to be compared).

    With ``every``, PAIR lists the pairs that hold an id divisible by it.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r, same = pdf.iloc[0], key[0] == key[1]
        ids, copies = ([np.frombuffer(r[f"{c}_{e}"], np.int64) for e in "st"] for c in ("ids", "copies"))
        x, y = (np.frombuffer(r[f"units_{e}"], np.float64).reshape(len(i), -1) for e, i in zip("st", ids))
        hit, wide = in_range(x, y, least)
        if same:
            np.fill_diagonal(hit, False)
        counts = [hit @ copies[1].astype(np.float64)] + ([] if same else [copies[0].astype(np.float64) @ hit])
        parts = [pd.DataFrame({"kind": COUNT, "a": i[n > 0], "b": n[n > 0].astype(np.int64)}) for i, n in zip(ids, counts)]
        both = np.concatenate(ids)
        a, b = (both[e] for e in stars(hit))
        parts.append(pd.DataFrame({"kind": LINK, "a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates())
        if every:
            i, j = np.nonzero(hit & ((ids[0] % every == 0)[:, None] | (ids[1] % every == 0)[None, :]))
            a, b = ids[0][i], ids[1][j]
            parts.append(pd.DataFrame({"kind": PAIR, "a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates())
        new = set()
        if not same:  # inside one block, what its vectors' neighbours are is known from the start
            for blocks, met, other in ((r["blocks_t"], wide.any(axis=0), key[0]), (r["blocks_s"], wide.any(axis=1), key[1])):
                new |= {(min(other, u), max(other, u)) for k in np.nonzero(met)[0] for u in blocks[k] if u != other}
        parts.append(pd.DataFrame(sorted(new - {key}), columns=["s", "t"]).assign(kind=NEXT))
        out = pd.concat(parts).reindex(columns=["kind", "a", "b", "s", "t"])
        return out.astype({"kind": "int32", "a": "Int64", "b": "Int64"}).astype({"s": object, "t": object}).where(lambda d: d.notna(), None)

    return run


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    units = materialize(rows.mapInPandas(prepared, "id long, label string, unit binary"), "units")
    usable = units.where("id is not null and label is not null and unit is not null").distinct()
    classes = usable.groupBy("label", "unit").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return units, materialize(classes, "vectors")


def search(classes: DataFrame, least: float, every: int | None = None) -> DataFrame:
    """What the comparison of blocks finds, as in :func:`_compare`, over all pairs of blocks that the graph leads to."""
    spark = classes.sparkSession
    rows = classes.select(F.concat(F.lit(":"), F.length("unit").cast("string"), F.lit(":"), F.col("label")).alias("shard"), "id", "copies", "unit")
    sizes = rows.groupBy("shard").count().where(F.col("count") > 2 * SHARD)
    homes = write_once(rows.mapInPandas(_deal(_models(rows, sizes, SHARD)), "id long, copies long, unit binary, home string, shards array<string>"), "homes")
    # blocks: home shards, in several pieces where they are large
    pieces = homes.groupBy("home").agg(F.ceil(F.count("*") / (2 * SHARD)).alias("pieces"))
    block = F.concat_ws("/", F.pmod(F.xxhash64("id"), "pieces").cast("string"), "home").alias("block")
    homes_in = homes.join(pieces, "home")
    members = homes_in.select(block, "id", "copies", "unit")
    shards, last = homes_in.select(F.explode("shards").alias("shard"), block, "id", "unit"), None
    while True:
        large = shards.groupBy("shard").count().where(F.col("count") > LARGEST * OVERLAP * SHARD)
        now = {r["shard"]: r["count"] for r in large.collect()}
        if not now or last is not None and max(now.values()) >= max(last.values()):
            break
        sizes = spark.createDataFrame(list(now.items()), "shard string, count long")
        again = write_once(shards.mapInPandas(_deal_again(_models(shards, sizes, OVERLAP * SHARD // 2)), shards.schema), "shards")
        if last is not None:
            discard(shards)
        shards, last = again, now
    built = write_once(shards.groupBy("shard").applyInPandas(_build(least), "id long, blocks array<string>, s string, t string"), "graph")
    if last is not None:
        discard(shards)
    united = built.where("id is not null").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    packed = write_once(members.join(united, "id", "left").groupBy("block").applyInPandas(
        _pack, "block string, ids binary, copies binary, units binary, blocks array<array<string>>"), "blocks")
    discard(homes)
    # blocks of vectors in range and of neighbours first, then whatever the rounds add; s <= t throughout
    beside = packed.select("block", F.explode(F.array_distinct(F.flatten("blocks"))).alias("u")).select(F.least("block", "u").alias("s"), F.greatest("block", "u").alias("t"))
    new = write_once(built.where("s is not null").select("s", "t").unionByName(beside).unionByName(packed.select(F.col("block").alias("s"), F.col("block").alias("t"))).distinct(), "frontier")
    discard(built)
    done, found = None, None
    side = lambda e: packed.select(*[F.col(c).alias(e if c == "block" else f"{c}_{e}") for c in packed.columns])
    while not new.isEmpty():
        got = write_once(new.join(side("s"), "s").join(side("t"), "t").groupBy("s", "t").applyInPandas(_compare(least, every), _FOUND), "found")
        found = got if found is None else found.unionByName(got)
        done = new if done is None else done.unionByName(new)
        new = write_once(got.where(F.col("kind") == NEXT).select("s", "t").distinct().join(done, ["s", "t"], "left_anti"), "frontier")
    discard(packed)
    return spark.createDataFrame([], _FOUND) if found is None else found


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: vectors of equal, known label linked by a cosine of ``least`` or more.

    NULL, empty and zero vectors, vectors with NULL or non-finite components, and rows without label link with nothing; so
    do vectors of different dimensions with each other. A row without id has no links, component NULL, and is kept. Rows that
    repeat an id and vector count once. Other columns are not looked at; an empty table gives an empty result.
    """
    units, classes = _classes(vectors, id_col, vector_col, label_col)
    found = search(classes, least)
    beside = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("beside"))
    parts = connected_components(found.where(F.col("kind") == LINK).select("a", "b").distinct())
    per_class = classes.join(beside, "id", "left").join(parts, classes.id == parts.node, "left").select(
        "label", "unit", (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    usable = F.col("id").isNotNull() & F.col("unit").isNotNull()
    done = units.join(per_class, ["label", "unit"], "left").select(
        F.col("id").alias(id_col), F.when(usable, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(usable, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def audit_recall(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, block: int = 2_000) -> DataFrame:
    """(found, truth, recall) over the links of every vector whose id is divisible by twenty, against brute force over all vectors, in blocks."""
    _, classes = _classes(vectors, id_col, vector_col, label_col)
    links = search(classes, least, 20).where(F.col("kind") == PAIR).select("a", "b").distinct()
    asked = classes.where("id % 20 = 0").select("label", "id", "unit", F.explode(F.array([F.lit(i) for i in range(8)])).alias("block"))
    # fresh names for the columns: a group of two frames that share columns loses those of the second
    held = classes.select(*[F.col(c).alias(c) for c in ("label", "id", "unit")], F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("block"))

    def compare(key, left, right):
        rows = []
        for size, part in right.groupby(right["unit"].map(len)) if len(left) and len(right) else ():
            mine = left[left["unit"].map(len) == size]
            y = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
            for at in range(0, len(mine), block):
                few = mine.iloc[at : at + block]
                q = np.frombuffer(b"".join(few["unit"]), np.float64).reshape(len(few), -1)
                i, j = np.nonzero(q @ y.T >= least)
                rows.append(pd.DataFrame({"a": few["id"].to_numpy()[i], "b": part["id"].to_numpy()[j]}))
        out = pd.concat(rows) if rows else pd.DataFrame({"a": [], "b": []}, dtype="int64")
        return out[out["a"] != out["b"]].astype("int64")

    truth = asked.groupBy("label", "block").cogroup(held.groupBy("label", "block")).applyInPandas(compare, "a long, b long")
    truth = truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    marked = truth.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return marked.agg(F.count("hit").alias("found"), F.count("*").alias("truth")).withColumn("recall", F.when(F.col("truth") > 0, F.col("found") / F.col("truth")).otherwise(1.0))


ORACLE = """
with v as (select vec_id, label, list_transform(embedding, lambda e: cast(e as double)) as x from embeddings
           where label is not null and embedding is not null),
u as (select * from v where list_sum(list_transform(x, lambda e: e * e)) > 0),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id as node, vec_id as reach from embeddings union select p.b, r.reach from r join p on p.a = r.node)
select e.vec_id, (select count(*) from p where p.a = e.vec_id) as n_links, m.component_id, e.vec_id = m.component_id as kept
from embeddings e join (select node, min(reach) as component_id from r group by node) m on m.node = e.vec_id
""".replace("with v as", "with recursive v as")


@query("op3_vector_near_dedup", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
