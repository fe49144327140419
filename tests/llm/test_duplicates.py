import hashlib
import random

import numpy as np
import pytest
from fixtures import components, documents, jaccard_linked, messy, shingles, simple, words

from plantscope.llm import minhash, suffixes, vector_graph
from plantscope.llm.graph import connected_components


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (90, 91), (91, 90)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(200, 250)], 100), 90: 90, 91: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_messy_documents(spark):
    got = minhash.near_duplicates(documents(spark), width=2)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(r[0], r[1]) for r in messy()]
    named = [(i, shingles(t, 2)) for i, t in rows if i is not None]
    nodes = sorted({i for i, _ in named})
    linked = lambda a, b: any(jaccard_linked([s, t], 80)(0, 1) for i, s in named if i == nodes[a] for j, t in named if j == nodes[b])
    part = dict(zip(nodes, (nodes[k] for k in components(len(nodes), linked))))
    want = sorted((str(i), len(shingles(t, 2)), str(part.get(i)), i is None or part[i] == i) for i, t in rows)
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect()) == want
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    r = random.Random(5)
    base = words(100, 9)
    texts = [" ".join(base)]
    for k in range(160):  # copies with up to a fifth of the words changed: some link to the base only, some to nothing
        w = list(base)
        for at in r.sample(range(100), r.choice([1, 3, 5, 8, 12])):
            w[at] = f"new{k}x{at}"
        texts.append(" ".join(w[: 100 - r.choice([0, 0, 5])]))
    r.shuffle(texts)
    sets = [shingles(t, 2) for t in texts]
    want = components(len(texts), jaccard_linked(sets, 80))
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(simple(spark, texts), width=2).collect())
    assert [c for _, c in got] == want


def test_estimate_is_close():
    h = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(h[:2500]), np.unique(h[500:])
    sig = minhash.registers([a, b])
    assert abs(minhash.estimate(sig[:1], sig[1:], np.array([2500]), np.array([2500]))[0] - 2 / 3) < 0.12


def brute_repeats(rows, width=50):
    """Plain version: which bytes go, for (id, bytes) rows."""
    first = {}
    for i, raw in rows:
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] < i:
                gone[p : p + width] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 4_000)
    if hot:  # every anchor held by two documents travels window by window
        monkeypatch.setattr(suffixes, "LEAST_HOT", 1)
        monkeypatch.setattr(suffixes, "ONE_IN", 10**9)
    r = random.Random(3)
    passage = ["".join(r.choice("ab ") for _ in range(n)) for n in (49, 50, 51, 120, 400)]
    texts = []
    for k in range(60):
        parts = [r.choice(passage) if r.random() < 0.6 else "".join(r.choice("abcé ") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 5))]
        texts.append("".join(parts))
    texts += [texts[5], texts[7], "a" * 300, "a" * 200, "ab" * 100, None, ""]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = spark.createDataFrame([(i * 3, texts[k]) for i, k in enumerate(order)], "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in suffixes.repeats_removed(docs).collect())
    assert got == brute_repeats([(i * 3, (texts[k] or "").encode()) for i, k in enumerate(order)])


def test_repeats_of_messy_documents(spark):
    rows = [(r[0], (r[1] or "").encode()) for r in messy()]
    got = suffixes.repeats_removed(documents(spark)).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == brute_repeats([r for r in rows if r[0] is not None])
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0, 0]
    assert suffixes.repeats_removed(documents(spark, [])).count() == 0


def test_texts_without_repeats_stay_texts(spark):
    docs = documents(spark)
    got = suffixes.without_repeats(docs)
    assert got.dtypes == docs.dtypes and got.count() == docs.count()
    by = {r["id"]: r["text"] for r in got.collect()}
    assert by[3] == "" and by[5] is None and by[12] == "Before it.and after it."
    eur = simple(spark, ["€" * 40, "x" + "€" * 40 + "y"])
    assert {r["doc_id"]: r["text"] for r in suffixes.without_repeats(eur).collect()} == {0: "€" * 40, 1: "xy"}


def test_deep_shallow_sorting_groups_equal_windows():
    r = random.Random(2)
    raw = "".join(r.choice("ab") for _ in range(40)) * 6 + "".join(r.choice("ab") for _ in range(300))
    data = np.frombuffer((raw + raw[10:200]).encode(), np.uint8)
    places = np.arange(len(data) - 49)
    group = suffixes.equal_windows(data, places)
    text = data.tobytes()
    assert len({(g, text[p : p + 50]) for g, p in zip(group.tolist(), places.tolist())}) == len({text[p : p + 50] for p in places}) == len(set(group.tolist()))
    tails = [bytes(r.choice(b"ab") for _ in range(8)) for _ in range(200)]
    assert [tails[g[0]] for g in suffixes.blind_trie(tails, 8)] == sorted(set(tails))


def vectors(spark, n=700):
    g = np.random.default_rng(4)
    c = g.normal(size=(12, 16))
    rows = [(k, (c[k % 12] * (k % 3 + 1) + g.normal(size=16) * 0.05 * (k % 4)).tolist(), k % 2, "x") for k in range(n)]
    rows += [(n + 1, None, 0, "x"), (n + 2, [0.0] * 16, 0, "x"), (n + 3, [float("nan")] * 16, 0, "x"), (n + 4, [None] * 16, 0, "x"), (n + 5, rows[0][1], None, "x"),
             (None, rows[0][1], 0, "x"), (n + 6, [], 0, "x"), (n + 7, [1.0, 2.0], 0, "x"), (n + 8, rows[0][1], 0, "x"), (n + 9, [x * 1e300 for x in rows[0][1]], 0, "x"), rows[3]]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string").repartition(3)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 120)
    rows, frame = vectors(spark)
    got = vector_graph.near_vectors(frame).collect()
    assert len(got) == len(rows)
    usable = sorted({i: (v, lab) for i, v, lab, _ in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}.items())
    unit = [np.array(v) / max(map(abs, v)) for _, (v, _) in usable]
    unit = [x / np.linalg.norm(x) for x in unit]
    near = lambda i, j: i != j and usable[i][1][1] == usable[j][1][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    true = {(i, j) for i in range(len(usable)) for j in range(len(usable)) if near(i, j)}
    found = sum({r["vec_id"]: r["n_links"] for r in got}.values())
    assert 0.97 * len(true) <= found <= len(true)
    part = components(len(usable), lambda i, j: (i, j) in true)
    want = {usable[i][0]: usable[p][0] for i, p in enumerate(part)}
    assert all(r["component_id"] == want.get(r["vec_id"], r["vec_id"]) for r in got)
    audit = vector_graph.audit_recall(frame).first()
    assert audit["truth"] > 0 and audit["recall"] >= 0.9
    assert vector_graph.near_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("largest", [4, 1])
def test_a_cluster_over_many_shards_is_linked_throughout(spark, monkeypatch, largest):
    monkeypatch.setattr(vector_graph, "SHARD", 20)
    monkeypatch.setattr(vector_graph, "LARGEST", largest)  # with 1, many shards are dealt again
    g = np.random.default_rng(6)
    tight, wide, other = (g.normal(size=24) + g.normal(size=(n, 24)) * noise for n, noise in ((900, 0.04), (300, 0.12), (200, 5.0)))
    x = np.concatenate([tight, wide, other])
    x = x[g.permutation(len(x))]
    got = vector_graph.near_vectors(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    assert near.sum() > 800_000
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(near.sum(axis=1).tolist()))
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["vec_id"])] == components(len(x), lambda i, j: near[i, j])
