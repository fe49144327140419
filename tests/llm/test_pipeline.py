import re
from collections import Counter

from fixtures import components, jaccard_linked, shingles, words
from test_files import brute_bins, library_ids
from test_texts import ASSIGN

import corpus_pipeline
from plantscope.llm.encoding import WORD_BPE


def prose(seed, lines=6):
    return "\n".join(" ".join(words(12, 1000 * seed + j)).capitalize() + "." for j in range(lines))


def planted():
    clean = [prose(k) for k in range(40)]
    passage = " ".join(words(60, 77)).capitalize() + "."
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(50, clean[3]), (51, clean[4].replace(clean[4].split()[10], "other")), (52, f"{prose(60)}\n{passage}\n{prose(61)}"), (53, f"{prose(62)}\n{passage}\n{prose(63)}")]
    rows += [(60, f'{prose(64)}\nThe key is password = "Zx81kQpLm29rTT" here.'), (70, " ".join(w + "***" for w in words(80, 900))), (71, "same line here again now\n" * 40), (72, "too short"), (73, None)]
    rows += [(80 + k, " | ".join(words(60, 950 + k))) for k in range(6)]
    return rows


def plain(rows):
    """The stages before packing, one document at a time; which documents are junk is known."""
    kept = [(i, t) for i, t in rows if i < 70]
    sets = [shingles(t, 5) for _, t in kept]
    part = components(len(kept), jaccard_linked(sets, 80))
    kept = [kept[k] for k in sorted(set(part))]
    first = {}
    for i, t in kept:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], i), i)
    out = []
    for i, t in kept:
        gone = set()
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone.update(range(p, p + 50))
        t = "".join(c for k, c in enumerate(t) if k not in gone)
        out.append((i, ASSIGN.sub(lambda m: "[SECRET]" if len(m[2]) >= 6 else m[0], t)))
    return out


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "repeated passages", "secret scan", "packing"]
    columns, now = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, None).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == columns
    want = plain(rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert texts == dict(want)
    pieces = now.collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(i for i, _ in want)  # all are shorter than a sequence
    assert {r["doc_id"]: r["length"] for r in pieces} == {i: len(library_ids(WORD_BPE, t)) for i, t in want}
    assert len({r["sequence_id"] for r in pieces}) == brute_bins([r["length"] for r in pieces], 2048)
    assert not re.search("Zx81kQ", "".join(texts.values()))


def test_pipeline_of_an_empty_table(spark):
    now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, None)
    assert now.count() == 0


def test_near_dedup_keeps_different_texts_under_one_id(spark):
    rows = [
        (1, "one two three four five six seven eight", "en", "a", 1),
        (1, "one two three four five six seven eight", "en", "a", 1),
        (2, "red green blue yellow black white grey pink", "en", "a", 1),
        (2, "sun moon star cloud rain snow wind storm", "en", "b", 1),
        (None, "a text without any id at all here", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, None).collect())
    assert got == sorted({(r[0] or 0, r[1]) for r in rows})


def test_packing_stage_leaves_no_parts_in_idle_workers():
    import pandas as pd

    from plantscope.llm import packing
    from plantscope.llm.encoding import encoder

    rows = pd.DataFrame({"id": [1, 2], "text": ["some words here", None]})
    kept = list(packing.pieces_of(WORD_BPE, 2048)(iter([rows])))
    assert len(encoder(WORD_BPE).numbers) > 0
    dropped = list(packing.pieces_of(WORD_BPE, 2048, remember=False)(iter([rows])))
    assert len(encoder(WORD_BPE).numbers) == 0
    pd.testing.assert_frame_equal(kept[0], dropped[0])
