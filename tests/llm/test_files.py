import base64
import bisect
import gzip
import hashlib
import random
import tempfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, messy

from plantscope.llm import packing, token_files, warc
from plantscope.llm.encoding import BYTE_BPE, WORD_BPE, Encoder, encoder
from plantscope.session import scratch_path


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_is_the_library(name):
    r = random.Random(2)
    signs = [*" \n\t\r  ab's1.,é中🙂Σς\x1c\0　\xa0İ́", "<|endoftext|>", "the", "Word", "'ll", "  "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(4000)] + [t for _, t, *_ in messy()]
    e = encoder(name)
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_signs_after_words_are_the_library(name):
    r = random.Random(5)
    signs = ["a", "Word", "é", "ÿ", "ª", "µ", "中", "Σ", "1", " ", "\n", "'s", "'", "$", "$$$", "&&", "%", "*", "###", "!!", "?", ".", ",", ";", ":", "...", "<|", "|>", "<|endoftext|>", "_", "\u0338", "\u0301"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(6000)]
    e = Encoder(public_tokenizers.path(name))
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_a_word_is_encoded_once_whatever_signs_follow(name):
    e = Encoder(public_tokenizers.path(name))
    library, given = e.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    e.tokenizer = Watched()
    text = "x zebra zebra. zebra$$$ zebra&&& zebra!! zebra,%%% zebra.*** zebra### zebra"
    assert next(e.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids
    assert "".join(given).count("zebra") == 1


def library_ids(name, text):
    return np.array(encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 5_000)
    folder = scratch_path(spark, "test-tokens")
    token_files.write_tokens(documents(spark), folder)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    ids = [(r[0], library_ids(BYTE_BPE, r[1])) for r in messy()]
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in got) == Counter((i, tuple(x.tolist())) for i, x in ids)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["token_ids"], "<u4").tobytes()) for r in got)
    empty = scratch_path(spark, "test-tokens")
    token_files.write_tokens(documents(spark, []), empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_files_start_where_the_documents_before_end(spark):
    r = random.Random(4)
    rows = [(i if i % 50 else None, " ".join(r.choice(["some", "words", "1.5", "é", "🙂"]) for _ in range(r.randint(0, 30)))) for i in range(400)]
    rows += rows[100:140]
    folder = scratch_path(spark, "test-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with larger tables, parts lie in many tasks
    try:
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder)
        got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [(i, tuple(library_ids(BYTE_BPE, t).tolist())) for i, t in rows]
    want = sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    assert [(r["doc_id"], tuple(r["token_ids"])) for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0] + [len(x) for _, x in want])[:-1].tolist()


def test_encoding_counts_the_symbols():
    import pandas as pd

    texts = [t for _, t, *_ in messy()]
    frames = [pd.DataFrame({"id": [1] * len(part), "text": part}) for part in (texts[:5], texts[5:])]
    *rows, last = token_files._tokens(BYTE_BPE, 0)(iter(frames))
    assert sum(len(x) for x in rows) == len(texts) and len(last) == 1
    want = Counter(np.concatenate([library_ids(BYTE_BPE, t) for t in texts]).tolist())
    assert dict(zip(last["symbols"][0].tolist(), last["counts"][0].tolist())) == want


def test_coder_checkpoints_and_damage():
    ids = np.random.default_rng(1).zipf(1.4, 600_000) % 3000
    symbols, freq = token_files.scaled(Counter(ids.tolist()))
    assert freq.sum() == 1 << token_files.BITS and freq.min() >= 1
    coder = token_files.Coder(symbols, freq)
    words, lanes, marks, places = coder.encode(ids)
    assert (coder.decode(words, lanes, len(ids)) == ids).all() and len(places) == 2
    block = {"words": words.astype("<u4").tobytes(), "marks": marks.tobytes(), "places": places.astype("<u4").tobytes(), "sizes": np.array([len(ids)], "<u4").tobytes()}
    for k in range(2):
        assert (token_files.decode_from(block, coder, k) == ids[(k + 1) * token_files.STRIDE * token_files.LANES :]).all()
    with pytest.raises(ValueError):
        coder.decode(words[:-1], lanes, len(ids) - 1)


def brute_bins(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def test_best_fit_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(150):
        capacity = r.choice([1, 10, 50, 2048])
        lengths = [r.randint(1, capacity if r.random() < 0.5 else max(1, capacity // 8)) for _ in range(r.randint(0, 300))]
        assert packing.best_fit(Counter(lengths), capacity)[1] == brute_bins(lengths, capacity)


def test_packing_of_messy_documents(spark):
    got = packing.pack_documents(documents(spark), capacity=64)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    want = Counter()
    for r in messy():
        ids = library_ids(WORD_BPE, r[1])
        want.update((r[0], k, at, len(p := ids[at : at + 64]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 64)))
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) <= 64
    assert len(bins) == brute_bins([r["length"] for r in rows], 64)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_packing_encodes_every_text_once(spark, tmp_path):
    folder = str(tmp_path)

    def seen(batches):
        for pdf in batches:
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                f.write(str(len(pdf)))
            yield pdf

    rows = [(i, f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInPandas(seen, "doc_id long, text string")
    assert packing.pack_documents(docs).count() == len(rows)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == len(rows)


def pages():
    rows = [(5, "http://a/x", "<p>same</p>"), (3, "http://a/y y", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "u", None), (2, "u", ""), (4, "v", f"{warc.END}{warc.VERSION}{warc.END} é中"),
            (None, "w", "<p>same</p>"), (6, "long", "z" * 300_000), (3, "http://a/y y", "<p>same</p>"), (7, "", "other"), (7, "", "different")]
    return [(i, u, h, "x", 1) for i, u, h in rows]


def test_archives_round_trip(spark):
    folder = scratch_path(spark, "test-warc")
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string, first string, sha int").repartition(3)
    warc.write_archives(frame, folder)
    records = warc.read_records(spark, folder)
    got = warc.captures(records).collect()
    main = {(int(p) if (p := r["main"]["headers"].get("X-Page-ID")) else None, bytes(r["main"]["payload"]).decode()): r for r in got}
    assert all(r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata" for r in got)
    assert set(main) == {(3, "<p>same</p>"), (5, ""), (9, ""), (1, ""), (2, ""), (4, pages()[5][2]), (None, "<p>same</p>"), (6, "z" * 300_000), (7, "other"), (7, "different")}
    for page in (5, 9):
        r = main[(page, "")]["main"]
        assert r["type"] == "revisit" and r["refers_to"] == main[(3, "<p>same</p>")]["capture_id"] and r["headers"]["X-Refers-To-Page"] == "3"
        assert r["headers"]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()
    assert main[(2, "")]["main"]["type"] == "revisit" and main[(1, "")]["main"]["type"] == "response"
    assert main[(None, "<p>same</p>")]["main"]["type"] == "response"
    empty = scratch_path(spark, "test-warc")
    warc.write_archives(frame.where("false"), empty)
    assert warc.captures(warc.read_records(spark, empty)).count() == 0


def test_a_damaged_archive_is_refused():
    import pandas as pd

    read = warc._records(True)
    good = warc._record("response", "a", [], b"body") + warc.END.encode()
    assert len(next(read(iter([pd.DataFrame({"path": ["p"], "content": [gzip.compress(good + good)]})])))) == 2
    with pytest.raises(ValueError):
        list(read(iter([pd.DataFrame({"path": ["p"], "content": [good[:-1] + b"x"]})])))
