import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, messy

from plantscope.llm import power_packing


def library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("capacity", [1024, 8])
def test_pieces_cover_documents_and_fill_sequences(spark, capacity):
    rows = power_packing.power_pack(documents(spark), capacity=capacity).collect()
    by_row = defaultdict(list)
    for r in rows:
        by_row[r["doc_id"], r["doc_tokens"]].append(r)
    want = defaultdict(int)
    for doc_id, text, *_ in messy():
        want[doc_id, len(library_ids(text))] += 1
    assert {k: len({r["piece"] for r in v if r["piece"] == 0}) for k, v in by_row.items()} == {k: 1 for k in want}
    for doc_id, text, *_ in messy():
        ids = np.array(library_ids(text), "<u4")
        mine = sorted((r for r in by_row[doc_id, len(ids)] if r["piece"] == 0 or True), key=lambda r: (r["piece"], r["start"]))
        copies = sum(1 for d, t, *_ in messy() if d == doc_id and len(library_ids(t)) == len(ids))
        lengths = power_packing.binary_lengths(len(ids), capacity)
        assert len(mine) == copies * len(lengths)
        for k, r in enumerate(mine[::copies]):
            assert (r["piece"], r["length"]) == (k, lengths[k])
            assert r["start"] == sum(lengths[:k])
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(x for _, x in places[:i]) for i in range(len(places))]
        assert len({x for _, x in places}) == 1 and sum(x for _, x in places) <= capacity
    per_length = defaultdict(int)
    for r in rows:
        per_length[r["length"]] += 1
    assert len(sequences) == sum(-(-n // (capacity // x)) for x, n in per_length.items())
    assert sorted(sequences) == list(range(len(sequences)))


def test_binary_lengths_and_empty_tables(spark):
    assert power_packing.binary_lengths(1, 1024) == [1]
    assert power_packing.binary_lengths(2048 + 5, 1024) == [1024, 1024, 4, 1]
    assert power_packing.binary_lengths(1023, 1024) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]
    assert power_packing.power_pack(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        power_packing.power_pack(documents(spark), capacity=1000)
