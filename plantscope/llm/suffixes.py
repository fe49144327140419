"""Removal of repeated passages: every byte covered by a string of fifty bytes that also starts in an earlier document.

A window of fifty bytes is looked up only where its anchor, the sixteen bytes in it
with the smallest hash, also occurs in another document. Neighbouring windows with one
anchor travel as one string, so each window travels once. Strings of one anchor meet in one
task, where deep-shallow sorting brings equal windows together: multikey quicksort on words
of eight bytes down to a shallow depth, then a blind trie for each group that agrees that
far and isn't alike throughout.

Hot passages: a batch of texts sends one copy of a string, that of its smallest
document, and settles the others itself, so a passage that a third of all documents share meets as
many times as there are batches. Where such a passage borders on different texts, its anchor's strings
all differ; windows of anchors held by very many documents therefore travel one by one under their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm.registry import query, table
from plantscope.llm.shingles import BYTE, chunks, mix
from plantscope.session import materialize

WIDTH = 50
ANCHOR = 16
BATCH = 4_000_000
SHALLOW = 24
#: An anchor is hot when it is held by more documents than this and by more than one of ONE_IN anchors.
LEAST_HOT, ONE_IN = 20_000, 100_000
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(2**64 - 1)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, by doubling."""
    part, have, out, done, left = BYTE[data], 1, None, 0, size
    while left:
        if left & 1:
            n = len(data) - (done + have) + 1
            out = part[:n].copy() if out is None else out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + part[done : done + n]
            done += have
        left >>= 1
        if left:
            n = len(part) - have
            part = part[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + part[have : have + n]
            have *= 2
    return mix(out)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - size + 1], out[size - span :][: len(x) - size + 1])


def anchored(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document number, first window, number of windows, hash of the anchor; and all bytes.

    Places count bytes in the joined documents. Equal windows have equal anchors at equal places in them.
    """
    data = np.frombuffer(b"".join(docs), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, none.astype(np.uint64), data
    size = np.array([len(d) for d in docs])
    ends = np.cumsum(size)
    h = rolling(data, ANCHOR)
    # which of equal hashes anchors a window doesn't matter, only that the value is the same: strings meet by value
    low = _sliding_min(h, WIDTH - ANCHOR + 1)
    inside = np.zeros(len(data) + 1, np.int32)  # windows that lie in one document
    long = size >= WIDTH
    np.add.at(inside, (ends - size)[long], 1)
    np.add.at(inside, ends[long] - WIDTH + 1, -1)
    place = np.flatnonzero(np.cumsum(inside[: len(low)]))
    value = low[place]
    doc = np.searchsorted(ends, place, side="right")
    new = np.ones(len(place), bool)
    new[1:] = (value[1:] != value[:-1]) | (np.diff(place) > 1) | (np.diff(doc) > 0)
    first = np.flatnonzero(new)
    return doc[first], place[first], np.diff(first, append=len(place)), value[first], data


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _short(values: np.ndarray) -> np.ndarray:
    """Six bytes of an anchor's hash: enough for a filter whose false hits are only looked up in vain."""
    return values & np.uint64(2**48 - 1)


def _batches(batches: Iterator[pd.DataFrame]):
    for pdf in batches:
        at = 0
        for docs in chunks(pdf["text"], BATCH):
            yield pdf.iloc[at : at + len(docs)], docs
            at += len(docs)


def _send_anchors(targets: int):
    """Per batch: (target, known, anchors, documents, counts). Not known: one row for each anchor, for its smallest document."""

    def run(batches):
        for pdf, docs in _batches(batches):
            ids = pdf["id"].to_numpy(np.int64)
            first = {}
            for i in np.argsort(ids, kind="stable"):  # of equal texts the smallest document speaks
                first.setdefault(docs[i], i)
            keep = sorted(first.values())
            doc, _, _, value, _ = anchored([docs[i] for i in keep])
            if not len(doc):
                continue
            owner, value = ids[np.array(keep)][doc], _short(value)
            order = np.lexsort((owner, value))
            owner, value = owner[order], value[order]
            once = np.ones(len(value), bool)
            once[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            owner, value = owner[once], value[once]
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            held = np.diff(start, append=len(value)).astype(np.int32)
            others = np.ones(len(value), bool)
            others[start] = False
            for known, v, o, n in ((False, value[start], owner[start], held), (True, value[others], owner[others], np.ones(int(others.sum()), np.int32))):
                to = (mix(o.astype(np.uint64)) if known else v) % np.uint64(targets)
                by = np.lexsort((o, to))
                v, o, n, to = v[by], o[by], n[by], to[by]
                cuts = np.flatnonzero(np.diff(to, prepend=np.uint64(targets)))
                for a, b in zip(cuts, [*cuts[1:], len(to)]):
                    yield pd.DataFrame({"target": [int(to[a])], "known": [known], "anchors": [_packed(v[a:b])], "owners": [o[a:b].tobytes()], "counts": [n[a:b].tobytes()]})

    return run


SENT = "target int, known boolean, anchors binary, owners binary, counts binary"
SHARED = "id long, anchors binary"


def _shared_anchors(hot: float):
    """Per target: the anchors of each document that other documents hold as well; under id NULL those that are hot."""

    def settle(rows):
        known = [r for r in rows if r[0]]
        new = [r for r in rows if not r[0]]
        owner = np.concatenate([np.frombuffer(r[2], np.int64) for r in known] + [np.zeros(0, np.int64)])
        value = np.concatenate([_unpacked(r[1]) for r in known] + [np.zeros(0, np.uint64)])
        if new:
            v, o, n = (np.concatenate(x) for x in zip(*[(_unpacked(r[1]), np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.int32)) for r in new]))
            order = np.lexsort((o, v))
            v, o, n = v[order], o[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            size = np.diff(start, append=len(v))
            total = np.add.reduceat(n.astype(np.int64), start)
            more = (np.maximum.reduceat(o, start) > np.minimum.reduceat(o, start)) | (np.maximum.reduceat(n, start) > 1)
            good = np.repeat(more, size)
            owner, value = np.concatenate([owner, o[good]]), np.concatenate([value, v[good]])
            if (total > hot).any():
                yield pd.DataFrame({"id": pd.array([None], dtype="Int64"), "anchors": [_packed(v[start][total > hot])]})
        if len(owner):
            order = np.argsort(owner, kind="stable")
            owner, value = owner[order], value[order]
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            yield pd.DataFrame({"id": pd.array(owner[cuts], dtype="Int64"), "anchors": [_packed(value[a:b]) for a, b in zip(cuts, [*cuts[1:], len(owner)])]})

    def run(batches):
        held, at = [], None
        for pdf in batches:
            for t, *row in pdf.itertuples(index=False):
                if t != at and held:
                    yield from settle(held)
                    held = []
                at = t
                held.append(row)
        if held:
            yield from settle(held)

    return run


def _send_strings(hot: np.ndarray):
    """Per batch: (key, id, start, windows) of strings to look up, and with windows NULL spans (start, stop) settled here."""

    def run(batches):
        for pdf, docs in _batches(batches):
            ids = pdf["id"].to_numpy(np.int64)
            doc, place, count, value, data = anchored(docs)
            if not len(doc):
                continue
            short = _short(value)
            asked = np.repeat(np.arange(len(docs)), [len(a) // 6 for a in pdf["anchors"]])
            wanted = np.concatenate([_unpacked(a) for a in pdf["anchors"]])
            pair = np.sort(mix(wanted + mix(asked.astype(np.uint64))))
            mine = mix(short + mix(doc.astype(np.uint64)))
            at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            keep = (pair[at] == mine) if len(pair) else np.zeros(len(mine), bool)
            doc, place, count, short = doc[keep], place[keep], count[keep], short[keep]
            key = short.copy()
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short
                if is_hot.any():  # one row for each window, under its own hash
                    n = count[is_hot]
                    each = np.repeat(place[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = rolling(data, WIDTH)[each]
                    doc, place = np.concatenate([doc[~is_hot], np.repeat(doc[is_hot], n)]), np.concatenate([place[~is_hot], each])
                    count, key = np.concatenate([count[~is_hot], np.ones(len(each), np.int64)]), np.concatenate([key[~is_hot], own])
            begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            raw = data.tobytes()
            strings = [raw[p : p + c + WIDTH - 1] for p, c in zip(place.tolist(), count.tolist())]
            owner = ids[doc]
            first: dict[bytes, int] = {}
            for i in np.argsort(owner, kind="stable").tolist():
                first.setdefault(strings[i], i)
            least = np.array([owner[first[s]] for s in strings], np.int64)
            start = place - begin[doc]
            settled = owner > least
            # of equal strings in the batch the first goes on, and those of the same document, for they have to be cut with it
            send = ~settled
            yield pd.DataFrame({
                "key": np.concatenate([key[send].view(np.int64), mix(owner[settled].astype(np.uint64)).view(np.int64)]),
                "id": np.concatenate([owner[send], owner[settled]]),
                "start": np.concatenate([start[send], start[settled]]),
                "stop": np.concatenate([np.zeros(int(send.sum()), np.int64), (start + count + WIDTH - 1)[settled]]),
                "windows": [s for s, k in zip(strings, send) if k] + [None] * int(settled.sum()),
            })

    return run


STRINGS = "key long, id long, start long, stop long, windows binary"


def blind_trie(strings: list[bytes], limit: int) -> list[list[int]]:
    """The strings in order, as groups of those that agree in their first ``limit`` bytes.

    A node of the trie keeps only the depth at which its strings part. A string
    descends blindly by single bytes, is compared once with the leaf it comes to, and is hung in where the two differ.
    """
    leaf = [[0]]
    root = leaf
    for i, s in enumerate(strings[1:], 1):
        node = root
        while isinstance(node, tuple):  # (depth, {byte: node})
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0][0] if isinstance(node[0], list) else node[0]]
        a, b = s[:limit], other[:limit]
        if a == b:
            node[0].append(i)
            continue
        x = int.from_bytes(a) ^ int.from_bytes(b)
        depth = limit - (x.bit_length() + 7) // 8
        parent, edge, node = None, None, root
        while isinstance(node, tuple) and node[0] < depth:
            parent, edge, node = node, s[node[0]], node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [[i]]
            continue
        fork = (depth, {other[depth]: node, s[depth]: [[i]]})
        if parent is None:
            root = fork
        else:
            parent[1][edge] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.append(node[0])
    return out


def equal_windows(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each place that is shared by just those whose next WIDTH bytes agree, by deep-shallow sorting."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])

    def word(p):  # eight bytes as one big-endian number
        out = np.zeros(len(p), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | padded[p + k].astype(np.uint64)
        return out

    group = np.zeros(len(places), np.int64)
    alone = np.zeros(len(places), bool)
    for depth in range(0, SHALLOW, 8):
        todo = np.flatnonzero(~alone)
        keys = word(places[todo] + depth)
        order = np.lexsort((keys, group[todo]))
        g, k = group[todo][order], keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(order))
        group[todo[order]] = np.repeat(todo[order][first], size)  # named after one of its members
        alone[todo[order]] = np.repeat(size == 1, size)
    todo = np.flatnonzero(~alone)
    if not len(todo):
        return group
    # groups that agree throughout are done; the others go through a blind trie
    lead = places[group[todo]]
    same = np.ones(len(todo), bool)
    for depth in (*range(SHALLOW, WIDTH - 8, 8), WIDTH - 8):
        same &= word(places[todo] + depth) == word(lead + depth)
    mixed = np.isin(group[todo], group[todo][~same])
    rest = todo[mixed]
    rest = rest[np.argsort(group[rest], kind="stable")]
    raw = data.tobytes()
    cuts = np.flatnonzero(np.diff(group[rest], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rest)]):
        members = rest[a:b]
        tails = [raw[p + SHALLOW : p + WIDTH] for p in places[members].tolist()]
        for alike in blind_trie(tails, WIDTH - SHALLOW):
            group[members[alike]] = members[alike[0]]
    return group


def _look_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans (id, start, stop) of windows that a smaller document holds, among strings whose keys are all here."""
    code, strings = pd.factorize(rows["windows"])
    owner, key = rows["id"].to_numpy(), rows["key"].to_numpy()
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, code, owner)
    of_key = np.zeros(len(strings), np.int64)
    of_key[code] = key
    size = np.array([len(s) for s in strings])
    start = rows["start"].to_numpy()
    out = [(owner[(w := owner > least[code])], start[w], (start + size[code])[w])]  # the whole string is in a smaller document
    kinds, number = np.unique(of_key, return_inverse=True)
    some = np.flatnonzero(np.bincount(number)[number] > 1)  # strings that share their anchor with other strings
    if len(some):
        data = np.frombuffer(b"".join(strings[i] for i in some), np.uint8)
        windows = size[some] - WIDTH + 1
        base = np.cumsum(size[some]) - size[some]
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        group = equal_windows(data, np.repeat(base, windows) + inner)
        held = np.repeat(least[some], windows)
        lowest = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, held)
        hit = held > lowest[group]
        edge = hit & ~np.concatenate([[False], hit[:-1] & (inner[1:] > 0)])
        last = hit & ~np.concatenate([hit[1:] & (inner[1:] > 0), [False]])
        string = np.repeat(np.arange(len(some)), windows)[edge]
        spans = pd.DataFrame({"code": some[string], "a": inner[edge], "b": inner[last] + WIDTH})
        # every document that holds the string is cut alike; larger ones than its smallest have lost it whole
        mine = pd.DataFrame({"code": code[~w], "id": owner[~w], "start": start[~w]}).merge(spans, on="code")
        out.append((mine["id"].to_numpy(), (mine["start"] + mine["a"]).to_numpy(), (mine["start"] + mine["b"]).to_numpy()))
    return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("id", "start", "stop"), zip(*out))})


def _sorted_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of their keys; whole keys are looked up about a million windows at a time."""
    held, size = [], 0
    for pdf in batches:
        settled = pdf["windows"].isna()
        if settled.any():
            yield pdf.loc[settled, ["id", "start", "stop"]]
            pdf = pdf[~settled]
        if not len(pdf):
            continue
        windows = pdf["windows"].map(len).to_numpy() - WIDTH + 1
        keys = pdf["key"].to_numpy()
        at = 0
        for cut in np.flatnonzero(keys[1:] != keys[:-1]) + 1:
            if size + windows[at:cut].sum() >= 1_000_000:
                held.append(pdf.iloc[at:cut])
                yield _look_up(pd.concat(held, ignore_index=True))
                held, size, at = [], 0, cut
        if at == 0 and held and keys[0] != held[-1]["key"].iloc[-1] and size >= 1_000_000:
            yield _look_up(pd.concat(held, ignore_index=True))
            held, size = [], 0
        held.append(pdf.iloc[at:])
        size += int(windows[at:].sum())
    if held:
        yield _look_up(pd.concat(held, ignore_index=True))


def _merged(spans) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans: starts and stops, in order."""
    a, b = np.array([x["start"] for x in spans]), np.array([x["stop"] for x in spans])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([new[1:], [True]])]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text, spans in pdf[["id", "text", "spans"]].itertuples(index=False):
            raw = (text or "").encode()
            a, b = _merged(spans)
            kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)]))
            rows.append((i, int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), hashlib.sha256(raw).hexdigest()))
        yield pd.DataFrame(rows, columns=["id", "n_removed", "n_spans", "kept_sha256", "whole"])


def repeated_spans(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows (id, text) without NULL ids: their digests, with the smallest id of equal texts, the spans to remove by id, and the texts dealt by id."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    digests = materialize(digests, "digests")
    classes = digests.groupBy("whole").agg(F.min("id").alias("least"))
    total = digests.agg(F.sum("n_bytes")).first()[0] or 0
    hot_from = max(LEAST_HOT, total / (WIDTH - ANCHOR) * 2 / ONE_IN)

    sent = rows.mapInPandas(_send_anchors(4 * partitions), SENT)
    dealt = sent.repartition(partitions, "target").sortWithinPartitions("target")
    shared = materialize(dealt.mapInPandas(_shared_anchors(hot_from), SHARED), "anchors")
    found = shared.where("id is null").collect()  # at most ONE_IN hashes in all
    hot = np.unique(np.concatenate([_unpacked(r["anchors"]) for r in found] + [np.zeros(0, np.uint64)]))

    speakers = classes.select(F.col("least").alias("id")).distinct()
    asked = shared.where("id is not null").groupBy("id").agg(F.array_join(F.collect_list(F.hex("anchors")), "").alias("hexes"))
    asked = asked.join(speakers, "id", "left_semi").select("id", F.unhex("hexes").alias("anchors"))
    texts = rows.repartition(partitions, "id")
    strings = texts.join(asked, "id").select("id", "text", "anchors").mapInPandas(_send_strings(hot), STRINGS)
    spans = strings.repartition(partitions, "key").sortWithinPartitions("key").mapInPandas(_sorted_spans, "id long, start long, stop long")
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return digests.join(classes, "whole"), spans, texts


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for every row: what is left without repeated passages.

    Texts are UTF-8 bytes; NULL counts as empty. A byte goes if a string of WIDTH bytes that covers it also starts in a
    document with a smaller id. Shorter texts stay whole. A row without id stays whole and takes nothing from others. Rows with one id
    take nothing from each other. Other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digests, spans, texts = repeated_spans(rows.where("id is not null"))
    cut = texts.join(spans, "id").select("id", "text", "spans").mapInPandas(_cut, "id long, n_removed long, n_spans long, kept_sha256 string, whole string")
    cut = cut.distinct()  # equal rows are cut alike
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= WIDTH)
    zero = F.lit(0).cast("long")
    done = digests.join(cut, ["id", "whole"], "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
    nameless = rows.where("id is null").select(
        F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return done.unionByName(nameless)


def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(text, spans):
        if t is None or s is None or not len(s):
            out.append(t)
            continue
        raw = t.encode()
        kept, at = [], 0
        for a, b in zip(*_merged(s)):
            while a < b and raw[a] & 0xC0 == 0x80:  # a character that is covered in part stays
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            kept.append(raw[at:a])
            at = b
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the texts, to whole characters; rows, columns and NULLs stay.

    A text that repeats an earlier document whole becomes empty. Ids as in :func:`repeats_removed`.
    """
    q = lambda c: F.col(f"`{c.replace('`', '``')}`")
    taken = {c.lower() for c in docs.columns}

    def free(name):
        while name in taken:
            name = f"_{name}"
        return name

    rows = docs.select(q(id_col).cast("long").alias("id"), F.coalesce(q(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    digests, spans, _ = repeated_spans(rows)
    copies = digests.where(f"id > least and n_bytes >= {WIDTH}").select(
        "id", "whole", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans")).dropDuplicates(["id", "whole"])
    speaking = digests.where("id = least").select("id", "whole").distinct().join(spans, "id")
    found = speaking.unionByName(copies)
    i, w, s = free("_id"), free("_whole"), free("_spans")
    found = found.select(F.col("id").alias(i), F.col("whole").alias(w), F.col("spans").alias(s))
    whole = F.sha2(F.coalesce(q(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    joined = docs.join(found, (q(id_col).cast("long") == F.col(i)) & (whole == F.col(w)), "left")
    cut = F.pandas_udf(_without, "string")
    return joined.select(*[cut(q(c), F.col(s)).alias(c) if c == text_col else q(c) for c in docs.columns])


ORACLE = r"""
with b as (select doc_id, encode(coalesce(text, '')) as raw from documents),
h as (select doc_id, hex(raw) as x, octet_length(raw) as n from b),
g as (select doc_id, unnest(generate_series(0, n - 50)) as p, x from h where n >= 50),
k as (select doc_id, p, substr(x, 2 * p + 1, 100) as s from g),
m as (select s, min(doc_id) as least from k group by s),
r as (select k.doc_id, k.p from k join m using (s) where m.least < k.doc_id),
e as (select doc_id, p, lag(p) over (partition by doc_id order by p) as last from r),
f as (select doc_id, p, sum(case when last is null or p > last + 50 then 1 else 0 end) over (partition by doc_id order by p) as run from e),
s as (select doc_id, run, min(p) as a, max(p) + 50 as b from f group by doc_id, run),
t as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from s),
j as (select t.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as tail, string_agg(substr(h.x, 2 * before + 1, 2 * (a - before)), '' order by a) as head
      from t join h using (doc_id) group by t.doc_id)
select h.doc_id, cast(h.n as bigint) as n_bytes, cast(coalesce(j.n_removed, 0) as bigint) as n_removed, coalesce(j.n_spans, 0) as n_spans,
  sha256(unhex(case when j.doc_id is null then h.x else j.head || substr(h.x, 2 * j.tail + 1) end)) as kept_sha256
from h left join j using (doc_id)
"""


@query("op7_suffix_dedup", ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))
