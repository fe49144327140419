import random
import re
import zlib
from collections import Counter

from fixtures import SCHEMA, documents, messy

from plantscope.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 97 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_equal_brute_force(spark):
    r = random.Random(7)
    base = ["hello", "world", "spelling", "variant", "éclair", "naïve", "ÀÉÎÕÜ", "abcde", "abcdf", "abcdef", "xabcde", "zzzzz"]
    vocab = base + [w[:i] + w[i + 1 :] for w in base for i in range(len(w))] + [w[:i] + "q" + w[i:] for w in base[:4] for i in range(len(w) + 1)]
    rows = []
    for k in range(300):
        words = [r.choice(vocab) if r.random() < 0.5 else r.choice(base) for _ in range(r.randint(0, 30))]
        rows.append((k % 120 if k % 17 else None, " ".join(w.upper() if r.random() < 0.1 else w for w in words) + r.choice(["", ". ", "12", "_"])))
    rows += [(5, None), (6, ""), (7, "Straße straße STRASSE" * 3)] * 2
    df = spark.createDataFrame([(i, t, "en", 0, 0, "s", "c", 0, "k") for i, t in rows], SCHEMA)
    assert got(spelling.spelling_variants(df)) == plain(rows)


def test_messy_documents_and_empty_tables(spark):
    docs = documents(spark)
    assert got(spelling.spelling_variants(docs)) == plain([(r[0], r[1]) for r in messy()])
    assert spelling.spelling_variants(documents(spark, [])).count() == 0


def test_chains_lead_to_the_root(spark):
    # words at one edit from each other with doubling counts: the root of all is the most frequent
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))
    df = spark.createDataFrame([(None, text, "en", 0, 0, "s", "c", 0, "k")], SCHEMA)
    out = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_variants(df).collect()}
    assert out == {"abcdefg": ("abcdefgh", "abcdefghij"), "abcdefgh": ("abcdefghi", "abcdefghij"), "abcdefghi": ("abcdefghij", "abcdefghij"), "abcdefghij": (None, "abcdefghij")}
