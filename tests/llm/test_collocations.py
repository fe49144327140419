import random
import re
from collections import Counter

from fixtures import SCHEMA, documents

from plantscope.llm import collocations


def plain(rows, least, top):
    """Collocations by counting every phrase of every piece, and trying every cut."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall(r"[^\x20\t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, " ".join(w[i : i + size])] += 1
    cands = {(lang, p): a for (lang, p), a in f.items() if a >= least and len(p.split(" ")) >= 2}
    out = []
    for (lang, p), a in cands.items():
        w = p.split(" ")
        if len(w) == 2 and any(100 * b >= 50 * a for (lg, q), b in cands.items() if lg == lang and len(q.split(" ")) == 3 and p in (" ".join(q.split(" ")[:2]), " ".join(q.split(" ")[1:]))):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, p, a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_equal_plain_counting(spark):
    r = random.Random(4)
    vocab = ["the", "of", "New", "york", "new", "city", "é", "中文", "a b", "x"]
    rows = []
    for k in range(120):
        words = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        text = "".join(w + r.choice([" ", " ", "\t", ". ", ", ", "\n", "  ", "!"]) for w in words)
        rows.append((k % 50, text, r.choice(["en", "de", None])))
    rows += [(None, None, "en"), (7, "", None), (8, "new york city new york city", "en")] * 2
    df = spark.createDataFrame([(i, t, lang, 0, 0, "s", "c", 0, "k") for i, t, lang in rows], SCHEMA)
    for least, top in ((2, 2000), (5, 3), (40, 2000)):
        assert got(collocations.collocations(df, least=least, top=top)) == plain([(t, lang) for _, t, lang in rows], least, top)


def test_collocations_of_messy_and_empty_tables(spark):
    docs = documents(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert got(collocations.collocations(docs, least=3)) == plain(rows, 3, 2000)
    assert collocations.collocations(documents(spark, [])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12, 10**12 + 1, 10**12 + 3)], "a long, l long, r long")
    assert df.select(collocations.exact_score().alias("s")).first()["s"] == 10**6 * 10**24 // ((10**12 + 1) * (10**12 + 3))


def test_only_phrases_of_frequent_pairs_are_sent_as_text(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 300)  # many slices, each with a part of the counts
    monkeypatch.setattr(collocations, "PER_BUCKET", 500)
    r = random.Random(9)
    rows = [(" ".join(f"rare{r.randint(0, 10**6)}" if r.random() < 0.6 else r.choice(["new", "york", "city", "\u00e9t\u00e9"]) for _ in range(30)), r.choice(["en", None])) for _ in range(200)]
    df = spark.createDataFrame([(i, t, lang, 0, 0, "s", "c", 0, "k") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    assert got(collocations.collocations(df, least=6)) == plain(rows, 6, 2000)
    plan = collocations.phrase_counts(df, least=6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan  # no row for each place of a word
