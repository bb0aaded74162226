import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base


def fields(r):
    q = r.quality
    return (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed)


def test_base_counts(spark, edge, none):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["a", "b", "c ", " ", "\n", "#", " ", "É"]) for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    texts += ["a b c a b c", "a a a a", "a b", "x\nx\n \nx", "w " * 60, " ".join(f"w{i}" for i in range(60))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality.judge(df).collect():
        assert fields(r) == brute(r.text), repr(r.text)
    rows = quality.judge(edge).collect()
    assert sorted(fields(r) for r in rows) == sorted(brute(r.text) for r in edge.collect())
    assert quality.judge(none).count() == 0 and quality.keep_good(none).columns == none.columns
    assert quality.keep_good(edge).columns == edge.columns


def corpus(n, share, seed=10):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        bad = rnd.random() < share
        words = [rnd.choice(vocabulary) + (rnd.choice(["###", "%%%", "|"]) if bad else "") for _ in range(int(rnd.lognormvariate(5, 0.8)) + 50)]
        rows.append((i, " ".join(words), rnd.choice(["en", None]), rnd.choice(["a", "a", "b"]), bad))
    return rows


def test_outliers_go_and_clean_texts_stay(spark):
    for share in (0.0, 0.1, 0.2):
        rows = corpus(800, share)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
        out = quality.judge(df).collect()
        assert [r.doc_id for r in out if r.quality.kept == r.bad] == []


def log_determinant(x):
    return np.linalg.slogdet(scatter(x))[1]


def scatter(x):
    return np.cov(x.T, bias=True) + np.diag(np.array(list(quality.FEATURES.values())) ** 2)


def test_least_determinant_of_all_subsets(spark):
    """Groups of 13 with five outliers: the core is that of all 1,287 subsets of 8 with the least determinant."""
    rng = np.random.default_rng(5)
    groups = {}
    for g in range(4):
        x = rng.normal(size=(13, 5)) @ rng.normal(size=(5, 5))
        x[8:] = x[:5] * 0.1 + rng.choice([-30, 30], size=(5, 5))
        groups[f"g{g}"] = x
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    fits = {r.grp: r for r in quality.estimates(df, core=8 / 13).collect()}
    for g, x in groups.items():
        best = min(combinations(range(13), 8), key=lambda s: log_determinant(x[list(s)]))
        core = x[list(best)]
        assert abs(fits[g].lndet - log_determinant(core)) < 1e-6
        assert np.allclose([fits[g][f"m{i}"] for i in range(5)], core.mean(axis=0))
        factor = np.array([[fits[g][f"l{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose(factor @ factor.T, scatter(core))


def test_steps_lower_determinants(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 5)), rng.normal(size=(100, 5)) + 9])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    few, many = (quality.estimates(df, most_steps=n).first().lndet for n in (3, 20))
    assert many <= few + 1e-9 and many < log_determinant(x[:900])


def test_small_groups_are_pooled(spark):
    rows = [(i, t, "en", "big" if i < 200 else f"s{i % 3}") for i, t, *_ in corpus(290, 0.0, 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for least, pooled in ((60, 90), (30, 0), (201, 290)):
        assert sum(r.quality.pooled for r in quality.judge(df, least=least).collect()) == pooled


def test_ids_play_no_part(spark):
    df = spark.createDataFrame([(i, t, "en", "a") for i, t, *_ in corpus(200, 0.1)], "doc_id long, text string, lang string, source string")
    other = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.keep_good(df).count() == quality.keep_good(other).count()


def test_outliers_in_each_statistic_go(spark):
    rnd = random.Random(12)
    good = [(i, r[1]) for i, r in enumerate(corpus(300, 0.0, 13))]
    vocabulary = sorted({w for _, t in good for w in t.split()})
    fresh = lambda n: rnd.sample(vocabulary, n)
    again, line = fresh(45), " ".join(fresh(2))  # no window of three words lies in such a line
    planted = {
        "length": " ".join(rnd.choice(vocabulary) for _ in range(60_000)),
        "word length": " ".join(a + b + c for a, b, c in zip(fresh(200), fresh(200), fresh(200), strict=True)),
        "symbols": " ".join(w + "#" * (i % 2) for i, w in enumerate(fresh(200))),
        "duplicate lines": "\n".join(x for w in fresh(150) for x in (line, w)),
        "repeated words": " ".join([*fresh(110), *again, *fresh(3), *again]),
    }
    rows = good + [(1000 + i, t) for i, t in enumerate(planted.values())]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    out = quality.judge(df).collect()
    assert not any(r.quality.base_failed for r in out)
    assert {r.doc_id for r in out if not r.quality.kept} == {1000 + i for i in range(len(planted))}
