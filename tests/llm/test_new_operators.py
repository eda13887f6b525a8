"""Positional index, whitening and hard negatives against plain Python, with nulls, ties, repeats, long and empty texts, clashing columns and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import hard_negatives, language_id, positional_index, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = ("row", "term", "pos", "id", "n", "x", "v", "label2", "item", "width", "start", "role", "words")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in docs:
        w, hit, who = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    who |= windows[key]
        out.append((doc, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "ab", "Ünd", "ünd", "x9"]) if rng.random() < 0.5 else "".join(rng.choice("abcdé") for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(1, prose(30)), (2, "The of, the of the"), (3, None), (4, "..."), (5, "single"), (10, prose(10)), (9, "two Words"), (None, prose(12)), (1, prose(15)), (6, " ".join(["the"] * 14)), (7, prose(25))]
    items.append((8, items[0][1]))
    texts = [None, "", "...", "the of the of the of the", "a SINGLE, one", "two words two words", "the " * 400, prose(3000), "ünd Ünd ÜND"]
    texts += [f"{prose(20)} {t.upper().replace('É', 'é')} {prose(9)}" for _, t in items if t] + [f"{prose(5)}; {' '.join(words(items[0][1])[3:16])} {prose(5)}" for _ in range(3)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, items[5][1]), (4, texts[4]), (4, "other single")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in docs], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)).coalesce(3)
    return d, spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, term string")


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(positional_index, "BROADCAST_BYTES", limit)
    docs, items = corpus()
    got = positional_index.contamination(*frames(spark, docs, items), 10)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = contamination(docs, items, 10)
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(r[5] for r in want) > 10


def test_contamination_of_nothing(spark):
    docs, items = frames(spark, *corpus())
    assert positional_index.contamination(docs.limit(0), items).count() == 0
    none = positional_index.contamination(docs, items.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated or r.n_hit or r.n_items for r in none)


def test_native(spark):
    docs, items = frames(spark, *corpus())
    plan = positional_index.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("within", [0, 3, 8])
def test_near(spark, within):
    docs, items = corpus(2)
    d, i = frames(spark, docs, items)
    index = positional_index.build(d, positional_index.item_terms(i))
    ids = [r.doc_id for r in index.documents().orderBy("row").collect()]
    assert ids == [r[0] for r in docs]
    texts = dict(zip([r.row for r in index.documents().orderBy("row").collect()], docs, strict=True))
    counts = Counter(w for _, t in docs for w in words(t))
    numbers = {r.term: r.id for r in index.terms.collect()}
    want = Counter()
    for item, text in items:
        terms = sorted(set(words(text)), key=lambda t: (counts[t], numbers[t]))
        for row, (_, doc) in texts.items() if terms else ():
            w = words(doc)
            for p in (p for p, x in enumerate(w) if x == terms[0]):
                if set(terms) <= set(w[max(0, p - within) : p + within + 1]):
                    want[("" if item is None else str(item), row, p)] += 1
    assert Counter(map(tuple, positional_index.near(index, i, within).collect())) == want and (within == 0 or want)


def vectors(n=300, dim=20, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dim)) * np.linspace(2, 0.3, dim)).astype(np.float32)
    rows = [(i, v.tolist(), int(rng.integers(4))) for i, v in enumerate(x)]
    rows[7] = (7, rows[8][1], 1)
    rows += [(1000, None, 1), (1001, [], 1), (1002, [1.0] * (dim - 1) + [None], 2), (1003, [float("nan")] * dim, 1), (1004, [float("inf")] + [0.0] * (dim - 1), 0), (1005, [1.0, 2.0], 1), (None, [0.5] * dim, 1)]
    return rows


def embedded(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, id string, x string, n string").repartition(3)


def test_whitening(spark):
    rows = vectors()
    kept = [r for r in rows if r[1] and len(r[1]) == 20 and None not in r[1] and np.isfinite(r[1]).all()]
    got = whitening.whiten(embedded(spark, rows), 8).toPandas()
    x = np.floor(1024 * np.array([r[1] for r in kept], np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 8 * n and (got["n"] == n).all() and got["identity_error"].max() < 1e-10
    ids = [-1 if r[0] is None else r[0] for r in kept]
    wide = got.assign(vec_id=got["vec_id"].fillna(-1).astype(int)).pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = (x - s / n) @ axes[:, :8] / np.sqrt(values[:8])
    assert np.abs(np.abs(wide) - np.abs(want)).max() < 1e-8
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() / (values[:8] / values.sum()) - 1).max() < 1e-9
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for i, v in zip(ids, x, strict=True)}
    assert got.assign(vec_id=got["vec_id"].fillna(-1).astype(int)).groupby("vec_id")["deviation"].first().to_dict() == deviation


def test_whitening_without_variance(spark):
    one = whitening.whiten(embedded(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0)]), 8).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 2 for r in one)
    flat = whitening.whiten(embedded(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)]), 2).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True] * 5
    assert whitening.whiten(embedded(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("spectrum", ["decay", "rank", "flat", "gap", "huge", "zero", "even"])
def test_components(spectrum):
    rng, d = np.random.default_rng(4), 90
    ev = {"decay": np.logspace(0, -12, d), "rank": np.r_[[5.0, 3, 1], np.zeros(d - 3)], "flat": np.ones(d), "gap": np.r_[np.arange(20.0, 10, -1), np.full(d - 10, 1e-3)], "huge": np.r_[[1e8], np.linspace(2, 1, d - 1)], "zero": np.zeros(d), "even": np.linspace(1, 0.5, d)}[spectrum]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = (q * ev) @ q.T
    v = (v + v.T) / 2
    seen = []
    values, axes = whitening.components(lambda y: (seen.append(y.shape[1]), v @ y)[1], d, 8)
    assert np.abs(values - ev[:8]).max() <= 1e-12 * ev[0] and np.abs(v @ axes - axes * values).max() <= 1e-11 * ev[0]
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12 and len(seen) < 120


def mined(rows, every, positives, negatives, least, most):
    x = {i: (k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, k in rows if i is not None and v and len(v) == 20 and None not in v and np.isfinite(v).all() and k is not None}
    out = []
    for a in (i for i in x if i % every == 0):
        score = {i: int(x[a][1] @ v) for i, (_, v) in x.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if x[i][0] == x[a][0]][:positives]:
            met = [i for i in order if x[i][0] != x[a][0] and least * score[p] <= 100 * score[i] <= most * score[p]][:negatives]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(met)]
    return out


@pytest.mark.parametrize("block", [4 << 20, 64 * 8 * 20])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rows = vectors(seed=3) + [(2000, [0.25] * 20, None), (2010, [0.0] * 20, 1)] + [(3000 + i, [1.0] * 20, i % 3) for i in range(30)]
    df = embedded(spark, [*rows, rows[5]])
    got = hard_negatives.mine(df, lambda i: i % 10 == 0, F.col("label"), 5, 10, 30, 90)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, 10, 5, 10, 30, 90)
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(want) > 500


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(embedded(spark, []).limit(0), lambda i: i % 10 == 0, F.col("label")).count() == 0
    assert hard_negatives.mine(embedded(spark, [(1, [1.0], 0), (2, [2.0], 1)]), lambda i: i % 10 == 0, F.col("label")).count() == 0
    assert hard_negatives.mine(embedded(spark, [(10, [1.0], 0), (2, [2.0], 1)]), lambda i: i % 10 == 0, F.col("label")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(8)
    import pandas as pd

    x = np.floor(rng.standard_normal((50, 37)) * 300 + 40)
    held = np.hstack([np.sqrt((x * x).sum(axis=1))[:, None], *(p for pair in hard_negatives.summaries(x) for p in pair)])
    rows = hard_negatives.Rows(pd.DataFrame({"id": range(50), "label": ["a"] * 50, "x": [r.tobytes() for r in x.astype(np.int64)], "summary": [r.tobytes() for r in held]}), 37)
    exact, all_ = x @ x.T, np.arange(50)
    low, high = hard_negatives.coarse(rows, all_, rows, all_)
    assert (low <= exact).all() and (exact <= high).all()
    for level in (1, 2):
        for i in range(50):
            lo, hi = hard_negatives.finer(rows, i, rows, all_, level)
            assert (lo <= exact[i]).all() and (exact[i] <= hi).all() and (hi - lo <= high[i] - low[i] + 1e-6).all()


def test_many_languages_keep_every_string(monkeypatch):
    """Tables of each language's own strings give the code lengths of shared tables, bit by bit, for 600 languages."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefghijklmnop", np.uint8), 60 + k % 7)) for k in range(600)]
    counts = []
    for t in texts:
        g, start, end = language_id.grams([t])
        key, n = np.unique(g[start[0] : end[0]], return_counts=True)
        counts.append((key.astype(np.int64), n.astype(np.float64)))
    names = [f"l{k:03}" for k in range(600)]
    monkeypatch.setattr(language_id, "CELLS", 1 << 30)
    shared = language_id.Trees(names, counts)
    monkeypatch.setattr(language_id, "CELLS", 1000)
    apart = language_id.Trees(names, counts)
    assert not shared.each and len(apart.each) == 600
    g, start, end = language_id.grams([*texts[:40], b"xyz abc", b"", b"\xff\x00"])
    assert (shared.lengths(g) == apart.lengths(g)).all() and (shared.totals(g, start, end) == apart.totals(g, start, end)).all()
    assert (shared.of_one(g, 17) == apart.of_one(g, 17)).all() and (shared.totals(g, start, end)[:40].argmin(axis=1) == np.arange(40)).all()
