"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes holds how often each byte follows. A byte's code length is that of the longest context: -log2(count / (total + distinct)) where it was seen there, else the escape's, -log2(distinct / (total + distinct)), and the code length in the context that is one byte shorter; below order 0 all 256 bytes are alike. Statistics are frozen: a text is coded exactly by them, all of it, in every language, and the shortest code wins (a tie goes to the language that sorts first). The score is the language's share of probability among the languages, 2**-length each.

Statistics come from a hash-picked sample of whole texts: of each language about PER_LANGUAGE labelled documents, but no more than its part of SAMPLE documents and SAMPLE_BYTES bytes in all; the bounds are parameters. Every language that has a label is learned, with every string of its sample. The trees are counted on the executors and broadcast; languages share tables of strings by languages up to CELLS code lengths, and beyond that each has tables of its own strings only, which give the same code lengths.

halves() says which texts are in a language at all. The sample is halved by text and each half's trees code the other half's texts, so that none is coded by what was learned from itself or its copies. In its own language, the code length a byte that nine labelled texts in ten keep to, FAR times, is the language's limit, and what a text of n bytes may exceed it by is SPREAD times the spread of a byte's code length over sqrt(n). A language of fewer than LEAST texts has no limit of its own but the highest of the others; where there is none, every text with a letter is in a language.

Nulls: a text that is null, or has no letter, is `und` with score 0, as is every text where no language was learned. Rows with a null language are never learned from. Repeated rows each give a row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import hashed_share, release, sample_share, staged, text_bytes
from assayer.llm.textbytes import Lookup, blocks, joined

ORDER = 3
#: Documents a language learns from, on average; documents and bytes that all languages together learn from, on average.
PER_LANGUAGE, SAMPLE, SAMPLE_BYTES = 2000, 20000, 256 << 20
#: Code lengths in a table that languages share, and in what is worked on at once.
CELLS, AT_ONCE = 1 << 24, 1 << 19
#: A text is in a language up to FAR times the code length of its own texts, and SPREAD standard deviations of a byte's; from LEAST texts.
FAR, SPREAD, LEAST = 2.0, 3.0, 20
GAP = b"\n" * ORDER
LETTER = re.compile(r"[^\W\d_]").search


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it as one number, and each text's span of them; a text is taken to follow line ends."""
    a, start, end = joined(texts, GAP)
    g = a[ORDER:].astype(np.uint32)
    for k in range(1, ORDER + 1):
        g |= a[ORDER - k : len(a) - k].astype(np.uint32) << np.uint32(8 * k)
    return g, start - ORDER, end - ORDER


class Trees:
    """The languages' context trees as tables of code lengths, by order."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: of each language, the grams of ORDER + 1 bytes seen and how often."""
        self.languages = languages
        self.levels, self.each = [], []
        if len(languages) > 1 and len(np.unique(np.concatenate([g for g, _ in counts]))) * len(languages) > CELLS:
            self.each = [Trees([k], [c]) for k, c in zip(languages, counts, strict=True)]
            return
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            own = []
            for g, n in counts:
                key, where = np.unique(g.astype(np.uint64) & mask, return_inverse=True)
                own.append((key, np.bincount(where, n)))
            keys, where = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
            contexts = np.unique(keys >> np.uint64(8))
            cost = np.zeros((len(keys), len(languages)), np.float32)
            escape = np.zeros((len(contexts), len(languages)), np.float32)
            shorter = self._below(keys, order)
            at = np.searchsorted(contexts, keys >> np.uint64(8))
            for j, (key, n) in enumerate(own):
                place = np.searchsorted(contexts, key >> np.uint64(8))
                total, distinct = np.bincount(place, n, len(contexts)), np.bincount(place, minlength=len(contexts))
                seen = distinct > 0
                escape[seen, j] = -np.log2(distinct[seen] / (total + distinct)[seen])
                cost[:, j] = escape[at, j] + shorter[:, j]
                cost[np.searchsorted(keys, key), j] = -np.log2(n / (total + distinct)[place])
            self.levels.append((Lookup(keys), cost, Lookup(contexts), escape))

    def _below(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of grams in the order before."""
        if not order:
            return np.full((len(keys), len(self.languages)), 8, np.float32)
        return self.lengths(keys & np.uint64((1 << 8 * order) - 1), order - 1)

    def lengths(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code length of each gram in each language."""
        if self.each:
            return np.hstack([trees.lengths(g, order) for trees in self.each])
        places, cost, contexts, escape = self.levels[order]
        at = places(g)
        out = cost[at] if len(cost) else np.zeros((len(g), len(self.languages)), np.float32)
        if len(miss := np.flatnonzero(at < 0)):
            rest = g[miss].astype(np.uint64)
            known = contexts(rest >> np.uint64(8))
            out[miss] = np.where(known[:, None] >= 0, escape[known], 0) + self._below(rest, order)
        return out

    def totals(self, g: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code length of each text (its span of grams) in each language."""
        out = np.zeros((len(start), len(self.languages)))
        step = max(1024, AT_ONCE // max(1, len(self.languages)))
        for at in range(0, len(g), step):
            sums = np.zeros((min(step, len(g) - at) + 1, len(self.languages)))
            np.cumsum(self.lengths(g[at : at + step]), axis=0, dtype=np.float64, out=sums[1:])
            own = slice(np.searchsorted(end, at, "right"), np.searchsorted(start, at + step))
            a, b = (np.clip(x[own] - at, 0, len(sums) - 1) for x in (start, end))
            out[own] += sums[b] - sums[a]
        return out

    def of_one(self, g: np.ndarray, j: int) -> np.ndarray:
        """Code length of each gram in one language."""
        if self.each:
            return self.each[j].of_one(g, 0)
        step = max(1024, AT_ONCE // max(1, len(self.languages)))
        return np.concatenate([self.lengths(g[at : at + step])[:, j] for at in range(0, len(g), step)] or [np.zeros(0)]).astype(np.float64)


def sampled(docs: DataFrame, learnable: Column, per_language: int, sample: int, sample_bytes: int) -> DataFrame | None:
    """doc_id, lang and text of the learnable rows that languages learn from, or None where no row has a language."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"))
    there = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row a language
    if not there:
        return None
    most, most_bytes = min(per_language, -(-sample // len(there))), sample_bytes // len(there)
    part = {r["lang"]: min(sample_share(most, r["n"]), sample_share(most_bytes, r["bytes"])) for r in there}
    share = rows.sparkSession.createDataFrame([(k, int(v * (1 << 30))) for k, v in part.items()], "lang string, share long")
    picked = F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1 << 30)) < F.col("share")
    return staged(rows.join(F.broadcast(share), "lang").where(picked).select("doc_id", "lang", "text"), "language-sample")  # a row a language


def learn(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Context trees of the languages of docs(doc_id, text, lang), from a sample of the learnable rows."""
    rows = sampled(docs, learnable, per_language, sample, sample_bytes)
    return None if rows is None else grown(rows)


def halves(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[Column, tuple[Trees | None, Trees | None], dict[str, tuple[float, float]]]:
    """A condition that parts the docs; the trees to code the texts by where it is false and where it is true; and by language, the bits a byte that a text in it may take and the spread of a byte's, the highest under ''."""
    half = hashed_share(text_bytes(), 0.5, 3)
    rows = sampled(docs, learnable, per_language, sample, sample_bytes)
    if rows is None:
        return half, (None, None), {}
    pair = grown(rows.where(half)), grown(rows.where(~half))

    def measured(trees: Trees | None, own: DataFrame) -> DataFrame:
        model = own.sparkSession.sparkContext.broadcast(trees)

        def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees = model.value
            place = {k: j for j, k in enumerate(trees.languages if trees else [])}
            for x in frames:
                x = x[x["lang"].isin(list(place)) & (x["text"].str.len() > 0)]
                texts, at = list(x["text"]), x["lang"].map(place).to_numpy(np.int64)
                for part in blocks(texts):
                    g, start, end = grams(texts[part])
                    own = [trees.of_one(g[s:e], j) for s, e, j in zip(start, end, at[part], strict=True)]
                    yield pd.DataFrame({"lang": x["lang"].to_numpy()[part], "rate": [c.mean() for c in own], "spread": [c.std() for c in own]})
            release()

        return own.select("lang", "text").distinct().mapInPandas(measure, "lang string, rate double, spread double")

    rest = measured(pair[0], rows.where(~half)).union(measured(pair[1], rows.where(half)))
    got = rest.groupBy("lang").agg(F.percentile_approx("rate", 0.9).alias("rate"), F.percentile_approx("spread", 0.5).alias("spread"), F.count("*").alias("n")).where(F.col("n") >= LEAST).collect()
    of = {r["lang"]: (FAR * r["rate"], r["spread"]) for r in got}
    return half, pair, of | {"": max(of.values())} if of else {}


def grown(rows: DataFrame) -> Trees | None:
    """Context trees from all texts of rows(lang, text)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for lang, own in x.groupby("lang"):
                texts = list(own["text"])
                for part in blocks(texts):
                    g, start, end = grams(texts[part])
                    inside = np.zeros(len(g) + 1, np.int32)
                    np.add.at(inside, start, 1)
                    np.add.at(inside, end, -1)
                    key, n = np.unique(g[np.cumsum(inside)[:-1] > 0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": key.astype(np.int64), "n": n.astype(np.int64)})
        release()

    counted = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    of = {lang: (x["gram"].to_numpy(np.int64), x["n"].to_numpy(np.float64)) for lang, x in counted.groupby("lang")}
    return Trees(sorted(of), [of[k] for k in sorted(of)]) if of else None


def predictor(trees: Trees | None, limit: dict[str, tuple[float, float]] | None = None) -> Callable[[list[bytes]], tuple[list[str], list[float], list[bool]]]:
    """Of texts, the language, its score and whether the text is in it by the limits; without any, texts with a letter are."""
    most = [(limit or {}).get(k, (limit or {}).get("", (np.inf, 0.0))) for k in (trees.languages if trees else [])]
    rate, spread = np.array(most).reshape(-1, 2).T

    def predict(texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, known = [], [], []
        for part in blocks(texts):
            own = texts[part]
            lettered = [LETTER(t.decode("utf-8", "replace")) is not None for t in own]
            if trees is None:
                langs, scores, known = langs + ["und"] * len(own), scores + [0.0] * len(own), known + lettered
                continue
            g, start, end = grams(own)
            cost = trees.totals(g, start, end)
            best = cost.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(-1000, cost.min(axis=1)[:, None] - cost)).sum(axis=1)
            within = cost.min(axis=1) <= rate[best] * (end - start) + SPREAD * spread[best] * np.sqrt(end - start)
            langs += [trees.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            scores += [float(s) if ok else 0.0 for s, ok in zip(share, lettered, strict=True)]
            known += [bool(w and ok) for w, ok in zip(within, lettered, strict=True)]
        return langs, scores, known

    return predict


def identify(docs: DataFrame, trees: Trees | None, *keep: str, limit: dict[str, tuple[float, float]] | None = None, other: tuple[Column, Trees | None] | None = None) -> DataFrame:
    """The columns `keep` of docs, and lang_pred and score of its text; with limits, also `known`, whether it is in a language. other: a condition, and the trees for the texts where it is true. Only texts go to Python; no shuffle."""
    models = docs.sparkSession.sparkContext.broadcast((trees, other[1] if other else None))

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType())]))
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        of = [predictor(t, limit) for t in models.value]
        for x, which in batches:
            out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "known": False}, index=range(len(x)))
            which = which.to_numpy(bool)
            for k in (0, 1):
                if len(at := np.flatnonzero(which == k)):
                    langs, scores, known = of[k]([x.iloc[i] for i in at])
                    out.iloc[at] = pd.DataFrame({"lang_pred": langs, "score": scores, "known": known})
            yield out
        release()

    which = F.coalesce(other[0], F.lit(False)) if other else F.lit(False)
    return docs.withColumn("__p", predict(text_bytes(), which)).select(*keep, "__p.lang_pred", "__p.score", *["__p.known"] * (limit is not None))
