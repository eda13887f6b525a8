"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters, digits, apostrophes and non-ASCII bytes, A-Z folded. A chain has two states, clean and toxic; a token's features are its whole form and its first 3, 4 and 5 bytes, hashed, and whether one of them is listed. Labels are given for documents only, so a list comes first: over all labelled texts, each text once, it is counted in how many toxic and clean ones a form or a beginning is found, and those found in toxic ones far more often than chance allows, and nearly only there, are listed. exp(-r / 2) bounds the chance of a log likelihood ratio of r / 2, and CHANCE is shared by the forms that are frequent enough to reach their part of it (Tarone's correction), so how often a form must occur depends on the number of forms and not on its share of the documents. In toxic documents of the training sample, tokens with a listed form are labelled toxic, and the field is trained on those chains by gradient steps on the exact likelihood. Of every second listed token it sees only that it is listed, so that listed forms count that no text of the sample holds. Forward and backward sums run over a whole batch as one chain that restarts at every document, in blocks of prefix products.

A document's score comes from the marginals: that of its likeliest token, which doesn't grow with the document's length, put on the scale of the labels by a logistic fit. Tokens with p >= 0.5 give the offending spans.

Counting takes all learnable labelled texts, as an aggregate by form; a filter of their ids, of fixed size, leaves other texts where they are. Training takes a hash-picked sample of about PER_CLASS labelled texts of either class and at most about CLASS_BYTES bytes of them, whole texts, each once; the bounds are parameters. One task fits the model, whose size is fixed but for the list of toxic forms, 8 bytes each.

Nulls: a null text counts as empty and scores as a text without toxic tokens; rows with a null label are never learned from. Without labels of both classes, or where no form qualifies, every score is 0. Repeated rows each give a row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import hashed_share, release, sample_share, staged, text_bytes
from assayer.llm.textbytes import FOLDED, Lookup, blocks, joined, mixed, prefix, span, words

#: Labelled texts of a class that the field is trained on, and their bytes, on average.
PER_CLASS, CLASS_BYTES = 1500, 32 << 20
BITS = 18
BEGINNINGS = (3, 4, 5)
#: Tokens, of whole documents, whose sums are held at once in training.
TOGETHER = 1 << 17
#: The chance that any form at all is listed without cause, and the share of a listed form's documents that must be toxic.
CHANCE, PURE = 0.01, 0.9
#: Bits of the filter that keeps unlabelled texts out of shuffles: at most 2048 bitmaps of 4 KB, whatever the number of ids.
FILTER_BITS, BITMAP = 1 << 26, 1 << 15
#: Forms that are counted together before they leave a task.
HELD = 1 << 19
#: Places of the weights besides the hashed ones: of a listed token, and of nothing, which stays 0. The last is the bias.
LISTED, NOTHING = 1 << BITS, (1 << BITS) + 1
STEPS, RATE, DECAY = 30, 1.0, 1e-3
BETWEEN = np.isin(np.arange(256), [b for b in range(128) if not (chr(b).isalnum() or chr(b) == "'")])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features (tokens by kinds, hashed), the token's document, its first and last byte there."""
    a, start, _ = joined(texts)
    s, e = words(a, BETWEEN)
    sums = prefix(FOLDED[a])
    kinds = [span(sums, s, e)] + [mixed(span(sums, s, np.minimum(s + k, e)) + np.uint64(k)) for k in BEGINNINGS]
    doc = np.searchsorted(start, s, "right") - 1
    return np.stack(kinds, 1), doc, s - start[doc], e - start[doc]


class Chain:
    """The field's weights, with sums over whole batches."""

    def __init__(self, listed: np.ndarray | None = None) -> None:
        self.weight = np.zeros((1 << BITS) + 3, np.float64)
        self.listed = Lookup(np.zeros(0, np.uint64) if listed is None else listed)
        self.start = np.zeros(2)
        self.step = np.zeros((2, 2))
        self.scale = (1.0, 0.0)

    def places(self, features: np.ndarray) -> np.ndarray:
        """Of each token, where the weights of its features are."""
        known = (self.listed(features.ravel()) >= 0).reshape(features.shape).any(axis=1)
        return np.column_stack([(features >> np.uint64(64 - BITS)).astype(np.int64), np.where(known, LISTED, NOTHING)])

    def matrices(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token (along the last axis), exp(score) from state to state; a document's first token comes from neither, so its rows are alike."""
        unary = np.zeros((2, len(places)))
        unary[1] = np.clip(self.weight[places].sum(axis=1) + self.weight[-1], -30, 30)
        m = np.where(first, self.start[None, :, None], self.step[:, :, None]) + unary
        return np.exp(m - m.max(axis=(0, 1)))

    def sums(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward vectors of every token, each scaled to sum to 1. The batch is cut into blocks; products of all blocks grow together, position by position, then vectors go from block to block."""
        n = m.shape[2]
        width = max(1, int(np.sqrt(n)))
        rows = -(-n // width)
        full = np.zeros((2, 2, rows * width))
        full[0, 0], full[1, 1] = 1, 1
        full[:, :, :n] = m
        full = np.ascontiguousarray(full.reshape(2, 2, rows, width).transpose(3, 0, 1, 2))  # position, from, to, block
        ahead, back = np.empty_like(full), np.empty_like(full)
        ahead[0] = full[0]
        back[-1] = np.eye(2)[:, :, None]
        for k in range(1, width):
            for out, x, y in ((ahead[k], ahead[k - 1], full[k]), (back[width - k - 1], full[width - k], back[width - k])):
                np.multiply(x[:, 0, None], y[None, 0], out=out)
                out += x[:, 1, None] * y[None, 1]
                out /= out.sum(axis=(0, 1))
        whole = full[0][:, 0, None] * back[0][None, 0] + full[0][:, 1, None] * back[0][None, 1]
        into, out_of = np.empty((2, rows)), np.empty((2, rows))
        x, y = np.full(2, 0.5), np.full(2, 0.5)
        for r in range(rows):
            into[:, r] = x
            x = x @ ahead[-1, :, :, r]
            x /= x.sum()
            out_of[:, rows - 1 - r] = y
            y = whole[:, :, rows - 1 - r] @ y
            y /= y.sum()
        a = into[0] * ahead[:, 0] + into[1] * ahead[:, 1]
        b = back[:, :, 0] * out_of[0] + back[:, :, 1] * out_of[1]
        a, b = (v.transpose(1, 2, 0).reshape(2, -1)[:, :n] for v in (a, b))
        return a / a.sum(axis=0), b / b.sum(axis=0)

    def marginals(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(places):
            return np.zeros(0)
        a, b = self.sums(self.matrices(places, first))
        p = a * b
        return p[1] / p.sum(axis=0)

    def gradient(self, places: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log likelihood: weights, start and step."""
        m = self.matrices(places, first)
        a, b = self.sums(m)
        p = a * b
        p /= p.sum(axis=0)
        miss = y - p[1]
        weight = np.bincount(places.ravel(), np.repeat(miss, places.shape[1]), len(self.weight))
        weight[NOTHING], weight[-1] = 0, miss.sum()
        inner = np.flatnonzero(~first)
        pair = a[:, None, inner - 1] * m[:, :, inner] * b[None, :, inner]
        pair /= pair.sum(axis=(0, 1))
        step = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2) - pair.sum(axis=2)
        start = np.bincount(y[first], minlength=2) - p[:, first].sum(axis=1)
        return weight, start, step


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sums of both counts."""
    key, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, *(np.bincount(of, np.concatenate([p[k] for p in parts]), len(key)) for k in (1, 2))


def forms_in(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forms and beginnings of texts, with the weight of the texts, and of the toxic texts, that hold them."""
    features, doc = tokens(texts)[:2]
    own = mixed(doc.astype(np.uint64))
    once = np.unique(mixed(features[:, 0] ^ own), return_index=True)[1]
    key, own, doc = features[once].ravel(), np.repeat(own[once], features.shape[1]), np.repeat(doc[once], features.shape[1])
    once = np.unique(mixed(key ^ own), return_index=True)[1]
    w = weight[doc[once]]
    return merged([(key[once], w, w * toxic[doc[once]])])


def bound(forms_of: dict[int, int], base: float) -> float:
    """Twice the log likelihood ratio above which a form is listed. forms_of: how many forms n texts hold, by n; base: the share of toxic texts."""
    unit, many = -np.log(base), max(1, sum(forms_of.values()))
    left = many
    for n in range(1, max(forms_of, default=0) + 1):  # left: the forms of n texts and more, which are those that can reach CHANCE / left
        if left <= CHANCE * np.exp(min(n * unit, 700)):
            many = max(1, left, CHANCE * np.exp(min((n - 1) * unit, 700)))
            break
        left -= forms_of.get(n, 0)
    return 2 * np.log(many / CHANCE)


def probable(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the rows of docs whose doc_id may be one of ids(doc_id): all that are, and of the others those whose bit another id has set. The filter is FILTER_BITS long and broadcast, 8 MB at most."""
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FILTER_BITS))
    seen = ids.select(F.floor(bit / BITMAP).alias("__map"), (bit % BITMAP).alias("__bit")).groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    rows = docs.select("doc_id", "text", F.floor(bit / BITMAP).alias("__map"), (bit % BITMAP).cast("int").alias("__bit")).join(F.broadcast(seen), "__map")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)")) != 0).select("doc_id", "text")


def read_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_bytes().alias("text")).withColumn("digest", F.md5("text"))


def labelled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, digest, toxic, weight, bytes of the distinct texts of docs that wanted(doc_id, toxic) labels: toxic where any of its labels is; doc_id is a document that has it, weight 1 / rows of the text in that document. Staged; texts stay where they are."""
    alike = read_texts(probable(docs, wanted)).select("doc_id", "digest", F.length("text").alias("bytes")).join(wanted, "doc_id").groupBy("digest", "doc_id").agg(F.max("toxic").alias("toxic"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"))
    alike = alike.groupBy("digest").agg(F.max("toxic").alias("toxic"), F.min(F.struct("doc_id", "copies")).alias("of"), F.max("bytes").alias("bytes"))
    return staged(alike.select("of.doc_id", "digest", "toxic", (1 / F.col("of.copies")).alias("weight"), "bytes"), "toxicity-labelled")


def lexicon(docs: DataFrame, texts: DataFrame) -> np.ndarray:
    """The listed forms' hashes, from all the labelled texts; a text counts once."""
    there = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(there) < 2:
        return np.zeros(0, np.uint64)
    base = there[1] / sum(there.values())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda x: pd.DataFrame({"form": x[0].view(np.int64), "n": x[1], "t": x[2]})
        held: list = []
        for x in frames:
            own, toxic, weight = list(x["text"]), x["toxic"].to_numpy(np.float64), x["weight"].to_numpy(np.float64)
            for part in blocks(own):
                held.append(forms_in(own[part], toxic[part], weight[part]))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield frame(held.pop())
        if held:
            yield frame(merged(held))
        release()

    rows = read_texts(probable(docs, texts)).join(texts.drop("bytes").hint("shuffle_hash"), ["doc_id", "digest"]).select("text", "toxic", "weight")
    forms = rows.mapInPandas(count, "form long, n double, t double").groupBy("form").agg(F.round(F.sum("n")).alias("n"), F.round(F.sum("t")).alias("t"))
    forms = staged(forms, "toxicity-forms")
    few = {int(r["n"]): r["count"] for r in forms.groupBy(F.least("n", F.lit(1000)).alias("n")).count().collect()}
    share = F.col("t") / F.col("n")
    clean = F.when(F.col("t") < F.col("n"), (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - base))).otherwise(0)
    sure = forms.where(F.col("t") > F.greatest(F.lit(PURE), F.lit(base)) * F.col("n")).where(2 * (F.col("t") * F.log(share / base) + clean) > bound(few, base))
    return np.sort(np.array([r["form"] for r in sure.select("form").collect()], np.int64).view(np.uint64))


def fit(texts: list[bytes], toxic: np.ndarray, listed: np.ndarray) -> Chain:
    chain = Chain(listed)
    made = [(part.start, *tokens(texts[part])[:2]) for part in blocks(texts)]
    features = np.concatenate([f for _, f, _ in made] or [np.zeros((0, 1 + len(BEGINNINGS)), np.uint64)])
    doc = np.concatenate([at + d for at, _, d in made] or [np.zeros(0, np.int64)])
    del made
    places, first = chain.places(features), np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    del features
    known = places[:, -1] == LISTED
    y = (known & (toxic[doc] > 0)).astype(np.int64)
    whole = places[known]
    places[np.flatnonzero(known)[::2], :-1] = NOTHING
    starts = np.flatnonzero(first)
    at = np.searchsorted(starts, np.arange(0, len(doc), TOGETHER))
    cuts = np.unique(starts[at[at < len(starts)]]).tolist()
    parts = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(doc)])] or [slice(0, 0)]
    seen = [np.full(s, 1e-8) for s in (len(chain.weight), 2, (2, 2))]
    for _ in range(STEPS if len(doc) else 0):
        total = [sum(x) for x in zip(*(chain.gradient(places[k], first[k], y[k]) for k in parts), strict=True)]
        for value, g, square in zip((chain.weight, chain.start, chain.step), total, seen, strict=True):
            g = g - DECAY * value
            square += g * g
            value += RATE * g / np.sqrt(square)
    places[known] = whole
    raw = logit(likeliest(np.concatenate([chain.marginals(places[k], first[k]) for k in parts]), doc, len(texts)))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method, with a little weight on the start
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((toxic - p) * raw).sum() - (a - 1), (toxic - p).sum() - b])
        h = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    chain.scale = (float(a), float(b))
    return chain


def likeliest(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The largest marginal of each document, 0 where it has no token."""
    out = np.zeros(n)
    np.maximum.at(out, doc, p)
    return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> bytes | None:
    """A pickled Chain from docs(doc_id, text) and labels(doc_id, toxic), or None without labels of both classes or without a form that qualifies."""
    wanted = labels.where(F.col("toxic").isin(0, 1) & learnable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = labelled(docs, wanted)
    listed = lexicon(docs, texts)
    if not len(listed):
        return None
    picked = F.lit(False)
    for r in texts.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect():
        share = min(sample_share(per_class, r["n"]), sample_share(class_bytes, r["bytes"] or 0))
        picked |= (F.col("toxic") == r["toxic"]) & hashed_share(F.col("digest"), share, 1)
    sample = texts.where(picked).select("doc_id", "digest", "toxic")  # about 2 * per_class rows
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = read_texts(chosen).join(F.broadcast(sample), ["doc_id", "digest"]).groupBy("digest").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")

    def fitted(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("text")
        model = pickle.dumps(fit(list(x["text"]), x["toxic"].to_numpy(np.float64), listed))
        release()
        return pd.DataFrame({"model": [model]})

    got = rows.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(fitted, "model binary").collect()
    return bytes(got[0]["model"]) if got else None


def score(docs: DataFrame, model: bytes | None, *keep: str, spans: bool = False) -> DataFrame:
    """The columns `keep` of docs and the score of its text; spans adds spans array<struct<start, end, p>>, in characters. Only texts go to Python; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: list[bytes], chain: Chain | None) -> Iterator[tuple[np.ndarray, list]]:
        for part in blocks(texts):
            own = texts[part]
            if chain is None:
                yield np.zeros(len(own)), [[] for _ in own]
                continue
            features, doc, start, end = tokens(own)
            p = chain.marginals(chain.places(features), np.append(True, doc[1:] != doc[:-1])[: len(doc)])
            found: list[list] = [[] for _ in own]
            for i in np.flatnonzero(p >= 0.5) if spans else []:
                text = own[doc[i]]
                s = len(text[: start[i]].decode("utf-8", "ignore"))
                found[doc[i]].append((s, s + len(text[start[i] : end[i]].decode("utf-8", "ignore")), float(p[i])))
            a, b = chain.scale
            yield 1 / (1 + np.exp(-np.clip(a * logit(likeliest(p, doc, len(own))) + b, -500, 500))), found

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = pickle.loads(sent.value) if sent.value else None
        for x in batches:
            got = list(scored(list(x), chain))
            found = [[{"start": a, "end": b, "p": p} for a, b, p in f] for _, y in got for f in y]
            yield pd.DataFrame({"score": np.concatenate([s for s, _ in got]) if got else np.zeros(0), "spans": found})
        release()

    return docs.withColumn("__p", run(text_bytes())).select(*keep, "__p.score", *["__p.spans"] * spans)
