"""Removal of word windows that an earlier document has, by a log-structured fingerprint index.

Of every window of WINDOW words the run of GRAM words with the smallest hash is its anchor; equal windows have equal anchors, and a fifth of the places are one. The index holds anchors as immutable sorted runs by bucket. Documents come in batches, in order of doc_id: a batch's sorted anchors are merged with the runs of the batches before, anchors that meet are reported to the parts of the corpus (origins) that hold them, and the batch's own anchors are compacted with the call's earlier ones into a new run. Windows whose anchor is shared are then verified: 128-bit hashes of the whole windows meet in buckets with the smallest doc_id that has them, and each origin learns for which of its windows a smaller doc_id exists elsewhere.

An index can be kept in a folder and given to later calls. It holds the runs, the packed texts of the origins (of which only those that share an anchor with a new batch are read again) and a log, which names what is valid: a call that is cut off leaves files, but no entry. FAN runs of a tier are merged into one of the next. Documents of earlier calls count as before all documents of a later one, so calls in order of doc_id give the rows of one call.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A document loses each word covered by a window whose word sequence also starts in a document with a smaller doc_id; windows are judged on the input.

Nulls: a null text has no words. A row with a null doc_id counts as after all others, and such rows don't affect each other; neither do rows that repeat a doc_id. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import expanded, staged
from assayer.llm.packed import among, bucket_of, dealt, fingerprints, from_sixteen, keys_of, large, marked, merged, opened, packed, sixteen, slices, small, with_origin
from assayer.llm.textbytes import VALUES, blocks, joined, mixed, prefix, slide_min, span, window_hash, words

WINDOW, GRAM = 13, 3
LAST = np.iinfo(np.int64).max
#: Runs of a tier that are merged into one of the next.
FAN = 4
#: A run covers origins since..upto; `replaces` are the runs it was merged from.
LOG = "run long, tier int, since int, upto int, replaces array<long>"


class Windows:
    """The windows of a block of texts: hashes, anchors and the text each is in."""

    def __init__(self, texts: list[bytes]):
        a, start, _ = joined(texts)
        s, e = words(a)
        word = span(prefix(VALUES[a]), s, e)
        self.doc = np.searchsorted(start, s, "right") - 1
        n = max(0, len(word) - WINDOW + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :][:n])
        grams = window_hash(word, GRAM)
        bits = np.uint64(max(1, len(grams)).bit_length())
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        least = slide_min(low, WINDOW - GRAM + 1)[self.at] if n else np.zeros(0, np.uint64)
        self.anchor = grams[(least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
        self.word = word

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window."""
        return window_hash(self.word, WINDOW)[self.at], window_hash(mixed(self.word + np.uint64(1)), WINDOW)[self.at]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w = Windows(texts)
    turn = np.append(True, (w.anchor[1:] != w.anchor[:-1]) | (w.doc[w.at][1:] != w.doc[w.at][:-1]))[: len(w.at)]
    return w.anchor[turn], w.doc[w.at][turn]


class Candidates:
    """An origin's windows whose anchor another origin, or another of its own documents, has."""

    def __init__(self, ids: list[int | None], texts: list[bytes], found: pd.DataFrame, buckets: int, before: bool = False):
        """before: documents of an earlier call."""
        self.order = np.array([-LAST if before else LAST if i is None else i for i in ids], np.int64)
        shared, parts, first = keys_of(found, "shared"), [], 0
        self.n_words, self.at, doc, a, b, anchor = [], [], [], [], [], []
        for part in blocks(texts):
            w = Windows(texts[part])
            x, y = w.hashes()
            self.n_words += np.bincount(w.doc, minlength=part.stop - part.start).tolist()
            begin = np.searchsorted(w.doc, w.doc[w.at])
            parts.append(len(w.at))
            self.at.append(w.at - begin)
            doc.append(part.start + w.doc[w.at])
            a.append(x)
            b.append(y)
            anchor.append(w.anchor)
            first += len(w.at)
        at, doc, a, b, anchor = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (self.at, doc, a, b, anchor))
        anchor = anchor.astype(np.uint64)
        elsewhere = among(anchor >> np.uint64(16), shared)
        key, of = np.unique(anchor, return_inverse=True)
        own = np.full(len(key), LAST, np.int64), np.full(len(key), -LAST, np.int64)
        np.minimum.at(own[0], of, self.order[doc])
        np.maximum.at(own[1], of, self.order[doc])
        keep = elsewhere | (own[0] < own[1])[of]
        self.at, self.doc, a, b, elsewhere = at[keep], doc[keep], a[keep].astype(np.uint64), b[keep].astype(np.uint64), elsewhere[keep]
        # distinct windows, sorted by bucket and hash, with the smallest id
        bucket = bucket_of(a, buckets)
        order = np.lexsort((self.order[self.doc], b, a, bucket))
        ka, kb, kc = a[order], b[order], bucket[order]
        fresh = np.append(True, (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1]) | (kc[1:] != kc[:-1]))[: len(ka)]
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.a, self.b, self.bucket, self.least = ka[fresh], kb[fresh], kc[fresh], self.order[self.doc][order][fresh]
        self.asked = np.zeros(len(self.a), bool)
        np.logical_or.at(self.asked, self.of, elsewhere)

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Of each bucket, the windows asked about."""
        asked = np.flatnonzero(self.asked)
        for bucket, i, j in slices(self.bucket[asked]):
            yield bucket, asked[i:j]


def resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """For each origin's windows in a bucket, a bit: another origin has the window in a smaller doc_id."""
    got = [from_sixteen(k) for k in rows["keys"]]
    least = [large(x, np.int64) for x in rows["least"]]
    a, b, doc = np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]), np.concatenate(least)
    order = np.lexsort((doc, b, a))
    x, y = a[order], b[order]
    fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    smallest = np.empty(len(doc), np.int64)
    smallest[order] = doc[order][fresh][np.cumsum(fresh) - 1]
    bits, at = [], 0
    for own in least:
        bits.append(np.packbits(smallest[at : at + len(own)] < own).tobytes())
        at += len(own)
    return pd.DataFrame({"origin": rows["origin"], "kind": "bits", "bucket": rows["bucket"], "keys": bits})


def valid(spark: SparkSession, index: str) -> list[Row]:
    """The index's runs that no other replaces; of calls, so bounded on the driver."""
    spark.createDataFrame([], LOG).write.mode("append").parquet(f"{index}/log")
    log = spark.read.schema(LOG).parquet(f"{index}/log").distinct().collect()
    gone = {k for r in log for k in r["replaces"]}
    return sorted((r for r in log if r["run"] not in gone), key=lambda r: r["run"])


def enter(spark: SparkSession, index: str, run: int, tier: int, since: int, upto: int, replaces: list[int]) -> None:
    spark.createDataFrame([(run, tier, since, upto, replaces)], LOG).coalesce(1).write.mode("append").parquet(f"{index}/log")


def compacted(spark: SparkSession, index: str, fan: int = FAN) -> None:
    """Merges `fan` runs of a tier into one of the next, as long as there are so many."""
    while True:
        runs, tiers = valid(spark, index), {}
        for r in runs:
            tiers.setdefault(r["tier"], []).append(r)
        tier = next((t for t in sorted(tiers) if len(tiers[t]) >= fan), None)
        if tier is None:
            return
        own, new = tiers[tier], spark.read.schema(LOG).parquet(f"{index}/log").agg(F.max("run")).first()[0] + 1
        since, upto = min(r["since"] for r in own), max(r["upto"] for r in own)
        rows = dealt(spark.read.parquet(*[f"{index}/runs/{r['run']}" for r in own]), upto - since)
        merged(rows, keep_run=True).where("kind = 'run'").select("bucket", "keys", "origins").write.mode("overwrite").parquet(f"{index}/runs/{new}")
        enter(spark, index, new, tier + 1, since, upto, [r["run"] for r in own])


def remove_repeats(docs: DataFrame, batches: int = 2, text: bool = False, index: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of docs(doc_id, text); text adds what is left. index: a folder that all executors reach, with the documents of earlier calls, to which these are added. Texts are shuffled once, compressed; of windows only those with shared anchors move, as 16 bytes each and an id."""
    spark = docs.sparkSession
    known = valid(spark, index) if index else []
    first = max((r["upto"] for r in known), default=0)
    rows, origins, again = with_origin(docs)
    buckets = first + origins
    rows = rows.withColumn("origin", F.col("origin") + F.lit(first))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 1000).alias("c")).first()["c"] or []
    history = dealt(spark.read.parquet(*[f"{index}/runs/{r['run']}" for r in known]), buckets) if known else None
    run, shared = None, None
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    for k in range(len(cuts) + 1):
        new = fingerprints(rows.where(F.coalesce(batch, F.lit(len(cuts))) == k), buckets, anchors)
        before = run if history is None else history if run is None else history.unionByName(run)
        found = staged(merged(new, before, keep_run=k < len(cuts) or index is not None, first=first), "fingerprint-run")
        run = found.where("kind = 'run'").select("bucket", "keys", "origins")
        here = found.where("kind = 'shared'").select("origin", "kind", "bucket", "keys")
        shared = here if shared is None else shared.unionByName(here)
    texts = packed(rows)
    asked = texts
    if index:
        number = (spark.read.schema(LOG).parquet(f"{index}/log").agg(F.max("run")).first()[0] or 0) + 1
        run.write.mode("overwrite").parquet(f"{index}/runs/{number}")
        texts.write.mode("overwrite").parquet(f"{index}/texts/{number}")
        asked = texts = spark.read.parquet(f"{index}/texts/{number}")
        if known:  # texts of a call lie under the number of its first run, which stays in the log
            calls = [r["run"] for r in spark.read.schema(LOG).parquet(f"{index}/log").where("tier = 0").select("run").distinct().collect()]
            old = spark.read.parquet(*[f"{index}/texts/{k}" for k in calls])
            asked = texts.unionByName(old.join(shared.select("origin").distinct(), "origin", "left_semi"))
        enter(spark, index, number, 0, first, first + origins, [])
        compacted(spark, index)

    def ask(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if own.empty or found.empty:
            return pd.DataFrame({c: [] for c in ("bucket", "origin", "keys", "least")}, dtype=object)
        origin = int(own["origin"].iloc[0])
        c = Candidates(*opened(own)[:2], found, buckets, origin < first)
        return pd.DataFrame([(bucket, origin, sixteen(c.a[i], c.b[i]), small(c.least[i])) for bucket, i in c.runs()], columns=["bucket", "origin", "keys", "least"])

    def finish(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "copies"] + ["text"] * text
        if own.empty:
            return pd.DataFrame({n: [] for n in names}, dtype=object)
        ids, texts, _, copies = opened(own)
        c = Candidates(ids, texts, found, buckets)
        bits = {b: k for b, k in zip(found["bucket"][found["kind"] == "bits"], found["keys"][found["kind"] == "bits"], strict=True)}
        earlier = np.zeros(len(c.a), bool)
        for bucket, i in c.runs():
            earlier[i] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(i)).astype(bool)
        covered = earlier[c.of] | (c.order[c.doc] > c.least[c.of])
        hit = np.flatnonzero(covered)
        hit = hit[np.argsort(c.doc[hit], kind="stable")]
        first = np.searchsorted(c.doc[hit], np.arange(len(ids) + 1))
        out = []
        for d, (doc_id, body, n) in enumerate(zip(ids, texts, c.n_words, strict=True)):
            kept = body.split()
            at = c.at[hit[first[d] : first[d + 1]]]
            gone = marked(n, at, WINDOW) if len(at) else None
            if gone is not None:
                kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
            left = b" ".join(kept)
            row = (doc_id, n, n - len(kept), hashlib.sha256(left).hexdigest(), copies[d])
            out.append((*row, left.decode("utf-8", "replace")) if text else row)
        return pd.DataFrame(out, columns=names)

    answers = asked.groupBy("origin").cogroup(shared.groupBy("origin")).applyInPandas(ask, "bucket int, origin int, keys binary, least binary").groupBy("bucket").applyInPandas(resolve, "origin int, kind string, bucket int, keys binary")
    told = answers.unionByName(shared).where(F.col("origin") >= first)
    kept = texts.groupBy("origin").cogroup(told.groupBy("origin")).applyInPandas(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, copies long" + (", text string" if text else ""))
    return expanded(kept, again).drop("copy")
