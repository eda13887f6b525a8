"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are tokenised once and dealt to shards by a hash of their row and, among equal rows, the number of the copy; so another layout of the same rows gives the same pieces. In a shard each source has a queue. A window of `window` tokens credits every source with its target share of the window; sources with credit for a turn are served in a round up to it, the others wait until they have it, in a heap by that time, and what a source got more or less than its share stays as its deficit for the next window. A turn costs the same for any number of sources. Deficits also go over from shard to shard: a shard's first deficits are, for each source, what the shards before it owe (target share of their tokens less the tokens they hold), taken from a table of tokens by shard and source. A source whose queue has run out leaves its credit to the others, so every window but a shard's last is full.

Nulls: a null text is empty and still has the end id; a null source is a queue of its own; a null doc_id stays null. Rows equal in doc_id, text and source are tokenised once, but are documents of their own, and a shard doesn't get all of them. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import collapsed, expanded, release, staged

#: A turn serves at least so many tokens, so that a window is not cut into crumbs.
LEAST_TURN = 256
#: UTF-8 bytes of text a shard holds, on average.
SHARD_BYTES = 12 << 20


def token_ids(rows: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """row_hash, copies, source, doc_id, n, ids (little-endian unsigned 32-bit, then deflated: ids repeat) of each distinct document, with the end id."""
    kind = dict(rows.dtypes)["doc_id"]

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from assayer.llm.pretokens import byte_bpe

        encoder, end = byte_bpe(tokenizer), np.asarray([end_id], "<u4")
        for x in frames:
            ids = [np.concatenate([encoder.ids(t), end]) for t in x["text"]]
            yield pd.DataFrame({"row_hash": x["row_hash"], "copies": x["copies"], "source": x["source"], "doc_id": x["doc_id"], "n": [len(i) for i in ids], "ids": [zlib.compress((i.astype("<u2") if i.max() < 1 << 16 else i).tobytes(), 1) if len(i) else b"" for i in ids], "wide": [bool(i.max() >= 1 << 16) for i in ids]})

    return rows.mapInPandas(encode, f"row_hash long, copies long, source string, doc_id {kind}, n long, ids binary, wide boolean")


def upto(rows: DataFrame, value: str, out: str, *keys: str, width: int = 12) -> DataFrame:
    """rows with the sum of `value` in the shards before, by keys. Sums run inside ranges of 2**width shards, and over the ranges' totals."""
    rows = rows.withColumn("__g", F.shiftright("shard", width))
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__g").agg(F.sum(value).alias("__t"))
    totals = totals.withColumn("__b", F.coalesce(F.sum("__t").over(before(keys or [F.lit(0)], "__g")), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in (*keys, "__g")], "__b")
    same = F.col("__g") == F.col("____g")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = F.coalesce(F.sum(value).over(before([*keys, "__g"], "shard")), F.lit(0))
    return rows.withColumn("__i", inside).join(totals, same).withColumn(out, F.col("__i") + F.col("__b")).select(*[c for c in rows.columns if c != "__g"], out)


def shares(tokens: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """shard, source, share, deficit: target shares (the corpus's own where none are given) and what the shards before owe."""
    spark = tokens.sparkSession
    held = staged(tokens.groupBy("shard", "source").agg(F.sum("n").alias("held")), "held")
    of_source = held.groupBy("source").agg(F.sum("held").alias("of_source"))
    if targets is None:
        wanted = of_source.withColumn("weight", F.col("of_source").cast("double"))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, weight double")
        wanted = of_source.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = wanted.agg(F.sum("weight").alias("all"))
    wanted = wanted.crossJoin(F.broadcast(total)).select("source", (F.col("weight") / F.greatest(F.col("all"), F.lit(1e-300))).alias("share"))  # one row on the right
    size = upto(held.groupBy("shard").agg(F.sum("held").alias("size")), "size", "all_before").drop("size")
    rows = upto(held, "held", "own_before", "source").join(size, "shard")
    rows = rows.join(wanted.withColumnRenamed("source", "q"), F.col("source").eqNullSafe(F.col("q")))
    return rows.select(F.col("shard").alias("shard"), F.col("source").alias("source"), F.col("share").alias("share"), (F.col("share") * F.col("all_before") - F.col("own_before")).alias("deficit"))


def pack_shard(queues: dict, share: dict, deficit: dict, window: int) -> Iterator[tuple]:
    """Deficit round-robin of one shard. queues: source -> list of (document, tokens). Yields (sequence, offset, document, start, length)."""
    order = sorted((s for s in queues if queues[s]), key=lambda s: (s is None, s or ""))
    heads = {s: [0, 0] for s in order}  # next document, its next token
    weight = {s: max(0.0, share.get(s, 0.0)) for s in order}
    base = {s: float(deficit.get(s, 0.0)) for s in order}  # a source's credit is base + weight * given
    given, rest, live = 0.0, sum(weight.values()), len(order)

    def entry(k: int) -> tuple[float, int]:
        """When a source has credit for a turn, and its place."""
        s = order[k]
        return ((LEAST_TURN - base[s]) / weight[s] if weight[s] > 0 else float("inf")), k

    waiting = [entry(k) for k in range(len(order))]
    heapify(waiting)
    ready: deque[int] = deque()
    sequence = 0
    while live:
        room, offset = window, 0
        if rest > 1e-12:
            given += window / rest
        while room and live:
            while waiting and waiting[0][0] <= given:
                ready.append(heappop(waiting)[1])
            if ready:
                k = ready.popleft()
                credit = base[order[k]] + weight[order[k]] * given
                if credit < LEAST_TURN / 2:  # an overdrawn source that ran out took it
                    heappush(waiting, entry(k))
                    continue
                quota = min(room, int(credit))
            else:  # what no source has credit for goes to the one that would have it next
                k = heappop(waiting)[1]
                quota = min(room, LEAST_TURN)
            s = order[k]
            head, queue = heads[s], queues[s]
            while quota and head[0] < len(queue):
                doc, n = queue[head[0]]
                take = min(quota, n - head[1])
                yield sequence, offset, doc, head[1], take
                quota, room, offset, base[s] = quota - take, room - take, offset + take, base[s] - take
                head[1] += take
                if head[1] == n:
                    head[0], head[1] = head[0] + 1, 0
            if head[0] == len(queue):  # its credit, owed or not, goes to the others by their shares
                live, rest = live - 1, rest - weight[s]
                if rest > 1e-12:
                    given += (base[s] + weight[s] * given) / rest
            elif base[s] + weight[s] * given >= LEAST_TURN:
                ready.append(k)
            else:
                heappush(waiting, entry(k))
        sequence += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, targets: dict[str, float] | None = None, keep_ids: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of docs(doc_id, text, source) in sequences of at most `window` tokens: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset; keep_ids adds the piece's ids array<int>.

    A sequence holds fewer tokens than the window only at the end of a shard of shard_bytes. The ids are staged once in the shared folder and dealt to shards once; a source with a third of all documents is a third of each shard.
    """
    rows, seen = collapsed(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source")), F.octet_length("text"))
    shards = max(1, math.ceil(seen["all_bytes"] / shard_bytes))
    tokens = expanded(staged(token_ids(rows, tokenizer, end_id), "token-ids"), seen["again"])
    tokens = tokens.withColumn("shard", F.pmod(F.xxhash64("row_hash", "copy"), F.lit(shards)).cast("int")).drop("row_hash", "copy")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def deal(rows: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        source = [None if pd.isna(s) else s for s in rows["source"]]
        key = [(-1 if pd.isna(i) else i, b) for i, b in zip(rows["doc_id"], rows["ids"], strict=True)]
        queues: dict = {s: [] for s in set(source)}
        n, at = rows["n"].tolist(), rows["ids"].tolist()
        wide, doc_id, first = rows["wide"].tolist(), rows["doc_id"].tolist(), int(rows["shard"].iloc[0]) << 32
        for i in sorted(range(len(rows)), key=key.__getitem__):
            queues[source[i]].append((i, n[i]))
        of = [None if pd.isna(s) else s for s in owed["source"]]
        out, ids_of = [], {}
        for sequence, offset, i, start, length in pack_shard(queues, dict(zip(of, owed["share"], strict=True)), dict(zip(of, owed["deficit"], strict=True)), window):
            ids = ids_of.get(i)
            if ids is None:
                ids = ids_of[i] = np.frombuffer(zlib.decompress(at[i]), "<u4" if wide[i] else "<u2").astype("<u4")
            piece = ids[start : start + length]
            row = (doc_id[i], source[i], start, length, zlib.crc32(piece.tobytes()), n[i], first | sequence, offset)
            out.append((*row, piece.astype("int32")) if keep_ids else row)
            if start + length == n[i]:
                del ids_of[i]
        release()
        return pd.DataFrame(out, columns=names).astype({"doc_id": rows["doc_id"].dtype})

    return tokens.groupBy("shard").cogroup(shares(tokens, targets).groupBy("shard")).applyInPandas(deal, schema)
