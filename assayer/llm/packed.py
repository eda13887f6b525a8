"""Texts dealt to origins, and the meeting of their sparse fingerprints in buckets.

An origin is a part of the documents, of about ORIGIN_BYTES of text, by a hash of the row. Rows equal in all that is read are one, with the number of their copies, and become as many again in the result. Texts travel compressed. Fingerprints of all origins meet in buckets by hash, as sorted runs of 6-byte keys with the origins that hold them; a bucket tells each origin which of its keys others hold too. An origin names a key once, however often its texts have it, so no frequent text makes a hot bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import collapsed, release, text_bytes
from assayer.llm.textbytes import blocks

ORIGIN_BYTES = 8 << 20
#: Keys are the upper 48 bits of a hash. Equal keys are candidates; what follows looks at whole windows.
KEY = np.uint64(16)


def six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def small(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def large(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def with_origin(docs: DataFrame, origins: int | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """origin, doc_id long, text binary, extra binary (the columns to carry along, as JSON), copies long; the number of origins, by the size of the texts if not given; and how many hashes of rows occur again."""
    extra = F.to_json(F.struct(*carry)).cast("binary") if carry else F.lit(b"")
    rows, seen = collapsed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), extra.alias("extra")), F.octet_length("text"))
    origins = origins or max(4, math.ceil(seen["bytes"] / ORIGIN_BYTES))
    return rows.select(F.pmod("row_hash", F.lit(origins)).cast("int").alias("origin"), "doc_id", "text", "extra", "copies"), origins, seen["again"]


def packed(rows: DataFrame) -> DataFrame:
    """origin, body: the documents of an origin that a batch holds, compressed together. The origin's ids, sizes and texts stay in one order from here on."""
    import zstandard

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = zstandard.ZstdCompressor(level=1)
        for x in frames:
            out = []
            for origin, own in x.groupby("origin"):
                none = own["doc_id"].isna().to_numpy()
                ids = np.where(none, 0, own["doc_id"].fillna(0).to_numpy(np.int64))
                parts = [*own["text"], *own["extra"]]
                head = np.int64([len(own)]).tobytes() + ids.tobytes() + own["copies"].to_numpy(np.int64).tobytes() + none.tobytes() + np.fromiter(map(len, parts), np.int64, len(parts)).tobytes()
                out.append((origin, to.compress(head + b"".join(parts))))
            yield pd.DataFrame(out, columns=["origin", "body"])
        release()

    return rows.mapInPandas(pack, "origin int, body binary")


def opened(rows: pd.DataFrame) -> tuple[list[int | None], list[bytes], list[bytes], list[int]]:
    """Ids, texts, what is carried along and numbers of copies, of an origin."""
    import zstandard

    of, ids, texts, extras, copies = zstandard.ZstdDecompressor(), [], [], [], []
    for body in sorted(rows["body"]):
        x = of.decompress(body)
        n = int(np.frombuffer(x, np.int64, 1)[0])
        own, none = np.frombuffer(x, np.int64, n, 8).tolist(), np.frombuffer(x, bool, n, 8 + 16 * n)
        copies += np.frombuffer(x, np.int64, n, 8 + 8 * n).tolist()
        end = 8 + 33 * n + np.cumsum(np.frombuffer(x, np.int64, 2 * n, 8 + 17 * n))
        start = np.append(8 + 33 * n, end[:-1])
        parts = [x[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        ids += [None if z else i for i, z in zip(own, none, strict=True)]
        texts += parts[:n]
        extras += parts[n:]
    return ids, texts, extras, copies


def fingerprints(rows: DataFrame, buckets: int, anchors: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """bucket, keys, origins: sorted runs. anchors gives, for a block of texts, hashes and the text each is in."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts, origin = list(x["text"]), x["origin"].to_numpy(np.int32)
            got = [anchors(texts[part]) for part in blocks(texts)]
            h = np.concatenate([g[0] for g in got] or [np.zeros(0, np.uint64)])
            of = [np.zeros(0, np.int32)]
            for part, g in zip(blocks(texts), got, strict=True):
                of.append(origin[part.start + g[1]])
            yield from rows_by_bucket(h, np.concatenate(of), buckets)
        release()

    return rows.select("origin", "text").mapInPandas(split, "bucket int, keys binary, origins binary")


def slices(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of a sorted array with the first place that has it and the place after the last."""
    value, first, n = np.unique(x, return_index=True, return_counts=True)
    return list(zip(value.tolist(), first.tolist(), (first + n).tolist(), strict=True))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> KEY) % np.uint64(buckets)).astype(np.int32)


def rows_by_bucket(h: np.ndarray, origin: np.ndarray, buckets: int) -> Iterator[pd.DataFrame]:
    bucket = bucket_of(h, buckets)
    key = h >> KEY
    order = np.lexsort((origin, key, bucket))
    bucket, key, origin = bucket[order], key[order], origin[order]
    fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]) | (origin[1:] != origin[:-1]))[: len(key)]
    bucket, key, origin = bucket[fresh], key[fresh], origin[fresh]
    yield pd.DataFrame([(who, six(key[a:b]), small(origin[a:b])) for who, a, b in slices(bucket)], columns=["bucket", "keys", "origins"])


FOUND = "kind string, bucket int, origin int, keys binary, origins binary"


def dealt(runs: DataFrame, buckets: int) -> DataFrame:
    """bucket, keys, origins: runs of an index that were dealt to other numbers of buckets."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for keys, origins in zip(x["keys"], x["origins"], strict=True):
                yield from rows_by_bucket(from_six(keys) << KEY, large(origins, np.int32), buckets)

    return runs.select("keys", "origins").mapInPandas(deal, "bucket int, keys binary, origins binary")


def merged(runs: DataFrame, history: DataFrame | None = None, keep_run: bool = False, hot: int = 1 << 30, first: int = 0) -> DataFrame:
    """Merges the sorted runs of each bucket with the runs of earlier batches. Rows of kind `shared`: an origin's keys that another origin holds too (of kind `hot`, where at least `hot` origins do), and of kind `run`, if kept: the bucket's compacted run of the origins from `first` on."""

    def merge(new: pd.DataFrame, old: pd.DataFrame | None) -> pd.DataFrame:
        frames = [new] if old is None else [old, new]
        bucket = int(next(f["bucket"].iloc[0] for f in frames if len(f)))
        key = np.concatenate([from_six(k) for f in frames for k in f["keys"]])
        origin = np.concatenate([large(o, np.int32) for f in frames for o in f["origins"]])
        order = np.lexsort((origin, key))
        key, origin = key[order], origin[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (origin[1:] != origin[:-1]))[: len(key)]
        key, origin = key[fresh], origin[fresh]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        count = np.diff(np.append(starts, len(key)))
        n = np.repeat(count, count)
        own = origin >= first
        out = [("run", bucket, -1, six(key[own]), small(origin[own]))] if keep_run and own.any() else []
        for kind, there in (("shared", (n > 1) & (n < hot)), ("hot", (n > 1) & (n >= hot))):
            k, o = key[there], origin[there]
            order = np.argsort(o, kind="stable")
            k, o = k[order], o[order]
            out += [(kind, bucket, who, six(k[a:b]), b"") for who, a, b in slices(o)]
        return pd.DataFrame(out, columns=["kind", "bucket", "origin", "keys", "origins"])

    if history is None:
        return runs.groupBy("bucket").applyInPandas(lambda x: merge(x, None), FOUND)
    return runs.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInPandas(merge, FOUND)


def keys_of(found: pd.DataFrame, kind: str) -> np.ndarray:
    """An origin's keys of a kind, sorted."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64)] + [from_six(k) for k in found.loc[found["kind"] == kind, "keys"]]))


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of x are among sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def sixteen(a: np.ndarray, b: np.ndarray) -> bytes:
    """128 bits of two hashes, by rows."""
    return np.stack([a.astype("<u8"), b.astype("<u8")], 1).tobytes()


def from_sixteen(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<u8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def ten(a: np.ndarray, b: np.ndarray) -> bytes:
    """80 bits of two hashes, by rows."""
    out = np.empty((len(a), 10), np.uint8)
    out[:, :6] = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    out[:, 6:] = (b & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def from_ten(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8).reshape(-1, 10)
    return from_six(np.ascontiguousarray(x[:, :6]).tobytes()), np.ascontiguousarray(x[:, 6:]).view("<u4").ravel()


def marked(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places are in some [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0
