"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each adjacent pair that has a merge is put, by its left position, into the bucket of its rank; a bitmap of three levels tells which buckets are not empty, and find-first-set picks the lowest rank. An entry whose pair has changed since is stale and skipped. The work is proportional to the number of merges, so a pre-token of a megabyte is no trouble.

Nulls: a null text encodes as empty: 0 tokens, the digests of no bytes. A null doc_id stays null. Repeated rows each give a row. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.pretokens import Cached, any_splitter, plain_splitter

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}


#: In a list of ids: the end of a piece, and an id merged into its left neighbour.
END, GONE = -2, -1


class RankQueue:
    """Positions by rank; pop() gives those of the lowest rank that has any. Three levels of 64 bits hold 262,144 ranks."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.top, self.middle, self.low = 0, [0] * 64, [0] * 4096

    def push(self, rank: int, places: list[int] | tuple[int, ...]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.extend(places)
            return
        self.buckets[rank] = list(places)
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] = word = word & (word - 1)
        if not word:
            self.middle[a] &= ~(1 << (b & 63))
            if not self.middle[a]:
                self.top &= ~(1 << a)
        return rank, self.buckets.pop(rank)


class Bpe:
    """Encodes by ranks (token bytes -> rank, which is the id) and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        if max(self.token, default=0) >= 1 << 18:
            raise ValueError("The rank queue holds ranks below 262,144.")
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}
        self.queue = RankQueue()
        self.cached = Cached(lambda pieces: [np.asarray(x, "<u4").tobytes() for x in self.encode_pieces([p.encode() for p in pieces])])
        self.plain, self.odd = plain_splitter()
        self.any = any_splitter(pattern)

    def merged(self, a: int, b: int) -> int:
        """The id of two tokens put together, or -1. Answers that are a rank are kept for good (there are not many more than ranks), others until they are a million."""
        if a < 0 or b < 0:
            return -1
        got = self.ranks.get(self.token[a] + self.token[b], -1)
        if got < 0 and len(self.merges) >= 1_000_000:
            for pair in [p for p, r in self.merges.items() if r < 0]:
                del self.merges[pair]
        else:
            self.merges[a, b] = got
        return got

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """All pieces share one queue and one list, in which no pair crosses a piece's end. A merge makes a token of higher rank than its own, so the lowest rank of all is always some piece's next."""
        ids: list[int] = []
        ends = []
        for piece in pieces:
            whole = self.ranks.get(piece)
            ids.extend([whole] if whole is not None else map(self.byte.__getitem__, piece))
            ids.append(END)
            ends.append(len(ids))
        n, queue, merges = len(ids), self.queue, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        starts: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(ids, ids[1:])):
            rank = merges.get(pair)
            if rank is None:
                rank = self.merged(*pair)
            if rank >= 0:
                starts.setdefault(rank, []).append(i)
        for rank, places in starts.items():
            queue.push(rank, places)
        while queue.top:
            rank, places = queue.pop()
            places.sort()  # the leftmost of equal ranks goes first
            for i in places:
                a = ids[i]
                if a < 0:
                    continue  # stale: merged into its left neighbour
                j = after[i]
                if merges.get((a, ids[j])) != rank:
                    continue  # stale: the pair has changed
                ids[i], ids[j] = rank, GONE
                k = after[i] = after[j]
                before[k] = i
                right = ids[k]
                if right >= 0:
                    r = merges.get((rank, right))
                    if r is None:
                        r = self.merged(rank, right)
                    if r >= 0:
                        queue.push(r, (i,))
                h = before[i]
                if h >= 0 and (left := ids[h]) >= 0:
                    r = merges.get((left, rank))
                    if r is None:
                        r = self.merged(left, rank)
                    if r >= 0:
                        queue.push(r, (h,))
        out, at = [], 0
        for end in ends:
            out.append([x for x in ids[at:end] if x >= 0])
            at = end
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):  # about a million characters together
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < 1 << 20:
                size += len(texts[end])
                end += 1
            split = [(self.any if self.odd(t) else self.plain)(t) for t in texts[at:end]]
            out += [np.frombuffer(x, "<u4") for x in self.cached.ids(split)]
            at = end
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@cache
def bpe(path: str, pattern: str) -> Bpe:
    """One a worker process."""
    return Bpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encodes each row of docs(doc_id, text) and decodes the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256; keep_ids adds ids array<int>. No shuffle."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = ENCODED.replace("doc_id long", f"doc_id {kind}") + (", ids array<int>" if keep_ids else "")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = bpe(path, pattern)
        for x in frames:
            rows = []
            for doc_id, ids in zip(x["doc_id"], coder.encode(list(x["text"])), strict=True):
                row = (doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest())
                rows.append((*row, ids.astype("int32")) if keep_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids).astype({"doc_id": x["doc_id"].dtype})

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(encode, schema)


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary of rows(doc_id, ids array<int>); null ids decode to no bytes."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = bpe(path, pattern)
        for x in frames:
            yield pd.DataFrame({"doc_id": x["doc_id"], "decoded": [b"" if ids is None else coder.decode(np.asarray(ids)) for ids in x["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(decode, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded binary")
