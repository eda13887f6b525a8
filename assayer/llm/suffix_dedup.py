"""Removal of repeated byte strings with suffix arrays by two-stage sorting.

A string of WIDTH bytes that starts in two places, in one document or two, is cut from both. Of every window of WIDTH bytes the run of GRAM bytes with the smallest hash is its anchor, so equal windows have equal anchors, and few places are one. Anchors that occur once in the corpus can't lie in a repeated window and are dropped. For the others, an anchor's context (all windows that have it as anchor, some 260 bytes) goes to a bucket by the anchor's hash, each distinct one once with whether it occurs again; so a passage with many copies costs one context an origin. A bucket sorts the suffixes of its contexts:

1. suffixes smaller than their successors are sorted directly,
2. the rest are induced by scanning the buckets of the first byte in order: a suffix just placed puts the one before it at the head of its own bucket,

both to a depth of WIDTH, and takes common prefixes of neighbours; a window is repeated if its neighbour agrees in WIDTH bytes or its whole context occurs again, byte by byte.

Contexts of an anchor that HOT origins share would make a bucket grow with the corpus, as each has other bytes around the passage. They are cut down first: hashes of their windows meet, each in a bucket of its own, once for each origin, and windows whose hash no other has can't be repeated. What is left, the passage itself, is one context an origin, and goes to its bucket as above. In a bucket, an anchor whose contexts are more than SORTED bytes is cut down in the same way. A hash only ever rules windows out.

Nulls: a null text is empty. Null and repeated ids are documents like others; of rows equal in id, text and what is carried along, one is worked on, and all of WIDTH bytes or more are cut whole. Texts shorter than WIDTH lose nothing. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from assayer.llm.common import expanded, releasing, staged
from assayer.llm.packed import among, bucket_of, fingerprints, from_ten, keys_of, marked, merged, opened, packed, slices, ten, with_origin
from assayer.llm.textbytes import VALUES, blocks, joined, mixed, prefix, slide_min, span, window_hash

WIDTH, GRAM = 200, 48
#: From so many origins on, an anchor's contexts are cut down to windows with a hash that occurs again.
HOT = 64
#: Bytes that are sorted together.
SORTED = 1 << 18
#: Neighbours that are compared at once.
COMPARED = 1 << 13


def suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text in the order of their first `depth` bytes, and which agree with the one before in all of these. A text is taken to end in zeros."""
    n = len(text)
    t = np.append(text, np.zeros(depth + 8, np.uint8))
    rise = np.sign(t[1 : n + 1].astype(np.int16) - t[:n])
    # equal neighbours are as the next unequal ones; the last suffix is larger than the end
    differs = np.where(rise != 0, np.arange(n), n - 1)
    after = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = rise[after] > 0
    rows = np.lib.stride_tricks.as_strided(t, (n, depth), (1, 1))
    first = np.flatnonzero(smaller)
    keys = np.ascontiguousarray(rows[first]).view(f"S{depth}").ravel()
    direct = first[np.argsort(keys, kind="stable")]
    del keys
    size = np.bincount(t[:n], minlength=256)
    head = np.cumsum(size) - size
    large = np.bincount(t[:n][~smaller], minlength=256)
    order = np.full(n, -1, np.int64)
    begin = np.searchsorted(t[direct], np.arange(257))
    for c in range(256):  # in a bucket the induced suffixes come first
        lo = head[c] + large[c]
        order[lo : lo + begin[c + 1] - begin[c]] = direct[begin[c] : begin[c + 1]]
    fill = head.copy()

    def induce(placed: np.ndarray) -> np.ndarray:
        """Puts what comes before the suffixes just placed at the head of its bucket; returns those of the bucket that is being scanned."""
        before = placed[placed > 0] - 1
        before = before[~smaller[before]]
        c = t[before]
        for v in np.unique(c):
            own = before[c == v]
            order[fill[v] : fill[v] + len(own)] = own
            fill[v] += len(own)
        return before

    if n and not smaller[n - 1]:
        order[fill[t[n - 1]]] = n - 1
        fill[t[n - 1]] += 1
    for c in range(256):
        if not size[c]:
            continue
        done = head[c]
        while done < fill[c]:  # induced within the bucket too, in runs of the same byte
            upto = fill[c]
            induce(order[done:upto])
            done = upto
        induce(order[head[c] + large[c] : head[c] + size[c]])
    agrees = np.zeros(n, bool)
    for at in range(1, n, COMPARED):
        i = np.arange(at, min(n, at + COMPARED))
        agrees[i] = (rows[order[i]] == rows[order[i - 1]]).all(axis=1)
    return order, agrees


def repeated(text: np.ndarray, depth: int) -> np.ndarray:
    """Of each place, whether its `depth` bytes start elsewhere too."""
    order, agrees = suffixes(text, depth)
    out = np.zeros(len(text), bool)
    out[order[agrees]] = True
    out[order[np.flatnonzero(agrees) - 1]] = True
    return out


class Contexts:
    """Anchors of a block of texts, with the windows that have them: starts first..last in the joined bytes."""

    def __init__(self, texts: list[bytes]):
        self.bytes, self.start, end = joined(texts)
        values = VALUES[self.bytes]
        n = max(0, len(values) - WIDTH + 1)
        inside = np.zeros(n + 1, np.int64)
        whole = end - self.start >= WIDTH
        np.add.at(inside, self.start[whole], 1)
        np.add.at(inside, end[whole] - WIDTH + 1, -1)
        ok = np.cumsum(inside)[:n] > 0
        grams = window_hash(values, GRAM)
        bits = np.uint64(max(1, len(grams)).bit_length())
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        place = (slide_min(low, WIDTH - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) if n else np.zeros(0, np.int64)
        turn = ok.copy()
        turn[1:] &= ~(ok[:-1] & (place[1:] == place[:-1]))
        stop = ok.copy()
        stop[:-1] &= ~(ok[1:] & (place[1:] == place[:-1]))
        self.first, self.last = np.flatnonzero(turn), np.flatnonzero(stop)
        self.anchor = grams[place[self.first]]

    def texts(self) -> np.ndarray:
        """The text each anchor is in."""
        return np.searchsorted(self.start, self.first, "right") - 1


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    c = Contexts(texts)
    return c.anchor, c.texts()


class Candidates:
    """An origin's contexts with shared anchors: distinct ones by bucket, and where each occurs. Those of hot anchors are cut down once the buckets have answered for the hashes of their windows."""

    def __init__(self, texts: list[bytes], found: pd.DataFrame, buckets: int):
        shared, hot = keys_of(found, "shared"), keys_of(found, "hot")
        self.parts = [(part, Contexts(texts[part])) for part in blocks(texts)]
        anchor = np.concatenate([c.anchor for _, c in self.parts] or [np.zeros(0, np.uint64)])
        of, n = np.unique(anchor, return_inverse=True, return_counts=True)[1:]
        is_hot = among(anchor >> np.uint64(16), hot)
        keep = ((n[of] > 1) | among(anchor >> np.uint64(16), shared)) & ~is_hot
        part = np.repeat(np.arange(len(self.parts)), [len(c.anchor) for _, c in self.parts])
        first, last = (np.concatenate([getattr(c, k) for _, c in self.parts] or [np.zeros(0, np.int64)]) for k in ("first", "last"))
        self.hot = anchor[is_hot], part[is_hot], first[is_hot], last[is_hot]
        anchor, self.part, self.first, self.last = anchor[keep], part[keep], first[keep], last[keep]
        answers = {b: x for k, b, x in zip(found["kind"], found["bucket"], found["keys"], strict=True) if k == "hash bits"}
        if answers:
            more = self.cut_down(answers, buckets)
            anchor, self.part, self.first, self.last = (np.append(x, y) for x, y in zip((anchor, self.part, self.first, self.last), more, strict=True))
        whole = np.zeros(len(anchor), np.uint64)
        for k, (_, c) in enumerate(self.parts):
            if (own := self.part == k).any():
                whole[own] = span(prefix(VALUES[c.bytes]), self.first[own], self.last[own] + WIDTH)
        bucket = bucket_of(anchor, buckets)
        order = np.lexsort((whole, anchor, bucket))
        a, w, b = anchor[order], whole[order], bucket[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        for k in np.flatnonzero(~fresh).tolist():  # equal hashes, and equal bytes?
            fresh[k] = self.bytes_of(order[k]) != self.bytes_of(order[k - 1])
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.pick = order[fresh]  # an occurrence of each distinct context
        self.anchor, self.bucket, self.again = a[fresh], b[fresh], np.bincount(self.of, minlength=fresh.sum()) > 1

    def bytes_of(self, k: int) -> bytes:
        return self.parts[self.part[k]][1].bytes[self.first[k] : self.last[k] + WIDTH].tobytes()

    def context(self, i: int) -> bytes:
        return self.bytes_of(self.pick[i])

    def gone(self, k: int, flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which bytes of a block are in a repeated window. flags: a bit a window of the distinct contexts, each of which begins at `begin`. Only this block's windows are held."""
        own = np.flatnonzero(self.part == k)
        n = self.last[own] - self.first[own] + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = flags[np.repeat(begin[self.of[own]], n) + step]
        return marked(len(self.parts[k][1].bytes), (np.repeat(self.first[own], n) + step)[hit], WIDTH)

    def hot_windows(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """context and start of every window with a hot anchor; of the distinct ones, sorted by bucket and hash: two hashes and bucket; and each window's distinct one."""
        _, part, first, last = self.hot
        size = last - first + 1
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        context = np.repeat(np.arange(len(part)), size)
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k, (_, c) in enumerate(self.parts):
            if (own := part[context] == k).any():
                for out, values in ((a, VALUES), (b, mixed(VALUES + np.uint64(1)))):
                    out[own] = span(prefix(values[c.bytes]), at[own], at[own] + WIDTH)
        bucket = bucket_of(a, buckets)
        a, b = a >> np.uint64(16), b & np.uint64(0xFFFFFFFF)
        order = np.lexsort((b, a, bucket))
        x, y, z = a[order], b[order], bucket[order]
        fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]))[: len(x)]
        of = np.empty(len(x), np.int64)
        of[order] = np.cumsum(fresh) - 1
        return context, at, x[fresh], y[fresh], z[fresh], of

    def cut_down(self, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor, part, first and last of what is left of the hot contexts: runs of windows whose hash occurs again, here or in another origin."""
        context, at, a, _, z, of = self.hot_windows(buckets)
        stays = np.bincount(of, minlength=len(a)) > 1
        for bucket, i, j in slices(z):
            stays[i:j] |= np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=j - i).astype(bool)
        where = np.flatnonzero(stays[of])
        context, at = context[where], at[where]
        begins = np.append(True, (context[1:] != context[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
        ends = np.append(begins[1:], True)[: len(at)]
        own = context[begins]
        return self.hot[0][own], self.hot[1][own], at[begins], at[ends]


HASHES = "bucket int, origin int, body binary"
ASKED = "bucket int, origin int, anchors binary, sizes binary, again binary, body binary"
TOLD = "origin int, kind string, bucket int, keys binary"


@releasing
def ask_hashes(own: pd.DataFrame, found: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Rows of an origin to the buckets: hashes of the windows with hot anchors."""
    out = []
    if len(own) and (found["kind"] == "hot").any():
        c, origin = Candidates(opened(own)[1], found, buckets), int(own["origin"].iloc[0])
        _, _, a, b, z, _ = c.hot_windows(buckets)
        out = [(bucket, origin, ten(a[i:j], b[i:j])) for bucket, i, j in slices(z)]
    return pd.DataFrame(out, columns=["bucket", "origin", "body"])


@releasing
def resolve_hashes(rows: pd.DataFrame) -> pd.DataFrame:
    """For each origin's hashes in a bucket, a bit: another origin has it."""
    got = [from_ten(x) for x in rows["body"]]
    a, b = np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])
    order = np.lexsort((b, a))
    fresh = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(fresh) - 1
    shared, at, out = np.bincount(of)[of] > 1, 0, []
    for origin, bucket, (x, _) in zip(rows["origin"], rows["bucket"], got, strict=True):
        out.append((origin, "hash bits", bucket, np.packbits(shared[at : at + len(x)]).tobytes()))
        at += len(x)
    return pd.DataFrame(out, columns=["origin", "kind", "bucket", "keys"])


@releasing
def ask(own: pd.DataFrame, found: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Rows of an origin to the buckets: distinct contexts."""
    names = [x.split()[0] for x in ASKED.split(", ")]
    if own.empty:
        return pd.DataFrame({n: [] for n in names}, dtype=object)
    c, origin, out = Candidates(opened(own)[1], found, buckets), int(own["origin"].iloc[0]), []
    for bucket, i, j in slices(c.bucket):
        bodies = [c.context(k) for k in range(i, j)]
        out.append((bucket, origin, c.anchor[i:j].tobytes(), np.fromiter(map(len, bodies), np.int32, j - i).tobytes(), np.packbits(c.again[i:j]).tobytes(), zlib.compress(b"".join(bodies), 1)))
    return pd.DataFrame(out, columns=names)


def sorted_windows(bodies: list[bytes]) -> list[np.ndarray]:
    """Of distinct contexts, which windows occur again, by the suffix array of all of them."""
    more, at, out = repeated(np.frombuffer(b"".join(body + b"\0" for body in bodies), np.uint8), WIDTH), 0, []
    for body in bodies:
        out.append(more[at : at + len(body) - WIDTH + 1])
        at += len(body) + 1
    return out


def common_windows(bodies: list[bytes], most: int = SORTED) -> list[np.ndarray]:
    """Of distinct contexts of any number, which windows occur again. More than `most` bytes are cut down to runs of windows whose hash occurs again; equal runs collapse, and what is left is sorted in parts by hash, in which equal windows meet."""
    if sum(map(len, bodies)) <= most:
        return sorted_windows(bodies)
    size = np.array([len(b) - WIDTH + 1 for b in bodies])
    begin = np.append(0, np.cumsum(size))
    hashes = np.empty(begin[-1], np.uint64)
    for part in blocks(bodies):
        a, start, _ = joined(bodies[part])
        own = window_hash(VALUES[a], WIDTH)
        at = np.repeat(start - (begin[part] - begin[part.start]), size[part]) + np.arange(size[part].sum())
        hashes[begin[part.start] : begin[part.stop]] = own[at]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    alike = ranked[1:] == ranked[:-1]
    again = np.zeros(len(hashes), bool)
    again[order] = np.append(alike, False) | np.append(False, alike)
    kinds = np.count_nonzero(np.append(alike[:1], alike[1:] & ~alike[:-1]))  # distinct hashes of those that occur again
    del order, ranked, alike
    of = np.repeat(np.arange(len(bodies)), size)
    out = np.zeros(len(hashes), bool)

    def runs(there: np.ndarray) -> dict[bytes, list[tuple[int, int]]]:
        """Runs of windows as bytes, with the places of the first and after the last in `hashes`."""
        where = np.flatnonzero(there)
        starts = np.append(True, (where[1:] != where[:-1] + 1) | (of[where[1:]] != of[where[:-1]]))[: len(where)]
        got: dict[bytes, list[tuple[int, int]]] = {}
        for i, j in zip(where[starts].tolist(), (where[np.append(starts[1:], True)[: len(where)]] + 1).tolist(), strict=True):
            k = of[i]
            got.setdefault(bodies[k][i - begin[k] : j - begin[k] + WIDTH - 1], []).append((i, j))
        return got

    def settle(found: dict[bytes, list[tuple[int, int]]]) -> None:
        for more, places in zip(sorted_windows(list(found)), found.values(), strict=True):
            for i, j in places:
                out[i:j] = more | (len(places) > 1)

    left = runs(again)
    if sum(map(len, left)) <= most:
        settle(left)
    else:  # equal windows have equal hashes, so each part can be settled alone
        del left
        cuts = -(-int(kinds) * (WIDTH + 1) // most)
        for k in range(cuts):
            settle(runs(again & (hashes % np.uint64(cuts) == k)))
    return [out[i:j] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


@releasing
def resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """For each origin's contexts in a bucket, a bit for each window start: it is repeated."""
    anchor = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["anchors"]])
    sizes = [np.frombuffer(x, np.int32) for x in rows["sizes"]]
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)) for x, s in zip(rows["again"], sizes, strict=True)]).astype(bool)
    bodies = []
    for x, s in zip(rows["body"], sizes, strict=True):
        data, end = zlib.decompress(x), np.cumsum(s)
        bodies += [data[j - i : j] for i, j in zip(s.tolist(), end.tolist(), strict=True)]
    bits: list[np.ndarray | None] = [None] * len(bodies)
    together: list[tuple[bytes, list[int]]] = []
    held = 0

    def settle() -> None:
        if together:
            for own, (_, places) in zip(common_windows([body for body, _ in together]), together, strict=True):
                for i in places:
                    bits[i] = own
            together.clear()

    order = np.argsort(anchor, kind="stable")
    for _, i, j in slices(anchor[order]):
        distinct: dict[bytes, list[int]] = {}
        for k in order[i:j].tolist():
            distinct.setdefault(bodies[k], []).append(k)
        unsettled = len(distinct) > 1
        if held + unsettled * sum(map(len, distinct)) > SORTED:
            settle()
            held = 0
        for body, places in distinct.items():
            if len(places) > 1 or again[places].any():
                full = np.ones(len(body) - WIDTH + 1, bool)
                for k in places:
                    bits[k] = full
                if unsettled:
                    together.append((body, []))
            elif unsettled:
                together.append((body, places))
            else:
                bits[places[0]] = np.zeros(len(body) - WIDTH + 1, bool)
            held += len(body) * unsettled
    settle()
    at, out = 0, []
    for origin, bucket, s in zip(rows["origin"], rows["bucket"], sizes, strict=True):
        own = bits[at : at + len(s)]
        out.append((origin, "context bits", bucket, zlib.compress(np.packbits(np.concatenate(own)).tobytes(), 1)))
        at += len(s)
    return pd.DataFrame(out, columns=["origin", "kind", "bucket", "keys"])


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, text: bool = False, hot: int = HOT, carry: tuple[str, ...] = (), origins: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs(doc_id, text); text adds what is left, as text (a character that was cut in two becomes U+FFFD). carry names columns that go along, as one JSON column `carried`. origins: parts of the documents, by their size if not given."""
    rows, origins, again = with_origin(docs, origins, carry)
    buckets = origins
    found = staged(merged(fingerprints(rows, buckets, anchors), hot=hot), "anchors").select("origin", "kind", "bucket", "keys")
    texts = packed(rows)

    @releasing
    def finish(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "copies"] + ["text"] * text + ["carried"] * bool(carry)
        if own.empty:
            return pd.DataFrame({n: [] for n in names}, dtype=object)
        ids, bodies, extras, copies = opened(own)
        c = Candidates(bodies, told, buckets)
        bits = {b: x for k, b, x in zip(told["kind"], told["bucket"], told["keys"], strict=True) if k == "context bits"}
        size = (c.last - c.first + 1)[c.pick]
        flags = np.zeros(int(size.sum()), bool)
        begin = np.append(0, np.cumsum(size))
        for bucket, i, j in slices(c.bucket):
            flags[begin[i] : begin[j]] = np.unpackbits(np.frombuffer(zlib.decompress(bits[bucket]), np.uint8), count=int(begin[j] - begin[i])).astype(bool)
        out = []
        for k, (where, contexts) in enumerate(c.parts):
            gone = c.gone(k, flags, begin)
            for d, start in zip(range(where.start, where.stop), contexts.start.tolist(), strict=True):
                body = bodies[d]
                own = gone[start : start + len(body)]
                if copies[d] > 1 and len(body) >= WIDTH:
                    own = np.ones(len(body), bool)
                spans = spans_of(own) if own.any() else []
                left = body
                if spans:
                    left = np.frombuffer(body, np.uint8)[~own].tobytes()
                row = (ids[d], len(body), len(body) - len(left), len(spans), hashlib.sha256(left).hexdigest(), copies[d])
                out.append(row + (left.decode("utf-8", "replace"),) * text + (extras[d].decode(),) * bool(carry))
        return pd.DataFrame(out, columns=names)

    by_origin = texts.groupBy("origin")
    hashes = by_origin.cogroup(found.groupBy("origin")).applyInPandas(lambda own, told: ask_hashes(own, told, buckets), HASHES)
    found = found.unionByName(staged(hashes.groupBy("bucket").applyInPandas(lambda x: resolve_hashes(x), TOLD), "hot-windows"))
    asked = by_origin.cogroup(found.groupBy("origin")).applyInPandas(lambda own, told: ask(own, told, buckets), ASKED)
    answers = asked.groupBy("bucket").applyInPandas(lambda x: resolve(x), TOLD)
    kept = by_origin.cogroup(answers.unionByName(found).groupBy("origin")).applyInPandas(lambda own, told: finish(own, told), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, copies long" + ", text string" * text + ", carried string" * bool(carry))
    return expanded(kept, again).drop("copy")
