"""Near-duplicates by HyperMinHash.

A document's set holds its distinct shingles of SHINGLE words (A-Z lower-cased); with fewer words, the whole sequence is its one shingle. For each of REGISTERS hash functions the smallest hash of the set is kept as a 16-bit register: its count of leading zeros and the MANTISSA bits behind the first one.

1. Documents with equal sets (128-bit sums over the set) make a class; only the class's smallest doc_id goes on.
2. Bands of four registers, one 64-bit word each, are bucket keys. A document is paired with the smallest and the largest doc_id that it shares the most buckets with, not with all others in its buckets.
3. Pairs whose sizes allow the threshold are estimated: the share of equal registers, less the share that unlike registers agree by collision, must come within MARGIN of it. 192 registers have a standard error of 0.03 at 0.75, so 0.19 are over six of them.
4. Survivors are verified on their full sets, and verified links make components by alternating small and large stars.
5. In buckets that still hold several components, all pairs across components go through 3 and 4 inside tiles of bounded size, which return links only, so that none is lost for which a bucket was found. A bucket's largest component is cut into blocks that stay where they are; only the documents of its other components are copied, to each block.

At a similarity of 0.75, 48 bands of four miss a pair with a probability of 1e-8 if registers are independent. Full sets are compared by 64-bit hashes of shingles; where a few shingles more or less would decide otherwise, by the words themselves.

Nulls: a null text, or one without words, has an empty set, is linked with nothing and is kept. Rows with a null doc_id are left out of all links and keep a null component_id. Rows that repeat a doc_id are one document: what any of its texts is linked with joins its component, and each row gives a row. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import release, staged, text_bytes
from assayer.llm.textbytes import FOLDED, blocks, joined, mixed, prefix, span, window_hash, words

SHINGLE, BANDS, ROWS, MANTISSA = 5, 48, 4, 10
REGISTERS = BANDS * ROWS
MARGIN = 0.19
#: Documents of a block in step 5; two blocks meet at once.
TILE = 1024
#: Rows of small buckets that are worked on together.
PART = 1000
FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted by text and hash, and the text each is in."""
    a, start, _ = joined(texts)
    s, e = words(a)
    word = span(prefix(FOLDED[a]), s, e)
    doc = np.searchsorted(start, s, "right") - 1
    n = max(0, len(word) - SHINGLE + 1)
    at = np.flatnonzero(doc[:n] == doc[SHINGLE - 1 :][:n])
    first, count = np.unique(doc, return_index=True, return_counts=True)[1:]
    few = count < SHINGLE
    h = np.concatenate([window_hash(word, SHINGLE)[at], span(prefix(word), first[few], first[few] + count[few])])
    doc = np.concatenate([doc[at], doc[first[few]]])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    return h[fresh], doc[fresh]


def minima(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The smallest hash of each text by each function."""
    x, least = (h >> np.uint64(32)).astype(np.uint32), np.full((n, REGISTERS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        y = x[at : at + 1024, None] * FACTORS
        y ^= y >> np.uint32(15)
        own = doc[at : at + 1024]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        found = np.minimum.reduceat(y, first, axis=0)
        least[own[first]] = np.minimum(least[own[first]], found)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 32-bit minima, in 16 bits."""
    digits = np.frexp(least.astype(np.float64))[1]
    below = least.astype(np.uint64) << (33 - digits).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return ((32 - digits) << MANTISSA).astype(np.uint16) | (below >> np.uint64(32 - MANTISSA)).astype(np.uint16)


@cache
def _agree(n: int, m: int) -> float:
    """The chance that a register of two disjoint sets of these sizes agrees: over all its values, the product of their chances to hold the minimum."""
    zeros, part = np.arange(33)[:, None], np.arange(1 << MANTISSA)[None, :]
    low = (1 + part / (1 << MANTISSA)) * 2.0 ** -(zeros + 1)
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    return float(np.prod([np.exp(-low * k) - np.exp(-high * k) for k in (n, m)], axis=0).sum())


def collision_share(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """_agree for sizes to the nearest power of 2**0.25, of which there are few."""
    grid, of = np.unique(np.round(4 * np.log2(np.stack(np.broadcast_arrays(n, m), 1))), axis=0, return_inverse=True)
    return np.array([_agree(round(2 ** (x / 4)), round(2 ** (y / 4))) for x, y in grid])[of.ravel()]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from registers, by rows."""
    same, chance = (a == b).mean(axis=-1), collision_share(n, m)
    return np.maximum(0.0, (same - chance) / (1 - chance))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2 (sums over the set), words array<long> (four registers each)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts = list(x["text"])
            for part in blocks(texts):
                size = part.stop - part.start
                h, doc = shingles(texts[part])
                n = np.bincount(doc, minlength=size)
                packed = registers(minima(h, doc, size)).view(np.int64)
                sums = np.zeros((2, size), np.uint64)
                for k in range(2):
                    np.add.at(sums[k], doc, mixed(h + np.uint64(k + 1)))
                yield pd.DataFrame({"doc_id": x["doc_id"].iloc[part], "n": n, "h1": sums[0].view(np.int64), "h2": sums[1].view(np.int64), "words": list(packed)})
        release()

    return rows.mapInPandas(sketch, "doc_id long, n long, h1 long, h2 long, words array<long>")


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b), those whose sizes and registers allow the threshold."""
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("words").alias(f"w_{k}"))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                a, b = (np.stack(x[k].to_numpy()).view(np.uint16) for k in ("w_a", "w_b"))
                ok = estimate(a, b, x["n_a"].to_numpy(), x["n_b"].to_numpy()) >= threshold - MARGIN
                yield x.loc[ok, ["a", "b"]]
        release()

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")).mapInPandas(pick, "a long, b long")


def reaches(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two texts are linked, by their words."""
    sides = []
    for text in (a, b):
        w = text.lower().split()  # of bytes: A-Z only, and the six bytes between words
        sides.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    common, union = len(sides[0] & sides[1]), len(sides[0] | sides[1])
    return common > 0 and 100 * common >= percent * union


def lead(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """By how much a pair's intersection and union pass the threshold."""
    return 100 * common - percent * (n + m - common)


#: A lead of less than this either way is settled by words: two hashes that collide move it by at most 175.
BORDER = 400


def linked(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union of their full sets. Each pair meets once; rows of a document are neighbours, so its set is made once a task."""
    both = pairs.join(bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b").join(bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        of = zstandard.ZstdDecompressor()
        known: tuple[int | None, bytes, np.ndarray] = (None, b"", np.zeros(0, np.uint64))
        for x in frames:
            ok = []
            for a, body_a, body_b in zip(x["a"].tolist(), x["body_a"], x["body_b"], strict=True):
                if known[0] != a:
                    known = (a, text := of.decompress(body_a), shingles([text])[0])
                other = of.decompress(body_b)
                p, q = known[2], shingles([other])[0]
                by = lead(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent)
                ok.append(by >= 0 if abs(by) >= BORDER else reaches(known[1], other, percent))
            yield x.loc[ok, ["a", "b"]]
        release()

    return both.select("a", "b", "body_a", "body_b").mapInPandas(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of links (a, b), by alternating large and small stars; each round is staged in the shared folder. It ends when only stars are left: no node hangs on two others, or on one that hangs itself."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # at most a row an edge, so repeats can wait
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = staged(small, "stars")


def tiles(shared: DataFrame, roots: DataFrame, tile: int) -> DataFrame:
    """t, whole, side, rep, root, band: documents of the buckets that hold several components, in tiles of bounded size; `whole` where a tile is all of its bucket. Documents of sides 0 and 1 meet each other, those of side 2 one another."""
    labelled = shared.join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = labelled.groupBy("band", "key", "root").agg(F.count("*").alias("c")).groupBy("band", "key").agg(F.count("*").alias("roots"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most")).where("roots > 1")
    cuts = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    sizes = sizes.select("band", "key", "roots", (F.col("n") <= tile).alias("whole"), F.col("most.root").alias("main"), cuts(F.col("most.c")).alias("main_cuts"), cuts(F.col("n") - F.col("most.c")).alias("cuts"))
    rows = labelled.join(sizes, ["band", "key"]).withColumn("in_main", F.col("root") == F.col("main"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep"), F.when(F.col("in_main"), F.col("main_cuts")).otherwise(F.col("cuts"))).cast("int"))
    at = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    i, none = F.col("i"), F.lit(0)
    upto = lambda n: F.sequence(none, n - 1)
    to_main = F.transform(upto(F.col("main_cuts")), lambda j: at(0, i, j, F.lit(1)))
    to_others = F.transform(upto(F.col("cuts")), lambda j: at(1, F.least(i, j), F.greatest(i, j), F.when(i == j, 2).when(i < j, 0).otherwise(1)))
    own = F.when(F.col("whole"), F.array(at(2, none, none, F.lit(2)))).when(F.col("in_main"), F.transform(upto(F.col("cuts")), lambda j: at(0, j, i, none)))
    own = own.when(F.col("roots") == 2, to_main).otherwise(F.concat(to_main, to_others))
    rows = rows.withColumn("tile", F.explode(own))
    return rows.select(F.xxhash64("band", "key", "tile.kind", "tile.i", "tile.j").alias("t"), "whole", "tile.side", "rep", "root", "band")


def candidates(own: pd.DataFrame, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of a tile, each document's place with the places of those of other components that it may be linked with; a pair comes up in the first band it shares only."""
    w, band = np.stack(own["words"].to_numpy()), int(own["band"].iloc[0])
    r, rep, root, n, side = w.view(np.uint16), own["rep"].to_numpy(), own["root"].to_numpy(), own["n"].to_numpy(), own["side"].to_numpy()
    for i in range(len(rep)):
        j = np.flatnonzero((root != root[i]) & (rep > rep[i]) & ((side == 2) | (side != side[i])) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i])))
        if len(j):
            j = j[((r[j] == r[i]).mean(axis=1) >= threshold - MARGIN) & ~(w[j, :band] == w[i, :band]).any(axis=1)]  # collisions only raise the share
        if len(j):
            j = j[estimate(r[j], r[i], n[j], n[i]) >= threshold - MARGIN]
        if len(j):
            yield i, j


def across(shared: DataFrame, reps: DataFrame, bodies: DataFrame, roots: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Verified links (a, b) between different components that share a bucket, a spanning set of each tile's. Registers meet first; full texts go only to tiles in which a pair is likely, and there only of documents that are in one."""
    threshold, placed = percent / 100, staged(tiles(shared, roots, tile), "tiles")
    # a tile of a large bucket is dealt by itself, small buckets some together
    placed = placed.select(F.when(F.col("whole"), F.pmod("t", F.lit(placed.count() // PART + 1))).otherwise(F.col("t")).alias("part"), "t", "side", "rep", "root", "band")
    columns = "part long, t long, side int, rep long, root long, band int"

    def hopeful(x: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for _, own in x.groupby("t"):
            if own["root"].nunique() > 1:
                found = {k for i, j in candidates(own, threshold) for k in (i, *j.tolist())}
                keep.append(own.iloc[sorted(found)])
        release()
        return pd.concat(keep or [x.iloc[:0]])[["part", "t", "side", "rep", "root", "band"]]

    likely_ones = staged(placed.join(reps, "rep").groupBy("part").applyInPandas(hopeful, columns), "likely")

    def settle(x: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        of, out = zstandard.ZstdDecompressor(), []
        for _, own in x.groupby("t"):
            sets = [shingles([of.decompress(b)])[0] for b in own["body"]]
            size = np.array([len(s) for s in sets])
            rep, parent = own["rep"].tolist(), {k: k for k in own["root"].tolist()}
            root = own["root"].tolist()

            def top(k: int, parent: dict = parent) -> int:
                while parent[k] != k:
                    k = parent[k] = parent[parent[k]]
                return k

            for i, j in candidates(own, threshold):
                j = np.array([k for k in j.tolist() if top(root[k]) != top(root[i])], np.int64)
                if not len(j):
                    continue
                all_of = np.concatenate([sets[k] for k in j])
                where = np.minimum(np.searchsorted(sets[i], all_of), size[i] - 1)
                common = np.bincount(np.repeat(np.arange(len(j)), size[j]), sets[i][where] == all_of, len(j))
                by = lead(common.astype(np.int64), size[i], size[j], percent)
                for k, by_k in zip(j[by > -BORDER].tolist(), by[by > -BORDER].tolist(), strict=True):
                    if top(root[k]) != top(root[i]) and (by_k >= BORDER or reaches(*(of.decompress(own["body"].iloc[z]) for z in (i, k)), percent)):
                        parent[top(root[k])] = top(root[i])
                        out.append((rep[i], rep[k]))
        release()
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    full = likely_ones.join(reps, "rep").join(bodies.withColumnRenamed("doc_id", "rep"), "rep")
    return full.groupBy("part").applyInPandas(settle, "a long, b long").distinct()


def repeated_ids(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat a doc_id; as a rule there are none."""
    twice = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    of = staged(known.join(twice, "doc_id", "left_semi").select("doc_id", "h1", "h2", "n").distinct().join(reps.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("doc_id", "rep"), "repeated-ids")
    return of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def near_duplicates(docs: DataFrame, percent: int = 75, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs(doc_id, text): documents linked when 100 * intersection >= percent * union of their sets. tile: documents of a block that are compared at once."""
    threshold = percent / 100
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = staged(sketches(one), "sketches")
    known = sketched.where("doc_id is not null and n > 0")
    reps = staged(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("words").alias("words")), "classes")
    small = reps.select("rep", "n", "words")
    keys = reps.select("rep", F.posexplode("words").alias("band", "key"))
    ends = keys.groupBy("band", "key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    shared = staged(keys.join(ends, ["band", "key"]), "buckets")
    bodies = _squeezed(one.where("doc_id is not null").select("doc_id", text_bytes().alias("text")))
    bodies = staged(bodies.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "bodies")
    # each document with the low and the high end that it shares the most buckets with
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("end"), F.col(end).alias("e")) for k, end in enumerate(("low", "high")))))
    counts = shared.select("rep", sides.alias("end")).select("rep", "end.*").where("rep <> e").groupBy("rep", "end", "e").agg(F.count("*").alias("c"))
    most = counts.groupBy("rep", "end").agg(F.max(F.struct("c", "e"))["e"].alias("e"))
    tried = most.select(F.least("rep", "e").alias("a"), F.greatest("rep", "e").alias("b")).distinct()
    tried = staged(likely(tried, small, threshold), "pairs")
    links = staged(linked(tried, bodies, percent), "links")
    links = links.unionByName(repeated_ids(known, reps))
    roots = components(links)
    more = staged(across(shared.select("rep", "band", "key"), small, bodies, roots, percent, tile), "links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))  # stars of the links stand for them
    classes = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("component_id"))
    joined_up = sketched.drop("words").join(classes, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined_up.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _squeezed(rows: DataFrame) -> DataFrame:
    """doc_id, body: texts compressed before they are shuffled."""

    def squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        to = zstandard.ZstdCompressor(level=1)
        for x in frames:
            yield pd.DataFrame({"doc_id": x["doc_id"], "body": [to.compress(t) for t in x["text"]]})
        release()

    return rows.mapInPandas(squeeze, "doc_id long, body binary")
