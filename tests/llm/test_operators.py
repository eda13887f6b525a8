"""Each operator on a small table with nulls, empty and long texts, repeated rows and clashing columns, against plain Python; and on an empty table."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assayer.llm import byte_bpe, common, fingerprints, hyper_minhash, language_id, packing, pretokens, substring_index, suffix_dedup, token_counts, toxicity, vector_search

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASHES = ("score", "origin", "rep", "n", "body", "hash", "v", "shard", "digest", "words", "key", "tokens")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def rows_of():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), [word() for _ in range(120)]
    texts = [None, "", " \n\t ", "a", "one two three", "one two three", "Ünïcode  ß mixed́ Ⅷ 日本語", "<|endoftext|> inside", "x" * 30000, "ab " * 5000]
    texts += [prose(80) for _ in range(6)]
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(4)]
    for k in range(5):
        near = list(base)
        for _ in range(2):
            near[rng.randrange(120)] = word()
        texts.append(" ".join(near))
    texts += [texts[10], texts[10].upper()]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, passage), (None, None), (10, texts[10]), (12, "another text of a repeated id")]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], [None, "s1", "s2"][k % 3], None if t is None else len(t), *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(rows)]


ROWS = rows_of()
PAIRS = [(r[0], r[1] or "") for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want, *columns):
    got = Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
    assert got == Counter(want)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_token_counts(docs, none, tmp_path):
    lib = library()
    want = [(i, len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 512) for i, t in PAIRS]
    cache = f"file://{tmp_path}/cache"
    for few in (0, 5, 1000):  # after the first time every count comes from the cache
        same(token_counts.count_tokens(docs, JSON, 512, cache, few), want, "doc_id", "n_bytes", "n_tokens", "over_limit")
    spark = docs.sparkSession
    assert spark.read.parquet(cache).count() == len({t for _, t in PAIRS})
    again = spark.read.parquet(cache).limit(3).withColumn("n_tokens", F.col("n_tokens").cast("long"))
    again.select("digest", "n_tokens", "tokenizer").write.mode("append").partitionBy("tokenizer").parquet(cache)  # two runs at once
    same(token_counts.count_tokens(docs, JSON, 512, cache), want, "doc_id", "n_bytes", "n_tokens", "over_limit")
    token_counts.compacted(docs, cache, f"{cache}-2")
    assert spark.read.parquet(f"{cache}-2").count() == len({t for _, t in PAIRS})
    same(token_counts.count_tokens(docs, JSON, 512, f"{cache}-2"), want, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert token_counts.count_tokens(none, JSON).count() == 0


def test_token_counts_of_a_sentencepiece_model(docs, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, n := len(model.encode(t, num_threads=1)), n > 512) for i, t in PAIRS]
    cache = f"file://{tmp_path}/cache"
    same(token_counts.count_tokens(docs, path, 512, cache), want, "doc_id", "n_tokens", "over_limit")
    assert token_counts.count_tokens(docs, JSON, 512, cache).count() == len(PAIRS)  # another tokenizer never meets these counts
    assert docs.sparkSession.read.parquet(cache).count() == 2 * len({t for _, t in PAIRS})


def test_byte_bpe(docs, none):
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in PAIRS:
        ids = np.asarray(lib.encode_ordinary(t), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same(byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), want, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True), RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back.collect()) == Counter(PAIRS)
    assert byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pretokens_like_the_library():
    lib, own = library(), pretokens.byte_bpe(JSON)
    for t in ["", " ", "  a\n\n b", "it's 'S 12½²", "\x85x\xa0y", "日本 <|endoftext|>", "é" * 300]:
        assert own.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_packing(docs, none):
    lib = library()
    for window in (16, 1024):
        rows = packing.pack(docs, JSON, window, 0, keep_ids=True).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
            by_seq[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append((r.start, tuple(r.ids)))
        for pieces in by_seq.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= window
        want = Counter()
        for i, t in PAIRS:
            want[i] += len(lib.encode(t, add_special_tokens=False).ids) + 1
        assert {k: sum(len(x) for _, x in v) for k, v in by_doc.items()} == dict(want)
        for i in (3, 4, 8, 9):
            assert [y for _, x in sorted(by_doc[i]) for y in x] == [*lib.encode(dict(PAIRS)[i], add_special_tokens=False).ids, 0]
        full = sum(want.values())
        assert len(by_seq) <= full // window + 2
    assert packing.pack(none, JSON).count() == 0


def test_packing_follows_targets():
    queues = {s: [(i, 50) for i in range(400)] for s in "abc"}
    share, held = {"a": 0.5, "b": 0.3, "c": 0.2}, Counter()
    for sequence, _, _, _, length in packing.pack_shard({k: [(f"{k}{i}", n) for i, n in v] for k, v in queues.items()}, share, {}, 1024):
        pass
    pieces = list(packing.pack_shard({k: [(f"{k}{i}", n) for i, n in v] for k, v in queues.items()}, share, {"c": 512.0}, 1024))
    for sequence, _, doc, _, length in pieces:
        if sequence < 20:
            held[doc[0]] += length
    assert abs(held["a"] / 20480 - 0.5) < 0.05 and abs(held["b"] / 20480 - 0.3) < 0.05 and held["c"] > 0.2 * 20480


def test_packing_with_many_sources():
    import time

    began, n = time.time(), 20000
    got, windows = Counter(), Counter()
    for sequence, _, doc, _, length in packing.pack_shard({f"s{k}": [(k, 1500)] for k in range(n)}, {f"s{k}": 1 / n for k in range(n)}, {}, 1024):
        got[doc] += length
        windows[sequence] += length
    assert set(got.values()) == {1500} and len(got) == n
    assert list(windows.values())[:-1] == [1024] * (len(windows) - 1)
    assert time.time() - began < 10


def test_packing_carries_deficits_over_shards(spark):
    """Sources that are unlike in the shards; every sequence but a shard's last is full, and the mixture holds while sources last."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(20, 60))), ["a", "a", "a", "b", None][i % 5]) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, JSON, 128, 0, shard_bytes=300000).collect()
    of_shard, in_sequence = defaultdict(Counter), Counter()
    for r in got:
        of_shard[r.sequence_id >> 32][r.source] += r.length
        in_sequence[r.sequence_id] += r.length
    assert len(of_shard) >= 5 and sum(in_sequence.values()) == sum({(r.doc_id): r.doc_tokens for r in got}.values())
    last = {max(s for s in in_sequence if s >> 32 == k) for k in of_shard}
    assert all(n == 128 for s, n in in_sequence.items() if s not in last)
    total = Counter(r.source for r in got for _ in range(r.length))
    halves = Counter()
    for r in got:
        shard_size = sum(of_shard[r.sequence_id >> 32].values())
        if (r.sequence_id & 0xFFFFFFFF) * 128 < shard_size / 2:
            halves[r.source] += r.length
    for s in ("a", "b", None):
        assert abs(halves[s] / sum(halves.values()) - total[s] / sum(total.values())) < 0.03


def test_sums_of_shards_before(spark):
    rng = random.Random(9)
    rows = [(k, s, rng.randrange(100)) for k in range(0, 300) for s in ("a", "b", None) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "shard int, source string, held long")
    got = {(r.shard, r.source): r.o for r in packing.upto(df, "held", "o", "source", width=4).collect()}
    assert got == {(k, s): sum(n for j, t, n in rows if t == s and j < k) for k, s, _ in rows}


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[40]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(0, x[0].tolist(), "clash"), (1000, None, "x"), (1020, [0.0] * 16, "x"), (1040, [float("nan")] * 16, "x"), (1060, [1.0], "x"), (None, x[3].tolist(), "x"), (1080, [None] + [1.0] * 15, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    d, want = x.astype(np.float64), []
    for q in range(0, 300, 20):
        s = vector_search.inner(np.repeat(d[q : q + 1], 300, 0), d)
        order = sorted((-s[i], i) for i in range(300) if i != q)[:20]
        want += [(q, r + 1, i, -v) for r, (v, i) in enumerate(order)]
    for tile in (4096, 64):
        vector_search.TILE = tile
        same(vector_search.search(df, lambda c: c % 20 == 0, 20), want, "query_id", "rank", "vec_id", "score")
    vector_search.TILE = 4096
    assert vector_search.search(df.where("false"), lambda c: c % 20 == 0).count() == 0


def test_language_id(spark, docs, none):
    rng = random.Random(1)
    bags = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    text = lambda lang: " ".join("".join(rng.choice(bags[lang]) for _ in range(5)) for _ in range(20))
    rows = [(i, text(lang := list(bags)[i % 3]), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn(df, F.col("doc_id") < 200)
    got = {r.doc_id: r for r in language_id.identify(df, trees, "doc_id").collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    edge = language_id.identify(docs, trees, "doc_id", "text").collect()
    assert len(edge) == len(ROWS) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in edge)
    assert language_id.learn(none, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None, "doc_id").collect()} == {"und"}


def test_every_language_is_learned(spark):
    """600 labels, of which none is frequent."""
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x3B1, 0x3C9)]
    bags = {f"l{k}": rng.sample(letters, 6) for k in range(600)}
    text = lambda k: " ".join("".join(rng.choice(bags[k]) for _ in range(5)) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate(list(bags) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn(df, F.col("doc_id") < 1800)
    assert len(trees.languages) == 600
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df.where("doc_id >= 1800"), trees, "doc_id").collect()}
    assert np.mean([got[i] == k for i, _, k in rows[1800:]]) > 0.97


def test_totals_in_pieces(monkeypatch):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.choice([0, 1, 5, 3000]))).encode() for _ in range(40)]
    g, start, end = language_id.grams(texts)
    key, n = np.unique(g, return_counts=True)
    trees = language_id.Trees(["x", "y"], [(key, n), (key[::3], n[::3])])
    want = [trees.lengths(g[s:e]).sum(axis=0, dtype=np.float64) for s, e in zip(start, end)]
    monkeypatch.setattr(language_id, "AT_ONCE", 2048)
    assert np.allclose(trees.totals(g, start, end), want, rtol=1e-5)
    assert np.allclose(trees.of_one(g, 1).sum(), trees.lengths(g)[:, 1].sum(dtype=np.float64), rtol=1e-5)
    monkeypatch.setattr(language_id, "CELLS", 600)
    small = language_id.Trees(["x", "y"], [(key, n), (key[::3], n[::3])])
    assert all(len(cost) <= 300 for _, cost, _, _ in small.levels) and np.isfinite(small.totals(g, start, end)).all()


def test_code_lengths_are_exact():
    counts = Counter()
    data = b"\n\n\n" + b"abracadabra"
    for i in range(3, len(data)):
        counts[int.from_bytes(data[i - 3 : i + 1], "big")] += 1
    trees = language_id.Trees(["x"], [(np.array(list(counts)), np.array([float(n) for n in counts.values()]))])

    def cost(g, order):
        if order < 0:
            return 8.0
        context = g[-order - 1 : -1]
        follow = Counter()
        for k, n in counts.items():
            b = k.to_bytes(4, "big")
            if b[3 - order : 3] == context:
                follow[b[3]] += n
        total, distinct = sum(follow.values()), len(follow)
        if not total:
            return cost(g, order - 1)
        if g[-1] in follow:
            return -np.log2(follow[g[-1]] / (total + distinct))
        return -np.log2(distinct / (total + distinct)) + cost(g, order - 1)

    for g in (b"\n\n\na", b"abra", b"brab", b"zzzz", b"cadx", b"xxab"):
        assert abs(trees.lengths(np.array([int.from_bytes(g, "big")], np.uint32))[0, 0] - cost(g, 3)) < 1e-4


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["mudhead", "zonk" + rng.choice(["a", "er", "ing"])])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels, F.col("doc_id") < 600)
    got = {r.doc_id: r for r in toxicity.score(df, model, "doc_id", spans=True).collect()}
    assert np.mean([(got[i].score >= 0.5) == y for i, _, y in rows[600:]]) > 0.97
    i, text, _ = rows[600]
    assert any(text[s.start : s.end].startswith(("mudhead", "zonk")) for s in got[i].spans)
    edge = toxicity.score(docs, model, "doc_id").collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.learn(none, labels.where("false"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None, "doc_id").collect()} == {0.0}


def test_forward_backward_is_exact():
    rng, chain = np.random.default_rng(0), toxicity.Chain()
    chain.weight[:] = rng.normal(size=len(chain.weight))
    chain.start, chain.step = rng.normal(size=2), rng.normal(size=(2, 2))
    places, first = rng.integers(0, 100, (23, 4)), np.isin(np.arange(23), [0, 1, 9])
    got = chain.marginals(places, first)
    unary = chain.weight[places].sum(axis=1) + chain.weight[-1]
    for a, b in ((0, 1), (1, 9), (9, 23)):
        mass = np.zeros((b - a, 2))
        for code in range(1 << (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            s = chain.start[y[0]] + sum(unary[a + k] * y[k] for k in range(b - a)) + sum(chain.step[y[k - 1], y[k]] for k in range(1, b - a))
            for k in range(b - a):
                mass[k, y[k]] += np.exp(s)
        assert np.allclose(got[a:b], mass[:, 1] / mass.sum(axis=1))


def split(t):
    return t.encode().split()


def test_suffix_dedup(docs, none):
    seen = Counter()
    for _, t in PAIRS:
        b = t.encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    want = []
    for i, t in PAIRS:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(np.sum(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        want.append((i, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    for hot, origins in ((64, None), (2, None), (2, 9), (3, 30)):
        same(suffix_dedup.remove_repeats(docs, hot=hot, origins=origins), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most", [1, 2000, 20000, 1 << 20])
def test_contexts_of_any_number(most):
    rng = random.Random(8)
    some = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    shared, tail = some(260), some(210)
    bodies = list({some(rng.randrange(200, 260)) for _ in range(20)} | {some(rng.randrange(1, 80)) + shared for _ in range(30)} | {shared + some(rng.randrange(1, 80)) for _ in range(30)} | {tail[k:] + some(190 + k) for k in range(9)} | {b"a" * 300, b"a" * 240})
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    got = suffix_dedup.common_windows(bodies, most)
    assert [g.tolist() for g in got] == [[seen[b[i : i + 200]] > 1 for i in range(len(b) - 199)] for b in bodies]


ONE_ANCHOR = """
import resource, zlib
from collections import Counter
import numpy as np, pandas as pd
from assayer.llm import suffix_dedup

rng = np.random.default_rng(1)
footer = rng.integers(97, 123, 240).astype(np.uint8).tobytes()
bodies = [rng.integers(97, 123, 60).astype(np.uint8).tobytes() + footer for _ in range(50000)]
rows = []
for origin in range(100):
    own = bodies[500 * origin : 500 * origin + 500]
    rows.append((0, origin, np.full(500, 7, np.uint64).tobytes(), np.full(500, 300, np.int32).tobytes(), np.packbits(np.zeros(500, bool)).tobytes(), zlib.compress(b"".join(own), 1)))
out = suffix_dedup.resolve(pd.DataFrame(rows, columns=["bucket", "origin", "anchors", "sizes", "again", "body"]))
bits = np.concatenate([np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=500 * 101).reshape(500, 101) for k in out["keys"]])
assert bits[:, 60:].all()
for i in range(60):
    seen = Counter(b[i:60] for b in bodies)
    assert bits[:, i].tolist() == [int(seen[b[i:60]] > 1) for b in bodies]
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20
"""


def test_one_anchor_in_many_contexts():
    """50,000 contexts of one anchor, of 100 origins, are settled in less than 1 GB."""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", ONE_ANCHOR], check=True)


def test_two_stage_sorting():
    rng = random.Random(3)
    for _ in range(200):
        n, letters, depth = rng.randrange(1, 120), rng.choice([2, 3, 256]), rng.choice([1, 3, 20])
        t = bytes(rng.randrange(letters) for _ in range(n))
        order, agrees = suffix_dedup.suffixes(np.frombuffer(t, np.uint8), depth)
        keys = [(t[i:] + b"\0" * depth)[:depth] for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))
        assert agrees.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substring_index(docs, none, batches):
    least = {}
    for i, t in PAIRS:
        w = split(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, 1 << 60), 1 << 60 if i is None else i)
    want = []
    for i, t in PAIRS:
        w = split(t)
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < (1 << 60 if i is None else i):
                gone |= set(range(k, k + 13))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    same(substring_index.remove_repeats(docs, batches), want, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert substring_index.remove_repeats(none).count() == 0


def test_substring_index_over_calls(spark, docs, tmp_path):
    """Six calls in order of doc_id, with compactions, give the rows of one; and what a call adds is found by the next."""
    whole = docs.where("doc_id is null or doc_id not in (10, 12)")
    want = Counter(tuple(r) for r in substring_index.remove_repeats(whole, 2).collect())
    index, got = f"file://{tmp_path}/index", Counter()
    for part in ("doc_id < 11", "doc_id between 11 and 15", "doc_id between 16 and 19", "doc_id between 20 and 22", "doc_id >= 23", "doc_id is null"):
        got.update(tuple(r) for r in substring_index.remove_repeats(whole.where(part), 1, index=index).collect())
    passage = [r for r in got if r[0] is None and r[1] > 0]
    assert all(r[1] == r[2] for r in passage)  # of an earlier call
    assert got == want
    runs = substring_index.valid(spark, index)
    assert max(r["tier"] for r in runs) == 1 and len(runs) == 3 and max(r["upto"] for r in runs) == sum(r["upto"] - r["since"] for r in runs)


def sets_of(pairs):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for i, t in pairs:
        w = t.encode().translate(lower).split()
        out.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def test_hyper_minhash(spark, docs, none):
    single = docs.where("doc_id IS NULL OR doc_id NOT IN (10, 12)")
    pairs = [(i, t) for i, t in PAIRS if i not in (10, 12)]
    sets = sets_of(pairs)
    top = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((top[i], top[j]))
                top = {k: lo if v == hi else v for k, v in top.items()}
    want = [(i, len(s), top[i], i is None or top[i] == i) for i, s in sets]
    same(hyper_minhash.near_duplicates(single), want, "doc_id", "n_shingles", "component_id", "kept")
    same(hyper_minhash.near_duplicates(docs), components_of(PAIRS), "doc_id", "n_shingles", "component_id", "kept")
    assert hyper_minhash.near_duplicates(none).count() == 0


def components_of(pairs):
    """By all pairs; rows of an id are one document."""
    sets = sets_of(pairs)
    top = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((top[i], top[j]))
                top = {k: lo if v == hi else v for k, v in top.items()}
    of = [(i, len(s), (top[i] if s else i) if i is not None else None) for i, s in sets]
    return [(i, n, c, i is None or i == c) for i, n, c in of]


@pytest.mark.parametrize("tile", [2, 5, 1024])
def test_hyper_minhash_in_tiles(spark, tile):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(160)]
    rows = []
    for k in range(90):  # near a common text, at all distances
        t = list(common)
        for _ in range(rng.randrange(0, 14)):
            t[rng.randrange(160)] = word()
        rows.append((k, " ".join(t)))
    for k in range(90, 130):  # two texts sewn together: buckets hold several components
        cut = rng.randrange(30, 150)
        rows.append((k, " ".join(common[:cut] + [word() for _ in range(160 - cut)])))
    rows += [(3, rows[100][1]), (95, "one more text of a repeated id"), (120, rows[5][1]), (None, rows[0][1]), (200, None)]
    got = hyper_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)
    same(got, components_of([(i, t or "") for i, t in rows]), "doc_id", "n_shingles", "component_id", "kept")


def test_near_the_threshold_words_decide():
    texts = [b"a b c d e f g h", b"A b c d e f g x", b"a b c d e f g h i"]
    assert [hyper_minhash.reaches(texts[0], t, 60) for t in texts] == [True, True, True]
    assert [hyper_minhash.reaches(texts[0], t, 61) for t in texts] == [True, False, True]
    assert hyper_minhash.reaches(b"a b", b"A  b", 100) and not hyper_minhash.reaches(b"", b"", 0)


def test_hyper_minhash_chains_without_a_common_end(spark):
    rng = random.Random(4)
    rows, text = [], [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(40):  # each is near the next only
        rows.append((i, " ".join(text)))
        for k in range(2):
            text[(i * 11 + k * 5) % 200] = f"v{rng.randrange(10**6)}"
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = dict(sets_of(rows))
    top = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((top[i], top[j]))
                top = {k: lo if v == hi else v for k, v in top.items()}
    got = {r.doc_id: r.component_id for r in hyper_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == top


def test_estimates_are_near():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.9):
        a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
        cut = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:cut], rng.integers(0, 1 << 63, 2000 - cut).astype(np.uint64)])
        r = [hyper_minhash.registers(hyper_minhash.minima(x, np.zeros(2000, int), 1)) for x in (a, b)]
        assert abs(hyper_minhash.estimate(r[0], r[1], np.array([2000]), np.array([2000]))[0] - share) < 0.13


def test_fingerprints(docs, none):
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    least = {}
    for i, t in PAIRS:
        if i is not None:
            least[i] = min(least.get(i, t), t)
    ids = sorted(least)
    want = Counter()
    for i, t in PAIRS:
        m = len(t) // 3
        head = "" if i is None else least[ids[ids.index(i) - 1]]
        want[i, len(t), hashlib.sha256((t[: len(t) - m] + head[:m]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    of = {r.doc_id: r.fingerprint for r in rows}
    assert of[4] == of[5] and of[1] == of[2] and of[25] == of[26] == of[10] and of[3] != of[4]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id == 5).near_next == 1.0
    assert {r.group_id for r in fingerprints.groups(docs.where("doc_id in (25, 26)")).collect()} == {25}
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprints_with_equal_hashes(docs):
    """With a digest of two values, bytes tell texts apart."""
    import unicodedata

    def body(t):
        return " ".join(unicodedata.normalize("NFC", t).upper().lower().split())

    weak = lambda t: (F.char_length(t) % 2).cast("string")
    texts = {i: t for i, t in PAIRS if i not in (None, 10, 12)}
    rows = fingerprints.edited_fingerprints(docs.where("doc_id NOT IN (10, 12)"), weak).collect()
    for a in rows:
        for b in rows:
            assert (a.fingerprint == b.fingerprint) == (body(texts[a.doc_id]) == body(texts[b.doc_id]))
    ids = sorted(texts)
    for r in rows:
        t, after = texts[r.doc_id], texts[ids[ids.index(r.doc_id) - 1]]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert r.near_edited == float(body(edited) == body(t)) == float(r.fingerprint == r.edited_fingerprint)
        assert r.near_next == float(body(t) == body(after))


def test_normal_form(spark):
    import unicodedata

    rng = random.Random(1)
    pool = [0x61, 0x65, 0xE9, 0x323, 0x301, 0x307, 0x1E0B, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x9C7, 0x9BE, 0x20, 0x212B, 0x344, 0x915, 0x93C, 0x958, 0x1D15E, 0x345]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(unicodedata.normalize("NFC", r.t) == r.n for r in df.select("t", fingerprints.nfc(F.col("t")).alias("n")).collect())


def test_next_smaller(spark):
    rng = random.Random(2)
    values = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)} | set(range(-5, 5)) | {1 << 16, (1 << 16) + 1})
    got = {r.v: r.following for r in fingerprints.next_smaller(spark.createDataFrame([(v,) for v in values], "v long")).collect()}
    assert got == dict(zip(values, [None, *values]))


def toxic_rows(n, every, bad):
    """n rows of (doc_id, text, toxic), one in `every` toxic; the k-th toxic one holds bad(k)."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(10, 30))]
        if i % every == 0:
            w[rng.randrange(len(w))] = bad(i // every)
        rows.append((i, " ".join(w), int(i % every == 0)))
    return rows


def toxicity_of(spark, rows, learnable, per_class=toxicity.PER_CLASS):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), learnable, per_class)
    return model, {r.doc_id: r.score for r in toxicity.score(df, model, "doc_id").collect()}


def test_toxicity_learns_words_that_the_sample_does_not_hold(spark):
    bad = [f"{a}{b}zz" for a in "klmnopqr" for b in "stuvwxy"]  # each in under 2 % of the toxic texts
    rows = toxic_rows(6000, 4, lambda k: bad[k % len(bad)])
    _, got = toxicity_of(spark, rows, F.col("doc_id") < 4800, 20)
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows[4800:]]) > 0.97
    assert np.mean([got[i] >= 0.5 for i, _, y in rows[4800:] if y]) > 0.97


def test_toxicity_learns_from_few_labels(spark):
    rows = toxic_rows(200, 2, lambda k: "mudhead")
    _, got = toxicity_of(spark, rows, F.col("doc_id") < 30)
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows[30:]]) > 0.97


def test_toxicity_without_toxic_forms_is_clean(spark):
    rows = [(i, f"w{i} v{i}", i % 2) for i in range(40)]
    model, got = toxicity_of(spark, rows, F.lit(True))
    assert model is None and set(got.values()) == {0.0}


def test_toxicity_filter_loses_no_labelled_text(spark, docs, none, monkeypatch):
    df = spark.range(20000).selectExpr("id - 50 as doc_id", "concat('text ', id) as text").unionByName(docs.select("doc_id", "text"))
    ids = df.where("doc_id % 7 = 0").select("doc_id")
    wanted, got = ids.count(), toxicity.probable(df, ids)
    assert got.join(ids.distinct(), "doc_id", "left_semi").count() == wanted
    assert got.count() <= wanted + 20  # 20,000 ids in 2^26 bits: about one stranger
    monkeypatch.setattr(toxicity, "FILTER_BITS", 1 << 4)  # all bits set: nothing is lost, nothing is kept out
    assert toxicity.probable(df, ids).count() == df.count()
    assert toxicity.probable(none, ids).count() == 0 == toxicity.probable(df, ids.where("false")).count()


def test_toxicity_counts_a_text_once(spark):
    rows = [(1, "same text here", 1)] * 30 + [(i, "same text here", 1) for i in range(2, 60)] + [(i, f"clean words number {i}", 0) for i in range(60, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = toxicity.labelled(df.select("doc_id", "text"), df.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    assert texts.count() == 61 and not len(toxicity.lexicon(df.select("doc_id", "text"), texts))


def test_bound_shares_chance_by_the_forms_that_can_reach_it():
    assert toxicity.bound({1: 10**6, 20: 5}, 0.5) < toxicity.bound({20: 10**6}, 0.5)
    assert abs(toxicity.bound({1: 10**6, 1000: 5}, 0.5) - 2 * np.log(5 / 0.01)) < 1e-9


def test_packing_ignores_the_layout(spark):
    """The same rows in other files and another order give the same pieces, repeated rows included."""
    rows = [(i % 40 if i % 7 else None, f"word {i % 50} " * (1 + i % 9), f"s{i % 3}") for i in range(400)] + [(5, "the same row", "s1")] * 2500
    schema = "doc_id long, text string, source string"
    got = [sorted(packing.pack(spark.createDataFrame(x, schema).repartition(n), JSON, 128, 0, shard_bytes=3000).collect(), key=repr) for x, n in ((rows, 1), (rows[::-1], 7))]
    assert got[0] == got[1]
    shards = Counter(r.sequence_id >> 32 for r in got[0] if r.doc_id == 5 and r.start == 0)
    assert len(shards) > 10 and sum(r.start == 0 for r in got[0]) == len(rows)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_rows_with_very_many_copies(spark, monkeypatch, sent):
    """50,000 equal rows are worked on once and come back as so many; a copy under another id, and a part of the text, are still repeats."""
    monkeypatch.setattr(common, "SENT", sent)
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long)] * 50_000 + [(1, "short")] * 3 + [(None, long + " more of it")] * 2 + [(2, "begins " + long), (3, " ".join(f"v{i}" for i in range(80))), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = common.collapsed(docs, F.octet_length("text"))[0]
    assert seen.count() == 7 and seen.agg(F.sum("copies")).first()[0] == len(rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    n = len(long)
    assert got == {(1, n, n): 50_000, (1, 5, 0): 3, (None, n + 11, n + 11): 2, (2, n + 7, n): 1, (3, len(rows[-3][1]), 0): 1, (4, 0, 0): 2}
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_index.remove_repeats(docs).collect())
    assert got[(1, 80, 0)] == 50_000 and got[(2, 81, 80)] == 1 and got[(3, 80, 0)] == 1 and got[(4, 0, 0)] == 2 and sum(got.values()) == len(rows)
