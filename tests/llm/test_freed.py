"""What a step of suffix_dedup holds is gone before its memory is given back, and few windows are held at once."""

import gc
import tracemalloc

import numpy as np
import pandas as pd

from assayer.llm import common, suffix_dedup
from assayer.llm.packed import packed


def test_released_after_its_variables(spark, monkeypatch):
    rows = spark.createDataFrame([(0, i, bytes(f"{i} " + "a passage that occurs twice " * 20, "utf-8"), b"{}", 1) for i in range(3)], "origin int, doc_id long, text binary, extra binary, copies long")
    own, held = packed(rows).toPandas(), []
    monkeypatch.setattr(common, "release", lambda: held.append(sum(isinstance(x, suffix_dedup.Candidates) for x in gc.get_objects())))
    monkeypatch.setattr(suffix_dedup, "release", common.release, raising=False)
    told = pd.DataFrame({"kind": ["hot"], "bucket": [0], "origin": [0], "keys": [b""], "origins": [b""]})
    assert len(suffix_dedup.ask(own, told, 4)) and len(suffix_dedup.ask_hashes(own, told, 4)) == 0
    assert held == [0, 0]


def test_windows_of_a_block_at_a_time():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, 50_000, np.uint8)) for _ in range(20)] * 2
    told = pd.DataFrame({"kind": [], "bucket": [], "origin": [], "keys": [], "origins": []}, dtype=object)
    c = suffix_dedup.Candidates(texts, told, 4)
    size = (c.last - c.first + 1)[c.pick]
    begin, flags = np.append(0, np.cumsum(size)), np.ones(int(size.sum()), bool)
    tracemalloc.start()
    gone = [c.gone(k, flags, begin) for k in range(len(c.parts))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.sum() for x in gone) == sum(map(len, texts))
    assert peak < 10 * sum(map(len, texts))
