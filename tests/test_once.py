"""Work that is done once, not for each piece of a text or each text."""

from pyspark.sql import functions as F

from assayer.functions import text, udfs


def test_chunks_find_the_words_once(spark):
    df = spark.createDataFrame([("a b c d e",), ("",)], "t string").select(text.chunks(F.split("t", " "), 2).alias("c"))
    assert [r.c for r in df.collect()] == [[["a", "b"], ["c", "d"], ["e"]], [[""]]]
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_phrases_need_no_table_a_text(monkeypatch):
    monkeypatch.setattr(udfs, "alignments", None)
    assert udfs.phrase_hits("photosynthesis", "the photosynthseis of photosyntheses and photographs") == [(1, 2), (3, 4)]
    assert udfs.items_found([["energy", "energ"], ["plants"]], "enrgy of the plant") == [0, 1]


def test_a_worker_holds_one_archive(spark):
    import io
    import tarfile

    import pandas as pd

    from assayer.sources import readers

    def packed(n):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w") as tar:
            for i in range(n):
                info = tarfile.TarInfo(f"{i}.html")
                info.size = 3
                tar.addfile(info, io.BytesIO(b"abc"))
        return buffer.getvalue()

    frames = list(readers.members(iter([pd.DataFrame({"path": ["a", "b", "c", "d"], "content": [packed(2), packed(0), b"none", packed(3)]})])))
    assert [len(x) for x in frames] == [2, 1, 3]
    assert [x["error"].iloc[0] for x in frames] == [None, "not an archive", None]
