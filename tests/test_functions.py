"""Hand-worked expectations of functions and operators, and their edge cases."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import dates, labels, numbers, text, udfs, vectors
from assayer.operators import assignment, choice, fitting, graphs, latest, mutation, readings, state
from assayer.sources import readers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_edit_distances(spark):
    r = one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting")), text.norm_distance(F.lit("abcd"), F.lit("abce")), text.norm_distance(F.lit(""), F.lit("xyz")), text.cer(F.lit("helo"), F.lit("hello")), text.cer(F.lit(""), F.lit("")), text.cer(F.lit("x"), F.lit("")), text.norm_distance(F.lit(""), F.lit("")))
    assert list(r) == [3, 0.25, 1.0, 0.2, 0.0, 1.0, 0.0]
    pairs = [("kitten", "sitting"), ("a", "abcdef"), ("ca", "abc"), ("ab", "ba"), ("", "xy"), ("", ""), ("recieve", "receive")]
    assert udfs.alignments(pairs).tolist() == [3, 5, 3, 1, 2, 0, 1] and udfs.alignments([]).tolist() == []


def plain_alignment(a, b):
    """By the definition, without a table."""
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


def test_alignments_like_the_definition():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(8)))
    pairs = [(word(), word()) for _ in range(400)]
    assert udfs.alignments(pairs).tolist() == [plain_alignment(a, b) for a, b in pairs]


@pytest.mark.parametrize("key, written, match", [("lantern", "lantem", True), ("lantern", "lxntxxn", False), ("river", "rivar", True), ("river", "rxvar", False), ("fox", "fax", False), ("1990s", "1980s", False), ("mountain", "muontain", True), ("tree", "tree", True)])
def test_word_matches(key, written, match):
    assert udfs.matches([(key, written)]).tolist() == [match]


def test_word_lists(spark):
    a, b = F.split(F.lit("the old red house stands"), " "), F.split(F.lit("the red house still stands here"), " ")
    assert list(one(spark, text.list_edits(a, b), text.list_edits(a, a), text.list_edits(F.array().cast("array<string>"), b))) == [3, 0, 6]


def test_folding(spark):
    import unicodedata

    cases = ["Straße", "ﬁne № ２", "It’s −3", "ABC", "", "É à ﬀ", "ΣΑΣ"]
    want = [unicodedata.normalize("NFKC", c).replace("’", "'").replace("−", "-").casefold() for c in cases]
    assert list(one(spark, *[text.folded(F.lit(c)) for c in cases])) == want == [udfs.fold(c) for c in cases]


def test_near_words_lose_no_pair(spark):
    from assayer.plans.arrow import near_words

    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(150)})
    got = {(r.w, r.x) for r in near_words(spark.createDataFrame([(w,) for w in words], "w string")).select("w", "x").collect()}
    want = {(a, b) for a in words for b in words if a < b and plain_alignment(a, b) <= 2}
    assert want <= got


def test_sentences():
    split = udfs.split_sentences
    assert split("Rain fell. Wind rose; night came! Who knew? So it was") == ["Rain fell.", "Wind rose;", "night came!", "Who knew?", "So it was"]
    assert split("See Fig. 3 and no. 7 etc. for more. Done.") == ["See Fig. 3 and no. 7 etc. for more.", "Done."]
    assert split("a hyphen-\nated word\nand a well-\nKnown one") == ["a hyphenated word and a well- Known one"]
    assert split("first line\n1. apples\n(b) pears\n\nlast") == ["first line", "1. apples", "(b) pears", "last"]
    assert [len(s.split()) for s in split(" ".join(["word"] * 70))] == [30, 30, 10] and split("... ! \n --") == []


def test_labels(spark):
    lines = ["7 c) Rivers flow", "Q no. 4. Tall trees", "Ans: Clouds", "Chapter 9 begins"]
    assert list(one(spark, *[text.strip_label(F.lit(x)) for x in lines])) == ["Rivers flow", "Tall trees", "Clouds", "Chapter 9 begins"]
    cases = {
        "11 c) some text": ("question", 11, "c", None, True), "5. some text": ("question", 5, None, None, False), "Q.7 text": ("question", 7, None, None, True), "Ans 3: text": ("question", 3, None, None, True), "l2) text": ("question", 12, None, None, False), "No. 8 - x": ("question", 8, None, None, True),
        "② text": ("question", 2, None, None, True), "Section - B": ("section", None, None, "B", False), "Part II": ("section", None, None, "2", False), "Sectiom: C": ("section", None, None, "C", False), "Ans: because": ("answer", None, None, None, True), "(ii) text": ("part", None, "ii", None, False),
        "lo and behold": None, "Il pleut": None, "Answer the question": None, "Quite so": None, "a. small": None, "": None, "plain words": None, "0. zero": None,
    }
    read = spark.createDataFrame([(k,) for k in cases], "t string").select("t", labels.parse_label("t").alias("l")).collect()
    assert {r.t: r.l and tuple(r.l)[:5] for r in read} == cases
    rest = ["3(b): two  words ", "Q no 12 - the rest", "no.4) four", "Answer: ", "\t* ③ circled", "SEC 2 a b c", "Section B one two three four", "ii] brackets", "iv) four", "Q", "answers to q. no. 9 nine"]
    want = [("question", 3, "b", None, True, "two  words"), ("question", 12, None, None, True, "the rest"), ("question", 4, None, None, True, "four"), ("answer", None, None, None, True, ""), ("question", 3, None, None, True, "circled"), ("section", None, None, "2", False, "a b c"), None, None, ("part", None, "iv", None, False, "four"), None, ("question", 9, None, None, True, "nine")]
    assert [r.l and tuple(r.l) for r in spark.createDataFrame([(k,) for k in rest], "t string").coalesce(1).select(labels.parse_label("t").alias("l")).collect()] == want
    got = spark.createDataFrame([(k,) for k in ["5. x", None, "plain"]], "t string").select(labels.parse_label("t").alias("l")).select("l.kind", "l.number", "l.strong").collect()
    assert [tuple(r) for r in got] == [("question", 5, False), (None, None, None), (None, None, None)]


def test_numbers():
    read = lambda t: [(float(v), u) for v, u in udfs.numbers_in(t)]
    assert read("sold 2,500 kg, then −4 and .25 or 7/8 of 3½ cups; 9 percentages") == [(2500, "kg"), (-4, "and"), (0.25, "or"), (0.875, "of"), (3.5, "cups"), (9, "")]
    assert read("¼ litre at 15% in v2.1 and 3/0 x 12.5.7") == [(0.25, "litre"), (15, "%"), (12.5, "")]
    assert read("room a12 b 6") == [(6, "")]


def test_phrases():
    said = "the tall trees stand near a quiet river and tall green trees fall"
    assert udfs.phrase_hits("the tall trees", said) == [(1, 3), (9, 12)]
    assert udfs.phrase_hits("quiet blue river", said) == [(6, 8)]  # one of three may be missing
    assert udfs.phrase_hits("blue quiet river", said) == [(6, 8)] and udfs.phrase_hits("blue red river", said) == []
    assert udfs.phrase_hits("of the", "a part of the whole, of the lot") == [(2, 4), (5, 7)]  # stop words alone are their own key
    assert udfs.phrase_hits("", said) == udfs.phrase_hits("tree", "") == []
    assert udfs.items_found([["tall trees"], ["trees"], ["river", "stream"], ["trees fall"]], said) == [0, 1, 2]


def test_trigrams(spark):
    import zlib
    from collections import Counter

    words = "Explain the quick brown fox to an ox; what is quick?"
    want = Counter()
    for w in ("quick", "brown", "fox", "quick"):
        padded = f" {w} "
        for i in range(len(padded) - 2):
            want[zlib.crc32(padded[i : i + 3].encode()) % 1024] += 1
        want[zlib.crc32(f"w:{w}".encode()) % 1024] += 2
    got = vectors.trigram_slots(spark.createDataFrame([(1, words)], "k int, t string"), "k", "t")
    assert {r.slot: r.weight for r in got.collect()} == dict(want)


def test_rounding(spark):
    cases = [("2.25", "0.5", "2.5"), ("2.24", "0.5", "2.0"), ("2.75", "0.5", "3.0"), ("1.125", "0.25", "1.25"), ("1.1", "0.25", "1.0"), ("3.5", "1", "4")]
    got = one(spark, *[numbers.to_step(F.lit(v), s) for v, s, _ in cases])
    assert [Decimal(x) for _, _, x in cases] == list(got)
    assert list(one(spark, numbers.percent(F.lit(9), F.lit(400)), numbers.percent(F.lit(1), F.lit(0)))) == [Decimal("2.3"), None]


def test_dates(spark):
    d = lambda s: F.lit(dt.date.fromisoformat(s))
    r = one(spark, dates.academic_label(d("2026-07-01")), dates.academic_label(d("2026-06-30")), dates.academic_label(d("1999-12-31")))
    assert list(r) == ["2026-27", "2025-26", "1999-00"]


def test_choice_rules(spark):
    marks = [2, 0.5, 1.5, 2, 1, 0, 1.5]
    df = spark.createDataFrame([("ci", "a", i + 1, 1, float(m)) for i, m in enumerate(marks)], "paper string, section string, slot int, alt int, mark double")
    got = choice.choice_rules(df, "paper", "section", "slot", "alt", "mark", 5).where("counted")
    assert sorted(r.slot for r in got.collect()) == [1, 3, 4, 5, 7] and got.agg(F.sum("mark")).first()[0] == 8
    two = spark.createDataFrame([("p", "b", 12, 1, 9.0), ("p", "b", 12, 2, 11.5)], df.schema)
    assert {(r.alt, r.outcome) for r in choice.choice_rules(two, "paper", "section", "slot", "alt", "mark", 1).collect()} == {(1, "other alternative scored higher"), (2, "counted")}
    tie = spark.createDataFrame([("p", "b", 12, 1, 7.0), ("p", "b", 12, 2, 7.0)], df.schema)
    assert choice.best_alternative(tie, ["slot"], "mark", "alt").where("chosen").first().alt == 1


def test_reading_selection(spark):
    lines = spark.createDataFrame([("l", 1, "p", "red sun", 0.5), ("l", 2, "q", "red sum", 0.7), ("l", 3, "r", "rod sun", 0.7)], "line string, pos int, engine string, body string, confidence double")
    agree = {r.engine: r.agreement for r in readings.agreement(lines, "line", "engine", "body").collect()}
    assert agree == pytest.approx({"p": 1 - 1 / 7, "q": 1 - (1 / 7 + 2 / 7) / 2, "r": 1 - (1 / 7 + 2 / 7) / 2})
    scored = lines.join(readings.agreement(lines, "line", "engine", "body"), ["line", "engine"]).withColumn("weight", F.lit(1.0)).withColumn("lexicon", F.when(F.col("engine") == "r", 1.0).otherwise(0.5))
    best = readings.select_reading(scored, "line", "pos", 0.5, 0.25, 0.9).first()
    assert best.engine == "r" and best.line_score == pytest.approx((0.7 + 0.5 * agree["r"] + 0.25) / 1.75) and best.flagged


def test_isotonic_like_the_closed_form(spark):
    rng = random.Random(5)
    rows = [("k", rng.randrange(12) / 12, rng.random()) for _ in range(80)]
    got = fitting.isotonic(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").first()
    xs = sorted({x for _, x, _ in rows})
    mean = lambda i, j: np.mean([y for _, x, y in rows if xs[i] <= x <= xs[j]])
    for i, x in enumerate(xs):
        want = max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1))
        assert np.interp(x, got.xs, got.ys) == pytest.approx(want, abs=2e-6)
    one_more = fitting.isotonic(spark.createDataFrame([("k", 0.1, 1.4), ("k", 0.2, 1.4)], "k string, x double, y double"), ["k"], "x", "y").first()
    assert one_more.xs == pytest.approx([0.1, 0.2], abs=1e-6) and one_more.ys == [1.0, 1.0]  # equal means stay apart, values stay within [0, 1]


def test_bootstrap(spark):
    pages = [("k", f"p{i}", float(i % 4), 10.0 + i) for i in range(12)]
    got = fitting.bootstrap_ratio(spark.createDataFrame(pages[::-1], "k string, page string, e double, n double"), ["k"], "page", "e", "n", draws=200).first()
    rng, order = random.Random(20261004), sorted(pages, key=lambda r: r[1])
    values = []
    for _ in range(200):
        drawn = [order[rng.randrange(12)] for _ in range(12)]
        values.append(sum(r[2] for r in drawn) / sum(r[3] for r in drawn))
    values.sort()
    assert (got.pages, got.low, got.high) == (12, pytest.approx(values[4]), pytest.approx(values[194]))
    few = fitting.bootstrap_ratio(spark.createDataFrame(pages[:4], "k string, page string, e double, n double"), ["k"], "page", "e", "n").first()
    assert few.low is None and few.high is None


def test_draws_are_those_of_the_seed():
    for units in (1, 5, 12, 64, 1000):
        rng = random.Random(7)
        want = [np.bincount([rng.randrange(units) for _ in range(units)], minlength=units) for _ in range(20)]
        assert all((a == b).all() for a, b in zip(fitting.draws_of(units, 20, 7), want, strict=True))


def test_paired_differences(spark):
    rng = random.Random(3)
    pages = {e: {f"p{i:02}": (rng.randrange(9), 10 + i) for i in range(10)} for e in "ab"}
    df = spark.createDataFrame([(e, p, *x) for e in pages for p, x in pages[e].items()], "engine string, page string, e long, n long")
    got = {(r.engine, r.against): (r.low, r.high) for r in fitting.bootstrap_ratio(fitting.paired(df, "engine", "page", "e", "n"), ["engine", "against"], "page", "e", "n", draws=100).collect()}
    for a, b in ("ab", "ba"):
        units = [(pages[a][p][0] - pages[b][p][0], pages[a][p][1]) for p in sorted(pages[a])]
        draw, values = random.Random(20261004), []
        for _ in range(100):
            sample = [units[draw.randrange(10)] for _ in units]
            values.append(sum(x for x, _ in sample) / sum(y for _, y in sample))
        values.sort()
        assert got[a, b] == (pytest.approx(values[2]), pytest.approx(values[96]))


def test_calibration(spark):
    df = spark.createDataFrame([("k", 0.5, 1.0), ("k", 0.5, 0.0), ("k", 0.2, 0.9), ("k", 0.9, 0.1)], "k string, x double, y double")
    got = fitting.isotonic(df, ["k"], "x", "y").first()
    assert got.xs == [0.2, 0.9] and got.ys == [0.5, 0.5]
    xs, ys = F.array(F.lit(0.2), F.lit(0.6)), F.array(F.lit(0.1), F.lit(0.9))
    assert list(one(spark, *[fitting.interpolated(F.lit(v), xs, ys) for v in (0.0, 0.4, 1.0)])) == pytest.approx([0.1, 0.5, 0.9])
    w = one(spark, *[numbers.engine_weight(F.lit(e)) for e in (0.1, 0.3, 0.5, 0.7)])
    assert w[0] == pytest.approx(np.log(9) / 2) and w[2] == w[3] == 0


@pytest.mark.parametrize("a, b, want", [((1, 2, 3, 4), (10, 20, 30, 40), 1), ((1, 2, 3), (3, 2, 1), -1), ((1, 1, 1), (1, 2, 3), 0), ((1, 2, 2, 3), (1, 2, 3, 4), 0.9486832980505138)])
def test_spearman(spark, a, b, want):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert fitting.spearman(df, "a", "b").first()[0] == pytest.approx(want)


def test_assignment_is_the_least():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 6):
        cost = rng.random((n, n))
        got = assignment.assign(cost)
        assert sorted(got) == list(range(n))
        assert sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(None, 3)]
    top = {n: n for e in edges if None not in e for n in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                top[a] = top[b] = min(top[a], top[b])
    got = {r.node: r.part for r in graphs.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == top


def test_versions(spark):
    base = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, version int")
    ok, refused = latest.append_versions(base, spark.createDataFrame([(1, 3), (2, 3), (3, 1)], "id int, version int"), "id", "version")
    assert sorted(map(tuple, ok.collect())) == [(1, 3), (3, 1)] and [tuple(r) for r in refused.collect()] == [(2, 3)]
    assert {tuple(r) for r in latest.without_newer(base, "id", "version").collect()} == {(1, 2), (2, 1)}


def test_upsert_checks_the_version(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, x string, version int")
    new = spark.createDataFrame([(1, "A", 2), (2, "B", 5), (3, "c", 1)], base.schema)
    assert {tuple(r) for r in mutation.upsert(base, new, "id", "version").collect()} == {(1, "A", 2), (2, "b", 1), (3, "c", 1)}


def test_first_hit_windows(spark):
    at = [0, 10, 59, 60, 119, 130]
    df = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "u long, e long, ts timestamp")
    got = {r.e: r.n for r in state.first_hit_windows(df, "u", "ts", "e", 60).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 1, 4: 2, 5: 1}


def test_sources(spark, tmp_path):
    import io
    import tarfile

    for name, head in (("page10.png", readers.MEDIA["png"]), ("page2.png", readers.MEDIA["png"]), (".hidden.png", b"x"), ("notes.txt", b"x")):
        (tmp_path / name).write_bytes(head + b"rest")
    files = readers.folder(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in files.collect()] == ["page2.png", "page10.png"]
    assert {r.k for r in files.select(readers.media_kind(F.col("content")).alias("k")).collect()} == {"png"}
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        info = tarfile.TarInfo("a.png")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    packed = spark.createDataFrame([("x", bytearray(buffer.getvalue())), ("y", bytearray(b"junk"))], "path string, content binary")
    assert {(r.path, r.member, r.error) for r in readers.archive_members(packed).collect()} == {("x", "a.png", None), ("y", None, "not an archive")}
    raw = spark.createDataFrame([(1, '{"Blocks":[{"BlockType":"LINE","Text":"hi","Confidence":90.0,"Geometry":{"BoundingBox":{"Left":0.1,"Top":0.2,"Width":0.3,"Height":0.1}}},{"BlockType":"WORD","Text":"hi"}]}')], "id int, body string")
    assert [(r.text, r.confidence) for r in readers.cloud_lines(raw).collect()] == [("hi", 0.9)]
    marks = spark.createDataFrame([("bucket/college/c1/booklets/b7/_complete",), ("other",)], "path string")
    assert [tuple(r) for r in readers.marker_events(marks).collect()] == [("c1", "b7")]


def test_roster(spark):
    rows = spark.createDataFrame([(2, "ab 1", "x"), (3, "AB1", "y"), (4, None, "z"), (5, "c", " ")], "line long, usn string, name string")
    got = {r.line: r.error for r in readers.roster(rows).collect()}
    assert got == {2: None, 3: "same roll number as line 2", 4: "roll number missing", 5: "name missing"}


def test_cosine(spark):
    a, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert list(one(spark, vectors.cosine(a, a), vectors.cosine(a, z), vectors.cosine(a, F.array(F.lit(-1.0), F.lit(0.0))))) == [1.0, 0.0, 0.0]


def test_the_library_stands_without_llm(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/assayer", tmp_path / "assayer", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') for n in q) and e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def boxes_of(rng, n, pages=3):
    out = []
    for i in range(n):
        x, y = rng.randrange(60), rng.randrange(60)
        out.append((rng.randrange(pages), f"b{i:03d}", rng.random() < 0.4, round(rng.random(), 3), x, y, x + rng.randrange(5, 30), y + rng.randrange(5, 30), f"e{i % 3}"))
    return out


BOX = "page long, id string, truth boolean, score double, x0 int, y0 int, x1 int, y1 int, engine string"


def shared(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    return max(0, w) * max(0, h) if w > 0 and h > 0 else 0


def area(a):
    return (a[6] - a[4]) * (a[7] - a[5])


def iou(a, b):
    return shared(a, b) / (area(a) + area(b) - shared(a, b))


def test_boxes_one_after_the_other(spark):
    rows = boxes_of(random.Random(3), 150)
    df = spark.createDataFrame(rows, BOX)
    free = {r[1]: r for r in rows if r[2]}
    want = {}
    for d in sorted((r for r in rows if not r[2]), key=lambda r: (r[0], -r[3], r[1])):
        best = max(((iou(d, f), f[1]) for f in sorted(free.values(), key=lambda f: f[1]) if f[0] == d[0]), key=lambda p: p[0], default=(0, None))
        want[d[1]] = best[1] if best[0] >= 0.3 else None
        free.pop(want[d[1]], None)
    assert {r.id: r.match for r in assignment.greedy(df, 0.3).collect()} == want
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[3], r[1])):
        if all(k[0] != r[0] or iou(k, r) <= 0.3 for k in kept):
            kept.append(r)
    assert {r.id for r in assignment.suppressed(df, 0.3).collect()} == {k[1] for k in kept}


def test_alignment_of_engines(spark):
    line = lambda k, e, x0, x1, y=0, truth=False: (1, k, truth, 0.5, x0, y, x1, y + 10, e)
    rows = [line("L1", "", 0, 100, truth=True), line("a1", "a", 0, 90), line("b1", "b", 10, 40), line("b2", "b", 45, 100), line("a2", "a", 0, 30, 50), line("b3", "b", 0, 60, 50), line("c1", "c", 40, 60, 50), line("c2", "c", 0, 20, 90)]
    got = {r.id: r.line for r in assignment.aligned(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {"a1": "L1", "b1": "L1", "b2": "L1", "a2": "extra 0", "b3": "extra 0", "c1": "extra 0", "c2": "extra 1"}


def test_a_page_of_any_size(spark):
    rows = boxes_of(random.Random(9), 6000, 1)
    df = spark.createDataFrame(rows, BOX)
    assert assignment.row_bands(df).count() == 6000 and assignment.aligned(df.limit(600)).count() > 0


def test_graphs_compared(spark):
    from assayer.plans import diagrams

    rng = random.Random(6)
    nodes, edges = {0: [], 1: []}, {0: [], 1: []}
    for graph in range(25):
        for side in (0, 1):
            n = rng.randrange(0, 5)
            nodes[side] += [(graph, k, rng.choice(["start", "stop", "stap", "sum up", "print"]), rng.choice(["BOX", "OVAL", "SMALL"])) for k in range(n)]
            edges[side] += [(graph, rng.randrange(n), rng.choice([None, *range(n)])) for _ in range(rng.randrange(4)) if n]
        edges = {k: sorted(set(v), key=repr) for k, v in edges.items()}
    frame = lambda side: (spark.createDataFrame(nodes[side], "graph long, node int, label string, shape string"), spark.createDataFrame(edges[side], "graph long, source int, target int"))
    (tn, te), (dn, de) = frame(0), frame(1)
    pairs = diagrams.node_pairs(diagrams.with_degrees(tn, te), diagrams.with_degrees(dn, de)).cache()
    got = {r.graph: r for r in diagrams.similarity((tn, dn), (te, de), pairs).collect()}
    chosen = {}
    for r in pairs.collect():
        chosen.setdefault(r.graph, {})[r.truth] = r.drawn
    degree = lambda side, g, k: sum(k == end for e in edges[side] if e[0] == g for end in e[1:])
    for g in range(25):
        a, b = ([r for r in nodes[s] if r[0] == g] for s in (0, 1))
        if not a and not b:
            continue
        label = lambda p, q: plain_alignment(p[2], q[2]) / max(len(p[2]), len(q[2]))
        shape = lambda p, q: 0.0 if p[3] == q[3] else 0.5 if "SMALL" in (p[3], q[3]) else 1.0
        deg = lambda p, q: abs(degree(0, g, p[1]) - degree(1, g, q[1])) / max(1, degree(0, g, p[1]), degree(1, g, q[1]))
        cost = {(p[1], q[1]): 0.6 * label(p, q) + 0.25 * shape(p, q) + 0.15 * deg(p, q) for p in a for q in b}
        best = float("inf")
        for k in range(min(len(a), len(b)) + 1):
            for left in itertools.combinations([p[1] for p in a], k):
                for right in itertools.permutations([q[1] for q in b], k):
                    if all(cost[x] <= 0.7 for x in zip(left, right)):
                        best = min(best, sum(cost[x] for x in zip(left, right)) + len(a) + len(b) - 2 * k)
        mine = chosen.get(g, {})
        assert sum(cost[x] for x in mine.items()) + len(a) + len(b) - 2 * len(mine) == pytest.approx(best)
        quality = {x: 1 - (0.6 * label(p, q) + 0.25 * shape(p, q)) / 0.85 for p in a for q in b for x in [(p[1], q[1])]}
        there, used, wrong = {e[1:] for e in edges[1] if e[0] == g}, set(), 0
        for _, u, v in [e for e in edges[0] if e[0] == g]:
            ahead, back = (mine.get(u), mine.get(v)), (mine.get(v), mine.get(u))
            if None not in ahead and ahead in there:
                used.add(ahead)
            elif None not in back and back in there:
                used.add(back)
                wrong += 1
            else:
                wrong += 1
        wrong += len(there - used)
        distance = sum(1 - quality[x] for x in mine.items()) + len(a) + len(b) - 2 * len(mine) + wrong
        size = len(a) + len(b) + sum(e[0] == g for s in (0, 1) for e in edges[s])
        assert got[g].distance == pytest.approx(distance, abs=1e-3) and got[g].similarity == pytest.approx(max(0, 1 - distance / size), abs=1e-3)


def test_decoding(spark):
    """Labels win over similarity, what has neither goes to the tray, and a number of another section is no start."""
    leaves = [{"slot": 1, "part": None, "section": "A"}, {"slot": 2, "part": None, "section": "A"}, {"slot": 3, "part": "a", "section": "B"}, {"slot": 3, "part": "b", "section": "B"}]
    label = lambda n, part=None, kind="question", strong=False: {"kind": kind, "number": n, "part": part, "section": None, "strong": strong, "rest": ""}
    rows = [(1, 0, None, 1.0, None, [0.1, 0.1, 0.1, 0.1]), (1, 1, label(2), 3.5, "A", [0.1, 0.1, 0.1, 0.1]), (1, 2, None, 0.0, "A", [0.1, 0.1, 0.1, 0.1]), (1, 3, label(1), 3.5, "A", [0.5, 0.1, 0.1, 0.1]), (1, 4, label(3, "a", strong=True), 3.5, "B", [0.1, 0.1, 0.2, 0.1]), (1, 5, label(None, "b", "part"), 2.5, "B", [0.1, 0.1, 0.1, 0.1])]
    from assayer.operators import segments

    schema = "booklet long, block long, l struct<kind:string,number:int,part:string,section:string,strong:boolean,rest:string>, evidence double, section string, sims array<double>"
    df = spark.createDataFrame(rows, schema)
    paper = spark.createDataFrame([(1, leaves)], "booklet long, leaves array<struct<slot:int,part:string,section:string>>")
    got = {r.block: r.state for r in segments.decode(df.join(paper, "booklet")).collect()}
    assert got == {0: -2, 1: 1, 2: 1, 3: 0, 4: 2, 5: 3}


def test_decoder_finds_the_best_path():
    """Against every path: what a path is worth is written out here by its definition."""
    from itertools import product
    from types import SimpleNamespace

    from assayer.operators import segments as S

    rng = random.Random(6)
    leaves = [{"slot": 1, "part": None, "section": "A"}, {"slot": 2, "part": "a", "section": "A"}, {"slot": 2, "part": "b", "section": "B"}]
    for _ in range(25):
        blocks = []
        for k in range(4):
            kind = rng.choice([None, None, "question", "part", "answer"])
            label = kind and {"kind": kind, "number": rng.choice([1, 2, 9]) if kind == "question" else None, "part": rng.choice([None, "a", "b"]) if kind != "answer" else None, "strong": rng.random() < 0.5}
            blocks.append(SimpleNamespace(booklet=1, block=k, leaves=leaves, l=label, evidence=rng.choice([0.0, 1.0, 3.5]), section=rng.choice([None, "A", "B"]), sims=[rng.random() for _ in leaves]))

        def worth(path):
            total, answered = 0.0, set()
            for k, (b, state) in enumerate(zip(blocks, path, strict=True)):
                label, evidence = b.l, b.evidence
                of = lambda n, part: next((i for i, q in enumerate(leaves) if q["slot"] == n and q["part"] == part), next((i for i, q in enumerate(leaves) if q["slot"] == n), None))
                named = set()
                if label and label["kind"] == "question":
                    leaf = of(label["number"], label["part"])
                    if leaf is not None and b.section is not None and leaves[leaf]["section"] != b.section:
                        label, evidence = None, evidence - 1.0
                    elif leaf is not None:
                        named = {leaf}
                elif label and label["kind"] == "part" and k and path[k - 1] >= 0 and leaves[path[k - 1]]["part"]:
                    named = {i for i, q in enumerate(leaves) if q["slot"] == leaves[path[k - 1]]["slot"] and q["part"] == label["part"]}
                if state == -2:
                    if label or (k and path[k - 1] != -2):
                        return float("-inf")
                    total += 1.5
                elif state == -1:
                    total += 0.5
                else:
                    total += 10 * (b.sims[state] - sum(b.sims) / 3) + ((4 if label["strong"] else 3) if state in named else 0) - (3 if b.section is not None and b.section != leaves[state]["section"] else 0)
                if k and state != path[k - 1]:
                    total += evidence - 3 - (4 if state in answered else 0)
                answered |= {state} - {-1, -2}
            return total

        decoder = S.Decoder()
        for b in blocks:
            decoder.feed(b)
        found = [r[2] for r in decoder.rows()]
        assert worth(found) == pytest.approx(max(worth(p) for p in product(range(-2, 3), repeat=4)))


def test_lists_join_their_answer(spark):
    from assayer.operators import segments

    texts = ["4) The answer begins", "1. first item", "2. second item", "3. third item", "5) next one"]
    lines = spark.createDataFrame([(1, 1, i, t, 100, 60 * i, 500, 60 * i + 28) for i, t in enumerate(texts)], "booklet long, page int, at int, text string, x0 int, y0 int, x1 int, y1 int")
    read = segments.evidence(segments.page_lines(lines, "booklet", "page", 1000), "booklet", "page", 1000)
    blocks = segments.summed(segments.blocks(read, "booklet", "page"), "booklet", "page").orderBy("block").collect()
    assert [(b.lines, b.l.number) for b in blocks] == [(4, 4), (1, 5)]
    assert [r.evidence for r in read.orderBy("at").collect()] == [3.5, 2.5, 2.5, 2.5, 2.5]


def test_steps_are_taken_up_again(spark, tmp_path):
    from assayer.operators import steps

    made = []

    def step(name, fail=False):
        def make(df):
            made.append(name)
            if fail:
                raise RuntimeError(name)
            return spark.range(3) if df is None else df.withColumn(name, F.lit(1))

        return name, make

    folder = f"file://{tmp_path}/steps"
    with pytest.raises(RuntimeError):
        steps.run(spark, folder, [step("a"), step("b", fail=True)])
    assert steps.run(spark, folder, [step("a"), step("b"), step("c")]).columns == ["id", "b", "c"] and made == ["a", "b", "b", "c"]
    steps.run(spark, folder, [step("a"), step("b"), step("c")])
    assert made == ["a", "b", "b", "c"]


def test_markup_and_uneven_files(spark):
    a = spark.createDataFrame([("q1", 0, "q1.1 The <b>sun</b> -LRB- a star -RRB-"), ("q1", 1, "q1.2 x"), ("q2", 0, "q2.1 y")], "code string, pos int, line string")
    g = spark.createDataFrame([("q1", 0, "4.5"), ("q1", 1, "2"), ("q2", 0, "1"), ("q2", 1, "3")], "code string, pos int, line string")
    got = {tuple(r) for r in readers.zipped_answers(a, g).collect()}
    assert got == {("q1:0", "q1", "The sun (a star)", 4.5, None), ("q1:1", "q1", "x", 2.0, None), (None, "q2", None, None, "answers and grades are not as many")}
    bad = readers.diagram_samples(spark.createDataFrame([("junk",), ('{"image":"i"}',)], "body string")).collect()
    assert [r.error is None for r in bad] == [False, True]


def test_figures_go_to_the_line_above_their_middle(spark):
    from assayer.operators import segments

    lines = [(1, 0, 1, 100.0, 0), (1, 0, 2, 90.0, 1), (1, 0, 3, 200.0, 2), (1, 1, 1, 50.0, 3), (1, 3, 1, 80.0, 4), (2, 5, 1, 10.0, 7)]
    figures = [(1, 0, "a", 100.0), (1, 0, "b", 95.0), (1, 0, "c", 10.0), (1, 1, "d", 300.0), (1, 2, "e", 5.0), (1, 3, "f", 79.0), (2, 4, "g", 1.0), (3, 1, "h", 1.0)]
    got = segments.place_figures(spark.createDataFrame(lines, "booklet long, page int, seq int, middle double, segment int"), spark.createDataFrame(figures, "booklet long, page int, figure string, middle double"), "booklet", "page")
    assert {r.figure: r.segment for r in got.collect()} == {"a": 1, "b": 1, "c": 0, "d": 3, "e": 3, "f": 3, "g": 7, "h": None}


def test_lines_in_figures(spark):
    from assayer.operators import segments

    lines = spark.createDataFrame([(1, 1, i, f"{i}) text", 100, y, 500, y + 28) for i, y in enumerate((0, 100, 200, 300))], "booklet long, page int, at int, text string, x0 int, y0 int, x1 int, y1 int")
    figures = spark.createDataFrame([(1, 1, "diagram", 0, 90, 1000, 240), (1, 1, "table", 0, 290, 1000, 340), (1, 1, "diagram", 0, 0, 1000, 1400), (1, 1, "diagram", 100, 110, 500, 120)], "booklet long, page int, kind string, x0 int, y0 int, x1 int, y1 int")
    laid = segments.in_figures(segments.page_lines(lines, "booklet", "page", 1000), figures, "booklet", "page", 1_400_000)
    rows = segments.evidence(laid, "booklet", "page", 1000).orderBy("at").collect()
    assert [r.in_figure for r in rows] == [False, True, True, False] and [r.evidence > 0 for r in rows] == [True, False, False, True] and rows[1].l is None


def test_finish_by_hand(spark):
    """Segments of the whole smallest table: every block in one segment, flags and thresholds as defined."""
    from assayer.plans import QUERIES
    from assayer.operators.segments import LEAST_SIMILAR as LEAST

    rows = QUERIES["seg_finish"](spark, "/root/testdata/sf0.001").toPandas()
    blocks = QUERIES["seg_blocks"](spark, "/root/testdata/sf0.001").toPandas()
    assert rows.groupby("booklet")["blocks"].sum().to_dict() == blocks.groupby("booklet").size().to_dict()
    kept = rows[rows["question"].notna()]
    assert ((kept["found_by"] == "rule") == kept["score"].isna()).all() and (kept["score"].dropna() >= LEAST).all()
    again = kept.duplicated(["booklet", "question"], keep=False)
    assert (kept.loc[again, "flags"].str.contains("duplicate")).all() and rows["figures"].sum() > 0


def test_ledger_takes_up_what_was_cut_off(spark, tmp_path):
    from assayer.operators import steps

    folder, made = f"file://{tmp_path}/ledger", []

    def step(name, fail_at=None):
        def make(ids):
            got = sorted(r.id for r in ids.collect())
            if fail_at is not None and fail_at in got:
                ids.write.parquet(f"{folder}/{name}/batch=torn")  # what a killed task leaves
                raise RuntimeError(name)
            made.append((name, got))
            return ids.where("id <> 3").withColumn("x", F.col("id") * 2)

        return name, make

    first, second = spark.createDataFrame([(i,) for i in range(6)], "id long"), spark.createDataFrame([(i,) for i in range(9)], "id long")
    with pytest.raises(RuntimeError):
        steps.advance(spark, folder, "id", first, [step("a"), step("b", fail_at=5), step("c")], parts=2)
    out = steps.advance(spark, folder, "id", second, [step("a"), step("b"), step("c")], parts=2)
    assert sorted((r.id, r.x) for r in out.collect()) == [(i, 2 * i) for i in (0, 1, 2, 4, 5, 6, 7, 8)]
    for name in "abc":
        ids = [i for n, got in made if n == name for i in got]
        assert sorted(ids) == list(range(9))  # no id twice, none lost; an id without rows is done as well
    assert steps.advance(spark, folder, "id", second, [step("a"), step("b"), step("c")]).count() == 8 and len(made) == len([m for m in made if m[1]])


def test_precision_curve(spark):
    rng = random.Random(9)
    found = [(rng.randrange(40) / 40, 1 if rng.random() < 0.6 else None) for _ in range(300)]
    got = {r.score: r for r in fitting.precision_curve(spark.createDataFrame(found, "s double, m int").repartition(7), "s", "m").collect()}
    at = {s: sum(m is not None for x, m in found if x >= s) / sum(x >= s for x, _ in found) for s in {x for x, _ in found}}
    assert {s: r.precision for s, r in got.items()} == pytest.approx(at)
    assert {s: r.best for s, r in got.items()} == pytest.approx({s: max(p for x, p in at.items() if x <= s) for s in at})


def test_overlapping_sets(spark):
    from assayer.operators import similarity

    rng = random.Random(4)
    sets = lambda n, k: [(i, sorted({f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(k))})) for i in range(n)]
    a, b = sets(40, 40), sets(15, 30)
    for least in (1, 5, 12):
        got = {(r.x, r.y): (r.n_x, r.n_y, r.both) for r in similarity.overlapping(spark.createDataFrame(a, "x int, set array<string>"), spark.createDataFrame(b, "y int, set array<string>"), least).collect()}
        assert got == {(x, y): (len(s), len(u), len({*s} & {*u})) for x, s in a for y, u in b if len({*s} & {*u}) >= least}


def test_extra_labels(spark):
    from assayer.plans import diagrams

    free = spark.createDataFrame([(1, "red bolt"), (1, "red bolts"), (1, "moon"), (1, "moon"), (2, "red bolt"), (3, "x"), (1, None)], "graph long, label string")
    known = spark.createDataFrame([(1, "red bolt"), (1, "green cog"), (2, "red bold"), (1, "red bolt")], "graph long, label string")
    got = sorted((r.graph, r.student) for r in diagrams.extra_labels(free.where("label IS NOT NULL"), known).collect())
    assert got == [(1, "moon"), (1, "moon"), (3, "x")]


def test_flags_follow_the_scorers(spark):
    """sc_flags by its definition, from the tables of the scorers it is made of."""
    from assayer.plans import QUERIES

    frame = lambda name: QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    got = {r.conv_id: set(filter(None, r.flags.split(","))) for r in frame("sc_flags").itertuples()}
    off = {r.conv_id for r in frame("sc_guard").itertuples() if r.off_target}
    apart = {r.doc_id for r in frame("sc_disagree").itertuples() if r.opinion == "disagree"}
    copies = frame("sc_candidates").groupby("conv_id")["copy"].max().to_dict()
    low = {r.conv_id for r in frame("sc_assemble").itertuples() if r.lines and r.low / r.lines >= 0.25}
    for conv, flags in got.items():
        assert ("off target" in flags) == (conv in off and "blank" not in flags) and ("scorers disagree" in flags) == (conv in apart)
        assert ("duplicate" in flags) == (copies[conv] > 1) and ("low ocr" in flags) == (conv in low)
    assert off and any("off target" in f for f in got.values())


def test_diagrams_chosen(spark):
    """sc_diagram's choice is the best of an answer's drawings; a comparison document says what the parts say."""
    import json

    from assayer.plans import QUERIES

    frame = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    best = frame("sc_diagram")
    docs = {r.graph: json.loads(r.body) for r in frame("jsn_comparison_doc").itertuples()}
    near = {r.graph: r for r in frame("gr_similarity").itertuples()}
    assert all(docs[g]["similarity"] == pytest.approx(near[g].similarity, abs=1e-6) for g in near) and set(docs) == set(near)
    edges = frame("gr_edges").groupby("graph").size().to_dict()
    assert {g: len(d.get("edges") or []) for g, d in docs.items() if d.get("edges")} == edges
    owners = {r.o_orderkey: r.o_custkey for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    most = {}
    for g, r in near.items():
        most[owners[g]] = max(most.get(owners[g], (-1, 0)), (r.similarity, -g))
    assert {r.answer: (r.similarity, -r.best) for r in best.itertuples()} == most
