"""Papers with faults of every kind, by hand."""

import copy
import json
from collections import Counter

from pyspark.sql import functions as F

from assayer.operators import blueprints

ID = "0f8fad5b-d9cb-469f-a165-70867728950e"
GOOD = {
    "schema_version": "1.2", "title": "Paper", "course_code": "C1", "subject_id": ID, "total_marks": 20, "duration_minutes": None,
    "sections": [
        {"label": "A", "method": "diagram", "choice": {"rule": "any", "n": 2}, "items": [{"type": "question", "label": "1", "marks": 5}, {"type": "question", "label": "2", "marks": 2.5, "question_id": ID}, {"type": "question", "label": "3", "marks": 5, "steps": [{"label": "s", "marks": 2}, {"label": "t", "marks": 3}]}]},
        {"label": "B", "method": "semantic_rubric", "choice": {"rule": "all"}, "items": [{"type": "or", "alternatives": [{"label": "4", "marks": 10}, {"label": "5", "marks": 10, "parts": [{"label": "a", "marks": 4}, {"label": "b", "marks": 6, "steps": [{"label": "x", "marks": 6}]}]}]}]},
    ],
}


def changed(*steps):
    """GOOD with values put at paths; a value of ... takes the field away."""
    doc = copy.deepcopy(GOOD)
    for *path, value in steps:
        at = doc
        for k in path[:-1]:
            at = at[k]
        if value is ...:
            del at[path[-1]]
        else:
            at[path[-1]] = value
    return json.dumps(doc)


Q1, OR = ("sections", 0, "items", 0), ("sections", 1, "items", 0)
CASES = [
    (json.dumps(GOOD), set()),
    ("{broken", {("(document)", "is not JSON")}),
    ("", {("(document)", "is not JSON")}),
    ("[1, 2]", {("(document)", "must be an object")}),
    ("null", {("(document)", "must be an object")}),
    (changed(("schema_version", "9")), {("schema_version", 'must be "1.2" (or "1.1", "1.0")')}),
    (changed(("title", ...), ("course_code", 7)), {("title", "is required"), ("course_code", "must be text")}),
    (changed(("title", "  "), ("exam_code", "x" * 51)), {("title", "must not be empty"), ("exam_code", "is longer than 50 characters")}),
    (changed(("subject_id", "x"), ("colour", 1)), {("subject_id", "is not a valid id (UUID)"), ("colour", "unknown field")}),
    (changed(("duration_minutes", 90.5)), {("duration_minutes", "must be a whole number")}),
    (changed(("duration_minutes", 0), ("kind", "other")), {("duration_minutes", "must be between 1 and 1440"), ("kind", 'must be "schema" or "paper"')}),
    (changed(("negative_marking", 0.3), ("mark_step", True)), {("negative_marking", "must be 0, 0.25 or 0.5 marks per wrong answer"), ("mark_step", "must be a number")}),
    (changed(("total_marks", 21)), {("total_marks", "The exam total is 21 but the sections add up to 20")}),
    (changed(("total_marks", 1001)), {("total_marks", "must not exceed 1000")}),
    (changed(("sections", [])), {("sections", "needs at least 1 sections")}),
    (changed(("sections", {})), {("sections", "must be a list")}),
    (changed(("sections", ...)), {("sections", "must be a list")}),
    (changed(("sections", 0, 5)), {("sections[0]", "must be an object")}),
    (changed(("sections", 0, "method", "guess")), {("sections[0].method", "must be one of: " + ", ".join(blueprints.METHODS))}),
    (changed(("sections", 0, "choice", {"rule": "any", "n": 4})), {("sections[0].choice.n", "answering any 4 of 3 is impossible")}),
    (changed(("sections", 0, "choice", {"rule": "some"})), {("sections[0].choice.rule", 'must be "all" or "any"')}),
    (changed(("sections", 0, "choice", {"rule": "any"})), {("sections[0].choice.n", "must be a whole number")}),
    (changed(("sections", 1, "choice", {"rule": "all", "n": 1})), {("sections[1].choice.n", 'only goes with rule "any"')}),
    (changed((*Q1, "type", "quiz")), {("sections[0].items[0].type", 'must be "question" or "or"')}),
    (changed((*Q1, "marks", -1)), {("sections[0].items[0].marks", "must be greater than 0")}),
    (changed((*Q1, "marks", 2.125)), {("sections[0].items[0].marks", "uses at most 2 decimal places")}),
    (changed((*Q1, "marks", "5"), (*Q1, "size", 1)), {("sections[0].items[0].marks", "must be a number"), ("sections[0].items[0].size", "unknown field")}),
    (changed((*Q1, "question_id", 5)), {("sections[0].items[0].question_id", "must be a question id (UUID) or null")}),
    (changed((*Q1, "label", "4")), {("sections", "Question number 4 is used twice")}),
    (changed(("sections", 1, "label", "A")), {("sections", "Section labels must be different")}),
    (changed((*OR, "alternatives", 0, "marks", 9)), {("sections[1].items[0]", "alternatives must carry equal marks")}),
    (changed((*OR, "alternatives", [])), {("sections[1].items[0].alternatives", "needs at least 2 alternatives")}),
    (changed((*OR, "alternatives", 1, "parts", 0, "marks", 5)), {("sections[1].items[0].alternatives[1].parts", "the sub-part marks add up to 11 but the question carries 10")}),
    (changed((*OR, "alternatives", 1, "parts", 0, "label", "b")), {("sections[1].items[0].alternatives[1].parts", "sub-part labels must be different")}),
    (changed((*OR, "alternatives", 1, "parts", 1, "steps", 0, "marks", 5.5)), {("sections[1].items[0].alternatives[1].parts[1].steps", "the step marks add up to 5.5 but the question carries 6")}),
    (changed((*OR, "alternatives", 1, "question_id", ID)), {("sections[1].items[0].alternatives[1]", "link the question on each sub-part, not on the question")}),
    (changed((*OR, "alternatives", 1, "steps", [{"label": "s", "marks": 10}])), {("sections[1].items[0].alternatives[1].steps", "put step marks on its sub-parts")}),
    (changed(("kind", "schema"), ("exam_code", "E1"), ("from_schema", ID)), {("exam_code", "A schema has no exam code"), ("from_schema", "Only a paper is made from a schema"), ("sections[0].items[1].question_id", "A schema leaves its questions unlinked")}),
    (None, set()),
]


def test_faults(spark):
    rows = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(CASES)], "doc int, body string").repartition(2)
    got = {i: set() for i in range(len(CASES))}
    for r in blueprints.check(rows).collect():
        assert (r.path, r.fault) not in got[r.doc]
        got[r.doc].add((r.path, r.fault))
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_texts_are_walked_once(spark):
    docs = spark.createDataFrame([(1, '{"sections":[{"choice":{"rule":"all"},"items":[{"type":"or","alternatives":[{"parts":[{"steps":[1]}]},null]},{"type":"question","steps":[2,3]},5]}]}')], "doc long, body string").select("doc", F.try_parse_json("body").alias("v"))
    units = blueprints.walked(docs)
    assert units._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    at = Counter((r.level, r.path, r.up) for r in units.collect())
    item = "sections[0].items"
    assert at == Counter([("document", "", None), ("section", "sections[0]", ""), ("choice", "sections[0].choice", "sections[0]"), ("or", f"{item}[0]", "sections[0]"), ("question", f"{item}[1]", "sections[0]"), ("question", f"{item}[2]", "sections[0]"), ("alternative", f"{item}[0].alternatives[0]", f"{item}[0]"), ("alternative", f"{item}[0].alternatives[1]", f"{item}[0]"), ("part", f"{item}[0].alternatives[0].parts[0]", f"{item}[0].alternatives[0]"), ("step", f"{item}[0].alternatives[0].parts[0].steps[0]", f"{item}[0].alternatives[0].parts[0]"), ("step", f"{item}[1].steps[0]", f"{item}[1]"), ("step", f"{item}[1].steps[1]", f"{item}[1]")])


def test_papers_are_checked_in_their_rows(spark):
    rows = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(CASES)], "doc int, body string")
    plan = blueprints.check(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert not [x for x in ("Exchange", "Join", "Aggregate", "Window", "parquet") if x in plan]


def test_plain_sections_are_held_to_the_same_rules(spark, monkeypatch):
    """What is read as plain and what is read field by field: the same faults, of plain papers at the limits of the rules."""
    from itertools import product

    unit = [{"type": t, "label": label, "marks": marks} for t, label, marks in [*product(["question"], ["1", " 1 ", " ", "", "x" * 200, "x" * 201, None], [5]), *product(["question"], ["1"], [0, -1, 1, 1000, 1001, None]), *product(["or", "quiz", None], ["1"], [5])]]
    unit += [{"type": "question", "label": "1"}, {"type": "question", "marks": 5}, {"label": "1", "marks": 5}, {}]
    lists = [[x, {"type": "question", "label": "2", "marks": 5}] for x in unit] + [[], [{"type": "question", "label": str(i), "marks": 5} for i in range(100)], [{"type": "question", "label": str(i), "marks": 5} for i in range(101)]]
    good = {"label": "B", "method": "diagram", "items": [{"type": "question", "label": "3", "marks": 5}]}
    papers = [[{"label": "A", "method": "diagram", "items": x}, good] for x in lists] + [[good | x] for x in ({"method": "guess"}, {"label": " "}, {"label": "x" * 201}, {"items": []})] + [[good | {"label": str(i)} for i in range(n)] for n in (20, 21)] + [[good, good]]
    rows = spark.createDataFrame([(i, json.dumps(GOOD | {"total_marks": 10, "sections": x})) for i, x in enumerate(papers)], "doc int, body string")
    plain = Counter(map(tuple, blueprints.check(rows).collect()))
    monkeypatch.setattr(blueprints, "PLAIN", "")
    assert plain == Counter(map(tuple, blueprints.check(rows).collect()))
    assert len({doc for doc, *_ in plain}) > 20
