"""Papers as JSON documents, checked as a whole: every fault of every document with its path, whatever the document is.

Texts are parsed into variants, and a variant is gone through level by level (document, sections, items, alternatives, parts, steps) within its row: a level's list is transformed, each object held against the rules of its level, of which a rule names a field and gives a message or null, and the level above gets its faults and what it adds up. What needs several places (sums of marks, equal marks, labels that are used twice, totals under rules of choice) is computed from those places that have no fault of their own. So a paper's fields are never rows, and nothing is moved, grouped or joined. Text that is no JSON, JSON of another kind, fields unknown or of the wrong type are faults like others.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of each level, the versions and choices, and the limits.
VERSIONS = ("1.0", "1.1", "1.2")
METHODS = ("exact_pattern_match", "omr_bubble_scan", "keyword_formula", "semantic_rubric", "diagram")
MOST_SECTIONS, MOST_ITEMS, MOST_PARTS, MOST_STEPS, MOST_MARKS, MOST_MINUTES, MOST_TEXT, MOST_CODE = 20, 100, 10, 20, 1000, 1440, 200, 50
UUID = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"

PLACE = ["doc", "i", "j", "a", "p"]


def _rule(level: str, key: str, kind: str, missing: str | None = "is required", **more: Any) -> tuple:
    given = {"low": None, "high": None, "among": None, "message": None, "nullable": False, "empty": False} | more
    return (level, key, kind, missing, *given.values())


LIST = "must be a list"
#: The table of rules, a row a field of a level: its kind, what is said if it is missing (null: it may be), limits and values.
RULES = [
    _rule("document", "schema_version", "among", f'must be "{VERSIONS[-1]}" (or "1.1", "1.0")', among=list(VERSIONS), message=f'must be "{VERSIONS[-1]}" (or "1.1", "1.0")'),
    _rule("document", "title", "text", high=MOST_TEXT), _rule("document", "course_code", "text", high=MOST_TEXT), _rule("document", "exam_code", "text", None, high=MOST_CODE, empty=True), _rule("document", "subject_id", "id", message="must be a question id (UUID) or null"),
    _rule("document", "duration_minutes", "whole", None, low=1, high=MOST_MINUTES, nullable=True), _rule("document", "total_marks", "amount"), _rule("document", "negative_marking", "amount", None, among=["0", "0.25", "0.5"], message="must be 0, 0.25 or 0.5 marks per wrong answer", empty=True),
    _rule("document", "mark_step", "amount", None, among=["0.25", "0.5", "1"], message="must be 0.25, 0.5 or 1: the unit marks are rounded to"), _rule("document", "kind", "among", None, among=["schema", "paper"], message='must be "schema" or "paper"'),
    _rule("document", "target_batch", "text", None, high=100, empty=True), _rule("document", "weightage_note", "text", None, high=1000, empty=True), _rule("document", "description", "text", None, high=1000, empty=True), _rule("document", "descriptor", "text", None, high=50, empty=True),
    _rule("document", "from_schema", "id", None, nullable=True, message="must be a schema id (UUID) or null"), _rule("document", "sections", "list", LIST, low=1, high=MOST_SECTIONS, message="sections"),
    _rule("section", "label", "text", high=MOST_TEXT), _rule("section", "title", "text", None, high=MOST_TEXT, empty=True), _rule("section", "method", "among", among=list(METHODS), message=f"must be one of: {', '.join(METHODS)}"), _rule("section", "choice", "any", None), _rule("section", "items", "list", LIST, low=1, high=MOST_ITEMS, message="questions"),
    _rule("choice", "rule", "among", 'must be "all" or "any"', among=["all", "any"], message='must be "all" or "any"'), _rule("choice", "n", "any", None),
    _rule("or", "type", "any", None), _rule("or", "alternatives", "list", LIST, low=2, high=MOST_ITEMS, message="alternatives"), _rule("question", "type", "any", None),
    *(_rule(level, "label", "text", high=MOST_TEXT) for level in ("question", "alternative", "part", "step")), *(_rule(level, "marks", "amount") for level in ("question", "alternative", "part", "step")),
    *(_rule(level, "question_id", "id", None, nullable=True, message="must be a question id (UUID) or null") for level in ("question", "alternative", "part")),
    *(_rule(level, "parts", "list", None, low=1, high=MOST_PARTS, message="sub-parts", empty=True) for level in ("question", "alternative")), *(_rule(level, "steps", "list", None, low=1, high=MOST_STEPS, message="steps", empty=True) for level in ("question", "alternative", "part")),
]
#: The same by level.
OF = {level: [rule[1:] for rule in RULES if rule[0] == level] for level, *_ in RULES}
FAULTS, MARKS = "array<struct<path:string,fault:string>>", "decimal(38,6)"


def nowhere(*places: str) -> list[Column]:
    return [F.lit(None).cast("int").alias(c) for c in places]


def number_text(x: Column) -> Column:
    """A number without needless zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def grown(rows: DataFrame, owners: Column, level: str, key: str, low: int, high: int, index: str | None, *more: str) -> DataFrame:
    """rows, and behind each owner the elements of its list that has as many as allowed, with `index` set, and the fields `more`. Rows are level, PLACE, up, path, v: nothing is read again to go a level down."""
    rows = rows.withColumn("e", F.when(owners, F.try_variant_get("v", f"$.{key}", "array<variant>")))
    unit = lambda level, place, up, path, v: F.struct(level.alias("level"), *(x.alias(c) for c, x in zip(PLACE[1:], place, strict=True)), up.alias("up"), path.alias("path"), v.alias("v"))
    place = [F.col(c) for c in PLACE[1:]]
    prefix = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
    child = lambda x, n: unit(F.lit(level), [n if c == index else F.col(c) for c in PLACE[1:]], F.col("path"), F.concat(prefix, F.lit(f"{key}["), n.cast("string"), F.lit("]")), x)
    own = F.array(unit(F.col("level"), place, F.col("up"), F.col("path"), F.col("v")))
    for name in more:
        v = F.when(owners, F.try_variant_get("v", f"$.{name}", "variant"))
        own = F.when(v.isNull(), own).otherwise(F.concat(own, F.array(unit(F.lit(name), place, F.col("path"), F.concat(prefix, F.lit(name)), v))))
    below = F.transform(F.when(F.size("e").between(low, high), F.col("e")), child)
    return rows.select("doc", F.explode(F.coalesce(F.concat(own, below), own)).alias("u")).select("u.level", "doc", *(f"u.{c}" for c in PLACE[1:]), "u.up", "u.path", "u.v")


def walked(docs: DataFrame) -> DataFrame:
    """Everything of docs(doc, v) that should be an object, as rows, level by level: level, PLACE, up, path, v."""
    rows = docs.select(F.lit("document").alias("level"), "doc", *nowhere(*PLACE[1:]), F.lit(None).cast("string").alias("up"), F.lit("").alias("path"), "v")
    at = F.col("level")
    rows = grown(rows, at == "document", "section", "sections", 1, MOST_SECTIONS, "i")
    rows = grown(rows, at == "section", "item", "items", 1, MOST_ITEMS, "j", "choice")
    type_ = F.try_variant_get("v", "$.type", "string")
    kind = F.when(type_ == "or", "or").when((type_ == "question") | F.try_variant_get("v", "$", "map<string,variant>").isNull(), "question").otherwise("untyped")
    rows = rows.withColumn("level", F.when(at == "item", kind).otherwise(at))
    rows = grown(rows, at == "or", "alternative", "alternatives", 2, MOST_ITEMS, "a")
    rows = grown(rows, at.isin("question", "alternative"), "part", "parts", 1, MOST_PARTS, "p")
    return grown(rows, at.isin("question", "alternative", "part"), "step", "steps", 1, MOST_STEPS, None)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def at(path: Column | None, key: Column | str) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return key if path is None else F.concat(path, F.lit("."), key)


# Lists of faults and of links are null where there are none, as nearly everywhere. What holds other levels is named once, by let(): a column that is written twice is worked out twice, and so is all below it.


def joined(*lists: Column) -> Column:
    """Lists as one, null if all are."""
    names = [f"of{i}" for i in range(len(lists))]
    kind = F.array().cast(FAULTS)
    return let(F.struct(*(x.alias(name) for x, name in zip(lists, names, strict=True))), lambda x: F.when(F.coalesce(*(x[name] for name in names)).isNotNull(), F.concat(*(F.coalesce(x[name], kind) for name in names))))


def from_below(units: Column, name: str = "faults") -> Column:
    return F.when(F.exists(units, lambda u: u[name].isNotNull()), F.flatten(F.array_compact(F.transform(units, lambda u: u[name]))))


def fault(path: Column, said: Column) -> Column:
    """A fault, or null if nothing is said. The path is made for a fault only."""
    return F.when(said.isNotNull(), F.struct(path.alias("path"), said.alias("fault")))


def some_of(*faults: tuple[Column, Column]) -> Column:
    """Faults of paths and messages that may be null."""
    return F.when(F.coalesce(*(said for _, said in faults)).isNotNull(), F.array_compact(F.array(*(fault(path, said) for path, said in faults))))


def fields(level: str, o: Column, of: str = "array<map<string,variant>>") -> Column:
    """What the rules of a level ask of an object's fields. Of a list whether it is given, and its objects, null for what is none; of others the type, null if the field is missing, and the value as a text or an amount, as if it were one."""

    def read(key: str, wants: str) -> Column:
        if wants == "list":
            return F.struct(o[key].isNotNull().alias("s"), F.try_variant_get(o[key], "$", of).alias("x"))
        value = F.try_variant_get(o[key], "$", MARKS) if wants in ("amount", "whole", "any") else F.trim(F.try_variant_get(o[key], "$", "string"))
        return F.struct(F.schema_of_variant(o[key]).alias("s"), value.alias("x"))

    return F.struct(*(read(key, wants).alias(key) for key, wants, *_ in OF[level] if wants != "any" or key == "n"))


def text(f: Column) -> Column:
    return F.when(f["s"] == "STRING", f["x"])


def amount(f: Column) -> Column:
    return F.when(~f["s"].isin("STRING", "BOOLEAN", "VOID"), f["x"])


def message(rule: tuple, f: Column) -> Column:
    """What is wrong with a field by its rule, or null."""
    _, wants, missing, low, high, among, said, nullable, empty = rule
    missing, x = F.lit(missing).cast("string"), f["x"]
    if wants == "list":
        wrong = F.when(x.isNull(), F.when(f["s"], LIST).otherwise(missing))
        wrong = wrong.when(F.size(x) == 0, None) if empty else wrong
        return wrong.when(F.size(x) < low, f"needs at least {low} {said}").when(F.size(x) > high, f"allows at most {high} {said}")
    wrong = F.when(f["s"].isNull(), missing)
    if nullable:
        wrong = wrong.when(f["s"] == "VOID", None)
    if wants == "text":
        wrong = wrong.when(f["s"] != "STRING", "must be text")
        wrong = wrong if empty else wrong.when(x == "", "must not be empty")
        return wrong.when(F.length(x) > high, f"is longer than {high} characters")
    if wants == "amount":
        wrong = wrong.when(x.isNull() | f["s"].isin("STRING", "BOOLEAN"), "must be a number")
        wrong = wrong.when(x < 0, "must not be negative") if empty else wrong.when(x <= 0, "must be greater than 0")
        wrong = wrong.when(x > MOST_MARKS, f"must not exceed {MOST_MARKS}").when(x != x.cast("decimal(38,2)").cast(MARKS), "uses at most 2 decimal places")
        return wrong if among is None else wrong.when(~number_text(x).isin(among), said)
    if wants == "whole":
        return wrong.when(f["s"] != "BIGINT", "must be a whole number").when(~x.between(low, high), f"must be between {low} and {high}")
    if wants == "among":
        return wrong.when((f["s"] != "STRING") | ~x.isin(among), said)
    return wrong.when(f["s"] != "STRING", said).when(~x.rlike(UUID), "is not a valid id (UUID)")


def own_faults(level: str, o: Column, r: Column, path: Column | None, known: Callable[[Column], Column] | None = None) -> Column:
    """Faults of an object's fields, r being what is read of them, or that it is no object; known: which fields may be there, if not those of the rules."""
    names = [key for key, *_ in OF[level]]
    strange = lambda key: ~known(key) if known else ~key.isin(names)
    said = [(at(path, rule[0]), message(rule, r[rule[0]])) for rule in OF[level] if rule[1] != "any"]
    unknown = F.transform(F.filter(F.map_keys(o), strange), lambda key: F.struct(at(path, key).alias("path"), F.lit("unknown field").alias("fault")))
    none = F.array(F.struct((F.lit("(document)") if path is None else path).alias("path"), F.lit("must be an object").alias("fault")))
    return F.when(o.isNull(), none).when(F.coalesce(*(x for _, x in said)).isNotNull() | F.exists(F.map_keys(o), strange), F.concat(F.array_compact(F.array(*(fault(*x) for x in said))), unknown))


def below(objects: Column, low: int, high: int, path: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each object of a list, and of its path; null for what is no list or has not as many as allowed."""
    return F.transform(F.when(F.size(objects).between(low, high), objects), lambda o, n: f(o, F.concat(path, F.lit("["), n.cast("string"), F.lit("]"))))


def summed(name: str, units: Column, own: Column, path: Column) -> Column:
    """Faults of a list whose elements have none: labels that repeat, and marks that don't add up to their owner's."""
    labels, total = F.transform(units, lambda u: u["label"]), F.aggregate(units, F.lit(0).cast(MARKS), lambda t, u: (t + u["marks"]).cast(MARKS))
    differ = F.when(F.size(F.array_distinct(labels)) < F.size(labels), f"{name} labels must be different")
    add_up = F.when((own > 0) & (total != own), F.concat(F.lit(f"the {name} marks add up to "), number_text(total), F.lit(" but the question carries "), number_text(own)))
    return F.when(~F.exists(units, lambda u: u["hurt"]), some_of((path, differ), (path, add_up)))


def step(o: Column, path: Column) -> Column:
    """label, marks, faults; hurt: there are some; given: an object with fields."""
    told = lambda r, faults: F.struct(text(r["label"]).alias("label"), amount(r["marks"]).alias("marks"), faults.isNotNull().alias("hurt"), (F.size(o) > 0).alias("given"), faults.alias("faults"))
    return let(fields("step", o), lambda r: let(own_faults("step", o, r, path), lambda faults: told(r, faults)))


def stepped(r: Column, path: Column) -> Column:
    return below(r["steps"]["x"], 1, MOST_STEPS, at(path, "steps"), step)


def link(r: Column, path: Column) -> Column:
    return F.when(r["question_id"]["s"] != "VOID", F.array(fault(at(path, "question_id"), F.lit("A schema leaves its questions unlinked"))))


def part(o: Column, path: Column) -> Column:
    """As a step; hurt: it or a step has a fault other than of sums. links: what would be wrong with its question in a schema."""

    def told(r: Column, steps: Column, first: Column) -> Column:
        faults = joined(first, summed("step", steps, amount(r["marks"]), at(path, "steps")))
        return F.struct(text(r["label"]).alias("label"), amount(r["marks"]).alias("marks"), first.isNotNull().alias("hurt"), (F.size(o) > 0).alias("given"), faults.alias("faults"), link(r, path).alias("links"))

    return let(fields("part", o), lambda r: let(stepped(r, path), lambda steps: let(joined(own_faults("part", o, r, path), from_below(steps)), lambda first: told(r, steps, first))))


def slot(o: Column, path: Column, choice: Column) -> Column:
    """A question, or an alternative where there is a choice: label, marks, faults, links."""

    def told(r: Column, lists: Column) -> Column:
        steps, parts, marks = lists["steps"], lists["parts"], amount(r["marks"])
        own = own_faults("question", o, r, path, lambda key: key.isin([key for key, *_ in OF["question"] if key != "type"]) | (~choice & (key == "type")))
        linked = F.when(r["question_id"]["s"] != "VOID", "link the question on each sub-part, not on the question")
        mixed = F.when(F.exists(parts, lambda p: p["given"]), some_of((path, linked), (at(path, "steps"), F.when(F.exists(steps, lambda s: s["given"]), "put step marks on its sub-parts"))))
        divided = F.when(steps.isNotNull() | parts.isNotNull(), joined(from_below(steps), from_below(parts), summed("step", steps, marks, at(path, "steps")), summed("sub-part", parts, marks, at(path, "parts")), mixed))
        return F.struct(text(r["label"]).alias("label"), marks.alias("marks"), own.alias("own"), divided.alias("divided"), link(r, path).alias("link"), from_below(parts, "links").alias("links"))

    return let(fields("question", o), lambda r: let(F.struct(stepped(r, path).alias("steps"), below(r["parts"]["x"], 1, MOST_PARTS, at(path, "parts"), part).alias("parts")), lambda lists: told(r, lists)))


def item(o: Column, path: Column) -> Column:
    """A question, or alternatives to choose one of: faults, links, labels, and the marks that it is worth. What is no object counts as a question."""

    def told(slots: Column, faults: Column) -> Column:
        marks = F.transform(slots, lambda s: s["marks"])
        unequal = F.when(faults.isNull() & (F.size(slots) > 1), F.when(F.size(F.array_distinct(marks)) > 1, F.array(fault(path, F.lit("alternatives must carry equal marks")))))
        return F.struct(F.coalesce(faults, unequal).alias("faults"), F.array_max(marks).alias("worth"), F.transform(slots, lambda s: s["label"]).alias("labels"), joined(from_below(slots, "link"), from_below(slots, "links")).alias("links"))

    def of(k: Column) -> Column:
        choice, listed = F.coalesce(k["kind"] == "or", F.lit(False)), k["r"]["alternatives"]["x"]
        owned = F.when(choice, F.when(F.size(listed).between(2, MOST_ITEMS), listed)).when(o.isNull() | (k["kind"] == "question"), F.array(o))
        slots = F.transform(owned, lambda s, n: slot(s, F.when(choice, F.concat(path, F.lit(".alternatives["), n.cast("string"), F.lit("]"))).otherwise(path), choice))
        untyped = F.when(o.isNotNull() & ~F.coalesce(k["kind"].isin("or", "question"), F.lit(False)), F.array(fault(at(path, "type"), F.lit('must be "question" or "or"'))))
        own = F.when(choice, own_faults("or", o, k["r"], path)).otherwise(untyped)
        return let(slots, lambda slots: let(joined(own, from_below(slots, "own"), from_below(slots, "divided")), lambda faults: told(slots, faults)))

    kind = F.try_variant_get(o["type"], "$", "string")
    return let(F.struct(kind.alias("kind"), F.when(kind == "or", fields("or", o)).alias("r")), of)


#: How the types of all sections read, taken together, that have label, method and items alone, their items type, label and whole marks alone; a field may be missing from some.
PLAIN = "ARRAY<OBJECT<items: ARRAY<OBJECT<label: STRING, marks: BIGINT, type: STRING>>, label: STRING, method: STRING>>"
PLAIN_TYPE = "array<struct<label:string,method:string,items:array<struct<type:string,label:string,marks:bigint>>>>"


def plain_section(x: Column) -> Column:
    """What section() gives for one that was read as plain, null if anything may be wrong with it. Most sections are plain and right: they need no look at each field's type."""
    named = lambda u: (F.length(u["label"]) <= MOST_TEXT) & (F.trim(u["label"]) != "")
    question = lambda u: (u["type"] == "question") & named(u) & u["marks"].between(1, MOST_MARKS)
    right = named(x) & x["method"].isin(*METHODS) & F.size(x["items"]).between(1, MOST_ITEMS) & F.forall(x["items"], question)
    worth, none = F.aggregate(x["items"], F.lit(0).cast("bigint"), lambda t, u: t + u["marks"]), F.lit(None).cast(FAULTS)
    return F.when(right, F.struct(F.trim(x["label"]).alias("label"), none.alias("faults"), worth.cast(MARKS).alias("worth"), F.transform(x["items"], lambda u: F.trim(u["label"])).alias("labels"), none.alias("links")))


def section(o: Column, path: Column) -> Column:
    """label, faults, links; of one without faults the labels of its questions, and the marks that its items, or the best as many as are asked for, are worth."""

    def chosen(c: Column, r: Column, count: Column) -> Column:
        """Faults of the rule of choice, and how many items are asked for."""
        rule, n, where = text(r["rule"]), amount(r["n"]), at(path, "choice")
        whole = F.when(F.coalesce(r["n"]["s"] != "BIGINT", F.lit(True)), "must be a whole number").when(~n.between(1, MOST_ITEMS), f"must be between 1 and {MOST_ITEMS}").when(n > count, F.concat(F.lit("answering any "), number_text(n), F.lit(" of "), count.cast("string"), F.lit(" is impossible")))
        many = F.when((rule == "all") & r["n"]["s"].isNotNull(), 'only goes with rule "any"').when(rule == "any", whole)
        return F.struct(joined(own_faults("choice", c, r, where), some_of((at(where, "n"), many))).alias("faults"), F.when(rule == "any", n).alias("n"))

    def told(r: Column, lists: Column, faults: Column) -> Column:
        items, n = lists["items"], lists["choice"]["n"]
        worth = F.transform(items, lambda x: x["worth"])
        best = F.when(n.isNull(), worth).otherwise(F.slice(F.sort_array(worth, asc=False), 1, n.cast("int")))
        total = F.aggregate(best, F.lit(0).cast(MARKS), lambda t, x: (t + x).cast(MARKS))
        return F.struct(text(r["label"]).alias("label"), faults.alias("faults"), F.when(faults.isNull(), total).alias("worth"), F.when(faults.isNull(), F.flatten(F.transform(items, lambda x: x["labels"]))).alias("labels"), from_below(items, "links").alias("links"))

    def of(r: Column) -> Column:
        count = F.when(F.size(r["items"]["x"]).between(1, MOST_ITEMS), F.size(r["items"]["x"]))
        choice = F.when(o["choice"].isNotNull(), let(F.try_variant_get(o["choice"], "$", "map<string,variant>"), lambda c: let(fields("choice", c), lambda q: chosen(c, q, count))))
        lists = F.struct(below(r["items"]["x"], 1, MOST_ITEMS, at(path, "items"), item).alias("items"), choice.alias("choice"))
        return let(lists, lambda lists: let(joined(own_faults("section", o, r, path), lists["choice"]["faults"], from_below(lists["items"])), lambda faults: told(r, lists, faults)))

    return let(fields("section", o), of)


def totals(given: Column, sections: Column) -> Column:
    """Faults of a paper whose sections have none: a total that is not theirs, and labels that repeat; given: what is read of the total."""
    says = message(next(rule for rule in OF["document"] if rule[0] == "total_marks"), given)
    total, computed = amount(given), F.aggregate(sections, F.lit(0).cast(MARKS), lambda t, s: (t + s["worth"]).cast(MARKS))
    differ = F.when((total != computed) & says.isNull(), F.concat(F.lit("The exam total is "), number_text(total), F.lit(" but the sections add up to "), number_text(computed)))
    labels, numbers = F.transform(sections, lambda s: s["label"]), F.flatten(F.transform(sections, lambda s: s["labels"]))
    same = F.when(F.size(F.array_distinct(labels)) < F.size(labels), "Section labels must be different")
    again = lambda x: F.array_distinct(F.filter(x, lambda label, n: (n > 0) & (label == F.get(x, n - 1))))
    twice = F.transform(let(F.sort_array(numbers), again), lambda label: fault(F.lit("sections"), F.concat(F.lit("Question number "), label, F.lit(" is used twice"))))
    return F.when(differ.isNotNull() | same.isNotNull() | (F.size(F.array_distinct(numbers)) < F.size(numbers)), F.concat(F.array_compact(F.array(fault(F.lit("total_marks"), differ), fault(F.lit("sections"), same))), twice))


def check(documents: DataFrame) -> DataFrame:
    """doc, path, fault of documents(doc, body), body being text: a row a fault; none for a document without faults, or null. A paper is parsed and checked within its row, in steps that each read what the one before has made, and no more."""
    c = F.col
    docs = documents.select("doc", c("body").isNotNull().alias("given"), F.try_parse_json("body").alias("v"))  # a filter would make the texts once more
    docs = docs.select("doc", F.when(c("given"), c("v").isNull()).alias("broken"), F.try_variant_get("v", "$", "map<string,variant>").alias("o"))
    given = c("o")["sections"]
    plain = F.transform(F.when(F.schema_of_variant(given) == PLAIN, F.try_variant_get(given, "$", PLAIN_TYPE)), plain_section)
    docs = docs.select("doc", "broken", "o", fields("document", c("o"), "array<boolean>").alias("r"), plain.alias("plain"))
    some = lambda o, n: F.when(F.get(c("plain"), n).isNotNull(), F.get(c("plain"), n))
    listed = F.try_variant_get(given, "$", "array<map<string,variant>>")
    each = F.transform(F.when(F.size("r.sections.x").between(1, MOST_SECTIONS), listed), lambda o, n: some(o, n).otherwise(section(o, F.concat(F.lit("sections["), n.cast("string"), F.lit("]")))))
    r, sections = c("r"), F.when(F.size("plain").between(1, MOST_SECTIONS) & F.forall("plain", lambda x: x.isNotNull()), c("plain")).otherwise(each)
    made = F.when(text(r["from_schema"]).rlike(UUID), "Only a paper is made from a schema")
    template = some_of((F.lit("exam_code"), F.when(text(r["exam_code"]) != "", "A schema has no exam code")), (F.lit("from_schema"), made))
    own = F.when(~c("broken"), own_faults("document", c("o"), r, None))
    docs = docs.select("doc", "broken", "r.total_marks", (text(r["kind"]) == "schema").alias("schema"), own.alias("own"), template.alias("template"), sections.alias("sections"))
    sections = c("sections")
    sound = ~F.exists(sections, lambda s: s["faults"].isNotNull())
    kinds = {"own": c("own"), "below": from_below(sections), "totals": F.when(sound, totals(c("total_marks"), sections)), "template": F.when(c("schema"), c("template")), "links": F.when(c("schema"), from_below(sections, "links"))}
    docs = docs.select("doc", "broken", *(x.alias(kind) for kind, x in kinds.items()))
    found = F.when(F.coalesce(*kinds).isNotNull(), F.concat(*(F.coalesce(c(kind), F.array().cast(FAULTS)) for kind in kinds)))
    found = F.when(c("broken"), F.array(F.struct(F.lit("(document)").alias("path"), F.lit("is not JSON").alias("fault")))).otherwise(found)
    # outer, as the filter that Spark derives from the inner one would work out all of it again
    return docs.select("doc", F.explode_outer(found).alias("f")).where("f IS NOT NULL").select("doc", "f.path", "f.fault")
