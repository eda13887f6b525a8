"""Labels at the start of a recognised line, as column expressions: a question's number with its part, a part alone, a section, or the start of an answer.

A line is read in several ways, each a struct or null. Readings that a line can have at once are ranked by `first_of`; a line that begins with a question's or an answer's word is read by what stands behind the word only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# How labels look, letters read for digits, circled numbers, section numbers and the words of section headings.
LEAD = r"""^[\s"'`*•·~_,]+"""
PARTS = r"viii|vii|vi|iv|v|i{1,3}|ix|x|[a-h]"
SECTION = r"^(?:sections?|sec|parts?)\s*[-–:.]?\s*([A-E]|I{1,3}|IV|[1-5])\b[\s.:\-–)]*(.*)$"
MISREAD_SECTION = r"^([a-z]{3,9})\s*[-–:.]+\s*([A-E]|I{1,3}|IV)[\s.:)\-–]*$"
NUMBERED = r"^no\.?\s?(\d{1,2})\s*[:.)\-]+\s*(.*)$"
ANSWER_WORD = r"^(ans(?:wer)?s?)\b\.?\s*(?:to\s*)?(?:(?:q(?:uestion|ues|n|s)?\.?\s*)?(?:no|n0)?\.?)?\s*[-–:.#)]*\s*"
QUESTION_WORD = r"^(q(?:uestion|ues|n(?![o0])|s)?)\s*\.?\s*(?:no|n0|num|number)?\s*\.?\s*[-–:.#)]*\s*"
NUMBER_BEHIND = r"^[(\[]?([0-9lI|!oO]{1,2})(?:[.\s]?\(?(viii|vii|vi|iv|v|i{1,3}|ix|x|[a-h])(?:[).:,\]]+|(?=\s|$))|[).:\]\-–]*)(?=[\s\-–:.)]|$)\s*[-–:.)]*\s*(.*)$"
BARE_WITH_PART = r"^[(\[]?([0-9lI|!oO]{1,2})[.\s]?\(?(viii|vii|vi|iv|v|i{1,3}|ix|x|[a-h])(?:[).:,\]]+|(?=\s|$))\s*(.*)$"
BARE_WITH_STOP = r"^[(\[]?([0-9lI|!oO]{1,2})(\s?[).:\]\-–]+|$)\s*(.*)$"
PART_IN_BRACKETS = r"^(?:\((viii|vii|vi|iv|v|i{1,3}|ix|x|[a-h])[).:\]]+|(viii|vii|vi|iv|v|i{1,3}|ix|x|[a-h])[.:\]]*\)[).:\]]*)\s*(.*)$"
LETTERS, DIGITS = "lI|!Oo", "111100"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
SECTION_NUMBERS = {"I": "1", "II": "2", "III": "3", "IV": "4"}
SECTION_WORDS = {"section": 2, "sections": 2, "sec": 1, "part": 1}  # with the edits that a misread one may have

LABEL = "struct<kind: string, number: int, part: string, section: string, strong: boolean, rest: string>"


@dataclass(frozen=True)
class Form:
    """A pattern held against a text."""

    text: Column
    pattern: str
    cased: bool = False

    def _whole(self) -> str:
        return ("(?U)" if self.cased else "(?iU)") + self.pattern

    def fits(self) -> Column:
        return self.text.rlike(self._whole())

    def group(self, k: int) -> Column:
        return F.regexp_extract(self.text, self._whole(), k)


def _label(kind: str, number: Column | None = None, part: Column | None = None, section: Column | None = None, strong: Column | bool = False, rest: Column | None = None) -> Column:
    values = {"kind": F.lit(kind), "number": number, "part": part, "section": section, "strong": strong if isinstance(strong, Column) else F.lit(strong), "rest": F.trim(rest) if rest is not None else F.lit("")}
    return F.struct(*((F.lit(None) if v is None else v).alias(k) for k, v in values.items())).cast(LABEL)


def _number(token: Column) -> Column:
    """The number of digits and letters read for them; null if it is zero, or two letters, which are rather a word."""
    plain = F.translate(token, LETTERS, DIGITS)
    return F.when(plain.rlike("^[0-9]{1,2}$") & (token.rlike("[0-9]") | (F.length(token) == 1)), F.nullif(plain.cast("int"), F.lit(0)))


def _part(group: Column) -> Column:
    return F.nullif(F.lower(group), F.lit(""))


def _section_name(group: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in SECTION_NUMBERS.items() for x in kv))
    return F.coalesce(names[F.upper(group)], F.upper(group))


def _headings(line: Column) -> tuple[Column, Column]:
    """A section heading with three words behind it at most; and one whose word was misread."""
    plain, odd = Form(line, SECTION), Form(line, MISREAD_SECTION)
    behind = F.size(F.filter(F.split(plain.group(2), r"\s+"), lambda w: w != ""))
    close = F.lit(False)
    for word, edits in SECTION_WORDS.items():
        close = close | (F.levenshtein(F.lower(odd.group(1)), F.lit(word)) <= edits)
    return (
        F.when(plain.fits() & (behind <= 3), _label("section", section=_section_name(plain.group(1)), rest=plain.group(2))),
        F.when(odd.fits() & close, _label("section", section=_section_name(odd.group(2)))),
    )


def _behind(word: Form, line: Column, sure: Column) -> Column:
    """What a line is that begins with a question's or an answer's word: a question if a number follows, else an answer where the word is surely a label."""
    tail = F.substring(line, F.length(word.group(0)) + F.lit(1), F.length(line))
    number = Form(tail, NUMBER_BEHIND)
    named = F.when(number.fits() & _number(number.group(1)).isNotNull(), _label("question", _number(number.group(1)), _part(number.group(2)), strong=True, rest=number.group(3)))
    return F.coalesce(named, F.when(sure | (F.lit(False) if word.pattern == QUESTION_WORD else F.trim(tail) == ""), _label("answer", strong=True, rest=tail)))


def _numbers(line: Column) -> tuple[Column, Column]:
    """A number with a part, and a number with a stop or alone; without a digit it needs the stop."""
    both, one = Form(line, BARE_WITH_PART), Form(line, BARE_WITH_STOP)
    digit = lambda form: form.group(1).rlike("[0-9]")
    parted = F.when(both.fits() & digit(both), _label("question", _number(both.group(1)), _part(both.group(2)), strong=True, rest=both.group(3)))
    stopped = F.when(one.fits() & (digit(one) | (one.group(2) != "")), _label("question", _number(one.group(1)), rest=one.group(3)))
    return tuple(F.when(x["number"].isNotNull(), x) for x in (parted, stopped))


def parse_label(text: Column | str) -> Column:
    """The label that a line begins with, or null."""
    raw = F.col(text) if isinstance(text, str) else text
    line = F.regexp_replace(raw, "(?U)" + LEAD + r"|\s+$", "")
    circle = F.instr(F.lit(CIRCLED), F.substring(line, 1, 1))
    circled = F.when((line != "") & (circle > 0), _label("question", circle, strong=True, rest=F.substring(line, F.lit(2), F.length(line))))
    heading, misread = _headings(line)
    numbered = Form(line, NUMBERED)
    number = F.when(numbered.fits(), _label("question", numbered.group(1).cast("int"), strong=True, rest=numbered.group(2)))
    answer, question = Form(line, ANSWER_WORD), Form(line, QUESTION_WORD)
    said_answer = answer.group(0).rlike(r"[.:\-–#)]\s*$") | (F.lower(answer.group(1)) == "ans")
    said_question = question.group(0).rlike(r"(?i)(?:no|n0|[.:\-–#])\s*$")
    part = Form(line, PART_IN_BRACKETS, cased=True)
    alone = F.when(part.fits(), _label("part", part=F.concat(part.group(1), part.group(2)), rest=part.group(3)))
    by_word = F.when(answer.fits(), _behind(answer, line, said_answer)).when(question.fits(), _behind(question, line, said_question))
    by_number = F.coalesce(*_numbers(line), alone)
    return F.coalesce(circled, heading, number, misread, F.when(answer.fits() | question.fits(), by_word).otherwise(by_number))
