"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in an answer.
STOP_WORDS = "a an the of to in on for and or is are was were be by with as at from that this it its his her their which who whom".split()
#: Static methods of the Unicode library that Spark ships: normal form KC, and full case folding.
COMPOSE, FOLD = ("com.ibm.icu.text.Normalizer", "compose"), ("com.ibm.icu.lang.UCharacter", "foldCase")


def folded(text: Column) -> Column:
    """NFKC, with plain single quotes and minus signs, case-folded. For ASCII that is lower case."""
    plain = F.translate(F.java_method(*map(F.lit, COMPOSE), text, F.lit(True)), "\u2019\u2018\u2212", "''-")
    return F.when(text.rlike(r"[^\x{0}-\x{7f}]"), F.java_method(*map(F.lit, FOLD), plain, F.lit(True))).otherwise(F.lower(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit("([a-z0-9]+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def list_edits(a: Column, b: Column) -> Column:
    """Edit distance of two lists of words: each distinct word of the two becomes a character of its own."""
    known = F.array_distinct(F.concat(a, b))
    spelled = lambda x: F.array_join(F.transform(x, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")), "")
    return F.levenshtein(spelled(a), spelled(b))


def words(text: Column) -> Column:
    """Letters with inner apostrophes or hyphens, two characters at least."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(\p{L}+(?:['’-]\p{L}+)*)"), F.lit(1)), lambda w: F.length(w) >= 2)


def flat(text: Column) -> Column:
    """White space as single spaces, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def norm_distance(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


def cer(written: Column, truth: Column) -> Column:
    return F.when(F.length(truth) == 0, F.when(F.length(written) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(written, truth) / F.length(truth)))


def allowed_edits(word: Column) -> Column:
    return F.when(word.rlike("[0-9]") | (F.length(word) <= 3), 0).when(F.length(word) <= 6, 1).otherwise(2)


#: How an answer's label and the word for an answer look.
ANSWER_LABEL = r"(?i)^\s*(?:(?:q(?:uestion)?|ans(?:wer)?)\s*(?:no\.?)?\s*[.:-]?\s*)?\(?\d{1,2}\s*(?:\(?[a-h]\)?)?\s*[.):-]\s*(?:ans(?:wer)?\s*[.:-]?\s*)?"
ANSWER_WORD = r"(?i)^\s*ans(?:wer)?\s*[.:-]\s*"


def strip_label(line: Column) -> Column:
    """Without a leading answer label such as `12 b)` or `Ans:`."""
    return F.regexp_replace(F.regexp_replace(line, ANSWER_LABEL, ""), ANSWER_WORD, "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def file_stem(path: Column) -> Column:
    """The last part of a path in NFKC, without its extension."""
    last = F.element_at(F.split(path, r"[/\\]"), -1)
    whole = F.when(last.rlike(r"[^\x{0}-\x{7f}]"), F.java_method(*map(F.lit, COMPOSE), last, F.lit(True))).otherwise(last)
    return F.regexp_replace(F.trim(whole), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower case, with its stop; empty without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, r"[/\\]"), -1), r".(\.[^.]*)$", 1))


def first_line(text: Column, limit: int = 120) -> Column:
    """The first line with text, cut with an ellipsis."""
    line = F.element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


def natural_key(text: Column) -> Column:
    """A key by which digit runs sort as numbers: array of (kind, number, text)."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.when(p.rlike(r"^\d"), p.cast("decimal(38,0)")).alias("number"), p.alias("text")))


def canonical_code(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def share_of_digits(text: Column) -> Column:
    kept = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.when(kept == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^0-9]", "")) / kept)


def hash_split(key: Column, train: int = 80, validate: int = 10) -> Column:
    """train, val or test by the first 32 bits of the key's SHA-256."""
    n = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(n < train, "train").when(n < train + validate, "val").otherwise("test")


def chunks(words_: Column, size: int = 30) -> Column:
    """Pieces of so many words. The words are bound to a variable, else each piece would have them found anew."""

    def cut(w: Column) -> Column:
        n = F.ceil(F.size(w) / size).cast("int")
        return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(w, i * size + 1, F.lit(size))))

    return F.element_at(F.transform(F.array(words_), cut), 1)
