"""String functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII punctuation signs, and the articles of each language, that answer normalisation removes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = {
    "en": ["a", "an", "the"],
    "es": ["un", "una", "unos", "unas", "el", "la", "los", "las"],
    "de": ["ein", "eine", "einen", "einem", "eines", "einer", "der", "die", "das", "den", "dem", "des"],
    "fr": [],
}


def words(c: Column) -> Column:
    """Lower-case ASCII words, as the sparse index sees a text."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def space_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def normalize_answer(c: Column, articles: list[str] | None = None) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    drop = ARTICLES["en"] if articles is None else articles
    tokens = space_tokens(F.translate(F.lower(c), PUNCTUATION, ""))
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*drop)) if drop else tokens, " ")


def normalize_answer_lang(c: Column, lang: Column) -> Column:
    """Normalisation with the language's articles and Unicode punctuation; Chinese signs stand alone."""
    bare = F.regexp_replace(F.lower(c), r"[\p{P}$+<=>^`|~]", "")
    spaced = F.when(lang == "zh", F.regexp_replace(bare, r"([\x{4e00}-\x{9fa5}])", " $1 ")).otherwise(bare)
    tokens = space_tokens(spaced)
    out = F.array_join(tokens, " ")
    for code, drop in ARTICLES.items():
        if drop:
            out = F.when(lang == code, F.array_join(_without(tokens, drop), " ")).otherwise(out)
    return out


def _without(tokens: Column, drop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*drop))


def count_in(tokens: Column, token: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x == token))


def token_overlap(pred: Column, gold: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(F.array_distinct(pred), F.lit(0), lambda acc, t: acc + F.least(count_in(pred, t), count_in(gold, t)))


def token_f1(pred: Column, gold: Column, empty: float = 0.0) -> Column:
    """Token F1 of two normalised strings; `empty` when both have no token."""
    p, g = F.filter(F.split(pred, " "), lambda t: t != ""), F.filter(F.split(gold, " "), lambda t: t != "")
    both = token_overlap(p, g).cast("double")
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(empty)).otherwise(F.coalesce(F.try_divide(2 * both, (F.size(p) + F.size(g)).cast("double")), F.lit(0.0)))


def has_answer(text: Column, answer: Column) -> Column:
    """Whether the answer's words stand in the text one after another; an answer without words is everywhere."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    bare = F.array_join(words(answer), " ")
    return F.when(bare == "", True).otherwise(F.contains(pad(text), F.concat(F.lit(" "), bare, F.lit(" "))))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two UTF-8 byte offsets; cut characters become replacement signs."""
    return F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int")).cast("string")


def byte_to_char(text: Column, at: Column) -> Column:
    """Character offset of a byte offset; -1 stays -1."""
    return F.when(at < 0, at).otherwise(F.length(F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int")).cast("string")).cast("bigint"))


def to_number(c: Column) -> Column:
    """A cell as a number: thousands commas, decimal comma, repeated dots; NULL where there is none."""
    s = F.trim(c)
    plain = s.try_cast("double")
    thousands = F.when(s.rlike(r"^[-+]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
    decimal = F.when(s.rlike(r"^[-+]?\d+,\d+$"), F.replace(s, F.lit(","), F.lit(".")).try_cast("double"))
    dots = F.when(s.rlike(r"^[-+]?\d+(\.\d+){2,}$"), F.replace(s, F.lit("."), F.lit("")).try_cast("double"))
    finite = F.when(plain.isNotNull() & s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), plain)
    return F.coalesce(finite, thousands, decimal, dots)


def linearize(headers: Column, values: Column) -> Column:
    """"h is v . " for every cell of a row."""
    return F.concat_ws("", F.transform(F.arrays_zip(headers.alias("h"), values.alias("v")), lambda x: F.concat(x["h"], F.lit(" is "), x["v"], F.lit(" . "))))


def cell_kind(c: Column) -> Column:
    """What a table cell holds: empty, bool, score, date, unit, number or word."""
    s = F.lower(F.trim(c))
    month = "(january|february|march|april|may|june|july|august|september|october|november|december)"
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "empty")
        .when(s.isin("yes", "no", "true", "false"), "bool")
        .when(s.rlike(r"^\d+\s*[-:]\s*\d+$"), "score")
        .when(s.rlike(rf"^(\d{{1,2}} {month}( \d{{4}})?|{month} \d{{1,2}}(, \d{{4}})?|\d{{4}}-\d{{2}}-\d{{2}}.*)$"), "date")
        .when(s.rlike(r"^[-+]?[\d,.]*\d\s?(km|m|kg|mi|ft|cm|mm|%)$"), "unit")
        .when(to_number(s).isNotNull(), "number")
        .otherwise("word")
    )
