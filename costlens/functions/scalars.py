"""Scalar functions of the audit as column expressions; all run inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from costlens.functions.policy import NULL_TOKENS, RESOURCE_LABELS, SPEND_LABELS, UNTAGGABLE

#: White space that is stripped: ASCII's, then Unicode's blanks, line marks and the byte-order mark.
BLANK = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
MONEY = "decimal(38,12)"
HEADER_MARKS = r"[\s\-_./:()]+"
# The prefixes of tag columns, in the order in which they are taken off.
TAG_PREFIXES = (r"resource[\s_]*tags?[\s_]*[/:.]?[\s_]*user[\s_]*[/:._]", r"resource[\s_]*tags?[\s_]*[/:._]", r"user[\s_]*[/:.]", r"tags?[\s_]*[/:.]", r"labels?[\s_]*[/:.]")


def stripped(c: Column) -> Column:
    """c without white space at both ends, Unicode's too; null is ''."""
    return F.trim(F.coalesce(c, F.lit("")), F.lit(BLANK))


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), HEADER_MARKS, "")


def plain_header(text: str) -> str:
    """normalize_header for names that a policy states."""
    return re.sub(HEADER_MARKS, "", text.lower(), flags=re.ASCII)


def strip_tag_prefix(c: Column) -> Column:
    """Provider prefixes of tag columns taken off, one after another."""
    for prefix in TAG_PREFIXES:
        c = F.regexp_replace(c, f"(?i)^{prefix}", "")
    return stripped(c)


def normalize_value(c: Column) -> Column:
    return F.lower(stripped(c))


def is_null_token(c: Column, tokens=NULL_TOKENS) -> Column:
    return normalize_value(c).isin(list(tokens))


def is_placeholder(c: Column, tokens=NULL_TOKENS) -> Column:
    """A null token that is not just empty."""
    return normalize_value(c).isin([t for t in tokens if t])


def normalize_currency(c: Column) -> Column:
    t = F.upper(stripped(c))
    return F.when(~t.isin("", "N/A", "-", "NULL", "NONE"), t)


def is_untaggable_charge(c: Column) -> Column:
    return F.coalesce(normalize_header(c).isin(UNTAGGABLE), F.lit(False))


def let(value: Column, body) -> Column:
    """body(value), value evaluated once: nested regular expressions would else be repeated in each branch."""
    return F.transform(F.array(value), body)[0]


def parse_cost(c: Column) -> Column:
    """Text to money, or null. Parentheses or a leading minus negate; all but digits, points and commas goes; of both marks the last is the decimal mark; commas alone are thousands unless there is one with two digits or fewer after it."""

    def number(d: Column) -> Column:
        eu = F.regexp_replace(F.regexp_replace(d, r"\.", ""), "^([^,]*),", "$1.")
        us = F.regexp_replace(d, ",", "")
        text = F.when(d.contains(".") & d.rlike(r",[^.]*$"), eu).when(~d.contains(".") & d.rlike("^[0-9]*,[0-9]{0,2}$"), F.regexp_replace(d, ",", ".")).otherwise(us)
        return F.when(d.rlike("[0-9]"), text.try_cast(MONEY))

    def signed(t: Column) -> Column:
        paren = t.rlike(r"^\(.*\)$")
        minus = paren | t.startswith("-")
        n = let(F.regexp_replace(t, "[^0-9.,]", ""), number)
        return F.when(minus, -n).otherwise(n)

    # Most cells are plain numbers: one pattern tells, and the rules for all others need not run.
    return F.when(c.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"), c.try_cast(MONEY)).otherwise(let(stripped(c), signed))


def parse_tag_object(c: Column) -> Column:
    """JSON object text, or its pairs without braces, to a map; '', null, arrays and broken text to null."""
    v = stripped(c)
    text = F.when(v.startswith("{"), v).otherwise(F.concat(F.lit("{"), v, F.lit("}")))
    return F.when((v != "") & (F.lower(v) != "null"), F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}))


def tag_from_json(tags: Column, key: str) -> Column:
    return tags[key]


def round2(x: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(x.cast("double") * 100 + 0.5) / 100


def pct(part: Column, whole: Column) -> Column:
    p, w = part.cast("double"), whole.cast("double")
    return F.when(w == 0, F.lit(100.0)).otherwise(F.floor(p / w * 100 * 100 + 0.5) / 100)


def grade(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= 95, "A").when(score >= 85, "B").when(score >= 70, "C").when(score >= 50, "D").otherwise("F")


def grade_label(g: Column, kind: str) -> Column:
    labels = SPEND_LABELS if kind == "spend" else RESOURCE_LABELS
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[g]


def display_id(c: Column) -> Column:
    line = F.regexp_extract(c, r"^row-([0-9]+)$", 1)
    short = F.when(F.length(c) > 64, F.concat(F.left(c, F.lit(26)), F.lit("…"), F.right(c, F.lit(34)))).otherwise(c)
    return F.when(line != "", F.concat(F.lit("(no resource id — line "), line, F.lit(")"))).otherwise(short)


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"[\s\-_./]+"), lambda t: t != "")))


def digit_skeleton(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "#")


def levenshtein(a: Column, b: Column, of_bytes: bool = False) -> Column:
    """Edit distance in characters, or in UTF-8 bytes, as DuckDB counts it; null if a side is null."""
    if of_bytes:  # Latin-1 reads each byte as one character
        a, b = (F.decode(c.cast("string").cast("binary"), "ISO-8859-1") for c in (a, b))
    return F.levenshtein(a, b)
