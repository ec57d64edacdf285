"""Column expressions over text: counting, readability, keywords, cleaning, keys, and pulling JSON out of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as written in both Java and RE2; \s alone differs for others.
SPACE = r"[ \t\n\r\x0b\x0c]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as none of df's columns (upper case or lower) has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Pieces after . ! or ? and white space."""
    return F.split(text, rf"(?<=[.!?]){SPACE}")


def syllables(text: Column) -> Column:
    """Groups of vowels; a word without one counts as one."""
    return F.size(F.regexp_extract_all(F.lower(text), F.lit("[aeiouy]+"), F.lit(0))) + F.size(F.filter(words(F.lower(text)), lambda w: ~w.rlike("[aeiouy]")))


def reading_ease(text: Column) -> Column:
    """Flesch's formula with heuristic syllables; 0 for texts without words."""
    n, s = word_count(text), F.greatest(F.size(F.regexp_extract_all(text, F.lit("[.!?]+"), F.lit(0))), F.lit(1))
    return F.when(n > 0, 206.835 - 1.015 * (n / s) - 84.6 * (syllables(text) / n)).otherwise(0.0)


def grade_level(text: Column) -> Column:
    n, s = word_count(text), F.greatest(F.size(F.regexp_extract_all(text, F.lit("[.!?]+"), F.lit(0))), F.lit(1))
    return F.when(n > 0, 0.39 * (n / s) + 11.8 * (syllables(text) / n) - 15.59).otherwise(0.0)


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur as substrings of the lower-cased text, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.contains(low, t))


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(low, F.lit(t)).cast("int")
    return total


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """In one pass of a regular expression; false for no terms."""
    import re

    return F.lower(text).rlike("|".join(re.escape(t) for t in terms)) if terms else F.lit(False)


def canonical(text: Column, longest: int = 240) -> Column:
    """Rule text without page markers, boilerplate, one leading prefix and numbering; one line, cut at a space, punctuated."""
    s = F.coalesce(text, F.lit(""))
    for pattern in (r"(?i)-+\s*Page\s*\d+\s*-+", r"(?i)Page\s*\d+(\s*of\s*\d+)?", r"(?i)Please recycle\.|Please recycle[^\n]*"):
        s = F.regexp_replace(s, pattern, "")
    s = F.regexp_replace(s, r"(?i)^\s*(note:|tip:|•|\*|-\s+|o\s+)\s*", "")
    s = collapsed(s)
    s = F.regexp_replace(F.regexp_replace(s, r"^\d+\s*/\s*\d+", ""), r"^\d+\.\s*", "")
    s = strip(s)
    s = F.when(F.length(s) > longest, F.concat(F.regexp_replace(F.substring(s, 1, longest), " [^ ]*$", ""), F.lit("..."))).otherwise(s)
    s = F.when(s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(s)


def norm_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), SPACE, " ")


def squeezed(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores: the fallback key of near-equal rules."""
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "")


def cache_id(path: Column, text: Column) -> Column:
    return F.concat(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("__"), F.substring(F.md5(text.cast("binary")), 1, 16))


def json_part(answer: Column) -> Column:
    """The JSON of a model's answer: a leading code fence off; all of it, or the widest {...}, or the widest [...]."""
    s = strip(answer)
    s = strip(F.regexp_replace(F.regexp_replace(s, r"^```(?i:json)?\s*", ""), r"\s*```$", ""))
    whole = F.when(s.rlike(r"(?s)^(\[.*\]|\{.*\})$"), s)
    part = lambda p: F.nullif(F.regexp_extract(s, p, 0), F.lit(""))
    return F.coalesce(whole, part(r"(?s)\{.*\}"), part(r"(?s)\[.*\]"))


def braces(answer: Column) -> Column:
    """From the first { to the last }, null without."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def safe_object(answer: Column) -> Column:
    """A map of the fields (as JSON or text) of the widest {...} in an answer, names without blanks and quotes around; null if it is no object.

    Of names that become equal that stays which was last by the alphabet.
    """
    value = F.try_parse_json(braces(answer))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(F.regexp_replace(e["key"], "^[ \\t\\n\\r\"']+|[ \\t\\n\\r\"']+$", "").alias("key"), e["value"].cast("string").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def numbers(text: Column) -> Column:
    """All numbers in a text, commas as spaces; a sign sticks to the digits behind it (1-5 gives 1 and -5)."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit(" ")), F.lit(r"-?\d*\.?\d+"), F.lit(0))
    return F.transform(found, lambda x: x.try_cast("double"))


def wait_seconds(message: Column, default: int = 20) -> Column:
    """Seconds of "try again in 17m18s" and five more."""
    part = lambda unit: F.coalesce(F.regexp_extract(message, rf"(?i)try again in (?:\d+h)?{'' if unit == 'm' else r'(?:\d+m)?'}(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    total = part("m") * 60 + part("s")
    return F.when(total > 0, total.cast("int") + 5).otherwise(default)
