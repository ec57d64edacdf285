"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

All in DataFrame expressions. A proposal's place comes from the lengths of what lies between matches (split by the
same pattern). Kinds, in the order of the result: email, ip, card, phone (the base, which always stays), then what
the method adds: iban (mod-97) and shortcard (12 to 15 digits, Luhn, and a context word such as "card" nearby).
A span is reported if base or if its score reaches THRESHOLD.

Patterns are written so that no start is tried twice: possessive quantifiers and look-behinds bound the work by the
text's length; each finds the leftmost non-overlapping matches of the plain pattern given beside it.

Null text: no spans. Places count code points, end exclusive. Spans of different kinds may overlap. A row per input
row, repeated rows too; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dolomite.llm.common import fresh

THRESHOLD = 0.6
BEFORE, AFTER, SHORTEST = 48, 24, 4  # characters of context, and of the shortest match there can be

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "shortcard")

#: kind: (pattern, score without context, what nearby words add, the words, cheap test that a text may have any)
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, 0.05, "e-?mail|contact|write to|@", r"@[A-Za-z0-9-]+\."),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, 0.3, "ip|host|server|addr|address|ping|login", r"\.[0-9]+\.[0-9]+\.[0-9]"),
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits: a maximal run has no digit, nor a digit and one separator, beside it
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])", 0.8, 0.2, "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta", r"[0-9](?:[ -]?[0-9]){15}"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 0.6, 0.3, "tel|phone|mobile|call|fax|whatsapp|telefon", r"\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.7, 0.25, "iban|account|bank|konto|compte|cuenta|transfer", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "shortcard": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,14}+(?![ -]?[0-9])", 0.4, 0.4, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", r"[0-9](?:[ -]?[0-9]){11}"),
}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits, every second from the right doubled, sum to a multiple of ten."""
    value = lambda c: F.ascii(c) - 48
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, twice(value(c))).otherwise(value(c)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number, its first four characters last and letters as 10 to 35, leaves 1 of 97."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    ) == 1


def with_bound(value: Column, body) -> Column:
    """body(value), value being computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(n: Column, first: Column, step) -> Column:
    """(last, out) of a fold over 0 .. n - 1 by step(state, i), the state having a list `out` that step appends to.

    By blocks of about the root of n, each with a list of its own, so that a step copies a block's list at most (whole numbers only).
    """
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    last = lambda a: F.element_at(a, -1)

    def block(a: Column, i: Column) -> Column:
        fresh_list = F.filter(last(a)["out"], lambda _: F.lit(False))
        return F.concat(a, F.array(F.aggregate(F.sequence(i, F.least(i + width, n) - 1), last(a).withField("out", fresh_list), step)))

    blocks = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, width)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.array(first), block, lambda a: F.struct(last(a).alias("last"), F.flatten(F.transform(a, lambda x: x["out"])).alias("out")))


def shortened(iban: Column) -> Column:
    """The longest part of a match, from its begin to a space or its end, that is an account number; null if none is.

    The pattern takes along groups of capitals or digits that stand behind the number.
    """
    valid = lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & mod97(x)
    parts = lambda w: F.filter(F.transform(F.sequence(F.size(w), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(w, F.lit(1), k), " ")), valid)
    return F.get(with_bound(F.split(iban, " "), parts), F.lit(0))


def confirmed(kind: str, match: Column) -> Column:
    """The match, or what of it counts; null where it fails."""
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        value = lambda p: F.concat(F.lit("0"), F.substring(plain(p), 1, 3)).cast("int")
        return F.when(F.forall(F.split(match, r"\."), lambda p: (F.length(plain(p)) <= 3) & (value(p) <= 255)), match)
    if kind in ("card", "shortcard"):
        return F.when(luhn(digits(match)), match)
    if kind == "phone":
        return F.when(F.length(digits(match)).between(8, 15), match)
    return shortened(match) if kind == "iban" else match


def starts(matches: Column, gaps: Column) -> Column:
    """Where each match begins, from the lengths of what lies before it."""

    def step(a: Column, i: Column) -> Column:
        at = a["at"] + F.length(F.get(gaps, i))
        return F.struct((at + F.length(F.get(matches, i))).alias("at"), F.concat(a["out"], F.array(at)).alias("out"))

    return folded(F.size(matches), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]


def found(kind: str, text: Column) -> Column:
    """The kind's confirmed spans: array of (kind, start, end, score). Work grows with the text and the root of its matches."""
    pattern, score, more, words, maybe = KINDS[kind]
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def scored(x: Column) -> Column:
        matches, gaps = x["m"], x["gap"]
        head, tail = lambda c: F.substring(c, 1, AFTER), lambda c: F.substring(c, -BEFORE, BEFORE)

        # A match has SHORTEST characters or more, so so many pieces on each side hold the characters asked for.
        def around(s: Column) -> tuple[Column, Column]:
            i = s["i"]
            before = [tail(F.get(c, F.when(i >= k, i - k))) for k in range(BEFORE // SHORTEST, 0, -1) for c in (gaps, matches)]
            after = [head(F.get(c, i + k)) for k in range(1, 1 + AFTER // SHORTEST) for c in (gaps, matches)]
            return tail(F.concat_ws("", *before, tail(F.get(gaps, i)))), head(F.concat_ws("", head(F.substr(F.get(matches, i), F.length(s["m"]) + 1)), *after, head(F.get(gaps, i + 1 + AFTER // SHORTEST))))

        def one(s: Column) -> Column:
            before, after = around(s)
            points = F.lit(score) + F.when(F.lower(F.concat(before, F.lit(" "), after)).rlike(rf"(?<![a-z])(?:{words})(?![a-z])"), more).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), points.alias("score"))

        each = F.transform(starts(matches, gaps), lambda at, i: F.struct(at.alias("start"), confirmed(kind, F.get(matches, i)).alias("m"), i.alias("i")))
        return F.transform(F.filter(each, lambda s: s["m"].isNotNull()), one)

    spans = with_bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")), scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(maybe), spans).otherwise(none)


def spans(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column out: array of (kind, start, end, score), by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.concat(*[found(k, text) for k in (*BASE, *ADDED)]))


def joined(found_spans: Column) -> Column:
    return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, and the largest score of any span."""
    rows = spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in brackets; overlapping spans are replaced as one.

    The text is cut as four bytes a character, so that a cut's place costs nothing.
    """
    (own,) = fresh(docs, "pii")
    text, wide = F.col(text_col), F.encode(F.make_valid_utf8(text_col), "UTF-32")
    ordered = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def replaced(x: Column) -> Column:
        cut = lambda a, b: F.decode(F.substr(x["wide"], 4 * a + 1, 4 * (b - a)), "UTF-32")

        def step(a: Column, i: Column) -> Column:
            end = F.get(x["spans"], i)["end"]
            return F.when(end <= a["at"], a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(a["at"], i)).alias("out")))

        def piece(lo: Column, i: Column) -> Column:
            s = F.get(x["spans"], i)
            return F.concat(cut(lo, F.greatest(s["start"], lo)), F.when(s["start"] >= lo, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))

        # The list holds pairs: where the text before a span begins, and the span's place.
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        each = lambda f: F.transform(F.sequence(F.lit(0), F.size(f["out"]) - 1, F.lit(2)), lambda k: piece(F.get(f["out"], k), F.get(f["out"], k + 1)))
        whole = lambda f: F.concat(F.array_join(each(f), ""), cut(f["last"]["at"], (F.octet_length(x["wide"]) / 4).cast("int")))
        return with_bound(folded(F.size(x["spans"]), first, step), whole)

    rows = spans(docs, text_col, own)
    new = with_bound(F.struct(ordered.alias("spans"), wide.alias("wide")), replaced)
    return rows.withColumn(text_col, F.when(F.size(own) > 0, new).otherwise(text)).drop(own)
