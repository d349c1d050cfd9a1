"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their scores. All in the JVM.

Each text is split at a kind's matches once; running totals of the pieces' lengths give the matches' places, and the piece on
either side of a match is its context. So the work is linear in the text, but for a logarithm of the number of its matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, spans_replaced, text_or_empty

# Every pattern takes the longest run from the leftmost start. The possessive quantifiers only keep the matcher from trying
# shorter runs that cannot match either; \G lets a match start in the middle of a run where the match before it ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Code points before and after a span in which words count as its context.
BEFORE, AFTER = 48, 24
#: Spans of the kinds that no checksum confirms need this score.
LEAST_SCORE = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    once = F.reverse(digits)
    twice = F.translate(once, "0123456789", "0246813579")
    place = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(place, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.substr(once, i, F.lit(1))).otherwise(F.substr(twice, i, F.lit(1))).cast("int"))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number in capitals, without blanks, leaves 1 modulo 97."""
    turned = F.concat(F.substr(value, F.lit(5)), F.left(value, F.lit(4)))
    places = F.sequence(F.lit(1), F.length(turned))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(places, F.lit(0), step) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _card(v: Column) -> Column:
    return F.when(_between(F.length(_digits(v)), 12, 19), luhn(_digits(v))).otherwise(False)


def _iban(v: Column) -> Column:
    bare = F.replace(v, F.lit(" "), F.lit(""))
    return F.when(_between(F.length(bare), 15, 34), mod97(bare)).otherwise(False)


#: kind, pattern, what confirms a match, its score without context, words nearby that raise the score.
BASE = [
    ("email", _EMAIL, lambda v: F.lit(True), 0.8, "mail|contact|write|address|reach"),
    ("ip", _IP, lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\bip\b|host|server|address|login"),
    ("card", _CARD, _card, 0.7, "card|visa|credit|payment|account"),
    ("phone", _PHONE, lambda v: _between(F.length(_digits(v)), 9, 15), 0.6, "phone|call|tel|mobile|fax|contact"),
]
ADDED = [
    ("iban", _IBAN, _iban, 0.9, "iban|bank|account|konto|compte|cuenta"),
    ("ssn", _SSN, lambda v: F.lit(True), 0.3, "ssn|social|security|tax|insurance"),
]


def _proposed(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _located(gaps: Column, hits: Column) -> Column:
    """Start, end, value and context of each hit, from the pieces around the hits."""
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(hits)).alias("rest"))
    lengths = F.zip_with(gaps, hits, lambda gap, hit: F.char_length(gap) + F.coalesce(F.char_length(hit), F.lit(0)))
    ends = running(F.slice(lengths, 1, F.size(hits)), lambda x, before: x + F.coalesce(before, F.lit(0)))

    def span(part: Column, end: Column) -> Column:
        around = F.lower(F.concat_ws(" ", F.right(part["gap"], F.lit(BEFORE)), F.left(part["rest"], F.lit(AFTER))))
        return F.struct((end - F.char_length(part["hit"])).alias("start"), end.alias("end"), part["hit"].alias("value"), around.alias("context"))

    none = F.array().cast("array<struct<start:int,end:int,value:string,context:string>>")
    return F.when(F.size(hits) == 0, none).otherwise(F.zip_with(parts, ends, span))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """For every row: `row` (all its columns) and `spans`, an array of (start, rank, end, kind, value, score) in order of start, then kind.

    Places are code points, the end exclusive. Null counts as empty; a row without spans has an empty array; repeated rows are
    told apart by nothing and each gets its own result; an empty table gives an empty result.
    """
    kinds = BASE + ADDED
    proposed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_or_empty(docs[text_col]).alias("body"))
    halves = {k: _proposed(F.col("body"), pattern) for k, pattern, *_ in kinds}
    proposed = proposed.select("row", *[c.alias(f"{n}_{k}") for k, pair in halves.items() for n, c in zip(("gaps", "hits"), pair, strict=True)])
    located = proposed.select("row", *[_located(F.col(f"gaps_{k}"), F.col(f"hits_{k}")).alias(k) for k in halves])

    def confirmed(rank: int, kind: str, confirms, score: float, words: str, least: float) -> Column:
        scored = F.transform(F.filter(F.col(kind), lambda s: confirms(s["value"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"),
            F.round(F.least(F.lit(1.0), F.lit(score) + F.when(s["context"].rlike(words), 0.25).otherwise(0.0)), 2).alias("score"),
        ))
        return F.filter(scored, lambda s: s["score"] >= least)

    found = [confirmed(i, k, ok, score, words, 0.0 if i < len(BASE) else LEAST_SCORE) for i, (k, _, ok, score, words) in enumerate(kinds)]
    return located.select("row", F.array_sort(reduce(F.concat, found)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span's value in `text_col` replaced by [KIND]; spans that overlap are replaced together, by the first one's kind."""
    return spans_replaced(find_pii(docs, text_col), text_col, docs.columns)
