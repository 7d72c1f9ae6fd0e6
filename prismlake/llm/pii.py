"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is a DataFrame expression: no Python runs on the executors and nothing is
shuffled.  For each rule the text is split at the rule's matches; the gaps and matches
give the positions (running sums of their lengths, in code points), the text before and
after a match is its context (it may reach over other matches), and a redacted text is put
together from them again.  All of it is linear in the length of a text.

Patterns are written for a backtracking engine: possessive where the next character
decides, and a match may only start where its run of characters starts (or where the
match before ended), so that long runs cost one pass.  The matches and gaps of a rule are
bound once (``_bound``), so that the cost stays linear whatever a later filter makes of the
plan.

Every rule has a base score; a passed checksum and context words within ``CONTEXT_CHARS``
raise it, and spans from ``MIN_SCORE`` on are kept.  A span that fails its rule's checksum
is dropped, whatever its context.  The rules with ``always`` reach the score on their own;
the others need their checksum or their context.

Edge cases: a null text has no spans (and stays null when redacted); spans of a kind
never overlap, ties cannot occur; repeated rows each give a row; an empty table gives
no rows; other columns are not read, or carried unchanged when redacting.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions.arrays import let
from prismlake.llm.common import prefix_sums, text_or_empty

MIN_SCORE = 0.5
CONTEXT_CHARS = 50
CONTEXT_BONUS = 0.3


def _ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda part: part.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)


def mod97(m: Column) -> Column:
    """The ISO 7064 mod 97-10 check of an account number (letters count 10 to 35)."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(F.ascii(c) < 58, acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int")) == 1


# Length of an account number by country code (ISO 13616).
IBAN_LENGTHS = {
    15: ("NO",),
    16: ("BE",),
    18: ("DK", "FI", "FK", "FO", "GL", "NL", "SD"),
    19: ("MK", "SI"),
    20: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"),
    21: ("CH", "HR", "LI", "LV"),
    22: ("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"),
    23: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"),
    24: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    25: ("LY", "PT", "ST"),
    26: ("IS", "TR"),
    27: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"),
    28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HN", "HU", "LB", "NI", "PL", "SV"),
    29: ("BR", "EG", "PS", "QA", "UA"),
    30: ("JO", "KW", "MU", "YE"),
    31: ("MT", "SC"),
    32: ("LC",),
    33: ("RU",),
}


def iban_pattern() -> str:
    """Account numbers by the length of their country: what follows is never swallowed."""
    kinds = (f"(?:{'|'.join(codes)})[0-9][0-9](?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
    return rf"\b(?:{'|'.join(kinds)})\b"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str                                   # proposes spans
    hint: str                                      # a text without this pattern has no span
    valid: Callable[[Column], Column] | None       # a span that fails is dropped
    score: float
    checksum_bonus: float = 0.0                    # of a span that ``valid`` confirms by a checksum
    words: tuple[str, ...] = field(default=())

    @property
    def always(self) -> bool:
        return self.score >= MIN_SCORE


# The patterns and limits of the first four kinds.
RULES = (
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 0.7,
         words=("mail", "email", "contact")),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip, 0.6, words=("ip", "host", "address")),
    Rule("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", _card, 0.6, words=("card", "credit", "visa", "payment")),
    Rule("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", _phone, 0.6, words=("phone", "call", "tel", "mobile")),
    Rule("iban", iban_pattern(), r"[A-Z][A-Z][0-9][0-9]", mod97, 0.2, 0.4,
         words=("iban", "account", "bank")),
    Rule("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", None, 0.3, words=("ssn", "social security")),
)
BASE = tuple(r.kind for r in RULES if r.always)


def _hinted(text: Column, rule: Rule) -> Column:
    return text.contains("@") if rule.hint == "@" else text.rlike(rule.hint)


def _bound(text: Column, rule: Rule, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(text, matches, gaps)`` with each of them evaluated once: as lambda variables
    they cannot be inlined into the lambdas of ``body``, where they would be evaluated again
    for every match."""
    none = F.array().cast("array<string>")
    matches = lambda t: F.when(_hinted(t, rule), F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))).otherwise(none)
    gaps = lambda t, m: F.when(F.size(m) > 0, F.split(t, rule.pattern, -1)).otherwise(none)
    return let(text, lambda t: let(matches(t), lambda m: let(gaps(t, m), lambda g: body(t, m, g))))


def _contexts(m: Column, g: Column) -> Column:
    """For each match the ``CONTEXT_CHARS`` characters of the text before it and after it,
    joined by a space.  They may reach over neighbouring matches: as no match is empty, so
    many neighbours at most; of each only the characters nearest to the match can count."""
    chars, n = F.lit(CONTEXT_CHARS), F.size(m)
    ends = F.zip_with(F.slice(g, F.lit(1), n), m, lambda g, m: F.right(F.concat(g, m), chars))
    starts = F.zip_with(m, F.slice(g, F.lit(2), n), lambda m, g: F.left(F.concat(m, g), chars))

    def one(i: Column, ends: Column, starts: Column) -> Column:
        first = F.greatest(i - CONTEXT_CHARS, F.lit(1))
        before = F.concat(F.array_join(F.slice(ends, first, i - first), ""), F.right(F.element_at(g, i), chars))
        after = F.concat(F.left(F.element_at(g, i + 1), chars), F.array_join(F.slice(starts, i + 1, F.lit(CONTEXT_CHARS)), ""))
        return F.concat_ws(" ", F.right(before, chars), F.left(after, chars))

    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return let(ends, lambda e: let(starts, lambda s: F.transform(numbers, lambda i: one(i, e, s))))


def _scored(rule: Rule, m: Column, g: Column) -> Column:
    """For each match the struct (m, before, ok, score); ``before``: the gap before it."""
    near = "(?i)\\b(?:" + "|".join(rule.words) + ")\\b"

    def one(x: Column, around: Column) -> Column:
        score = F.lit(rule.score + rule.checksum_bonus)
        score = score + F.when(around.rlike(near), CONTEXT_BONUS).otherwise(0.0)
        ok = rule.valid(x["m"]) if rule.valid else F.lit(True)
        return F.struct(x["m"].alias("m"), x["before"].alias("before"), ok.alias("ok"), F.round(score, 2).alias("score"))

    pairs = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda g, m: F.struct(m.alias("m"), g.alias("before")))
    return F.zip_with(pairs, _contexts(m, g), one)


def _spans(rule: Rule, scored: Column) -> Column:
    """The kept spans (kind, start, end, score) of scored matches."""
    lengths = F.transform(scored, lambda x: F.length(x["before"]) + F.length(x["m"]))
    placed = F.zip_with(scored, let(lengths, lambda x: prefix_sums(x)), lambda x, at: F.struct(
        F.lit(rule.kind).alias("kind"), (at + F.length(x["before"])).alias("start"),
        (at + F.length(x["before"]) + F.length(x["m"])).alias("end"), x["score"].alias("score"), x["ok"].alias("ok")))
    kept = F.filter(placed, lambda x: x["ok"] & (x["score"] >= MIN_SCORE))
    return F.transform(kept, lambda x: F.struct(x["kind"], x["start"], x["end"], x["score"]))


def _found(text: Column, rule: Rule) -> Column:
    return _bound(text, rule, lambda t, m, g: let(_scored(rule, m, g), functools.partial(_spans, rule)))


def _cleaned(text: Column, rule: Rule) -> Column:
    tag = F.lit(f"[{rule.kind.upper()}]")

    def body(t: Column, m: Column, g: Column) -> Column:
        parts = F.transform(_scored(rule, m, g), lambda x: F.concat(
            x["before"], F.when(x["ok"] & (x["score"] >= MIN_SCORE), tag).otherwise(x["m"])))
        return F.when(F.size(m) > 0, F.concat(F.array_join(parts, ""), F.element_at(g, F.size(g)))).otherwise(t)
    return _bound(text, rule, body)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, array of (kind, start, end, score),
    by kind in the order of ``RULES``, then by start; code points, end exclusive."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias(id_col), let(text, lambda t: F.concat(*(_found(t, rule) for rule in RULES))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every kept span of ``text_col`` replaced by its kind in brackets, one
    kind after the other; all other columns as they are."""
    text = F.col(text_col)
    for rule in RULES:
        text = _cleaned(text, rule)
    return docs.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
