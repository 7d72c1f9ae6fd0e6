"""Secret scans over a trigram inverted index.

For each rule's pattern a Boolean query of trigrams is derived that every match must
satisfy: literal runs give conjunctions of their trigrams, alternatives give
disjunctions, and a pattern without a literal run of three characters gives no query.

Documents are indexed in segments (some megabytes of text): the posting list of a
trigram holds the documents of the segment that contain it.  Only trigrams that some
query asks for are indexed.  A rule's query is evaluated by intersecting and uniting
posting lists, and its pattern then runs on the candidates only; rules without mandatory
trigrams run on every text.  Segments are independent, so nothing is shuffled and a lost
task is simply run again.

Texts are indexed with A-Z in lower case, so that one index serves all rules.

Edge cases: a null text has no spans; very long texts are scanned in one piece, each rule in
time linear in their length; spans of one kind never overlap, so there are no ties; repeated rows
each give a row; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as ops
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import text_or_empty, text_slices

MAX_VARIANTS = 16          # literal variants that are followed through classes and alternatives


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    valid: Callable[[re.Match], bool] = lambda m: True
    group: int = 0                                 # the span is that of this group

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


# The patterns and limits of the first three kinds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),      # the runs of [0-9a-f]+ that have 24 characters or more
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # from the first eyJ of a run on: a run that does not go on in the right way is read once, not from each eyJ in it
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ[A-Za-z0-9_-]{8}))([A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", group=1),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE

# -- trigram queries -------------------------------------------------------------
# A query is True (anything may match), or ("and" | "or", frozenset of queries and trigrams).


def _all(parts) -> object:
    flat: set = set()
    for p in parts:
        if p is not True:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat)) if flat else True


def _any(parts) -> object:
    parts = set(parts)
    return True if True in parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_literals(variants: set[str]) -> object:
    """Some variant occurs in the text: the trigrams of each, united."""
    return _any(_all(v[i:i + 3] for i in range(len(v) - 2)) for v in variants)


def _walk(nodes, before: set[str]) -> tuple[object, set[str]]:
    """The query for a sequence, and the literal variants that end it.  ``before``: the
    literals that may precede it directly."""
    query, run = True, before
    for op, arg in nodes:
        exact: set[str] | None = None
        if op is ops.LITERAL:
            exact = {chr(arg).lower()}
        elif op is ops.IN:
            exact = _class(arg)
        elif op is ops.SUBPATTERN:
            inner, run = _walk(arg[3], run)
            query = _all([query, inner])
            continue
        elif op is ops.BRANCH:
            found = [_walk(branch, run) for branch in arg[1]]
            query = _all([query, _any(q for q, _ in found)])
            run = set().union(*(r for _, r in found))
            if len(run) > MAX_VARIANTS:
                run = {""}
            continue
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low, high, body = arg
            if (low, high) == (0, 1):
                inner, after = _walk(body, run)
                query, run = _all([query, _any([inner, _of_literals(run)])]), run | after
                run = run if len(run) <= MAX_VARIANTS else {""}
                continue
            if low:
                query = _all([query, _of_literals(run), _walk(body, {""})[0]])
            else:
                query = _all([query, _of_literals(run)])
            run = {""}
            continue
        if exact and len(run) * len(exact) <= MAX_VARIANTS:
            run = {r + x for r in run for x in exact}
        else:
            query, run = _all([query, _of_literals(run)]), {""}
    return _all([query, _of_literals(run)]), run


def _class(items) -> set[str] | None:
    """The characters of a small class, in lower case."""
    chars: set[str] = set()
    for op, arg in items:
        if op is ops.LITERAL:
            chars.add(chr(arg).lower())
        elif op is ops.RANGE and arg[1] - arg[0] < MAX_VARIANTS:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= MAX_VARIANTS else None


@cache
def trigram_query(pattern: str) -> object:
    """The trigram query of a pattern of ASCII literals; True if it has none."""
    query, _ = _walk(parser.parse(pattern, re.ASCII), {""})
    return query


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


# -- index and search --------------------------------------------------------------

class Index:
    """Posting lists of the asked-for trigrams over the texts of one segment."""

    def __init__(self, texts: list[str], asked: list[str]):
        raw = [t.encode().lower() for t in texts]
        self.n = len(raw)
        data = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        numbers = _numbers(tuple(asked))
        codes = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
        at = np.flatnonzero(numbers[codes])
        doc = np.searchsorted(ends, at, "right")
        inside = at + 3 <= ends[doc] if len(at) else np.zeros(0, bool)
        pairs = np.unique(numbers[codes[at[inside]]].astype(np.int64) * self.n + doc[inside])
        cuts = np.searchsorted(pairs, np.arange(1, len(asked) + 2) * self.n)
        self.postings = {t: pairs[cuts[k]:cuts[k + 1]] % self.n for k, t in enumerate(asked)}

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        found = lists[0]
        for more in lists[1:]:
            found = np.intersect1d(found, more, assume_unique=True) if query[0] == "and" else np.union1d(found, more)
        return found


@cache
def _numbers(asked: tuple[str, ...]) -> np.ndarray:
    """Number (from 1) of each asked-for trigram by its three bytes; 0: not asked for."""
    table = np.zeros(1 << 24, np.uint16)
    for k, t in enumerate(asked, 1):
        a, b, c = t.encode()
        table[a << 16 | b << 8 | c] = k
    return table


def scan(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end) of each text, by start, then in the order of rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = Index(texts, sorted(set().union(*(trigrams_of(q) for q in queries)))) if texts else None
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for order, (rule, query) in enumerate(zip(rules, queries)):
        search = rule.regex.finditer
        for i in index.candidates(query).tolist() if index else []:
            found[i] += [(m.start(rule.group), order, m.end()) for m in search(texts[i]) if rule.valid(m)]
    return [[(rules[o].kind, s, e) for s, o, e in sorted(spans)] for spans in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id and ``spans``, array of (kind, start, end) in code
    points, end exclusive."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in scan(part.column("text").to_pylist(), rules)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, _SPANS)], names=["id", "spans"])

    id_type = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
