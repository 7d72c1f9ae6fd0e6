"""Repair of damaged conversations by generalised LR parsing with weighted edits.

A conversation should read  (s? (u a)+)?  by the initials of its roles.  The role grammar

    C -> empty | H        H -> u a | s u a | H u a

has the LR states of ``SHIFT`` and ``REDUCE``.  The parser keeps a graph-structured stack:
all stacks that the edits so far can lead to, heads with an equal top merged into the one
of smallest (cost, audit).  Each row is kept, reroled or deleted, empty turns are inserted
before it, and the audit lists the edits' initials.

Merging is safe for texts of any length: of two audits with equal cost that end in one
state after the same rows, neither begins with the other (what follows would be inserts,
which cost), so the smaller one stays smaller whatever comes next.  For the same reason a
long conversation is parsed in stretches, each from every possible top, and the
stretches' tables are put together by the same minimum: one conversation may hold any
share of all rows.

Edge cases: null role or text is one space, and so is a null id or turn in the damage rule;
rows with a null id are one conversation; rows are ordered by turn, null first, ties by
role, then text; repeated rows are rows of their own (the later one is a duplicate); texts
may have any length and are carried, not copied into the parser; a conversation without
rows has no edits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import discard, materialize
from prismlake.llm.conversations import digest_parts, pack_in_order, sorted_parts

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1      # costs
STRETCH = 512                                                # rows parsed from all tops at once
NOTHING = "\x00"                                             # key of the rows without an id
SPACES = " \t\n\x0b\x0c\r"

SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 4, (2, "a"): 5, (4, "a"): 6, (3, "u"): 7, (7, "a"): 8}
REDUCE = {5: 2, 6: 3, 8: 3}                # states that end a rule, and the length of its right side
GOTO = {0: 3}                              # state after H on top of a state
ACCEPT = (0, 3)
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 1, 4), 7: (0, 3, 7)}      # stacks between rows, by top
TOPS = tuple(STACKS)
NAMES = {"u": "user", "a": "assistant"}

Heads = dict[int, tuple[int, str]]         # top of a stack: (cost, audit)


def advance(top: int, role: str) -> int | None:
    """The top after shifting ``role`` and all reductions, or None where it may not follow."""
    state = SHIFT.get((top, role))
    if state is None:
        return None
    stack = [*STACKS[top], state]
    while stack[-1] in REDUCE:
        del stack[-REDUCE[stack[-1]]:]
        stack.append(GOTO[stack[-1]])
    return stack[-1]


NEXT = {(top, role): advance(top, role) for top in TOPS for role in "sua"}


def expected(top: int) -> str:
    """The role of an inserted or reroled turn."""
    return "u" if NEXT[top, "u"] is not None else "a"


def _merge(heads: Heads, top: int | None, cost: int, audit: str) -> bool:
    if top is None or top in heads and heads[top] <= (cost, audit):
        return False
    heads[top] = (cost, audit)
    return True


def _insert(heads: Heads) -> Heads:
    """Heads with any number of inserted turns."""
    out = dict(heads)
    todo = list(heads)
    while todo:
        top = todo.pop()
        cost, audit = out[top]
        after = NEXT[top, expected(top)]
        if _merge(out, after, cost + INSERT, audit + "I"):
            todo.append(after)
    return out


def parse(heads: Heads, codes: str) -> Heads:
    """Heads after rows given as two letters each: the role's initial (x: no such role) and
    the fault (b, d, t or -)."""
    heads = _insert(heads)
    for i in range(0, len(codes), 2):
        role, fault = codes[i], codes[i + 1]
        rows: Heads = {}
        for top, (cost, audit) in heads.items():
            _merge(rows, top, cost + DELETE, audit + "D")
            if fault in "bd":
                continue
            more = TRUNCATED if fault == "t" else 0
            if role != "x":
                _merge(rows, NEXT[top, role], cost + KEEP + more, audit + "K")
            _merge(rows, NEXT[top, expected(top)], cost + REROLE + more, audit + "R")
        heads = _insert(rows)
    return heads


@functools.lru_cache(maxsize=100_000)
def _stretch(top: int, codes: str) -> tuple[tuple[int, tuple[int, str]], ...]:
    return tuple(parse({top: (0, "")}, codes).items())


def _follow(left: Heads, right: dict[int, Heads]) -> Heads:
    out: Heads = {}
    for middle, (cost, audit) in left.items():
        for top, (more, rest) in right[middle].items():
            _merge(out, top, cost + more, audit + rest)
    return out


def table(codes: str, tops: tuple[int, ...] = TOPS) -> dict[int, Heads]:
    """For each top before the rows, the heads after them."""
    step = 2 * STRETCH
    parts = [{t: dict(_stretch(t, codes[i:i + step])) for t in (TOPS if i or len(codes) > step else tops)}
             for i in range(0, max(len(codes), 1), step)]
    while len(parts) > 1:
        parts = [{t: _follow(a[t], parts[k + 1]) for t in a} if k + 1 < len(parts) else a for k, a in enumerate(parts) if k % 2 == 0]
    return {t: parts[0][t] for t in tops}


def accepted(heads: Heads) -> tuple[int, tuple[int, str]]:
    """The cheapest accepting head: its top and (cost, audit)."""
    top = min((t for t in ACCEPT if t in heads), key=lambda t: heads[t])
    return top, heads[top]


def illegal_pairs(initials: str) -> int:
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


# -- rows --------------------------------------------------------------------------

def damage(convs: DataFrame) -> DataFrame:
    """The damaged rows: key, conv_id, turn, role, text."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(NOTHING))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = convs.select(key.alias("key"), "conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("_fate"))
    rows = rows.where("_fate <> 0").select("key", "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                                           text.alias("text"), F.when(F.col("_fate") == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")


def _faults(parts: DataFrame) -> DataFrame:
    """Light rows in order: key, turn, _part, _i, initial, fault."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    same = F.unhex(F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text").cast("binary")))
    light = parts.select("key", "turn", "_part", "_i", same.alias("_same"), (F.length(trimmed) == 0).alias("_blank"),
                         F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("_whole"), F.substring("role", 1, 1).alias("initial"))
    light = materialize(light)
    first = light.groupBy("key", "_same").agg(F.min("_i").alias("_first"))
    fault = F.when(F.col("_blank"), "b").when(F.col("_i") > F.col("_first"), "d").when(~F.col("_whole"), "t").otherwise("-")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    out = materialize(light.join(first, ["key", "_same"]).select("key", "turn", "_part", "_i", initial.alias("initial"), fault.alias("fault")))
    discard(light)
    return out


def _plans(rows: DataFrame) -> DataFrame:
    """For each part of a conversation: key, _part, n_parts, top before it, audit of its
    rows, cost and illegal pairs."""
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.concat("initial", "fault").alias("c")))), lambda x: x["c"]), "")
    stretches = rows.groupBy("key", "_part").agg(code.alias("codes")).withColumn("n_parts", F.count(F.lit(1)).over(Window.partitionBy("key")))
    stretches = materialize(stretches)

    @F.pandas_udf("top int, audit string, cost long, illegal long")
    def whole(codes: pd.Series) -> pd.DataFrame:
        found = [accepted(table(c, (0,))[0])[1] for c in codes]
        return pd.DataFrame({"top": 0, "audit": [a for _, a in found], "cost": [c for c, _ in found],
                             "illegal": [illegal_pairs(c[::2]) for c in codes]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        tables = [table(c) for c in pdf["codes"]]
        # heads before each part; then back from the accepted one, by the same minimum
        heads, before = {0: (0, "")}, []
        for t in tables:
            before.append(heads)
            heads = _follow(heads, t)
        top, (total, _) = accepted(heads)
        tops, audits = [], []
        for t, earlier in zip(reversed(tables), reversed(before)):
            start = min((m for m in earlier if top in t[m]), key=lambda m: (earlier[m][0] + t[m][top][0], earlier[m][1] + t[m][top][1]))
            audits.append(t[start][top][1])
            tops.append(start)
            top = start
        n = len(tables)
        return pd.DataFrame({"key": pdf["key"], "_part": pdf["_part"], "n_parts": pdf["n_parts"], "top": tops[::-1], "audit": audits[::-1],
                             "cost": [total] + [0] * (n - 1), "illegal": [illegal_pairs("".join(c[::2] for c in pdf["codes"]))] + [0] * (n - 1)})

    single = stretches.where("n_parts = 1").withColumn("x", whole("codes")).select("key", "_part", "n_parts", "x.*")
    many = stretches.where("n_parts > 1").groupBy("key").applyInPandas(
        joined, "key string, _part int, n_parts long, top int, audit string, cost long, illegal long")
    return materialize(single.unionByName(many))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the plans (rows with an audit come first in their part) through sorted rows."""
    names = ["key", "_part", "no", "edit", "role", "text"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()])))
    out: list[tuple] = []
    state = {"at": None, "audit": "", "i": 0, "top": 0, "no": 0}

    def emit(edit: str, role: str, text: str, initial: str) -> None:
        out.append((*state["at"], state["no"], edit, role, text))
        state["no"] += 1
        state["top"] = NEXT[state["top"], initial]

    def inserts() -> None:
        while state["at"] and state["i"] < len(state["audit"]) and state["audit"][state["i"]] == "I":
            initial = expected(state["top"])
            emit("I", NAMES[initial], "", initial)
            state["i"] += 1

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    for batch in batches:
        for key, part, audit, top, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "_part", "audit", "top", "role", "text"))):
            if audit is not None:
                inserts()
                state.update(at=(key, part), audit=audit, i=0, top=top, no=0)
                continue
            inserts()
            edit = state["audit"][state["i"]]
            state["i"] += 1
            if edit == "K":
                emit("K", role, text, role[:1])
            elif edit == "R":
                initial = expected(state["top"])
                emit("R", NAMES[initial], text, initial)
        yield batch_of()
    inserts()
    yield batch_of()


def repair_conversations(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired).  Report, one row for each conversation of ``convs`` after damage:
    conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit.  Repaired rows: key,
    _part, no (their order in a part; parts follow each other), edit (K, R or I), role, text;
    a partition holds its parts one after the other, in order."""
    parts = sorted_parts(damage(convs), "key", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()])
    rows = _faults(parts)
    plans = _plans(rows)
    count = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
    by_turn = rows.groupBy("key", "turn").agg(count("b").alias("b"), count("d").alias("d"), count("t").alias("t"))
    counts = by_turn.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"))
    audits = plans.groupBy("key").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    ids = convs.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(NOTHING)).alias("key")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    report = ids.join(counts, "key", "left").join(audits, "key", "left").select("conv_id", "key", *zero, F.coalesce("audit", F.lit("")).alias("audit"))
    none = lambda t: F.lit(None).cast(t)
    lines = (parts.select("key", "_part", "_i", "role", "text", none("string").alias("audit"), none("int").alias("top"))
             .unionByName(plans.select("key", "_part", F.lit(-1).cast("long").alias("_i"), none("string").alias("role"),
                                       none("string").alias("text"), "audit", "top")))          # before the rows of its part
    sorted_rows = lines.repartition("key", "_part").sortWithinPartitions("key", "_part", "_i")
    repaired = sorted_rows.select("key", "_part", "audit", "top", "role", "text").mapInArrow(
        _apply, "key string, _part int, no long, edit string, role string, text string")
    return report, repaired


def with_digests(report: DataFrame, repaired: DataFrame) -> DataFrame:
    """``report`` with ``repaired_sha256``: digest of the repaired ``role:text`` lines."""
    lines = repaired.withColumn("line", F.concat_ws(":", "role", "text"))
    digests = digest_parts(pack_in_order(lines, ["key"], "line", F.col("_part"), "\n"), ["key"], "\n")
    return report.join(digests, "key", "left").withColumn(
        "repaired_sha256", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("key", "sha256")
