"""Conversation operators and pattern packing against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, length int, audit string, _part int, _i long, block int, prior int"
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "a", 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


def plain(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def many_rows(seed=7):
    """Shared openings, copies, gaps, ties, nulls, a negative id, long conversations and texts."""
    rng = random.Random(seed)
    words = ["Go on.", "Why?", "no end", "", " \n", "x" * 5000, "Yes!", "ü 😀."]
    rows = []
    for c in range(-3, 90):
        if c % 11 == 4:
            continue
        n = 0 if c % 13 == 5 else rng.randint(1, 12)
        for t in range(n):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            rows.append((c, t if rng.random() < 0.95 else None, role, "Same." if c % 3 == 0 else rng.choice([*words, None])))
    for c in (200, 201, 205, 206):                                       # long, and alike for long
        rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t % 50}." if t < 300 else f"{c} {t}") for t in range(330 + c % 7)]
    rows += [(None, 1, "user", "No id."), (300, None, None, None), (300, None, None, None), (301, 1, "user", "b"), (301, 1, "user", "a"), (301, 1, "assistant", "a")]
    return rows + rows[40:60]


@pytest.fixture(params=["one part", "parts"])
def layout(request, spark):
    """With parts, conversations lie in several range partitions."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    if request.param == "parts":
        spark.conf.set(names[0], "5")
        spark.conf.set(names[1], "false")
    yield request.param
    for name, value in zip(names, before):
        spark.conf.set(name, value)


# -- prefix trie -------------------------------------------------------------------

def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            convs[c].append(((t is not None, t or 0, r, digest), (r, x)))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members, below = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in below[path]) or 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[p] for p in below[path])
        ends = ",".join(str(c) for c in sorted(members[path]) if len(rebuilt[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(below[path]),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie_rows(convs):
    from prismlake.llm.prefix_trie import prefix_trie, with_end_digests

    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in with_end_digests(prefix_trie(convs)).select(*names).collect()), key=lambda r: r[:2])


def test_trie_equals_brute_force(spark, layout, monkeypatch):
    from prismlake.llm import conversations, prefix_trie

    if layout == "parts":                                                # several levels of keys, stretches and packed parts
        monkeypatch.setattr(prefix_trie, "FAN", 3)
        monkeypatch.setattr(prefix_trie, "STRETCH", 16)
        monkeypatch.setattr(conversations, "BLOB_BYTES", 4)
    convs = frame(spark, many_rows())
    assert trie_rows(convs) == trie_by_hand(plain(convs))


def test_trie_of_generated_tables(spark):
    for table in ("sf0.001", "sf0.01"):
        convs = spark.read.parquet(f"/root/testdata/{table}/conversations.parquet")
        assert trie_rows(convs) == trie_by_hand(plain(convs))


def test_trie_of_few_rows(spark):
    assert trie_rows(frame(spark, [(0, 0, "user", "a")]).where("1 = 0")) == []
    convs = frame(spark, [(1, 0, "user", "a")])                           # turnless once rebuilt: its first turns are replaced by none
    assert trie_rows(convs) == trie_by_hand(plain(convs))


# -- structure repair --------------------------------------------------------------

NEXT = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = (("u", "user"), ("a", "assistant"))


def cheapest(rows):
    """Uniform-cost search over (rows read, automaton state), audits as a whole."""
    heap, done = [(0, "", 0, "e", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "ea":
            return cost, audit, out
        moves = [(2, "I", i, r, (name, "")) for r, name in NAMES]
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("b", "d"):
                more = int(fault == "t")
                moves += [(more, "K", i + 1, role[:1], (role, text))] + [(2 + more, "R", i + 1, r, (name, text)) for r, name in NAMES]
        for price, letter, j, initial, line in moves:
            if (state, initial) in NEXT:
                heapq.heappush(heap, (cost + price, audit + letter, j, NEXT[state, initial], out + (line,)))


def repairs_by_hand(rows):
    space = lambda x: " " if x is None else x
    convs, out = defaultdict(list), []
    for c, t, role, text in rows:
        role, text = space(role), space(text)
        fate = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            convs[c] += [(t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for c in {r[0] for r in rows}:
        seen, marked, n = set(), [], {"b": 0, "d": 0, "t": 0, "-": 0}
        damaged = sorted(convs[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for _, role, text in damaged:
            bare = text.strip(SPACES)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
            marked.append((role, text, fault))
            n[fault] += 1
        turns = {t for t, _, _ in damaged if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        text = "\n".join(f"{role}:{line}" for role, line in lines)
        out.append((c, gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def repair_rows(convs):
    from prismlake.llm.structure_repair import repair_conversations, with_digests

    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in with_digests(*repair_conversations(convs)).select(*names).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_repair_equals_brute_force(spark, layout, monkeypatch):
    from prismlake.llm import conversations

    if layout == "parts":
        monkeypatch.setattr(conversations, "BLOB_BYTES", 64)
    convs = frame(spark, many_rows())
    assert repair_rows(convs) == repairs_by_hand(plain(convs))


def test_repair_of_generated_tables(spark):
    for table in ("sf0.001", "sf0.01"):
        convs = spark.read.parquet(f"/root/testdata/{table}/conversations.parquet")
        assert repair_rows(convs) == repairs_by_hand(plain(convs))


def test_repair_of_few_rows(spark):
    from prismlake.llm.structure_repair import repair_conversations

    assert repair_rows(frame(spark, [(0, 0, "user", "a")]).where("1 = 0")) == []
    dropped = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repair_rows(frame(spark, [(dropped, 0, "user", "a.")])) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    whole = next(c for c in range(999) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(3)))
    _, repaired = repair_conversations(frame(spark, [(whole, 0, "system", "A."), (whole, 1, "assistant", "B.")]))
    assert [tuple(r)[3:] for r in repaired.orderBy("no").collect()] == [("K", "system", "A."), ("I", "user", ""), ("K", "assistant", "B.")]


def test_stretches_join_exactly(monkeypatch):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from prismlake.llm import structure_repair as sr

    monkeypatch.setattr(sr, "STRETCH", 3)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("bdt---")), max_size=20))
    def check(codes):
        _, (cost, audit) = sr.accepted(sr.table("".join(r + f for r, f in codes), (0,))[0])
        assert (cost, audit) == cheapest([(r, "", f) for r, f in codes])[:2]

    check()


def test_sql_of_both_queries():
    import duckdb

    from prismlake.llm.queries import ORACLES

    con, rows = duckdb.connect(), many_rows()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    order = lambda r: (r[0] is not None, *(x or 0 for x in r[:2]))
    for name, columns, want in (("op11_prefix_trie", "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256", trie_by_hand(rows)),
                                ("op12_structure_repair", "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256", repairs_by_hand(rows))):
        got = con.execute(f"select {columns} from ({ORACLES[name]}) q").fetchall()
        assert sorted(got, key=order) == sorted(want, key=order)


# -- pattern packing ---------------------------------------------------------------

@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_pattern_packing(request, which):
    from tokenizers import Tokenizer

    from prismlake.llm.pattern_packing import pack_documents

    docs = request.getfixturevalue(which)
    got = pack_documents(docs, PATH)
    assert {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"} <= set(got.columns)
    rows = got.collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for k, (a, b) in enumerate([(0, first), *((s, s + 2048) for s in range(first, len(ids), 2048))]):
            want.append((r["doc_id"], k, a, b - a, np.array(ids[a:b], "<u4").tobytes()))
    order = lambda r: (r[0] is None, *((r[0] or 0, *r[1:])))
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows], key=order) == sorted(want, key=order)
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(windows) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    from prismlake.llm import pattern_packing

    monkeypatch.setattr(pattern_packing, "BUCKET_ROWS", 7)
    pieces = spark.range(300).select((F.col("id") % 3).alias("doc_id"), F.when(F.col("id") < 200, 700).otherwise(F.col("id") * 5 + 1).cast("long").alias("length"),
                                     F.lit("x").alias("sequence_no"), F.lit(1).alias("_rank"))
    rows = pattern_packing.place_pieces(pieces).collect()
    taken = {(r["sequence_id"], k) for r in rows for k in range(r["offset"], r["offset"] + r["length"])}
    assert len(rows) == 300 and len(taken) == sum(r["length"] for r in rows) and max(k for _, k in taken) < 2048


def test_fit_reaches_the_least_squares_optimum():
    from prismlake.llm.pattern_packing import SHORT_WEIGHT, fit_repeats, length_patterns

    window = 24
    counts = np.array([0, *np.random.default_rng(3).integers(0, 40, window - 1)])
    patterns = length_patterns(counts, window)
    by_hand = sorted({tuple(sorted((a, b, c), reverse=True)) for a in range(1, 24) for b in range(1, 24) for c in range(24) if a + b + c == 24})
    by_hand = [p for p in by_hand if all(p.count(v) <= counts[v] for v in p if v)]
    assert sorted(map(tuple, patterns.tolist())) == by_hand
    x = fit_repeats(patterns, counts, window, rounds=20_000)
    matrix = np.zeros((window, len(patterns)))
    for k, p in enumerate(patterns.tolist()):
        for v in p:
            matrix[v, k] += v > 0
    weight = np.where(np.arange(window) <= window // 8, SHORT_WEIGHT, 1.0)
    slope = matrix.T @ (weight * (matrix @ x - counts))
    assert (x >= 0).all() and slope.min() > -0.1 and np.abs(slope[x > 1e-9]).max() < 0.1
    assert fit_repeats(patterns[:0], counts, window).shape == (0,)
