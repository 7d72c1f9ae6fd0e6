"""Operators on documents against brute force, on tricky and on generated rows."""

import functools
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *cols):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


def ordered(items):
    return sorted(items, key=lambda r: tuple((x is None, x) for x in r))


# -- BPE and packing ---------------------------------------------------------------

@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def reference_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_bpe_equals_library_and_round_trips(request, which):
    from prismlake.llm.bpe import decode_documents, encode_documents

    docs = request.getfixturevalue(which)
    out = decode_documents(encode_documents(docs, PATH), PATH)
    want = [(i, np.array(reference_ids(t), "<u4").tobytes(), t or "") for i, t in pairs(docs)]
    assert rows(out.withColumn("ids", F.col("ids")), "doc_id", "ids", "decoded") == ordered((i, bytearray(b), t) for i, b, t in want)


def test_tree_concatenation_equals_direct_encoding():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from prismlake.llm import bpe

    codec = bpe.codec(PATH)

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="ab'st!1é😀 \n<|endoftext>", max_size=300), st.integers(2, 40))
    def check(text, leaf):
        before, bpe.LEAF_CHARS = bpe.LEAF_CHARS, leaf
        try:
            direct = codec.bpe.encode(text, allowed_special="all")
            assert codec.encode(text) == direct
            codec.cache.clear()
            assert np.frombuffer(codec.encode_many([text, "x", text])[2], "<u4").tolist() == direct
        finally:
            bpe.LEAF_CHARS = before

    check()


def test_leaves_of_long_texts_join_exactly(spark, monkeypatch):
    from prismlake.llm import bpe

    texts = ["".join(np.random.default_rng(s).choice(list("abé1!'s \n"), 4000)) for s in range(4)] + ["z" * 5000, "ab1" * 2000, " " * 3000]
    monkeypatch.setattr(bpe, "LONG_CHARS", 100)
    codec = bpe.codec(PATH)
    for text in texts:
        parts, at, torn = [], 0, False
        while at < len(text):                      # cut anywhere inside runs, as the leaves are
            end = min(len(text), at + 333)
            near = bpe._CUT.search(text, end, end + 333) if end < len(text) else None
            cut = near.start() if near else bpe._solid(text, end) if end < len(text) else end
            parts.append((torn, codec.encode(text[at:cut])))
            at, torn = cut, not near
        ids = parts[0][1]
        for torn, more in parts[1:]:
            ids = codec.join(ids, more) if torn else ids + more
        assert ids == codec.bpe.encode(text, allowed_special="all")


def test_leaves_split_at_added_tokens(spark, monkeypatch):
    from prismlake.llm import bpe

    # as stored: the added token cut in two, beside a cut, and near a cut
    texts = [("ab1" * 12_000)[:32_768 - k] + "<|endoftext|>" + "ab1" * 15_000 for k in (-4, -1, 0, 5, 13, 20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(frame, PATH).collect():
        assert bytes(r["ids"]) == np.array(reference_ids(texts[r["doc_id"]]), "<u4").tobytes(), r["doc_id"]
    # many small leaves
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    codec = bpe.codec(PATH)
    for seed in range(60):
        text = "".join(np.random.default_rng(seed).choice(["<|endoftext|>", "ab1", "é", "z" * 30, "!'s", "<|end", "😀"] + [" "] * (seed % 3), 300))
        batch = pa.RecordBatch.from_pydict({"key": ["k"], "text": [text]})
        leaves = pa.Table.from_batches(bpe._leaves(PATH)(iter([batch]))).to_pandas()
        assert "".join(leaves["text"]) == text
        leaves["ids"] = [codec._pack(codec.encode(t)) for t in leaves["text"]]
        assert bpe._join_leaves(PATH)(leaves)["ids"][0] == np.array(reference_ids(text), "<u4").tobytes(), seed


@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_packing_holds_every_id_once(request, which):
    from prismlake.llm.packing import WINDOW, pack_documents

    docs = request.getfixturevalue(which)
    got = pack_documents(docs, PATH).collect()
    want = Counter((i, zlib.crc32(np.array([*reference_ids(t), 1], "<u4").tobytes())) for i, t in pairs(docs))
    windows, whole = {}, Counter()
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= WINDOW
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= WINDOW
    total = sum(r["length"] for r in got)
    assert len(windows) <= total / WINDOW * 1.02 + 2                    # little padding
    parts = {}
    for r in got:
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for (i, n), found in parts.items():
        starts = sorted(found)
        copies = len([s for s, _ in starts if s == 0])
        text = b"".join(b for _, b in starts[::copies]) if copies > 1 else b"".join(b for _, b in starts)
        assert len(text) == 4 * n
        whole[(i, zlib.crc32(text))] += copies
    assert whole == want


def test_window_filling_is_optimal():
    from itertools import product

    from prismlake.llm.packing import fill_window, plan_windows

    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = np.zeros(31, np.int64)
        for length in rng.integers(1, 31, 5):
            counts[length] = rng.integers(1, 4)
        chosen = fill_window(counts, 30)
        lengths = np.flatnonzero(counts)
        longest = lengths[-1]
        best = max(s for c in product(*(range(counts[x] + 1) for x in lengths))
                   if c[-1] >= 1 and (s := int(np.dot(c, lengths))) <= 30)
        assert chosen[longest] >= 1 and sum(k * n for k, n in chosen.items()) == best
        assert all(n <= counts[k] for k, n in chosen.items())
        used = np.zeros(31, np.int64)
        for pattern, times in plan_windows(counts, 30):
            for length, n in pattern.items():
                used[length] += n * times
        assert (used == counts).all()


# -- SimHash -------------------------------------------------------------------------

def reference_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_simhash_components(request, which):
    from prismlake.llm.simhash import keep_one_per_component, simhash_components

    docs = request.getfixturevalue(which)
    data = pairs(docs)
    prints = [reference_fingerprint(t) for _, t in data]
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    smallest = {c: min((data[i][0] for i in range(len(data)) if label[i] == c and data[i][0] is not None), default=None) for c in label}
    want = ordered((data[i][0], format(prints[i], "016x"), smallest[label[i]]) for i in range(len(data)))
    assert rows(simhash_components(docs), "doc_id", "fingerprint", "component_id") == want
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(smallest.values())


def test_trie_join_finds_every_link(spark):
    from prismlake.llm.simhash import trie_links

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)]
    dense = np.arange(200, dtype=np.uint64)                                       # one hot corner of the trie
    prints = np.unique(np.concatenate([base, *near, near[0] ^ np.uint64(1 << 40), dense]))
    want = {(int(a), int(b)) for k, a in enumerate(prints) for b in prints[k + 1:] if (int(a) ^ int(b)).bit_count() <= 2}
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    for unit in (1 << 15, 50):
        got = [tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in trie_links(frame, 2, unit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    from prismlake.llm.graph import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (300, 300)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert len({found[i] for i in range(101)}) == 1 and found[200] == found[201] != found[0] and 300 not in found


# -- repeated passages ---------------------------------------------------------------

def kept_words(texts):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p:p + 35]) for w in docs for p in range(len(w) - 34))
    for words in docs:
        gone = set()
        for p in range(len(words) - 34):
            if seen[tuple(words[p:p + 35])] > 1:
                gone |= set(range(p, p + 35))
        yield len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()


@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_repeated_windows(request, which):
    from prismlake.llm.substrings import remove_repeats

    docs = request.getfixturevalue(which)
    data = pairs(docs)
    want = ordered((i, *k) for (i, _), k in zip(data, kept_words([t for _, t in data])))
    assert rows(remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == want


def test_repeats_of_generated_passages(spark):
    from prismlake.llm.substrings import remove_repeats

    rng = np.random.default_rng(5)
    stock = [" ".join(rng.choice(["a", "b", "c", "d"], 80)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(list("efghij"), rng.integers(1, 60)))]
        for _ in range(rng.integers(0, 3)):
            words = stock[rng.integers(4)].split()
            start = rng.integers(0, 40)
            parts += [" ".join(words[start:start + rng.integers(30, 60)]), " ".join(rng.choice(list("efghij"), 3))]
        texts.append(" ".join(parts))
    texts += ["a " * 300, "a b " * 120, texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == ordered((i, *k) for i, k in enumerate(kept_words(texts)))


# -- personal data and secrets ----------------------------------------------------------

def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, text or "") if ok(m[0])]


@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_pii_base_spans(request, which):
    from prismlake.llm.pii import BASE, find_pii, redact

    docs = request.getfixturevalue(which)
    found = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in BASE]) for r in find_pii(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(((i, pii_spans(t)) for i, t in pairs(docs)), key=key)
    clean = redact(docs)
    assert clean.columns == docs.columns and all(not pii_spans(t) for _, t in pairs(clean))


def test_pii_generated_texts_checksums_and_context(spark):
    from prismlake.llm.pii import find_pii, prefix_sums, redact

    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("a1. @+-()2é😀_:0\n"), rng.integers(0, 70))) for _ in range(400)]
    texts += ["1" * 30_000, "x" * 30_000 + "@", "+1" + " " * 9000 + "2", "a@b.c@d.e a@b.c_d@e.f",
              "IBAN GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789", "no 123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in find_pii(docs).collect()}
    for i, t in enumerate(texts):
        assert [s for s in found[i] if s[0] in PII] == pii_spans(t)
    n = len(texts)
    assert [x[0] for k in range(n - 4, n) for x in found[k]] == ["iban", "ssn"]
    assert [r["text"] for r in redact(docs).where(f"doc_id >= {n - 4}").orderBy("doc_id").collect()] == [
        "IBAN [IBAN].", texts[-3], "my ssn is [SSN]", texts[-1]]
    sums = spark.range(1).select(prefix_sums(F.sequence(F.lit(0), F.lit(1000))).alias("s")).first()["s"]
    assert sums == [k * (k - 1) // 2 for k in range(1001)]


def test_pii_context_reaches_over_other_matches(spark):
    from prismlake.llm.pii import CONTEXT_CHARS, find_pii, redact

    one = "123-45-6789"
    texts = ["SSN: 123-45-6789, 987-65-4321", f"{one} {one} {one} social security", f"ssn{' ' * 36}{one} {one}",
             f"ssn {'x' * 43} {one}, {one} 5 {one}", f"no {one}, {one}", " ".join([one] * 300) + " ssn"]
    rng = np.random.default_rng(11)
    texts += ["".join(rng.choice(["ssn", " ", f" {one} ", "😀", ", ", "x" * 9], rng.integers(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        near = lambda m: f"{t[max(0, m.start() - CONTEXT_CHARS):m.start()]} {t[m.end():m.end() + CONTEXT_CHARS]}"  # noqa: B023, E731
        want[i] = [m.span() for m in re.finditer(r"(?a)\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", t)
                   if re.search(r"(?ai)\b(ssn|social security)\b", near(m))]
    assert len(want[0]) == 2 and len(want[1]) == 3 and len(want[5]) == 4
    assert {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "ssn"] for r in find_pii(docs).collect()} == want
    assert redact(docs).where("doc_id = 0").first()["text"] == "SSN: [SSN], [SSN]"


def test_pii_is_linear_under_a_filter(spark):
    from prismlake.llm.pii import find_pii, redact

    text = " ".join(f"w{i} a{i}@b.cc 10.0.0.{i % 256} 123-45-{i % 9000 + 1000}" for i in range(7_500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    assert len(find_pii(docs).where(F.size("spans") > 0).first()["spans"]) == 15_000
    assert redact(docs).where("text like '%[EMAIL]%' and not text like '%@%'").count() == 1
    assert time.time() - start < 60


def test_account_numbers_before_other_capitals(spark):
    from prismlake.llm.pii import find_pii, redact

    texts = ["IBAN GB82 WEST 1234 5698 7654 32 AND MORE", "pay to GB82WEST12345698765432 TODAY",
             "GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 X", "NO93 8601 1117 947A", "ZZ82 WEST 1234 5698 7654 32"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [[(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "iban"] for r in find_pii(docs).orderBy("doc_id").collect()]
    assert found == [[(5, 32)], [(7, 29)], [(0, 27), (28, 55)], [], []]
    assert redact(docs).where("doc_id = 2").first()["text"] == "[IBAN] [IBAN] X"


def test_pii_oracle_agrees_on_contexts_and_account_numbers(spark):
    import duckdb

    from prismlake.llm import queries
    from prismlake.llm.pii import find_pii, span_text

    one = "123-45-6789"
    texts = ["SSN: 123-45-6789, 987-65-4321", f"{one} {one} {one} social security", f"ssn{' ' * 36}{one} {one}", f"ssn {'x' * 43} {one}, {one}",
             "IBAN GB82 WEST 1234 5698 7654 32 AND MORE", "pay to GB82WEST12345698765432 TODAY", None, "", "ü 😀 ssn a@b.cc +49 (30) 1234-5678 " + one]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = {r["doc_id"]: r["t"] for r in find_pii(docs).select("doc_id", span_text(F.col("spans")).alias("t")).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    theirs = dict(con.execute(f"select doc_id, spans from ({queries.ORACLES['op5_pii']}) q").fetchall())
    assert mine == theirs and mine[0].count("ssn") == 2


def test_pii_context_does_not_replace_a_checksum(spark):
    from prismlake.llm.pii import find_pii, redact

    texts = ["bank account GB82 WEST 1234 5698 7654 33", "account AB12CDEFGHIJKLMNO", "bank account GB82 WEST 1234 5698 7654 32"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in find_pii(docs).collect()}
    assert found == {0: [], 1: [], 2: [("iban", 13, 40)]}
    assert [r["text"] for r in redact(docs).orderBy("doc_id").collect()] == [*texts[:2], "bank account [IBAN]"]


SECRETS = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))


def secret_spans(text):
    return [(k, s, e) for s, _, k, e in sorted((m.start(), o, k, m.end()) for o, (k, p, ok) in enumerate(SECRETS)
                                               for m in re.finditer(p, text or "") if ok(m))]


@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_secret_base_spans(request, which):
    from prismlake.llm.secrets import BASE, find_secrets

    docs, kinds = request.getfixturevalue(which), {r.kind for r in BASE}
    found = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in kinds]) for r in find_secrets(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(((i, secret_spans(t)) for i, t in pairs(docs)), key=key)


def test_trigram_queries_lose_no_match():
    from prismlake.llm.secrets import RULES, Index, scan, trigram_query, trigrams_of

    rng = np.random.default_rng(7)
    parts = ["password", "Passwd", "SECRET", "toKen", "api_key", "apikey", '"', " ", "=", ":", "abc123", "deadbeef", "AKIA", "ABCDEFGHIJKLMNOP",
             "é", "😀", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "a1" * 20, "xoxb-", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(800)]
    got = scan(texts)
    for rule in RULES:
        query = trigram_query(rule.pattern)
        hits = {i for i, t in enumerate(texts) if rule.regex.search(t)}
        assert hits <= set(Index(texts, sorted(trigrams_of(query))).candidates(query).tolist())
        for i, t in enumerate(texts):
            assert [(s, e) for k, s, e in got[i] if k == rule.kind] == [m.span(rule.group) for m in rule.regex.finditer(t) if rule.valid(m)]
    assert trigram_query("[0-9a-f]{24,}") is True and trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset({"aki", "kia"}))


def test_web_tokens_in_linear_time():
    import re as plain
    import time

    from prismlake.llm import secrets

    rule = next(r for r in secrets.RULES if r.kind == "jwt")
    old = plain.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rng = np.random.default_rng(8)
    parts = ["eyJ", "a", "bcdefgh", "12345678", ".", ".eyJ", " ", "-", "_x", "eyJabcdefgh.eyJabcdefgh.abcdefgh"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(3000)]
    for t, spans in zip(texts, secrets.scan(texts, (rule,))):
        assert [(s, e) for _, s, e in spans] == [m.span() for m in old.finditer(t)], t
    assert sum(map(len, secrets.scan(texts, (rule,)))) > 100
    start = time.time()
    assert secrets.scan(["eyJ" * 350_000, "eyJabcdefgh." * 90_000], (rule,))[0] == []
    assert time.time() - start < 10


# -- quality, language, pseudo-likelihood -----------------------------------------------

def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    again = {j for k in range(len(words) - 7) if seen[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
            len(words) < 20 or 100 * len(again) > 30 * len(words))


@pytest.mark.parametrize("which", ["tricky", "sample", "nothing"])
def test_quality_counts(spark, request, which):
    from prismlake.llm.quality import quality_rules

    docs = request.getfixturevalue(which)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = quality_rules(docs, labels)
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(out, "doc_id", *cols) == ordered((i, *base_counts(t)) for i, t in pairs(docs))
    assert all(not r["kept"] for r in out.collect() if r["base_failed"])


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash of those before as seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (h >> 63 << 64)


def test_quality_ratio_and_verdict(spark, tricky):
    from prismlake.llm import quality as q

    docs = tricky.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        (F.col("doc_id") + 100).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(i, i % 3 > 0, i % 7 == 0) for i in range(1, 250)], "doc_id long, good boolean, toxic boolean").select(
        "doc_id", F.col("good").cast("int").alias("quality"), F.when(F.col("toxic"), 1).alias("toxic"))
    got = {}
    for r in q.quality_rules(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append((r["ratio"], r["kept"], r["base_failed"]))
    token = regex.compile(r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]+")
    corpus, trusted, grams = Counter(), Counter(), []
    for i, text in pairs(docs):
        hashed = [spark_hash(t) for t in token.findall((text or "").lower())]
        found = [spark_hash(h) % q.BUCKETS for h in hashed] + [spark_hash(a, b) % q.BUCKETS for a, b in zip(hashed, hashed[1:])]
        grams.append((i, found))
        corpus.update(found)
        if i is not None and i < 250 and i % 3 and i % 7:
            trusted.update(found)
    n, m = sum(corpus.values()) + q.BUCKETS, sum(trusted.values()) + q.BUCKETS
    weight = lambda b: round(np.log((trusted[b] + 1) / m) - np.log((corpus[b] + 1) / n), 6)
    for i, found in grams:
        want = sum(map(weight, found)) / len(found) if found else 0.0
        assert any(abs(ratio - want) < 1e-5 for ratio, _, _ in got[i]), i
    assert all(kept == (not failed and ratio >= q.THRESHOLD) for rows_ in got.values() for ratio, kept, failed in rows_)


def test_quality_of_a_very_long_text(spark):
    from prismlake.llm.quality import quality_rules

    text = " ".join(f"w{i % 50_000}" for i in range(100_000))                # every window occurs twice
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    row = quality_rules(docs, labels).first()
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"]) == (100_000, 100_000, True)


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    from prismlake.llm.quality import quality_rules

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality_rules(spark.read.parquet(f"{d}/documents.parquet"), labels).where("not base_failed").join(labels, "doc_id")
    share = {r["quality"]: r["s"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] == 1.0 and share[0] < 0.2


def test_quality_without_trusted_rows_scores_zero(tricky, spark):
    from prismlake.llm.quality import quality_rules

    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["ratio"] for r in quality_rules(tricky, empty).collect()} == {0.0}


def test_language_of_held_out_documents(spark):
    from prismlake.llm.langid import held_out, identify, train_on_documents

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs, train_on_documents(docs)).where(held_out())
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.99


def test_language_edge_cases(tricky, nothing):
    from prismlake.llm.langid import Scorer, grams_of, identify, train

    model = train(tricky)
    got = [(r["doc_id"], r["p"], r["s"]) for r in identify(tricky, model, names=("p", "s")).collect()]
    assert len(got) == tricky.count() and all(0 <= s <= 1 for _, _, s in got)
    by = {i: (p, s) for i, p, s in got}
    assert by[4] == by[5] == by[6] == ("und", 0.0) and by[7][0] == "en"
    none = train(nothing)
    assert none.languages == [] and Scorer(none).score(["abc"]) == (["und"], [0.0])
    assert identify(nothing, model).count() == 0
    # backoff: the longest known n-grams decide about a word that was not seen
    word = "zalphabet"
    known = [g for g in grams_of(word, 4) if g in model.grams]
    assert known and (model.unseen(word) == model.table[[model.grams[g] for g in known]].mean(0)).all()


def test_language_keeps_every_word_of_each_language(spark):
    from prismlake.llm.langid import Scorer, grams_of, train

    name = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    common = [(f"the x{name(i)} y{name(i)}", "large") for i in range(30_000)]
    rare = [(f"z{name(i)}", "small") for i in range(30)]
    model = train(spark.createDataFrame(common + rare, "text string, lang string"), per_language=60_000)
    assert len(model.words) == 60_031 and all(w in model.words for w, _ in rare)
    assert all(g in model.grams for w, _ in rare for n in range(1, 5) for g in grams_of(w, n))
    for lang, rows in (("large", common), ("small", rare)):             # recall of each language
        found = Scorer(model).score([t for t, _ in rows])[0]
        assert found.count(lang) == len(rows), lang
    # the compact table agrees with counts over all items
    whole = np.array([90_000, 30]) + 0.5 * len(model.words)
    assert np.allclose(model.rows([rare[7][0]])[0], np.log(np.array([0.5, 1.5]) / whole), atol=1e-5)
    assert np.allclose(model.rows(["the"])[0], np.log(np.array([30_000.5, 0.5]) / whole), atol=1e-5)
    assert np.allclose(model.rows(["zxaaay"])[0], model.unseen("zxaaay"), atol=1e-5)


def test_pseudo_likelihood(sample, nothing, tricky):
    from prismlake.llm import pseudolikelihood as pl

    base = sample.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found, words = pl.frequent_words(base.select("text"))
    counts = Counter(w for _, t in pairs(sample) for w in (t or "").encode().lower().split())
    least = max(pl.LEAST, -(-words ** pl.RARITY // 1))
    number = {w: int(pl.word_hashes([w.decode()])[0][0]) for w in counts}
    assert len(set(number.values())) == len(counts) and words == sum(counts.values())
    assert sorted(found.tolist()) == sorted(number[w] for w, n in counts.items() if n >= least)
    vocabulary = pl.Vocabulary(found)
    for text in ["", " \t", "a B\x0bé\x1c 　x", "x" * 50 + " y", *(t or "" for _, t in pairs(sample)[:20])]:
        own = [int(pl.word_hashes([w.decode()])[0][0]) for w in text.encode().lower().split()]
        assert pl.word_hashes(["z", text, "q"])[0].tolist()[1:-1] == own and pl.word_hashes(["z", text, "q"])[1].tolist() == [1, len(own), 1]
    tokens = pl.to_tokens(base, vocabulary)
    flat = pl.train(tokens, vocabulary.size, words, 1)
    network = pl.Network(vocabulary.size, flat)
    texts = vocabulary.tokens([t or "" for _, t in pairs(sample)][:20] + ["", "one"])
    logs = pl.score_tokens(network, texts)
    for found, log in zip(texts, logs):
        row = [pl.PAD] * 2 + found.tolist() + [pl.PAD] * 2
        one = sum(network.log_probability(np.array([[row[p - 2], row[p - 1], row[p + 1], row[p + 2]]]), np.array([row[p]]))[0]
                  for p in range(2, len(row) - 2))
        assert abs(one - log) < 1e-3 * max(1, len(found))
    assert sum(logs) > sum(pl.score_tokens(pl.Network(vocabulary.size), texts))
    probabilities = [network.log_probability(np.array([[3, 5, 7, 9]]), np.array([t]))[0] for t in range(1, vocabulary.size + 1)]
    assert abs(np.exp(probabilities).sum() - 1) < 1e-4
    assert pl.score_documents(nothing, rounds=1).count() == 0
    got = {r["doc_id"]: r for r in pl.score_documents(tricky, rounds=1).collect()}
    assert len(got) == tricky.select("doc_id").distinct().count()
    assert got[4]["n_tokens"] == 0 and got[4]["log_likelihood"] == 0 and got[4]["mean_log_likelihood"] is None
    assert got[7]["n_tokens"] == 30_000 and got[7]["log_likelihood"] < 0


def test_pseudo_likelihood_gradients():
    """A training step against numeric slopes of the log-probability, weight by weight."""
    from prismlake.llm import pseudolikelihood as pl

    rng = np.random.default_rng(1)
    network = pl.Network(11)
    network.w = {k: (v + rng.normal(size=v.shape) * 0.3 * (v > -9)).astype(np.float64) for k, v in network.w.items()}
    context, token = rng.integers(0, 12, (9, 4)), rng.integers(1, 12, 9)
    grads = network.gradients(context, token)
    assert set(grads) == set(network.w)
    for k, w in network.w.items():
        rows, g = grads[k]
        full = np.zeros(w.shape)
        full[rows] = g
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 25)]:
            if w[at] < -9:
                continue
            old, change = w[at], []
            for eps in (1e-5, -1e-5):
                w[at] = old + eps
                change.append(-network.log_probability(context, token).mean())
            w[at] = old
            assert abs((change[0] - change[1]) / 2e-5 - full[at]) < 1e-4, (k, at)


def test_pseudo_likelihood_scores_do_not_depend_on_the_layout(spark):
    from prismlake.llm import pseudolikelihood as pl

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3))
    score = lambda d: d.toPandas().sort_values(["doc_id", "n_tokens"])["log_likelihood"].to_numpy()
    monkey, pl.SHARD_WORDS, pl.WORDS_A_WEIGHT = pl.SHARD_WORDS, 20_000, 1
    try:
        one, many = (score(pl.score_documents(docs.repartition(n), rounds=2)) for n in (1, 32))
    finally:
        pl.SHARD_WORDS, pl.WORDS_A_WEIGHT = monkey, 16
    assert np.abs(one - many).max() < 1e-3 * np.abs(one).max()
    assert np.corrcoef(one.argsort().argsort(), many.argsort().argsort())[0, 1] > 0.999


def test_pseudo_likelihood_trains_on_every_token(spark):
    from prismlake.llm import pseudolikelihood as pl

    words = ["a", "b", "c", "d", "e", "f"]
    vocabulary = pl.Vocabulary(pl.word_hashes(words)[0])
    base = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    flat = pl.train(pl.to_tokens(base, vocabulary), vocabulary.size, 6, 1)
    row, at = pl.positions(vocabulary.tokens([" ".join(words)]))
    before, after = (n.log_probability(pl.contexts(row, at), row[at]) for n in (pl.Network(vocabulary.size), pl.Network(vocabulary.size, flat)))
    assert len(at) == 6 and (after > before).all()                          # every token was a target
    tokens = vocabulary.tokens(["a b c", "", "d", "a b c d e f f"])
    assert [t.tolist() for t in tokens] == [[1, 2, 3], [], [4], [1, 2, 3, 4, 5, 6, 6]]
    row, at = pl.positions(tokens)
    for rounds in (1, 2, 3):
        parts = [pl.targets(at, [len(t) for t in tokens], turn, rounds) for turn in range(rounds)]
        assert sorted(np.concatenate(parts).tolist()) == at.tolist()


def test_registered_sql_matches(spark):
    import duckdb

    from prismlake.llm.queries import ORACLES, QUERIES
    from tools.check_oracle import compare

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{d}/{table}.parquet'")
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, d).toPandas(), con.execute(sql).df()) == "ok", name


def test_bpe_digests_of_the_query(spark):
    from prismlake.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = dict(pairs(spark.read.parquet(f"{d}/documents.parquet")))
    for r in QUERIES["op4_bpe_codec"](spark, d).limit(30).collect():
        ids = np.array(reference_ids(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
