"""Byte-level BPE encoding and decoding with tree concatenation.

Text is encoded in independent segments.  A cut between a character that is no white
space and a following white-space character is always a pre-token boundary of the
byte-level pattern, so the ids of the whole text are the ids of its segments one
after the other.  Segments are cached (words repeat); the misses of many texts are
encoded in one call.

Where a text has no such cut for long (an unsplit run), the run is *tree
concatenated*: its halves are encoded on their own, then a window of tokens around
the join is encoded again and grown until it agrees with the left and the right side
exactly.  Texts longer than ``LONG_CHARS`` are cut into leaves that different tasks
encode, and are put together by the same join.  Added tokens split a text before all else:
no cut goes through one, and the window of a join ends at the nearest on either side.

Edge cases: null text is the empty text (no ids); an empty table gives no rows; very long
texts are encoded in leaves; merges have an order, so there are no ties; repeated rows each
give a row; only the id and text columns are read, so other
columns cannot clash.  An added token's string inside a text becomes that token's id,
as in the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import text_or_empty, text_slices

LEAF_CHARS = 1024          # an unsplit run up to this length is encoded directly
LONG_CHARS = 1 << 16       # longer texts are encoded by several tasks
PIECE_CHARS = 1 << 15      # length of the leaves of such texts
WINDOW_TOKENS = 16         # first window on each side of a join
AGREE_TOKENS = 4           # tokens that must agree on each side
CACHE_SEGMENTS = 250_000   # cached segments per Python worker

# Fixed value: the pre-token pattern of the byte-level tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACES = b" \t\n\x0b\x0c\r"
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for
    the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE file (ids follow merge order)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        alphabet = _byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"the ids of {path} do not follow its merges")
        self.bpe = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.added_ids = added
        self.special = frozenset(added.values())
        self.table = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        for token, i in added.items():
            self.table[i] = token.encode()
        self.widths = np.array([len(t) for t in self.table], np.int64)
        self.cache: dict[bytes, bytes] = {}

    # -- one run ---------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Ids of one text, by tree concatenation where it is long and unsplit."""
        if len(text) <= LEAF_CHARS:
            return self.bpe.encode(text, allowed_special="all")
        out: list[int] = []
        for part in self.added.split(text) if self.added else [text]:
            if part in self.added_ids:
                out.append(self.added_ids[part])
            else:
                for seg in _CUT.split(part):
                    out += self._tree(seg)
        return out

    def _tree(self, run: str) -> list[int]:
        """Ids of a run whose white space, if any, is in front."""
        front = len(run) - len(run.lstrip())
        middle = max(len(run) // 2, front + 1)
        if len(run) <= LEAF_CHARS or middle >= len(run):
            return self.bpe.encode_ordinary(run)
        return self.join(self._tree(run[:middle]), self._tree(run[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two adjoining parts of one run: the window around the join grows
        until its ids agree with both sides (or it holds them whole, up to an added token)."""
        if not left or not right:
            return left + right
        width = WINDOW_TOKENS
        while True:
            low, high = max(0, len(left) - width), min(width, len(right))
            a = next((k + 1 for k in range(len(left) - 1, low - 1, -1) if left[k] in self.special), low)
            b = next((k for k in range(high) if right[k] in self.special), high)
            whole_left, whole_right = a == 0 or left[a - 1] in self.special, b == len(right) or right[b] in self.special
            while not whole_left and self._inside_char(left[a]):
                a -= 1
                whole_left = a == 0 or left[a - 1] in self.special
            while not whole_right and self._inside_char(right[b]):
                b += 1
                whole_right = b == len(right) or right[b] in self.special
            if a == len(left) or b == 0:          # an added token at the join
                return left + right
            window = b"".join(self.table[i] for i in left[a:]) + b"".join(self.table[i] for i in right[:b])
            ids = self.bpe.encode_ordinary(window.decode())
            if (whole_left or ids[:AGREE_TOKENS] == left[a:a + AGREE_TOKENS]) and \
                    (whole_right or ids[-AGREE_TOKENS:] == right[b - AGREE_TOKENS:b]):
                return left[:a] + ids + right[b:]
            width *= 2

    def _inside_char(self, i: int) -> bool:
        return 0x80 <= self.table[i][0] < 0xC0

    # -- many texts ------------------------------------------------------------

    def encode_many(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        The distinct segments of all texts are found by their bytes (in four 8-byte
        lanes), looked up or encoded once, and gathered back."""
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        if not sizes.sum():
            return [b""] * len(raw)
        data = b"".join(raw)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        starts = segment_starts(data, edges)
        ends = np.append(starts[1:], len(data))
        first, inverse = distinct_segments(data, starts, ends)
        packed = self._lookup([data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())])
        widths = np.array([len(x) >> 2 for x in packed], np.int64)
        ids = np.frombuffer(b"".join(packed), "<u4")
        counts = widths[inverse]
        out_ends = np.cumsum(counts)
        source = np.repeat((np.cumsum(widths) - widths)[inverse] - (out_ends - counts), counts)
        source += np.arange(len(source))
        out = ids[source].tobytes()
        cuts = np.concatenate([[0], out_ends])[np.searchsorted(starts, edges)].tolist()
        return [out[4 * i:4 * j] for i, j in zip(cuts, cuts[1:])]

    def _lookup(self, segments: list[bytes]) -> list[bytes]:
        """Packed ids of distinct segments, from the cache where it has them.  New
        ones that begin with white space and do not end with it are encoded together."""
        cache = self.cache
        new = [x for x in segments if x not in cache]
        together = [x for x in new if len(x) <= LEAF_CHARS and x[0] in _SPACES and x[-1] > 32]
        if together:
            ids = np.array(self.bpe.encode(b"".join(together).decode(), allowed_special="all"), "<u4")
            ends = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
            cuts = (np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1).tolist()
            packed, start = ids.tobytes(), 0
            for segment, cut in zip(together, cuts):
                cache[segment] = packed[4 * start:4 * cut]
                start = cut
        extra = {x: self._pack(self.encode(x.decode())) for x in new if x not in cache}
        out = [cache[x] if x in cache else extra[x] for x in segments]
        if len(cache) > CACHE_SEGMENTS:
            cache.clear()
        return out

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def decode(self, packed: bytes) -> str:
        """Text of ids, special tokens kept; bytes that are no UTF-8 are replaced."""
        return b"".join([self.table[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def segment_starts(data: bytes, edges: np.ndarray) -> np.ndarray:
    """Byte offsets where segments start: the texts' own starts (``edges``) and every
    ASCII white space after a character that surely is none.  After control characters
    and in doubt (U+0085, U+00A0, lead bytes E1 to E3) there is no cut."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13)))
    before, two, three = b[at - 1], b[at - 2], b[at - 3]      # wrap-around at the first bytes is cut off below
    wide = before >= 0x80
    doubtful = wide & (((two == 0xC2) & ((before == 0x85) | (before == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3)))
    at = at[(at > 0) & (before > 32) & (before != 127) & ~doubtful]
    begins = np.zeros(len(data), bool)
    begins[at] = True
    begins[edges[:-1][np.diff(edges) > 0]] = True
    return np.flatnonzero(begins)


def distinct_segments(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one segment for each distinct one, and the distinct number of every
    segment.  Up to 32 bytes are compared as four words, longer ones by a dict."""
    sizes = ends - starts
    short = np.flatnonzero(sizes <= 32)
    padded = np.frombuffer(data + b"\0" * 40, np.uint8)
    words = np.ndarray((len(data) + 32,), "<u8", padded, 0, (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    lanes = [words[starts[short] + 8 * k] & masks[np.clip(sizes[short] - 8 * k, 0, 8)] for k in range(4)]
    lanes.append(sizes[short].astype(np.uint64))
    mixed = np.zeros(len(short), np.uint64)
    for lane in lanes:
        mixed = (mixed ^ lane) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    if any((lane != lane[first][inverse]).any() for lane in lanes):     # two texts share a mixed value
        _, first, inverse = np.unique(np.stack(lanes, 1), axis=0, return_index=True, return_inverse=True)
    number = np.empty(len(starts), np.int64)
    number[short] = inverse.reshape(-1)
    found: dict[bytes, int] = {}
    extra = []
    for i in np.flatnonzero(sizes > 32).tolist():
        text = data[starts[i]:ends[i]]
        if text not in found:
            found[text] = len(first) + len(extra)
            extra.append(i)
        number[i] = found[text]
    return np.concatenate([short[first], np.array(extra, np.int64)]), number


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec of a file; its cache lives as long as the Python worker."""
    return Codec(path)


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in text_slices(batches):
            ids = c.encode_many(part.column("text").to_pylist())
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(ids, pa.binary())], names=[*names, "ids"])
    return run


def _leaves(path: str):
    """Cut long texts into leaves: at a safe cut if one is near, else anywhere
    (``torn``: the join to the leaf before needs a window), but never inside an added token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = codec(path).added
        for part in text_slices(batches):
            rows: list[tuple] = []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                spans = np.array([m.span() for m in added.finditer(text)] if added else [], np.int64).reshape(-1, 2)
                start, no, torn = 0, 0, False
                while start < len(text):
                    end, next_torn = min(len(text), start + PIECE_CHARS), False
                    if end < len(text):
                        near = _CUT.search(text, end, min(len(text), end + PIECE_CHARS))
                        if near:
                            end = near.start()
                        elif text[end - 1].isspace() or text[end].isspace():
                            end, next_torn = _solid(text, end), True
                        else:
                            next_torn = True
                        k = int(np.searchsorted(spans[:, 0], end)) - 1          # the last added token that starts before
                        if k >= 0 and end < spans[k, 1]:
                            end, next_torn = int(spans[k, 0] if spans[k, 0] > start else spans[k, 1]), False
                    rows.append((key, no, torn, text[start:end]))
                    start, no, torn = end, no + 1, next_torn
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "no", "torn", "text"), map(list, zip(*rows)) if rows else [[]] * 4)),
                                             schema=pa.schema([("key", pa.string()), ("no", pa.int32()), ("torn", pa.bool_()), ("text", pa.string())]))
    return run


def _solid(text: str, at: int) -> int:
    """The first place from ``at`` on inside a run without white space."""
    found = re.compile(r"(?<=\S)(?=\S)").search(text, at)
    return found.start() if found else len(text)


def _join_leaves(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        pdf = pdf.sort_values("no")
        parts = [(torn, np.frombuffer(ids, "<u4").tolist()) for torn, ids in zip(pdf["torn"], pdf["ids"])]
        while len(parts) > 1:
            pairs = []
            for k in range(0, len(parts), 2):
                torn, left = parts[k]
                if k + 1 < len(parts):
                    left = c.join(left, parts[k + 1][1]) if parts[k + 1][0] else left + parts[k + 1][1]
                pairs.append((torn, left))
            parts = pairs
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "ids": [c._pack(parts[0][1])]})
    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and ``ids``, the text's ids as
    little-endian unsigned 32-bit integers (null text: empty)."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    short = base.where(F.length("text") <= LONG_CHARS).mapInArrow(_encode_batches(path), f"id {id_type}, ids binary")
    long = base.where(F.length("text") > LONG_CHARS).withColumn("key", F.sha2("text", 256))
    leaves = (long.select("key", "text").mapInArrow(_leaves(path), "key string, no int, torn boolean, text string")
              .groupBy("key", "no").agg(F.min("torn").alias("torn"), F.min("text").alias("text")))
    whole = (leaves.mapInArrow(_encode_batches(path), "key string, no int, torn boolean, ids binary")
             .groupBy("key").applyInPandas(_join_leaves(path), "key string, ids binary"))
    return short.unionByName(long.select("id", "key").join(whole, "key").select("id", "ids")).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of ``ids``."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in text_slices(batches, "ids"):
            texts = pa.array([c.decode(x) for x in part.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
