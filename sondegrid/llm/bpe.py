"""Byte-level BPE of whole columns.

Texts are cut into pretokens by array operations over the code points of many documents at once. Each distinct pretoken
is merged once per worker with a segment tree over its byte positions; all others are found by hash in a table of
finished pretokens, and every hit is verified character by character. The vocabulary is read on the driver and sent as one broadcast of a fixed size (under 1 MB).
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

TOKENIZERS = os.environ.get("SONDEGRID_TOKENIZERS", "/opt/tokenizers")
#: Code points processed at once, which bounds the memory of a worker (a longer single text is taken whole).
SLICE = 1 << 20
#: Finished pretokens kept by a worker; beyond it the table starts anew, which costs time only.
TABLE = 1 << 20

SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
#: Code points with the property White_Space (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
_MUL = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file (base64 and number a line)."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken. Leaf i of the tree holds the rank of the pair that begins at byte i; a node holds the minimum of
    its children, so the leftmost least pair is found from the root, and a merge updates three leaves in O(log n)."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    none = 1 << 60
    size = 1 << max(1, (n - 2).bit_length())
    get = ranks.get
    part = [piece[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], none)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (least := tree[1]) < none:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = nxt[i]
        part[i] += part[j]
        after = nxt[i] = nxt[j]
        if j < n - 1:
            put(j, none)
        if after < n:
            prv[after] = i
            put(i, get(part[i] + part[after], none))
        else:
            put(i, none)
        if (before := prv[i]) >= 0:
            put(before, get(part[before] + part[i], none))
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i]])
        i = nxt[i]
    return out


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def starts(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Where pretokens begin. cls is the class of each code point, EDGE between texts and at the end."""
    n = len(cp)
    start = np.ones(n, bool)
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != EDGE))  # last blank before a word
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    a = np.flatnonzero((cp == 39) & start)
    if len(a):
        c1, c2 = cp[np.minimum(a + 1, n - 1)], cp[np.minimum(a + 2, n - 1)]
        # the code points of s t m d, and of re ve ll
        two = (c1 == 115) | (c1 == 116) | (c1 == 109) | (c1 == 100)
        three = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        for at, length in ((a[two], 2), (a[three], 3)):
            start[at + 1] = False
            if length == 3:
                start[at + 2] = False
            start[at + length] = True
    return start


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Encoder:
    """Encodes batches of texts; holds the vocabulary and the table of finished pretokens of one worker."""

    def __init__(self, ranks: dict[bytes, int], table: int = TABLE):
        self.ranks, self.limit = ranks, table
        self.classes = _classes()
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.bits = max(10, (2 * self.limit - 1).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.val = np.zeros(1 << self.bits, np.int64)
        self.off, self.cnt, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.pool, self.filled = np.zeros(4096, np.int32), 0
        self.chars, self.spelt = np.zeros(4096, np.uint32), 0  # the pretokens themselves
        self.at, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.odd: dict[bytes, int] = {}  # pretokens whose hash another one has

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("power", _MUL), ("inverse", pow(_MUL, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the finished pretokens, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)) & mask
        seen = self.key[slot]
        out = np.where(seen == h, self.val[slot], -1)
        left = np.flatnonzero((seen != h) & (seen != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            seen = self.key[slot[left]]
            hit = seen == h[left]
            out[left[hit]] = self.val[slot[left[hit]]]
            left = left[~hit & (seen != 0)]
        return out

    def _add(self, piece: np.ndarray) -> int:
        """Merges a pretoken and keeps its characters and ids; returns its index."""
        ids = merge(piece.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), self.ranks)
        if self.used == len(self.off):
            self.off, self.cnt, self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.cnt, self.at, self.size))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.spelt + len(piece) > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.off[self.used], self.cnt[self.used] = self.filled, len(ids)
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.at[self.used], self.size[self.used] = self.spelt, len(piece)
        self.chars[self.spelt : self.spelt + len(piece)] = piece
        self.spelt += len(piece)
        self.used += 1
        return self.used - 1

    def _enter(self, h: int, index: int) -> None:
        mask = (1 << self.bits) - 1
        s = (h >> (64 - self.bits)) & mask
        while self.key[s]:
            s = (s + 1) & mask
        self.key[s], self.val[s] = h, index

    def _verify(self, index: np.ndarray, cp: np.ndarray, text: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Corrects the index of each pretoken that isn't the one found by its hash. text: the characters of all pretokens."""
        size = e - s
        found = self.size[index]
        wrong = found != size
        if wrong.any():
            found = np.where(wrong, 0, found)  # not compared
            text = text[np.repeat(~wrong, size)]
        end = np.cumsum(found)
        kind = np.int32 if self.spelt + len(text) < 1 << 31 else np.int64
        where = np.repeat((self.at[index] - (end - found)).astype(kind), found)
        where += np.arange(len(where), dtype=kind)
        stored = self.chars.take(where)
        differ = np.flatnonzero(stored != text)
        if differ.size:
            wrong[np.searchsorted(end, differ, side="right")] = True
        for k in np.flatnonzero(wrong).tolist():
            piece = cp[s[k] : e[k]]
            key = piece.tobytes()
            if key not in self.odd:
                self.odd[key] = self._add(piece)
            index[k] = self.odd[key]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each pretoken of all texts its index in the table, and for each text its number of pretokens."""
        joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cls = self.classes[cp]
        cls[ends] = EDGE
        start = starts(cp, cls)
        start[ends] = True
        start[ends[:-1] + 1] = True
        n = len(cp)
        self._powers(n + 1)
        head = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(cp.astype(np.uint64) + np.uint64(0x51ED27)) * self.power[:n], out=head[1:])
        at = np.flatnonzero(start)
        edge = cls[at] == EDGE
        s, e = at[~edge], np.append(at[1:], n)[~edge]
        h = (head[e] - head[s]) * self.inverse[s]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        count = np.diff(np.searchsorted(s, np.concatenate([[0], ends])))
        index = self._find(h)
        if (new := np.flatnonzero(index < 0)).size:
            distinct, first = np.unique(h[new], return_index=True)
            if self.used + len(distinct) > self.limit:
                if len(distinct) > self.limit:
                    self.limit = 2 * len(distinct)
                self._clear()
                distinct, first = np.unique(h, return_index=True)
                if len(distinct) > self.limit:
                    self.limit = 2 * len(distinct)
                    self._clear()
                new = np.arange(len(h))
            for key, k in zip(distinct.tolist(), new[first].tolist()):
                self._enter(key, self._add(cp[s[k] : e[k]]))
            index = self._find(h)
        inner = np.ones(n, bool)
        inner[ends] = False
        self._verify(index, cp, cp[inner], s, e)
        return index, count

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        index, count = self.tokens(texts)
        total = np.concatenate([[0], np.cumsum(self.cnt[index])])
        return np.diff(total[np.concatenate([[0], np.cumsum(count)])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each text."""
        index, count = self.tokens(texts)
        cnt = self.cnt[index]
        end = np.cumsum(cnt)
        total = np.concatenate([[0], end])
        ids = self.pool[np.repeat(self.off[index] - (end - cnt), cnt) + np.arange(total[-1])]
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(count)])])


def slices(sizes: Iterable[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many code points together."""
    a = size = n = 0
    for n, k in enumerate(sizes, 1):
        size += k + 1
        if size >= most:
            yield a, n
            a, size = n, 0
    if a < n:
        yield a, n


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, list[str]]]:
    """The texts of a column by slices, so that only one slice at a time exists as Python strings; a null is an empty text."""
    for a, z in slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), most):
        yield a, z, [t or "" for t in column.slice(a, z - a).to_pylist()]


_ENCODER: dict[int, Encoder] = {}


def worker_encoder(raw: bytes) -> Encoder:
    """One encoder for each worker process and vocabulary; workers are reused between tasks."""
    key = hash(raw)
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(parse_ranks(raw))
    return _ENCODER[key]


def _vocabulary(df: DataFrame, path: str | None):
    with open(path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, no special tokens. Null and empty text give an empty list; repeated rows and
    null ids are kept as they are; other columns are left out, so clashing names do no harm; an empty table gives no rows.
    Strings of special tokens in a text are ordinary text. Texts of any length are encoded whole."""
    raw = _vocabulary(df, vocabulary)
    src = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(raw.value)
        for b in batches:
            for a, z, texts in text_slices(b.column(1)):
                ids, n = enc.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), lists], ["k", "ids"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).toDF(id_col, ids_col)


def count_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens): the number of token ids of each text; null and empty text give 0. Otherwise as encode_column."""
    raw = _vocabulary(df, vocabulary)
    src = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(raw.value)
        for b in batches:
            for a, z, texts in text_slices(b.column(1)):
                n = enc.lengths(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(n, pa.int64())], ["k", "n"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("n", T.LongType())])
    return src.mapInArrow(run, schema).toDF(id_col, n_col)
