"""Byte-level BPE with a two-tier lookup, and its inverse.

Text is cut into pre-tokens by the vocabulary's pattern.  Tier one: a minimal perfect hash (hash and
displace, one slot per vocabulary entry, the entry's bytes compared) resolves a pre-token that is
itself an entry.  Tier two: the other pre-tokens are merged from single bytes, a heap of
(rank, position) over a doubly linked list giving the lowest-ranked leftmost pair each time, so a
pre-token of n bytes takes O(n log n).  Workers remember resolved pre-tokens in a bounded memo, which goes
with the vocabulary's broadcast: a worker that is given other work holds neither.

Defined results: null text counts as empty; an empty text has no ids and decodes to empty bytes;
ids outside the vocabulary or null ids raise ValueError on decoding; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.plans.columns import fresh, map_in_arrow, named
from quarry.plans.scratch import ship

_MASK = (1 << 64) - 1
#: Pre-tokens in a generation of a worker's memo; at most two generations are held.
MEMO_LIMIT = 200_000
#: Characters of a pre-token that is remembered, at most; longer ones are rare and encoded each time.
MEMO_LENGTH = 32


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & _MASK


def _slot(low: int, d: int, n: int) -> int:
    x = (low + d * 0x9E3779B97F4A7C15) & _MASK
    x ^= x >> 29
    return ((x * 0xBF58476D1CE4E5B9) & _MASK) % n


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: n keys in n slots."""

    def __init__(self, keys: list[bytes], load: int = 4, built: tuple[list[int], list[int]] | None = None):
        self.n, self.m = len(keys), max(1, len(keys) // load)
        if built:
            self.shift, self.at = built
            return
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.m)]
        for i, k in enumerate(keys):
            high, low = _hashes(k)
            buckets[high % self.m].append((low, i))
        self.shift = [0] * self.m
        self.at = [-1] * self.n
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        free = iter(())
        for j, b in enumerate(order):
            group = buckets[b]
            if len(group) <= 1:
                free = iter([s for s, i in enumerate(self.at) if i < 0])
                order = order[j:]
                break
            d = 1
            while True:
                slots = [_slot(low, d, self.n) for low, _ in group]
                if len(set(slots)) == len(slots) and all(self.at[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, group):
                self.at[s] = i
        else:
            order = []
        for b in order:  # single keys go straight to what is left, coded as a negative shift
            if buckets[b]:
                s = next(free)
                self.shift[b] = -s - 1
                self.at[s] = buckets[b][0][1]

    def index(self, key: bytes) -> int:
        """Position of key if it is one of the keys; some position otherwise."""
        high, low = _hashes(key)
        d = self.shift[high % self.m]
        return self.at[-d - 1 if d < 0 else _slot(low, d, self.n)]


class BytePairCodec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, built: tuple[list[int], list[int]] | None = None):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.table = PerfectHash(self.tokens, built=built)
        self.split = regex.compile(pattern).findall
        size = max(self.ids) + 1
        by_id = [b""] * size
        self.known = np.zeros(size, bool)
        for t, i in ranks.items():
            by_id[i] = t
            self.known[i] = True
        self.by_id = pa.array(by_id, pa.large_binary())

    def __reduce__(self):
        """A worker has this codec without building its hash again."""
        return BytePairCodec, (self.ranks, self.pattern, (self.table.shift, self.table.at))

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        i = self.table.index(raw)
        if self.tokens[i] == raw:
            return [self.ids[i]]
        return self.merge(raw)

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, over linked parts raw[i:end[i]]."""
        n, ranks = len(raw), self.ranks
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of its parts has been merged meanwhile
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                r = ranks.get(raw[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            k = before[i]
            if k >= 0:
                r = ranks.get(raw[k:stop])
                if r is not None:
                    heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def decode_flat(self, ids: pa.Array, offsets: np.ndarray) -> pa.LargeBinaryArray:
        """Bytes of each list of ids; offsets cut ids into lists."""
        flat = ids.to_numpy(zero_copy_only=False)
        if ids.null_count or (len(flat) and (flat.min() < 0 or flat.max() >= len(self.known) or not self.known[flat].all())):
            raise ValueError("an id is null or not in the vocabulary")
        taken = self.by_id.take(ids)
        cuts = np.frombuffer(taken.buffers()[1], np.int64, count=len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        data = taken.buffers()[2] if len(taken) else None
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts[offsets])), data or pa.py_buffer(b"")]
        )


class _Memo(dict):
    """Pre-token -> its ids.  Two generations: what is not asked for between two turns is forgotten."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __reduce__(self):
        return _Memo, (self.codec,)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > MEMO_LENGTH:
            return tuple(self.codec.piece(piece.encode("utf-8")))
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(self.codec.piece(piece.encode("utf-8")))
        if len(self) >= MEMO_LIMIT:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


_built: dict[tuple[str, str], BytePairCodec] = {}


def codec_for(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file, built once in this process."""
    if (path, pattern) not in _built:
        _built[path, pattern] = BytePairCodec(load_ranks(path), pattern)
    return _built[path, pattern]


def encode_texts(memo: _Memo, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and the offsets of each text."""
    ids, cuts = array("i"), [0]
    look, split = memo.__getitem__, memo.codec.split
    for t in texts:
        ids.extend(chain.from_iterable(map(look, split(t))))
        cuts.append(len(ids))
    return np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32), np.array(cuts, np.int64)


def _slices(texts: list[str], most: int):
    """Consecutive slices of at most so many characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def with_tokens(
    docs: DataFrame,
    codec: BytePairCodec,
    text_col: str = "text",
    keep: list[str] | None = None,
    decoded: bool = True,
) -> DataFrame:
    """docs' columns in ``keep`` (all, if None) with token_ids array<int> and, if asked, decoded binary.

    The bytes are decoded from the ids, not copied from the text.  Columns of docs that clash with
    the added names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    added = ["token_ids", "decoded"] if decoded else ["token_ids"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    fields = [docs.schema[c] for c in names]
    source = fresh("_text", names)
    schema = T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema = schema.add("decoded", T.BinaryType(), False)
    bc = spark.sparkContext.broadcast(_Memo(codec))  # a vocabulary, whatever the corpus' size

    def run(batches):
        memo = bc.value
        for batch in batches:
            texts = [t or "" for t in batch.column(source).to_pylist()]
            for a, b in _slices(texts, 2_000_000):
                ids, cuts = encode_texts(memo, texts[a:b])
                flat = pa.array(ids, pa.int32())
                cols = [batch.column(c).slice(a, b - a) for c in names]
                cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), flat))
                if decoded:
                    cols.append(memo.codec.decode_flat(flat, cuts).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    return map_in_arrow(docs.select(*[named(docs, c) for c in names], named(docs, text_col).alias(source)), run, schema)


def decode(df: DataFrame, codec: BytePairCodec, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """df's columns in ``keep`` with decoded binary; a null list decodes to empty bytes."""
    spark = df.sparkSession
    ship(spark)
    names = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("decoded", T.BinaryType(), False)])
    source = fresh("_ids", names)
    bc = spark.sparkContext.broadcast(codec)

    def run(batches):
        own = bc.value
        for batch in batches:
            lists = batch.column(source)
            lens = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            cuts = np.concatenate([[0], np.cumsum(lens)])
            got = own.decode_flat(lists.flatten().cast(pa.int64()), cuts).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], got], names=[*names, "decoded"])

    return map_in_arrow(df.select(*[named(df, c) for c in names], named(df, ids_col).alias(source)), run, schema)
