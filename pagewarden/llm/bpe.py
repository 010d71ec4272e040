"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

A piece of text starts as one token a byte. Over the byte positions stands a segment tree; a leaf
holds the rank of the pair that starts there, a node the least of its children, the leftmost where
ranks tie. The root so names the next merge, and a merge changes three leaves: the pair that starts
at the merged token, the pair of its live left neighbour, and the right part's, which dies. Each is a
point update up the tree, so a piece of n bytes takes O(n log n).

Pieces of up to BATCH_BYTES bytes are encoded many at a time: their trees are the rows of one array
and each round makes one merge in every piece that still has one. Longer pieces have a tree each.
Encoded pieces are kept in a dictionary of bounded size.

Cases: null text encodes to no token and decodes to nothing, as does empty text; texts of any
length are encoded whole; repeated rows fare alike; an empty table gives an empty result; other
columns pass through, columns named like the added ones are replaced. Ids outside the vocabulary
can't be decoded and raise."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: Longest piece that is encoded in a batch; pieces kept by a worker; ids decoded at once.
BATCH_BYTES = 128
KEPT_PIECES = 120_000
CHUNK_IDS = 200_000
NONE = np.int64(1) << 60


class Vocabulary:
    """Ranks of a vocabulary, its pairs, and the pieces encoded so far."""

    def __init__(self, data: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    self.pairs[a << 20 | b] = rank
        self._table()
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.length = np.array([len(x) for x in parts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.known: dict[str, bytes] = {}

    def _table(self) -> None:
        """An open-addressing hash table of the pairs, to look up many at a time."""
        bits = max(4, int(len(self.pairs) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.fromiter(self.pairs.keys(), dtype=np.int64, count=len(self.pairs))
        values = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of keys that want one slot the last gets it
            got = self.keys[at] == keys
            self.values[at[got]] = values[got]
            keys, values, at = keys[~got], values[~got], (at[~got] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none."""
        keys = left << 20 | right
        at = self._slot(keys)
        out = np.full(len(keys), NONE)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (seen != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def encode_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian int32, of pieces of at most `width` bytes, a power of two."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), dtype=np.uint8).reshape(n, width)
        column = np.arange(width)
        token = self.byte[raw]
        token[column >= lengths[:, None]] = -1
        after = np.broadcast_to(column + 1, (n, width)).copy()
        before = np.broadcast_to(column - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        row, at = np.nonzero(column[: width - 1] < lengths[:, None] - 1)
        rank = self.rank_of(token[row, at], token[row, at + 1])
        tree[row, width + at] = np.where(rank < NONE, rank * width + at, NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            rank, i = np.divmod(tree[live, 1], width)
            j = after[live, i]
            k = after[live, j]
            token[live, i], token[live, j] = rank, -1
            after[live, i] = k
            right = k < lengths[live]
            before[live[right], k[right]] = i[right]
            h = before[live, i]
            left = h >= 0
            tree[live, width + j] = NONE
            tree[live, width + i] = NONE
            for row, a, b in ((live[right], i[right], k[right]), (live[left], h[left], i[left])):
                rank = self.rank_of(token[row, a], token[row, b])
                tree[row, width + a] = np.where(rank < NONE, rank * width + a, NONE)
            up = [(live, width + i), (live, width + j), (live[left], width + h[left])]
            for row, node in up:
                while node[0:1].size and node[0] > 1:  # all leaves are on one level
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        kept = token >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        flat = token[kept].astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n, pairs = len(piece), self.pairs
        width = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        token = [int(self.byte[x]) for x in piece]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(token[i] << 20 | token[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break  # nothing changes further up
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            token[i], token[j], after[i] = rank, -1, k
            put(j, none)
            r = pairs.get(rank << 20 | token[k]) if k < n else None
            put(i, none if r is None else r * width + i)
            if k < n:
                before[k] = i
            if (h := before[i]) >= 0:
                r = pairs.get(token[h] << 20 | rank)
                put(h, none if r is None else r * width + h)
        return np.array([x for x in token if x >= 0], dtype="<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        known, pieces = self.known, [self.split(x) for x in texts]
        new = set().union(*pieces).difference(known)
        if len(known) + len(new) > KEPT_PIECES:
            known.clear()
            new = set().union(*pieces)
        by_width: dict[int, list[str]] = {}
        for x in new:
            n = len(x.encode())
            by_width.setdefault(0 if n > BATCH_BYTES else 1 << max(1, (n - 1).bit_length()), []).append(x)
        for width, some in by_width.items():
            for at in range(0, len(some), step := max(1, 400_000 // max(1, width))):
                part = [x.encode() for x in some[at : at + step]]
                known.update(zip(some[at : at + step], self.encode_many(part, width) if width else map(self.encode_one, part)))
        return [b"".join(map(known.__getitem__, x)) for x in pieces]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after another, and where each text's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        stop = np.concatenate(([0], np.cumsum(self.length[ids])))
        out = np.empty(stop[-1], dtype=np.uint8)
        for a in range(0, len(ids), CHUNK_IDS):
            some = ids[a : a + CHUNK_IDS]
            begin = stop[a : a + len(some)]
            at = np.arange(begin[0], stop[a + len(some)]) + np.repeat(self.start[some] - begin, self.length[some])
            out[begin[0] : stop[a + len(some)]] = self.blob[at]
        return out, stop[ends]


_READY: dict = {}


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Vocabulary(data, pattern)
    return _READY[key]


def _encode(sent, text: str, into: str, drop: bool):
    def run(batches):
        vocab = vocabulary(*sent.value)
        for whole in batches:
            for batch in slices(whole, text):
                done = vocab.encode([x or "" for x in batch.column(text).to_pylist()])
                ends = np.cumsum([0] + [len(x) // 4 for x in done], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(done), dtype="<i4"), pa.int32()))
                keep = [i for i, n in enumerate(batch.schema.names) if n != into and not (drop and n == text)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), ids], [*(batch.schema.names[i] for i in keep), into])

    return run


def _decode(sent, ids: str, into: str):
    def run(batches):
        vocab = vocabulary(*sent.value)
        for whole in batches:
            for batch in slices(whole, ids):
                column = batch.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # a null list has no items
                ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                data, stops = vocab.decode(flat, ends)
                text = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(stops.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
                keep = [i for i, n in enumerate(batch.schema.names) if n != into]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), text], [*(batch.schema.names[i] for i in keep), into])

    return run


def _send(df: DataFrame, path: str, pattern: str):
    """The vocabulary's file, below a megabyte or two whatever the corpus, goes from the driver to the workers."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "token_ids", drop: bool = False) -> DataFrame:
    """df with the ids of each whole text; without the text itself if `drop`."""
    kept = [f for f in df.schema.fields if f.name != into and not (drop and f.name == text)]
    return df.mapInArrow(_encode(_send(df, path, pattern), text, into, drop), T.StructType([*kept, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""
    kept = [f for f in df.schema.fields if f.name != into]
    return df.mapInArrow(_decode(_send(df, path, pattern), ids, into), T.StructType([*kept, T.StructField(into, T.BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", into: str = "decoded", drop: bool = False) -> DataFrame:
    """encode() and then decode() in one pass, so one Python worker holds the vocabulary, not two."""
    sent = _send(df, path, pattern)
    there, back = _encode(sent, text, ids, drop), _decode(sent, ids, into)
    kept = [f for f in df.schema.fields if f.name not in (ids, into) and not (drop and f.name == text)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(into, T.BinaryType())])
    return df.drop(into).mapInArrow(lambda batches: back(there(batches)), schema)
