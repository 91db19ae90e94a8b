"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pairs of neighbours wait in one bucket per merge rank; a three-level bitmap
over the ranks finds the least non-empty bucket with three find-first-set
steps. A bucket holds positions in a linked list of tokens, the leftmost
first; an entry whose position has since got another pair is stale and is
skipped when met. Cost grows as the number of bytes, so a pre-token of
millions of bytes is no worse a byte than a short one. Distinct pre-tokens
that a task meets are encoded together, as one list with gaps.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .annotate import annotate, free_name
from .store import prepare

#: Pre-tokens in each of the two generations that a worker remembers, some two hundred bytes each; when the younger is full, the older goes.
CACHE_PIECES = 250_000
#: Pre-tokens of at most this many characters are remembered.
CACHE_CHARS = 64
#: Pre-tokens of a text held at once.
PIECES_AT_ONCE = 1 << 18
#: Entries a vocabulary may have, as it is sent to every executor.
MAX_VOCABULARY = 1 << 20

FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
ROUND_TRIP_FIELDS = T.StructType([*FIELDS.fields, T.StructField("decoded", T.BinaryType(), False)])


class RankQueue:
    """Buckets by rank, found through bitmaps of 64 bits a word: ranks, words, words of words."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [position])
        else:
            bucket.append(position)

    def open(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        w = rank >> 6
        self.low[w] |= 1 << (rank & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push many; positions ascending."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ranks)], strict=True):
            self.open(int(ranks[a]), positions[a:b].tolist())

    def first(self) -> int:
        """The least rank that waits, or -1."""
        top = self.top
        if not top:
            return -1
        a = (top & -top).bit_length() - 1
        mid = self.mid[a]
        b = (a << 6) + (mid & -mid).bit_length() - 1
        low = self.low[b]
        return (b << 6) + (low & -low).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Remove a rank's bucket: its positions, leftmost first."""
        w = rank >> 6
        self.low[w] &= ~(1 << (rank & 63))
        if not self.low[w]:
            self.mid[w >> 6] &= ~(1 << (w & 63))
            if not self.mid[w >> 6]:
                self.top &= ~(1 << (w >> 6))
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return bucket


@dataclass
class Vocabulary:
    ranks: dict[bytes, int]
    pattern: str
    tokens: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self):
        if len(self.ranks) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(self.ranks)} entries is over {MAX_VOCABULARY}")
        self.tokens = {r: b for b, r in self.ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a rank: {missing[:5]}")

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        """Read a file of base64 tokens and their ranks, a pair a line."""
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.tokens = vocabulary.ranks, vocabulary.tokens
        self.size = max(self.tokens) + 1
        self.split = regex.compile(vocabulary.pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0], token[1]] = rank
        #: left id * size + right id -> the rank of the two together
        self.rank_of: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.rank_of[left * self.size + right] = rank
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece, as 32-bit integers."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        merged = iter(self._merge(rest)) if rest else iter(())
        return [w.to_bytes(4, sys.byteorder) if w is not None else next(merged) for w in whole]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        ends = np.cumsum([len(p) for p in pieces])
        # position n stands for "none": it has no pair and nothing reads its links
        pair = np.full(n + 1, -1, dtype=np.int64)
        pair[: n - 1] = self.pairs[raw[:-1], raw[1:]]
        pair[ends - 1] = -1
        nxt = np.arange(1, n + 2)
        nxt[ends - 1] = n
        prv = np.arange(-1, n)
        prv[ends[:-1]] = n
        prv[0] = n
        queue = RankQueue(self.size)
        at = np.flatnonzero(pair >= 0)
        queue.fill(pair[at], at)
        token, pair, nxt, prv = self.single[raw].tolist(), pair.tolist(), nxt.tolist(), prv.tolist()
        rank_of, size, buckets, waiting = self.rank_of.get, self.size, queue.buckets, queue.buckets.get
        while (rank := queue.first()) >= 0:
            bucket = queue.take(rank)
            # a merge never makes a pair of its own rank, as the new pair's token is longer
            for done, i in enumerate(bucket, 1):
                if pair[i] != rank:
                    continue  # stale
                j = nxt[i]
                k = nxt[j]
                token[i], nxt[i], token[j], pair[j] = rank, k, -1, -1
                least = rank
                if k == n:
                    pair[i] = -1
                else:
                    prv[k] = i
                    pair[i] = new = rank_of(rank * size + token[k], -1)
                    if new >= 0:
                        if (b := waiting(new)) is None:
                            queue.open(new, [i])
                        else:
                            b.append(i)
                        if new < least:
                            least = new
                p = prv[i]
                if p != n:
                    pair[p] = new = rank_of(token[p] * size + rank, -1)
                    if new >= 0:
                        if (b := waiting(new)) is None:
                            queue.open(new, [p])
                        else:
                            b.append(p)
                        if new < least:
                            least = new
                if least < rank and done < len(bucket):
                    queue.open(rank, bucket[done:])
                    break
        left = np.array(token, dtype=np.int32)
        stays = left >= 0
        cuts = 4 * np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])]
        packed, cuts = left[stays].tobytes(), cuts.tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= PIECES_AT_ONCE:
            yield self.split.findall(text)
            return
        some: list[str] = []
        for m in self.split.finditer(text):
            some.append(m[0])
            if len(some) >= PIECES_AT_ONCE:
                yield some
                some = []
        yield some

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; each match of the pattern is merged on its own, the rest is none."""
        out = []
        for pieces in self._pieces(text):
            self.learn(pieces)
            out.append(self.ids(pieces))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """As encode() of each text, null as empty; new pieces of short texts are merged together."""
        out: list = [None] * len(texts)
        group: list[tuple[int, list[str]]] = []
        held = 0
        for r, x in enumerate(texts):
            if not x:
                out[r] = np.zeros(0, dtype=np.int32)
            elif len(x) > PIECES_AT_ONCE:
                out[r] = self.encode(x)
            else:
                group.append((r, self.split.findall(x)))
                held += len(group[-1][1])
            if group and (held >= PIECES_AT_ONCE or r == len(texts) - 1):
                self.learn(chain.from_iterable(p for _, p in group))
                for i, pieces in group:
                    out[i] = self.ids(pieces)
                group, held = [], 0
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Merge the pieces that aren't remembered."""
        if len(self.cache) > CACHE_PIECES:
            self.old, self.cache = self.cache, {}
        self.long.clear()
        new = []
        for p in set(pieces).difference(self.cache):
            if (ids := self.old.get(p)) is None:
                new.append(p)
            else:
                self.cache[p] = ids
        for p, ids in zip(new, self.merge([p.encode("utf-8") for p in new]), strict=True):
            (self.cache if len(p) <= CACHE_CHARS else self.long)[p] = ids

    def ids(self, pieces: list[str]) -> np.ndarray:
        cache, long = self.cache, self.long
        parts = (cache[p] if p in cache else long[p] for p in pieces) if long else map(cache.__getitem__, pieces)
        return np.frombuffer(b"".join(parts), dtype=np.int32)


_encoders: dict[tuple, Encoder] = {}


def encoder_for(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The process's encoder of a vocabulary: what it has learnt serves later tasks of the same worker."""
    key = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(ranks, pattern))
    return _encoders[key]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        size = max(vocabulary.tokens) + 1
        parts = [vocabulary.tokens.get(i, b"") for i in range(size)]
        self.known = np.array([i in vocabulary.tokens for i in range(size)])
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, end of each id's bytes)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        source += np.arange(len(source))
        return self.bytes[source], ends


def share(spark: SparkSession, vocabulary: Vocabulary):
    """The vocabulary as a broadcast; its size is bounded by MAX_VOCABULARY."""
    return spark.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern))


def _id_lists(ids: list[np.ndarray]) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """(lists, their offsets, all ids)."""
    offsets = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *ids])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), offsets, flat


def _bytes_of(decoder: Decoder, flat: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    """The bytes of each list of ids."""
    data, ends = decoder.decode(flat)
    cuts = np.concatenate([[0], ends])[offsets].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "bpe") -> DataFrame:
    """`docs` with a struct `name`: ids, the text's token ids. Null and empty texts have none."""
    shared = share(docs.sparkSession, vocabulary)

    def make():
        encoder = encoder_for(*shared.value)

        def work(column: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays([_id_lists(encoder.encode_all(column.to_pylist()))[0]], names=FIELDS.names)

        return work

    return annotate(docs, text, make, FIELDS, free_name(docs, name))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "bpe") -> DataFrame:
    """As encode, with `decoded`: the bytes that the ids decode to. One pass, so ids needn't travel in between."""
    shared = share(docs.sparkSession, vocabulary)

    def make():
        encoder = encoder_for(*shared.value)
        decoder = Decoder(Vocabulary(*shared.value))

        def work(column: pa.Array) -> pa.StructArray:
            lists, offsets, flat = _id_lists(encoder.encode_all(column.to_pylist()))
            return pa.StructArray.from_arrays([lists, _bytes_of(decoder, flat, offsets)], names=ROUND_TRIP_FIELDS.names)

        return work

    return annotate(docs, text, make, ROUND_TRIP_FIELDS, free_name(docs, name))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """`docs` with a binary column `name`, the bytes of the id lists in `ids`.

    Null lists and null ids have no bytes; an id outside the vocabulary is an error.
    """
    prepare(docs.sparkSession)
    shared, at, name = share(docs.sparkSession, vocabulary), docs.columns.index(ids), free_name(docs, name)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(*shared.value))
        for batch in batches:
            lists = batch.column(at)
            lists = lists if not lists.null_count else pa.array([x or [] for x in lists.to_pylist()], lists.type)
            values = lists.flatten().drop_null() if not lists.flatten().null_count else None
            if values is None:
                lists = pa.array([[i for i in x if i is not None] for x in lists.to_pylist()], lists.type)
                values = lists.flatten()
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            out = _bytes_of(decoder, values.to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType(), False)]))
