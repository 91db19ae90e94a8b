"""Benchmark decontamination by winnowing.

Every text becomes a sequence of word hashes. Of the k-gram hashes, the least
in each run of w consecutive ones is kept, the rightmost on a tie: any span of
k + w - 1 equal words then yields an equal kept hash at the same place of the
span on both sides. Kept hashes of documents are looked up among those of the
benchmark; each hit is extended to the left and right as far as words agree,
and counts where it reaches the item's window length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .annotate import annotate, free_name
from .store import prepare
from .textops import ALNUM_WORDS, blocks, grams, text_buffers, texts_words, word_bounds, words

#: Words a window has; an item of fewer is one window.
WINDOW_WORDS = 13
#: Words of a k-gram (fewer in shorter windows).
GRAM_WORDS = 5
#: Benchmark words that a worker holds at a time (some 30 bytes each, with their prints).
BLOCK_WORDS = 2_000_000
#: Bytes of texts that a worker passes by one block after the other, where there are several.
HELD_BYTES = 64 << 20

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("hits", T.ArrayType(T.LongType(), False), False),
    ]
)


def kept_positions(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept k-grams: least in a run of `w`, rightmost on ties."""
    if len(g) == 0:
        return np.zeros(0, dtype=np.int64)
    if len(g) <= w:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    runs = np.lib.stride_tricks.sliding_window_view(g[::-1], w)
    return np.unique(len(g) - 1 - (np.argmin(runs, axis=1) + np.arange(len(runs))))


@dataclass
class Index:
    """One block of the benchmark. Items are slices of `hashes`; prints are sorted by hash, by window length."""

    ids: list
    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    prints: dict

    @staticmethod
    def build(items: list[tuple[str | None, np.ndarray]], window: int, k: int) -> Index:
        starts = np.cumsum([0, *(len(h) for _, h in items)])
        every: dict[int, list] = {}
        for n, (_, h) in enumerate(items):
            span = min(window, len(h))
            g = grams(h, min(k, span))
            at = kept_positions(g, span - min(k, span) + 1)
            every.setdefault(span, []).append((g[at], np.full(len(at), n), at))
        prints = {}
        for span, parts in every.items():
            g, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            prints[span] = (g[order], n[order], at[order])
        lengths = np.array([min(window, len(h)) for _, h in items])
        return Index([i for i, _ in items], np.concatenate([h for _, h in items]), starts, lengths, prints)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    step, done = 64, 0
    while done < n:
        same = a[done : min(n, done + step)] == b[done : min(n, done + step)]
        if not same.all():
            return done + int(np.argmin(same))
        done = min(n, done + step)
        step *= 4
    return n


def find_hits(h: np.ndarray, bounds: np.ndarray, index: Index, k: int) -> dict[int, dict]:
    """Text number -> {(first word, end): set of items}, for texts whose words are h[bounds[i]:bounds[i+1]]."""
    found: dict[int, dict] = {}
    for span, (prints, item, where) in index.prints.items():
        kk = min(k, span)
        g = grams(h, kk)
        at = kept_positions(g, span - kk + 1)
        if not len(at):
            continue
        lo = np.searchsorted(prints, g[at], side="left")
        hit = (lo < len(prints)) & (prints[np.minimum(lo, len(prints) - 1)] == g[at])
        done: dict[tuple[int, int], int] = {}
        for p, x in zip(at[hit].tolist(), lo[hit].tolist(), strict=True):
            doc = int(np.searchsorted(bounds, p, side="right")) - 1
            first, end = int(bounds[doc]), int(bounds[doc + 1])
            while x < len(prints) and prints[x] == g[p]:
                n, q = int(item[x]), int(where[x])
                x += 1
                a, b = int(index.starts[n]), int(index.starts[n + 1])
                diagonal = (n, p - q)
                if done.get(diagonal, -1) > p:
                    continue
                own, other = h[first:end], index.hashes[a:b]
                right = _agree(own[p - first :], other[q:])
                left = _agree(own[: p - first][::-1], other[:q][::-1])
                done[diagonal] = p + max(right, 1)
                if left + right >= span:
                    found.setdefault(doc, {}).setdefault((p - first - left, p - first + right), set()).add(n)
    return found


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _benchmark_words(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(id, hashes as bytes) of every distinct item that has words."""
    rows = benchmark.select(F.col(item).cast("string").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), ([], [])
            for r, _, h, _, _ in texts_words(batch.column(1), ALNUM_WORDS):
                if len(h):
                    out[0].append(ids[r].as_py())
                    out[1].append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["id", "hashes"])

    prepare(benchmark.sparkSession)
    return rows.mapInArrow(run, "id string, hashes binary").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", name: str = "contamination", window: int = WINDOW_WORDS, k: int = GRAM_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with a struct `name`: n_words, n_hit, items, hits.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A word is
    hit inside any occurrence of an item's window (`window` consecutive words, or
    the whole item if it has fewer); `items` are the ids with such windows, sorted
    as strings; `hits` are the word spans (start, end, start, end, ...). Null or
    empty texts have no words; items without words or an empty benchmark hit
    nothing; equal items under several ids all count; the words of an item whose
    id is null count, but it isn't listed. Texts are compared by 64-bit word hashes.

    Rows are judged one by one: repeated ones alike, and an empty table gives no rows;
    columns of `docs` stay and `name` gives way to one of the same name. Texts of any
    length are read whole.

    The benchmark is cut into blocks of `block_words` words (an item is never split).
    A block is a broadcast of its own, which lies on disk until a worker reads it; the
    worker holds one at a time and passes HELD_BYTES of texts by each. So the documents
    are read once, in one job without a shuffle, and memory doesn't grow with the
    benchmark.
    """
    spark = docs.sparkSession
    rows = _benchmark_words(benchmark, item, item_text)
    sized = rows.select("id", "hashes", (F.length("hashes") / 8).cast("long").alias("n"))
    total = sized.agg(F.sum("n").alias("n")).first().n or 0
    n_blocks = -(-total // block_words)
    shared = []
    for b in range(n_blocks):
        part = sized if n_blocks == 1 else sized.where(F.pmod(F.xxhash64("id", "hashes"), F.lit(n_blocks)) == b)
        items = sorted(((r.id, np.frombuffer(r.hashes, dtype=np.uint64)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1].tobytes()))
        if items:
            shared.append(spark.sparkContext.broadcast(Index.build(items, window, k)))
    return annotate(docs, text, _worker(shared, k), FIELDS, free_name(docs, name), HELD_BYTES if len(shared) > 1 else 0)


def _worker(shared: list, k: int):
    def indexes() -> Iterator[Index]:
        for one in shared:
            yield one.value
            if len(shared) > 1:
                # the worker's copy goes; it is read from disk again for the next texts
                one.__dict__.pop("_value", None)

    def make():
        def work(column: pa.Array) -> pa.StructArray:
            raw, offsets = text_buffers(column)
            parts, n_words = [], []
            for i, j in blocks(offsets):
                h, s, _ = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM_WORDS)
                at = word_bounds(s, offsets[i : j + 1] - offsets[i])
                n_words += np.diff(at).tolist()
                parts.append((i, h, at))
            hits: dict[int, dict[tuple[int, int], set]] = {}
            for index in indexes():
                for i, h, at in parts:
                    for r, found in find_hits(h, at, index, k).items():
                        own = hits.setdefault(i + r, {})
                        for span, items in found.items():
                            own.setdefault(span, set()).update(index.ids[n] for n in items)
            n_hit, items, spans = [], [], []
            for r in range(len(n_words)):
                here = hits.get(r, {})
                n_hit.append(_covered(list(here)))
                items.append(sorted({x for own in here.values() for x in own} - {None}))
                spans.append([x for ab in sorted(here) for x in ab])
            return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], names=FIELDS.names)

        return work

    return make


def contaminated(found: Column) -> Column:
    """The contract's rule: a twentieth of the words or more are hit."""
    return (found["n_hit"] > 0) & (found["n_hit"] * 20 >= found["n_words"])
