"""Quality rules: base counts, and compression bands.

zstandard ratios (text bytes / compressed bytes) of the whole text and of
fixed chunks must lie within bands that depend on the length: far above them
a text repeats itself, below them it is noise. Short inputs compress worse,
as the frame and the tables weigh more, so the limits are by length, down to
the last piece of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .annotate import annotate, free_name
from .textops import BLOCK_BYTES, SPACE_WORDS, blocks, byte_class, grams, text_buffers, word_bounds, words

#: (bytes at least, lowest ratio, highest ratio) of whole texts; shorter texts have no band.
TEXT_BANDS = [(256, 1.02, 3.5), (1024, 1.15, 4.5), (4096, 1.25, 5.0), (16384, 1.35, 6.0), (65536, 1.4, 7.0)]
#: Bytes of a chunk; the last one holds the rest, and a shorter text is one chunk.
CHUNK_BYTES = 4096
#: Lowest and highest ratio of a chunk, by its bytes at least. Random printable characters reach 1.2,
#: random base64 1.33; prose has 1.7 from 1,024 bytes on. Under 64 bytes noise packs as badly as prose does.
CHUNK_BANDS = [(1, 0.05, 2.0), (64, 0.8, 2.5), (128, 0.95, 3.0), (256, 1.1, 3.5), (512, 1.25, 4.0), (1024, 1.35, 5.0), (2048, 1.4, 6.0)]
#: Rejected if chunks out of their bands hold more than this share of the bytes.
CHUNK_SHARE = 0.25
LEVEL = 3

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LINES = byte_class(b"\n")

FIELDS = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("ratio", T.DoubleType(), False), T.StructField("n_chunks", T.LongType(), False), T.StructField("n_low_chunks", T.LongType(), False), T.StructField("n_high_chunks", T.LongType(), False), T.StructField("kept", T.BooleanType(), False)]
)


def band(size: int, bands: list[tuple[int, float, float]]) -> tuple[float, float]:
    """The limits for a length: those of the last band that it reaches."""
    low, high = 0.0, float("inf")
    for least, a, b in bands:
        if size >= least:
            low, high = a, b
    return low, high


def compression(raw: bytes | memoryview, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, int, bool]:
    """(whole ratio, chunks, too low, too high, within bands)."""
    size = len(raw)
    if not size:
        return 0.0, 0, 0, 0, True
    stream, packed = packer.compressobj(size=size), 0
    n = low = high = outside = 0
    for a in range(0, size, BLOCK_BYTES):
        packed += len(stream.compress(raw[a : a + BLOCK_BYTES]))
    packed += len(stream.flush())
    for a in range(0, size, CHUNK_BYTES):
        part = raw[a : a + CHUNK_BYTES]
        least, most = band(len(part), CHUNK_BANDS)
        r = len(part) / len(packer.compress(part))
        n, low, high = n + 1, low + (r < least), high + (r > most)
        outside += 0 if least <= r <= most else len(part)
    least, most = band(size, TEXT_BANDS)
    ratio = size / packed
    return ratio, n, low, high, least <= ratio <= most and outside <= CHUNK_SHARE * size


def repeated_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    g = grams(h, 3)
    if len(g) < 2:
        return 0
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] >= 2)
    inside = np.zeros(len(h), dtype=bool)
    for j in range(3):
        inside[at + j] = True
    return int(inside.sum())


def quality_rules(docs: DataFrame, text: str = "text", name: str = "quality_rules") -> DataFrame:
    """`docs` with a struct `name`: the base counts, base_failed, the ratios and `kept`.

    Words are `[^\\x20\\x09-\\x0D]+`, case kept. n_dup_lines counts lines (split at
    \\n) that have a word and equal an earlier line. base_failed: fewer than 50
    words, or more than half of the words in repeated 3-word windows. kept: not
    base_failed, whole ratio within its band, and no more than a quarter of the
    bytes in chunks out of theirs. Null texts count as empty: all counts 0, ratio 0,
    not kept. Rows are judged one by one: repeated ones alike, and an empty table
    gives no rows. Texts of any length are read whole, some of it at a time. Columns
    of `docs` stay, whatever their names; `name` gives way.
    """

    def make():
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)

        def work(column: pa.Array) -> pa.StructArray:
            raw, offsets = text_buffers(column)
            rows = []
            for i, j in blocks(offsets):
                part, bounds = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, s, e = words(part, bounds, SPACE_WORDS, lower=False)
                line, ls, le = words(part, bounds, _LINES, lower=False)
                filled = np.searchsorted(s, le) > np.searchsorted(s, ls)
                line, ls = line[filled], ls[filled]
                at, line_at = word_bounds(s, bounds), word_bounds(ls, bounds)
                points = np.zeros(len(part) + 1, dtype=np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                chars = np.concatenate([[0], np.cumsum(points[e] - points[s])])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[part])])
                for r in range(j - i):
                    own = h[at[r] : at[r + 1]]
                    lines = line[line_at[r] : line_at[r + 1]]
                    n, again = len(own), repeated_words(own)
                    failed = n < 50 or 100 * again > 50 * n
                    ratio, chunks, low, high, fits = compression(part[bounds[r] : bounds[r + 1]].tobytes(), packer)
                    rows.append((n, int(chars[at[r + 1]] - chars[at[r]]), int(symbols[bounds[r + 1]] - symbols[bounds[r]]), len(lines) - len(np.unique(lines)), again, failed, ratio, chunks, low, high, fits and not failed))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()] + [pa.int64()] * 3 + [pa.bool_()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=FIELDS.names)

        return work

    return annotate(docs, text, make, FIELDS, free_name(docs, name))
