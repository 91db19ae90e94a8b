"""Exact Jaccard self-join of documents on word shingles, and its components.

A document is its set of hashed 5-word shingles. Two sets of Jaccard similarity
t or more share a token among the first n - ceil(t * n) + 1 of each, in ANY one
global order of the tokens; and where sizes are alike, many. Candidates come
from a rare-first order and must pass the prefix test in two further orders
before their sets are compared.

Only connectivity is asked for, so links inside a group that already hangs
together are not looked for again:

1. sets are reduced to one per distinct set;
2. token frequencies, over all documents, give the rare-first order;
3. prefix tokens that nobody else has drop out; what is left is small;
4. tokens in the prefixes of a few sets give pairs, kept if they share enough tokens;
5. tokens of more sets give stars: in each posting, everyone is compared with one
   central set, and the links found merge sets into partial components;
6. whatever still shares a frequent prefix token across partial components is
   compared in full, a set against all members of the other one, in blocks.

Two linked sets that share a token of few sets are compared in step 4. Two that
share tokens of many alone end in one partial component or meet in step 6. So no
link between components is lost, and no long posting is paired with itself.

How many rows a token, a hub or a component has is known before it is joined: what
has many is sent, or cut into cells of bounded size, and never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lookup import lookup
from .store import Scratch, prepare, release_memory, released
from .textops import SPACE_WORDS, grams, mix, texts_words

SHINGLE_WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A token of as many documents counts as frequent and comes last, by frequency; prefixes of as many sets aren't paired.
FREQUENT = 8
#: Frequent tokens that the order knows at most (16 bytes each, sent to executors): the most frequent ones.
#: More of them are ordered by hash alone, which is as global; how their sets are compared doesn't depend on it.
MAX_FREQUENT = 1_000_000
#: Tokens that one counting task takes in, and that a map task holds before it passes them on.
COUNT_TOKENS = 1_000_000
#: Tokens of a block of sets in a comparison.
BLOCK_TOKENS = 60_000
STAR_ROUNDS = 3
#: Components that crowd a token, and tokens of a set that are listed to tell where two sets meet first.
CROWD = 32
MOST_LISTED = 256
#: Sets, or components, of a crowded token that meet in one cell of its grid.
CELL = 512
#: Tokens of either side of a hub that meet in one cell: as few as the first while that makes no more than so many cells, never more than the last.
SMALL_CELL, FEW_CELLS, CELL_TOKENS = 10_000, 32, 500_000
#: Bits of the filter over the sets that have candidates: at most 4 MB, sent to executors.
MAX_FILTER_BITS = 1 << 25

_SALTS = [np.uint64(0), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles; a shorter text is one shingle, an empty one has none."""
    return np.unique(grams(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, dtype=np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    total = np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True)
    total ^= np.bitwise_xor.reduce(tokens, keepdims=True) * np.uint64(0x9E3779B97F4A7C15)
    return int((mix(total) + np.uint64(len(tokens))).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


@dataclass
class Orders:
    """The global orders: rare-first twice with different ties, and one by hash alone."""

    keys: np.ndarray  # sorted frequent tokens (shortened)
    counts: np.ndarray
    shift: int

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        """How frequent each token is; 0 below the mark."""
        if not len(self.keys):
            return np.zeros(len(tokens), dtype=np.int64)
        short = tokens >> np.uint64(self.shift)
        at = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
        return np.where(self.keys[at] == short, self.counts[at], 0)

    def prefix(self, tokens: np.ndarray, order: int, percent: int, frequency: np.ndarray | None = None) -> np.ndarray:
        """Indices into `tokens` of the prefix, in the order's sequence."""
        size = prefix_length(len(tokens), percent)
        # never by the tokens' own bits: those say where a prefix token is sent
        tie = mix(tokens ^ _SALTS[order])
        first = np.zeros(len(tokens), dtype=np.int64) if order == 2 else (self.frequency(tokens) if frequency is None else frequency)
        return np.lexsort((tie, first))[:size]


def _sets(batch: pa.RecordBatch, text: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for r, _, h, _, _ in texts_words(batch.column(text), SPACE_WORDS):
        yield r, shingles(h, k)


def _frequent(docs: DataFrame, k: int, n_tokens: int, scratch: Scratch) -> Orders:
    """Count every token over all documents; keep those of FREQUENT documents or more.

    Tokens travel as sorted arrays, cut by their leading bits into as many ranges as
    keep one range within COUNT_TOKENS; 32 further bits tell tokens of a range apart.
    Two tokens may thus count as one, which makes the order no less global.
    """
    bits = max(6, int(np.ceil(np.log2(max(1, n_tokens / COUNT_TOKENS)))))
    shift = 64 - bits - 32

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(token >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows: list[list] = [[], [], [], []]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own, n = token[cuts[b] : cuts[b + 1]], count[cuts[b] : cuts[b + 1]]
            more = np.flatnonzero(n > 1)
            for x, y in zip(rows, (b, own.astype(np.uint32).tobytes(), more.astype(np.uint32).tobytes(), n[more].astype(np.uint32).tobytes()), strict=True):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "tokens", "at", "n"])

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            for _, tokens in _sets(batch, 0, k):
                held.append(tokens >> np.uint64(shift))
                size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def count(table: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("tokens").to_pylist()])
        n = np.ones(len(token), dtype=np.int64)
        start = 0
        for x, at, more in zip(table.column("tokens").to_pylist(), table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            n[start + np.frombuffer(at, dtype=np.uint32).astype(np.int64)] = np.frombuffer(more, dtype=np.uint32)
            start += len(x) // 4
        order = np.argsort(token, kind="stable")
        token, n = token[order], np.concatenate([[0], np.cumsum(n[order])])
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        total = n[np.append(first[1:], len(token))] - n[first]
        often = total >= FREQUENT
        key = (np.uint64(table.column("part")[0].as_py()) << np.uint64(32)) | token[first[often]].astype(np.uint64)
        found = pa.table({"token": pa.array(key.view(np.int64)), "n": pa.array(total[often])})
        del token, n, order
        release_memory()
        return found

    parts = docs.mapInArrow(released(gather), "part int, tokens binary, at binary, n binary")
    often = scratch.save(parts.groupBy("part").applyInArrow(count, "token long, n long"), "frequent")
    mark, size = FREQUENT, often.count()
    while size > MAX_FREQUENT:
        mark *= 2
        size = often.where(F.col("n") >= mark).count()
    found = often.where(F.col("n") >= mark).select("token", "n").toArrow()
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(token)
    return Orders(token[order], n[order], shift)


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, sid) of every row of (key, text)."""

    def run(batches):
        for batch in batches:
            n, sid = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for r, tokens in _sets(batch, 1, k):
                n[r] = len(tokens)
                sid[r] = set_id(tokens) if len(tokens) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sid)], names=["key", "n", "sid"])

    return docs.mapInArrow(released(run), docs.select("key").schema.add("n", "long").add("sid", "long"))


def _entries(docs: DataFrame, k: int, percent: int, orders, n_tokens: int, scratch: Scratch) -> DataFrame:
    """(token, sid, n, frequent): prefix tokens in the first order that two sets or more have.

    Rows travel packed, cut by the token's leading bits as for counting, and each cut
    keeps the tokens of several sets; those of FREQUENT sets or more are marked. A
    token that the order knows as frequent is taken as shared by many; its rows are
    cut by token and set instead, so that no task gathers those of a token or a set.
    """
    bits = max(6, int(np.ceil(np.log2(max(1, n_tokens * (100 - percent) / 100 / COUNT_TOKENS)))))
    shift = np.uint64(64 - bits - 32)
    low = np.uint64(0xFFFFFFFF)

    def run(batches):
        own: Orders = orders.value
        seen: set[int] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for _, tokens in _sets(batch, 0, k):
                if not len(tokens) or (sid := set_id(tokens)) in seen:
                    continue
                seen.add(sid)
                frequency = own.frequency(tokens)
                at = own.prefix(tokens, 0, percent, frequency)
                for x, y in zip(out, (tokens[at] >> shift, np.full(len(at), sid), np.full(len(at), len(tokens), dtype=np.int32), frequency[at] > 0), strict=True):
                    x.append(y)
            if not out[0]:
                continue
            token, sid, n, often = (np.concatenate(x) for x in out)
            part = np.where(often, mix(token ^ sid.view(np.uint64)) >> np.uint64(64 - bits), token >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, token, sid, n, often = part[order], token[order], sid[order], n[order], often[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            rows: list[list] = [[], [], [], []]
            # a frequent token is sent whole: its cut doesn't tell its leading bits
            for a, b in zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True):
                c = a + np.flatnonzero(~often[a:b])
                f = a + np.flatnonzero(often[a:b])
                rows[0].append(int(part[a]))
                rows[1].append((token[c] & low).astype(np.uint32).tobytes() + token[f].tobytes())
                rows[2].append(np.concatenate([sid[c], sid[f]]).tobytes())
                rows[3].append(np.concatenate([n[c], n[f]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "token", "sid", "n"])

    def keep(table: pa.Table) -> pa.Table:
        part = np.uint64(table.column("part")[0].as_py()) << np.uint64(32)
        rare, often, sids, sizes = [], [], [[], []], [[], []]
        for token, sid, n in zip(*(table.column(c).to_pylist() for c in ("token", "sid", "n")), strict=True):
            rows = len(sid) // 8
            frequent = (len(token) - 4 * rows) // 4
            cut = 4 * (rows - frequent)
            rare.append(np.frombuffer(token[:cut], dtype=np.uint32).astype(np.uint64) | part)
            often.append(np.frombuffer(token[cut:], dtype=np.uint64))
            for x, y in ((sids, np.frombuffer(sid, dtype=np.int64)), (sizes, np.frombuffer(n, dtype=np.int32))):
                x[0].append(y[: rows - frequent])
                x[1].append(y[rows - frequent :])
        out = []
        for tokens, sid, n, frequent in zip((rare, often), sids, sizes, (False, True), strict=True):
            t, s, m = np.concatenate(tokens), np.concatenate(sid), np.concatenate(n)
            order = np.lexsort((s, t))
            t, s, m = t[order], s[order], m[order]
            fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])[: len(t)]
            t, s, m = t[fresh], s[fresh], m[fresh]
            _, at, size = np.unique(t, return_inverse=True, return_counts=True)
            kept = np.ones(len(t), dtype=bool) if frequent else size[at] > 1
            out.append((t[kept], s[kept], m[kept], np.ones(int(kept.sum()), dtype=bool) if frequent else size[at][kept] >= FREQUENT))
        token, sid, n, flag = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"token": pa.array(token.view(np.int64)), "sid": pa.array(sid), "n": pa.array(n.astype(np.int32)), "frequent": pa.array(flag)})

    parts = docs.mapInArrow(released(run), "part int, token binary, sid binary, n binary")
    return scratch.save(parts.groupBy("part").applyInArrow(keep, "token long, sid long, n int, frequent boolean"), "entries")


def _membership(live: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of hashed set ids: tells most sets without candidates apart, and none with."""
    n, bits = live.count(), 12
    while (1 << bits) < 32 * n and (1 << bits) < MAX_FILTER_BITS:
        bits += 1
    place = F.shiftrightunsigned("sid", 64 - bits)
    words = live.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    table = np.zeros((1 << bits) >> 6, dtype=np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits, table


def _live_sets(docs: DataFrame, live: DataFrame, k: int, percent: int, orders, scratch: Scratch) -> DataFrame:
    """(sid, tokens, second, third): sets that may have candidates, with their prefixes in the other orders."""
    shared = docs.sparkSession.sparkContext.broadcast(_membership(live))

    def run(batches):
        own: Orders = orders.value
        bits, table = shared.value
        seen: set[int] = set()
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for _, tokens in _sets(batch, 0, k):
                if not len(tokens):
                    continue
                sid = set_id(tokens)
                h = (sid & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                if sid in seen or not (int(table[h >> 6]) >> (h & 63)) & 1:
                    continue
                seen.add(sid)
                frequency = own.frequency(tokens)
                rows[0].append(sid)
                rows[1].append(tokens.tobytes())
                for x, order in ((rows[2], 1), (rows[3], 2)):
                    x.append(np.sort(tokens[own.prefix(tokens, order, percent, frequency)]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["sid", "tokens", "second", "third"])

    sets = docs.mapInArrow(released(run), "sid long, tokens binary, second binary, third binary")
    return scratch.save(sets.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("tokens", "second", "third"))), "sets")


class _Block:
    """Some sets, concatenated for comparison with one at a time."""

    def __init__(self, rows: list[dict]):
        self.sids = [r["sid"] for r in rows]
        self.arrays = {c: [np.frombuffer(r[c], dtype=np.uint64) for r in rows] for c in ("tokens", "second", "third")}
        self.sizes = np.array([len(x) for x in self.arrays["tokens"]])
        self.flat = {c: np.concatenate(x) for c, x in self.arrays.items()}
        self.starts = {c: np.cumsum([0, *(len(y) for y in x[:-1])]) for c, x in self.arrays.items()}

    def overlaps(self, kind: str, other: np.ndarray) -> np.ndarray:
        """Size of the intersection of each set with a sorted one; no array here is empty."""
        flat = self.flat[kind]
        at = np.minimum(np.searchsorted(other, flat), len(other) - 1)
        return np.add.reduceat((other[at] == flat).astype(np.int64), self.starts[kind])


def compare(members: list[dict], spokes: list[dict], percent: int) -> tuple[list[int], list[int]]:
    """Ids of linked pairs; those without common prefix tokens in either further order aren't verified."""
    out: tuple[list[int], list[int]] = ([], [])
    start, size = 0, 0
    for end, m in enumerate(members, 1):
        size += len(m["tokens"]) // 8
        if size >= BLOCK_TOKENS or end == len(members):
            _compare_block(_Block(members[start:end]), spokes, percent, out)
            start, size = end, 0
    return out


def _compare_block(block: _Block, spokes: list[dict], percent: int, out: tuple[list[int], list[int]]) -> None:
    own = np.array(block.sids)
    for spoke in spokes:
        n = len(spoke["tokens"]) // 8
        likely = (100 * np.minimum(block.sizes, n) >= percent * np.maximum(block.sizes, n)) & (own != spoke["sid"])
        if not likely.any():
            continue
        sets = {c: np.frombuffer(spoke[c], dtype=np.uint64) for c in ("tokens", "second", "third")}
        for c in ("second", "third"):
            if likely.any():
                likely &= block.overlaps(c, sets[c]) > 0
        if likely.any():
            both = block.overlaps("tokens", sets["tokens"])
            for i in np.flatnonzero(likely & (100 * both >= percent * (block.sizes + n - both))).tolist():
                out[0].append(block.sids[i])
                out[1].append(spoke["sid"])


def _links(members: DataFrame, spokes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between members and spokes (hub, sid, n) of the same hub.

    A hub's members and spokes meet in cells: where either are many tokens, they are
    dealt over several, and each cell of one side meets each of the other on its own.
    """
    every = members.select("hub", "sid", "n", F.lit(True).alias("member")).unionByName(spokes.select("hub", "sid", "n", F.lit(False).alias("member")))
    tokens = lambda own: F.sum(F.when(own, F.col("n")).otherwise(0))
    cells = lambda own: F.greatest(F.lit(1), F.least(F.lit(FEW_CELLS), F.ceil(tokens(own) / SMALL_CELL)), F.ceil(tokens(own) / CELL_TOKENS)).cast("int")
    hubs = every.groupBy("hub").agg(cells(F.col("member")).alias("m_cells"), cells(~F.col("member")).alias("s_cells"), F.count("*").alias("rows"))
    sums = hubs.agg(F.sum("rows").alias("rows"), F.max(F.greatest("m_cells", "s_cells")).alias("cells")).first()
    if (sums.cells or 1) > 1:
        every = lookup(every, scratch.save(hubs, "hubs"), "hub", "rows", F.col("sid"), sums.rows)
        own = lambda c: F.pmod(F.xxhash64("sid"), F.col(c)).cast("int")
        one = lambda x: F.array(x)
        all_ = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        every = every.withColumn("m_cell", F.explode(F.when(F.col("member"), one(own("m_cells"))).otherwise(all_("m_cells"))))
        every = every.withColumn("s_cell", F.explode(F.when(F.col("member"), all_("s_cells")).otherwise(one(own("s_cells")))))
    else:
        every = every.withColumns({"m_cell": F.lit(0), "s_cell": F.lit(0)})
    fields = F.struct("sid", "tokens", "second", "third")
    side = lambda own: F.collect_list(F.when(own, fields))
    met = every.select("hub", "sid", "member", "m_cell", "s_cell").join(sets, "sid").groupBy("hub", "m_cell", "s_cell").agg(side(F.col("member")).alias("members"), side(~F.col("member")).alias("spokes"))

    def run(batches):
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for r in range(len(batch)):
                a, b = compare(batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), percent)
                found[0].extend(a)
                found[1].extend(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return met.select("members", "spokes").mapInArrow(released(run), "a long, b long")


def _fits(n: str, least: str, most: str, percent: int) -> Column:
    return (F.col(n) * 100 >= F.col(least) * percent) & (F.col(most) * 100 >= F.col(n) * percent)


def _least_shared(n: str, m: str, percent: int) -> Column:
    """How many prefix tokens two linked sets of n and m tokens share at least.

    What they have in common lies in the prefix that ends first, but for the rest of
    that set: the overlap is at most the shared prefix tokens and n less its prefix.
    """
    need = F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")
    rest = F.greatest(*(F.expr(f"({percent} * {x} + 99) div 100 - 1") for x in (n, m)))
    return F.greatest(F.lit(1), need - rest)


def _rare_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(hub, hub_n, sid, n): pairs that share prefix tokens of few sets, and enough of them.

    Such a token is in fewer than FREQUENT prefixes, so its pairs are few. Others are
    not paired here: as many as the two could share are taken for granted.
    """
    rare = entries.where("NOT frequent").select("token", "sid", "n")
    often = entries.where("frequent").groupBy(F.col("sid").alias("x")).agg(F.count("*").alias("f"))
    other = rare.select("token", F.col("sid").alias("hub"), F.col("n").alias("hub_n"))
    pairs = rare.join(other, "token").where((F.col("hub") < F.col("sid")) & _fits("n", "hub_n", "hub_n", percent))
    pairs = pairs.groupBy("hub", "sid").agg(F.first("hub_n").alias("hub_n"), F.first("n").alias("n"), F.count("*").alias("shared"))
    pairs = pairs.join(often.withColumnsRenamed({"x": "hub", "f": "hub_f"}), "hub", "left").join(often.withColumnRenamed("x", "sid"), "sid", "left")
    bound = F.col("shared") + F.least(F.coalesce("hub_f", F.lit(0)), F.coalesce("f", F.lit(0)))
    return pairs.where(bound >= _least_shared("n", "hub_n", percent)).select("hub", "hub_n", "sid", "n")


def _cross(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, sid, n, least, most, c): sets that share tokens with a component that isn't theirs, and how many.

    `rows` are (token, sid, n, comp, size). The larger component is the hub, so two
    components meet once. A token of few components sends them all to its sets. One
    of many would repeat the same pairs token after token, so there two single sets
    meet at the first such token that they share; and sets meet components in cells of
    a grid over the token, by size, as sets link only within a factor of their sizes.
    """
    larger = F.struct("hub_size", "hub") > F.struct(F.col("size").alias("hub_size"), F.col("comp").alias("hub"))
    fits = larger & _fits("n", "least", "most", percent)
    sides = rows.groupBy("token", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.first("size").alias("hub_size"), F.count("*").alias("own"))
    sides = scratch.save(sides.withColumnRenamed("comp", "hub"), "sides")
    tokens = scratch.save(sides.groupBy("token").agg(F.sum("own").alias("rows"), F.count("*").alias("comps")), "tokens")
    sums = tokens.agg(F.sum("rows").alias("rows"), F.sum("comps").alias("comps"), F.max("comps").alias("most")).first()
    # fewer than CROWD components of a token, as a list
    few = sides.join(tokens.where(F.col("comps") < CROWD).select("token", "rows"), "token")
    few = few.groupBy("token").agg(F.first("rows").alias("rows"), F.collect_list(F.struct("hub", "hub_size", "least", "most")).alias("hubs"))
    cols = ["hub", "sid", "n", "least", "most", "c"]
    found = lookup(rows, scratch.save(few, "few"), "token", "rows", F.col("sid"), sums.rows or 0).select("sid", "n", "comp", "size", F.inline("hubs"))
    found = found.where(fits).withColumn("c", F.lit(1)).select(*cols)
    if (sums.most or 0) >= CROWD:
        crowded = tokens.where(F.col("comps") >= CROWD)
        cells = lambda c: F.ceil(F.col(c) / CELL).cast("int")
        grid = crowded.select("token", cells("rows").alias("row_cells"), cells("comps").alias("hub_cells"), "rows", "comps")
        dense = scratch.save(lookup(rows, grid.drop("comps"), "token", "rows", F.col("sid"), sums.rows), "crowds")
        own = dense.groupBy("sid").agg(F.sort_array(F.collect_list("token")).alias("own")).where(F.size("own") <= MOST_LISTED)
        own = scratch.save(own, "listed")
        size = dense.select("sid", "size").distinct()
        ones = own.join(size.where("size = 1"), "sid").select(F.col("sid").alias("one"), F.col("own").alias("hub_own"))
        hubs = lookup(sides, grid.drop("rows"), "token", "comps", F.col("hub"), sums.comps)
        # a component of one set goes by that set
        hubs = hubs.join(ones, (F.col("hub") == F.col("one")) & (F.col("hub_size") == 1), "left")
        log = np.log(100 / percent)
        band = lambda n, by: F.floor(F.log(F.col(n).cast("double")) / log + by).cast("int")
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        cell = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = dense.join(own, "sid", "left").withColumns({"band": band("n", 0), "row_cell": cell("sid", "row_cells")}).withColumn("hub_cell", spread("hub_cells"))
        right = hubs.withColumn("hub_cell", cell("hub", "hub_cells")).withColumn("row_cell", spread("row_cells"))
        right = right.withColumn("band", F.explode(F.sequence(band("least", -1 - 1e-9), band("most", 1 + 1e-9))))
        on = ["token", "band", "row_cell", "hub_cell"]
        both = F.array_intersect("own", "hub_own")
        listed = F.col("own").isNotNull() & F.col("hub_own").isNotNull()
        meets = left.select(*on, "sid", "n", "comp", "size", "own").join(right.select(*on, "hub", "hub_size", "least", "most", "hub_own"), on)
        meets = meets.where(fits & (~listed | (F.col("token") == F.array_min(both))))
        found = found.unionByName(meets.withColumn("c", F.when(listed, F.size(both)).otherwise(1)).select(*cols))
    return found.groupBy("hub", "sid").agg(F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("c").alias("c"))


def _join(docs: DataFrame, k: int, percent: int, n_tokens: int, scratch: Scratch) -> DataFrame | None:
    """(node, root) of sets that link with other sets; None where none do."""
    spark = docs.sparkSession
    orders = spark.sparkContext.broadcast(_frequent(docs, k, n_tokens, scratch))
    scratch.drop("frequent")
    entries = _entries(docs, k, percent, orders, n_tokens, scratch)
    rare = scratch.save(_rare_pairs(entries, percent), "rare")
    often = scratch.save(entries.where("frequent").select("token", "sid", "n"), "often")
    scratch.drop("entries")
    # sets made of frequent tokens to a good part, with the number of such tokens
    dense = scratch.save(often.groupBy("sid").agg(F.count("*").alias("shared"), F.first("n").alias("n")), "dense")
    live = scratch.save(rare.select("sid").union(rare.select("hub")).union(dense.select("sid")).distinct(), "live")
    if live.isEmpty():
        return None
    sets = _live_sets(docs, live, k, percent, orders, scratch)
    roots = None

    n_often, n_dense = often.count(), dense.count()

    def compared(spokes: DataFrame, hubs: DataFrame, name: str) -> bool:
        """Find links, and add the components that they make to `roots`."""
        nonlocal roots
        if spokes.isEmpty():
            return False
        new = scratch.save(_links(hubs, spokes, sets, percent, scratch), f"links-{name}")
        if new.isEmpty():
            return False
        # what hung together before goes as links to the root
        links = new if roots is None else new.union(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = scratch.save(connected_components(links, scratch, f"parts-{name}"), f"roots-{name}")
        return True

    def own_hubs(spokes: DataFrame) -> DataFrame:
        return spokes.select("hub", F.col("hub").alias("sid"), F.col("hub_n").alias("n")).distinct()

    def members() -> DataFrame:
        """(sid, n, shared, comp) of the dense sets."""
        of = dense if roots is None else dense.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        return of.select("sid", "n", "shared", (F.col("sid") if roots is None else F.coalesce("root", "sid")).alias("comp"))

    def placed(name: str) -> DataFrame:
        """Entries (token, sid, n) with their set's partial component, its size, and `shared`."""
        of = scratch.save(members().drop("n"), f"of-{name}")
        sizes = of.groupBy("comp").agg(F.count("*").alias("size"), F.count("*").alias("rows"))
        rows = often.join(lookup(of, sizes, "comp", "rows", F.col("sid"), n_dense, n_dense), "sid")
        return scratch.save(rows.select("token", "sid", "n", "shared", "comp", "size"), f"placed-{name}")

    def split(rows: DataFrame, name: str, *more: Column) -> DataFrame:
        """(token, rows, ...) of the tokens that several components have."""
        ends = F.struct(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        of = rows.groupBy("token").agg(ends.alias("e"), F.count("*").alias("rows"), *more).where("e.lo <> e.hi").drop("e")
        return scratch.save(of, f"split-{name}")

    compared(rare.select("hub", "sid", "n"), own_hubs(rare), "rare")
    for r in range(STAR_ROUNDS):
        # first the set that shares most, likely the one the others derive from; then members of the largest component
        rank = F.struct("shared", "sid") if r == 0 else F.struct("size", F.xxhash64(F.lit(r), "sid"), "sid")
        rows = placed(str(r))
        centres = split(rows, str(r), F.max(F.struct(rank.alias("rank"), "sid", "comp", "n")).alias("c"))
        centres = centres.select("token", "rows", F.col("c.sid").alias("hub"), F.col("c.comp").alias("hub_comp"), F.col("c.n").alias("hub_n"))
        pairs = lookup(rows, centres, "token", "rows", F.col("sid"), n_often).where((F.col("comp") != F.col("hub_comp")) & _fits("n", "hub_n", "hub_n", percent))
        pairs = pairs.groupBy("hub", "sid").agg(F.first("hub_n").alias("hub_n"), F.first("n").alias("n"), F.count("*").alias("c")).where(F.col("c") >= _least_shared("n", "hub_n", percent))
        spokes = scratch.save(pairs.select("hub", "hub_n", "sid", "n"), f"spokes-{r}")
        some = compared(spokes.select("hub", "sid", "n"), own_hubs(spokes), f"star-{r}")
        scratch.drop(f"placed-{r}", f"of-{r}", f"split-{r}", f"spokes-{r}")
        if not some:
            break

    rows = placed("all")
    rows = scratch.save(lookup(rows, split(rows, "all"), "token", "rows", F.col("sid"), n_often), "open")
    cross = _cross(rows, percent, scratch)
    # the bound is least for the sizes farthest from n, none beyond what can link; rounding may take one more off between
    lo, hi = F.greatest("least", F.expr(f"({percent} * n + 99) div 100")), F.least("most", F.expr(f"100 * n div {percent}"))
    cross = cross.withColumns({"lo": lo, "hi": hi}).where(F.col("c") >= F.least(_least_shared("n", "lo", percent), _least_shared("n", "hi", percent)) - 1)
    spokes = scratch.save(cross.select("hub", "sid", "n"), "spokes")
    hubs = members().select(F.col("comp").alias("hub"), "sid", "n").join(spokes.select("hub").distinct(), "hub", "left_semi")
    compared(spokes, hubs, "cross")
    scratch.drop("rare", "often", "dense", "live", "sets", "placed-all", "of-all", "split-all", "open", "spokes", "sides", "tokens", "few", "crowds", "listed", "hubs")
    return roots


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; the set holds the distinct
    `k`-word shingles, or the whole sequence where there are fewer words. Two rows
    link when 100 * intersection >= `percent` * union; component_id is the least
    key that links reach, the row's own included. Null and empty texts, and texts
    without words, have no shingles and link with nothing. Repeated rows come back
    as often as they came. A null key counts as no key: such a row takes the least
    key it reaches, null if there is none. Shingles are compared by 64-bit hashes,
    and a set goes by 64 bits too.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    base = scratch.save(_describe(rows, k), "base")
    sums = base.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("rows")).first()
    roots = _join(rows.select("text"), k, percent, sums.n, scratch) if sums.n else None
    least = base.where("n > 0").groupBy("sid").agg(F.min("key").alias("component_id"), F.count("*").alias("rows"))
    if roots is not None:
        rooted = least.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        rooted = scratch.save(rooted.withColumnRenamed("component_id", "least"), "rooted")
        tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
        least = lookup(rooted, tops, "root", "members", F.col("sid"), sums.rows, rooted.count()).select("sid", "component_id", "rows")
    least = scratch.save(least, "least")
    filled, empty = base.where("n > 0"), base.where("n = 0")
    # copies go by their key as well, as a set may be that of very many rows
    out = lookup(filled, least, "sid", "rows", F.struct("key", "n"), sums.rows or 0).select("key", "n", "component_id").union(empty.select("key", "n", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
