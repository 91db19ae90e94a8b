import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelayout.llm import components, decontaminate, jaccard_join, lookup, sharding
from pagelayout.llm.store import Scratch

DOCS = "doc_id long, text string"


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, n=120):
    """Random texts, copies, edited copies in chains, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Just three words"), (1004, "just THREE  words")]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 or not i:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80)))
        elif kind < 0.6:
            text = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))
        else:
            words = (rng.choice(rows)[1] or "").split() or ["a", "b"]
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        # every path: nearly all shared tokens frequent, every posting crowded
        monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
        monkeypatch.setattr(jaccard_join, "CROWD", 2)
        monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 200)
        monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    rows = corpus(seed)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


@pytest.mark.parametrize("rounds,most_hot", [(0, 3), (1, 3), (2, 10**6)])
def test_a_passage_in_every_text(spark, monkeypatch, rounds, most_hot):
    # every token of the passage is hot; with small cells each way to spread it is taken
    for name, value in (("FREQUENT", 3), ("CROWD", 2), ("BLOCK_TOKENS", 100), ("STAR_ROUNDS", rounds), ("CELL", 2), ("SMALL_CELL", 50), ("FEW_CELLS", 2), ("CELL_TOKENS", 100), ("MAX_FREQUENT", 20)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(lookup, "HOT_ROWS", 2)
    monkeypatch.setattr(lookup, "MOST_HOT", most_hot)
    if rounds == 1:
        monkeypatch.setattr(components.connected_components, "__defaults__", (0,))
    rng = random.Random(rounds)
    passage = " ".join(f"p{i}" for i in range(40))
    other = [f"w{i}" for i in range(30)]
    rows = [(i, f"{passage} " + " ".join(rng.choice(other) for _ in range(rng.randrange(0, 30)))) for i in range(90)]
    rows += [(200 + i, " ".join([*passage.split()[: 20 + i % 20], rng.choice(other)])) for i in range(40)] + [(300 + i, rows[i % 3][1]) for i in range(30)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_sizes_bound_the_cells(spark):
    # sets link only within neighbouring bands of size
    pairs = spark.createDataFrame([(n, m) for n in range(1, 400) for m in range(n, 4 * n // 3 + 1)], "n int, m int")
    log = np.log(100 / 75)
    lo, hi, own = F.floor(F.log(F.col("n").cast("double")) / log - 1 - 1e-9), F.floor(F.log(F.col("n").cast("double")) / log + 1 + 1e-9), F.floor(F.log(F.col("m").cast("double")) / log)
    assert pairs.where(~own.between(lo, hi)).count() == 0


@pytest.mark.parametrize("total,most", [(0, 3), (10, 3), (10**9, 3), (10**9, 10**6)])
def test_lookup_is_a_join(spark, monkeypatch, total, most):
    monkeypatch.setattr(lookup, "HOT_ROWS", 5)
    monkeypatch.setattr(lookup, "MOST_HOT", most)
    rows = spark.createDataFrame([(k, i, "old") for i, k in enumerate([1] * 20 + [2] * 3 + [3, None, 9])], "k long, i int, v string")
    table = spark.createDataFrame([(1, 20, "a"), (2, 3, None), (3, 1, "c"), (4, 0, "d")], "k long, w int, v string")
    found = lookup.lookup(rows, table, "k", "w", F.col("i"), total)
    assert found.columns == ["k", "i", "v"]
    assert sorted((r.k, r.i, r.v or "") for r in found.collect()) == sorted([(1, i, "a") for i in range(20)] + [(2, i, "") for i in (20, 21, 22)] + [(3, 23, "c")])


def test_join_odd_tables(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (7, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "sid": F.lit("x"), "token": F.lit(2)})
    found = sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert found == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (7, 0, 7)], key=str)


def test_similarity_at_the_threshold(spark):
    # 6 of 8 shingles in common link, 5 of 8 don't
    a = [f"a{i}" for i in range(11)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:10], "z"])), (3, " ".join(["y", *a[1:10], "z"]))]
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()) == brute(rows)


def test_least_shared_is_a_bound(spark):
    rng = np.random.default_rng(0)
    sizes = spark.createDataFrame([(n, m) for n in range(1, 60) for m in range(1, 60) if 4 * min(n, m) >= 3 * max(n, m)], "n int, m int")
    bound = {(r.n, r.m): r.c for r in sizes.withColumn("c", jaccard_join._least_shared("n", "m", 75)).collect()}
    for n, m in bound:
        need = -(-75 * (n + m) // 175)
        for _ in range(3):
            order = rng.permutation(n + m - need)
            x, y = np.sort(order[:n]), np.sort(np.concatenate([order[:need], order[n:]]))
            p, q = jaccard_join.prefix_length(n, 75), jaccard_join.prefix_length(m, 75)
            assert len(set(x[:p]) & set(y[:q])) >= bound[n, m]


@pytest.mark.parametrize("short", [0, 10**6])
def test_connected_components_of_a_long_chain_and_a_star(spark, short):
    links = [(i, i + 1) for i in range(0, 60)] + [(200 + i, 199) for i in range(1, 30)] + [(300, 300)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c", short)
    want = {i: 0 for i in range(61)} | {200 + i: 199 for i in range(1, 30)} | {199: 199}
    assert {r.node: r.root for r in found.collect()} == want


# decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(docs, items):
    out = []
    for doc, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for item, t in items:
            b = words_of(t)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1) if b else ():
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    ids.add(item)
        names = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((doc, len(w), len(hit), len(ids - {None}), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words,held", [(10**6, 0), (40, 1 << 20), (40, 300)])
def test_hits_equal_brute_force(spark, monkeypatch, block_words, held):
    monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
    rng = random.Random(3)
    words = [f"k{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 30])))) for i in range(12)]
    items += [(50, items[3][1].upper()), (60, ""), (61, None), (None, items[0][1])]
    docs = [(0, None), (1, ""), (2, "--- !!"), (3, items[7][1])]
    for i in range(4, 60):
        part = words_of(rng.choice(items)[1])
        a = rng.randrange(0, max(1, len(part) - 3))
        docs.append((i, " ".join([*(rng.choice(words) for _ in range(rng.randrange(0, 60))), *part[a : a + rng.randrange(1, 40)], "end", "aaa " * rng.randrange(0, 30)])))
    d, b = spark.createDataFrame(docs, DOCS).withColumn("found", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(d, b, name="found", block_words=block_words)
    assert found.columns == ["doc_id", "text", "found", "found_"]
    f = F.col("found_")
    got = found.select("doc_id", "found_.n_words", "found_.n_hit", F.size("found_.items"), F.sha2(F.concat_ws(",", "found_.items"), 256), decontaminate.contaminated(f)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(docs, items)


def test_no_benchmark_hits_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], DOCS)
    row = decontaminate.decontaminate(d, spark.createDataFrame([], "item_id long, text string")).first().contamination
    assert (row.n_words, row.n_hit, row["items"], row.hits) == (3, 0, [], [])


def test_every_long_shared_span_has_a_common_print():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 4, 13).astype(np.uint64)
        sides = [np.concatenate([rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(2)]
        prints = []
        for s in sides:
            g = decontaminate.grams(s, 5)
            prints.append(set(g[decontaminate.kept_positions(g, 9)].tolist()))
        assert prints[0] & prints[1]


# sharding


def brute_shards(rows, n):
    import zlib

    data = sorted(((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows))
    total, before, out, slots = sum(r[2] for r in data), 0, [], {}
    for has, d, size, crc in data:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((d if has else None, size, crc, "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


@pytest.mark.parametrize("range_rows", [7, 10**6])
def test_shards_equal_brute_force(spark, range_rows):
    rng = random.Random(9)
    rows = [(rng.randrange(80), "ü" * rng.randrange(60)) for _ in range(150)] + [(3, "same")] * 50 + [(None, None), (None, "x"), (500, "y" * 900)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS), 8, range_rows=range_rows).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_shards(rows, 8)


def test_sharding_an_empty_table(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_of_as_many_ranges_as_allowed(spark):
    rows = [(n * 7919 % 20011, "y" * (n % 23)) for n in range(sharding.MAX_RANGES)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS), 8, range_rows=1).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_shards(rows, 8)


def test_ranges_hold_nearly_equal_numbers_of_rows(spark):
    light = spark.range(40_000).select((F.col("id") % 7).alias("_key"), F.col("id").alias("size"), F.lit(0).alias("text_crc32"))
    order = light.columns
    bounds = sharding._bounds(light, order, 40, 40_000)
    ranges = light.withColumn("r", sharding._range_of(F.struct(*order), bounds)).groupBy("r").count().collect()
    # a key that many rows share is in several ranges
    assert 35 <= len(ranges) <= 41 and max(r["count"] for r in ranges) <= 3_000


def test_equal_rows_are_laid_out_in_pieces(spark):
    rows = [(1, "a")] * 3_000 + [(n, "b" * (n % 5)) for n in range(500)] + [(None, None)] * 700
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS), 8, range_rows=100, copies=64).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_shards(rows, 8)


def test_sharding_ignores_other_columns(spark):
    rows = [(n, "t" * n) for n in range(20)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "_range": F.lit(1), "shard": F.lit(None).cast("int"), "_KEY": F.lit(2)})
    assert sorted((tuple(r) for r in sharding.shard_by_bytes(docs).collect()), key=str) == brute_shards(rows, 8)
