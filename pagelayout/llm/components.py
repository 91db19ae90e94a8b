"""Connected components of a table of links: by alternating large and small stars, a short table in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .lookup import lookup
from .store import Scratch, prepare

#: Links (16 bytes each) that one task unites; a longer table goes through rounds of joins.
SHORT = 200_000
#: A round at least halves the longest chains; this many would serve any table.
MAX_ROUNDS = 100


def _united(edges: DataFrame) -> DataFrame:
    """(node, root), by union and find over all edges in one task."""

    def run(batches):
        parent: dict = {}

        def find(x):
            top = parent.setdefault(x, x)
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])

    schema = T.StructType([T.StructField("node", edges.schema["u"].dataType), T.StructField("root", edges.schema["u"].dataType)])
    kind = to_arrow_schema(schema).field(0).type
    return edges.repartition(1).mapInArrow(run, schema)


def connected_components(links: DataFrame, scratch: Scratch, name: str, short: int = SHORT) -> DataFrame:
    """(node, root) for every node of `links` (columns a and b, of one orderable type).

    The root is the least node reachable. Each round hooks neighbours to the least
    one they can see; it ends when a round changes nothing. No component is ever
    gathered in one task: minima are aggregates, and hooking is a join on the node.
    Only a table of `short` links or fewer is united in one task, as rounds of joins
    would take longer to start than to run; the result is the same.
    """
    prepare(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if edges.count() <= short:
        return _united(edges)
    edges = edges.distinct()
    state, before = scratch.save(edges, f"{name}-0"), None
    total = state.count()
    for r in range(1, MAX_ROUNDS + 1):
        # large star: all greater neighbours go to the least of the neighbours and the node itself
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
        large = lookup(both.where("v > u"), least, "u", "degree", F.col("v"), 2 * total, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the lesser neighbours, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = lookup(large, low, "u", "degree", F.col("v"), 2 * total, 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{r}")
        scratch.drop(f"{name}-{r - 1}")
        now = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            break
        before, total = now, now.n
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
