"""URL filter: host and path rules, and gradient-boosted trees for the rest.

Features are lexical (lengths, depths, digit ratio, entropy, parameter counts)
and suffix statistics: how often labelled URLs under the host's last one and
two labels are blocked. Labelled URLs are those that a rule decides. The trees
are fitted on a bounded sample of them, with suffix statistics that leave out the
URL's own fold, and tried on a fold they haven't seen. They become one SQL
expression, so URLs are judged by expressions and one join, without Python on the
executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import free_name
from .folds import thinned
from .lookup import lookup
from .store import Scratch

#: Labelled URLs per verdict that the trees are fitted on, about.
SAMPLE_PER_VERDICT = 3_000
TREES, DEPTH, RATE, CUTS, LEAST_ROWS, RIDGE = 24, 3, 0.3, 16, 8, 1.0
#: Weight of the overall block rate in a suffix's rate, in URLs.
SMOOTHING = 20.0
#: Folds of URLs: trees are fitted on all but the first, and a URL they are fitted on has rates from the other folds.
FOLDS = 5

LEXICAL = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_parameters", "host_hyphens", "longest_label")
SUFFIX = ("rate_1", "rate_2", "log_seen_2")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty without `://` or for null."""
    plain = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(plain, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(plain, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[Rule], what: str = "name") -> Column:
    """Name (or verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def _count(text: Column, one: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    n = F.length(text)
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    spread = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + (n - F.length(F.replace(text, c, F.lit("")))) * F.log2((n - F.length(F.replace(text, c, F.lit("")))).cast("double")))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    columns = {
        "url_length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": _count(host, "."),
        "path_depth": _count(path, "/"),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(n, F.lit(1)),
        "entropy": F.when(n > 0, F.round(F.log2(n.cast("double")) - spread / n, 9)).otherwise(0.0),
        "n_parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "host_hyphens": _count(host, "-"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))),
    }
    return {k: c.cast("double").alias(k) for k, c in columns.items()}


@dataclass
class Node:
    value: float
    feature: str = ""
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def sql(self) -> str:
        if self.below is None or self.above is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {self.feature} <= {self.cut!r}D THEN {self.below.sql()} ELSE {self.above.sql()} END"

    def predict(self, row: dict) -> float:
        if self.below is None or self.above is None:
            return self.value
        return (self.below if row[self.feature] <= self.cut else self.above).predict(row)


@dataclass
class Model:
    base: float
    trees: list[Node] = field(default_factory=list)
    #: Labelled URLs the trees haven't seen, and how many of them they judge as the rules do.
    held_out: tuple[int, int] = (0, 0)

    def logit(self) -> Column:
        """The blocking score's log-odds, from columns named as the features."""
        return F.expr(" + ".join([f"{self.base!r}D", *(f"({t.sql()})" for t in self.trees)]))

    def predict(self, row: dict) -> float:
        return self.base + sum(t.predict(row) for t in self.trees)


def _grow(rows: list[dict], grads: list[float], curves: list[float], own: list[int], cuts: dict[str, list[float]], depth: int) -> Node:
    """A regression tree on gradients and second derivatives; the first best cut wins ties."""
    g, h = sum(grads[i] for i in own), sum(curves[i] for i in own)
    node = Node(-RATE * g / (h + RIDGE))
    if not depth or len(own) < 2 * LEAST_ROWS:
        return node
    best = (1e-9, "", 0.0)
    for name, edges in cuts.items():
        if not edges:
            continue
        # sums by bin: a bin holds what is above the edge before and not above its own
        sums = [[0, 0.0, 0.0] for _ in range(len(edges) + 1)]
        for i in own:
            s = sums[rows[i]["_bin"][name]]
            s[0] += 1
            s[1] += grads[i]
            s[2] += curves[i]
        n, a, b = 0, 0.0, 0.0
        for edge, (m, x, y) in zip(edges, sums, strict=False):
            n, a, b = n + m, a + x, b + y
            if LEAST_ROWS <= n <= len(own) - LEAST_ROWS:
                gain = a * a / (b + RIDGE) + (g - a) ** 2 / (h - b + RIDGE) - g * g / (h + RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, name, edge)
    if best[1]:
        _, node.feature, node.cut = best
        low = [i for i in own if rows[i][node.feature] <= node.cut]
        high = [i for i in own if rows[i][node.feature] > node.cut]
        node.below, node.above = (_grow(rows, grads, curves, x, cuts, depth - 1) for x in (low, high))
    return node


def fit(rows: list[dict], labels: list[int]) -> Model:
    """Boosted trees for the logistic loss; 1 is block. One label alone, or none, gives a constant."""
    n, blocked = len(labels), sum(labels)
    rate = (blocked + 0.5) / (n + 1)
    model = Model(math.log(rate / (1 - rate)))
    if not 0 < blocked < n:
        return model
    cuts = {}
    for name in (*LEXICAL, *SUFFIX):
        values = sorted(r[name] for r in rows)
        cuts[name] = sorted({values[len(values) * k // CUTS] for k in range(1, CUTS)} - {values[-1]})
    rows = [r | {"_bin": {name: sum(r[name] > e for e in edges) for name, edges in cuts.items()}} for r in rows]
    z = [model.base] * n
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-max(-40.0, min(40.0, x)))) for x in z]
        tree = _grow(rows, [a - y for a, y in zip(p, labels, strict=True)], [a * (1 - a) for a in p], list(range(n)), cuts, DEPTH)
        model.trees.append(tree)
        z = [a + tree.predict(r) for a, r in zip(z, rows, strict=True)]
    return model


def _featured(pages: DataFrame, key: str, url: str, rules: list[Rule]) -> DataFrame:
    """Key, host, path, rule, ruled verdict, suffixes, fold and lexical features; no other column of `pages`."""
    host, path = parts(F.col("_url"))
    df = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url")).select("_key", "_url", host.alias("host"), path.alias("path"))
    last = lambda n: F.substring_index("host", ".", -n).alias(f"_suffix_{n}")
    ruled = [matched_rule(F.col("host"), F.col("path"), rules, w).alias(c) for w, c in (("name", "rule"), ("verdict", "_ruled"))]
    # copies of a URL are in one fold
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_url"), F.lit(FOLDS)).cast("int").alias("_fold")
    return df.select("_key", "host", "path", *ruled, last(1), last(2), fold, *lexical(F.col("_url"), F.col("host"), F.col("path")).values())


def _label() -> Column:
    """1 where a rule blocks, 0 where one allows, else null."""
    return F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0)


def _suffixes(featured: DataFrame) -> DataFrame:
    """A row a two-label suffix: its URLs, and labelled and blocked ones by fold, of its last label's URLs too."""
    in_fold = lambda i, x: F.sum(F.when(F.col("_fold") == i, x).otherwise(0))
    lists = lambda x: F.array(*(in_fold(i, x) for i in range(FOLDS)))
    labelled, blocked = F.when(F.col("_ruled").isNotNull(), 1).otherwise(0), F.coalesce(F.when(F.col("_ruled") == "block", 1), F.lit(0))
    two = featured.groupBy("_suffix_2").agg(F.first("_suffix_1").alias("_suffix_1"), F.count("*").alias("urls"), lists(labelled).alias("seen_2"), lists(blocked).alias("blocked_2"))
    sums = lambda c: F.array(*(F.sum(F.get(c, i)) for i in range(FOLDS)))
    one = two.groupBy("_suffix_1").agg(F.count("*").alias("suffixes"), sums("seen_2").alias("seen_1"), sums("blocked_2").alias("blocked_1"))
    # there are no more suffixes than URLs
    n = featured.count()
    return lookup(two, one, "_suffix_1", "suffixes", F.col("_suffix_2"), n, n).drop("_suffix_1")


def _rates(df: DataFrame, seen: list[int], blocked: list[int], out_of_fold: bool) -> DataFrame:
    """Adds SUFFIX to rows joined with `_suffixes`; `out_of_fold` leaves the row's own fold out of all counts."""

    def total(c: Column) -> Column:
        whole = F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
        return whole - F.get(c, F.col("_fold")) if out_of_fold else whole

    constant = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    overall = total(constant(blocked)) / F.greatest(F.lit(1), total(constant(seen)))
    if not sum(seen):
        overall = F.lit(0.5)
    rates = {f"rate_{n}": F.round((total(F.col(f"blocked_{n}")) + SMOOTHING * overall) / (total(F.col(f"seen_{n}")) + SMOOTHING), 9) for n in (1, 2)}
    return df.withColumns(rates | {"log_seen_2": F.round(F.log1p(total(F.col("seen_2")).cast("double")), 9)})


def learn(featured: DataFrame, suffixes: DataFrame, per_verdict: int = SAMPLE_PER_VERDICT) -> tuple[Model, list[int], list[int]]:
    """(model, labelled URLs by fold, blocked ones by fold), from written `_featured` and `_suffixes`."""
    sums = suffixes.agg(*(F.sum(F.get(c, i)).alias(f"{c}{i}") for c in ("seen_2", "blocked_2") for i in range(FOLDS))).first()
    seen, blocked = ([sums[f"{c}{i}"] or 0 for i in range(FOLDS)] for c in ("seen_2", "blocked_2"))
    n, bad = sum(seen), sum(blocked)
    share = F.when(_label() == 1, min(1.0, per_verdict / max(1, bad))).otherwise(min(1.0, per_verdict / max(1, n - bad)))
    # about twice per_verdict rows: few enough to be sent, as are their suffixes
    some = thinned(featured.where(_label().isNotNull() & F.col("_key").isNotNull()), "_key", share)
    own = suffixes.join(F.broadcast(some.select("_suffix_2").distinct()), "_suffix_2", "left_semi")
    rows = _rates(some.join(F.broadcast(own), "_suffix_2"), seen, blocked, True)
    found = [r.asDict() for r in rows.select(_label().alias("_y"), "_fold", *LEXICAL, *SUFFIX).collect()]
    found.sort(key=lambda r: tuple(r.values()))
    tried, known = [r for r in found if r["_fold"] == 0], [r for r in found if r["_fold"] != 0]
    model = fit(known or tried, [r["_y"] for r in known or tried])
    # the sample holds verdicts in other shares than the labelled URLs
    drawn = sum(r["_y"] for r in known or tried)
    if 0 < bad < n and 0 < drawn < len(known or tried):
        model.base += math.log(bad / (n - bad)) - math.log(drawn / (len(known or tried) - drawn))
    model.held_out = (len(tried), sum((model.predict(r) >= 0) == (r["_y"] == 1) for r in tried)) if known else (0, 0)
    return model, seen, blocked


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", name: str = "judged", per_verdict: int = SAMPLE_PER_VERDICT, threshold: float = 0.5) -> DataFrame:
    """`key` and a struct `name`: host, path, rule, verdict, score (of blocking, by the trees).

    A rule's verdict stands; other URLs are blocked from `threshold` on. Rules of
    equal length go by name. A null or hostless URL has empty host and path and is
    judged like any other by its features. Without URLs of both verdicts the score
    is the share of blocked ones (a half without labels). Repeated rows stay, an empty
    table gives no rows, and other columns of `pages` are ignored, whatever their names.

    `pages` is read once; the features are written and read again. Suffix rates count
    every labelled URL; the trees see about `per_verdict` of each verdict, chosen by a
    hash of the key. `rules` is a list of the caller's, short enough to be part of the
    plan.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    df = scratch.save(_featured(pages, key, url, rules), "featured")
    suffixes = scratch.save(_suffixes(df), "suffixes")
    model, seen, blocked = learn(df, suffixes, per_verdict)
    df = _rates(lookup(df, suffixes, "_suffix_2", "urls", F.struct("_key", "path"), df.count()), seen, blocked, False)
    score = 1 / (1 + F.exp(-model.logit()))
    verdict = F.coalesce("_ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return df.withColumn("score", score).select(F.col("_key").alias(key), F.struct("host", "path", "rule", verdict.alias("verdict"), "score").alias(free_name(pages.select(key), name)))
