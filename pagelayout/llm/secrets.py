"""Secret scans with an incremental ledger of blobs.

Every version of every path has a content address (SHA-256). The ledger says
which (blob, rule version) pairs were scanned and what was found; a scan reads
only blobs that the ledger lacks, each once however many paths hold it, and
joins findings back to all paths. All of it is DataFrame expressions.

Addresses and keys are exchanged, texts are not, as long as a list of either what
is to be scanned or what isn't is short enough to be sent to all executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import free_name
from .store import Scratch

SPAN = "array<struct<start:int,kind_order:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping; kept where `group` has `least` characters.

    `needs` is a cheaper pattern that every text with a kept match also matches.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str | None = None


def _any_case(word: str) -> str:
    """Letters in either case; written out, as case-insensitive matching differs between regex engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
#: The kinds in the contract's order. Runs of a fixed class are matched from the
#: least length on: a shorter run holds no match, and the class alone ends a run.
RULES = (
    Rule("assign", f"({_NAMES}){_GLUE}([A-Za-z0-9+/_.=-]+)", group=2, least=12, needs=f"(?:{_NAMES}){_GLUE}[A-Za-z0-9+/_.=-]{{12}}"),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Findings (some hundred bytes each) that are sent to all executors rather than joined by an exchange of the versions.
SMALL_SPANS = 200_000
#: Addresses (some hundred bytes each) that are sent to all executors, to tell what is scanned, rather than joined by an exchange.
SMALL_BLOBS = 300_000
#: A blob of as many versions is joined by sending its findings, so at most one in as many versions' blobs is sent.
HOT_COPIES = 10_000
#: Matches that are folded together; blocks of them are then shifted.
BLOCK_SPANS = 256


def rules_version(rules: tuple[Rule, ...]) -> str:
    """Half of the ledger's key: a digest of the rules themselves, so that it changes whenever one does."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _blocks(array: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of each run of BLOCK_SPANS elements."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(array) - 1), F.lit(BLOCK_SPANS))
    return F.transform(starts, lambda a: f(F.slice(array, a + 1, F.lit(BLOCK_SPANS))))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans (code points, end exclusive) of a rule's kept matches in a text without nulls.

    The text is split at the matches; starts are running sums of the lengths of
    gaps and matches, within blocks of matches and then over the blocks.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    parts = F.transform(F.arrays_zip(matches.alias("m"), judged.alias("g"), gaps.alias("gap")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        # the text after the last match is a gap without a match
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["m"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.coalesce(x["g"] >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def joined(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        pairs = F.arrays_zip(blocks.alias("b"), F.slice(offsets, 1, F.size(blocks)).alias("at"))

        def shifted(p: Column) -> Column:
            return F.transform(p["b"]["found"], lambda x: F.struct((x["start"] + p["at"]).alias("start"), x["kind_order"].alias("kind_order"), x["kind"].alias("kind"), (x["end"] + p["at"]).alias("end")))

        return F.flatten(F.transform(pairs, shifted))

    found = _with(_with(parts, lambda p: _blocks(p, lambda block: F.aggregate(block, zero, step))), joined)
    return F.when(text.rlike(rule.needs or rule.pattern), found).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' spans, by start and then by the rules' order."""
    return F.array_sort(F.concat(*(rule_spans(F.col(text), r, i) for i, r in enumerate(rules))))


def _addressed(versions: DataFrame, text: str, key: tuple[str, ...]) -> DataFrame:
    """(blob, at, content): address, the key as one value, and text of every version."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    at = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    return versions.select(F.sha2(content, 256).alias("blob"), at.alias("at"), content.alias("content"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None, scratch: Scratch, text: str = "text", key: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, rule_version: str | None = None, small: int = SMALL_BLOBS) -> tuple[DataFrame, DataFrame]:
    """(entries, blobs): the entries (blob, rule_version, spans) that the ledger lacks for `versions`, and (blob, at, copies) of all.

    A null text is the empty blob. Of the versions of a blob, the one of the least
    `key` is scanned (all of them where they share that key, into one entry).
    """
    version = rule_version or rules_version(rules)
    rows = _addressed(versions, text, key)
    blobs = scratch.save(rows.groupBy("blob").agg(F.min("at").alias("at"), F.count("*").alias("copies")), "blobs")
    todo = blobs.select("blob", "at", "copies", F.lit(False).alias("known"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version).select("blob").distinct().withColumn("seen", F.lit(True))
        todo = scratch.save(blobs.join(seen, "blob", "left").select("blob", "at", "copies", F.col("seen").isNotNull().alias("known")), "todo")
    size = todo.agg(F.count(F.when(~F.col("known"), 1)).alias("scanned"), F.count(F.when(F.col("known") | (F.col("copies") > 1), 1)).alias("other")).first()
    mine = F.col("at").eqNullSafe(F.col("_at"))
    chosen = todo.where("NOT known").select(F.col("blob").alias("_blob"), F.col("at").alias("_at"))
    if size.other <= min(small, size.scanned):
        # all but a few blobs are scanned: who isn't alone, or is known, is looked up
        other = todo.where("known OR copies > 1").select(F.col("blob").alias("_blob"), F.col("at").alias("_at"), "known")
        rows = rows.join(F.broadcast(other), F.col("blob") == F.col("_blob"), "left").where(F.col("_blob").isNull() | (~F.col("known") & mine))
    else:
        # few are scanned, or texts have to be exchanged; copies then go by their keys as well
        rows = rows.join(F.broadcast(chosen) if size.scanned <= small else chosen, (F.col("blob") == F.col("_blob")) & mine)
    entries = rows.select("blob", scan(rows, "content", rules).alias("spans")).groupBy("blob").agg(F.first("spans").alias("spans"))
    return entries.select("blob", F.lit(version).alias("rule_version"), "spans"), blobs


def scan_versions(versions: DataFrame, ledger: str | None = None, text: str = "text", name: str = "secrets", key: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, rule_version: str | None = None, small_blobs: int = SMALL_BLOBS, small_spans: int = SMALL_SPANS, hot_copies: int = HOT_COPIES) -> DataFrame:
    """`versions` (any columns: path, version, ...) with `name`, the array of spans found in `text`.

    `key` names the columns that tell versions apart; versions of one key and blob are
    each scanned. `ledger` is the path of a Parquet table with columns blob,
    rule_version and spans, which may not exist yet; only blobs that it lacks are read
    by the rules, and their entries are appended to it before findings are joined
    back. Entries go by a digest of `rules` unless `rule_version` names another; an
    entry that is there twice (two scans at once, a task that was repeated) counts
    once. A scan that is cut off loses at most its own entries; one run twice finds
    nothing new. Without a path the ledger is a table of this call. Null and empty
    texts have no spans; an empty table gives no rows. Rows come back as often as they
    came, whatever copies there are, and null keys are keys like any other.
    """
    spark = versions.sparkSession
    scratch = Scratch(spark, "secrets")
    ledger = ledger or f"{scratch.root}/ledger"
    version = rule_version or rules_version(rules)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    schema = f"blob string, rule_version string, spans {SPAN}"
    known = spark.read.schema(schema).parquet(ledger) if there else None
    entries, blobs = update_ledger(versions, known, scratch, text, key, rules, version, small_blobs)
    entries.write.mode("append").parquet(ledger)
    scratch.drop("todo")
    entries = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == version)
    # blobs without findings need no partner: most paths then meet nothing
    found = entries.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    if there:
        found = found.groupBy("_blob").agg(F.first("_spans").alias("_spans")).join(blobs.select(F.col("blob").alias("_blob")), "_blob", "left_semi")
        found = scratch.save(found, "found")
    out, own = free_name(versions, name), free_name(versions, "_content")
    keyed = versions.withColumn(own, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    size = found.agg(F.sum(F.size("_spans") + 1)).first()[0] or 0
    on = F.col(own) == F.col("_blob")
    if size <= small_spans:
        joined = keyed.join(F.broadcast(found), on, "left")
    else:
        # what many versions share is sent, found or not; an exchange then meets few copies of any blob
        hot = scratch.save(blobs.where(F.col("copies") >= hot_copies).select(F.col("blob").alias("_blob")).join(found, "_blob", "left"), "hot")
        cold = keyed.join(F.broadcast(hot.select("_blob")), on, "left_anti")
        joined = keyed.join(F.broadcast(hot), on).unionByName(cold.join(found, on, "left"))
    return joined.withColumn(out, F.coalesce(F.col("_spans"), F.array().cast(SPAN))).drop("_blob", "_spans", own)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by `mark`; overlapping spans by one.

    A null text stays null, as does one without spans. Spans are by start, as found;
    each block of them works on its own part of the text.
    """
    ends = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))

    def step(seg: Column, base: Column):
        def one(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            gap = F.substring(seg, acc["at"] - base + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            grown = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown.alias("out"))

        return one

    def cleaned(blocks: Column) -> Column:
        # where each block begins: the greatest end before it
        reach = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), ends(b)))))

        def part(p: Column) -> Column:
            seg = F.substring(text, p["at"] + 1, F.greatest(F.lit(0), ends(p["b"]) - p["at"]))
            return _with(seg, lambda x: F.aggregate(p["b"], F.struct(p["at"].alias("at"), F.lit("").alias("out")), step(x, p["at"]))["out"])

        def whole(r: Column) -> Column:
            pairs = F.arrays_zip(blocks.alias("b"), F.slice(r, 1, F.size(blocks)).alias("at"))
            return F.concat(F.array_join(F.transform(pairs, part), ""), F.substring(text, F.element_at(r, -1) + 1, F.length(text)))

        return _with(reach, whole)

    return F.when(F.size(spans) > 0, _with(_blocks(spans, lambda b: b), cleaned)).otherwise(text)
