"""Secret scanning over a content-addressed ledger, with DataFrame functions alone.

A version is a text at a path. Its blob is the SHA-256 of the text, so all copies and
unchanged versions share one blob. The ledger holds a row for each blob and rule
version that has been scanned, with the spans found. A run hashes all versions,
anti-joins the blobs with the ledger, scans the texts of the unseen pairs alone (one
version stands for all copies of a blob) and joins the findings back to all paths.

Spans are in code points: a text is split at the matches of a rule, and the
lengths of the pieces and the matches add up to the places.

Edge cases: a null text is scanned as an empty one, and a null path is a path like
any other; texts are scanned whole;
repeated rows each get their result; an empty table gives an empty ledger and no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tarnkit.llm.common import let, shared_dir

SPAN = "array<struct<at:int,end:int>>"
GROUP = 256  # matches whose spans are listed in one fold, which copies its list at every step


@dataclass(frozen=True)
class Rule:
    """pattern is scanned leftmost and non-overlapping; a match whose group is
    shorter than least is dropped and not tried again. hint must occur in any match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""


RULES = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)


def found_spans(text: Column, rule: Rule) -> Column:
    """All spans of the rule in text, in order."""
    pattern = F.lit(rule.pattern)

    def places(got: Column) -> Column:
        pieces = F.split(text, rule.pattern, -1)
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        both = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(matches, F.length).alias("len"), F.transform(got, F.length).alias("own"))
        return let(both, lambda every: F.when(F.size(every) <= GROUP, spans_of(every, F.lit(0))).otherwise(in_groups(every)))

    def in_groups(every: Column) -> Column:
        """The same for many matches: groups by themselves, each from where those before it end."""
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / GROUP).cast("int")), lambda g: F.slice(every, g * GROUP + 1, GROUP))
        total = lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x["gap"] + F.coalesce(x["len"], F.lit(0)))
        starts = F.aggregate(groups, F.array(F.lit(0)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + total(g))))
        return let(groups, lambda gs: let(starts, lambda st: F.flatten(F.transform(gs, lambda g, i: spans_of(g, F.get(st, i))))))

    def spans_of(some: Column, base: Column) -> Column:
        start = F.struct(base.alias("to"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            at = a["to"] + x["gap"]
            end = at + F.coalesce(x["len"], F.lit(0))
            return F.struct(end.alias("to"), F.when(x["own"] >= rule.least, F.concat(a["out"], F.array(F.struct(at.alias("at"), end.alias("end"))))).otherwise(a["out"]).alias("out"))

        return F.aggregate(some, start, step, lambda a: a["out"])

    got = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    spans = let(got, lambda g: F.when(F.exists(g, lambda x: F.length(x) >= rule.least), places(g)).otherwise(F.array().cast(SPAN)))
    return F.when(text.contains(rule.hint), spans).otherwise(F.array().cast(SPAN)) if rule.hint else spans


def hashed(versions: DataFrame) -> DataFrame:
    return versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the pairs that ledger lacks.

    versions: path, text. A blob without findings gets rows too, so that it isn't
    scanned again. Of several rows with one path and blob one is scanned."""
    rule_table = versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    texts = hashed(versions)
    blobs = texts.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*(F.lit(r.kind) for r in rules))
    if ledger is None:
        todo = blobs.withColumn("kinds", every)
    else:
        seen = ledger.join(F.broadcast(rule_table), ["kind", "version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        todo = blobs.join(seen, "blob", "left").select("blob", "path", missing.alias("kinds")).where(F.size("kinds") > 0)
    same = (F.col("t.blob") == F.col("c.blob")) & F.col("t.path").eqNullSafe(F.col("c.path"))
    chosen = texts.alias("t").join(todo.alias("c").hint("shuffle_hash"), same).select("t.blob", "t.text", "c.kinds")
    scan = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("kinds", r.kind), found_spans(F.col("text"), r)).alias("spans")) for r in rules))
    rows = chosen.select("blob", F.explode(F.filter(scan, lambda x: x["spans"].isNotNull())).alias("x"))
    return rows.select("blob", "x.kind", "x.version", "x.spans")


class Ledger:
    """The ledger as a Parquet table that every run reads and appends to.

    What a run appends appears when it is complete, so a run that fails leaves the ledger
    as it was and can be made again."""

    SCHEMA = f"blob string, kind string, version int, spans {SPAN}, run string"

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame | None:
        """All rows, or None before the first run."""
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def run(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen, append it, and give the rows that were appended."""
        name = uuid.uuid4().hex
        scan_versions(versions, self.rows(), rules).withColumn("run", F.lit(name)).write.mode("append").partitionBy("run").parquet(self.folder)
        return self.rows().where(F.col("run") == name).drop("run")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and found (a map of kind to spans) of every version."""
    current = F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules])
    found = ledger.where(current & (F.size("spans") > 0)).groupBy("blob", "kind").agg(F.first("spans").alias("spans"))
    by_blob = found.groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("found"))
    return hashed(versions).select("path", "blob").join(by_blob, "blob", "left").select("path", "blob", "found")


def find_secrets(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, counts by kind, digest of the spans, and the spans, of each document.

    folder: of a ledger that earlier runs may have filled; one of its own by default."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    ledger = Ledger(docs.sparkSession, folder)
    ledger.run(versions)
    every = findings_by_path(versions, ledger.rows())
    kinds = [r.kind for r in RULES]
    none = F.array().cast(SPAN)
    spans = {k: F.coalesce(F.col("found")[k], none) for k in kinds}

    def numbered(k: str) -> Column:
        return F.transform(spans[k], lambda s: F.struct(s["at"].alias("at"), F.lit(kinds.index(k)).alias("k"), s["end"].alias("end")))

    listed = F.concat(*map(numbered, kinds))
    names = F.array(*map(F.lit, kinds))
    text = F.array_join(F.transform(F.array_sort(listed), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["at"], s["end"])), ",")
    out = every.select(F.col("path").alias("doc_id"), *(F.size(spans[k]).cast("long").alias(f"n_{k}") for k in kinds), text.alias("spans"), "blob")
    return out.withColumn("base_sha256", F.sha2("spans", 256))
