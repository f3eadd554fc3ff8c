"""URL filtering by rules, and by a ratio of character language models elsewhere.

Rules name a host, with its subdomains, and a path prefix; the longest that fits
decides. URLs that a rule accepts and URLs that one rejects train two smoothed
variable-order Markov models of bytes: the chance of a byte after its last k bytes
interpolates the count at order k with the chance at order k - 1, and contexts never
seen leave the lower order as it is. Every labelled URL is counted, except one in ten,
by hash, that is held out. On these the threshold on the length-normalised
log-likelihood difference is calibrated: the best mean of both classes' accuracies,
from a histogram of scores.

A cell is a byte with the ORDERS - 1 bytes before it, packed exactly into a long. Counts
are a distributed table of cells that grows with the corpus; the counts of lower orders
are its sums. URLs to be scored go in blocks; the distinct cells of a block meet the
table once, shuffled by the last two bytes of the context, within which orders from 2 on
are summed. Orders 0 and 1 have 257 * 256 cells at most and go along with the plan.

Edge cases: a null url, or one without ://, has an empty host and path and is allowed,
as nothing speaks against it; without labels of both kinds every unruled url is
allowed; URLs are read whole; repeated rows are judged alike; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C
from tarnkit.llm.decontaminate import LOWER, UPPER
from tarnkit.llm.near_join import whole_groups

ORDERS, ALPHA = 5, 2.0
BINS, BIN = 400, 0.02
RUN = 1 << 18
# (action, host and path): the rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """pages (page_id, url) with host, path, rule and action of the rule."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    out = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
    out = out.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    out = out.select("page_id", "url", "rest", F.translate("raw", UPPER, LOWER).alias("host"), F.regexp_extract(F.col("rest").substr(F.length("raw") + 1, F.length("rest")), "^[^?#]*", 0).alias("path"))

    def fits(rule: str) -> Column:
        host, _, path = rule.partition("/")
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)

    hit = F.coalesce(*(F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))) for action, rule in sorted(rules, key=lambda r: -len(r[1]))))
    return out.withColumn("hit", hit).select("page_id", "url", "rest", "host", "path", "hit.rule", "hit.action")


def cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The cell of each byte: the byte, and above it 9 bits for each byte before, 0 where the row starts."""
    first = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(data))
    out = data.astype(np.int64)
    for k in range(1, ORDERS):
        out |= np.where(at - k >= first, data[np.maximum(at - k, 0)].astype(np.int64) + 1, 0) << (9 * k - 1)
    return out


def _in_blocks(urls: DataFrame) -> DataFrame:
    """urls with block: a number for each run of about RUN bytes."""
    place = urls.columns.index("rest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = C.column_bytes(batch.column(place))
            for i, j in C.runs(offsets, RUN):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(np.full(j - i, number, np.int64))], [*batch.schema.names, "block"])
                number += 1

    return C.staged(urls.mapInArrow(work, f"{_schema(urls)}, block long"), "urls")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _counted(labelled: DataFrame) -> DataFrame:
    """cell, accepted, rejected: exact counts of all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accepted = np.array(batch.column(1).to_pylist(), object) == "allow"
            data, offsets = C.column_bytes(batch.column(0))
            for i, j in C.runs(offsets, RUN):
                part = offsets[i : j + 1] - offsets[i]
                cell, where = np.unique(cells(data[offsets[i] : offsets[j]], part), return_inverse=True)
                yes = np.bincount(where, weights=np.repeat(accepted[i:j], np.diff(part)), minlength=len(cell)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(yes), pa.array(np.bincount(where, minlength=len(cell)).astype(np.int64) - yes)], ["cell", "accepted", "rejected"])

    each = labelled.select("rest", "action").mapInArrow(work, "cell long, accepted long, rejected long")
    return each.groupBy("cell").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


class Ratio:
    """Two models: a table of cells with their counts of both classes."""

    def __init__(self, counts: DataFrame) -> None:
        self.counts = counts
        self.held_out: float | None = None  # the mean of both classes' accuracies on the URLs held out
        self.low = np.zeros((2, 257, 256))
        pair = F.col("cell").bitwiseAND((1 << 17) - 1)
        for r in counts.groupBy(pair.alias("pair")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).collect():  # at most 257 * 256 rows
            self.low[:, r.pair >> 8, r.pair & 255] = r.accepted, r.rejected

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-likelihood difference a byte, accepted less rejected."""
        rows = [(k, bytes(data[a:b]).decode("utf-8", "surrogateescape")) for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
        found = self.scored(self.counts.sparkSession.createDataFrame(rows, "at long, rest string"))
        return np.array([r.score for r in found.orderBy("at").collect()])

    def scored(self, urls: DataFrame) -> DataFrame:
        """urls (with rest) with score: the mean log-likelihood difference a byte, 0 if empty."""
        blocked = _in_blocks(urls)
        pairs = C.staged(_block_cells(blocked), "cells")
        none = F.lit(0).cast("long")
        every = self.counts.unionByName(pairs.select("cell").distinct().select("cell", none.alias("accepted"), none.alias("rejected")))
        every = every.groupBy("cell").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), (F.count("*") > F.count_if(F.col("accepted") + F.col("rejected") > 0)).alias("asked"))
        near = every.withColumn("near", F.shiftright("cell", 8).bitwiseAND((1 << 18) - 1)).repartition("near").sortWithinPartitions("near")
        known = pairs.join(self._ratios(near), "cell").select("block", "cell", "ratio")
        rows = blocked.withColumns({"cell": F.lit(None).cast("long"), "ratio": F.lit(None).cast("double")})
        whole = rows.unionByName(known, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")
        names = urls.columns

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, at in whole_groups(batches, ["block"]):
                for a, b in zip(at[:-1], at[1:], strict=True):
                    part = table.slice(a, b - a)
                    told = part.filter(part.column("cell").is_valid())
                    mine = part.filter(part.column("cell").is_null()).combine_chunks()
                    key, ratio = told.column("cell").to_numpy(), told.column("ratio").to_numpy()
                    order = np.argsort(key)
                    key, ratio = key[order], ratio[order]
                    data, offsets = C.column_bytes(mine.column("rest"))
                    sums = np.concatenate([[0.0], np.cumsum(ratio[np.searchsorted(key, cells(data, offsets))])]) if len(data) else np.zeros(1)
                    score = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
                    for batch in mine.select(names).append_column("score", pa.array(score, pa.float64())).to_batches():
                        yield batch

        return whole.mapInArrow(work, f"{_schema(urls)}, score double")

    def _ratios(self, near: DataFrame) -> DataFrame:
        """cell and ratio of the cells that are asked for; near: the last two bytes of the context."""
        low = self.low

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, _ in whole_groups(batches, ["near"]):
                cell, asked = table.column("cell").to_numpy(), table.column("asked").to_numpy()
                byte, last = cell & 255, cell >> 8 & 511
                keys = [np.unique(cell & (1 << 9 * k + 8) - 1, return_inverse=True)[1] for k in range(2, ORDERS)]
                outer = [np.unique((cell & (1 << 9 * k + 8) - 1) >> 8, return_inverse=True)[1] for k in range(2, ORDERS)]
                logs = []
                for c, name in enumerate(("accepted", "rejected")):
                    n = table.column(name).to_numpy()
                    p = (low[c].sum(0)[byte] + ALPHA / 256) / (low[c].sum() + ALPHA)
                    p = (low[c][last, byte] + ALPHA * p) / (low[c].sum(1)[last] + ALPHA)
                    for both, alone in zip(keys, outer, strict=True):
                        p = (np.bincount(both, weights=n)[both] + ALPHA * p) / (np.bincount(alone, weights=n)[alone] + ALPHA)
                    logs.append(np.log(p))
                yield pa.RecordBatch.from_arrays([pa.array(cell[asked]), pa.array((logs[0] - logs[1])[asked])], ["cell", "ratio"])

        return near.select("cell", "accepted", "rejected", "asked", "near").mapInArrow(work, "cell long, ratio double")


def _block_cells(blocked: DataFrame) -> DataFrame:
    """block and cell, once each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            data, offsets = C.column_bytes(batch.column(1))
            cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                cell = np.unique(cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), block[i])), pa.array(cell)], ["block", "cell"])

    return blocked.select("block", "rest").mapInArrow(work, "block long, cell long")


def train(labelled: DataFrame) -> tuple[Ratio | None, float]:
    """labelled: rest, action. The models and the calibrated threshold."""
    split = labelled.withColumn("held", F.pmod(F.xxhash64("rest"), F.lit(10)) == 0)
    model = Ratio(C.staged(_counted(split.where("not held")), "counts"))
    if not model.low.any((1, 2)).all():
        return None, 0.0
    scores = model.scored(split.where("held").select("rest", "action"))
    slot = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("score") / BIN) + BINS // 2)) + F.when(F.col("action") == "allow", BINS).otherwise(0)
    held = np.zeros(2 * BINS)
    for r in scores.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect():
        held[r.slot] = r.n
    rejected, accepted = held.reshape(2, BINS)
    if not (rejected.any() and accepted.any()):
        return model, 0.0
    cut = np.concatenate([[0], np.cumsum(rejected)])[:-1] / rejected.sum() + np.cumsum(accepted[::-1])[::-1] / accepted.sum()
    best = np.flatnonzero(cut == cut.max())
    model.held_out = float(cut.max()) / 2
    return model, float((best[len(best) // 2] - BINS // 2) * BIN)


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides)."""
    ruled = with_rule(pages, rules).select("page_id", "rest", "host", "path", "rule", "action")
    model, threshold = train(ruled.where("action is not null").select("rest", "action"))
    left = ruled.where("action is null")
    scored = model.scored(left) if model else left.withColumn("score", F.lit(0.0))
    fits = F.lit(True) if model is None else (F.col("rest") == "") | (F.col("score") >= threshold)
    judged = scored.withColumn("verdict", F.when(fits, "allow").otherwise("block"))
    done = ruled.where("action is not null").withColumns({"verdict": F.col("action"), "score": F.lit(None).cast("double")})
    return done.unionByName(judged).select("page_id", "host", "path", "rule", "verdict", "score")
