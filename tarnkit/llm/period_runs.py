"""Runs of words that repeat with a period: found, reported, and collapsed to their first period.

A run is a longest stretch with smallest period q and at least LEAST words and EXPONENT
periods. It starts at i with its two suffixes i and i+q in one class of the suffixes
that share length-q words, and next to each other there: no suffix between them shares as
much, as q is the smallest period. So the classes are built as Kruskal builds a forest:
neighbours in the suffix array are united by decreasing common prefix, with union-find
over ordered sets of positions, the smaller set going into the larger. Positions that
become neighbours in a set at a distance within the common prefix seed a run; the seed at
the run's own start, where the word before breaks the period, gives it exactly once.

A run within the limits has two suffixes with 16 words in common (depth_of), so only texts
in which some 16 words occur twice, by a hash, get a suffix array (refined by
Larsson-Sadakane, prefixes by Kasai, over exact codes of the words), and no shorter
prefix is united. Texts are worked on one by one and in whole, inside the task
that read them; nothing is shuffled.

Edge cases: null and empty texts have no words and no runs; texts are worked on whole, a long
one costs n log n; repeated rows give repeated results; rows without a doc_id are treated
like others, but plant_repeats leaves them as they are; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C
from tarnkit.llm.suffix_dedup import larsson_sadakane

LEAST, EXPONENT = 24, 3
BLOCK = 512  # positions of a block of an ordered set
RUN = "struct<start: bigint, length: bigint, period: bigint>"
WORD = r"[^\x20\x09-\x0D]+"


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves few of them."""

    def __init__(self, position: int) -> None:
        self.blocks, self.size = [[position]], 1

    def _block(self, x: int) -> int:
        """The last block that starts at or before x, or the first."""
        low, high = 0, len(self.blocks) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.blocks[mid][0] <= x else (low, mid - 1)
        return low

    def add(self, x: int) -> None:
        self.size += 1
        b = self._block(x)
        block = self.blocks[b]
        insort(block, x)
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]

    def beside(self, x: int) -> tuple[int, int]:
        """The positions before and after x, which is in; -1 where there is none."""
        blocks, b = self.blocks, self._block(x)
        block = blocks[b]
        at = bisect_left(block, x)
        before = block[at - 1] if at else blocks[b - 1][-1] if b else -1
        after = block[at + 1] if at + 1 < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else -1
        return before, after

    def __iter__(self) -> Iterator[int]:
        return (x for block in self.blocks for x in block)


def kasai(code: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of each suffix in order with the one before it, 0 where below depth.

    Only neighbours whose first depth words agree are walked along."""
    n = len(code)
    common = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    near = np.flatnonzero((before >= 0) & (np.arange(n) + depth <= n) & (before + depth <= n))
    for k in range(depth):
        near = near[code[near + k] == code[before[near] + k]]
    words, h, last = code.tolist(), 0, -2
    for i in near.tolist():
        h = max(h - (i - last), depth) if h else depth
        j, last = int(before[i]), i
        end = n - max(i, j)
        while h < end and words[i + h] == words[j + h]:
            h += 1
        common[rank[i]] = h
    return common


def runs_of(code: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, given as codes of its words, by start, then period."""
    depth, n = depth_of(least, exponent), len(code)
    if n < least:
        return []
    order, rank = larsson_sadakane(code, 1)
    common = kasai(code, order, rank, depth)
    edges = np.flatnonzero(common >= depth)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    root: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    words, found = code.tolist(), set()

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def seeds(placed: list[int], lcp: int) -> None:
        """Runs that start where two positions became neighbours by the unions of one level; two that were
        so before have a longer prefix in common."""
        for x in placed:
            before, after = sets[find(x)].beside(x)
            for i, j in ((before, x), (x, after)):
                q = j - i
                if 0 <= i < j and q * (exponent - 1) <= lcp and lcp + q >= least and (i == 0 or words[i - 1] != words[j - 1]) and (j + lcp == n or words[i + lcp] != words[j + lcp]):
                    found.add((i, lcp + q, q))

    level, placed = 0, []
    for a, b, lcp in zip(order[edges - 1].tolist(), order[edges].tolist(), common[edges].tolist(), strict=True):
        if lcp != level:
            seeds(placed, level)
            level, placed = lcp, []
        a, b = find(a), find(b)
        one, two = sets.get(a) or Positions(a), sets.get(b) or Positions(b)
        if one.size < two.size:
            a, b, one, two = b, a, two, one
        root[b] = a
        sets[a] = one
        sets.pop(b, None)
        for x in two:
            one.add(x)
            placed.append(x)
    seeds(placed, level)
    return sorted(found, key=lambda r: (r[0], r[2]))


def depth_of(least: int, exponent: int) -> int:
    """A run of length L and period q has two suffixes with L - q words in common: at least this many."""
    return max(1, least - least // exponent)


def with_repeats(code: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Which rows may hold depth words twice: all that do, and by chance another."""
    n = len(code)
    if n < depth:
        return np.zeros(len(at) - 1, bool)
    window = C.mix(code.astype(np.uint64) + np.uint64(1))
    have, made = 1, window
    while have < depth:  # windows of twice the words, the last step of as many as are wanted
        step = min(have, depth - have)
        made = C.mix(made[: len(made) - step] * np.uint64(C.BASE) + made[step:])
        have += step
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(made)]
    inside = np.arange(len(made)) + depth <= at[row + 1]
    row, made = row[inside], made[inside]
    keys = C.mix(made ^ C.mix(row.astype(np.uint64)))
    turn = np.argsort(keys)
    same = np.flatnonzero(keys[turn][1:] == keys[turn][:-1])
    flag = np.zeros(len(at) - 1, bool)
    flag[row[turn[same]]] = True
    return flag


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs and the text collapsed, of each whole text of docs (doc_id, text)."""
    depth = depth_of(least, exponent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.column_bytes(batch.column(1))
            for i, j in C.runs(offsets):
                words = [data[a:b].tobytes().split() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                table = defaultdict(count().__next__)
                code = np.fromiter(map(table.__getitem__, chain.from_iterable(words)), np.int64, int(at[-1]))
                runs: list[list] = [[] for _ in words]
                for k in np.flatnonzero(with_repeats(code, at, depth)):
                    runs[k] = runs_of(code[at[k] : at[k + 1]], least, exponent)
                columns = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
                ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(columns[:, c])) for c in range(3)], ["start", "length", "period"]))
                texts = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), listed, texts], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")


def greatest_run(runs: Column) -> Column:
    """The run of the greatest exact length/period; ties go to the smaller start, then period."""
    more = lambda x, y: x["length"].cast("decimal(19,0)") * y["period"] - y["length"].cast("decimal(19,0)") * x["period"]
    first = lambda x, y: C.let(more(x, y), lambda m: (m > 0) | ((m == 0) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))))
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(best.isNull() | first(x, best), x).otherwise(best))


def plant_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeats planted in the texts that a checksum of doc_id picks, one of ten.

    Such a text's words from a on become a's next p words over and over. Rows without a
    doc_id or words, and all other texts, stay as they are."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(checksum / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        return C.let(F.pmod(g, n), lambda a: C.let(1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))), lambda p: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    changed = C.let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.col("text")))
    return docs.withColumn("text", F.when(F.pmod(checksum, F.lit(10)) == 0, changed).otherwise(F.col("text")))


def run_report(docs: DataFrame) -> DataFrame:
    """A document's number of runs, its greatest one, and the digests of all runs and of the collapsed text."""
    best = greatest_run(F.col("runs"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    found = find_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
