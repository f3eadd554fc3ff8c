"""Quality rules as a short-circuit cascade.

Each rule has a cost and a selectivity, both estimated on a sample (SAMPLE_ROWS
documents of each input split, where the task then stops reading): the seconds of the
features that no earlier rule has computed, and the share that it rejects of what earlier
rules keep. The rules run in the order of rejection per cost; each sees only the documents
that all earlier ones kept, and computes only the features it reads. The order changes
the cost, never the verdict: a document is kept if no rule rejects it. Words and lines are
compared by exact codes.

Edge cases: a null or empty text has no words and is rejected as too short; ties
and repeated rows are judged alike, row by row; an empty table gives an empty
result; further columns pass through filter_quality untouched whatever their
names and are ignored by judge_quality.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C

SAMPLE_ROWS = 64
SYMBOLS = b"#*$%&|<>"


class Texts:
    """Features of a run of texts, each computed when first asked for.

    seconds: what each took by itself, without the others that it asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.known = data, offsets, {}
        self.seconds: dict[str, float] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.known:
            began, others = time.perf_counter(), sum(self.seconds.values())
            self.known[name] = getattr(self, name)()
            self.seconds[name] = time.perf_counter() - began - (sum(self.seconds.values()) - others)
        return self.known[name]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        return C.word_spans(self.data, self.offsets)

    def word_offsets(self) -> np.ndarray:
        return np.searchsorted(self.get("spans")[0], self.offsets)

    def n_words(self) -> np.ndarray:
        return np.diff(self.get("word_offsets"))

    def word_chars(self) -> np.ndarray:
        return C.per_row(((self.data & 0xC0) != 0x80) & ~C.space_mask(self.data), self.offsets)

    def n_symbols(self) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(SYMBOLS)] = True
        return C.per_row(table[self.data], self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the lines with a word: the row and a code of its content."""
        breaks = np.flatnonzero(self.data == C.NEWLINE)
        begin = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        row = np.searchsorted(self.offsets[1:], breaks, "right")
        row = np.sort(np.concatenate([np.arange(len(self.offsets) - 1), row]), kind="stable")
        end = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        solid = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~C.space_mask(self.data), out=solid[1:])
        full = solid[end] > solid[begin]
        return row[full], C.span_codes(self.data, begin[full], end[full])[0]

    def n_lines(self) -> np.ndarray:
        return np.bincount(self.get("lines")[0], minlength=len(self.offsets) - 1)

    def n_dup_lines(self) -> np.ndarray:
        row, line = self.get("lines")
        again = C.later_copies(line * len(self.offsets) + row)
        return np.bincount(row[again], minlength=len(self.offsets) - 1)

    def n_repeat_words(self) -> np.ndarray:
        start, end = self.get("spans")
        if len(start) < 4:
            return np.zeros(len(self.offsets) - 1, np.int64)
        word, table = C.span_codes(self.data, start, end)
        row = np.repeat(np.arange(len(self.offsets) - 1), self.get("n_words"))
        inside = np.flatnonzero(row[2:] == row[:-2])
        key, size = row[inside], len(self.offsets)
        for k in range(3):  # exact: a key that would grow too long is numbered anew
            if size * len(table) >= 1 << 62:
                key, size = C.codes(key), len(key)
            key, size = key * len(table) + word[inside + k], size * len(table)
        window = C.codes(key)
        hit = np.zeros(len(start) + 2, bool)
        hit[inside[np.bincount(window)[window] > 1]] = True
        covered = hit[:-2].copy()
        covered[1:] |= hit[:-3]
        covered[2:] |= hit[:-4]
        return C.per_row(covered, self.get("word_offsets"))


@dataclass(frozen=True)
class Rule:
    """rejects says which texts go; it asks for the features in reads and no others."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable[[Texts], np.ndarray]
    base: bool = False


RULES = (
    Rule("too_short", ("n_words",), lambda t: t.get("n_words") < 50, base=True),
    Rule("repetitive", ("n_repeat_words", "n_words"), lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words"), base=True),
    Rule("symbols", ("n_symbols", "n_words"), lambda t: 10 * t.get("n_symbols") > 3 * t.get("n_words")),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda t: 100 * t.get("n_dup_lines") > 60 * np.maximum(t.get("n_lines"), 5)),
    Rule("word_length", ("word_chars", "n_words"), lambda t: (t.get("word_chars") > 25 * t.get("n_words")) | (2 * t.get("word_chars") < 3 * t.get("n_words"))),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BY_ROW = (*FEATURES, "n_lines")
SHARED = {"spans": "n_words", "word_offsets": "n_words", "lines": "n_lines"}  # the features that bear the cost of shared work


def take(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of the given rows only."""
    if len(rows) == len(offsets) - 1:
        return data, offsets
    keep = np.zeros(len(data) + 1, np.int8)
    lengths = (offsets[1:] - offsets[:-1])[rows]
    full = rows[lengths > 0]
    np.add.at(keep, offsets[full], 1)
    np.add.at(keep, offsets[full + 1], -1)
    return data[np.cumsum(keep[:-1]).astype(bool)], np.concatenate([[0], np.cumsum(lengths)])


class Known:
    """Features by row as far as they have been computed."""

    def __init__(self, n: int) -> None:
        self.value = {name: np.zeros(n, np.int64) for name in BY_ROW}
        self.have = {name: np.zeros(n, bool) for name in BY_ROW}

    def put(self, rows: np.ndarray, texts: Texts) -> None:
        for name in BY_ROW:
            if name in texts.known:
                self.value[name][rows], self.have[name][rows] = texts.known[name], True

    def complete(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Compute what rows lack, each feature for these rows alone."""
        lacking = np.flatnonzero(~np.logical_and.reduce([self.have[name] for name in FEATURES]))
        while len(lacking):
            need = [name for name in FEATURES if not self.have[name][lacking[0]]]
            same = np.logical_and.reduce([self.have[name][lacking] == (name not in need) for name in FEATURES])
            rows, lacking = lacking[same], lacking[~same]
            texts = Texts(*take(data, offsets, rows))
            for name in need:
                texts.get(name)
            self.put(rows, texts)


def cascade(data: np.ndarray, offsets: np.ndarray, rules: list[Rule]) -> tuple[np.ndarray, Known]:
    """For each text the place in rules of the first that rejects it, or len(rules); and
    the features that were needed to tell."""
    n = len(offsets) - 1
    verdict, alive, known = np.full(n, len(rules)), np.arange(n), Known(n)
    texts = Texts(data, offsets)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(texts)
        if bad.any():
            known.put(alive, texts)
            verdict[alive[bad]] = k
            stay = np.flatnonzero(~bad)
            alive = alive[stay]
            left = Texts(*take(texts.data, texts.offsets, stay))
            left.known = {name: value[stay] for name, value in texts.known.items() if name in BY_ROW}
            texts = left
    known.put(alive, texts)
    return verdict, known


def best_order(rules: tuple[Rule, ...], rejected: dict[int, int], cost: dict[str, float]) -> list[Rule]:
    """The rules by rejection per cost, one after the other.

    rejected: sampled texts by the set (bits) of the rules that reject them; cost: seconds
    by feature. The next rule is the one that rejects most of what is left per second,
    where features that earlier rules computed cost nothing more."""
    left, paid, out = set(range(len(rules))), set(), []
    alive = dict(rejected)
    while left:
        gain = {k: sum(n for bits, n in alive.items() if bits >> k & 1) / (sum(cost.get(f, 0.0) for f in rules[k].reads if f not in paid) + 1e-9) for k in left}
        k = min(left, key=lambda k: (-gain[k], k))
        left.remove(k)
        out.append(rules[k])
        paid |= set(rules[k].reads)
        alive = {bits: n for bits, n in alive.items() if not bits >> k & 1}
    return out


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that a sample of sample_rows texts of each input split suggests.

    A task looks at the first texts of its split and reads no further; what it sends is
    counts by sets of rules and seconds by feature, whose sums are a few rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = Texts(*C.column_bytes(batch.column(0).slice(0, sample_rows)))
            bits = np.zeros(len(texts.offsets) - 1, np.int64)
            for k, rule in enumerate(rules):
                bits |= rule.rejects(texts).astype(np.int64) << k
            kinds, n = np.unique(bits, return_counts=True)
            seconds: dict[str, float] = defaultdict(float)
            for name, s in texts.seconds.items():
                seconds[SHARED.get(name, name)] += s
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(kinds) + list(seconds), pa.string()), pa.array([*kinds, *[0] * len(seconds)], pa.int64()), pa.array([*map(float, n), *seconds.values()], pa.float64())],
                ["feature", "bits", "amount"],
            )
            return

    rows = docs.select("text").mapInArrow(measure, "feature string, bits long, amount double").groupBy("feature", "bits").agg(F.sum("amount").alias("amount")).collect()  # at most 2 ** len(rules) + 6
    return best_order(rules, {r.bits: int(r.amount) for r in rows if r.feature is None}, {r.feature: r.amount for r in rows if r.feature})


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that every rule keeps, with all their columns."""
    order, text = ordered_rules(docs, rules), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.column_bytes(batch.column(text))
            for i, j in C.runs(offsets):
                verdict, _ = cascade(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
                yield batch.slice(i, j - i).filter(pa.array(verdict == len(order)))

    return C.in_place(docs, work)


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: all features, base_failed, kept and the rule that rejected it.

    Verdicts and features come from the cascade; features that it could spare for a
    rejected document are filled in, so that each is computed once a document."""
    order = ordered_rules(docs, rules)
    names = [rule.name for rule in order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.column_bytes(batch.column(1))
            for i, j in C.runs(offsets):
                body, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                verdict, known = cascade(body, at, order)
                known.complete(body, at)
                features = [pa.array(known.value[name], pa.int64()) for name in FEATURES]
                told = Texts(body, at)
                told.known = known.value
                failed = np.zeros(j - i, bool)
                for rule in rules:
                    if rule.base:
                        failed |= rule.rejects(told)
                by = pa.array([names[v] if v < len(names) else None for v in verdict], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *features, pa.array(failed), pa.array(verdict == len(names)), by], ["doc_id", *FEATURES, "base_failed", "kept", "rejected_by"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {', '.join(f'{name} long' for name in FEATURES)}, base_failed boolean, kept boolean, rejected_by string")
