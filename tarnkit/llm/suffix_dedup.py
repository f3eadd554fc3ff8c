"""Exact removal of repeated byte strings by suffix arrays.

A string of LENGTH bytes that starts at two places has its smallest K-gram hash at one
offset in both (leftmost on ties), so it suffices to compare strings with one such
anchor. Each start of a string is served by one anchor; the starts that an anchor
serves make a fragment of the text, LENGTH - 1 bytes longer than their number.

1. Each document gives a row a fragment: the anchor's fingerprint and the
   fragment's digest. Equal fragments in a batch are settled there, so a hot passage
   sends one row a batch.
2. Rows meet by fingerprint. Fragments with equal digests repeat as a whole. Where a
   fingerprint has fragments that differ, one of each kind goes on.
3. Those fragments are cut from the texts and gathered, whole fingerprints together,
   in shards of SHARD_BYTES. A shard gets a suffix array by Larsson-Sadakane
   refinement (groups that are sorted are left alone) and common prefixes by Kasai's
   method, all fragments in step; starts with LENGTH bytes in common with a neighbour
   repeat. A fingerprint with more than a shard's bytes is split in blocks; each
   pair of blocks is merged by binary search of one's strings in the other's sorted
   starts.
4. The repeated stretches of a document are joined with it and cut out.

Texts are UTF-8 bytes and are worked on whole. A row is known by a hash of its doc_id
and text. Edge cases: null and empty texts have no bytes; texts of fewer than LENGTH
bytes stay as they are; repeated rows repeat each other and lose all long strings, as
ties do; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C
from tarnkit.llm.byte_bpe import gather
from tarnkit.llm.near_join import whole_groups

LENGTH, K = 200, 50
WINDOW = LENGTH - K + 1
SHARD_BYTES = 4 << 20
PLACE_BITS = np.uint64(32)


def sliding_argmin(values: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest of each WINDOW consecutive values, by their upper half.

    The lower half gives way to the place, always as many bits, so that a window's
    choice depends on nothing but the window."""
    n = len(values)
    bits = PLACE_BITS
    tagged = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // WINDOW) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = tagged
    rows = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - WINDOW + 1], ahead[WINDOW - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def fragments(data: np.ndarray, offsets: np.ndarray, powers: C.Powers, salt: bytes) -> tuple[np.ndarray, ...]:
    """row, start in the text, length, fingerprint and digest of each fragment."""
    n = len(data) - K + 1
    if n < WINDOW:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    gram = C.gram_hash(data, K, powers)
    anchor = sliding_argmin(gram)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= offsets[row + 1])
    anchor, row = anchor[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    low, high = start[first], start[last] + LENGTH
    body = memoryview(np.ascontiguousarray(data))
    told = np.fromiter((C.digest(body[a:b], salt) for a, b in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(low))
    digest = C.mix(told + (anchor[first] - low).astype(np.uint64))
    return row[first], low - offsets[row[first]], high - low, gram[anchor[first]], digest


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching stretches of one key as one."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new)
    wide = int(end.max(initial=0)) + 1
    top = np.maximum.accumulate(end + group * wide) - group * wide
    new[1:] |= start[1:] > top[:-1]
    first = np.flatnonzero(new)
    return key[first], start[first], np.maximum.reduceat(end, first) if len(first) else end


ROW = "fp long, digest long, key long, at int, len int, state int"
#: state: 0 a fragment, 1 one that repeats in its batch, 2 a stretch that is settled
SETTLED = 2


def _anchored(docs: DataFrame) -> DataFrame:
    salt = C.run_key()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = C.Powers()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = C.column_bytes(batch.column(1))
            parts = []
            for i, j in C.runs(offsets):
                row, *rest = fragments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], powers, salt)
                parts.append((keys[i:j][row], *rest))
            if not parts:
                continue
            key, at, size, fp, digest = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((digest, fp))
            key, at, size, fp, digest = key[order], at[order], size[order], fp[order], digest[order]
            new = np.ones(len(key), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (digest[1:] != digest[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(key))) > 1
            again = np.repeat(many, np.diff(np.append(first, len(key))))
            k, s, e = merged(key[again], at[again], (at + size)[again])
            spread = C.mix(k.astype(np.uint64) + s.astype(np.uint64)).view(np.int64)
            columns = (
                np.concatenate([fp[first].view(np.int64), spread]),
                np.concatenate([digest[first].view(np.int64), np.zeros(len(k), np.int64)]),
                np.concatenate([key[first], k]),
                np.concatenate([at[first], s]),
                np.concatenate([size[first], e - s]),
                np.concatenate([many.astype(np.int64), np.full(len(k), SETTLED)]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if i < 3 else np.int32)) for i, c in enumerate(columns)], ["fp", "digest", "key", "at", "len", "state"])

    return docs.select("key", "text").mapInArrow(work, ROW)


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """Settled stretches (state 2), and the fragments that have to be compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["fp"], 65536):
            fp, digest, key, at, size, state = (table.column(c).to_numpy() for c in range(6))
            done = state == SETTLED
            out = [(fp[done], key[done], at[done], size[done], state[done])]
            fp, digest, key, at, size, state = (x[~done] for x in (fp, digest, key, at, size, state))
            if len(fp):
                new_fp = np.append(True, fp[1:] != fp[:-1])
                new = new_fp | np.append(True, digest[1:] != digest[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(fp)))
                repeats = (count > 1) | (np.maximum.reduceat(state, first) == 1)
                settle = np.repeat(repeats, count) & (state == 0)
                out.append((fp[settle], key[settle], at[settle], size[settle], np.full(settle.sum(), SETTLED)))
                group = np.cumsum(new_fp[first]) - 1
                differ = np.bincount(group)[group] > 1
                pick = first[differ]
                out.append((fp[pick], key[pick], at[pick], size[pick], repeats[differ].astype(np.int64)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if i < 2 else np.int32)) for i, c in enumerate(columns)], ["fp", "key", "at", "len", "state"])

    return rows.mapInArrow(work, "fp long, key long, at int, len int, state int")


def larsson_sadakane(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and their ranks. key orders them by their first depth
    items; groups of equal rank are refined by the rank depth items on, and depth
    doubles, until every group is a single suffix."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order][1:] != key[order][:-1])[:n]
    rank = np.empty(n + 1, np.int64)
    rank[n], rank[order] = -1, np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        unsorted = np.flatnonzero(np.repeat(size > 1, size))
        if not len(unsorted):
            return order, rank[:n]
        where = order[unsorted]
        pair = rank[where] * (n + 1) + rank[np.minimum(where + depth, n)] + 1
        turn = np.argsort(pair, kind="stable")
        where, pair = where[turn], pair[turn]
        order[unsorted] = where
        fresh = np.append(True, pair[1:] != pair[:-1])
        head[unsorted] = fresh
        rank[where] = unsorted[np.maximum.accumulate(np.where(fresh, np.arange(len(unsorted)), 0))]
        depth *= 2


class Shard:
    """Fragments end to end, each closed by a zero byte (UTF-8 bytes are raised by one)."""

    def __init__(self, parts: list[bytes]) -> None:
        self.size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        text = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8) + np.uint8(1)
        self.n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.word = np.zeros(self.n, np.uint64)
        for k in range(8):
            self.word = self.word << np.uint64(8) | padded[k : k + self.n]
        count = np.maximum(self.size - LENGTH + 1, 0)
        self.owner = np.repeat(np.arange(len(parts)), count)
        self.starts = gather(np.arange(self.n), self.begin, count)

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        return larsson_sadakane(self.word, 8)

    def repeats(self) -> np.ndarray:
        """Which of self.starts have LENGTH bytes in common with another start."""
        order, rank = self.suffix_array()
        before = np.full(self.n, -1, np.int64)
        before[order[1:]] = order[:-1]
        flag = np.zeros(self.n + 1, bool)
        last = self.size - LENGTH
        live = np.flatnonzero(last >= 0)
        common = np.zeros(len(live), np.int64)
        step = 0
        while len(live):  # Kasai: a suffix shares at least one byte less than the one before it
            here = self.begin[live] + step
            other = before[here]
            common = np.maximum(common - 1, 0)
            grow = np.flatnonzero((other >= 0) & (common < LENGTH))
            common[other < 0] = 0
            for stride in (8, 1):
                todo = grow
                while len(todo):
                    a, b = here[todo] + common[todo], other[todo] + common[todo]
                    inside = (a < self.n) & (b < self.n)
                    todo, a, b = todo[inside], a[inside], b[inside]
                    same = self.word[a] == self.word[b] if stride == 8 else self.word[a] >> np.uint64(56) == self.word[b] >> np.uint64(56)
                    todo = todo[same]
                    common[todo] += stride
                    todo = todo[common[todo] < LENGTH]
            hit = common >= LENGTH
            flag[here[hit]] = True
            flag[other[hit]] = True
            step += 1
            stay = last[live] >= step
            live, common = live[stay], common[stay]
        return flag[self.starts]

    def sorted_starts(self) -> np.ndarray:
        """Its starts in the order of their suffixes."""
        rank = self.suffix_array()[1]
        return self.starts[np.argsort(rank[self.starts], kind="stable")]

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The LENGTH bytes from each place as big-endian words."""
        return np.stack([self.word[at + k] for k in range(0, LENGTH, 8)], axis=1)

    def found_in(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of each of self.starts among other's sorted starts: flags of both."""
        sorted_ = other.sorted_starts()
        low, high = np.zeros(len(self.starts), np.int64), np.full(len(self.starts), len(sorted_))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            mine, theirs = self.rows(self.starts[open_]), other.rows(sorted_[mid])
            differ = mine != theirs
            k = differ.argmax(axis=1)
            each = np.arange(len(open_))
            less = differ.any(axis=1) & (theirs[each, k] < mine[each, k])
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        hit = np.flatnonzero(low < len(sorted_))
        hit = hit[(self.rows(self.starts[hit]) == other.rows(sorted_[low[hit]])).all(axis=1)]
        flag = np.zeros(len(self.starts), bool)
        flag[hit] = True
        theirs = np.zeros(other.n, bool)
        theirs[sorted_[low[hit]]] = True
        return flag, theirs[other.starts]


def _compare(groups: DataFrame) -> DataFrame:
    """Fragments by fp and pair of blocks, to stretches (key, at, end) that repeat.

    Flags from the search mark one of several equal strings in the other block; those
    equal to it repeat inside that block, whose own pair (b, b) finds them."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        shard = Shard([r[2] for r in rows])
        yield from stretches(rows, shard, shard.repeats())

    def stretches(rows: list[tuple], shard: Shard, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        if flag.any():
            owner = shard.owner[flag]
            at = np.array([r[1] for r in rows], np.int64)[owner] + shard.starts[flag] - shard.begin[owner]
            key, start, end = merged(np.array([r[0] for r in rows], np.int64)[owner], at, at + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["key", "at", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table, at in whole_groups(batches, ["fp", "lo", "hi"], 1024):
            block, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
            keys, starts = table.column("key").to_numpy(), table.column("at").to_numpy()
            bodies = table.column("body")
            for a, b in zip(at[:-1], at[1:], strict=True):
                rows = [(keys[i], starts[i], bodies[i].as_py(), block[i]) for i in range(a, b)]
                if lo[a] == hi[a]:
                    held += rows
                    size += sum(len(r[2]) for r in rows)
                    if size >= SHARD_BYTES:
                        yield from flush(held)
                        held, size = [], 0
                    continue
                left, right = [r for r in rows if r[3] == lo[a]], [r for r in rows if r[3] == hi[a]]
                if left and right:
                    one, two = Shard([r[2] for r in left]), Shard([r[2] for r in right])
                    for mine, shard, flag in zip((left, right), (one, two), one.found_in(two), strict=True):
                        yield from stretches(mine, shard, flag)
        if held:
            yield from flush(held)

    return groups.mapInArrow(work, "key long, at int, end int")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """docs: key, text. To key and spans, the sorted stretches (at, end) that repeat."""
    rows = _anchored(docs).repartition("fp").sortWithinPartitions("fp", "digest")
    found = C.staged(_by_fingerprint(rows), "anchors")

    ask = found.where(F.col("state") < SETTLED)
    blocks = ask.groupBy("fp").agg(F.ceil(F.sum("len") / SHARD_BYTES).cast("int").alias("blocks"))
    wanted = ask.join(blocks, "fp").groupBy("key").agg(F.collect_list(F.struct("fp", "at", "len", "blocks")).alias("wanted"))
    cut = _cut(docs.join(wanted.hint("shuffle_hash"), "key"))
    block = F.pmod(F.xxhash64("key", "at"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    groups = cut.withColumn("block", block).withColumn("pair", F.explode(pairs)).select("fp", "block", "pair.lo", "pair.hi", "key", "at", "body")
    compared = _compare(groups.repartition("fp", "lo", "hi").sortWithinPartitions("fp", "lo", "hi"))

    settled = found.where(F.col("state") == SETTLED).select("key", "at", (F.col("at") + F.col("len")).alias("end"))
    return settled.unionByName(compared).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"))


def _cut(texts: DataFrame) -> DataFrame:
    """The wanted fragments of each text. A key with several rows gives them once a row,
    which is harmless: its fragments are settled already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                body = memoryview(text.as_buffer())
                w = wanted.values.flatten()
                ats, sizes = w[1].to_numpy(), w[2].to_numpy()
                bodies = pa.array([bytes(body[a : a + s]) for a, s in zip(ats, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([w[0], pa.array(np.full(len(ats), key.as_py(), np.int64)), w[1], w[3], bodies], ["fp", "key", "at", "blocks", "body"])

    return texts.select("key", "text", "wanted").mapInArrow(work, "fp long, key long, at int, blocks int, body binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the remaining bytes, of each document."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    salted = F.sha2(F.concat(F.lit(C.run_key().hex()), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), "text"), 256)
    keyed = keyed.withColumn("key", F.conv(F.substring(salted, 1, 16), 16, -10).cast("long"))
    spans = repeated_stretches(keyed.select("key", "text"))
    joined = keyed.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, count, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = memoryview(text.as_buffer())
                size.append(len(body))
                if not spans.is_valid:
                    removed.append(0)
                    count.append(0)
                    kept.append(bytes(body))
                    continue
                at, end = (x.to_numpy().astype(np.int64) for x in spans.values.flatten())
                _, at, end = merged(np.zeros(len(at), np.int64), at, end)
                removed.append(int((end - at).sum()))
                count.append(len(at))
                edge = zip(np.append(0, end), np.append(at, len(body)), strict=True)
                kept.append(b"".join([body[a:b] for a, b in edge]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, count)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def removal_digest(docs: DataFrame) -> DataFrame:
    """remove_repeats with the SHA-256 of the remaining bytes in their place."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

