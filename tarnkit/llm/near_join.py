"""N-gram Jaccard self-join of documents by signature trees.

A document's set holds its distinct shingles of SHINGLE lower-cased words as 64-bit
hashes; two documents link at Jaccard similarity 3/4 or more. Equal sets collapse
first (by a 128-bit digest of the set), so copies never meet. Then, in two rounds:

1. Candidates. Each set's KEEP smallest hashes are its bottom sketch. Two sets that
   reach 3/4 share LEAST or more of their union's KEEP smallest (a pair at exactly 3/4
   shares fewer with a chance below 1e-11, the order of a hash collision; sets that fit
   their sketches are compared exactly). So they also share one of the hashes that stay
   when each sketch gives up its LEAST - 1 most frequent ones: a set is looked up by
   its rarest hashes only, and not at all if no one shares these. Sets that share
   such a hash meet in a group, where a signature tree over the sketches keeps the
   pairs that may reach 3/4. A group of more than BLOCK sets is split in blocks and
   every pair of blocks is worked on by itself, so that no task holds an unbounded
   group.
2. Verification. Candidate links form clusters (distributed components). Each set
   in one is read again whole and sent to its cluster once; a signature tree over the
   full sets finds the exact components. Clusters beyond BLOCK_TOKENS hashes are
   split in blocks and pairs of blocks likewise.

Edge cases: null and empty texts, and texts of white space, have the empty set and
link with nothing; fewer words than SHINGLE make one shingle of the whole sequence;
texts are read whole; rows with one doc_id count as one document; a null doc_id links
with nothing and has a null component; an empty table gives an empty result; further
columns are ignored, or kept by keep_one, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C
from tarnkit.llm.components import components
from tarnkit.llm.signature_tree import SignatureTree, sketches_match

SHINGLE, KEEP, LEAST = 5, 48, 13
BLOCK = 4096
BLOCK_TOKENS = 4_000_000
SMALL_GROUP = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, salt: bytes = b"") -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are hashed by their digest with the run's key."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    start, end = C.word_spans(data, offsets)
    place, table = C.span_codes(data, start, end)
    word = np.fromiter((C.digest(w, salt) for w in table.to_pylist()), np.uint64, len(table))[place]
    at = np.searchsorted(start, offsets)
    n = max(0, len(word) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(C.BASE) + C.mix(word[k : k + n] + np.uint64(k))
    rolled = C.mix(rolled)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(rolled[a : b - SHINGLE + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = whole * np.uint64(C.BASE) + C.mix(word[k : k + 1] + np.uint64(k - a))
            yield C.mix(whole + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def _sets(docs: DataFrame, salt: bytes) -> DataFrame:
    """doc_id, n (set size), set_id and sketch of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.column_bytes(batch.column(1))
            for i, j in C.runs(offsets):
                n, ids, sketches = [], [], []
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], salt):
                    n.append(len(s))
                    ids.append(hashlib.blake2b(s, digest_size=16).digest())
                    sketches.append(s[:KEEP].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n", "set_id", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n long, set_id binary, sketch array<long>")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 4096, least_bytes: int = 32 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches regrouped so that no key is split; with the groups' offsets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least_rows or sum(b.nbytes for b in held) >= least_bytes:
            table = pa.Table.from_batches(held).combine_chunks()
            at = _offsets(table, keys)
            if len(at) > 2:
                yield table.slice(0, at[-2]), at[:-1]
                held = table.slice(at[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _offsets(table, keys)


def _offsets(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


class Links:
    """Unions of ids, given back as stars."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        pairs = [(x, self.find(x)) for x in self.up]
        pairs = [(x, r) for x, r in pairs if x != r]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])


def _in_blocks(df: DataFrame, key: str, id_: str, blocks: Column) -> DataFrame:
    """A row for each pair of blocks that holds it: key, lo, hi. One block: (0, 0)."""
    mine = F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    return df.withColumn("blocks", blocks).withColumn("block", mine).withColumn("pair", F.explode(every)).select(*df.columns, "pair.lo", "pair.hi").repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _link_groups(keys: list[str], tokens: str, keep: int | None) -> Callable:
    """Work on sorted groups with columns id, n and tokens: stars of linked ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for table, at in whole_groups(batches, keys):
            ids, sizes, bodies = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column(tokens)
            bodies = bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a < 2:
                    continue
                known = [links.find(int(x)) for x in ids[a:b]]
                if len(set(known)) == 1:
                    continue
                sets = [_tokens(bodies[i]) for i in range(a, b)]
                if b - a <= SMALL_GROUP:
                    for i in range(b - a):
                        for j in range(i + 1, b - a):
                            x, y = int(ids[a + i]), int(ids[a + j])
                            if 100 * min(sizes[a + i], sizes[a + j]) >= 75 * max(sizes[a + i], sizes[a + j]) and links.find(x) != links.find(y) and _pair(sets[i], sets[j], keep):
                                links.join(x, y)
                    continue
                root = SignatureTree(sets, sizes[a:b], keep, LEAST if keep else 0).link(known)
                for i in np.flatnonzero(root != np.arange(b - a)):
                    links.join(int(ids[a + i]), int(ids[a + root[i]]))
            if len(links.up) > 200_000:
                yield links.batch()
        yield links.batch()

    return work


def _tokens(value: pa.Scalar) -> np.ndarray:
    if pa.types.is_list(value.type):
        return value.values.to_numpy().view(np.uint64)
    return np.frombuffer(value.as_buffer(), np.uint64)


def _pair(a: np.ndarray, b: np.ndarray, keep: int | None) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return bool(sketches_match(shared, total, keep, LEAST)) if keep else 100 * shared >= 75 * total


def _full_sets(chosen: DataFrame, salt: bytes) -> DataFrame:
    """chosen: text, id, n and further columns; text replaced by the whole set."""
    rest = [c for c in chosen.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.column_bytes(batch.column(0))
            for i, j in C.runs(offsets):
                sets = [s.tobytes() for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], salt)]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *(batch.column(k + 1).slice(i, j - i) for k in range(len(rest)))], ["tokens", *rest])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.select(*rest).schema)
    return chosen.select("text", *rest).mapInArrow(work, f"tokens binary, {schema}")


def _probes(reps: DataFrame) -> DataFrame:
    """id, probe and members: the hashes by which each set is looked up, and how many
    sets look there.

    By rising frequency a set's unshared hashes come first, and all but the last
    LEAST - 1 of the sketch (or of a small set's own bound) are its probes."""
    tokens = reps.select("id", F.col("n"), F.explode("sketch").alias("probe"))
    shared = tokens.groupBy("probe").agg(F.count("*").alias("df")).where("df > 1")
    mine = tokens.join(shared, "probe").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "probe"))).alias("shared"))
    need = F.least(F.lit(LEAST), F.ceil(F.col("n") * 3 / 4))
    drop = F.greatest(need - 1, F.lit(0))
    rare = F.slice("shared", F.lit(1), F.greatest(F.size("shared") - drop, F.lit(0)).cast("int"))
    probes = mine.select("id", F.explode(rare).alias("x")).select("id", "x.probe")
    members = probes.groupBy("probe").agg(F.count("*").alias("members")).where("members > 1")
    return probes.join(members, "probe")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; doc_id is an integer."""
    C.integer_ids(docs)
    salt = C.run_key()
    sets = C.staged(_sets(docs, salt), "sets")
    reps = sets.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = C.staged(reps, "reps")

    grouped = _probes(reps).join(reps.select("id", "n", "sketch"), "id").select("probe", "members", "id", "n", "sketch")
    blocks = F.ceil(F.col("members") / BLOCK)
    edges = _in_blocks(grouped, "probe", "id", blocks).select("probe", "lo", "hi", "id", "n", "sketch").mapInArrow(_link_groups(["probe", "lo", "hi"], "sketch", KEEP), "u long, v long")
    cluster = components(edges)

    listed = cluster.unionByName(cluster.select(F.col("label").alias("id"), "label").distinct())
    listed = C.staged(listed.join(reps.select("id", "n"), "id"), "clusters")
    size = listed.groupBy("label").agg(F.sum("n").alias("tokens"))
    sized = listed.join(size.where(F.col("tokens") > BLOCK_TOKENS), "label", "left").select("id", "label", "n", F.coalesce("tokens", F.lit(1)).alias("total"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(sized.hint("shuffle_hash"), "id")
    full = _full_sets(chosen.select("text", "label", "id", "n", "total"), salt)
    exact = _in_blocks(full, "label", "id", F.ceil(F.col("total") / BLOCK_TOKENS)).select("label", "lo", "hi", "id", "n", "tokens").mapInArrow(_link_groups(["label", "lo", "hi"], "tokens", None), "u long, v long")
    labels = components(exact)

    named = reps.select("set_id", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", F.coalesce("label", "rep").alias("component"))
    out = sets.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns.

    Of rows that share this doc_id the one with the smallest hash of its columns (maps aside)
    stays, also when a task is run again; rows without a doc_id all stay."""
    kept = near_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.join(kept.hint("shuffle_hash"), docs["doc_id"] == kept["doc_id"], "left_semi")
    order = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    one = chosen.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))
