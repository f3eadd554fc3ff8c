"""Benchmark decontamination with DataFrame functions alone.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered.
A window is WINDOW consecutive words of a benchmark item; a shorter item is one
window as a whole. The scan of a document runs inside one row: its words are made
once, and each position is probed by the hash of its first SEED words against the
hash set of the windows' first words, which travels with the plan as bits: 16 for a
seed, MOST_BITS (2 MB) at most. Positions that pass give the words of a window there,
which a join with the windows verifies, so what the bits let through by chance costs
time and never a result. Larger benchmarks go the same way; beyond a million seeds more
positions pass by chance. The windows are broadcast by Spark's own size rule.

Edge cases: a null or empty text has no words and no hits; an item without words
has no windows; repeated items or documents count for themselves, repeated item ids
once; windows of an item without an item_id hit, and the item is not listed;
without benchmark rows nothing is hit; an empty documents table gives an
empty result; rows without a doc_id are measured like any others; further columns are
ignored by measure_contamination and kept by remove_contaminated, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.common import let

WINDOW = 13
SEED = 4
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 24
WORD = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame) -> DataFrame:
    """size, seed, window (its words, by spaces) and the ids of the items that hold it."""
    made = let(
        words(F.col("text")),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>"))
        .when(F.size(w) <= WINDOW, F.array(w))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.slice(w, i, WINDOW))),
    )
    each = benchmark.select("item_id", F.explode(made).alias("w"))
    return each.select(F.size("w").alias("size"), seed_hash(F.col("w"), F.lit(0), F.size("w")).alias("seed"), F.array_join("w", " ").alias("window"), "item_id").groupBy("size", "seed", "window").agg(F.collect_set("item_id").alias("items"))


def seed_hash(w: Column, i: Column, size: Column) -> Column:
    """Of the first words, up to SEED, of the window that starts at place i."""
    firsts = [F.when(size > k, F.get(w, i + k)) for k in range(SEED)]
    return F.xxhash64(F.least(size, F.lit(SEED)), *firsts)


def seed_bits(seeds: DataFrame) -> tuple[int, Column]:
    """The number of bits, and the set of seeds as an array of longs of 64 bits."""
    n = seeds.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    slot = F.pmod("seed", F.lit(size))
    rows = seeds.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).collect()  # at most MOST_BITS / 64
    bits = [0] * (size // 64)
    for r in rows:
        bits[r["at"]] = r["bits"]
    return size, F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded into one literal


def candidates(text: Column, sizes: list[int], size: int, bits: Column) -> Column:
    """The number of words, and (at, size, window) wherever a window may occur."""
    empty = F.array().cast("array<struct<at:int,size:int,window:string>>")

    def probe(w: Column, i: Column, p: int) -> Column:
        key = F.xxhash64(F.lit(p), *(F.get(w, i + k) if k < p else F.lit(None).cast("string") for k in range(SEED)))
        slot = F.pmod(key, F.lit(size))
        return F.call_function("shiftright", F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    def places(w: Column, p: int) -> Column:
        """Where windows may start whose size gives p words to the probe."""
        listed = F.array(*(F.lit(s) for s in sizes if min(s, SEED) == p))
        passed = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: probe(w, i, p))
        return F.flatten(F.transform(passed, lambda i: F.transform(F.filter(listed, lambda s: i + s <= F.size(w)), lambda s: F.struct(i.alias("at"), s.alias("size"), F.array_join(F.slice(w, i + 1, s), " ").alias("window")))))

    def found(w: Column) -> Column:
        parts = [places(w, p) for p in sorted({min(s, SEED) for s in sizes})]
        return F.when(F.size(w) > 0, F.concat(*parts)).otherwise(empty) if parts else empty

    return let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), found(w).alias("found")))


def measure_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    table = windows(benchmark)
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # at most WINDOW rows
    size, bits = seed_bits(table.select("seed").distinct())
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", candidates(F.col("text"), sizes, size, bits).alias("c"))
    each = scanned.select("row", "doc_id", F.col("c.n").alias("n_words"), F.explode_outer("c.found").alias("f")).select("row", "doc_id", "n_words", "f.*")
    hits = each.join(table.select("window", "size", "items"), ["window", "size"], "left")
    ends = F.array_sort(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("size")).alias("end")))))
    doc = hits.groupBy("row", "doc_id", "n_words").agg(ends.alias("ends"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate(
        "ends",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, e: F.struct(F.greatest(a["to"], e["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), e["end"] - F.greatest(a["to"], e["at"]))).alias("n")),
        lambda a: a["n"],
    )
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = doc.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns.

    A repeated doc_id goes if any of its rows is contaminated; rows without a doc_id
    are told apart by their text, so copies of one go or stay together."""
    key = F.coalesce(F.concat(F.lit("id:"), docs["doc_id"].cast("string")), F.concat(F.lit("text:"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256)))
    bad = measure_contamination(docs.select(key.alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("bad_key")).distinct()
    return docs.join(bad, key == bad["bad_key"], "left_anti")
