"""How far the sources of a language differ from each other, term by term.

In-mapper stripes: a task folds whole documents into hash stripes, a term's document
frequency and its counts by source, and writes them out as rows (lang, term, df, sources)
when they grow beyond SPILL entries or the partition ends. The stripes are shuffled by
(lang, term), sorted, and merged as they stream by; those of terms in at least
MIN_DOCS documents of their language are kept. A frequent term gives one row a task and
spill, whatever its count.

The merged stripes then emit the divergences. They are dealt in blocks of about
BLOCK_TERMS terms and tiles of about TILE_SOURCES sources of one language; a block and a
pair of tiles is one group, which meets the totals of its sources and gives partial sums
of the pairs, and on the diagonal its own best terms of each source. So no group grows
with the corpus, nothing is broadcast that Spark doesn't know to be small, and the pairs
of sources are those that the result lists anyway.

All numbers are integers: a probability is counted in units of 1/SCALE, from 1.

Edge cases: null text, lang and source are ''; texts are read whole; a source without
terms takes part with counts of 0; in a language without kept terms all pairs have value
0; repeated rows count as often as they stand there; equal values go by the UTF-8 bytes
of the item; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnkit.llm import common as C

MIN_DOCS, TOP_TERMS, PSEUDO = 30, 50, 5
SPILL = 400_000
BLOCK_TERMS, TILE_SOURCES, PAIR_CELLS = 4096, 256, 1 << 22
# Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased: every other byte becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SOURCES = "array<struct<source: string, n: bigint>>"
STRIPE = f"lang string, term string, df long, sources {SOURCES}"


class Stripes:
    """The stripes that a task holds: df by language and term, and counts by language, source and term.

    The empty term stands for the group itself, so that sources without terms are known."""

    def __init__(self) -> None:
        self.df: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def add(self, lang: str, source: str, words: list[bytes]) -> None:
        self.df[lang].update({b"", *words})
        count = self.counts[lang][source]
        count[b""] += 0
        count.update(words)

    def size(self) -> int:
        return sum(len(c) for of in self.counts.values() for c in of.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lang, df in self.df.items():
            counts = self.counts[lang]
            coded = pa.array(chain.from_iterable(counts.values()), pa.binary()).dictionary_encode()
            source = np.repeat(np.arange(len(counts)), [len(c) for c in counts.values()])
            n = np.fromiter(chain.from_iterable(c.values() for c in counts.values()), np.int64, len(source))
            terms = coded.dictionary
            code = coded.indices.to_numpy()
            turn = np.argsort(code, kind="stable")
            yield _batch([lang] * len(terms), terms.cast(pa.string()), np.fromiter(map(df.__getitem__, terms.to_pylist()), np.int64, len(terms)), np.bincount(code, minlength=len(terms)), pa.array(list(counts), pa.string()).take(pa.array(source[turn])), n[turn])


def _batch(langs: list | pa.Array, terms: pa.Array, df: np.ndarray, sizes: np.ndarray, sources: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """Stripes of which the i-th has the next sizes[i] of sources and n."""
    pairs = pa.StructArray.from_arrays([sources, pa.array(n, pa.int64())], ["source", "n"])
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), terms, pa.array(df, pa.int64()), pa.ListArray.from_arrays(at, pairs)], ["lang", "term", "df", "sources"])


def fold(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """Stripes of each task: lang, term, df, sources."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grown = Stripes(), 0
        for batch in batches:
            data, at = C.column_bytes(batch.column(2))
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                words = data[at[k] : at[k + 1]].tobytes().translate(TERM_BYTES).split()
                held.add(lang, source, words)
                grown += len(words)
                if grown >= spill:  # no more entries than words, so it needn't be counted before
                    grown = held.size()
                    if grown >= spill:
                        yield from held.rows()
                        held, grown = Stripes(), 0
        yield from held.rows()

    empty = F.lit("")
    return docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text").mapInArrow(work, STRIPE)


def merged(stripes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One stripe a term, for terms in at least min_docs documents of their language, and for ''."""

    def joined(table: pa.Table) -> pa.RecordBatch:
        """The stripes of each term in one, for whole groups of sorted rows; only those that stay are put together."""
        langs, terms = (table.column(c).combine_chunks() for c in range(2))
        first = np.flatnonzero(np.append(True, pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(terms[1:], terms[:-1])).to_numpy(zero_copy_only=False)))
        df = np.add.reduceat(table.column(2).to_numpy(), first)
        stay = (df >= min_docs) | (pc.binary_length(terms).to_numpy()[first] == 0)
        rows = np.flatnonzero(np.repeat(stay, np.diff(np.append(first, len(terms)))))
        lists = table.column(3).combine_chunks().take(pa.array(rows))
        group = np.repeat(np.repeat(np.arange(stay.sum()), np.diff(np.append(first, len(terms)))[stay]), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        names = flat.field(0).dictionary_encode()
        width = max(1, len(names.dictionary))
        keys, place = np.unique(group * width + names.indices.to_numpy(), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, place, flat.field(1).to_numpy())
        kept = pa.array(first[stay])
        return _batch(langs.take(kept), terms.take(kept), df[stay], np.bincount(keys // width, minlength=int(stay.sum())), names.dictionary.take(pa.array(keys % width)), n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last term may go on in the next batch; what there is of it is one stripe a batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            langs, terms = table.column(0), table.column(1)
            ends = pc.or_(pc.not_equal(langs, langs[-1]), pc.not_equal(terms, terms[-1])).to_numpy()
            cut = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
            if cut:
                yield joined(table.slice(0, cut))
            held = [_one_stripe(table.slice(cut))]
        if held:
            yield joined(pa.Table.from_batches(held))

    return stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(work, STRIPE)


def _one_stripe(table: pa.Table) -> pa.RecordBatch:
    """Rows of one term as one stripe."""
    flat = table.column(3).combine_chunks().flatten()
    names = flat.field(0).dictionary_encode()
    n = np.zeros(len(names.dictionary), np.int64)
    np.add.at(n, names.indices.to_numpy(), flat.field(1).to_numpy())
    return _batch([table.column(0)[0].as_py()], pa.array([table.column(1)[0].as_py()], pa.string()), np.array([table.column(2).to_numpy().sum()]), np.array([len(n)]), names.dictionary, n)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) without overflow, three digits at a time."""
    rest, out = count.astype(np.int64), np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def _emit(key: tuple, stripes: pa.Table, totals: pa.Table) -> pa.Table:
    """Partial sums of the pairs of one block and pair of tiles, and on the diagonal its best terms."""
    out: dict[str, list] = {name: [] for name in ("lang", "source", "part", "item", "value")}

    def put(source: list, part: str, item: list, value: list) -> None:
        for name, column in zip(out, ([key[0].as_py()] * len(source), source, [part] * len(source), item, value), strict=True):
            out[name] += column

    block, low, high = (k.as_py() for k in key[1:])
    tile, names = totals.column("tile").to_numpy(), totals.column("source").to_pylist()
    v = totals.column("v")[0].as_py() if names else 0
    whole = np.maximum(totals.column("n").to_numpy() + PSEUDO * v, 1)
    place = {s: k for k, s in enumerate(names)}
    row_of: dict[str, int] = {}
    rows = [row_of.setdefault(t, len(row_of)) for t in stripes.column("term").to_pylist()]  # a term comes once from each of two tiles
    terms, n_terms = list(row_of), len(row_of)
    count, in_lang = np.zeros((n_terms, len(names)), np.int64), np.zeros(n_terms, np.int64)
    in_lang[rows] = stripes.column("total").to_numpy()
    for row, parts in zip(rows, stripes.column("sources").to_pylist(), strict=True):
        for p in parts:
            count[row, place[p["source"]]] = p["n"]
    p, none = share(count + PSEUDO, whole[None, :]), share(np.full(len(names), PSEUDO), whole)
    left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    one, two = np.triu_indices(len(left), 1) if low == high else map(np.ravel, np.indices((len(left), len(right))))
    one, two = left[one], right[two]
    absent = (v if block == 0 else 0) - n_terms  # terms that neither source has differ alike: block 0 counts all of them, each block takes its own back
    step = max(1, PAIR_CELLS // max(1, n_terms))
    for a in range(0, len(one), step):
        x, y = one[a : a + step], two[a : a + step]
        value = (np.abs(p[:, x] - p[:, y]).sum(axis=0) + absent * np.abs(none[x] - none[y])).tolist()
        x, y = [names[k] for k in x], [names[k] for k in y]
        put(x + y, "pair", y + x, value + value)
    if low == high and n_terms:
        in_all = share(in_lang + PSEUDO, np.full(n_terms, totals.column("lang_n")[0].as_py() + PSEUDO * v))
        turn = np.argsort(np.array([t.encode() for t in terms], object), kind="stable")
        for k in left:
            gain = (p[:, k] - in_all)[turn]
            found = np.flatnonzero((gain > 0) & (count[turn, k] > 0))
            best = found[np.argsort(-gain[found], kind="stable")[:TOP_TERMS]]
            put([names[k]] * len(best), "term", [terms[turn[b]] for b in best], gain[best].tolist())
    return pa.table({**out, "value": pa.array(out["value"], pa.int64())}, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank: the distances between the sources of a
    language (part pair), and the terms that a source has more of than its language (part term)."""
    stripes = C.staged(merged(fold(docs), min_docs), "stripes")
    kept, each = stripes.where("term <> ''"), lambda df, *columns: df.select("lang", *columns, F.explode("sources").alias("x")).select("lang", *columns, F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    n_of = each(kept).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = each(stripes.where("term = ''")).select("lang", "source").join(n_of, ["lang", "source"], "left").fillna(0, ["n"])
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    langs = totals.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.ceil(F.count("*") / tile_sources).cast("int").alias("tiles")).join(terms, "lang", "left").fillna(0, ["v"])
    langs = C.staged(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int")), "langs")
    tile = lambda source: F.pmod(F.xxhash64(source), F.col("tiles")).cast("int")
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)

    def by_pair(df: DataFrame) -> DataFrame:
        """Rows of a tile once for each pair of tiles that it is in."""
        mates = F.transform(tiles, lambda t: F.struct(F.least(t, F.col("tile")).alias("low"), F.greatest(t, F.col("tile")).alias("high")))
        return df.withColumn("m", F.explode(mates)).select("*", "m.low", "m.high").drop("m", "tiles", "blocks")

    held = kept.join(langs.select("lang", "tiles", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    held = held.withColumn("total", F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    held = held.withColumn("tile", F.explode(F.array_distinct(F.transform("sources", lambda x: tile(x["source"])))))
    held = held.withColumn("sources", F.filter("sources", lambda x: tile(x["source"]) == F.col("tile")))
    held = by_pair(held.select("lang", "term", "total", "sources", "tile", "tiles", "blocks", "block"))
    met = by_pair(totals.join(langs, "lang").withColumn("tile", tile("source")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    grid = ["lang", "block", "low", "high"]
    met = met.toDF(*met.columns)  # columns of its own: both sides come from the stripes
    parts = held.groupBy(*grid).cogroup(met.groupBy(*grid)).applyInArrow(_emit, "lang string, source string, part string, item string, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
