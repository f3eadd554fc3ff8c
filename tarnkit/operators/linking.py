"""Joins between chunks, images, segments and their documents."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IMAGE_BASE, FRAME_BASE = 1000, 10000  # fixed values: where chunk indices of page images and key frames begin

CELL = 20_000


def either_key(left: DataFrame, right: DataFrame, keys: tuple[str, str], on: str, right_id: str) -> DataFrame:
    """left joined with right where either left key equals right's, left rows without a
    match kept. Two equi-joins and a union take the place of a disjunction, which
    would compare every pair; a pair that fits both ways comes once."""
    a, b = keys
    one = left.join(right, left[a] == right[on])
    two = left.join(right, (left[b] == right[on]) & ~F.coalesce(left[a] == right[on], F.lit(False)))
    pairs = one.unionByName(two)
    known = right.select(F.col(on).alias("known_")).distinct()
    alone = left.join(known, left[a] == known["known_"], "left_anti")
    alone = alone.join(known, alone[b] == known["known_"], "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def with_times(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """hits (document_id, chunk_index) with start_time and end_time of their segment, else 0."""
    times = segments.groupBy("chunk_id").agg(F.max_by("start_time", "id").alias("start_time"), F.max_by("end_time", "id").alias("end_time"))
    keyed = hits.withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))
    return keyed.join(times, "chunk_id", "left").drop("chunk_id").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("start_time", "end_time")})


def near_images(hits: DataFrame, images: DataFrame, base: int = 0, reach: int = 1) -> DataFrame:
    """Images (document_id, chunk_index) within reach of a hit of their document, each once.

    Each hit names the few places around it, so that the join is on whole keys and a document
    with many hits and images isn't paired through. base: where the images' numbers begin."""
    places = F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: (F.col("chunk_index") + d + base).cast("int"))).alias("chunk_index")
    near = hits.select("document_id", places).distinct()
    return images.join(near, ["document_id", "chunk_index"], "left_semi").select("document_id", "chunk_index").distinct()


def enriched(hits: DataFrame, images: DataFrame, most: int = 5) -> DataFrame:
    """Images for the answers that have none: query_id, document_id, chunk_index, image_url, place.

    hits: query_id, document_id, chunk_index, image_url; images: document_id, chunk_index,
    image_url, at their text's place or, from IMAGE_BASE on, at their page's. An answer with
    an image among its hits gets no more; the others get the first ones within one place of a
    hit, most at the most, which is the feature."""
    shown = F.coalesce("image_url", F.lit("")) != ""
    bare = hits.groupBy("query_id").agg(F.max(shown).alias("shown")).where("not shown").select("query_id")
    asked = hits.join(bare, "query_id", "left_semi")
    places = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: (F.col("chunk_index") + d).cast("int"))
    direct, paged = F.filter(places, lambda x: x < IMAGE_BASE), F.transform(F.filter(places, lambda x: (x >= 0) & (x < FRAME_BASE - IMAGE_BASE)), lambda x: x + IMAGE_BASE)
    near = asked.select("query_id", "document_id", F.explode(F.concat(direct, paged)).alias("chunk_index")).distinct()
    found = near.join(images.where(shown), ["document_id", "chunk_index"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("document_id", "chunk_index"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("query_id", "document_id", "chunk_index", "image_url", "place")


def capped_images(images: DataFrame, most: int = 5) -> DataFrame:
    """The first images of each document, most at the most, by chunk_index; the cap is the feature."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))
    return images.withColumn("place", place).where(F.col("place") <= most)


def frames_in_time(frames: DataFrame, hits: DataFrame, slack: float = 30.0) -> DataFrame:
    """Frames (document_id, time) within slack of a timed hit (document_id, start_time, end_time).

    Time is cut in spans of twice the slack: a hit is listed in those it reaches, a frame in
    its own, so that only what lies close together is compared."""
    span = lambda c: F.floor(c / (2 * max(slack, 1.0)))
    timed = hits.where("end_time > 0").select("document_id", (F.col("start_time") - slack).alias("low"), (F.col("end_time") + slack).alias("high")).where("low <= high")
    h = timed.distinct().withColumn("span", F.explode(F.sequence(span(F.col("low")), span(F.col("high")))))
    f = frames.withColumn("span", span(F.col("time")))
    return f.join(h, (f["document_id"] == h["document_id"]) & (f["span"] == h["span"]) & f["time"].between(h["low"], h["high"]), "left_semi").drop("span")


def contents_in_chunks(chunks: DataFrame, segments: DataFrame, cell: int = CELL) -> DataFrame:
    """document_id, chunk_index, start_time and end_time over the segments of a document that a chunk's text contains.

    All contents of a document are one automaton, which passes over each chunk once, so
    the work grows with chunks, segments and hits, not with their pairs. A document of many
    chunks or segments is dealt in cells of about cell rows, by position and by hash; a pair of
    cells is one group. Null texts and contents match nothing; an empty content is in
    every text."""
    named = segments.where("content is not null").groupBy("document_id", "content").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    texts = chunks.where("chunk_text is not null").select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")
    sizes = texts.groupBy("document_id").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).unionByName(named.groupBy("document_id").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
    sizes = sizes.groupBy("document_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0 and m > 0")
    cells = sizes.select("document_id", F.ceil(F.col("n") / cell).cast("int").alias("rows"), F.ceil(F.col("m") / cell).cast("int").alias("parts"))
    both = lambda df, own, of, other, count: df.join(cells, "document_id").withColumn(own, F.pmod(F.xxhash64(of), F.col("rows" if own == "row" else "parts")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop("rows", "parts")
    left, right = both(texts, "row", "chunk_index", "part", "parts"), both(named, "part", "content", "row", "rows")
    key = chunks.schema["document_id"].dataType.simpleString()

    def work(key: tuple, theirs: pa.Table, mine: pa.Table) -> pa.Table:
        names = {"document_id": theirs.schema.field("document_id").type, "chunk_index": pa.int64(), "start_time": pa.float64(), "end_time": pa.float64()}
        if not theirs.num_rows or not mine.num_rows:
            return pa.schema(list(names.items())).empty_table()
        automaton, every = ahocorasick.Automaton(), []
        for content, start, end in zip(*(mine.column(c).to_pylist() for c in ("content", "start_time", "end_time")), strict=True):
            automaton.add_word(content, (start, end)) if content else every.append((start, end))
        automaton.make_automaton()
        found: list[tuple] = []
        for chunk, text in zip(theirs.column("chunk_index").to_pylist(), theirs.column("chunk_text").to_pylist(), strict=True):
            hits = [*every, *({times for _, times in automaton.iter(text)} if len(automaton) else ())]
            starts, ends = [h[0] for h in hits if h[0] is not None], [h[1] for h in hits if h[1] is not None]
            if hits:
                found.append((key[0].as_py(), chunk, min(starts, default=None), max(ends, default=None)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([],) * 4, names.values(), strict=True)], names=list(names))

    grid = ["document_id", "row", "part"]
    hits = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(work, f"document_id {key}, chunk_index long, start_time double, end_time double")
    return hits.groupBy("document_id", "chunk_index").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def chunk_times(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Time range of each chunk: of the segments whose text it contains, or the full span."""
    segments = segments.withColumns({c: F.col(c).cast("double") for c in ("start_time", "end_time")})
    found = contents_in_chunks(chunks, segments)
    span = segments.groupBy("document_id").agg(F.min("start_time").alias("low"), F.max("end_time").alias("high"))
    return chunks.select("document_id", "chunk_index").join(found, ["document_id", "chunk_index"], "left").join(span, "document_id").select("document_id", "chunk_index", F.coalesce("start_time", "low").alias("start_time"), F.coalesce("end_time", "high").alias("end_time"))
