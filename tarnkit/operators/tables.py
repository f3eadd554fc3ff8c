"""Keyed changes, paging, reuse and incremental export of tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkit.functions import text as T

ANSWER_BYTES, ANSWER_IMAGES = 100_000, 50  # fixed values: of an answer by hand


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Changes replace rows with their key; of several changes the last by order stays."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    last = changes.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
    return table.join(last, key, "left_anti").unionByName(last)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(key).join(table, key, "left_anti"))


def delete_by(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def replace_for(table: DataFrame, rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """All rows of the given owners replaced by rows."""
    return table.join(owners.select(key).distinct(), key, "left_anti").unionByName(rows)


def is_free(table: DataFrame, column: str, value: str, but: str = "", id_: str = "id") -> bool:
    """Whether no other row holds the value, so that it may be taken."""
    return table.where((F.col(column) == value) & (F.col(id_) != but)).isEmpty()


def all_of(conditions: list[Column | None]) -> Column:
    """The conditions that are given, together."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def with_status(table: DataFrame, status: str | None, allowed: tuple[str, ...]) -> DataFrame:
    if status and status not in allowed:
        raise ValueError(f"unknown status {status!r}")
    return table.where(F.col("status") == status) if status else table


def page(table: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; a number below 1 means the first, a size outside 1..200 means 20."""
    size, number = size if 1 <= size <= 200 else 20, max(number, 1)
    return table.orderBy(*order).offset((number - 1) * size).limit(size)


def placed(table: DataFrame, by: str, order: str, width: int = 10_000) -> DataFrame:
    """table with place, from 1, by an integer column within each value of by, and total.

    Rows are numbered within ranges of width, and ranges get the counts of those before
    them, so that a value which holds most rows is still many tasks' work."""
    ranged = table.withColumn("range_", F.floor(F.col(order) / width))
    counts = ranged.groupBy(by, "range_").agg(F.count("*").alias("n_"))
    whole = Window.partitionBy(by)
    offsets = counts.select(by, "range_", (F.sum("n_").over(whole.orderBy("range_")) - F.col("n_")).alias("before_"), F.sum("n_").over(whole).alias("total"))
    within = F.row_number().over(Window.partitionBy(by, "range_").orderBy(order))
    return ranged.withColumn("within_", within).join(offsets, [by, "range_"]).withColumn("place", F.col("before_") + F.col("within_")).drop("range_", "within_", "before_")


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks (document_id, chunk_index, owner, ...) as rows with id {document}-{index}, in folders by owner.

    The append is all or nothing, and a search for an owner reads that owner's folder and the
    public one's."""
    key = F.concat_ws("-", "document_id", "chunk_index")
    chunks.withColumn("id", key).withColumn("owner", F.when(F.coalesce("owner", F.lit("")) == "", "public").otherwise(F.concat(F.lit("of-"), "owner"))).write.mode("append").partitionBy("owner").parquet(path)


def stored_chunks(spark, path: str, owner: str | None = None) -> DataFrame:
    """Stored chunks, all or those that an owner sees."""
    found = spark.read.parquet(path)
    return found if owner is None else found.where(F.col("owner").isin(f"of-{owner}", "public"))


def knowledge_chunks(entries: DataFrame, text: str, images: str) -> DataFrame:
    """Entries by hand (document_id, title, a text and urls of images) as chunks of the library.

    Text from 0 on; each image as [图片: title] from 1000 on for its text's vector and from
    2000 on for its own; blank urls are left out and keep their number."""
    named = entries.withColumn("name", F.concat(F.lit("知识录入: "), "title"))
    words = named.select("document_id", "name", F.posexplode(T.chunks(F.col(text))).alias("chunk_index", "chunk_text"), F.lit("").alias("image_url"))
    shown = named.select("document_id", "name", "title", F.posexplode(images).alias("i", "url"), F.array(F.lit(1000), F.lit(2000)).alias("bases"))
    shown = shown.where(F.trim("url") != "").select("document_id", "name", "title", "i", "url", F.explode("bases").alias("base"))
    pictures = shown.select("document_id", "name", (F.col("base") + F.col("i")).alias("chunk_index"), F.concat(F.lit("[图片: "), "title", F.lit("]")).alias("chunk_text"), F.trim("url").alias("image_url"))
    return words.unionByName(pictures)


def judged_answers(answers: DataFrame, pending: DataFrame) -> DataFrame:
    """answers by hand (id, answer, images, edit) with reason: why one is refused, null where it isn't.

    pending: id and status. An answered question takes an answer only as an edit."""
    sizes = F.when(F.octet_length("answer") > ANSWER_BYTES, "answer too long").when(F.size("images") > ANSWER_IMAGES, "too many images")
    known = answers.withColumn("refused_", sizes).join(pending.select("id", "status"), "id", "left")  # judged before the join, which needn't carry what isn't asked for
    taken = F.when(F.col("status").isNull(), "not found").when((F.col("status") == "answered") & ~F.coalesce("edit", F.lit(False)), "already answered")
    return known.withColumn("reason", F.coalesce("refused_", taken)).drop("status", "refused_")


def feedback(answers: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers by hand (id, question, answer, images) as chunks of the library, and pending (id, status, answer)
    after them, with llm_answer, the model's summary.

    The text of question and answer from 0 on, each image from 1000 on by its number; blank
    urls are left out and keep their number. An edit replaces the chunks of its document."""
    key = F.concat(F.lit("pending-answer-"), "id").alias("document_id")
    words = answers.where("answer <> ''").select(key, F.posexplode(T.chunks(T.answer_document(F.col("question"), F.col("answer")))).alias("chunk_index", "chunk_text"), F.lit("").alias("image_url"))
    shown = answers.select(key, T.image_answer(F.col("question")).alias("chunk_text"), F.posexplode("images").alias("i", "image_url")).where("image_url <> ''")
    chunks = words.unionByName(shown.select("document_id", (F.col("i") + 1000).alias("chunk_index"), "chunk_text", "image_url"))
    summary = T.generate(F.concat(F.lit(T.SUMMARISE), F.lit("\n"), F.col("question")), F.filter(F.array("answer"), lambda x: x.isNotNull() & (x != "")))
    told = answers.select("id", F.lit("answered").alias("status"), "answer", summary.alias("llm_answer"))
    return chunks, pending.join(told.select("id"), "id", "left_anti").withColumn("llm_answer", F.lit(None).cast("string")).unionByName(told)


def free_values(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """wanted (id, value) with free: whether no row of table (id, value) but its own holds the value."""
    held = table.groupBy("value").agg(F.min("id").alias("low_"), F.max("id").alias("high_"))
    own = (F.col("low_") == F.col("id")) & (F.col("high_") == F.col("id"))
    return wanted.join(held, "value", "left").select("id", "value", (F.col("low_").isNull() | F.coalesce(own, F.lit(False))).alias("free"))


def new_documents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of batch (id, content_hash) whose content is new: not held by a stored document
    that didn't fail, and the first of its kind in the batch. Copies may be many, so the first
    is found by an aggregate, not by a window over them."""
    held = stored.where("status != 'failed'").select("content_hash").distinct()
    first = batch.groupBy("content_hash").agg(F.min("id").alias("id"))
    return batch.join(first, ["content_hash", "id"], "left_semi").join(held, "content_hash", "left_anti")


def reuse_vectors(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """chunks with the vector of a stored chunk of equal text, null where there is none.

    Of several stored vectors the one with the smallest id counts."""
    known = stored.groupBy(F.sha2("chunk_text", 256).alias("hash")).agg(F.min_by("vector", "id").alias("vector"))
    return chunks.withColumn("hash", F.sha2("chunk_text", 256)).join(known, "hash", "left").drop("hash")


def changed_since(table: DataFrame, since: str | None, column: str = "created_at") -> DataFrame:
    """All rows of a table that changes in place, or the rows made after since."""
    return table if since is None else table.where(F.col(column) > F.lit(since).cast("timestamp"))


def export(tables: dict[str, DataFrame], path: str, since: str | None, append_only: dict[str, str]) -> DataFrame:
    """Write each table below path and a manifest of row counts beside them.

    append_only: table and time column of those that only grow; the others go whole."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, table in tables.items():
        changed_since(table, since if name in append_only else None, append_only.get(name, "")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    manifest = spark.createDataFrame([(json.dumps({"since": since, "mode": "full" if since is None else "incremental", "rows": counts, "partial": sorted(append_only) if since is not None else []}),)], "value string")
    manifest.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.createDataFrame(sorted(counts.items()), "table string, rows long")


def _exported(spark, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """A manifest and its tables; an export that lacks rows of what the manifest counts is refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["rows"]}
    for name, rows in tables.items():
        if (n := rows.count()) != manifest["rows"][name]:
            raise ValueError(f"{path}/{name} has {n} rows; its manifest says {manifest['rows'][name]}")
    return manifest, tables


def restore(spark, path: str) -> dict[str, DataFrame]:
    """The tables that a manifest names."""
    return _exported(spark, path)[1]


def restore_chain(spark, paths: list[str], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables after a full export and its increments, in order.

    A table that an increment holds whole replaces what was before. Of one that it holds
    in part, rows add to those before and replace them by key: the last export that has a key
    wins, by an aggregate over all exports at once. keys: of the tables that increments hold in part."""
    exports = [_exported(spark, p) for p in paths]
    if not exports or exports[0][0]["mode"] != "full" or any(m["mode"] == "full" for m, _ in exports[1:]):
        raise ValueError("a chain is a full export and increments after it")
    parts: dict[str, list[DataFrame]] = {}
    for manifest, tables in exports:
        for name, rows in tables.items():
            parts[name] = [*parts.get(name, []), rows] if name in manifest.get("partial", []) else [rows]
    return {name: found[0] if len(found) == 1 else _last_wins(found, keys[name]) for name, found in parts.items()}


def _last_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    columns = parts[0].columns
    numbered = reduce(DataFrame.unionByName, [p.select(*columns, F.lit(k).alias("turn_")) for k, p in enumerate(parts)])
    last = numbered.groupBy(*key).agg(F.max_by(F.struct(*columns), "turn_").alias("row_"))
    return last.select("row_.*")


def evenly_sampled(frames: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    """At most keep rows of each group, evenly spaced in an integer order: j * (total - 1) / (keep - 1); one: the middle."""
    numbered = placed(frames, by, order).withColumn("place_", F.col("place") - 1).select(*frames.columns, "place_")
    sizes = frames.groupBy(by).agg(F.count("*").cast("int").alias("total_"))
    j = F.sequence(F.lit(0), F.lit(keep - 1))
    spots = F.when(F.col("total_") <= keep, F.sequence(F.lit(0), F.col("total_") - 1)).otherwise(
        F.array(F.expr("total_ div 2").cast("int")) if keep == 1 else F.transform(j, lambda x: F.floor(x * (F.col("total_") - 1) / (keep - 1)).cast("int"))
    )
    wanted = sizes.select(by, F.explode(spots).alias("place_"))
    return numbered.join(wanted, [by, "place_"], "left_semi").drop("place_")
