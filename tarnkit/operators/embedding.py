"""Embeddings with a stored cache: each distinct text goes to the service once.

A run digests texts, joins the digests with the cache, and sends the distinct misses in
batches. A batch's answer is put into the shared folder before the task goes on, under
a name made of its texts and the service's version; a task that is tried again, or a run that is
made again, finds it there and sends nothing twice."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.vectors import call_again
from tarnkit.sources.shared import shared_dir, written

BATCH = 256


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:/") else (fs.LocalFileSystem(), folder)


def _answered(folder: str, name: str, ask: Callable[[], list]) -> list:
    """What is stored under a name, or else the answer, stored before it is given."""
    system, place = _files(folder)
    path = f"{place}/{name}"
    if system.get_file_info(path).is_file:
        with system.open_input_file(path) as file, pa.ipc.open_file(file) as table:
            return table.read_all().column(0).to_pylist()
    vectors = ask()
    table = pa.table({"vector": pa.array(vectors, pa.list_(pa.float64()))})
    draft = f"{path}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as file, pa.ipc.new_file(file, table.schema) as out:
        out.write_table(table)
    system.move(draft, path)
    return vectors


def embed_texts(texts: DataFrame, service: Callable[[list[str]], list[list[float]]], version: str, folder: str | None = None, batch: int = BATCH, tries: int = 3, pause: float = 5.0) -> DataFrame:
    """texts (with a column text) and a column vector, null where the text is.

    version: names the service and its model; folder: of the cache, in the shared folder by default."""
    spark = texts.sparkSession
    folder = folder or f"{shared_dir(spark)}/embeddings"
    system, place = _files(folder)
    system.create_dir(f"{place}/answers", recursive=True)
    keyed = texts.withColumn("hash_", F.sha2("text", 256))
    schema = "hash_ string, vector array<double>, version string"

    def stored() -> DataFrame:
        try:
            files = spark.read.schema(schema).parquet(f"{folder}/vectors").inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            files = []
        runs = sorted({f.rsplit("/", 1)[0] for f in files})
        rows = spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)  # run by run: a plan may hold the cache before and after an append
        return rows.where(F.col("version") == version)

    known = stored().select("hash_").distinct()
    misses = keyed.where("text is not null").groupBy("hash_").agg(F.first("text").alias("text")).join(known, "hash_", "left_anti")
    misses = written(misses.sortWithinPartitions("hash_"), "misses")  # a task that is tried again reads the same rows in the same order

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                some = rows.slice(a, batch)
                hashes = some.column(0).to_pylist()
                name = hashlib.sha256("\n".join([version, *hashes]).encode()).hexdigest()
                vectors = _answered(f"{folder}/answers", name, lambda some=some: call_again(service, some.column(1).to_pylist(), tries, pause))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["hash_", "vector"])

    made = misses.select("hash_", "text").mapInArrow(work, "hash_ string, vector array<double>").withColumn("version", F.lit(version))
    if not misses.isEmpty():
        made.write.parquet(f"{folder}/vectors/run={uuid.uuid4().hex}")
    vectors = stored().groupBy("hash_").agg(F.first("vector").alias("vector"))
    return keyed.join(vectors, "hash_", "left").drop("hash_")
