"""Queries over what is stored: files in a folder, tables that change, exports in a chain, logs and cached embeddings."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnkit.functions.vectors import DIM, embed_one
from tarnkit.operators import tables as B
from tarnkit.operators.embedding import _files, embed_texts
from tarnkit.plans.registry import Registry, table
from tarnkit.sources import files
from tarnkit.sources.compound import write_xls
from tarnkit.sources.logs import log_tail
from tarnkit.sources.shared import shared_dir
from tarnkit.sources.versioned import VersionedTable

R = Registry()


def _zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _printed(lines: list[str]) -> dict[str, bytes]:
    """One text in each kind of file, by its extension."""
    safe = [escape(x) for x in lines]
    word, draw = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    sheet, office = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = "".join(f'<row><c r="B{k + 1}" t="inlineStr"><is><t>{x}</t></is></c></row>' for k, x in enumerate(safe))
    return {
        "docx": _zipped(**{"word/document.xml": f"<w:document {word}>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in safe) + "</w:document>"}),
        "xlsx": _zipped(**{"xl/workbook.xml": f'<workbook {sheet} {office}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="sheet1.xml"/></Relationships>', "xl/sheet1.xml": f"<worksheet {sheet}>{cells}</worksheet>"}),
        "pptx": _zipped(**{f"ppt/slides/slide{k + 1}.xml": f"<p {draw}><a:p><a:t>{x}</a:t></a:p></p>" for k, x in enumerate(safe)}),
        "MD": "".join(f"## **{x}**\n" for x in lines).encode(),
        "html": ("<html><head><script>var x;</script></head>" + "".join(f"<p>{x}</p>" for x in safe) + "</html>").encode(),
        "xls": write_xls("S", [["", x] for x in lines]),
        "txt": "not a known kind".encode(),
    }


NAMES = "SELECT p_brand AS brand, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part"


@R.add(f"""WITH p AS ({NAMES})
  SELECT brand, kind, string_agg(CASE kind WHEN 'excel' THEN 'S-' || n || ',2: ' || name WHEN 'excel_legacy' THEN 'S-' || n || ',2: ' || name WHEN 'ppt' THEN CASE WHEN n > 1 THEN chr(10) ELSE '' END || 'Slide ' || n || ':' || chr(10) || name WHEN 'html' THEN CASE WHEN n > 1 THEN chr(10) ELSE '' END || name ELSE name END, chr(10) ORDER BY n) AS text
  FROM p, (VALUES ('word'), ('excel'), ('ppt'), ('markdown'), ('html'), ('excel_legacy')) k(kind) GROUP BY brand, kind""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand printed to files of six kinds below a folder; the folder scanned, and its files parsed."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"

    def put(key: tuple, rows: pa.Table) -> pa.Table:
        names = [n for _, n in sorted(zip(rows.column("p_partkey").to_pylist(), rows.column("p_name").to_pylist(), strict=True))]
        system, place = _files(f"{folder}/{key[0].as_py().replace('#', '-')}")
        system.create_dir(place, recursive=True)
        printed = _printed(names)
        for extension, body in printed.items():
            with system.open_output_stream(f"{place}/parts.{extension}") as out:
                out.write(body)
        return pa.table({"brand": [key[0].as_py()], "n": pa.array([len(printed)], pa.int64())})

    table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name").groupBy("p_brand").applyInArrow(put, "brand string, n long").write.format("noop").mode("overwrite").save()
    read = files.parse(files.scan(spark, folder))
    return read.select(F.regexp_replace(F.element_at(F.split("path", "/"), -2), "-", "#").alias("brand"), "kind", "text")


@R.add("""WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3), fresh AS (SELECT c_custkey AS k, c_acctbal AS price FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3),
  rest AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone) AND o_custkey NOT IN (SELECT k FROM fresh))
  SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 200000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM rest
  UNION ALL SELECT k, -k, price FROM fresh UNION ALL SELECT o_custkey, o_orderkey + 1000000000, -1.0 FROM rest WHERE o_totalprice > 200000""")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a stored table by customer: those of one nation deleted, those of one segment replaced by
    a row each, dear ones changed and followed by a row more; each change is a version."""
    orders, customers = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), table(spark, sf_dir, "customer")
    stored = VersionedTable(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}", "o_custkey", 8)
    stored.create(orders)
    stored.delete(customers.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")))
    fresh = customers.where("c_mktsegment = 'BUILDING' and c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"), (-F.col("c_custkey")).alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"))
    stored.replace(fresh)
    dear = stored.read().where("o_totalprice > 200000").select("o_custkey", F.explode(F.array("o_orderkey", F.col("o_orderkey") + 1000000000)).alias("o_orderkey"))
    stored.upsert(dear.withColumn("o_totalprice", F.when(F.col("o_orderkey") > 1000000000, -1.0).otherwise(0.0)), ["o_custkey", "o_orderkey"], "o_totalprice")
    return stored.read()


CHAIN = ("2024-01-08", "2024-01-15", "2024-01-22")


@R.add("""SELECT 'events' AS name, event_id AS id, CASE WHEN event_id % 10 = 3 AND ts <= TIMESTAMP '2024-01-15' THEN 'changed' ELSE event_type END AS value FROM events
  UNION ALL SELECT 'labels', doc_id, CAST(1 - quality AS VARCHAR) FROM labels""")
def export_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full export and three increments, of which the second holds older events that have changed and
    each has all labels as they are then; what the chain brings back."""
    events, labels = table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    folder = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"
    made, keys = F.col("ts"), {"events": ["event_id"]}
    edges = [None, *CHAIN, "2100-01-01"]
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        now = events.where(made <= F.lit(high).cast("timestamp_ntz"))
        if k == 2:
            old = now.where((F.col("event_id") % 10 == 3) & (made <= F.lit(CHAIN[1]).cast("timestamp_ntz")))
            now = now.join(old.select("event_id"), "event_id", "left_anti").unionByName(old.select("event_id", F.lit("changed").alias("event_type"), F.lit(CHAIN[1] + " 00:00:01").cast("timestamp_ntz").alias("ts")))
        flipped = labels.withColumn("quality", F.when(F.lit(k == 3), 1 - F.col("quality")).otherwise(F.col("quality")))
        B.export({"events": now, "labels": flipped}, f"{folder}/{k}", low, {"events": "ts"})
    back = B.restore_chain(spark, [f"{folder}/{k}" for k in range(4)], keys)
    named = lambda name, id_, value: back[name].select(F.lit(name).alias("name"), F.col(id_).alias("id"), F.col(value).cast("string").alias("value"))
    return named("events", "event_id", "event_type").unionByName(named("labels", "doc_id", "quality"))


LINE = "event_id || ' ' || event_type || ' ' || repeat('x', CAST(event_id % 7 AS INTEGER))"


@R.add(f"SELECT {LINE} AS line FROM events WHERE event_id % 5 <> 0 ORDER BY event_id DESC LIMIT 200")
def log_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 lines of a log of all events, in which every fifth line is empty."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat_ws(" ", "event_id", "event_type", F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int"))))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e.orderBy("event_id").select(line.alias("value")).coalesce(1).write.text(path)  # a log is one file
    return log_tail(spark, spark.read.text(path).inputFiles()[0], 200)


@R.add(f"""SELECT CAST(1 AS INTEGER) AS run, count(*) AS n_rows, CAST({DIM} * count(*) AS BIGINT) AS n_numbers, count(DISTINCT text) AS n_sent FROM conversations WHERE role = 'user'
  UNION ALL SELECT 2, count(*), CAST({DIM} * count(*) AS BIGINT), (SELECT count(DISTINCT text) FROM conversations WHERE role <> 'user' AND text NOT IN (SELECT text FROM conversations WHERE role = 'user')) FROM conversations""")
def embedded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions embedded, then all turns beside them, over one cache: rows, numbers, and texts that went to the service."""
    turns, folder = table(spark, sf_dir, "conversations").select("role", "text"), f"{shared_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    service, out = lambda texts: [embed_one(t).tolist() for t in texts], []
    for k, rows in enumerate((turns.where("role = 'user'"), turns)):
        found = embed_texts(rows, service, "pairs-1", folder)
        out.append(found.agg(F.lit(k + 1).alias("run"), F.count("*").alias("n_rows"), F.sum(F.size("vector")).alias("n_numbers")))
    sent = spark.read.parquet(f"{folder}/vectors").groupBy("run").agg(F.count("*").alias("n"), F.max("_metadata.file_modification_time").alias("at"))
    numbered = sent.select(F.row_number().over(Window.orderBy("at")).alias("run"), F.col("n").alias("n_sent"))  # two runs
    return out[0].unionByName(out[1]).join(numbered, "run")
