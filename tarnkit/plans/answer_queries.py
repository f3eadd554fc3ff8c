"""Queries around one answer: routing by a model's reply, images, feedback, tickets and files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnkit.functions import text as T
from tarnkit.operators import linking as L
from tarnkit.operators import tables as B
from tarnkit.plans.operation_queries import CHUNKS, _chunks, _event_stream
from tarnkit.plans.registry import Registry, table
from tarnkit.sources import files
from tarnkit.sources.compound import write_xls
from tarnkit.sources.shared import shared_dir
from tarnkit.streaming import state as W
from tarnkit.streaming import timed as Z

R = Registry()


@R.add("""SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 OR conv_id % 11 = 0 THEN 'product' WHEN turn % 6 = 0 THEN 'greeting' WHEN turn % 6 = 2 THEN 'product' ELSE CASE conv_id % 3 WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'product' ELSE '' END END AS intent
  FROM conversations WHERE role = 'user'""")
def routed_by_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent by a model's reply, which may be wrapped in prose, broken, missing or without an
    intent; questions with images and those to a knowledge base aren't classified."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    c, t = F.col("conv_id") % 3, F.col("turn") % 6
    rest = F.when(c == 0, 'Sure: {"intent": "irrelevant", "reason": "weather"} ok').when(c == 1, '{"intent": irrelevant').otherwise('{"reason": "none"}')
    reply = F.when(t == 0, '```json\n{"intent": "greeting"}\n```').when(t == 2, "greeting").otherwise(rest)
    image = F.when(F.col("conv_id") % 7 == 0, "data:image/png;base64,AA")
    product = F.when(F.col("conv_id") % 11 == 0, "knowledge_base").otherwise("service")
    return asked.select("conv_id", "turn", T.intent(reply, image, product).alias("intent"))


@R.add(f"WITH c AS ({CHUNKS}) SELECT DISTINCT b.doc_id AS document_id, CAST(1000 + b.chunk_index AS INTEGER) AS chunk_index FROM c a JOIN c b ON a.doc_id = b.doc_id AND abs(b.chunk_index - a.chunk_index) <= 1 WHERE a.chunk_index % 6 = 0 AND b.chunk_index % 2 = 1")
def page_images_near_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of scanned pages, numbered from 1000, near text hits."""
    c = _chunks(spark, sf_dir).select("document_id", "chunk_index")
    return L.near_images(c.where("chunk_index % 6 = 0"), c.where("chunk_index % 2 = 1").withColumn("chunk_index", F.col("chunk_index") + 1000), L.IMAGE_BASE)


@R.add(f"""WITH c AS ({CHUNKS}), h AS (SELECT doc_id % 50 AS query_id, doc_id, chunk_index, CASE WHEN chunk_index % 40 = 35 THEN '/h' ELSE '' END AS url FROM c WHERE chunk_index % 5 = 0),
  i AS (SELECT doc_id, CAST(CASE WHEN chunk_index % 4 = 1 THEN chunk_index ELSE chunk_index + 1000 END AS INTEGER) AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '/i/' || doc_id || '-' || chunk_index END AS url FROM c WHERE chunk_index % 2 = 1),
  n AS (SELECT DISTINCT query_id, i.doc_id AS document_id, i.chunk_index, i.url AS image_url FROM h JOIN i ON h.doc_id = i.doc_id AND abs(CASE WHEN i.chunk_index >= 1000 THEN i.chunk_index - 1000 ELSE i.chunk_index END - h.chunk_index) <= 1
    WHERE i.url <> '' AND query_id NOT IN (SELECT query_id FROM h WHERE url <> ''))
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) AS INTEGER) AS place FROM n QUALIFY place <= 5""")
def answers_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images put beside the answers whose hits have none, five at most; the cap is the feature."""
    c, i = _chunks(spark, sf_dir).select("document_id", "chunk_index"), F.col("chunk_index")
    hits = c.where("chunk_index % 5 = 0").select((F.col("document_id") % 50).alias("query_id"), "document_id", "chunk_index", F.when(i % 40 == 35, "/h").otherwise("").alias("image_url"))
    url = F.when(F.col("document_id") % 3 == 0, "").when(F.col("document_id") % 3 == 1, F.concat_ws("-", F.concat(F.lit("/i/"), "document_id"), "chunk_index"))
    images = c.where("chunk_index % 2 = 1").select("document_id", F.when(i % 4 == 1, i).otherwise(i + 1000).alias("chunk_index"), url.alias("image_url"))
    return L.enriched(hits, images)


@R.add("SELECT doc_id, source FROM documents WHERE source = 'src3' OR source = 'src0'")
def documents_of_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a product's list shows: its own and the public ones, which src0 plays."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(B.all_of([None, F.col("source").isin("src3", "src0")])).select("doc_id", "source")


TOLD = """a AS (SELECT conv_id || '-' || turn AS id, text AS question, answer, (conv_id + turn) % 3 AS n FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant')"""


def _feedback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations")
    asked = turns.withColumn("next", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).where("role = 'user'")
    key = F.concat_ws("-", "conv_id", "turn").alias("id")
    n = ((F.col("conv_id") + F.col("turn")) % 3).cast("int")
    images = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("/a/"), "conv_id", F.lit("-"), "turn", F.lit("-"), i))).otherwise(F.array().cast("array<string>"))
    answers = asked.where("next = 'assistant'").select(key, F.col("text").alias("question"), "answer", images.alias("images"))
    pending = asked.select(key, F.lit("pending").alias("status"), F.lit(None).cast("string").alias("answer"))
    return B.feedback(answers, pending)


@R.add(f"""WITH {TOLD} SELECT 'pending-answer-' || id AS document_id, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 384 + 1 AS BIGINT), 512) AS chunk_text, '' AS image_url
  FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 512 THEN 1 ELSE CAST(ceil((length(text) - 512) / 384.0) AS BIGINT) + 1 END)) AS i FROM (SELECT id, '问题：' || question || chr(10) || '回答：' || answer AS text FROM a))
  UNION ALL SELECT 'pending-answer-' || id, CAST(1000 + i AS INTEGER), '[图片回答: ' || CASE WHEN length(question) > 50 THEN substring(question, 1, 50) || '...' ELSE question END || ']', '/a/' || id || '-' || (i + 1) FROM a, range(2) r(i) WHERE i < n""")
def feedback_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of answers by hand: text from 0, images from 1000."""
    return _feedback(spark, sf_dir)[0]


@R.add(f"WITH {TOLD} SELECT conv_id || '-' || turn AS id, CASE WHEN answer IS NULL THEN 'pending' ELSE 'answered' END AS status, answer, answer AS llm_answer FROM conversations c LEFT JOIN a ON a.id = conv_id || '-' || turn WHERE role = 'user'")
def feedback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions, of which those with an answer by hand are no longer pending."""
    return _feedback(spark, sf_dir)[1]


@R.add("""SELECT conv_id || '-' || turn AS id, CASE WHEN 2000 * strlen(text) > 100000 AND turn % 5 = 0 THEN 'answer too long' WHEN conv_id % 10 = 9 THEN 'too many images' WHEN conv_id % 7 = 0 THEN 'not found' WHEN conv_id % 4 = 0 AND turn % 3 <> 0 THEN 'already answered' END AS reason FROM conversations""")
def answers_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why answers by hand are refused: very long ones, many images, unknown questions, and answered ones that aren't edited."""
    turns, key = table(spark, sf_dir, "conversations"), F.concat_ws("-", "conv_id", "turn").alias("id")
    images = F.array_repeat(F.lit("/x"), F.when(F.col("conv_id") % 10 == 9, 51).otherwise(50))
    answers = turns.select(key, F.repeat("text", F.when(F.col("turn") % 5 == 0, 2000).otherwise(1)).alias("answer"), images.alias("images"), (F.col("turn") % 3 == 0).alias("edit"))
    pending = turns.where("conv_id % 7 <> 0").select(key, F.when(F.col("conv_id") % 4 == 0, "answered").otherwise("pending").alias("status"))
    return B.judged_answers(answers, pending).select("id", "reason")


@R.add("SELECT p_partkey AS id, p_name AS value, p_name NOT IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) AS free FROM part UNION ALL SELECT -s_suppkey, s_name, s_name NOT IN (SELECT p_name FROM part) FROM supplier")
def names_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part may keep its name, and a supplier's name could be a new part's."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    new = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("value"))
    return B.free_values(parts.unionByName(new), parts)


TICKETS = """WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t, CASE WHEN event_type = 'signup' THEN event_id ELSE last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS ticket FROM events),
  u AS (SELECT u.ticket, u.event_id AS id, u.t AS "at", u.t < i.t + 43200000000 AS valid FROM e u JOIN e i ON i.event_id = u.ticket WHERE u.event_type = 'click')
  SELECT ticket, id, "at", valid AND id = first_value(id) OVER (PARTITION BY ticket ORDER BY NOT valid, "at", id) AS used FROM u"""


def _tickets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sign-ups as issued tickets, and clicks that try their user's newest one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("ticket", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    issued = e.where("event_type = 'signup'").select(F.col("event_id").alias("ticket"), "at")
    return issued, e.where("event_type = 'click' and ticket is not null").select("ticket", F.col("event_id").alias("id"), "at")


@R.add(TICKETS)
def tickets_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that try their user's newest ticket, which lives for half a day and is good for one use."""
    return W.first_uses(*_tickets(spark, sf_dir), 12 * 3600)


@R.add(f'SELECT ticket, id, "at" FROM ({TICKETS}) WHERE used')
def stream_redeemed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as two streams that are joined; a row a year later in each lets all open tickets end."""
    issued, uses = _tickets(spark, sf_dir)
    later = lambda df, *columns: df.unionByName(df.agg(F.max("at").alias("last")).select(*(F.lit(-1).cast("long").alias(c) for c in columns), (F.col("last") + 365 * 24 * W.HOUR).alias("at")).where("at is not null"))
    streams = [W.replayed(later(df, *columns), shared_dir(spark), name) for df, name, columns in ((issued, "issued", ("ticket",)), (uses, "uses", ("ticket", "id")))]
    return W.run_available(Z.redeemed(*streams, 12 * 3600), shared_dir(spark), "redeemed").where("ticket >= 0")


@R.add("SELECT event_type, count(*) AS done, count(*) AS total, CAST(100 AS BIGINT) AS percent FROM events GROUP BY event_type")
def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a streamed import reports at its end, by kind of event."""
    totals = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"))
    return W.report_progress(_event_stream(spark, sf_dir), "event_type", totals, shared_dir(spark))


PLAIN = r"trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g'))"


@R.add(f"SELECT conv_id, turn, role || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END || chr(10) || chr(10) || 'page ' || turn AS text FROM (SELECT conv_id, turn, role, {PLAIN} AS t FROM conversations)")
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns printed to PDF files of two pages, and read back; the text is in codes of a font with a ToUnicode table."""
    turns = table(spark, sf_dir, "conversations")
    plain = F.trim(F.regexp_replace("text", r"[\x00-\x20]+", " "))
    code = F.hex(F.encode(plain, "UTF-16BE"))
    used = F.array_distinct(F.regexp_extract_all(code, F.lit("[0-9A-F]{4}"), F.lit(0)))
    named = F.array_join(F.transform(used, lambda c: F.concat(F.lit("<"), c, F.lit("> <"), c, F.lit(">"))), "\n")
    stream = lambda number, *body: (F.lit(f"{number} 0 obj\n<< /Length 0 >>\nstream\n"), *body, F.lit("\nendstream\nendobj\n"))
    body = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 >>\nendobj\n"),
        F.lit("3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F2 7 0 R >> >> >>\nendobj\n5 0 obj\n<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>\nendobj\n"),
        *stream(4, F.lit("BT /F1 12 Tf 72 720 Td ("), F.col("role"), F.lit(") Tj 0 -14 Td /F2 12 Tf [<"), code, F.lit(">] TJ ET")),
        *stream(6, F.lit("BT (page) Tj [-300("), F.col("turn").cast("string"), F.lit(")] TJ ET")),
        F.lit("7 0 obj\n<< /Type /Font /ToUnicode 8 0 R >>\nendobj\n"),
        *stream(8, F.lit("1 beginbfchar\n"), named, F.lit("\nendbfchar")),
        F.lit("%%EOF\n"),
    )
    printed = turns.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.lit("pdf").alias("kind"), F.encode(body, "US-ASCII").alias("content"))
    read = files.parse(printed).withColumn("at", F.split("path", "/"))
    return read.select(F.get("at", F.lit(0)).cast("long").alias("conv_id"), F.get("at", F.lit(1)).cast("long").alias("turn"), "text")


@R.add("SELECT s_nationkey AS nation, CAST(s_suppkey AS DOUBLE) AS suppkey, s_name AS name, s_acctbal AS acctbal FROM supplier")
def xls_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers printed to one legacy workbook a nation, and read back from its cells."""
    suppliers = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")

    def book(key: tuple, rows: pa.Table) -> pa.Table:
        lines = [[float(k), name, balance] for k, name, balance in sorted(zip(*(rows.column(c).to_pylist() for c in range(1, 4)), strict=True))]
        return pa.table({"path": [str(key[0].as_py())], "kind": ["excel_legacy"], "content": pa.array([write_xls(f"nation{key[0].as_py()}", lines)], pa.binary())})

    read = files.parse(suppliers.groupBy("s_nationkey").applyInArrow(book, "path string, kind string, content binary"))
    cell = F.expr("regexp_extract_all(line, '^nation([0-9]+)-([0-9]+),([0-9]+): (.*)$', 0)")
    lines = read.select(F.explode(F.split("text", "\n")).alias("line")).where(F.size(cell) == 1)
    part = lambda k: F.regexp_extract("line", r"^nation([0-9]+)-([0-9]+),([0-9]+): (.*)$", k)
    cells = lines.select(part(1).cast("int").alias("nation"), part(2).cast("int").alias("row"), part(3).cast("int").alias("column"), part(4).alias("value"))
    value = lambda k: F.max(F.when(F.col("column") == k, F.col("value")))
    found = cells.groupBy("nation", "row").agg(value(1).cast("double").alias("suppkey"), value(2).alias("name"), value(3).cast("double").alias("acctbal"))
    return found.drop("row")
