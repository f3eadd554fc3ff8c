"""Queries around answers: routing, sources, review, feedback, probes and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnkit.functions import text as T
from tarnkit.operators import tables as B
from tarnkit.plans.operation_queries import BANS, CHUNKS, SEGMENTS, _bans, _chunks, _segments
from tarnkit.plans.registry import Registry, table

R = Registry()


@R.add("""SELECT conv_id, turn, CASE WHEN turn = 0 AND length(text) < 60 THEN 'greeting' WHEN contains(text, '###') OR contains(text, '***') THEN 'irrelevant' ELSE 'product' END AS intent FROM conversations WHERE role = 'user'""")
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent by rules that stand in for a model: short openings greet, junk is irrelevant."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    junk = F.col("text").contains("###") | F.col("text").contains("***")
    intent = F.when((F.col("turn") == 0) & (F.length("text") < 60), "greeting").when(junk, "irrelevant").otherwise("product")
    return asked.select("conv_id", "turn", intent.alias("intent"))


@R.add(f"""WITH c AS ({CHUNKS}), h AS (SELECT * FROM c WHERE chunk_index % 9 = 2)
  SELECT h.doc_id AS document_id, list(chunk_index ORDER BY chunk_index) AS indices, min(chunk_index) * 10.0 AS start_time, max(chunk_index) * 10.0 + 10 AS end_time FROM h GROUP BY h.doc_id""")
def hits_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _chunks(spark, sf_dir).where("chunk_index % 9 = 2")
    i = F.col("chunk_index")
    return hits.groupBy("document_id").agg(F.array_sort(F.collect_list(i)).alias("indices"), (F.min(i) * 10.0).alias("start_time"), (F.max(i) * 10.0 + 10).alias("end_time"))


@R.add(f"WITH c AS ({CHUNKS}) SELECT DISTINCT c.doc_id AS document_id, d.source AS name, d.lang AS type, substring(chunk_text, 1, 100) AS snippet FROM c JOIN documents d ON d.doc_id = c.doc_id WHERE chunk_index = 0")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an answer comes from: document, type and the first 100 characters of the hit."""
    hits = _chunks(spark, sf_dir).where("chunk_index = 0")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("name"), F.col("lang").alias("type"))
    return hits.join(docs, "document_id", "left").select("document_id", "name", "type", F.substring("chunk_text", 1, 100).alias("snippet")).distinct()


@R.add(f"""WITH c AS ({CHUNKS}), {SEGMENTS}
  SELECT 'text' AS kind, doc_id AS document_id, chunk_index AS place, chunk_text AS content FROM c
  UNION ALL SELECT 'transcript', document_id, CAST(start_time AS INTEGER), content FROM segments
  UNION ALL SELECT 'image', doc_id, 1000 + chunk_index, '' FROM c WHERE chunk_index % 2 = 1""")
def review_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of a document for review: text, transcript and images."""
    c, s = _chunks(spark, sf_dir), _segments(spark, sf_dir)
    text = c.select(F.lit("text").alias("kind"), "document_id", F.col("chunk_index").alias("place"), F.col("chunk_text").alias("content"))
    spoken = s.select(F.lit("transcript").alias("kind"), "document_id", F.col("start_time").cast("int").alias("place"), "content")
    image = c.where("chunk_index % 2 = 1").select(F.lit("image").alias("kind"), "document_id", (1000 + F.col("chunk_index")).alias("place"), F.lit("").alias("content"))
    return text.unionByName(spoken).unionByName(image)


@R.add(f"""WITH c AS ({CHUNKS}), f AS (SELECT doc_id, chunk_index FROM c WHERE chunk_index % 3 = 0)
  SELECT f.doc_id AS document_id, f.chunk_index, i.chunk_index IS NOT NULL AS has_image FROM f LEFT JOIN (SELECT * FROM c WHERE chunk_index % 2 = 1) i ON i.doc_id = f.doc_id AND i.chunk_index = f.chunk_index""")
def frames_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir).select("document_id", "chunk_index")
    images = c.where("chunk_index % 2 = 1").withColumn("has_image", F.lit(True))
    return c.where("chunk_index % 3 = 0").join(images, ["document_id", "chunk_index"], "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))


ANSWERS = """a AS (SELECT 'pending-answer-' || conv_id || '-' || turn AS document_id, 'pending-answer-' || conv_id || '-' || turn AS name, '问题：' || text || chr(10) || '回答：' || answer AS text
  FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant')"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).where("role = 'user' and next = 'assistant'")
    return pairs.select("conv_id", "turn", "answer", F.concat_ws("-", F.lit("pending-answer"), "conv_id", "turn").alias("document_id"), T.answer_document(F.col("text"), F.col("answer")).alias("text"))


@R.add(f"""WITH {ANSWERS} SELECT document_id, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 384 + 1 AS BIGINT), 512) AS chunk_text
  FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 512 THEN 1 ELSE CAST(ceil((length(text) - 512) / 384.0) AS BIGINT) + 1 END)) AS i FROM a)""")
def feedback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions as documents of their own, cut in chunks for the next search."""
    return _answers(spark, sf_dir).select("document_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@R.add(f"WITH {ANSWERS} SELECT document_id, substring(document_id, 16) AS question_id, starts_with(document_id, 'pending-answer-') AS from_answer FROM a")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question behind a hit, found by the id inside the document's id."""
    a = _answers(spark, sf_dir)
    hits = a.select("document_id")
    known = a.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"))
    keyed = hits.where(F.col("document_id").startswith("pending-answer-")).withColumn("question_id", F.expr("substring(document_id, 16)"))
    return keyed.join(known, "question_id").select("document_id", "question_id", F.lit(True).alias("from_answer"))


@R.add(f"WITH {BANS} SELECT username, max(unlocks_at) AS unlocks_at FROM bans WHERE unlocks_at > TIMESTAMP '1998-06-01' GROUP BY username")
def ban_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bans(spark, sf_dir).where("unlocks_at > timestamp_ntz'1998-06-01'").groupBy("username").agg(F.max("unlocks_at").alias("unlocks_at"))


@R.add("""SELECT a.event_id, count(b.event_id) AS recent FROM (SELECT * FROM events WHERE event_type = 'signup') a
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND b.ts > a.ts - INTERVAL 1 DAY AND b.ts < a.ts GROUP BY a.event_id""")
def resend_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a user got in the day before each."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000 + 1, -1)
    return e.withColumn("at", micros).select("event_id", F.count("*").over(w).alias("recent"))


@R.add("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def purged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention of seven days leaves; the filter reaches the scan."""
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-23'").select("event_id", "user_id")


@R.add(f"WITH {SEGMENTS} SELECT s.chunk_id, s.start_time FROM segments s JOIN documents d ON d.doc_id = s.document_id WHERE d.doc_id > 100")
def segments_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents made after a point, for the incremental export."""
    recent = table(spark, sf_dir, "documents").where("doc_id > 100").select(F.col("doc_id").alias("document_id"))
    return _segments(spark, sf_dir).join(recent, "document_id").select("chunk_id", "start_time")


@R.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)")
def in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that either of two tables refers to."""
    c = table(spark, sf_dir, "customer")
    by_order = c.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    by_nation = c.join(table(spark, sf_dir, "nation").where("n_regionkey = 0"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return by_order.select("c_custkey").unionByName(by_nation.select("c_custkey")).distinct()


@R.add("SELECT source FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0 AND doc_id < 30)")
def new_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where("doc_id % 2 = 0").select("source").subtract(d.where("doc_id % 3 = 0 and doc_id < 30").select("source"))


@R.add("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50; the limit is the feature."""
    o = B.with_status(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "P", ("P", "O", "F"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "o_totalprice")


@R.add("""SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) * 100 // count(*) OVER (PARTITION BY source) AS BIGINT) AS percent FROM documents""")
def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress that an import of each source reports after each document."""
    placed = B.placed(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    return placed.select("doc_id", "source", F.floor(F.col("place") * 100 / F.col("total")).alias("percent"))
