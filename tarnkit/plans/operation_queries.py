"""Operational queries: joins, lockout, keyed changes, paging, export and stream state.

customer, orders and supplier play users, questions and bans; events play attempts and
requests; documents and their chunks play the stored library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions import checks, text as T
from tarnkit.operators import linking as L
from tarnkit.operators import lockout as K
from tarnkit.operators import tables as B
from tarnkit.plans.registry import Registry, table
from tarnkit.plans.text_queries import duck_chunks
from tarnkit.sources.shared import shared_dir, written
from tarnkit.streaming import state as W
from tarnkit.streaming import timed as Z

R = Registry()
AS_OF = "2024-01-20 12:00:00"
ATTEMPTS = """WITH attempts AS (SELECT CAST(user_id AS VARCHAR) AS username, '10.0.0.' || CAST(user_id % 20 AS VARCHAR) AS ip,
  CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS success, ts AS created_at FROM events WHERE event_type IN ('error', 'signup', 'purchase'))"""


def _streak(key: str, least: int) -> str:
    return f"""(SELECT a.{key}, count(*) AS fail_count, min(created_at) AS first_failure FROM attempts a LEFT JOIN (SELECT {key}, max(created_at) AS last FROM attempts WHERE success = 1 GROUP BY {key}) s USING ({key})
      WHERE success = 0 AND created_at > coalesce(last, TIMESTAMP '1970-01-01') GROUP BY a.{key} HAVING count(*) >= {least})"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.attempts_of(table(spark, sf_dir, "events"))


def _plain(column: str):
    """A timestamp without zone, as the tables have them."""
    return F.col(column).cast("timestamp_ntz").alias(column)


# joins

@R.add("""SELECT o_orderkey, o_orderpriority, c_name, CASE WHEN coalesce(c_nationkey, -1) % 5 = 0 THEN '公共库' ELSE coalesce(n_name, '') END AS product
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'""")
def pending_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = B.with_status(o.withColumnRenamed("o_orderstatus", "status"), "F", ("F", "O", "P")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    public = F.coalesce("c_nationkey", F.lit(-1)) % 5 == 0
    return joined.select("o_orderkey", "o_orderpriority", "c_name", F.when(public, "公共库").otherwise(F.coalesce("n_name", F.lit(""))).alias("product"))


@R.add("SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_name) AS names, count(n_name) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def names_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey", "r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.count("n_name").alias("n"))


BANS = """bans AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS username, o_orderdate AS unlocks_at
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1998-01-01')"""


def _bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate > timestamp_ntz'1998-01-01'")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    return urgent.select(name.alias("username"), F.col("o_orderdate").alias("unlocks_at"))


@R.add(f"WITH {BANS} SELECT c_custkey, c_name, unlocks_at FROM customer LEFT JOIN bans ON username = c_name OR username = CAST(c_custkey AS VARCHAR)")
def users_with_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    return L.either_key(users, _bans(spark, sf_dir), ("c_name", "key"), "username", "unlocks_at").select("c_custkey", "c_name", "unlocks_at")


@R.add(f"WITH {BANS} SELECT count(DISTINCT c_custkey) AS n FROM customer JOIN bans ON username = c_name OR username = CAST(c_custkey AS VARCHAR)")
def banned_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users_with_bans(spark, sf_dir).where("unlocks_at is not null").agg(F.countDistinct("c_custkey").alias("n"))


CHUNKS = duck_chunks()
SEGMENTS = f"segments AS (SELECT doc_id AS document_id, doc_id || '-' || chunk_index AS chunk_id, chunk_index * 10.0 AS start_time, chunk_index * 10.0 + 10 AS end_time, substring(chunk_text, 11, 40) AS content FROM ({CHUNKS}))"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(T.chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


def _segments(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    """A segment for each chunk."""
    start = F.col("chunk_index") * 10.0
    made = _chunks(spark, sf_dir) if chunks is None else chunks
    key = F.concat_ws("-", "document_id", "chunk_index")
    return made.select("document_id", key.alias("chunk_id"), key.alias("id"), start.alias("start_time"), (start + 10).alias("end_time"), F.substring("chunk_text", 11, 40).alias("content"))


@R.add(f"WITH c AS ({CHUNKS}), {SEGMENTS} SELECT doc_id AS document_id, chunk_index, coalesce(start_time, 0.0) AS start_time, coalesce(end_time, 0.0) AS end_time FROM c LEFT JOIN segments ON chunk_id = doc_id || '-' || chunk_index")
def hits_with_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_times(_chunks(spark, sf_dir).select("document_id", "chunk_index"), _segments(spark, sf_dir))


@R.add(f"WITH c AS ({CHUNKS}) SELECT DISTINCT b.doc_id AS document_id, b.chunk_index FROM c a JOIN c b ON a.doc_id = b.doc_id AND abs(b.chunk_index - a.chunk_index) <= 1 WHERE a.chunk_index % 5 = 0 AND b.chunk_index % 2 = 1")
def images_near_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir).select("document_id", "chunk_index")
    return L.near_images(c.where("chunk_index % 5 = 0"), c.where("chunk_index % 2 = 1"))


@R.add(f"""WITH c AS ({CHUNKS}), h AS (SELECT doc_id, chunk_index * 10.0 AS s, chunk_index * 10.0 + 10 AS e FROM c WHERE chunk_index % 20 = 3), f AS (SELECT doc_id, chunk_index * 7.0 AS t FROM c)
  SELECT doc_id AS document_id, t AS time FROM f WHERE EXISTS (SELECT 1 FROM h WHERE h.doc_id = f.doc_id AND t BETWEEN s - 30 AND e + 30)""")
def frames_near_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    hits = c.where("chunk_index % 20 = 3").select("document_id", (F.col("chunk_index") * 10.0).alias("start_time"), (F.col("chunk_index") * 10.0 + 10).alias("end_time"))
    return L.frames_in_time(c.select("document_id", (F.col("chunk_index") * 7.0).alias("time")), hits)


@R.add(f"""WITH c AS ({CHUNKS}), {SEGMENTS}, span AS (SELECT document_id, min(start_time) AS low, max(end_time) AS high FROM segments GROUP BY document_id)
  SELECT c.doc_id AS document_id, c.chunk_index, coalesce(min(start_time), any_value(low)) AS start_time, coalesce(max(end_time), any_value(high)) AS end_time
  FROM c JOIN span ON span.document_id = c.doc_id LEFT JOIN segments s ON s.document_id = c.doc_id AND contains(chunk_text, content) GROUP BY c.doc_id, c.chunk_index""")
def chunk_time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = written(_chunks(spark, sf_dir), "chunks")  # read by each side of each join
    return L.chunk_times(chunks, _segments(spark, sf_dir, chunks.toDF(*chunks.columns)))


# lockout

@R.add(ATTEMPTS + f"SELECT * FROM {_streak('username', 3)}")
def user_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.streaks(_attempts(spark, sf_dir), "username", 3).withColumn("first_failure", _plain("first_failure"))


@R.add(ATTEMPTS + f"SELECT * FROM {_streak('ip', 1)}")
def ip_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.streaks(_attempts(spark, sf_dir), "ip", 1).withColumn("first_failure", _plain("first_failure"))


@R.add(ATTEMPTS + "SELECT ip, created_at AS nth_failure FROM (SELECT ip, created_at, row_number() OVER (PARTITION BY ip ORDER BY created_at DESC) AS n FROM attempts WHERE success = 0) WHERE n = 50")
def fiftieth_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nth_recent_failure(_attempts(spark, sf_dir), "ip", 50).withColumn("nth_failure", _plain("nth_failure"))


@R.add(ATTEMPTS + "SELECT username, count(*) AS fail_count FROM attempts WHERE success = 0 AND created_at >= TIMESTAMP '2024-01-20' AND created_at < TIMESTAMP '2024-01-21' GROUP BY username HAVING count(*) >= 2")
def failures_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.daily_failures(_attempts(spark, sf_dir), "2024-01-20", 2)


@R.add(ATTEMPTS + f""", manual AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS username, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '10.1.0.' || s_suppkey END AS ip, TIMESTAMP '2024-01-15 00:00:00' + to_hours(s_suppkey * 2) AS unlocks_at FROM supplier)
  SELECT CASE WHEN username <> '' THEN 'manual_user' ELSE 'manual_ip' END AS type, username, ip, NULL::BIGINT AS fail_count, unlocks_at FROM manual WHERE unlocks_at > TIMESTAMP '{AS_OF}'
  UNION ALL SELECT 'user_consecutive', username, NULL, fail_count, first_failure + INTERVAL 1 HOUR FROM {_streak('username', 2)} WHERE first_failure + INTERVAL 1 HOUR > TIMESTAMP '{AS_OF}'
  UNION ALL SELECT 'user_daily', username, NULL, count(*), TIMESTAMP '2024-01-21' FROM attempts WHERE success = 0 AND created_at >= TIMESTAMP '2024-01-20' AND created_at < TIMESTAMP '2024-01-21' GROUP BY username HAVING count(*) >= 2
  UNION ALL SELECT 'ip', NULL, s.ip, fail_count, created_at + INTERVAL 10 DAY FROM {_streak('ip', 2)} s JOIN (SELECT ip, created_at, row_number() OVER (PARTITION BY ip ORDER BY created_at DESC) AS n FROM attempts WHERE success = 0) f ON f.ip = s.ip AND n = 2 WHERE created_at + INTERVAL 10 DAY > TIMESTAMP '{AS_OF}'""")
def active_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    unlocks = F.lit("2024-01-15").cast("timestamp") + F.make_dt_interval(hours=(F.col("s_suppkey") * 2).cast("int"))
    manual = s.select(F.when(even, F.col("s_name")).otherwise("").alias("username"), F.when(even, "").otherwise(F.concat(F.lit("10.1.0."), F.col("s_suppkey").cast("string"))).alias("ip"), unlocks.alias("unlocks_at"))
    return K.active_bans(_attempts(spark, sf_dir), manual, AS_OF, 2, 2, 2).withColumn("unlocks_at", _plain("unlocks_at"))


# keyed changes, paging, reuse

@R.add("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000 AND contains(lower(c_name), '#0000001') ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def customer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    found = c.where(B.all_of([checks.like_any_case(F.col("c_name"), "#0000001"), F.col("c_acctbal") > 1000, None])).select("c_custkey", "c_name", "c_acctbal")
    return B.page(found, [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 999)


@R.add("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT o_custkey, 'changed', arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey""")
def upserted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(-1).cast("long").alias("version"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("changed").alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("version"))
    return B.upsert(c, o, ["c_custkey"], "version").drop("version")


@R.add("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 23, r_name FROM region WHERE r_regionkey + 23 NOT IN (SELECT n_nationkey FROM nation)")
def inserted_or_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region")
    return B.insert_or_ignore(n, r.select((F.col("r_regionkey") + 23).alias("n_nationkey"), F.col("r_name").alias("n_name")), ["n_nationkey"])


@R.add(f"SELECT doc_id, count(*) AS n FROM ({CHUNKS}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id")
def chunks_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumnRenamed("document_id", "doc_id")
    return B.delete_by(chunks, table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@R.add("SELECT min(doc_id) AS id, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 <> 0 GROUP BY sha256(text) HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0)")
def documents_to_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four documents come in; of the stored rest a third failed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    stored = d.where("id % 4 = 0").withColumn("status", F.when(F.col("id") % 3 == 0, "failed").otherwise("success"))
    return B.new_documents(d.where("id % 4 != 0"), stored).select("id", "content_hash")


@R.add(f"""WITH c AS ({CHUNKS}), k AS (SELECT chunk_text, min_by(doc_id * 10000 + chunk_index, doc_id * 10000 + chunk_index) AS from_id FROM c WHERE doc_id % 2 = 0 GROUP BY chunk_text)
  SELECT c.doc_id AS document_id, c.chunk_index, from_id AS vector FROM c LEFT JOIN k USING (chunk_text) WHERE c.doc_id % 2 = 1""")
def chunks_with_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of odd documents with the vector, here a number, of an equal chunk of an even one."""
    c = _chunks(spark, sf_dir)
    key = F.col("document_id") * 10000 + F.col("chunk_index")
    return B.reuse_vectors(c.where("document_id % 2 = 1"), c.where("document_id % 2 = 0").select("chunk_text", key.alias("id"), key.alias("vector"))).select("document_id", "chunk_index", "vector")


@R.add("SELECT 'labels' AS name, count(*) AS rows FROM labels UNION ALL SELECT 'events', count(*) FROM events WHERE ts > TIMESTAMP '2024-01-15' UNION ALL SELECT 'customer', count(*) FROM customer")
def changes_to_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of an incremental export: a log by time, changing tables whole."""
    parts = [(n, B.changed_since(table(spark, sf_dir, n), "2024-01-15" if n == "events" else None, "ts")) for n in ("labels", "events", "customer")]
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@R.add("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
  SELECT user_id, event_id FROM n WHERE c <= 8 OR list_contains(list_transform(range(8), lambda j: CAST(floor(j * (c - 1) / 7.0) AS BIGINT)), i)""")
def sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight evenly spaced events of each user; sampling is the feature."""
    return B.evenly_sampled(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 8)


@R.add("SELECT lang, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS failed, NULL::BIGINT AS failed_id FROM documents GROUP BY lang UNION ALL SELECT lang, NULL, NULL, doc_id FROM documents WHERE doc_id % 3 = 0")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by language, and a row for each document that failed."""
    d = table(spark, sf_dir, "documents")
    totals = d.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("doc_id") % 3 == 0).alias("failed"), F.lit(None).cast("long").alias("failed_id"))
    none = F.lit(None).cast("long")
    return totals.unionByName(d.where("doc_id % 3 = 0").select("lang", none.alias("total"), none.alias("failed"), F.col("doc_id").alias("failed_id")))


@R.add("SELECT c_custkey, coalesce(o.n, s.n) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) o ON o_custkey = c_custkey, (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P') s")
def assigned_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's own open orders, or all where none is assigned."""
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    own = open_.groupBy("o_custkey").agg(F.count("*").alias("own"))
    total = open_.agg(F.count("*").alias("total"))
    return table(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").crossJoin(F.broadcast(total)).select("c_custkey", F.coalesce("own", "total").alias("n"))


@R.add("SELECT doc_id, CASE WHEN source = 'src3' THEN '' ELSE source END AS product_id FROM documents")
def product_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src3", "").otherwise(F.col("source")).alias("product_id"))


# stream state

NUMBERED = "e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
LIMITED = f"""WITH RECURSIVE {NUMBERED}, s AS (
  SELECT key, id, t, n, true AS allowed, [t] AS times FROM e WHERE n = 1
  UNION ALL SELECT key, id, t, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
  FROM (SELECT e.*, list_filter(s.times, lambda x: x > e.t - 345600000000) AS live FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))
  SELECT key, id, t AS "at", allowed FROM s"""
SESSIONS = f"""WITH RECURSIVE {NUMBERED}, s AS (
  SELECT key, id, t, n, CAST(1 AS BIGINT) AS session, t AS began, t + 86400000000 AS ends FROM e WHERE n = 1
  UNION ALL SELECT e.key, e.id, e.t, e.n, session + CASE WHEN e.t >= ends THEN 1 ELSE 0 END, CASE WHEN e.t >= ends THEN e.t ELSE began END,
    CASE WHEN e.t >= ends THEN e.t + 86400000000 WHEN ends - e.t < 43200000000 THEN least(e.t + 86400000000, began + 604800000000) ELSE ends END
  FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
  SELECT key, id, t AS "at", session FROM s"""

def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("value"))


@R.add(LIMITED)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests in four days for each user."""
    return W.rate_limited(_requests(spark, sf_dir), 3, 4 * 86400)


@R.add(SESSIONS)
def sliding_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(_requests(spark, sf_dir))


@R.add("""SELECT user_id AS key, event_id AS id, epoch_us(ts) AS at, CASE WHEN event_type <> 'error' THEN 0 ELSE count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY ts, event_id) END AS streak
  FROM (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)""")
def streak_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.failure_streaks(_requests(spark, sf_dir))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@R.add(SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of a stream with their sessions, which end by timers."""
    stream = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("at"))
    found = W.run_available(Z.session_stream(stream, "40 days"), shared_dir(spark), "sessions")
    return found.where(F.col("event") == Z.REQUEST).select("key", "id", "at", "session")


@R.add(SESSIONS.rsplit("SELECT", 1)[0] + """SELECT key, session, max(ends) AS "at" FROM s GROUP BY key, session
  QUALIFY session < max(session) OVER (PARTITION BY key) OR max(ends) <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""")
def stream_session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of sessions: where a next request came after it, or the watermark, an hour behind the newest event, has passed it."""
    stream = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("at"))
    found = W.run_available(Z.session_stream(stream, "1 hour"), shared_dir(spark), "sessions")
    return found.where(F.col("event") == Z.EXPIRED).select("key", "session", "at")


@R.add("""SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type FROM events)
  WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY start, event_type""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = W.tumbling_counts(_event_stream(spark, sf_dir), "ts", "6 hours", "1 day", "event_type")
    return W.run_available(counts, shared_dir(spark), "counts").withColumn("start", _plain("start"))


@R.add(LIMITED)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("at"))
    return W.run_available(W.rate_limited_stream(stream, 3, 4 * 86400), shared_dir(spark), "limit")


@R.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and kind; the life of a ticket spans the log."""
    stream = _event_stream(spark, sf_dir).withColumn("ticket", F.concat_ws(":", "user_id", "event_type"))
    return W.run_available(W.once_per_ticket(stream, "ticket", "ts", "60 days").select("user_id", "event_type"), shared_dir(spark), "tickets")


