"""Queries around the stored library: chunks by owner, knowledge entries, images, accounts and files' text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions import checks, text as T, transcripts
from tarnkit.operators import linking as L
from tarnkit.operators import lockout as K
from tarnkit.operators import tables as B
from tarnkit.plans.operation_queries import ATTEMPTS, BANS, CHUNKS, _attempts, _bans, _chunks
from tarnkit.plans.registry import Registry, table
from tarnkit.plans.text_queries import duck_chunks
from tarnkit.sources.shared import shared_dir

R = Registry()


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks owned by their document's source; src0 plays the public library."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("owner"), "text")
    return docs.select("document_id", "owner", F.posexplode(T.chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@R.add(f"SELECT doc_id || '-' || chunk_index AS id, doc_id AS document_id, chunk_index, CASE WHEN source = 'src0' THEN 'public' ELSE 'of-' || source END AS owner FROM ({duck_chunks('source,')}) WHERE source IN ('src0', 'src3')")
def chunks_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks stored by owner, and those that one owner sees, of its own folder and the public one."""
    path = f"{shared_dir(spark)}/library-{uuid.uuid4().hex}"
    B.store_chunks(_owned(spark, sf_dir), path)
    return B.stored_chunks(spark, path, "src3").select("id", "document_id", "chunk_index", "owner")


@R.add(f"""WITH e AS (SELECT conv_id * 10000 + turn AS doc_id, text, substring(text, 1, 40) AS title, (conv_id + turn) % 4 AS n FROM conversations WHERE role = 'assistant' AND trim(text) <> '')
  SELECT doc_id AS document_id, '知识录入: ' || title AS name, chunk_index, chunk_text, '' AS image_url FROM ({duck_chunks('title,', 'e')})
  UNION ALL SELECT doc_id, '知识录入: ' || title, CAST(base + i AS INTEGER), '[图片: ' || title || ']', '/api/images/' || doc_id || '-' || i || '.png' FROM e, (VALUES (1000), (2000)) b(base), range(3) r(i) WHERE i < n""")
def knowledge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by hand: text chunks from 0, images from 1000 by their text and from 2000 by their own vectors."""
    entries = table(spark, sf_dir, "conversations").where("role = 'assistant' and trim(text) != ''")
    key = F.col("conv_id") * 10000 + F.col("turn")
    urls = F.transform(F.when((F.col("conv_id") + F.col("turn")) % 4 > 0, F.sequence(F.lit(0), ((F.col("conv_id") + F.col("turn")) % 4).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("/api/images/"), key.cast("string"), F.lit("-"), i.cast("string"), F.lit(".png")))
    made = entries.select(key.alias("document_id"), F.substring("text", 1, 40).alias("title"), "text", urls.alias("images"))
    return B.knowledge_chunks(made, "text", "images")


@R.add("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site, regexp_extract(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) AS dir, regexp_extract(url, '^([^:]+):', 1) AS scheme, coalesce(url, '') <> '' AS based FROM pages)
  SELECT page_id, 'a' AS alt, CASE WHEN based THEN site ELSE '' END || '/i/' || page_id || '.png' AS image FROM p UNION ALL SELECT page_id, '', CASE WHEN based THEN scheme || ':' ELSE '' END || '//cdn.example.org/x.png?v=1' FROM p UNION ALL SELECT page_id, 'b', 'https://other.example.org/y.png' FROM p
  UNION ALL SELECT page_id, 'c', CASE WHEN NOT based THEN '' WHEN dir = '' THEN site || '/' ELSE site || dir END || 'z.png#f' FROM p""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages with alt texts and whole addresses, as they stand where a page has no url; the tags are added, as the pages hold none."""
    tags = F.concat(F.lit('<img src="/i/'), F.col("page_id").cast("string"), F.lit('.png" alt="a"><img alt=\'\' src=\' //cdn.example.org/x.png?v=1 \'><IMG ALT="b" SRC="https://other.example.org/y.png"><img src="z.png#f" alt="c"><img src="data:image/png;base64,AA">'))
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", T.base_of(F.col("html"), F.col("url")).alias("base"), F.explode(T.html_images(F.concat("html", tags))).alias("x"))
    return found.select("page_id", F.col("x.alt").alias("alt"), T.resolved(F.col("x.src"), F.col("base")).alias("image"))


@R.add(f"WITH c AS ({CHUNKS}), n AS (SELECT DISTINCT b.doc_id AS document_id, b.chunk_index FROM c a JOIN c b ON a.doc_id = b.doc_id AND abs(b.chunk_index - a.chunk_index) <= 1 WHERE a.chunk_index % 5 = 0 AND b.chunk_index % 2 = 1) SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS INTEGER) AS place FROM n QUALIFY place <= 5")
def images_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five images beside an answer; the cap is the feature."""
    c = _chunks(spark, sf_dir).select("document_id", "chunk_index")
    return L.capped_images(L.near_images(c.where("chunk_index % 5 = 0"), c.where("chunk_index % 2 = 1")))


@R.add("SELECT p_partkey AS id FROM part ORDER BY p_retailprice, p_partkey LIMIT 1")
def first_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first by creation, which the price plays; the limit is the feature."""
    return table(spark, sf_dir, "part").orderBy("p_retailprice", "p_partkey").limit(1).select(F.col("p_partkey").alias("id"))


@R.add("""WITH u AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS next, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  a AS (SELECT conv_id, turn, CASE WHEN contains(lower(question), 'er the') THEN '参考资料中没有相关信息' ELSE answer END AS answer FROM u WHERE role = 'user' AND next = 'assistant'),
  r AS (SELECT *, contains(answer, '没有相关信息') AS pending FROM a WHERE NOT regexp_matches(lower(answer), 'not mentioned|does not contain|unable to find'))
  SELECT conv_id, turn, CASE WHEN pending THEN '该问题已转交人工处理，请稍后查看回复' ELSE answer END AS answer, CAST(CASE WHEN pending THEN 0 ELSE 1 END AS BIGINT) AS n_sources, pending FROM r""")
def refusals_to_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers; a refusal, given where there is no reference, goes to manual handling without sources."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).where("role = 'user' and next = 'assistant'")
    context = F.when(F.lower("text").contains("er the"), F.array().cast("array<string>")).otherwise(F.array("answer"))
    told = turns.withColumn("context", context).withColumn("x", T.pending_answer(T.generate(F.col("text"), F.col("context")), F.col("context")))
    return told.select("conv_id", "turn", "x.answer", F.size("x.sources").cast("long").alias("n_sources"), "x.pending")


# text that files and tools leave

@R.add(r"""SELECT doc_id, array_to_string(list_filter(string_split(replace(replace(text, ' the ', chr(10) || 'HYPERLINK \l "x" '), ' and ', chr(10) || ' TOC \o y' || chr(10)), chr(10)), lambda x: NOT regexp_matches(x, 'HYPERLINK|PAGEREF|MERGEFORMAT|TOC \\o|TOC \\h|\\l "| \\h')), chr(10)) AS text FROM documents""")
def legacy_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without field codes; codes are put in for two words, as the documents hold none."""
    coded = F.replace(F.replace("text", F.lit(" the "), F.lit('\nHYPERLINK \\l "x" ')), F.lit(" and "), F.lit("\n TOC \\o y\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_field_codes(coded).alias("text"))


@R.add("""WITH l AS (SELECT conv_id, turn, unnest(string_split(replace(replace(text, '. ', chr(10)), ' of ', chr(10) || 'Second level' || chr(10) || 'Click to edit Master title style now' || chr(10)), chr(10))) AS line FROM conversations)
  SELECT conv_id, turn, count(*) AS n FROM l WHERE line NOT IN ('*', '二级', '三级', '四级', '五级', 'Second level', 'Third level', 'Fourth level', 'Fifth level') AND NOT contains(line, 'Click to edit Master') GROUP BY ALL""")
def legacy_slide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of slides without the master's placeholders, which are put in for a word."""
    marked = F.replace(F.replace("text", F.lit(". "), F.lit("\n")), F.lit(" of "), F.lit("\nSecond level\nClick to edit Master title style now\n"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(marked, "\n", -1)).alias("line"))
    return lines.where(~T.slide_noise(F.col("line"))).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


MARKED = " OR ".join(f"contains(lower(said), '{mark}')" for mark in transcripts.LOG_MARKS)


@R.add(f"SELECT conv_id, turn, CASE WHEN {MARKED} THEN '' ELSE said END AS spoken FROM (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS said FROM conversations)")
def spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser output with log lines around each turn's text; what was said comes out, unless it reads like a log line itself."""
    said = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    raw = F.concat(F.lit("[INFO] model loaded\n[0.00-9.00] x\n<|en|><|EMO|>"), said, F.lit("\nRTF: 0.1 on CPU\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", transcripts.transcript(raw).alias("spoken"))


@R.add("""SELECT event_id, CAST(event_id % 100 * 3600 + event_id % 60 * 60 + user_id % 60 + 0.25 AS DOUBLE) AS seconds FROM events""")
def stamp_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of time stamps as tools print them."""
    stamp = F.format_string("Duration: %02d:%02d:%02d.25, start", F.col("event_id") % 100, F.col("event_id") % 60, F.col("user_id") % 60)
    return table(spark, sf_dir, "events").select("event_id", transcripts.duration_seconds(stamp).alias("seconds"))


@R.add("""SELECT p_partkey, CASE WHEN length(p_name) <= 4 THEN '***' ELSE '***' || right(p_name, 4) END AS masked, regexp_replace(p_type || '/' || p_name || '?.txt', '[/\\:*?"<>|]', '_', 'g') AS file,
  CASE p_size % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' END AS image, CASE p_size % 4 WHEN 2 THEN 'mp4' WHEN 3 THEN 'avi' END AS video, p_partkey % 2 = 0 AS own_id, regexp_full_match(CASE WHEN p_size % 3 = 0 THEN p_type ELSE upper(md5(CAST(p_partkey AS VARCHAR))) END, '[0-9a-fA-F]{0,64}') AS any_id FROM part""")
def stored_file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked secrets, safe names, kinds by first bytes and ids of 32 hexadecimal digits."""
    heads = F.array(*(F.lit(bytes.fromhex(x)) for x in ("ffd8ffe000", "89504e470d0a1a0a00", "000000186674797069736f6d", "52494646aaaaaaaa41564920")))
    head = F.get(heads, (F.col("p_size") % 4).cast("int"))
    key = F.when(F.col("p_partkey") % 2 == 0, F.md5(F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    name = F.concat("p_type", F.lit("/"), "p_name", F.lit("?.txt"))
    return table(spark, sf_dir, "part").select("p_partkey", T.mask_secret(F.col("p_name")).alias("masked"), T.safe_filename(name).alias("file"), checks.image_magic(head).alias("image"), checks.video_magic(head).alias("video"), checks.hex_id(key).alias("own_id"), checks.optional_hex_id(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.upper(F.md5(F.col("p_partkey").cast("string"))))).alias("any_id"))


A, B_, C_, D_ = "(event_id * 7 + user_id) % 256", "(event_id * 31) % 256", "event_id % 3", "event_id % 5"


@R.add(f"""WITH a AS (SELECT event_id, {A} AS a, {B_} AS b, {C_} AS c, {D_} AS d FROM events)
  SELECT event_id, v, NOT (a = 127 OR a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 224 AND b = 0 AND c = 0) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 0 AND b = 0 AND c = 0 AND d = 0)) AS fetchable
  FROM a, (VALUES ('dotted'), ('mapped'), ('hex')) t(v)""")
def fetchable_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 addresses of events, dotted and mapped into IPv6 in two spellings."""
    e = table(spark, sf_dir, "events").select("event_id", *(F.expr(x).alias(n) for n, x in zip("abcd", (A, B_, C_, D_), strict=True)))
    dotted = F.concat_ws(".", *"abcd")
    spelled = {"dotted": dotted, "mapped": F.concat(F.lit("[::ffff:"), dotted, F.lit("]")), "hex": F.format_string("[0:0::ffff:%02x%02x:%02x%02x]", *map(F.col, "abcd"))}
    urls = F.array(*(F.struct(F.lit(v).alias("v"), F.concat(F.lit("http://"), host, F.lit(":8080/x")).alias("url")) for v, host in spelled.items()))
    return e.select("event_id", F.explode(urls).alias("x")).select("event_id", "x.v", checks.fetchable(F.col("x.url")).alias("fetchable"))


# accounts

@R.add(ATTEMPTS + """, w AS (SELECT CAST(user_id AS VARCHAR) AS username, '10.0.0.' || CAST(user_id % 20 AS VARCHAR) AS ip FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 = 0)),
  a AS (SELECT * FROM attempts UNION ALL SELECT username, ip, 1, TIMESTAMP '2024-01-25 00:00:00' FROM w)
  SELECT a.username, count(*) AS fail_count, min(created_at) AS first_failure FROM a LEFT JOIN (SELECT username, max(created_at) AS last FROM a WHERE success = 1 GROUP BY username) s USING (username) WHERE success = 0 AND created_at > coalesce(last, TIMESTAMP '1970-01-01') GROUP BY a.username""")
def streaks_after_unban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks once every seventh user has been let in again by hand."""
    log = _attempts(spark, sf_dir)
    who = table(spark, sf_dir, "events").where("user_id % 7 = 0").select(F.col("user_id").cast("string").alias("username"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")).alias("ip")).distinct()
    none = who.limit(0).withColumn("unlocks_at", F.lit("2024-01-01").cast("timestamp"))
    after, _ = K.unban(log, none, who, "2024-01-25")
    return K.streaks(after, "username", 1).withColumn("first_failure", F.col("first_failure").cast("timestamp_ntz"))


@R.add(f"""WITH {BANS}, m AS (SELECT CASE WHEN length(username) % 2 = 0 THEN username ELSE '' END AS username, CASE WHEN length(username) % 2 = 0 THEN '' ELSE username END AS ip, unlocks_at FROM bans),
  w AS (SELECT c_name AS username, CAST(c_custkey AS VARCHAR) AS ip FROM customer)
  SELECT w.username, w.ip, max(unlocks_at) AS unlocks_at FROM w JOIN m ON (m.username <> '' AND m.username = w.username) OR (m.ip <> '' AND m.ip = w.ip) WHERE unlocks_at > TIMESTAMP '1998-06-01' GROUP BY ALL""")
def bans_by_user_or_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is banned by name or by address, which keys of customers play."""
    even = F.length("username") % 2 == 0
    manual = _bans(spark, sf_dir).select(F.when(even, F.col("username")).otherwise("").alias("username"), F.when(even, "").otherwise(F.col("username")).alias("ip"), F.col("unlocks_at").cast("timestamp").alias("unlocks_at"))
    who = table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), F.col("c_custkey").cast("string").alias("ip"))
    return K.banned(manual, who, "1998-06-01").withColumn("unlocks_at", F.col("unlocks_at").cast("timestamp_ntz"))


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 AND c_name <> ''")
def login_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that can log in by password: those with a hash that isn't empty."""
    users = table(spark, sf_dir, "customer").withColumn("password_hash", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.sha2("c_name", 256)))
    return users.where("password_hash != '' and c_name != ''").select("c_custkey", "c_name")


@R.add("""SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality IS NOT NULL THEN 'success' ELSE 'processing' END AS status, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS error, CASE WHEN coalesce(toxic, 0) = 0 AND quality IS NOT NULL THEN sha256(text) ELSE '' END AS content_hash
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def document_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in as processing; each update of status, error and hash replaces its row."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    start = docs.select("doc_id", F.lit("processing").alias("status"), F.lit("").alias("error"), F.lit("").alias("content_hash"), F.lit(0).alias("at"))
    told = docs.join(labels, "doc_id")
    bad = F.col("toxic") == 1
    updates = told.select("doc_id", F.when(bad, "failed").otherwise("success").alias("status"), F.when(bad, "toxic").otherwise("").alias("error"), F.when(bad, "").otherwise(F.sha2("text", 256)).alias("content_hash"), F.lit(2).alias("at"))
    early = told.select("doc_id", F.lit("parsing").alias("status"), F.lit("").alias("error"), F.lit("").alias("content_hash"), F.lit(1).alias("at"))
    return B.upsert(start, early.unionByName(updates), ["doc_id"], "at").drop("at")


@R.add(f"WITH c AS ({CHUNKS}) SELECT doc_id AS document_id, 'transcript' AS kind, count(*) AS n FROM c GROUP BY doc_id UNION ALL SELECT doc_id, 'keyframe', count(*) FROM c WHERE chunk_index % 3 = 0 GROUP BY doc_id")
def segments_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments and keyframes (from 10000 on) appended to one table of segments."""
    c = _chunks(spark, sf_dir)
    spoken = c.select("document_id", F.lit("transcript").alias("kind"), F.col("chunk_index").alias("place"), F.col("chunk_text").alias("content"))
    frames = c.where("chunk_index % 3 = 0").select("document_id", F.lit("keyframe").alias("kind"), (F.col("chunk_index") + 10000).alias("place"), F.lit("").alias("content"))
    return B.insert_or_ignore(spoken, frames, ["document_id", "kind", "place"]).groupBy("document_id", "kind").agg(F.count("*").alias("n"))


@R.add("""SELECT 'customer' AS name, count(*) AS rows FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
  UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))""")
def customers_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays once the customers of one region and all their orders are gone."""
    gone = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    left = B.delete_by(table(spark, sf_dir, "customer"), gone, ["c_custkey"])
    orders = B.delete_by(table(spark, sf_dir, "orders"), gone.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])
    count = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
    return count(left, "customer").unionByName(count(orders, "orders"))


@R.add("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderstatus = 'P'""")
def lines_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of open orders replaced by one each, as a document's chunks are on a new import."""
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    fresh = open_.select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return B.replace_for(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), fresh, open_, "l_orderkey")


@R.add("SELECT 'labels' AS name, doc_id AS id, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT 'events', event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def exported_and_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental export written with its manifest, and the tables that the manifest brings back."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    B.export({n: table(spark, sf_dir, n) for n in ("labels", "events")}, path, "2024-01-15", {"events": "ts"})
    back = B.restore(spark, path)
    labels = back["labels"].select(F.lit("labels").alias("name"), F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("value"))
    return labels.unionByName(back["events"].select(F.lit("events").alias("name"), F.col("event_id").alias("id"), F.col("event_type").alias("value")))
