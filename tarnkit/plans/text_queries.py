"""Text preparation over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions import checks, text as T
from tarnkit.plans.registry import Registry, table
from tarnkit.sources.shared import spread

R = Registry()
DUCK_WHITE = r"\t\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def duck_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{DUCK_WHITE}\n]+|[{DUCK_WHITE}\n]+$', '', 'g')"


def duck_clean(x: str) -> str:
    out = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '[{DUCK_WHITE}]*\n[{DUCK_WHITE}]*', chr(10), 'g')"
    return duck_trim(f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def duck_chunks(columns: str = "", source: str = "documents", body: str = "text", size: int = 512, overlap: int = 128) -> str:
    step = size - overlap
    return f"""SELECT doc_id, {columns} CAST(i AS INTEGER) AS chunk_index, substring({body}, CAST(i * {step} + 1 AS BIGINT), {size}) AS chunk_text
      FROM (SELECT *, unnest(range(CASE WHEN length({body}) <= {size} THEN 1 ELSE CAST(ceil((length({body}) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i FROM {source} WHERE length({body}) > 0)"""


DUCK_BLOCK = "|".join(T.BLOCK_TAGS)


def duck_html(x: str) -> str:
    for p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    x = f"regexp_replace({x}, '(?i)<(?:{DUCK_BLOCK})[^>]*>|</(?:{DUCK_BLOCK})\\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)<t[dh][^>]*>', chr(9), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, to in T.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{to.replace(chr(39), chr(39) * 2)}')"
    return duck_clean(x)


def duck_bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substring({x}, i, 2)))"


def duck_keywords(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array({x}, '{T.SEPARATORS}'), lambda w: length(w) >= 2), lambda w: lower(w)))"


@R.add(duck_chunks("source,"))
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "source", F.posexplode(T.chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@R.add(duck_chunks("", size=200, overlap=150))
def chunk_dense_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.chunks(F.col("text"), 200, 150)).alias("chunk_index", "chunk_text"))


@R.add("SELECT doc_id, " + duck_clean("text") + " AS cleaned FROM documents")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def duck_markdown(x: str) -> str:
    for pattern, to in T.MARKDOWN:
        pattern = pattern.replace("(?dm)", "(?m)").replace("(?d)", "")
        to = "chr(10) || chr(10)" if "\n" in to else "'" + to.replace("$1", "\\1") + "'"
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return duck_trim(x)


@R.add("SELECT doc_id, " + duck_markdown("text") + " AS plain, len(regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)')) AS n_images FROM documents")
def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.strip_markdown(F.col("text")).alias("plain"), F.size(T.markdown_images(F.col("text"))).cast("long").alias("n_images"))


@R.add("SELECT page_id, url, " + duck_html("html") + " AS text FROM pages")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", "url", T.html_to_text(F.col("html")).alias("text"))


@R.add("""SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '(?i)<img[^>]*\\bsrc\\s*=\\s*["'']([^"'']+)["''][^>]*>', 1), lambda s: trim(s) <> '' AND NOT starts_with(trim(s), 'data:'))) AS BIGINT) AS n_images FROM pages""")
def html_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(T.html_images(F.col("html"))).cast("long").alias("n_images"))


@R.add(f"SELECT conv_id, turn, unnest({duck_keywords('text')}) AS keyword FROM conversations WHERE role = 'user'")
def question_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.explode(T.keywords(F.col("text"))).alias("keyword"))


@R.add(f"SELECT conv_id, turn, CAST(len({duck_bigrams('lower(text)')}) AS BIGINT) AS n_bigrams FROM conversations")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.bigrams(F.lower("text"))).cast("long").alias("n_bigrams"))


@R.add(f"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
  b AS (SELECT *, {duck_bigrams('lower(text)')} AS x, {duck_bigrams('lower(before)')} AS y FROM t WHERE before IS NOT NULL)
  SELECT conv_id, turn, round(CASE WHEN text = before THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0
    ELSE len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE) END, 6) AS similarity FROM b""")
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("before", before).where("before is not null")
    return turns.select("conv_id", "turn", F.round(T.text_similarity(F.col("text"), F.col("before")), 6).alias("similarity"))


@R.add("SELECT doc_id, sha256(text) AS content_hash, md5(text) AS digest FROM documents")
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.md5("text").alias("digest"))


@R.add("SELECT lang, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM documents GROUP BY lang, source")
def import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@R.add("SELECT doc_id, substring(text, 1, 100) AS snippet, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS short FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("snippet"), T.truncate(F.col("text"), 50).alias("short"))


@R.add("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{p}')" for p in (*T.REFUSALS, "er the")) + " AS refused FROM conversations WHERE role = 'assistant'")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusal phrases; 'er the' stands in for one, as the table's prose has none."""
    told = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return told.select("conv_id", "turn", (T.refuses(F.col("text")) | F.lower("text").contains("er the")).alias("refused"))


@R.add("""SELECT u.conv_id, '参考资料：' || chr(10) || string_agg('[' || CAST(k AS VARCHAR) || '] ' || a.text || chr(10), '' ORDER BY a.turn) || chr(10) || '用户问题：' || any_value(u.text) AS prompt
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') a
  JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) u USING (conv_id) GROUP BY u.conv_id""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a conversation as references for its first question."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("context"))
    return first.join(answers, "conv_id").select("conv_id", T.prompt(F.col("question"), F.col("context")).alias("prompt"))


@R.add("""SELECT conv_id, turn, '问题：' || text || chr(10) || '回答：' || answer AS body, '管理员回答: ' || CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS name
  FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'""")
def answer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).where("role = 'user' and next = 'assistant'")
    return pairs.select("conv_id", "turn", T.answer_document(F.col("text"), F.col("answer")).alias("body"), T.answer_name(F.col("text")).alias("name"))


@R.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", T.first_json_object(F.col("props"), "k bigint")["k"].alias("k"), "event_type")


@R.add("""WITH h AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(lower(url), '^https?://([^/]*)', 1), ':[^:]*$', '')) AS host FROM pages)
  SELECT page_id, host, regexp_matches(lower(url), '^https?://') AND NOT contains(url, '@') AND host <> '' AND NOT regexp_matches(host, '\\.(internal|local)$') AND host <> 'localhost' AS fetchable FROM h""")
def fetchable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", checks.url_host(F.col("url")).alias("host"), checks.fetchable(F.col("url")).alias("fetchable"))


@R.add("""WITH n AS (SELECT page_id, html, strlen(html) AS size, CASE WHEN strlen(left(html, 5000)) <= 5000 THEN least(5000, length(html)) ELSE list_max(list_filter(range(1250, 5001), lambda k: strlen(left(html, k)) <= 5000)) END AS n FROM pages)
  SELECT page_id, CASE WHEN size > 5000 THEN left(html, n) || CASE WHEN strlen(left(html, n)) < 5000 THEN chr(65533) ELSE '' END || chr(10) || '...(内容已截断，共 ' || size || ' 字符)' ELSE html END AS preview,
    size > 5000 AS cut, regexp_matches(lower(substring(html, 1, 512)), '<!doctype html|<html|<head|<body') AS is_html FROM n""")
def page_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.preview(F.col("html")).alias("preview"), (F.octet_length("html") > 5000).alias("cut"), checks.looks_like_html(F.col("html")).alias("is_html"))


@R.add("SELECT p_partkey, regexp_replace(lower(p_type), '_legacy$', '') AS kind, length(p_name) >= 8 AND regexp_matches(p_name, '[A-Za-z]') AND regexp_matches(p_name, '[0-9]') AND strlen(p_name) <= 72 AS strong FROM part")
def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", checks.base_type(F.lower("p_type")).alias("kind"), checks.valid_password(F.col("p_name")).alias("strong"))
