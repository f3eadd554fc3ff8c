"""Text functions as column expressions; texts are counted in code points throughout."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as trimming sees it, keyword separators, markup and entity tables.
SPACES = "\t\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = r"[ \t\n,.?!。，？！、：；“”（）()\[\]{}]+"
BLOCK_TAGS = ("div", "p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "pre", "section", "article", "header", "footer", "nav", "main")
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–",
    "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&laquo;": "«", "&raquo;": "»", "&amp;": "&",
}
MARKDOWN = (
    (r"(?dm)^#{1,6}\s+", ""),
    (r"(?d)\*\*(.+?)\*\*", "$1"),
    (r"(?d)__(.+?)__", "$1"),
    (r"(?d)\*(.+?)\*", "$1"),
    (r"(?d)_(.+?)_", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[([^\]]*)\]\(([^)]+)\)", "$1"),
    (r"\n{3,}", "\n\n"),
)
# What marks a field code's line, and the placeholders of master slides.
FIELD_CODES = ("HYPERLINK", "PAGEREF", "MERGEFORMAT", "TOC \\o", "TOC \\h", "\\l \"", " \\h")
SLIDE_NOISE = ("*", "二级", "三级", "四级", "五级", "Second level", "Third level", "Fourth level", "Fifth level")
SLIDE_NOISE_PARTS = (
    "单击此处编辑母版", "单击此处编辑母版标题样式", "单击此处编辑母版文本样式", "单击此处编辑母版副标题样式",
    "Click to edit Master title style", "Click to edit Master text styles", "Click to edit Master subtitle style",
)
REFUSALS = (
    "未提及", "未找到", "没有相关信息", "没有提及", "未涉及", "没有涉及", "无法从参考资料", "参考资料中没有", "没有找到相关", "未包含", "没有包含", "无相关信息", "暂无相关", "未能找到",
    "not mentioned", "no relevant information", "not found in the reference", "no information available", "does not contain", "do not have information",
    "not covered in the reference", "unable to find", "not available in the provided",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(c: Column, spaces: str = SPACES + "\n") -> Column:
    return F.btrim(c, F.lit(spaces))


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int")


def chunks(text: Column, size: int = 512, overlap: int = 128) -> Column:
    """Overlapping chunks in order; the last ends with the text. Linear in the text:
    it is cut once in pieces of one step, and a chunk joins the pieces it covers."""
    size = size if size > 0 else 512
    overlap = min(max(overlap, 0), size - 1)
    step, cover = size - overlap, -(-size // (size - overlap))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    n = chunk_count(F.length(text), size, overlap)
    made = let(pieces, lambda p: F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.array_join(F.slice(p, i, cover), ""), 1, size)))
    return F.when(F.length(text) > 0, made).otherwise(F.array().cast("array<string>"))


def clean_text(text: Column) -> Column:
    """Control characters out, spaces collapsed, lines trimmed, blank lines limited to one."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"\t[ \t]*+| [ \t]++", " ")  # single spaces stay unmatched
    lines = F.transform(F.split(out, "\n", -1), lambda line: trim_space(line, SPACES))
    return trim_space(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def strip_markdown(text: Column) -> Column:
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return trim_space(text)


def markdown_images(text: Column) -> Column:
    """Structs (alt, url) of image references."""
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("alt"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("url"))


def decode_named(text: Column) -> Column:
    """Named entities; the ampersand comes last, so nothing is decoded twice."""
    out = text
    for entity, to in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(to))
    return F.when(text.contains("&"), out).otherwise(text)


def code_point(base: int, digits: Column) -> Column:
    """The number, or null where it is no code point."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("bigint"))
    return F.when((n > 0) & (n < 0x110000), n)


def character(n: Column) -> Column:
    return F.when(n.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_numeric(text: Column) -> Column:
    """Decimal, then hexadecimal character references of valid code points."""
    for pattern, base in (("&#([0-9]+);", 10), ("(?i)&#x([0-9a-f]+);", 16)):
        pieces, every, digits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

        points = F.transform(digits, partial(code_point, base))
        decoded = F.array_append(F.zip_with(every, points, lambda ref, n: F.coalesce(character(n), ref)), F.lit(""))
        text = F.when(text.contains("&#"), F.array_join(F.zip_with(pieces, decoded, lambda a, b: F.concat(a, b)), "")).otherwise(text)
    return text


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, blocks on lines of their own."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, pattern, "")
    tags = "|".join(BLOCK_TAGS)
    # one pass over all block tags: no replacement makes a new tag for a later one
    html = F.regexp_replace(html, rf"(?i)<(?:{tags})[^>]*>|</(?:{tags})\s*>", "\n")
    html = F.regexp_replace(html, r"(?i)<t[dh][^>]*>", "\t")
    return F.regexp_replace(html, r"<[^>]+>", "")


def html_to_text(html: Column) -> Column:
    return let(strip_html(html), lambda text: let(decode_numeric(text), lambda out: clean_text(decode_named(out))))


def html_images(html: Column) -> Column:
    """Structs (src, alt) of images with a source that isn't inline data."""
    pattern = r"""(?i)<img[^>]*\bsrc\s*=\s*["']([^"']+)["'][^>]*>"""
    alt = lambda tag: F.regexp_extract(tag, r"""(?i)\balt\s*=\s*["']([^"']*)["']""", 1)
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("src"), F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("tag"))
    made = F.transform(both, lambda x: F.struct(F.trim(x["src"]).alias("src"), alt(x["tag"]).alias("alt")))
    return F.filter(made, lambda x: (x["src"] != "") & ~x["src"].startswith("data:"))


def base_of(html: Column, url: Column) -> Column:
    """What relative addresses of a page refer to: its url, else its base element, else null."""
    found = F.regexp_extract(html, r"""(?i)<base[^>]+href\s*=\s*["']([^"']+)["']""", 1)
    return F.when(F.coalesce(url, F.lit("")) != "", url).when(found != "", found)


def resolved(src: Column, base: Column) -> Column:
    """An address by the base: absolute ones stay, others take scheme, host and path from it."""
    scheme, host = F.regexp_extract(base, "^([^:/?#]+):", 1), F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query, path, rest = F.regexp_extract(base, r"(\?[^#]*)", 1), F.regexp_extract(src, "^([^?#]*)", 1), F.regexp_extract(src, "^[^?#]*(.*)$", 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(page, "^(.*/)", 1), path))
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    whole = F.when(path != "", F.concat(host, without_dots(joined), rest)).when(rest.startswith("?"), F.concat(host, page, rest)).otherwise(F.concat(host, page, query, rest))
    return F.when(base.isNull() | src.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), src).when(src.startswith("//"), F.concat(scheme, F.lit(":"), src)).otherwise(whole)


def without_dots(path: Column) -> Column:
    """A rooted path with . and .. segments worked out."""
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 20)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closing = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    made = F.concat(F.lit("/"), F.array_join(kept, "/"), closing)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(made, "^//+$", "/")).otherwise(path)


def keywords(text: Column) -> Column:
    """Distinct lower-cased words of two characters or more, in order."""
    return F.array_distinct(F.transform(F.filter(F.split(text, SEPARATORS, -1), lambda w: F.length(w) >= 2), F.lower))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, made in one linear pass."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    made = let(chars, lambda c: F.array_distinct(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b))))
    return F.when(F.length(text) >= 2, made).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    return let(F.size(F.array_intersect(a, b)), lambda i: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(i / (F.size(a) + F.size(b) - i)))


def text_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(jaccard(bigrams(F.lower(a)), bigrams(F.lower(b))))


def keyword_overlap(words: Column, lowered: Column) -> Column:
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: lowered.contains(w))) / F.size(words))


def text_score(words: Column, query_bigrams: Column, lowered: Column, chunk_bigrams: Column) -> Column:
    return 0.6 * keyword_overlap(words, lowered) + 0.4 * jaccard(query_bigrams, chunk_bigrams)


def refuses(answer: Column) -> Column:
    """Whether an answer says that it found nothing."""
    low = F.lower(answer)
    out = F.lit(False)
    for p in REFUSALS:
        out = out | low.contains(p)
    return out


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_json_object(text: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def intent(reply: Column, image: Column, product: Column) -> Column:
    """Intent of a question from a model's reply: that of the JSON object inside it, which may
    be empty. A question with an image, or to a knowledge base, isn't classified, and a reply
    without an object that can be read counts as product, as those do."""
    parsed = first_json_object(reply, "intent string").getField("intent")
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    readable = F.coalesce(F.get_json_object(body, "$").isNotNull(), F.lit(False))
    asked = F.when(readable, F.coalesce(parsed, F.lit(""))).otherwise("product")
    return F.when(F.coalesce(image, F.lit("")).eqNullSafe("") & ~F.coalesce(product == "knowledge_base", F.lit(False)), asked).otherwise("product")


def prompt(question: Column, context: Column) -> Column:
    """References numbered from 1, then the question."""
    lines = F.transform(context, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x, F.lit("\n")))
    return F.concat(F.lit("参考资料：\n"), F.array_join(lines, ""), F.lit("\n用户问题："), question)


def answer_document(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("问题："), question, F.lit("\n回答："), answer)


def answer_name(question: Column) -> Column:
    return F.concat(F.lit("管理员回答: "), truncate(question, 50))


SUMMARISE = "请根据管理员提供的回答内容，生成一个简洁、清晰的总结性回答。"  # fixed value: what a model is asked with an answer by hand


def image_answer(question: Column) -> Column:
    """The text by which an answer's image is found."""
    return F.concat(F.lit("[图片回答: "), truncate(question, 50), F.lit("]"))


def preview(text: Column, most: int = 5000) -> Column:
    """The first bytes of a long text and a note of its size; a character that is cut comes as U+FFFD."""
    size = F.octet_length(text)
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(size > most, F.concat(head, F.lit("\n...(内容已截断，共 "), size.cast("string"), F.lit(" 字符)"))).otherwise(text)


def mask_secret(secret: Column) -> Column:
    return F.when(F.length(secret) <= 4, "***").otherwise(F.concat(F.lit("***"), F.right(secret, F.lit(4))))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>|\x00-\x1f]', "_")


def drop_field_codes(text: Column) -> Column:
    """Lines of legacy word files without those that hold a field code; blank lines stay."""
    coded = lambda x: F.exists(F.array(*map(F.lit, FIELD_CODES)), lambda p: F.contains(trim_space(x), p))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~coded(x)), "\n")


def slide_noise(line: Column) -> Column:
    """Whether a line of a legacy slide comes from the master's placeholders."""
    out = line.isin(*SLIDE_NOISE)
    for part in SLIDE_NOISE_PARTS:
        out = out | line.contains(part)
    return out


def generate(question: Column, context: Column) -> Column:
    """The offline stand-in for a language model: the first reference, or a refusal without one."""
    return F.when(F.size(context) > 0, F.get(context, F.lit(0))).otherwise(F.lit("参考资料中没有相关信息"))


def pending_answer(answer: Column, found: Column) -> Column:
    """answer, sources and pending: a refusal goes to manual handling and loses its sources."""
    refused = refuses(answer)
    return F.struct(
        F.when(refused, F.lit("该问题已转交人工处理，请稍后查看回复")).otherwise(answer).alias("answer"),
        F.when(refused, F.array().cast("array<string>")).otherwise(found).alias("sources"),
        refused.alias("pending"),
    )
