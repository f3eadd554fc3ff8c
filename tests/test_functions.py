import math
import re

import pytest
from pyspark.sql import functions as F

from tarnkit.functions import checks, text as T, transcripts, vectors as V


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def chunk_model(text, size, overlap):
    out, step = [], size - overlap
    for at in range(0, len(text), step):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
    return out


@pytest.mark.parametrize("n", [0, 1, 512, 513, 895, 896, 897, 5000])
@pytest.mark.parametrize("size,overlap", [(512, 128), (10, 9), (7, 0)])
def test_chunks(spark, n, size, overlap):
    text = "".join("aé漢\n😀"[i % 5] for i in range(n))
    assert one(spark, text, lambda c: T.chunks(c, size, overlap)) == chunk_model(text, size, overlap)


def test_chunks_repair_their_parameters(spark):
    text = "x" * 600
    assert one(spark, text, lambda c: T.chunks(c, 0, 128)) == chunk_model(text, 512, 128)
    assert one(spark, text, lambda c: T.chunks(c, 5, 9)) == chunk_model(text, 5, 4)
    assert one(spark, text, lambda c: T.chunks(c, 5, -3)) == chunk_model(text, 5, 0)


@pytest.mark.parametrize(
    "raw,clean",
    [("a \t b", "a b"), (" a \n\n\n\n b\x00 ", "a\n\nb"), ("　a \n b", "a\nb"), ("", ""), ("\n \n", ""), ("a\x85", "a")],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


@pytest.mark.parametrize(
    "raw,plain",
    [("# Title\n**b** and _i_", "Title\nb and i"), ("[t](u)", "t"), ("![alt](u)", "!alt"), ("![](u)", ""), ("`code` __x__", "code x")],
)
def test_markdown(spark, raw, plain):
    assert one(spark, raw, T.strip_markdown) == plain


def test_markdown_images(spark):
    assert [tuple(x) for x in one(spark, "![a](b.png) ![](c)", T.markdown_images)] == [("a", "b.png"), ("", "c")]


@pytest.mark.parametrize(
    "raw,text",
    [
        ("<p>a</p><script>x<y</script>b<br/>c", "a\nb\nc"),
        ("<tr><td>1</td><td>2</td></tr>", "1 2"),
        ("&amp;lt; &#65;&#x42; &#0; &nbsp;|", "&lt; AB &#0; |"),
        ("<!-- <p>no</p> --><pre>x</pre>", "x"),
        ("&copy;&hellip;&laquo;", "©…«"),
    ],
)
def test_html(spark, raw, text):
    assert one(spark, raw, T.html_to_text) == text


def test_html_images(spark):
    html = '<img src="a.png" alt="x"><img src="data:abc"><IMG SRC=\'/b\'>'
    assert [x.src for x in one(spark, html, T.html_images)] == ["a.png", "/b"]


def bigram_model(s):
    return {s[i : i + 2] for i in range(len(s) - 1)}


def keyword_model(s):
    out = []
    for w in re.split(r"[ \t\n,.?!。，？！、：；“”（）()\[\]{}]", s):
        if len(w) >= 2 and w.lower() not in out:
            out.append(w.lower())
    return out


@pytest.mark.parametrize("question", ["How to reset my password?", "如何（重置）密码？How", "...", "", "a b c", "Aa aA"])
@pytest.mark.parametrize("chunk", ["to reset a password, press 重置密码", "x", "", "how how"])
def test_text_score(spark, question, chunk):
    words, a, b = keyword_model(question), bigram_model(question.lower()), bigram_model(chunk.lower())
    overlap = sum(w in chunk.lower() for w in words) / len(words) if words else 0
    want = 0.6 * overlap + 0.4 * (len(a & b) / len(a | b) if a and b else 0)
    df = spark.createDataFrame([(question, chunk)], "q string, c string")
    low = F.lower("c")
    got = df.select(T.text_score(T.keywords(F.col("q")), T.bigrams(F.lower("q")), low, T.bigrams(low)).alias("s")).first().s
    assert got == pytest.approx(want)


def test_text_similarity(spark):
    df = spark.createDataFrame([("Ab", "Ab"), ("AB", "ab"), ("", "a"), ("x", "x")], "a string, b string")
    assert [r.s for r in df.select(T.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 1.0, 0.0, 1.0]


def test_refusals_prompts_and_names(spark):
    assert one(spark, "This is NOT mentioned anywhere", T.refuses)
    assert one(spark, "参考资料中没有", T.refuses)
    assert not one(spark, "Press the button", T.refuses)
    assert one(spark, "q", lambda c: T.prompt(c, F.array(F.lit("a"), F.lit("b")))) == "参考资料：\n[1] a\n[2] b\n\n用户问题：q"
    assert one(spark, "q" * 51, T.answer_name) == "管理员回答: " + "q" * 50 + "..."
    assert one(spark, 'noise {"intent": "product"} noise', lambda c: T.first_json_object(c, "intent string")).intent == "product"
    assert one(spark, "a/b:c", T.safe_filename) == "a_b_c"
    assert one(spark, "secret-1234", T.mask_secret) == "***1234"


@pytest.mark.parametrize(
    "url,ok",
    [
        ("https://example.com/a", True),
        ("http://example.com:8080", True),
        ("ftp://example.com", False),
        ("https://u:p@example.com", False),
        ("http://LOCALHOST/x", False),
        ("http://10.1.2.3", False),
        ("http://172.16.0.1", False),
        ("http://172.32.0.1", True),
        ("http://100.64.0.1", False),
        ("http://100.128.0.1", True),
        ("http://[::1]:80/", False),
        ("http://a.internal", False),
        ("http://", False),
        (None, False),
    ],
)
def test_fetchable(spark, url, ok):
    assert one(spark, url, checks.fetchable) is ok


def test_checks(spark):
    assert one(spark, "/x/A.DOCX", checks.file_type) == "word"
    assert one(spark, "/x/a.txt", checks.file_type) is None
    assert one(spark, "ppt_legacy", checks.base_type) == "ppt"
    assert one(spark, "0" * 32, checks.hex_id) and not one(spark, "0" * 31, checks.hex_id)
    assert one(spark, "abcdefg1", checks.valid_password) and not one(spark, "abcdefgh", checks.valid_password)
    assert one(spark, bytearray(b"\x89PNG\r\n\x1a\n.."), checks.image_magic, "binary") == "png"
    assert one(spark, bytearray(b"\0\0\0\x18ftypmp42"), checks.video_magic, "binary") == "mp4"


def test_transcripts(spark):
    raw = "Model loaded\n[2026-02-20 00:27] x\n1. Time: 0.6\n<|zh|>hello <|end|>\n[rs-cli] Result: <|en|> hi there\n\nplain"
    assert one(spark, raw, transcripts.transcript) == "hello\nhi there\nplain"
    assert one(spark, "Duration: 01:02:03.50, start", transcripts.duration_seconds) == 3723.5
    assert one(spark, "none", transcripts.duration_seconds) is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([1 / math.sqrt(2), 0, 0, 0])
    assert [r.n for r in df.select(V.inverse_norm(F.col("b")).alias("n")).collect()][:2] == pytest.approx([1 / math.sqrt(2)] * 2)


def test_vector_bytes(spark):
    import numpy as np

    v = np.linspace(-1, 1, 384)
    df = spark.createDataFrame([(bytearray(v.astype("<f8").tobytes()),), (bytearray(v.astype("<f4").tobytes()),)], "x binary")
    for r in df.select(V.from_bytes("x").alias("v")).collect():
        assert np.allclose(r.v, v, atol=1e-6)


def test_embedding_is_a_unit_vector(spark):
    (v,), (zero,) = spark.createDataFrame([("abcabc",), ("a",)], "x string").select(V.embed("x")).collect()
    assert sum(x * x for x in v) == pytest.approx(1) and not any(zero)


def test_embedding_service_is_called_in_batches_and_tried_again(spark, tmp_path):
    mark, again = tmp_path / "failed", V.TryAgain

    def service(texts):
        from pathlib import Path

        if not Path(mark).exists():
            Path(mark).touch()
            raise again
        assert len(texts) <= 3
        return [[float(len(t))] for t in texts]

    embed = V.embed_with(service, batch=3, pause=0.01)
    df = spark.createDataFrame([("x" * k,) for k in range(10)], "x string").coalesce(1)
    assert [r[0] for r in df.select(embed("x")).collect()] == [[float(k)] for k in range(10)]

    def busy(texts):
        raise again("busy")

    with pytest.raises(Exception, match="busy"):
        df.select(V.embed_with(busy, tries=2, pause=0.01)("x")).collect()


def test_internal_addresses_are_not_fetched(spark):
    inside = ["[::ffff:10.0.0.1]", "[ff02::1]", "[::]", "[0:0:0:0:0:0:0:1]", "[::1]:80", "[fd00::1]", "[fe80::1%25]"[:8] + "]", "[::ffff:a9fe:1]", "[::ffff:7f00:1]", "127.1.1.1", "100.64.0.1", "224.0.0.9", "0.0.0.0", "LOCALHOST:8080", "a.internal"]
    outside = ["0.1.2.3", "[2001:db8::1]", "[::ffff:8.8.8.8]", "[::ffff:808:808]", "[ff05::1]", "8.8.8.8", "011.0.0.1", "10.0.0.256", "[fc00]", "[::1::]", "example.org"]
    df = spark.createDataFrame([(h, f"http://{h}/x") for h in inside + outside], "host string, url string")
    got = {r.host: r.ok for r in df.select("host", checks.fetchable(F.col("url")).alias("ok")).collect()}
    assert got == dict.fromkeys(inside, False) | dict.fromkeys(outside, True)


def test_addresses_resolve_like_the_library(spark):
    from urllib.parse import urljoin

    bases = ["https://h.org/a/b/c.html?x=1#f", "https://h.org", "http://h.org/", "https://h.org/a/b/"]
    sources = ["x.png", "/x.png", "../x.png", "./y/../x.png", "?q=2", "#f", "//c.org/z.png", "https://o.org/p.png", "../../../x.png", "a/./b.png#f", ".."]
    df = spark.createDataFrame([(b, s) for b in bases for s in sources], "base string, src string")
    for r in df.select("base", "src", T.resolved(F.col("src"), F.col("base")).alias("got")).collect():
        want = urljoin(r.base, r.src)
        assert r.got.rstrip("/") == want.rstrip("/"), (r.base, r.src, r.got, want)
    assert spark.range(1).select(T.resolved(F.lit("x.png"), F.lit(None).cast("string"))).first()[0] == "x.png"


def test_numeric_references(spark):
    given = {"&#65;&#x41;&#X1f600;": "AA😀", "&#0;": "&#0;", "&#xD800;|&#1114112;": "\ufffd|&#1114112;", "&#99999999999999999999;x": "&#99999999999999999999;x", "a &# b": "a &# b", "&#38;#65;": "&#65;"}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r.t: r.d for r in df.select("t", T.decode_numeric(F.col("t")).alias("d")).collect()} == given


def test_long_runs_of_space_are_linear(spark):
    import time

    text = "a" + "\u00a0" * 60_000 + "b" + " \n\u3000\n " + "c" + "\u2003" * 50_000
    df = spark.createDataFrame([(text,)], "t string")
    began = time.perf_counter()
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "a" + "\u00a0" * 60_000 + "b\n\nc"
    assert time.perf_counter() - began < 20


def test_previews_are_cut_by_bytes(spark):
    note = lambda n: f"\n...(内容已截断，共 {n} 字符)"
    texts = ["", "short", "é" * 5, "é" * 6, "ab漢字cd", "aaaaaaaaa漢", "aaaaaaaaaa", "aaaaaaaaaab"]
    want = ["", "short", "é" * 5, "é" * 5 + note(12), "ab漢字cd", "aaaaaaaaa\ufffd" + note(12), "aaaaaaaaaa", "aaaaaaaaaa" + note(11)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i")
    assert [r.p for r in df.select(T.preview(F.col("x"), 10).alias("p")).collect()] == want


def test_many_texts_embed_as_each_alone(monkeypatch):
    from tarnkit.functions import vectors

    texts = ["", "a", "Ab aB", "漢字漢字 é\U0001f600x", "the that then " * 40, "İx"]
    seen = []
    monkeypatch.setattr(vectors, "_bucket", lambda pair, f=vectors._bucket: (seen.append(pair), f(pair))[1])
    many = vectors.embed_many(texts)
    assert len(seen) == len(set(seen))  # text by text each occurrence was looked up
    assert many.tolist() == [vectors.embed_one(t).tolist() for t in texts]
    assert vectors.embed_many(["", "a"]).tolist() == [[0.0] * 64] * 2 and vectors.embed_many([]).shape == (0, 64)
