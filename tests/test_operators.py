import io
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnkit.functions import text as T
from tarnkit.operators import linking as L
from tarnkit.operators import lockout as K
from tarnkit.operators import search as S
from tarnkit.operators import tables as B
from tarnkit.plans import operation_queries as O
from tarnkit.sources import files, logs, pdf, pdf_filters
from tarnkit.streaming import state as W

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_vector_search_edges(spark):
    corpus = spark.createDataFrame(
        [(1, "", [1.0, 0.0]), (2, "p", [1.0, 0.0]), (3, "q", [1.0, 1.0]), (4, "p", [0.0, 0.0]), (5, "p", [1.0]), (6, None, [-1.0, 0.0])], "id long, part string, vector array<float>"
    )
    query = spark.createDataFrame([(9, "p", [2.0, 0.0]), (8, "p", [0.0, 0.0])], corpus.schema)
    assert rows(S.vector_search(query, corpus, 2, 0.0)) == [(9, 1, 1.0, 1), (9, 2, 1.0, 2)]
    assert [r[1] for r in rows(S.vector_search(query, corpus, 9, -1.0, partitioned=True))] == [1, 2, 6]
    assert rows(S.vector_search(query, corpus.limit(0), 3)) == []
    exact = spark.createDataFrame([(7, "", [3.0, 4.0])], corpus.schema)
    assert rows(S.vector_search(query, exact, 1, 0.6)) == [(9, 7, 0.6, 1)]
    with pytest.raises(ValueError):
        S.vector_search(query, corpus, 0)


def test_cascade_stops_at_the_first_level_that_answers(spark):
    unit = lambda *at: [1.0 if k in at else 0.0 for k in range(8)]
    library = [
        (1, "how to reset the password", "a", unit(0)),  # answered
        (2, "the weather is nice today", "", unit(1)),
        (3, "the weather is nice todaj", "b", unit(2)),  # answered, of another text
        (4, "zzz qqq", "", unit(3, 4)),
        (5, "how to reset the password", "b", unit(7)),
    ]
    chunks = spark.createDataFrame([(d, 0, t, p, v) for d, t, p, v in library], "document_id long, chunk_index int, lowered string, part string, vector array<double>")
    answered = spark.createDataFrame([(1,), (3,)], "document_id long")
    asked = [
        (10, "how to reset the password", "a", unit(5), None),  # 1: its own partition's hit is answered
        (11, "the weather is nice today", "b", unit(2), None),  # 2: the lexical hit isn't answered, the vector's is
        (12, "the weather is nice today", "b", unit(1), None),  # 3: neither is
        (13, "12345", "b", [0.4, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0], None),  # 3: by vectors alone
        (14, "12345", "b", [0, 0, 0, 0.55, 0, 1.0, 0, 0], None),  # 3: relaxed, below the threshold
        (15, "12345", "b", unit(6), None),  # 4: nothing
        (16, "how to reset the password", "a", unit(6), unit(0)),  # 3: with an image, whose vector finds the document
        (17, "12345", "b", unit(6), [0, 0, 0, 0.3, 0, 1.0, 0, 0]),  # 3: the image's relaxed hit
        (18, "how to reset the password", "b", unit(6), None),  # 4: the hit isn't answered, and no vector is near
    ]
    questions = spark.createDataFrame([(i, q, p, [float(x) for x in v], m and [float(x) for x in m]) for i, q, p, v, m in asked], "query_id long, question string, part string, vector array<double>, image array<double>")
    got = sorted((r.query_id, r.level, r.id and r.id >> 20) for r in S.cascade(questions, chunks, answered).collect())
    assert got == [(10, 1, 1), (11, 2, 3), (12, 3, 2), (13, 3, 4), (14, 3, 4), (15, 4, None), (16, 3, 1), (17, 3, 4), (18, 4, None)]


@pytest.mark.parametrize("rows,cell", [(1024, 8192), (3, 4)])
def test_searches_equal_brute_force_in_every_grid(spark, monkeypatch, rows, cell):
    import random

    import numpy as np

    monkeypatch.setattr(S, "QUERY_ROWS", rows)
    monkeypatch.setattr(S.B, "PASS_ROWS", rows)
    monkeypatch.setattr(S.B, "BLOCK_BYTES", cell * 16)
    monkeypatch.setattr(S, "CHUNK_ROWS", cell)
    r = random.Random(7)
    data = [(k, r.choice(["", "a", "b"]), [float(r.randrange(-1, 2)) for _ in range(r.choice([3, 4]))]) for k in range(60)] + [(60, "a", None), (61, None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "id long, part string, vector array<float>").repartition(3)
    for partitioned in (False, True):
        want = []
        for i, p, v in data:
            found = []
            for j, o, w in data:
                if v and w and len(v) == len(w) and any(v) and any(w) and i != j and (not partitioned or (p or "") == (o or "") or not p or not o):
                    score = round(float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), 6)
                    found += [(-score, j)] if score >= 0.2 else []
            want += [(i, j, -s, k + 1) for k, (s, j) in enumerate(sorted(found)[:4])]
        got = S.vector_search(df, df, 4, 0.2, partitioned, others=True).collect()
        assert sorted(tuple(x) for x in got) == sorted(want)
    texts = [(k, 0, "".join(r.choice(["ab", "c ", "def", "漢字", ", ", "xyz"]) for _ in range(r.randrange(0, 30)))) for k in range(50)]
    asked = [(k, t[2][:40]) for k, t in enumerate(texts[::5])] + [(90, ""), (91, "?")]
    chunks = spark.createDataFrame(texts, "document_id long, chunk_index int, lowered string").repartition(3)
    questions = spark.createDataFrame(asked, "query_id long, question string")
    pairs = chunks.crossJoin(questions).withColumn("score", F.round(T.text_score(T.keywords(F.col("question")), T.bigrams(F.lower("question")), F.col("lowered"), T.bigrams(F.col("lowered"))), 6)).where("score >= 0.3")
    want = S.top_k(pairs, 3, ties=("document_id", "chunk_index")).select("query_id", "document_id", "chunk_index", "score", "rank")
    assert sorted(tuple(x) for x in S.text_search(questions, chunks, 3, 0.3).collect()) == sorted(tuple(x) for x in want.collect())


def test_either_key_keeps_rows_whose_keys_are_null_or_shared(spark):
    left = spark.createDataFrame([("x", None, 1), ("y", "k", 2), ("z", "k", 3), (None, None, 4), ("k", "x", 5)], "a string, b string, n int")
    right = spark.createDataFrame([("x", 10), ("y", 20)], "name string, t int")
    got = sorted(((r.n, r.t) for r in L.either_key(left, right, ("a", "b"), "name", "t").collect()), key=str)
    assert got == [(1, 10), (2, 20), (3, None), (4, None), (5, 10)]


def test_places_equal_row_numbers(spark):
    rows = [(k * 37 % 1000, "hot" if k % 3 else f"s{k % 5}") for k in range(400)]
    df = spark.createDataFrame(rows, "id long, source string")
    want = {}
    for k, s in sorted(rows):
        want.setdefault(s, []).append(k)
    got = {(r.id, r.source): (r.place, r.total) for r in B.placed(df, "source", "id", 50).collect()}
    assert got == {(k, s): (i + 1, len(ks)) for s, ks in want.items() for i, k in enumerate(ks)}


def test_unban_lifts_both_kinds(spark):
    log = spark.createDataFrame([("u", "1.1.1.1", 0, f"2024-01-01 00:0{k}:00") for k in range(5)], "username string, ip string, success int, at string").select("username", "ip", "success", F.col("at").cast("timestamp").alias("created_at"))
    manual = spark.createDataFrame([("u", ""), ("", "2.2.2.2"), ("v", "")], "username string, ip string").withColumn("unlocks_at", F.lit("2025-01-01").cast("timestamp"))
    who = spark.createDataFrame([("u", ""), ("", "2.2.2.2")], "username string, ip string")
    after, left = K.unban(log, manual, who, "2024-01-02")
    assert K.streaks(log, "username", 1).count() == 1 and K.streaks(after, "username", 1).where("username = 'u'").count() == 0
    assert [tuple(r)[:2] for r in left.collect()] == [("v", "")]

def attempts(spark, spec):
    made = [(u, "i", s, T0 + timedelta(seconds=t)) for u, s, t in spec]
    return spark.createDataFrame(made, "username string, ip string, success int, created_at timestamp")


def test_streak_ignores_a_failure_in_the_second_of_a_success(spark):
    log = attempts(spark, [("a", 0, 1), ("a", 1, 5), ("a", 0, 5), *[("a", 0, 6 + k) for k in range(10)], ("b", 0, 1)])
    assert rows(K.streaks(log, "username", 10)) == [("a", 10, T0 + timedelta(seconds=6))]


def test_bans_by_threshold(spark):
    manual = spark.createDataFrame([("m", "", T0 + timedelta(days=2)), ("", "9.9.9.9", T0)], "username string, ip string, unlocks_at timestamp")
    log = attempts(spark, [("u", 0, k) for k in range(100)])
    got = {r.type: r for r in K.active_bans(log, manual, "2024-01-01 00:30:00").collect()}
    assert set(got) == {"manual_user", "user_consecutive", "user_daily", "ip"}
    assert got["user_consecutive"].unlocks_at == T0 + timedelta(hours=1)
    assert got["user_daily"].unlocks_at == T0 + timedelta(days=1)
    assert got["ip"].unlocks_at == T0 + timedelta(days=10)


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n int")
    c = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], t.schema)
    assert rows(B.upsert(t, c, ["k"], "n")) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert [r[0] for r in rows(B.insert_or_ignore(t, c, ["k"]))] == [1, 2, 3]
    assert rows(B.delete_by(t, c, ["k"])) == [(1, "a", 0)]
    assert rows(B.page(t, [F.col("k")], 0, 500)) == rows(t)
    assert rows(B.page(t, [F.col("k")], 2, 1)) == [(2, "b", 0)]
    with pytest.raises(ValueError):
        B.with_status(t, "odd", ("open",))
    owners = spark.createDataFrame([(1,)], "k long")
    assert rows(B.replace_for(t, spark.createDataFrame([(1, "z", 5)], t.schema), owners, "k")) == [(1, "z", 5), (2, "b", 0)]
    assert B.is_free(t, "v", "c", "0", "k") and not B.is_free(t, "v", "a", "2", "k") and B.is_free(t, "v", "a", "1", "k")
    frames = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    assert [r[1] for r in rows(B.evenly_sampled(frames, "g", "i", 4))] == [0, 3, 6, 9]
    assert [r[1] for r in rows(B.evenly_sampled(frames, "g", "i", 1))] == [5]


def test_export_and_restore(spark, tmp_path):
    log = spark.createDataFrame([(1, T0), (2, T0 + timedelta(days=1))], "id long, created_at timestamp")
    users = spark.createDataFrame([(1, "x")], "id long, name string")
    out = B.export({"log": log, "users": users}, str(tmp_path / "e"), "2024-01-01 12:00:00", {"log": "created_at"})
    assert rows(out) == [("log", 1), ("users", 1)]
    assert rows(B.restore(spark, str(tmp_path / "e"))["log"]) == [(2, T0 + timedelta(days=1))]


def test_linking(spark):
    frames = spark.createDataFrame([(1, 0.0), (1, 69.9), (1, 70.1), (2, 50.0)], "document_id long, time double")
    hits = spark.createDataFrame([(1, 30.0, 40.0), (2, 0.0, 0.0)], "document_id long, start_time double, end_time double")
    assert rows(L.frames_in_time(frames, hits)) == [(1, 0.0), (1, 69.9)]
    images = spark.createDataFrame([(1, 1004), (1, 1007)], "document_id long, chunk_index int")
    at = spark.createDataFrame([(1, 5)], "document_id long, chunk_index int")
    assert rows(L.near_images(at, images, L.IMAGE_BASE)) == [(1, 1004)]


def test_rate_limit_equals_a_loop(spark, sf_dir):
    got = {r.id: r.allowed for r in O.rate_limit(spark, sf_dir).collect()}
    seen, want = {}, {}
    for r in O._requests(spark, sf_dir).orderBy("at", "id").collect():
        live = [t for t in seen.get(r.key, []) if t > r.at - 4 * 86400 * W.SECOND]
        want[r.id] = len(live) < 3
        seen[r.key] = live + [r.at] * want[r.id]
    assert got == want


def test_stream_equals_batch(spark, sf_dir):
    assert rows(O.stream_rate_limit(spark, sf_dir)) == rows(O.rate_limit(spark, sf_dir))


def test_request_exactly_a_window_old_has_left(spark):
    log = W.SlidingLog(1, 10)
    assert [log.allow(t) for t in (0, 9, 10, 19, 20)] == [True, False, True, False, True]


def test_session_is_extended_late_and_capped(spark):
    s = W.SlidingSession()
    hours = [0, 11, 13, 36, *range(48, 200, 12), 400]
    numbers = [s.touch(h * W.HOUR) for h in hours]
    assert numbers[:4] == [1, 1, 1, 1] and numbers[-1] == max(numbers) and max(numbers) >= 2


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "A.DOCX").write_bytes(office({"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:t>you</w:t></w:p></w:document>", "word/media/i.png": "png"}))
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    (tmp_path / "b.xlsx").write_bytes(
        office(
            {
                "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" r:id="x"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<R><Relationship Id="x" Target="worksheets/s.xml"/></R>',
                "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>",
                "xl/worksheets/s.xml": f'<worksheet {s}><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>7</v></c></worksheet>',
            }
        )
    )
    d = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slides = {f"ppt/slides/slide{k}.xml": f"<p {d}><a:p><a:t>s{k}</a:t></a:p></p>" for k in (10, 2)}
    links = {f"ppt/slides/_rels/slide{k}.xml.rels": "".join(["<R>", *(f'<Relationship Id="{x}" Target="../media/{x}.png"/>' for x in shown), "</R>"]) for k, shown in ((2, "b"), (10, "ba"))}
    (tmp_path / "c.pptx").write_bytes(office({**slides, **links, **{f"ppt/media/{x}.png": x for x in "abc"}}))
    (tmp_path / "d.md").write_text("# T\n**x**")
    (tmp_path / "e.html").write_text("<p>p</p>")
    (tmp_path / "f.pdf").write_bytes(b"%PDF-")
    (tmp_path / "g.docx").write_bytes(b"no zip")
    (tmp_path / "h.txt").write_text("skipped")
    got = {row.path.rsplit("/", 1)[1]: row for row in files.parse(files.scan(spark, str(tmp_path))).collect()}
    assert {k: v.text for k, v in got.items() if not v.error} == {"A.DOCX": "Hello\nyou", "b.xlsx": "S-1,1: name\nS-2,28: 7", "c.pptx": "Slide 2:\ns2\n\nSlide 10:\ns10", "d.md": "T\nx", "e.html": "p"}
    assert bytes(got["A.DOCX"].images[0].data) == b"png"
    assert [(i.name[-5:], i.place) for i in got["c.pptx"].images] == [("b.png", 2), ("a.png", 10), ("c.png", None)]
    assert set(k for k, v in got.items() if v.error) == {"f.pdf", "g.docx"}


def test_log_tail(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(f"line {i}\n" for i in range(60)))
    assert [r.line for r in logs.log_tail(spark, str(tmp_path / "log"), 3).collect()] == ["line 57", "line 58", "line 59"]


def test_log_tail_is_bounded_by_bytes(spark, tmp_path):
    (tmp_path / "log").write_text("old\n  \n" + "x" * (logs.TAIL_BYTES + 1) + "\nnew\n")
    assert [r.line for r in logs.log_tail(spark, str(tmp_path / "log"), 9).collect()] == ["new"]  # what the range starts within is left out
    with open(tmp_path / "huge", "wb") as f:
        f.truncate(40 << 30)
        f.seek(0, 2)
        f.write(b"\nlast but one\r\nlast")
    reader = logs.TailReader(str(tmp_path / "huge"), logs.TAIL_BYTES, 1 << 16)
    ranges = reader.partitions()
    assert sum(r.end - r.start for r in ranges) == logs.TAIL_BYTES and len(ranges) == 4
    assert [r.line for r in logs.log_tail(spark, f"file://{tmp_path}/huge", 2).collect()] == ["last but one", "last"]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_log_tail_follows_rotated_files_and_any_split(tmp_path, split):
    lines = [f"line {i} " + "é" * (i % 9) for i in range(200)]
    for name, part in (("log.2", lines[:80]), ("log.1", lines[80:150]), ("log", lines[150:])):
        (tmp_path / name).write_text("".join(f"{x}\n" for x in part))
    for most in (10, 500, 1500, 10**6):
        reader = logs.TailReader(str(tmp_path / "log"), most, split)
        got = [line for _, line in sorted(x for p in reader.partitions() for x in reader.read(p))]
        assert got == lines[len(lines) - len(got) :]
        whole = sum(len(x.encode()) + 1 for x in got)
        assert whole <= most and (len(got) == 200 or whole + len(lines[-len(got) - 1].encode()) + 1 > most if got else most == 10)
    with pytest.raises(FileNotFoundError):
        logs.TailReader(str(tmp_path / "none"), 10, 10).partitions()


def printed(*objects: bytes) -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, body) for k, body in objects) + b"%%EOF"


def flate(body: bytes, more: bytes = b"") -> bytes:
    packed = zlib.compress(body)
    return b"<< /Filter /FlateDecode %s/Length %d >>\nstream\n%s\nendstream" % (more, len(packed), packed)


def test_pdf_fonts_pages_and_images():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <4F60> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <00790079>] endbfrange"
    photo = b"<< /Subtype /Image /Filter /DCTDecode /Width 60 /Height %d >>\nstream\n%s\nendstream"
    packed = b"<< /Font << /F1 8 0 R >> /XObject << /A 10 0 R /B 11 0 R /C 12 0 R >> >>"
    data = printed(
        (1, b"<< /Type /Catalog /Pages 2 0 R >>"),
        (2, b"<< /Type /Pages /Kids [5 0 R 3 0 R 2 0 R] /Resources 7 0 R >>"),
        (3, b"<< /Type /Page /Contents 4 0 R >>"),
        (4, flate(b"BT /F1 9 Tf <00010010> Tj [<0012> -500 <0020> 20 <0021>] TJ ET")),
        (5, b"<< /Type /Page /Contents [6 0 R 9 0 R] >>"),
        (6, b"<< >>\nstream\nBT (a\\(b\\)\\101) Tj 3 0 Td (c) Tj 0 -9 Td (d (e)) Tj T* (\x80)' ET\nendstream"),
        (8, b"<< /Type /Font /ToUnicode 14 0 R >>"),
        (9, flate(b"BT (end) Tj ET")),
        (10, photo % (60, b"one")),
        (11, photo % (49, b"small")),
        (12, photo % (60, b"one")),
        (13, flate(b"7 0 " + packed, b"/Type /ObjStm /N 1 /First 4 ")),
        (14, flate(cmap)),
    )
    text, images = pdf.parse(data)
    assert text == "a(b)Ac\nd (e)\n\u20ac\nend\n\n\u4f60ac xyy"
    assert images == [{"name": "page 1 image 1", "data": b"one", "place": 1}]
    for bad in (b"", b"%PDF-1.4", data + b"trailer << /Encrypt 1 0 R >>"):
        with pytest.raises(ValueError):
            pdf.parse(bad)


def lzw_written(data: bytes, early: int = 1) -> bytes:
    """Plain LZW by a table of its own."""
    table, bits, out, width, word = {bytes([k]): k for k in range(256)}, 0, [], 9, b""
    codes, n = [(256, 9)], 258
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        codes.append((table[word], width))
        table[word + bytes([c])], n = n, n + 1
        if n + early > 1 << width and width < 12:
            width += 1
        word = bytes([c])
        if n == 4095:
            codes += [(table[word], width), (256, width)]
            table, n, width, word = {bytes([k]): k for k in range(256)}, 258, 9, b""
    codes += [(table[word], width)] if word else []
    n += 1
    codes.append((257, width + (n + early > 1 << width and width < 12)))
    text = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))


def predicted(rows: list[bytes], step: int, kinds: list[int]) -> bytes:
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        out += bytes([kind])
        for k, x in enumerate(row):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c)[kind]
            out += bytes([x - guess & 255])
        above = row
    return out


def test_pdf_filters_undo_what_was_written():
    import base64
    import random

    r = random.Random(7)
    for n in (0, 1, 300, 9000):
        data = bytes(r.choice(b"abcab\0\xff") if r.random() < 0.7 else r.randrange(256) for _ in range(n))
        for early in (0, 1):
            assert pdf_filters.lzw(lzw_written(data, early), early) == data
        assert pdf_filters.ascii85(b"<~" + base64.a85encode(data) + b"~>\n") == data and pdf_filters.ascii_hex(data.hex().encode() + b" >") == data
        assert pdf_filters.decoded(zlib.compress(base64.a85encode(data) + b"~>"), b"<< /Filter [/FlateDecode /A85] >>") == (data, False)
    assert pdf_filters.run_length(b"\x02abc\xfeZ\x80rest") == b"abcZZZ" and pdf_filters.ascii_hex(b"41 4>") == b"A@"
    rows = [bytes(r.randrange(256) for _ in range(12)) for _ in range(10)]
    for step in (1, 3, 4):
        assert pdf_filters.unpredicted(predicted(rows, step, [0, 1, 2, 3, 4] * 2), 15, step, 8, 12 // step) == b"".join(rows)
    assert pdf_filters.unpredicted(bytes([1, 2, 3, 1, 1, 1]), 2, 3, 8, 2) == bytes([1, 2, 3, 2, 3, 4])
    with pytest.raises(ValueError):
        pdf_filters.lzw(b"\xff\xff\xff")


def unpng(data: bytes) -> tuple[int, int, int, int, bytes, bytes]:
    """Width, height, bits, kind, rows and palette of a PNG whose rows aren't predicted."""
    import struct

    at, parts = 8, {}
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        parts[name] = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + parts[name])
        at += 12 + n
    width, height, bits, kind = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    body = zlib.decompress(parts[b"IDAT"])
    size = len(body) // height
    return width, height, bits, kind, b"".join(body[k * size + 1 : (k + 1) * size] for k in range(height)), parts.get(b"PLTE", b"")


def test_pdf_of_chained_filters_forms_and_raw_images():
    import base64
    import random

    r = random.Random(3)
    rgb = [bytes(r.randrange(256) for _ in range(180)) for _ in range(50)]
    grey, indexed, cmyk = bytes(r.randrange(256) for _ in range(2500)), bytes(r.randrange(256) for _ in range(50 * 13)), bytes(r.randrange(256) for _ in range(4 * 2500))
    image = lambda size, more, body: b"<< /Subtype /Image /Width %d /Height 50 %s /Length %d >>\nstream\n%s\nendstream" % (size, more, len(body), body)
    text = lzw_written(b"BT /F1 9 Tf (first) Tj ET /Fm Do BT (last) Tj ET")
    coded = base64.a85encode(text) + b"~>"
    form = zlib.compress(b"BT /G 9 Tf <d83dde00> Tj ET /Fm Do")
    resources = b"<< /Font << /F1 30 0 R >> /XObject << /Fm 6 0 R /I1 10 0 R /I2 11 0 R /I3 12 0 R /I4 13 0 R /I5 15 0 R /I6 16 0 R >> >>"
    packed = b"3 0 4 50 ".ljust(20) + (b"<< /Type /Page /Contents 5 0 R /Resources 4 0 R >>").ljust(50) + resources
    table = predicted([packed[k : k + 10].ljust(10) for k in range(0, len(packed), 10)], 1, [2] * -(-len(packed) // 10))
    squeezed = zlib.compress(table)
    data = printed(
        (1, b"<< /Type /Catalog /Pages 2 0 R >>"),
        (2, b"<< /Type /Pages /Kids [3 0 R] >>"),
        (20, b"<< /Type /ObjStm /N 2 /First 20 /Filter [/FlateDecode] /DecodeParms [<< /Predictor 12 /Columns 10 >>] /Length %d >>\nstream\n%s\nendstream" % (len(squeezed), squeezed)),
        (5, b"<< /Filter [/ASCII85Decode /LZWDecode] /Length %d >>\nstream\n%s\nendstream" % (len(coded), coded)),
        (6, b"<< /Subtype /Form /Filter /FlateDecode /Resources << /Font << /G 8 0 R >> /XObject << /Fm 6 0 R >> >> /Length %d >>\nstream\n%s\nendstream" % (len(form), form)),
        (8, b"<< /Type /Font /ToUnicode 9 0 R >>"),
        (9, flate(b"2 beginbfchar <d83d> <D83D> <de00> <DE00> endbfchar")),
        (10, image(60, b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors 3 /Columns 60 >>", zlib.compress(predicted(rgb, 3, [0, 1, 2, 3, 4] * 10)))),
        (11, image(50, b"/ColorSpace [/ICCBased 40 0 R] /BitsPerComponent 8 /Filter /LZWDecode", lzw_written(grey))),
        (12, image(50, b"/ColorSpace [/Indexed /DeviceRGB 3 <000000ff000000ff000000ff>] /BitsPerComponent 2 /Filter /Fl", zlib.compress(indexed))),
        (13, image(50, b"/ColorSpace /DeviceCMYK /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(cmyk))),
        (15, image(50, b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /JPXDecode", b"wavelets")),
        (16, image(50, b"/ColorSpace /DeviceRGB /BitsPerComponent 8", b"too short")),
        (40, b"<< /N 1 /Length 4 >>\nstream\nicc.\nendstream"),
    )
    text, images = pdf.parse(data)
    assert text == "first\n\U0001f600\nlast"
    got = [unpng(i["data"]) for i in images]
    assert got[0] == (60, 50, 8, 2, b"".join(rgb), b"") and got[1] == (50, 50, 8, 0, grey, b"")
    assert got[2] == (50, 50, 2, 3, indexed, bytes.fromhex("000000ff000000ff000000ff"))
    c, m, _, k = cmyk[:4]
    assert got[3][:4] == (50, 50, 8, 2) and tuple(got[3][4][:2]) == ((255 - c) * (255 - k) // 255, (255 - m) * (255 - k) // 255) and len(got) == 4
    with pytest.raises(ValueError, match="encrypted"):
        pdf.parse(data + printed((90, b"<< /Type /XRef /Encrypt 91 0 R >>\nstream\n\nendstream")))


def test_enriched_answers(spark):
    hits = spark.createDataFrame([(1, 7, 3, ""), (1, 7, 999, None), (2, 7, 3, "/x"), (3, 8, 0, "")], "query_id int, document_id long, chunk_index int, image_url string")
    images = spark.createDataFrame([(7, k, f"/{k}") for k in (2, 4, 1000, 1001, 1002, 1004, 1999, 10002, 11000)] + [(7, 3, ""), (8, 9, "/n")], "document_id long, chunk_index int, image_url string")
    got = [(r.query_id, r.chunk_index, r.place) for r in L.enriched(hits, images).orderBy("query_id", "place").collect()]
    assert got == [(1, 2, 1), (1, 4, 2), (1, 1002, 3), (1, 1004, 4), (1, 1999, 5)]


def test_first_uses(spark):
    issued = spark.createDataFrame([("a", 0), ("b", 5)], "ticket string, at long")
    uses = spark.createDataFrame([("a", 1, -1), ("a", 2, 10), ("a", 3, 10), ("b", 4, 10**6 + 5), ("c", 5, 1)], "ticket string, id long, at long")
    assert sorted((r.id, r.used) for r in W.first_uses(issued, uses, 1).collect()) == [(1, False), (2, True), (3, False), (4, False), (5, False)]
