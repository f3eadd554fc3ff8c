"""Packed vector blocks, versioned tables, legacy files, event-time streams and text runs in chunks."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnkit.operators import linking as L
from tarnkit.operators import search as S
from tarnkit.operators import vector_blocks as B
from tarnkit.plans import search_queries as Q
from tarnkit.sources import compound as C
from tarnkit.sources import files
from tarnkit.sources.versioned import Conflict, VersionedTable
from tarnkit.streaming import state as W
from tarnkit.streaming import timed as Z

# vector blocks


def vectors(seed, n, dim, places=7):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(places, dim)) * 3
    return (centres[r.integers(0, places, n)] + r.normal(size=(n, dim)) * 0.4).astype(np.float32)


def best(rows, asked, k, least, partitioned, others):
    """query to (id, score), by every pair in double precision."""
    out = []
    for qi, qp, q in asked:
        found = []
        for i, p, v in rows:
            if v is None or q is None or len(v) != len(q) or not len(v) or any(x is None or not np.isfinite(x) for x in [*v, *q]) or (others and i == qi):
                continue
            if partitioned and not (qp == p or qp == "" or p == ""):
                continue
            a, b = np.asarray(q, np.float64), np.asarray(v, np.float64)
            size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            if size and (score := float(B.half_up(np.array([a @ b / size]))[0])) >= max(least, -1):
                found.append((-score, i))
        out += [(qi, i, -s, rank + 1) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    m = vectors(1, 600, 24)
    rows = [(k, ("", "a", "b", "c")[k % 4], [float(x) for x in v]) for k, v in enumerate(m)]
    rows += [(1000 + k, ("a", None)[k % 2], [float(x) for x in m[k]]) for k in range(20)]  # exact copies tie
    rows += [(2000, "a", None), (2001, "a", []), (2002, "", [0.0] * 24), (2003, "a", [1.0] * 8), (2004, "b", [float("nan")] * 24), (2005, "a", [None] + [1.0] * 23), (2006, "b", [2.0] * 8), (2007, "", [1e-20] * 24)]
    return rows, spark.createDataFrame(rows, "id long, part string, vector array<float>").repartition(5)


@pytest.mark.parametrize(("k", "least", "partitioned", "others"), [(3, -1.0, False, False), (5, 0.5, True, True), (1, 0.95, False, True), (30, -1.0, True, False)])
def test_stored_blocks_find_what_all_pairs_find(spark, table, k, least, partitioned, others):
    rows, df = table
    rows = [(i, p or "", v) for i, p, v in rows]
    want = best(rows, [r for r in rows if r[0] % 20 == 0], k, least, partitioned, others)
    asked = df.where("id % 20 = 0")
    for corpus in (df, B.store_vectors(df), B.store_vectors(df, block_rows=3, pivots=16)):
        if "body" in corpus.columns:
            pruned = S.top_k(B.search_blocks(asked, corpus, k, least, partitioned, others, few=0), k)
            assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in pruned.collect()) == want
        got = S.vector_search(asked, corpus, k, least, partitioned, others)
        assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == want


def test_passes_of_queries_add_up(spark, table, monkeypatch):
    rows, df = table
    want = sorted(map(tuple, S.vector_search(df, df, 2, 0.0).collect()))
    monkeypatch.setattr(B, "PASS_ROWS", 50)
    assert len(list(B.passes(df))) > 10
    assert sorted(map(tuple, S.vector_search(df, df, 2, 0.0).collect())) == want


def test_doubles_are_kept_as_doubles(spark):
    near = [(1, "", [1.0, 1e-9]), (2, "", [1.0, 2e-9]), (3, "", [1.0, 0.0])]
    df = spark.createDataFrame(near, "id long, part string, vector array<double>")
    blocks = B.store_vectors(df)
    assert {r.width for r in blocks.collect()} == {8} and sum(r.n for r in blocks.collect()) == 3
    assert [tuple(r) for r in S.vector_search(df.where("id = 3"), blocks, 3).orderBy("rank").collect()] == [(3, 1, 1.0, 1), (3, 2, 1.0, 2), (3, 3, 1.0, 3)]


def test_far_blocks_are_not_read(spark, table):
    rows, df = table
    blocks = B.store_vectors(df, block_rows=8, pivots=32)
    met, read = B.blocks_read(df.where("id = 40"), blocks, 3, -1.0)
    assert met > 60 and 0 < read < met / 2
    met, none = B.blocks_read(df.where("id = 40"), blocks, 3, 0.9999999)
    assert none <= read


def test_skipped_blocks_are_counted(spark, sf_dir):
    found = Q.vector_blocks_skipped(spark, sf_dir).orderBy("threshold").collect()
    assert all(r.n_blocks == r.n_read + r.n_skipped and r.n_blocks * 16 >= r.n_vectors for r in found)
    assert found[0].n_skipped <= found[1].n_skipped <= found[2].n_skipped and found[2].n_skipped > 0


# chunks that contain segments


def test_contents_in_chunks_of_any_number(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    chunks = [(d, k, " ".join(word() for _ in range(12))) for d in (1, 2, 3) for k in range(60)] + [(1, 60, None), (4, 0, "lone"), (1, 61, "")]
    segments = [(d, word() if k % 7 else " ".join([word(), word()]), float(k), float(k + r.randrange(3))) for d in (1, 2) for k in range(40)] + [(2, None, 0.0, 1.0), (2, "", 500.0, 501.0), (5, "a", 1.0, 2.0)]
    want = {}
    for d, k, text in chunks:
        hits = [(s, e) for o, c, s, e in segments if o == d and c is not None and text is not None and c in text]
        if hits:
            want[d, k] = (min(h[0] for h in hits), max(h[1] for h in hits))
    a, b = spark.createDataFrame(chunks, "document_id long, chunk_index int, chunk_text string"), spark.createDataFrame(segments, "document_id long, content string, start_time double, end_time double")
    for cell in (20_000, 7):
        assert {(x.document_id, x.chunk_index): (x.start_time, x.end_time) for x in L.contents_in_chunks(a, b, cell).collect()} == want


def test_a_long_document_is_linear(spark):
    import time

    n = 100_000
    chunks = spark.range(n).select(F.lit(1).cast("long").alias("document_id"), F.col("id").cast("int").alias("chunk_index"), F.concat(F.lit("so said "), "id", F.lit(" to "), F.col("id") + 1, F.lit(";")).alias("chunk_text"))
    segments = spark.range(n).select(F.lit(1).cast("long").alias("document_id"), F.concat(F.lit(" "), "id", F.lit(" to ")).alias("content"), F.col("id").cast("double").alias("start_time"), (F.col("id") + 1).cast("double").alias("end_time"))
    began = time.time()
    found = L.contents_in_chunks(chunks, segments)
    assert found.where("start_time = chunk_index and end_time = chunk_index + 1").count() == n
    assert time.time() - began < 120


# versioned tables


def content(df):
    return sorted(map(tuple, df.collect()))


def test_versioned_table(spark, tmp_path):
    rows = [(f"d{k % 10}", k, f"text {k}") for k in range(100)]
    made = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_text string")
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    assert t.create(made) == 1 and content(t.read()) == sorted(rows)
    before = t.read()
    assert t.delete(spark.createDataFrame([("d1",), ("none",), ("d1",)], "document_id string")) == 2
    state = [r for r in rows if r[0] != "d1"]
    assert content(t.read()) == sorted(state) and content(before) == sorted(rows)  # a reader keeps to its version
    new = [("d2", 0, "new"), ("d99", 5, "first")]
    assert t.replace(spark.createDataFrame(new, made.schema), spark.createDataFrame([("d3",)], "document_id string")) == 3
    state = [r for r in state if r[0] not in ("d2", "d3", "d99")] + new
    assert content(t.read()) == sorted(state)
    changes = [("d4", 4, "old", 1), ("d4", 4, "newer", 2), ("d4", 1004, "added", 1)]
    latest = spark.createDataFrame(changes, "document_id string, chunk_index int, chunk_text string, at int")
    with pytest.raises(ValueError, match="owner"):
        t.upsert(latest, ["chunk_index"], "at")
    keyed = VersionedTable(spark, str(tmp_path / "keyed"), buckets=4)
    keyed.create(made.withColumn("at", F.lit(0)))
    keyed.upsert(latest, ["document_id", "chunk_index"], "at")
    assert content(keyed.read().where("document_id = 'd4' and chunk_index in (4, 1004)").drop("at")) == [("d4", 4, "newer"), ("d4", 1004, "added")] and keyed.read().count() == 101
    assert content(t.of(["d2", "d4"])) == sorted(r for r in state if r[0] in ("d2", "d4"))
    assert len(t.of(["d2"]).inputFiles()) < len(t.read().inputFiles())
    assert content(t.read(1)) == sorted(rows)
    assert t.expire(1) == 2 and content(t.read()) == sorted(state) and t.versions() == [3]


def test_a_failed_writer_leaves_the_old_version(spark, tmp_path):
    made = spark.range(50).select(F.concat(F.lit("d"), F.col("id") % 5).alias("document_id"), "id")
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=3)
    t.create(made)
    want = content(t.read())
    broken = made.withColumn("id", F.when(F.col("id") < 48, F.col("id")).otherwise(F.raise_error("lost").cast("long")))
    with pytest.raises(Exception, match="lost"):
        t.replace(broken)
    assert t.versions() == [1] and content(t.read()) == want
    # of two writers that read the same version the second fails, and shows nothing
    manifest = t._manifest()
    t.delete(spark.createDataFrame([("d1",)], "document_id string"))
    with pytest.raises(Conflict):
        t._commit({**manifest, "version": 2, "buckets": {}})
    one, two = VersionedTable(spark, t.folder, buckets=3).read(), VersionedTable(spark, t.folder, buckets=3).read()
    assert content(one) == content(two) == [r for r in want if r[0] != "d1"]


def test_empty_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=2)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(spark.createDataFrame([], "document_id string, n long"))
    assert t.read().count() == 0
    t.delete(spark.createDataFrame([], "document_id string"))
    t.replace(spark.createDataFrame([("x", 1)], "document_id string, n long"))
    assert content(t.read()) == [("x", 1)]


# legacy files


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def workbook():
    """All kinds of cells, and shared strings that go on in the next record with and without wide characters."""
    strings = ["plain", "née 漢字", "long " * 40, "ends here"]
    first = struct.pack("<II", 4, 4) + struct.pack("<HB", 5, 0) + b"plain" + struct.pack("<HBHI", 6, 1 | 8 | 4, 1, 3) + "née 漢字".encode("utf-16-le")[:8]
    second = b"\1" + "née 漢字".encode("utf-16-le")[8:] + b"runs" + b"ext" + struct.pack("<HB", 200, 0) + strings[2].encode()[:90]
    third = b"\1" + strings[2][90:].encode("utf-16-le") + struct.pack("<HB", 9, 0) + b"ends here"
    cells = b"".join([
        record(0xFD, struct.pack("<HHHI", 0, 0, 0, 1)), record(0xFD, struct.pack("<HHHI", 0, 1, 0, 2)), record(0xFD, struct.pack("<HHHI", 5, 0, 0, 3)),
        record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)), record(0x27E, struct.pack("<HHHI", 1, 1, 0, 12345 << 2 | 3)), record(0xBD, struct.pack("<HHHIHIH", 1, 2, 0, (7 << 2) | 2, 0, struct.unpack("<Q", struct.pack("<d", 0.5))[0] >> 32 & 0xFFFFFFFC, 3)),
        record(0x205, struct.pack("<HHHBB", 2, 0, 0, 1, 0)), record(0x205, struct.pack("<HHHBB", 2, 1, 0, 42, 1)), record(0x201, struct.pack("<HHH", 2, 2, 0)),
        record(0x06, struct.pack("<HHHdHIH", 3, 0, 0, -4.0, 0, 0, 0)), record(0x06, struct.pack("<HHH", 3, 1, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)), record(0x207, struct.pack("<HB", 6, 0) + b"result"),
        record(0x06, struct.pack("<HHH", 3, 2, 0) + b"\1\0\0\0\0\0\xff\xff" + bytes(8)), record(0x204, struct.pack("<HHHHB", 4, 0, 0, 3, 0) + b" x "),
    ])
    begin = record(0x809, struct.pack("<HHII", 0x600, 5, 0, 0))
    middle = record(0xFC, first) + record(0x3C, second) + record(0x3C, third) + record(0x0A, b"")
    bound = lambda at: record(0x85, struct.pack("<IBBBB", at, 0, 0, 1, 0) + b"S") + record(0x85, struct.pack("<IBBBB", at, 0, 0, 2, 1) + "Ü2".encode("utf-16-le"))
    at = len(begin) + len(bound(0)) + len(middle)
    return begin + bound(at) + middle + record(0x809, bytes(12)) + cells + record(0x0A, b"") + b"noise"


SHEET = [(1, 1, "née 漢字"), (1, 2, ("long " * 40).strip()), (2, 1, "2.5"), (2, 2, "123.45"), (2, 3, "7"), (2, 4, "0.5"), (3, 1, "TRUE"), (4, 1, "-4"), (4, 2, "result"), (4, 3, "FALSE"), (5, 1, "x"), (6, 1, "ends here")]


def test_cells_of_a_legacy_workbook():
    for pad in (b"", bytes(6000)):  # in short sectors, and in long ones
        text, images = C.xls(C.write_compound({"Other": b"x" * 70, "Workbook": workbook() + pad}))
        assert text.split("\n") == [f"{s}-{r},{c}: {v}" for s in ("S", "Ü2") for r, c, v in SHEET] and images == []


def legacy_doc(flags=0x200):
    narrow, wide = "Dear café\rsecond\7cell\7\x0cHYPERLINK x\r".encode("cp1252"), "漢字 end\r\x13".encode("utf-16-le")
    body = bytearray(0x400) + narrow + wide
    struct.pack_into("<H", body, 10, flags)
    n, m = len(narrow), len(wide) // 2
    pieces = b"\1" + struct.pack("<H", 2) + b"pp" + b"\2" + struct.pack("<I", 4 * 3 + 16) + struct.pack("<III", 0, n, n + m) + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0) + struct.pack("<HIH", 0, 0x400 + n, 0)
    struct.pack_into("<II", body, 0x1A2, 5, len(pieces))
    return C.write_compound({"WordDocument": bytes(body), "0Table": b"wrong", "1Table": b"-----" + pieces})


def atom(kind, body, version=0):
    return struct.pack("<HHI", version, kind, len(body)) + body


def legacy_ppt():
    picture = b"\xff\xd8" + b"p" * 2000
    slide = atom(0x0FA8, b"Title here") + atom(0x0FA0, "Zweite 漢\rZeile".encode("utf-16-le")) + atom(0x0FA8, b"Click to edit Master title style") + atom(0x0FA8, b"*") + atom(1, b"skipped")
    pictures = atom(0xF01D, bytes(17) + picture, 0x46A0) + atom(0xF01E, bytes(33) + picture, 0x6E10) + atom(0xF01D, bytes(17) + b"tiny", 0x46A0) + atom(0xF01A, bytes(3000))
    return C.write_compound({"PowerPoint Document": atom(1000, slide, 15), "Pictures": pictures}), picture


def test_pieces_and_atoms_of_legacy_documents():
    assert C.doc(legacy_doc())[0] == "Dear café\nsecond\tcell\tHYPERLINK x\n漢字 end\n"
    data, picture = legacy_ppt()
    text, images = C.ppt(data)
    assert text == "Title here\nZweite 漢\nZeile" and [i["data"] for i in images] == [picture, picture]


def test_broken_legacy_files_are_error_rows(spark):
    good = C.write_compound({"Workbook": workbook() + bytes(9000)})
    cyclic = bytearray(good)
    table = (struct.unpack_from("<I", good, 76)[0] + 1) * 512
    struct.pack_into("<I", cyclic, table, 0)  # the first sector is its own next
    data, _ = legacy_ppt()
    made = [("good", "excel_legacy", good), ("cyclic", "excel_legacy", bytes(cyclic)), ("short", "excel_legacy", good[:3000]), ("none", "excel_legacy", b""), ("text", "word_legacy", b"not at all" * 100), ("other", "ppt_legacy", good), ("doc", "word_legacy", legacy_doc()), ("locked", "word_legacy", legacy_doc(0x300)), ("ppt", "ppt_legacy", data)]
    found = {r.path: r for r in files.parse(spark.createDataFrame(made, "path string, kind string, content binary")).collect()}
    assert {p for p, r in found.items() if r.error is None} == {"good", "doc", "ppt"}
    assert found["doc"].text.split("\n") == ["Dear café", "漢字 end"] and len(found["ppt"].images) == 2
    assert "doesn't end" in found["cyclic"].error and "encrypted" in found["locked"].error and "KeyError" in found["other"].error


def test_damage_anywhere_ends():
    good, r = C.write_compound({"Workbook": workbook() + bytes(9000), "small": b"s" * 100}), random.Random(6)
    for _ in range(400):
        bad = bytearray(good[: r.randrange(600, len(good) + 1)] if r.random() < 0.3 else good)
        for _ in range(r.randrange(1, 6)):
            bad[r.randrange(len(bad))] = r.choice((0, 255, r.randrange(256)))
        try:
            C.xls(bytes(bad))
        except (ValueError, KeyError, IndexError, struct.error):
            pass


# streams by event time

HOUR = 3600 * W.SECOND


def arrive(spark, folder, number, rows):
    spark.createDataFrame(rows, "key long, id long, at long").coalesce(1).write.parquet(f"{folder}/batch={number}")


def run_sessions(spark, folder, late="1 hour"):
    stream = spark.readStream.schema("key long, id long, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = Z.session_stream(stream, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.read.schema(Z.EVENTS).parquet(f"{folder}/out").collect()), key=str)


def test_sessions_survive_a_restart_and_end_by_timers(spark, tmp_path):
    r, rows = random.Random(9), []
    at = {k: 0 for k in range(4)}
    for i in range(300):
        k = r.choice((0, 0, 0, 1, 2, 3))
        at[k] += r.randrange(1, 20) * HOUR
        rows.append((k, i, at[k]))
    rows.sort(key=lambda x: x[2])
    half = len(rows) // 2
    arrive(spark, f"{tmp_path}/in", 1, rows[:half])
    first = run_sessions(spark, tmp_path)
    arrive(spark, f"{tmp_path}/in", 2, rows[half:])  # a new query goes on from the checkpoint
    last = max(x[2] for x in rows) + 400 * HOUR
    arrive(spark, f"{tmp_path}/in", 3, [(9, 9999, last)])
    found = run_sessions(spark, tmp_path)
    assert len(found) > len(first) > half
    log = spark.createDataFrame([(*x, 0) for x in rows], "key long, id long, at long, value long")
    want = content(W.sessions(log))
    assert sorted((k, i, a, s) for k, i, a, s, e in found if e == Z.REQUEST and k != 9) == sorted((x[0], x[1], x[2], x[3]) for x in want)
    # every session but the last key's has ended, though nobody asked again after the last ones
    ends = [(k, s) for k, i, a, s, e in found if e == Z.EXPIRED]
    assert sorted(ends) == sorted({(x[0], x[3]) for x in want}) and all(i is None for k, i, a, s, e in found if e == Z.EXPIRED)


def test_streak_stream_equals_its_fold(spark, tmp_path):
    r = random.Random(3)
    log = spark.createDataFrame([(r.randrange(3), i, i * 1000, r.randrange(2)) for i in range(500)], "key long, id long, at long, value long").repartition(4)
    got = W.run_available(W.streak_stream(W.replayed(log, str(tmp_path), "log")), str(tmp_path), "streaks")
    assert content(got.select("key", "id", "at", "streak")) == content(W.failure_streaks(log).select("key", "id", "at", "streak"))


def test_tickets_are_redeemed_once(spark, tmp_path):
    issued = [(1, 0), (2, 0), (3, 0), (4, 10 * HOUR), (99, 900 * HOUR)]
    uses = [(1, 11, HOUR), (1, 10, HOUR), (1, 12, 2 * HOUR), (2, 20, 12 * HOUR), (3, 30, -HOUR), (3, 31, 12 * HOUR - 1), (5, 50, HOUR), (4, 40, 10 * HOUR), (99, 990, 900 * HOUR)]
    streams = [W.replayed(spark.createDataFrame(rows, schema), str(tmp_path), name) for rows, schema, name in ((issued, "ticket long, at long", "issued"), (uses, "ticket long, id long, at long", "uses"))]
    got = W.run_available(Z.redeemed(*streams, 12 * 3600), str(tmp_path), "redeemed")
    assert content(got.select("ticket", "id", "at")) == [(1, 10, HOUR), (3, 31, 12 * HOUR - 1), (4, 40, 10 * HOUR)]  # 99 may still be used


# text index


def test_indexed_search_equals_the_scan(spark, tmp_path):
    from tarnkit.operators import text_index as X

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdé漢字") for _ in range(r.randrange(1, 6)))
    chunks = [(d, k, " ".join(word() for _ in range(r.randrange(0, 30))), r.choice(("", "p", "q"))) for d in range(60) for k in range(r.randrange(1, 6))] + [(99, 0, None, ""), (99, 1, "", "p")]
    asked = [(i, " ".join(word() for _ in range(r.randrange(0, 7))), r.choice(("", "p", "q", None))) for i in range(40)] + [(100, None, ""), (101, "a", ""), (102, chunks[3][2], chunks[3][3])]
    c, q = spark.createDataFrame(chunks, "document_id long, chunk_index int, lowered string, part string"), spark.createDataFrame(asked, "query_id long, question string, part string")
    for block, k, least, partitioned in ((7, 3, 0.1, True), (7, 2, 0.3, False), (512, 4, 0.2, True), (1, 1, 0.05, True)):
        index = X.index_chunks(c, f"{tmp_path}/{block}-{k}", block)
        want = content(S.text_search(q.where("question is not null"), c.where("lowered is not null"), k, least, partitioned))
        assert content(X.search_index(q, index, k, least, partitioned)) == want and len(want) > 20
    assert content(X.search_index(q, X.open_index(spark, f"{tmp_path}/7-2"), 2, 0.3)) == content(S.text_search(q.where("question is not null"), c.where("lowered is not null"), 2, 0.3))
    assert X.search_index(q.limit(0), index, 3, 0.4).count() == 0


def test_a_search_reads_its_runs_and_no_other(spark, tmp_path, monkeypatch):
    from tarnkit.operators import text_index as X

    chunks = spark.createDataFrame([(d, 0, t) for d, t in enumerate(["some words here", "others there", "zzz yyy xxx", "nothing at all"] * 20)], "document_id long, chunk_index int, lowered string")
    index = X.index_chunks(chunks, str(tmp_path / "i"), 5)
    q = spark.createDataFrame([(1, "zzz")], "query_id long, question string")
    asked = X.Asked([1], ["zzz"], [["zzz"]], None)
    rows = X.rows_wanted(index, asked, False)
    assert {(r.gram, r["size"]) for r in rows.collect()} == {(122 << 21 | 122, 2), (122 << 42 | 122 << 21 | 122, 3)}
    from test_plans import plan

    assert "PartitionFilters: [isnotnull(bucket" in plan(rows) or "PartitionFilters: [bucket" in plan(rows)
    found = X.candidates(index, asked, 3, 0.4, False)
    assert "lowered" not in plan(found) and {r.query_id for r in found.collect()} == {1}
    assert [r.document_id for r in X.search_index(q, index, 3, 0.4).orderBy("rank").collect()] == [2, 6, 10]


# embeddings and exports


def test_each_text_goes_to_the_service_once(spark, tmp_path):
    from tarnkit.functions.vectors import embed_one
    from tarnkit.operators.embedding import embed_texts

    log, broken = tmp_path / "sent", tmp_path / "broken"

    def service(texts):
        if broken.exists() and "text 7" in texts:
            raise RuntimeError("service lost")
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [embed_one(t).tolist() for t in texts]

    sent = lambda: log.read_text().splitlines() if log.exists() else []
    rows = [(k, None if k == 50 else f"text {k % 20}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    broken.touch()
    with pytest.raises(Exception, match="service lost"):
        embed_texts(df, service, "m1", str(tmp_path / "cache"), batch=2)
    before = sent()
    broken.unlink()
    found = {r.id: r.vector for r in embed_texts(df, service, "m1", str(tmp_path / "cache"), batch=2).collect()}
    assert len(before) == len(set(before)) and all(found[k] == (None if t is None else embed_one(t).tolist()) for k, t in rows)
    assert sorted(sent()) == sorted({t for _, t in rows if t})  # nothing that was answered before the failure is sent again
    more = df.unionByName(spark.createDataFrame([(100, "another")], "id long, text string"))
    assert embed_texts(more, service, "m1", str(tmp_path / "cache")).where("vector is not null").count() == 60
    assert len(sent()) == 21
    assert embed_texts(df.limit(0), service, "m1", str(tmp_path / "cache")).count() == 0
    embed_texts(df, service, "m2", str(tmp_path / "cache")).count()
    assert len(sent()) == 41  # another model has answers of its own


def test_a_chain_that_lacks_rows_is_refused(spark, tmp_path):
    from tarnkit.operators import tables as T

    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-02-01 00:00:00")], "id long, v string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    T.export({"t": df}, f"{tmp_path}/0", None, {"t": "created_at"})
    T.export({"t": df.withColumn("v", F.lit("c"))}, f"{tmp_path}/1", "2024-01-15", {"t": "created_at"})
    paths = [f"{tmp_path}/0", f"{tmp_path}/1"]
    assert sorted((r.id, r.v) for r in T.restore_chain(spark, paths, {"t": ["id"]})["t"].collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError, match="full export"):
        T.restore_chain(spark, paths[::-1], {"t": ["id"]})
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/1/t")
    with pytest.raises(ValueError, match="manifest says 1"):
        T.restore_chain(spark, paths, {"t": ["id"]})
