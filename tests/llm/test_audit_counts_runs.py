"""Source audit, token counts and periodic runs against brute force, with every edge case at once."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from tarnkit.llm import period_runs, source_audit, token_counts
from tarnkit.llm.oracles import ORACLES
from tarnkit.llm.queries import QUERIES


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "an", "Er", "é", "st", "ou", "漢"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "a" * 3000, "ab " * 400, "x y z " * 9, "Don't  it's\n\n we'll 's ½ ² 漢字    x  ", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|><|endoftext|>", "12345 678 \t\t 9", "w " * 23, "w " * 24, "a b " * 11 + "a b"]


def rows():
    texts = [*ODD, *(prose(k, 120) for k in range(40)), prose(3, 120), prose(99, 900)]
    return [(k, t, (None, "en", "de")[k % 3], (None, "s1", "s2", "ß", "s\U00010000")[k % 5], "shadow", 1.5, None) for k, t in enumerate(texts)] + [(3, "one", "fr", "lone", "shadow", 0.0, None), (None, "no id", "fr", "other", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, `a.b` string, rank double, term string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def audit_model(rows, least):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    df, count, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source, w = lang or "", source or "", words(text or "")
        groups.add((lang, source))
        df.update((lang, x) for x in set(w))
        count.update((lang, source, x) for x in w)
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [t for (k, t), n in df.items() if k == lang and n >= least], [s for k, s in groups if k == lang]

        def p(counts, kept=kept):
            n = sum(counts)
            return [1 + 10**9 * (c + 5) // (n + 5 * len(kept)) for c in counts]

        of = {s: [count[lang, s, t] for t in kept] for s in sources}
        share, q = {s: p(c) for s, c in of.items()}, p([sum(c) for c in zip(*of.values(), strict=True)])
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(share[s], share[o], strict=True)), o.encode()) for o in sources if o != s]
            terms = [(b - a, t.encode()) for t, a, b, c in zip(kept, share[s], q, of[s], strict=True) if c and a > b]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "block", "tile"), [(3, 4096, 256), (2, 7, 2), (5, 50, 1), (10**6, 10, 3)])
def test_source_audit(docs, least, block, tile):
    got = source_audit.audit_sources(docs, least, block, tile)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got.collect()) == audit_model(rows(), least)


def test_source_audit_spills_and_merges(spark, docs, empty):
    stripes = source_audit.fold(docs, spill=50)
    assert stripes.count() > source_audit.fold(docs).count()
    found = []
    for s, rows_ in ((stripes, 7), (stripes, 1), (source_audit.fold(docs), 10_000)):  # a term's stripes lie in one batch, and in many
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_)
        try:
            found.append(sorted((r.lang, r.term, r.df, sorted(map(tuple, r.sources))) for r in source_audit.merged(s, 2).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    assert source_audit.audit_sources(empty).count() == 0


def test_shares_are_exact_beyond_doubles():
    import numpy as np

    r = random.Random(1)
    pairs = [(r.randrange(5, 10**k), r.randrange(10**k, 9 * 10**15)) for k in (2, 9, 13, 15) for _ in range(200)]
    c, d = map(np.array, zip(*pairs, strict=True))
    assert source_audit.share(c, d).tolist() == [1 + 10**9 * x // y for x, y in pairs]


@pytest.mark.parametrize("name", ["op11_source_audit", "token_cache_runs"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    from conftest import as_set

    df, found = QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name])
    assert as_set(df.columns, [tuple(r) for r in df.collect()]) == as_set([c[0] for c in found.description], found.fetchall())


def library_counts(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, empty, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    tokenizer = token_counts.load_tokenizer(path)
    assert (tokenizer.classes is not None) == (name == "byte_bpe_50k.json")
    texts = [r[1] or "" for r in rows()]
    want = [(r[0], len(t.encode()), n, n > 512) for r, t, n in zip(rows(), texts, library_counts(path, texts), strict=True)]
    got = token_counts.judge_length(docs, tokenizer)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == sorted(want, key=str)
    assert token_counts.judge_length(empty, tokenizer).count() == 0


def test_a_process_keeps_one_counter_and_asks_for_little_at_once(monkeypatch):
    import pyarrow as pa
    import public_tokenizers

    tokenizer, made, asked = token_counts.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), [], []

    class Counter(token_counts.TokenCounter):
        def __init__(self, tokenizer):
            super().__init__(tokenizer)
            made.append(self)
            encode = self.encode
            self.encode = lambda texts: asked.append(sum(map(len, texts))) or encode(texts)

    class Misses:
        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    monkeypatch.setattr(token_counts, "TokenCounter", Counter)
    monkeypatch.setattr(token_counts, "_MADE", {})
    work = token_counts.encode_misses(Misses(), tokenizer)
    texts = [" ".join(f"x{k}y{k * k}" for k in range(a, a + 20_000)) for a in (0, 10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"1", b"2"]), pa.array(texts)], ["content", "text"])
    for _task in range(3):
        got = [n for b in work(iter([batch])) for n in b.column(1).to_pylist()]
        assert got == library_counts(public_tokenizers.path("byte_bpe_50k.json"), texts)
    assert len(made) == 1
    assert max(asked) <= 8 * token_counts.ASKED < sum(map(len, texts)) // 4


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_by_words_are_the_librarys(name, monkeypatch):
    import random

    import pyarrow as pa
    import public_tokenizers

    path, pick = public_tokenizers.path(name), random.Random(3)
    tokenizer = token_counts.load_tokenizer(path)
    assert tokenizer.spaced
    parts = [*" \n\t\u00a0\u3000\u2028▁aĠĊ²", "  ", "   x", "\r\n", "▁▁", " the", "word", "'s", "'", "é", "漢字", "\U0001f600", "e\u0301", " 7", "!!", "<|endoftext|>", "<|", "|>", "<s>", "<0x0A>", "\x00", "\x1c", "x" * 40]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 20))) for _ in range(3000)] + ["", " ", "  ", "▁", "a ", "a  ", None]
    want = library_counts(path, [t or "" for t in texts])
    for words, cell, group in ((1 << 20, 1 << 18, 1 << 23), (50, 200, 1000), (0, 1 << 10, 1 << 13)):
        for key, value in (("KNOWN_WORDS", words), ("CELL", cell), ("GROUP", group)):
            monkeypatch.setattr(token_counts, key, value)
        counter = token_counts.TokenCounter(tokenizer)
        assert counter.counts(pa.array(texts)).tolist() == want
        assert len(counter.known) <= words
        assert counter.counts(pa.array([], pa.string())).tolist() == []


def test_token_counts_of_the_table_are_the_librarys(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    table = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(table, library_counts(path, list(table.values())), strict=True))
    assert {r.doc_id: r.n_tokens for r in QUERIES["op12_token_counts"](spark, sf_dir).collect()} == want


def test_counts_are_read_from_the_cache(spark, docs, tmp_path, monkeypatch):
    import public_tokenizers

    tokenizer = token_counts.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    cache = token_counts.CountCache(spark, str(tmp_path / "cache"))
    n = len({r[1] or "" for r in rows()})
    first, n_texts, n_stored = token_counts.counted(docs, tokenizer, cache)
    assert (n_texts, n_stored) == (n, 0)
    stored = cache.rows(tokenizer)
    assert stored.count() == n
    # counts that only the cache can know: what was stored is not encoded again
    changed = token_counts.CountCache(spark, str(tmp_path / "changed"))
    from pyspark.sql import functions as F

    stored.withColumn("n_tokens", F.col("n_tokens") + 1000).write.partitionBy("tokenizer", "run").parquet(changed.folder)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(1000, "a new text"), (1001, "a new text")], "doc_id long, text string"))
    for limit in (token_counts.FEW_MISSES, 0):
        monkeypatch.setattr(token_counts, "FEW_MISSES", limit)
        again, n_texts, n_stored = token_counts.counted(more, tokenizer, changed)
        assert (n_texts, n_stored) == (n + 1, n if limit else n + 1)
    # texts with many rows are joined apart from the others
    monkeypatch.setattr(token_counts, "HOT_ROWS", 1)
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens)
    hot = token_counts.counted(more, tokenizer, changed)[0]
    assert sorted(map(key, hot.collect())) == sorted(map(key, again.collect()))
    shift = {k: v + 1000 for k, v in ((r.doc_id, r.n_tokens) for r in first.collect())}
    assert {r.doc_id: r.n_tokens for r in again.where("doc_id is null or doc_id < 1000").collect()} == shift
    assert [r.n_tokens for r in again.where("doc_id >= 1000").collect()] == library_counts(public_tokenizers.path("byte_bpe_50k.json"), ["a new text"]) * 2


def runs_model(words, least=24, exponent=3):
    """Every maximal run by its definition."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            piece = words[start : start + length]
            smallest = all(any(a != b for a, b in zip(piece, piece[r:], strict=False)) for r in range(1, q))
            if length >= max(least, exponent * q) and smallest:
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def report_model(doc_id, text):
    words = planted(doc_id, text)
    runs = runs_model(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


REPORT = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_period_runs(spark, docs, empty):
    r = random.Random(5)
    more = [(k, " ".join(r.choice("ab") for _ in range(200))) for k in range(100, 130)]
    more += [(k, " ".join((["p", "q", "r", "s", "t"][: r.randrange(1, 6)] * 30)[: r.randrange(20, 90)] + ["z"] * r.randrange(30)) * 2) for k in range(130, 160)]
    more += [(k, prose(k, r.randrange(1, 300))) for k in range(160, 400)]
    table = docs.select("doc_id", "text", "rank", "term").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = period_runs.run_report(period_runs.plant_repeats(table))
    want = sorted((report_model(i, t) for i, t in [*((r[0], r[1]) for r in rows()), *more]), key=str)
    assert sorted((tuple(x[c] for c in REPORT) for x in got.collect()), key=str) == want
    assert sum(w[1] for w in want) > 40
    assert period_runs.run_report(period_runs.plant_repeats(docs)).count() == len(rows())
    assert period_runs.run_report(period_runs.plant_repeats(empty)).count() == 0


def test_runs_of_words_of_every_shape():
    import numpy as np

    r, fib = random.Random(8), ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts = [fib[-1], "a" * 500, "ab" * 200 + "a", ("aab" * 9 + "b") * 5, "".join(r.choice("ab") for _ in range(400))]
    texts += ["".join(r.choice("abc") * r.randrange(1, 12) for _ in range(30)) for _ in range(40)]
    for least, exponent in ((24, 3), (6, 2), (4, 3), (1, 2)):
        for t in texts:
            code = np.frombuffer(t.encode(), np.uint8).astype(np.int64)
            assert period_runs.runs_of(code, least, exponent) == runs_model(list(t), least, exponent), (t, least, exponent)


def test_ordered_sets_split_their_blocks():
    r = random.Random(2)
    numbers = r.sample(range(10**6), 5000)
    made = period_runs.Positions(numbers[0])
    for k, x in enumerate(numbers[1:]):
        made.add(x)
        if k % 50 == 0:
            held = sorted(numbers[: k + 2])
            for y in r.sample(held, min(20, len(held))):
                i = held.index(y)
                assert made.beside(y) == (held[i - 1] if i else -1, held[i + 1] if i + 1 < len(held) else -1)
    assert list(made) == sorted(numbers) and len(made.blocks) > 3


def test_long_text_of_one_word_is_linear_enough():
    import time

    import numpy as np

    began = time.time()
    assert period_runs.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert time.time() - began < 30
