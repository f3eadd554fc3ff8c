"""Operators on pages and conversations against brute force, and the pipeline."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnkit.llm import chat, html_extract, url_filter


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


MARKS = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    r = random.Random(2)
    pieces = ["\\", "#", "###", "</turn>", "\n", "</turn>\n", ": ", "a", "é😀", "### User: ", "=", ""]
    data = []
    for conv in range(40):
        for turn in range(r.randrange(1, 6)):
            data.append((conv, turn, r.choice(["user", "assistant", "system", "odd: \\role", "User", None, ""]), r.choice([None, "", "".join(r.choice(pieces) for _ in range(12)), "x" * 700])))
    data += [(None, 0, "user", "no conversation"), (7, None, "assistant", "no turn"), (-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS), (3, 0, "user", "again"), (3, 0, "user", "again")]
    df = spark.createDataFrame([(*x, "extra") for x in data], "conv_id long, turn long, role string, text string, seq string").repartition(3)
    want = {}
    for conv, turn, role, text in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = {x.conv_id: x for x in chat.format_digest(df).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss)), conv
    assert chat.format_digest(df.limit(0)).count() == 0


def test_chat_parts_hold_whole_turns(spark, monkeypatch):
    df = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"text {t}" * 5) for t in range(20)], "conv_id long, turn long, role string, text string")
    whole = chat.format_digest(df).collect()
    monkeypatch.setattr(chat, "PART_CHARS", 100)
    assert chat.format_events(chat.events_of(df)).count() > 3
    assert chat.format_digest(df).collect() == whole


def test_stored_parts_are_read_back_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 100)
    df = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"text {t}" * 5) for c in range(6) for t in range(20)], "conv_id long, turn long, role string, text string")
    chat.format_events(chat.events_of(df)).orderBy("text").write.parquet(f"{tmp_path}/parts")
    assert sorted(chat.read_back(spark.read.parquet(f"{tmp_path}/parts")).collect()) == sorted(chat.format_digest(df).collect())


def test_log_holds_drafts_edits_regenerations_and_retractions(spark):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "x" * 600)], "conv_id long, turn long, role string, text string")
    log = chat.events_of(df)
    assert {r.op: r["count"] for r in log.groupBy("op").count().collect()} == {"delta": 2 + 2 + 1, "edit": 1, "regenerate": 1, "retract": 1}
    (part,) = chat.format_events(log).collect()
    assert list(chat.parse(part.text)) == [("user", "ask"), ("assistant", "x" * 600)]


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, 1, 1, "delta", "user", "Hel"), (1, 0, 1, 2, "delta", None, "lo"), (1, 1, 1, 1, "delta", "assistant", "bad"), (1, 1, 1, 2, "regenerate", "assistant", "go"),
        (1, 1, 1, 3, "delta", None, "od"), (1, 2, 1, 1, "delta", "user", "first"), (1, 2, 1, 2, "edit", None, "second"), (1, 3, 1, 1, "delta", "assistant", "x"), (1, 3, 1, 2, "retract", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, msg long, seq int, op string, role string, text string").repartition(4)
    (part,) = chat.format_events(events).collect()
    assert list(chat.parse(part.text)) == [("user", "Hello"), ("assistant", "good"), ("user", "second")]
    assert [part.text[m.start : m.end] for m in part.mask] == ["good"]


def url_model(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for action, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return host, path, *(best or (None, None))


def test_urls(spark):
    r = random.Random(6)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c/d", "http://com/", "http://com", "http://É.com/", "http://xcom/", "http://net/es/", "http://a.net/esx"]
    urls += [f"https://{r.choice(['shop', 'blog', 'casino'])}{r.randrange(99)}.{r.choice(['example.com', 'other.com', 'site.net', 'www.example.com', 'site.org'])}/{r.choice(['en', 'es', 'fr'])}/{r.choice(['', 'p?q'])}" for _ in range(800)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, *urls[-3:]])], "page_id long, url string, host string").repartition(3)
    got = {x.page_id: x for x in url_filter.filter_urls(df).collect()}
    assert len(got) == len(urls) + 3
    for k, u in enumerate(urls):
        host, path, action, rule = url_model(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == action if rule else got[k].verdict in ("allow", "block")
    assert got[0].verdict == got[2].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_models_tell_held_out_urls_apart(spark):
    good = [f"https://news{k}.org/science/article-{k * 7}" for k in range(600)]
    bad = [f"https://win{k}.biz/casino/bonus-{k * 3}" for k in range(600)]
    labelled = spark.createDataFrame([(u.split("://")[1], a) for us, a in ((good, "allow"), (bad, "block")) for u in us], "rest string, action string")
    model, threshold = url_filter.train(labelled)
    import numpy as np

    def score(us):
        data = [u.encode() for u in us]
        return model.score(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(u) for u in data])]))

    accepted, rejected = score([f"news{k}.org/science/article-{k}" for k in range(9000, 9100)]), score([f"win{k}.biz/casino/bonus-{k}" for k in range(9000, 9100)])
    assert (accepted >= threshold).mean() > 0.95 and (rejected < threshold).mean() > 0.95


def test_url_scores_equal_exact_counts(spark):
    import math
    from collections import Counter

    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(24)) for _ in range(5000)]
    labelled = spark.createDataFrame([(f"{w}.{'good' if k % 2 else 'bad'}", "allow" if k % 2 else "block") for k, w in enumerate(words)], "rest string, action string").repartition(3)
    model, _ = url_filter.train(labelled)
    pairs, alone = Counter(), Counter()
    for rest, action in labelled.where("pmod(xxhash64(rest), 10) != 0").collect():
        b = rest.encode()
        for i in range(len(b)):
            for k in range(5):
                context = (action, k, (b"^" * 4 + b)[i + 4 - k : i + 4])
                pairs[context, b[i]] += 1
                alone[context] += 1

    def brute(b):
        total = 0.0
        for i in range(len(b)):
            for action, sign in (("allow", 1), ("block", -1)):
                p = 1 / 256
                for k in range(5):
                    context = (action, k, (b"^" * 4 + b)[i + 4 - k : i + 4])
                    p = (pairs[context, b[i]] + 2 * p) / (alone[context] + 2)
                total += sign * math.log(p)
        return total / len(b)

    asked = [*words[:20], "a", "never.seen/é?", words[3]]
    got = model.scored(spark.createDataFrame([(k, x) for k, x in enumerate([*asked, ""])], "at long, rest string").repartition(2)).orderBy("at").collect()
    assert [x.score for x in got[:-1]] == pytest.approx([brute(x.encode()) for x in asked], abs=1e-9) and got[-1].score == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<article><h1>T&amp;t</h1><p>a <b>b</b>c<br>d\n e</p></article>", "T&t a bc d e"),
        ("<nav>menu</nav><div class='ad'>buy</div><article><p>x<p>y</article><footer>f</footer>", "x y"),
        ("<article><p>x</p><aside>no</aside><div id=comments><p>no</p></div><p>y</p></article>", "x y"),
        ("<article><p>open <b>bold<p>two</p></article>", "open bold two"),
        ("<article>a<!-- c --><script>var t='</p>';</script><style>p{}</style>b</article>", "ab"),
        ("<article><p>cut &lt; here <a href='x", "cut < here"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<html><head><title>no</title></head><body><main><p>m</p></main></body>", "m"),
        ("<ARTICLE><P TITLE='a>b'>q</P></ARTICLE>", "q"),
        ("<form><input>no</form><article>yes</article>", "yes"),
        ("<article><p class=notice>no<p>yes</article>", "yes"),
        ("<article>a&nbsp;b &#233;&eacute;</article>", "a b éé"),
        ("<article></article><p>loose</p>", ""),
    ],
)
def test_html_blocks(page, text):
    zones, texts, found = html_extract.segments(page or "")
    assert " ".join(t for z, t in zip(zones, texts, strict=True) if z == (html_extract.ARTICLE if found else html_extract.LOOSE)) == text


def test_repeated_strings_leave_pages_without_an_article(spark):
    boiler = "accept all our cookies to go on with this site now"
    pages = [(k, f"http://a.org/{k}", f"<div><p>unique text number {k} says {k * k} things</p><p>{boiler}</p></div>") for k in range(6)]
    pages += [(90, "http://b.org/", f"<div><p>{boiler}</p></div>"), (91, None, None), (92, "http://a.org/x", "<article><p>" + boiler + "</p></article>"), (0, *pages[0][1:])]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text long")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_text(df).collect())
    want = [(k, f"unique text number {k} says {k * k} things") for k in (0, 0, 1, 2, 3, 4, 5)] + [(90, boiler), (91, ""), (92, boiler)]
    assert got == [(k, t, len(t)) for k, t in want]
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_repeated_strings_decide_loose_blocks_beside_an_article(spark):
    boiler = "accept all our cookies to go on with this site now"
    pages = [(k, f"http://a.org/{k}", f"<p>lead of page {k} stands outside of its article</p><article><p>text {k}</p></article><p>{boiler}</p><p>by {k}</p>") for k in range(3)]
    pages += [(k, f"http://b.org/{k}", "<p>one and the same page under two of the addresses</p>") for k in (10, 11)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    want = {k: f"lead of page {k} stands outside of its article text {k}" for k in range(3)}
    assert got == want | {k: "one and the same page under two of the addresses" for k in (10, 11)}


def test_shards_of_a_host_share_their_evidence(spark, monkeypatch):
    pages = [(k, "http://hot.org/", f"<p>a unique text that stands on page {k} alone {k * k}</p><p>notice {k // 2} of this site for two of all its pages</p>") for k in range(40)]
    pages += [(k, "http://hot.org/", f"<nav>menu {k} with as many words as it takes</nav><article>{k}</article>") for k in range(40, 60)]
    pages += [(60 + k, "http://hot.org/", f"<p>what page {k} says is said once and never again</p><p>menu {40 + k} with as many words as it takes</p>") for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = sorted(html_extract.extract_text(df).select("page_id", "url", "text", "n_chars").collect())
    monkeypatch.setattr(html_extract, "SHARD_CHARS", 600)
    assert sorted(html_extract.extract_text(df).select(*whole[0].__fields__).collect()) == whole
    texts = {r.page_id: r.text for r in whole}
    assert not any("notice" in t or "menu" in t for t in texts.values()) and texts[61] == "what page 1"


def test_repeated_runs_equal_brute_force():
    import numpy as np

    r = random.Random(5)
    for _ in range(200):
        tokens, page = [], []
        for p in range(4):
            for _ in range(r.randrange(1, 3)):
                words = [r.choice("abc") for _ in range(r.randrange(12))]
                tokens += [*words, None]
                page += [p] * (len(words) + 1)
        starts = {}
        for i in range(len(tokens) - 3):
            if None not in tokens[i : i + 4]:
                starts.setdefault(tuple(tokens[i : i + 4]), []).append(i)
        want = np.zeros(len(tokens), bool)
        for at in starts.values():
            if len({page[i] for i in at}) > 1:
                for i in at:
                    want[i : i + 4] = True
        names = {}
        ids = np.array([-1 - k if t is None else names.setdefault(t, len(names)) for k, t in enumerate(tokens)])
        assert (html_extract.repeated_runs(ids, np.array(page), 4) == want).all()


def extract_model(pages):
    """The operator's rule by brute force over all windows of a host."""
    least, hosts = html_extract.MIN_TOKENS, {}
    cut = []
    for _, url, page in pages:
        zones, texts, found = html_extract.segments(page or "")
        host = (re.search("://([^/?#]*)", url or "") or [None, ""])[1].lower()
        own = tuple(t for z, t in zip(zones, texts, strict=True) if z != html_extract.BOILER)
        cut.append((host, own, [(z, t.split(" ")) for z, t in zip(zones, texts, strict=True)], found))
        for _, w in cut[-1][2]:
            for k in range(len(w) - least + 1):
                hosts.setdefault((host, tuple(w[k : k + least])), set()).add(own)
    out = []
    for (page_id, url, _), (host, _, parts, found) in zip(pages, cut, strict=True):
        text, repeated, marked = [], 0, 0
        for zone, w in parts:
            hit = [any(len(hosts.get((host, tuple(w[j : j + least])), ())) > 1 for j in range(max(0, k - least + 1), k + 1)) for k in range(len(w))]
            if zone == html_extract.ARTICLE:
                text += w
                continue
            repeated += sum(hit)
            if zone == html_extract.BOILER:
                marked += len(w) - sum(hit)
                continue
            run = []
            for word, bad in [*zip(w, hit, strict=True), (None, True)]:
                if bad:
                    text += run if len(run) >= (least if found else 1) else []
                    run = []
                else:
                    run.append(word)
        out.append((page_id, url, " ".join(text), len(" ".join(text)), repeated, marked))
    return sorted(out, key=str)


def made_pages(n):
    r = random.Random(12)
    words = lambda k: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(4)) for _ in range(k))
    menus, articles, notes = [words(9) for _ in range(3)], [f"<article><h1>{words(5)}</h1><p>{words(40)}</article>" for _ in range(8)], [words(12) for _ in range(4)]
    out = [(None, None, None), (1, "http://a.org", ""), (2, "HTTP://A.org/x", f"<p>{notes[0]}</p>"), (2, "HTTP://A.org/x", f"<p>{notes[0]}</p>")]
    for k in range(n):
        body = r.choice([*articles, f"<article>{words(30)}</article>", f"<p>{words(20)}</p><p>{r.choice(notes)}</p>"])
        loose = r.choice(["", "", f"<p>{r.choice(notes)}</p>", f"<p>{words(8)}</p>", f"<div>{words(3)}</div>"])
        comment = r.choice(["", f"<div class=comments><p>{words(10)}</div>"])
        out.append((10 + k, f"http://{r.choice('aab')}.org/{k}", f"<nav><li>{'<li>'.join(r.choice(menus).split(' '))}</nav>{loose}{body}{comment}<footer>{r.choice(notes)}</footer>"))
    return out


def test_whole_pages_equal_brute_force(spark, monkeypatch):
    pages = made_pages(120)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = extract_model(pages)
    assert sorted((tuple(r[c] for c in ("page_id", "url", "text", "n_chars", "repeated", "marked")) for r in html_extract.extract_text(df).collect()), key=str) == want
    assert sum(x[4] for x in want) > 1000
    monkeypatch.setattr(html_extract, "SHARD_CHARS", 4000)
    assert sorted((tuple(r) for r in html_extract.extract_text(df).select("page_id", "url", "text", "n_chars").collect()), key=str) == [x[:4] for x in want]


def test_query_removes_repeated_strings_and_keeps_articles(spark, sf_dir):
    from tarnkit.llm.common import read_table

    pages = read_table(spark, sf_dir, "pages")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = html_extract.extract_text(pages).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "url", "text", "n_chars", "repeated", "marked")) for r in got), key=str) == extract_model(rows)


@pytest.mark.parametrize("name", ["op2_decontaminate", "op3_chat", "op4_secrets", "secret_ledger_runs", "op9_near_join", "op10_quality"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    from conftest import as_set

    from tarnkit.llm.oracles import ORACLES
    from tarnkit.llm.queries import QUERIES

    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    assert as_set(df.columns, [tuple(r) for r in df.collect()]) == as_set([c[0] for c in want.description], want.fetchall())


def test_pipeline_stages_equal_their_parts(spark, sf_dir):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from tarnkit.llm import byte_bpe, decontaminate, near_join, pii, quality
    from tarnkit.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "personal data", "tokens"]
    good = {r.doc_id for r in quality.judge_quality(docs).where("kept").collect()}
    docs = docs.where(F.col("doc_id").isin(list(good)))
    one = {r.doc_id for r in near_join.near_components(docs).where("doc_id = component_id").collect()}
    docs = docs.where(F.col("doc_id").isin(list(one)))
    bad = {r.doc_id for r in decontaminate.measure_contamination(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated").collect()}
    docs = docs.where(~F.col("doc_id").isin(list(bad)))
    model = pii.train(docs)
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: library.encode_ordinary(pii.redact(r.text, model)) for r in docs.collect()}
    got = {r.doc_id: memoryview(r.ids).cast("I").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and bad and len(good) > len(one)


def test_stages_on_nulls_repeats_and_clashing_columns(spark, sf_dir):
    import corpus_pipeline

    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    good = " ".join(f"word{k} then" for k in range(60))
    rows = [(1, good, 5), (1, good, 5), (None, good + " more", 5), (2, None, None), (3, "", 0), (4, passage, 1), (None, passage, 1), (5, good + " call +49 170 5551234567 now", 9), (6, "x " * 40_000, 8)]
    docs = spark.createDataFrame([(i, t, n, True, "k", 7) for i, t, n in rows], "doc_id long, text string, n_chars long, kept boolean, key string, n int")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        left[name] = sorted(((r.doc_id, (r.text or "")[-20:]) for r in out.collect()), key=str)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert [i for i, _ in left["quality rules"]] == [1, 1, 5, None]
    assert [i for i, _ in left["near duplicates"]] == [1, 2, 3, 4, 6, None, None]
    assert [i for i, _ in left["decontamination"]] == [1, 1, 2, 3, 5, 6, None]
    assert any("[PHONE] now" in t for i, t in left["personal data"] if i == 5)
    ids = corpus_pipeline.token_stage(spark, docs, sf_dir).collect()
    assert len(ids) == len(rows) and {r.n_tokens for r in ids if r.doc_id in (2, 3)} == {0}


def test_last_stage_decodes_its_ids(spark, sf_dir):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "plain text, 12 é😀"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.token_stage(spark, docs, sf_dir).collect()}
    assert got == {1: sha("plain text, 12 é😀"), 2: sha(""), 3: sha("")}


def test_stages_but_the_last_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
