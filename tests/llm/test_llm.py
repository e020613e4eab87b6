"""The operators on odd inputs, against brute force, round trips and held-out labels."""

import base64
import hashlib
import random

import duckdb
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quirefold.llm import (
    chat,
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    minhash_dedup,
    queries,
    sentencepiece_bpe,
    substring_dedup,
    toxicity,
    warc,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, digest string, rid long, key string"
ODD = [
    (1, "One two three", "en", "x", 1, "k"),
    (2, "One two three", "en", None, 1, "k"),
    (2, "One two three", "en", "x", 1, "k"),
    (3, None, None, "x", 1, None),
    (4, "", "en", "x", 1, "k"),
    (5, "x" * 50_000, "en", "x", 1, "k"),
    (6, "word " * 30_000, None, "x", 1, "k"),
    (7, " \n\t ", "en", "x", 1, "k"),
    (None, "no id here at all", "en", "x", 1, "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = queries.queries()[name](spark, SF).toPandas()
    theirs = con.execute(queries.oracle_sql()[name]).df()
    clean = lambda f: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert clean(mine) == clean(theirs)


def test_encoding_equals_the_library(spark, odd):
    model = queries.piece_model()
    mine = sentencepiece_bpe.PieceModel(model)
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    texts = [t or "" for _, t, *_ in ODD] + ["".join(rng.choices(" \n▁ab.th,eé漢😀'\"<>0x", k=rng.randrange(120))) for _ in range(500)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == lib.encode(t) and mine.decode(ids) == lib.decode(ids)
    for _ in range(100):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259)]) for _ in range(12)]
        assert mine.decode(ids) == lib.decode(ids)
    rows = sentencepiece_bpe.round_trip(odd, model).collect()
    assert len(rows) == len(ODD)
    there = sentencepiece_bpe.decode_column(sentencepiece_bpe.encode_column(odd, model), model)
    assert {r["decoded"] for r in there.collect()} >= {"One two three", ""}


def test_exact_groups_of_odd_rows(odd, none):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == len(ODD)
    copies = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"One two three").hexdigest()]
    assert {r["keep_id"] for r in copies} == {2} and sum(r["kept"] for r in copies) == 1 and copies[0]["group_size"] == 3
    assert {r["keep_id"] for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()} == {4}
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert exact_dedup.exact_groups(none).count() == 0


def test_near_groups(spark, odd, none):
    base = [f"w{i}" for i in range(200)]
    near = base.copy()
    near[7], near[90] = "other", "words"
    rows = [(10, " ".join(base)), (11, " ".join(near).upper().replace("W", "w")), (12, " ".join(base[:120]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10: 10, 11: 10, 12: 12}
    found = minhash_dedup.near_groups(odd).collect()
    assert len(found) == len(ODD)
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] in (3, 4, 7)} == {3: 3, 4: 4, 7: 7}
    assert minhash_dedup.near_groups(none).count() == 0


@pytest.mark.parametrize("percent", [50, 79, 101])
def test_near_groups_rejects_what_its_keys_miss(none, percent):
    with pytest.raises(ValueError):
        minhash_dedup.near_groups(none, percent=percent)


def test_blocks_count_common_shingles():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(12)]
    got = minhash_dedup._counts(sets[:5], sets[5:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]


def test_repeats(spark, odd, none):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a b {passage} c"), (2, f"d {passage}"), (3, passage.rsplit(" ", 6)[0]), (4, " ".join(["z"] * 36))]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["n_removed"], got[4]["n_removed"]) == ("a b c", "d", 0, 36)
    found = substring_dedup.digest(odd).collect()
    assert len(found) == len(ODD) and {r["doc_id"]: r["n_removed"] for r in found}[6] == 30_000
    assert substring_dedup.digest(none).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "One two, three"), (2, None), (3, ""), (10, " ".join(f"q{i}" for i in range(14)))], "item_id long, text string")
    got = {(r["doc_id"], r["n_items"], r["contaminated"]) for r in decontamination.report(odd, items).collect()}
    assert (1, 1, True) in got and (3, 0, False) in got and (6, 0, False) in got
    left = decontamination.decontaminate(odd, items)
    assert left.columns == odd.columns and left.where("doc_id <= 2").count() == 0
    docs = spark.createDataFrame([(1, "keep " + " ".join(f"Q{i}" for i in range(2, 13)) + ", tail")], "doc_id long, text string")
    cut = decontamination.decontaminate(docs, items, max_span=10, max_coverage=0.9).first()["text"]
    assert cut == "keep , tail"
    assert decontamination.report(none, items).count() == 0
    assert decontamination.report(odd, items.limit(0)).where("contaminated").count() == 0


def test_language_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    found = queries.op9_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    model = language_id.train(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()}
    assert got[3] == got[4] == got[7] == ("und", 0.0) and got[1][0] == "en"
    assert language_id.predict(odd, language_id.train(none)).where("lang_pred != 'und'").count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(40)], "doc_id long, toxic int")
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=40) + (["vile"] if i < 12 else []) + rng.choices([f"w{j}" for j in range(60)], k=9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, labels)
    more = spark.createDataFrame([(1, "a VILE thing"), (2, "a fine thing"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(more, model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and [(s["start"], s["end"]) for s in got[1]["spans"]] == [(2, 6)]
    assert got[3]["score"] <= got[2]["score"]
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_toxic_words_of_a_small_language(spark):
    """A language with few toxic texts and many rare toxic words, beside one whose few toxic words are common."""
    rng, plain = random.Random(7), {"en": [f"w{j}" for j in range(60)], "fr": [f"v{j}" for j in range(60)]}
    rows, labels = [], []
    for i in range(600):
        lang = "fr" if i % 6 == 0 else "en"
        toxic = int(i % 12 < 2)
        bad = (["vile"] * 9 if lang == "en" else [f"sotise{rng.choice('abcdefgh')}" for _ in range(3)]) if toxic else []
        words = rng.choices(plain[lang], k=60) + bad
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    more = spark.createDataFrame([(1, "v1 v2 sotisea v3"), (2, "v1 v2 v3"), (3, "w1 vile w2")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(more, model).collect()} == {1: 1, 2: 0, 3: 1}
    # Words that near copies of one toxic text repeat are no evidence.
    base = [f"c{j}" for j in range(300)]
    copies = [(1000 + i, " ".join(base[:-1] + [f"end{i}", "vile"])) for i in range(30)]
    model = toxicity.train(spark.createDataFrame(rows + copies, "doc_id long, text string"), spark.createDataFrame(labels + [(i, 1) for i, _ in copies], "doc_id long, toxic int"))
    assert "vile" in model["code"] and not any(w in model["code"] for w in base)


def test_html():
    read = lambda page: html_text.extract_text(page, html_text.Aligner())
    page = "<header>Site</header><nav>a</nav><div class='ad'>x</div><div><h1>T</h1><p>One <b>bold</b>text<p>Two &amp; it<br>ic<ul><li>a<li>b</ul><form>f</form><section class='comments'><p>c</section></div><footer>f"
    assert read(page) == "T\n\nOne boldtext\n\nTwo & it ic\n\na\n\nb"
    assert read("") == ""
    assert read("<div><p title=it's>one</p><p>two</p><p>it's three</p></div>") == "one\n\ntwo\n\nit's three"
    assert read("<div class='notice-period'>a</div><div class='site-nav'>b</div><div data-hidden='x' id='search-results'>c</div><p hidden>d") == "a\n\nc"
    assert read("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"
    assert read("<p>" + "long " * 200_000) == ("long " * 200_000).strip()


ARTICLE = "<html><article><h1>T{0}</h1><p>Body {0}</p><p>Join our list</p><p>More {0}</p></article></html>"


def test_wrapper_acts_in_articles(spark):
    """Constant text inside articles goes, but not that of copies of a page, nor what a few articles share."""
    schema = "page_id long, url string, html string, host string, salt int"
    rows = [(i, f"http://h.example/{i}", ARTICLE.format(i), "x", 1) for i in range(8)]
    rows += [(50 + i, f"http://copies.example/{i}", ARTICLE.format("same"), "x", 1) for i in range(8)]
    rows += [(90 + i, f"http://few.example/{i}", f"<article><p>{'Twice' if i < 3 else i}</p><p>Own {i}</p></article>", "x", 1) for i in range(12)]
    rows += [(1, "http://h.example/1", ARTICLE.format(1), "x", 1), (None, None, None, None, None), (7, "no url", "", None, 0)]
    rows += [(200, "http://h.example/deep", "<div>" * 4_000 + "<p>x" + "</div>" * 4_000, None, 0)]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[3] == "T3\n\nBody 3\n\nMore 3" and "Join our list" in text[51]
    assert text[90] == "Twice\n\nOwn 0" and text[None] == "" and text[7] == "" and text[200] == "x"
    assert "Join our list" in html_text.extract_text(ARTICLE.format(3), html_text.Aligner())


def test_many_hosts_are_joined(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", ARTICLE.format(i)) for i in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 1)
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == few and few[5] == "T5\n\nBody 5\n\nMore 5"


def test_wrapper_drops_what_recurs(spark, none):
    rows = [(i, f"http://h.example/{i}", f"<div>Fixed line</div><div><p>Body {i}</p></div>") for i in range(6)] + [(9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got[3] == "Body 3" and got[9] == "" and html_text.extract(pages.limit(0)).count() == 0


def test_trees_match_by_brute_force():
    rng = random.Random(2)

    def grow(depth):
        kids = [grow(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        kids = [k for i, k in enumerate(kids) if not i or k != kids[i - 1]]
        return (rng.choice("ab"), tuple(kids))

    def text(t):
        return t[0] + (f"({','.join(map(text, t[1]))})" if t[1] else "")

    def plain(a, b):
        """Simple tree matching by trying every choice."""
        if a[0] != b[0]:
            return 0

        def row(p, q):
            if not p or not q:
                return 0
            return max(row(p[1:], q), row(p, q[1:]), plain(p[0], q[0]) + row(p[1:], q[1:]))

        return 1 + row(a[1], b[1])

    assert len(html_text.match_trees("r(a,b(c),d)", "r(b(c),x,d)")) == 4
    for _ in range(300):
        a, b = grow(3), grow(3)
        found = html_text.match_trees(text(a), text(b))
        assert len(found) == plain(a, b) == len({i for i, _ in found}) == len({j for _, j in found})
    source = html_text.parse("<div><p>a<p>b<p>c<ul><li>x</ul><p>d</div>")
    assert html_text.skeleton(source) == "html(div(p,ul(li),p))"
    assert [n.index for n in html_text._walk(source)] == [0, 1, 2, 2, 2, 3, 4, 5]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\nx", None), (4, "http://d", "é" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.page_records(records).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"], got[2]["record_type"]) == ("revisit", 2, 4, "response")
    assert got[4]["payload_digest"] == base64.b32encode(hashlib.sha1(("é" * 10).encode()).digest()).decode()
    assert records.where("warc_type = 'revisit'").count() == 1
    warc.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_warc_filters_are_taken(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader(str(tmp_path), True, 1)
    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert reader.wanted == {"WARC-Type": {"revisit"}} and len(left) == 1


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.format_chats(turns).collect()}
    assert got == {2: 2, 4: 1}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t)}
    last = {t: i for i, t in sorted(docs.items())}
    docs = {i: t for i, t in docs.items() if last[t] == i}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shingles = {}
    for i, t in docs.items():
        w = t.translate(lower).encode().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(shingles[a] & shingles[b])
            if 100 * common >= 80 * (len(shingles[a]) + len(shingles[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = {i: t for i, t in docs.items() if find(i) == i}
    windows = set()
    for t in items:
        w = decontamination.normalise(t)
        k = min(10, len(w))
        windows |= {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if w else set()
    sizes = {len(w) for w in windows}
    clean = {i for i, t in docs.items() if not any(tuple(w[s : s + k]) in windows for w in [decontamination.normalise(t)] for k in sizes for s in range(len(w) - k + 1))}
    lib = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    expected = {i: len(lib.encode(docs[i])) for i in clean}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == expected
