"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; models by brute force."""

import base64
import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from quirefold.llm import chat, decontamination, exact_dedup, html_text, language_id, minhash_dedup, queries, sentencepiece_bpe, substring_dedup, toxicity, warc

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, beside the columns of documents.
SCHEMA = "doc_id long, text string, lang string, row string, own long, id long, digest string, text_key long, found string, rid long, key string, lang_pred string, cls long, host string, bucket long, salt int"
REST = ("r", 1, 1, "d", 1, "f", 1, "k", "xx", 1, "h", 1, 0)
ODD = [
    (1, "One two three four five six", "en", *REST),
    (2, "One two three four five six", "en", *REST),
    (2, "One two three four five six", "en", *REST),
    (2, "Quite another text under this id", None, *REST),
    (3, None, None, *[None] * 13),
    (4, "", "en", *REST),
    (5, "x" * 60_000, "en", *REST),
    (6, "word " * 40_000, None, *REST),
    (7, " \n\t ", "en", *REST),
    (8, "½ ² ① 12", None, *REST),
    (None, "no id here at all", "en", *REST),
    (None, None, None, *REST),
]
ITEMS = [("9", "One two three"), (None, "Quite another"), (None, "word word"), ("10", None), ("9", "One two three"), ("x", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string")


def operators(spark, docs, items):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    return {
        "op1": sentencepiece_bpe.round_trip(docs, queries.piece_model()),
        "op3": minhash_dedup.near_groups(docs),
        "op4": toxicity.score(docs, toxicity.train(docs, labels)),
        "op6": decontamination.report(docs, items),
        "op8": exact_dedup.exact_groups(docs),
        "op9": language_id.predict(docs, language_id.train(docs)),
        "op10": substring_dedup.digest(docs),
    }


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op6", "op8", "op9", "op10"])
def test_a_row_for_each_odd_row(spark, odd, items, name):
    rows = operators(spark, odd, items)[name].collect()
    ids = lambda rs: sorted((r[0] is None, r[0] or 0) for r in rs)
    assert ids((r["doc_id"],) for r in rows) == ids(ODD)
    assert operators(spark, odd.limit(0), items)[name].count() == 0


def test_stages_keep_columns_and_repeated_ids(spark, odd, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(9, "One two three four"), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    named = dict(corpus_pipeline.STAGES)
    kept = {name: named[name](spark, odd, sf) for name in ("language_id", "exact_dedup", "minhash_dedup", "decontamination")}
    for frame in kept.values():
        assert frame.columns == odd.columns
    texts = {name: sorted((r["doc_id"] or 0, (r["text"] or "")[:12]) for r in f.collect()) for name, f in kept.items()}
    assert [x for x in texts["language_id"] if x[0] in (3, 4, 7, 8)] == []
    assert [x for x in texts["exact_dedup"] if x[0] in (1, 2)] == [(2, "One two thre"), (2, "Quite anothe")]
    # Id 2 holds a copy of text 1, which goes, and another text, which stays.
    assert [x for x in texts["minhash_dedup"] if x[0] in (1, 2)] == [(1, "One two thre"), (2, "Quite anothe")]
    assert [x for x in texts["decontamination"] if x[0] in (1, 2)] == [(2, "Quite anothe")]
    assert named["sentencepiece"](spark, odd, sf).count() == len(ODD)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0, name


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "decontamination", "sentencepiece"])
def test_stages_hand_memory_back_first(spark, odd, tmp_path, name):
    """Executors (here the driver) collect their whole heap, and Python workers let go what the stage before kept."""
    import corpus_pipeline

    def keep(batches):
        from quirefold.llm import common

        common.worker_state("before", lambda: bytearray(1_000_000))
        yield from batches

    def kept(batches):
        from quirefold.llm import common

        for batch in batches:
            yield batch.assign(id=int("before" in common._STATE))

    spark.createDataFrame([(9, "One two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))
    tasks = spark.range(0, 4, 1, 4)
    tasks.mapInPandas(keep, "id long").collect()
    before = full()
    dict(corpus_pipeline.STAGES)[name](spark, odd, str(tmp_path))
    assert full() > before
    assert not any(r["id"] for r in tasks.mapInPandas(kept, "id long").collect())


def test_letters():
    assert language_id.letters("A½b ²c ①d1e_f 漢é ½") == ["a", "b", "c", "d", "e", "f", "漢é"]


def test_digests_by_row(spark, odd):
    lib = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    rows = queries.op1_sentencepiece(spark, SF).toPandas().set_index("doc_id")
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    for i, text in texts.items():
        ids = lib.encode(text or "")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert list(rows.loc[i]) == [len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))]


def test_blocks_of_a_benchmark_make_passes(spark, odd, items):
    whole = sorted(map(str, decontamination.report(odd, items).collect()))
    assert sorted(map(str, decontamination.report(odd, items, block_words=1, at_once=1).collect())) == whole
    got = {r["doc_id"]: r for r in decontamination.report(odd.where("doc_id = 6"), items).collect()}
    assert got[6]["n_items"] == 1 and got[6]["n_hit"] == 40_000 and got[6]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_hot_windows_stream(spark, monkeypatch):
    """The same result whatever the lists of hot minimisers and windows hold."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}", *passage, *(f"w{i}-{k}" for k in range(20))])) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, substring_dedup.digest(docs).collect()))
    assert all(r[2] == 60 for r in plain)
    monkeypatch.setattr(substring_dedup, "HOT_TIMES", 10**9)  # no window is known beforehand
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, substring_dedup.digest(docs).collect())) == plain
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_mixture_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    langs = ["de", "en", "fr"]
    words = [f"w{i}" for i in range(30)]
    model = {"langs": langs, "grams": {f" w{i}": i for i in range(10)} | {f"{i} ": 10 + i for i in range(10)}, "table": rng.normal(-4, 2, (21, 3)).astype(np.float32)}
    mixture = language_id.Mixture(model)
    letters = ["a" * (1 + i) for i in range(8)]
    texts = [" ".join(rng.choice(letters, n)) for n in (1, 2, 5, 40)] + [None, "", "12 ½"]

    def plain(text):
        tokens = language_id.letters(text) if text else []
        if not tokens:
            return {}
        p = [[math.exp(max(v - max(row), -30)) for v in row] for row in ([float(x) for x in model["table"][[model["grams"].get(g, 20) for g in language_id.grams(t)]].sum(axis=0)] for t in tokens)]

        def em(cols):
            theta = [1 / len(cols)] * len(cols)
            for _ in range(language_id.ROUNDS if len(cols) > 1 else 0):
                sums = [0.0] * len(cols)
                for row in p:
                    parts = [row[c] * t for c, t in zip(cols, theta, strict=True)]
                    for k, x in enumerate(parts):
                        sums[k] += x / sum(parts)
                theta = [s / len(p) for s in sums]
            return theta, sum(math.log(sum(row[c] * t for c, t in zip(cols, theta, strict=True)) + 1e-30) for row in p)

        full, _ = em(range(3))
        order = sorted(range(3), key=lambda c: -full[c])
        penalty = 0.5 * math.log(len(p) + 1) + 3
        best, out = None, {}
        for size in (1, 2, 3):
            theta, fit = em(order[:size])
            if best is not None and fit - penalty * size <= best:
                break
            best, out = fit - penalty * size, {langs[c]: t for c, t in zip(order, theta, strict=False)}
        return out

    assert words
    for text, got in zip(texts, mixture.infer_all(texts), strict=True):
        assert got == pytest.approx(plain(text), abs=1e-4)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(5)
    chain = toxicity.Chain(4)
    chain.emit, chain.trans, chain.start = rng.normal(0, 1, 4), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    texts = [rng.integers(0, 4, n) for n in (1, 2, 5, 7)]
    f, b, _ = chain.marginals(np.concatenate(texts), np.array([len(t) for t in texts]))
    got = np.split(f * b / (1 + f * b), np.cumsum([len(t) for t in texts])[:-1])
    for codes, mine in zip(texts, got, strict=True):
        total, toxic = 0.0, np.zeros(len(codes))
        for path in itertools.product((0, 1), repeat=len(codes)):
            w = chain.start[path[0]] + sum(chain.emit[c] for c, s in zip(codes, path, strict=True) if s)
            w = math.exp(w + sum(chain.trans[x, y] for x, y in itertools.pairwise(path)))
            total += w
            toxic += w * np.array(path)
        assert mine == pytest.approx(toxic / total)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op4_toxicity(spark, sf).where("held_out").toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    hit = found[found["predicted"] == 1]
    assert hit["toxic"].mean() >= 0.95 and hit["toxic"].sum() / found["toxic"].sum() >= 0.9


def test_near_copies_below_the_threshold_of_a_hub(spark):
    """2,000 near copies of one text, few of which reach the smallest one, against all pairs."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(2_000):
        words = base.copy()
        for at in rng.sample(range(40), rng.randrange(0, 6)):
            words[at] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(frozenset(zip(w, w[1:], strict=False)), []).append(i)
    terms = {g: k for k, g in enumerate(sorted({g for s in sets for g in s}))}
    m = np.zeros((len(sets), len(terms)), dtype=np.float32)
    for k, s in enumerate(sets):
        m[k, [terms[g] for g in s]] = 1
    common, size = m @ m.T, m.sum(axis=1)
    near = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    ids = [min(v) for v in sets.values()]
    label = list(range(len(ids)))
    for start in range(len(ids)):
        todo = [start] if label[start] == start else []
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x]).tolist():
                if label[y] == y and y != start:
                    label[y] = start
                    todo.append(y)
    smallest = {}
    for k, root in enumerate(label):
        smallest[root] = min(smallest.get(root, 10**9), ids[k])
    expected = {i: smallest[label[k]] for k, v in enumerate(sets.values()) for i in v}
    assert got == expected


def test_chats_of_odd_turns(spark):
    rows = [
        (1, 0, "user", "hi", 5), (2, 0, "user", "hi", 5), (2, 0, "user", "hi", 5), (2, 1, None, None, 5),
        (3, 7, "user", "hi", 5), (None, 0, "user", "hi", 5), (None, 0, "user", "alone", 5), (None, 0, "user", "alone", 5),
        (4, 1, "b", "tie", 5), (4, 1, "a", "tie", 5), (5, 0, "user", "long " * 50_000, 5), (6, None, "user", "x", 5),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {(r["conv_id"], r["n_turns"]): r["rendered"] for r in chat.format_chats(turns).collect()}
    # 1, 3 and the lone "hi" are prefixes of 2; the two lone turns are equal, so one stays.
    assert set(got) == {(2, 3), (None, 1), (4, 2), (5, 1), (6, 1)}
    assert got[4, 2] == "<|im_start|>a\ntie<|im_end|>\n<|im_start|>b\ntie<|im_end|>\n" and "alone" in got[None, 1]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_warc_of_odd_pages(spark, tmp_path):
    rows = [(1, "u", "same", 1), (1, "u", "same", 1), (2, "u", "same", 1), (2, "u", "same", 1), (3, None, None, 1), (None, "u", "same", 1), (4, "u", "long " * 200_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write_pages(pages, str(tmp_path / "w"))
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.page_records(warc.read_archive(spark, str(tmp_path / "w"))).collect())
    assert got == [(0, "response", None, 4), (1, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "response", None, 0), (4, "response", None, 1_000_000)]
    assert base64.b32encode(hashlib.sha1(b"").digest()).decode() in {r["payload_digest"] for r in warc.page_records(warc.read_archive(spark, str(tmp_path / "w"))).collect()}
    assert html_text.extract(pages.limit(0)).count() == 0
