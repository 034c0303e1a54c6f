"""Trained operators: held-out accuracy, fold rules and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import hashed, language_id, quality, toxicity, url_filter
from cartolith.llm.queries import RULES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def many(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_of_held_out_documents(many):
    rows = language_id.identify(many).join(many, "doc_id").select("doc_id", "held_out", "lang_pred", "lang", "score").collect()
    assert len(rows) == many.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(many, odd, empty):
    model = language_id.train(many)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.predict(odd, model).collect()}
    assert {(3, "und", False), (4, "und", False), (5, "und", False), (10, "und", False)} <= got
    assert language_id.predict(odd, model).count() == odd.count()
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    kept = language_id.keep_known(odd.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == odd.columns and kept.count() == 9
    assert language_id.keep_known(empty).count() == 0
    assert language_id.keep_known(many).count() >= 0.98 * many.count()


def test_held_out_labels_teach_nothing(many, labels):
    lied = many.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = language_id.train(many), language_id.train(lied)
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.temperature == b.temperature
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(many, labels).at, toxicity.train(many, wrong).at)


def test_languages_in_several_blocks(many):
    """The path of very many languages on the given four: blocks of two and of one."""
    for size in (2, 1):
        model = language_id.train(many, block_languages=size)
        assert isinstance(model.table, language_id.Blocks)
        held = [r for r in language_id.predict(many, model).join(many, "doc_id").select("held_out", "lang_pred", "lang").collect() if r.held_out]
        assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_an_id_of_very_many_rows_does_not_fill_the_sample(many):
    hot = many.select(F.lit(3).cast("bigint").alias("doc_id"), "text", F.lit("en").alias("lang")).limit(200)
    hot = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("copy")
    rows, _ = language_id.per_class_sample(hot, "lang", 50, by=("doc_id", "text"))
    assert rows.dropDuplicates(["doc_id", "lang", "text"]).count() <= 100
    assert language_id.train(hot, per_language=50).languages == ["en"]


def test_every_language_is_learned(spark):
    """More languages than a block holds, the rarest with a few documents, each with words of its own."""
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for _ in range(130)]
    rows = [(int(k), " ".join(rng.choice(words[k], 40)), f"l{k:03}") for k in np.repeat(np.arange(130), np.where(np.arange(130) < 20, 60, 16))]
    docs = spark.createDataFrame([(n, text, lang) for n, (_, text, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == sorted({lang for *_, lang in rows})
    got = language_id.predict(docs, model).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    right = np.mean([r.lang_pred == r.lang for r in held])
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got} == set(model.languages)
    assert language_id.keep_known(docs).count() > 0.95 * len(rows)


def test_block_weights_add_up_as_a_table(monkeypatch):
    rng = np.random.default_rng(4)
    dense = rng.normal(0, 1, (5, 1 << language_id.BITS)) * (rng.random((5, 1 << language_id.BITS)) < 0.3)
    columns = [(np.flatnonzero(w), w[w != 0]) for w in dense]
    blocks = language_id.Blocks(3, columns, np.array([0, 1, 0]))
    table = dense[:3] - dense[[3, 4, 3]]
    texts = ["one two two three", None, "Four! five", "x" * 3000]
    whole = language_id.Model(["a", "b", "c"], table, np.zeros(3), 1.0).scores(texts)
    assert np.allclose(blocks.dense(), table)
    monkeypatch.setattr(language_id, "HELD", 7)
    model = language_id.Model(["a", "b", "c"], blocks, np.zeros(3), 1.0)
    assert np.allclose(whole, model.scores(texts))
    assert np.allclose(model.predict(texts)[1], [whole[0].max(), 0, whole[2].max(), whole[3].max()])


def _separates(rows, label):
    good, bad = ([r["score"] for r in rows if r[label] == k] for k in (1, 0))
    return np.mean([[g > b for b in bad] for g in good])


def test_toxicity(many, labels, odd, empty):
    model = toxicity.train(many, labels)
    rows = toxicity.score(many, model).join(labels, "doc_id").collect()
    assert _separates([r for r in rows if not r.held_out], "toxic") > 0.95 and _separates([r for r in rows if r.held_out], "toxic") > 0.6
    assert all(r.predicted == (r.score >= 0.5) for r in rows) and len(model.at) < 20_000
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert len({r.score for r in toxicity.score(odd, toxicity.train(many, labels.limit(0))).collect()}) == 1


def test_toxicity_counts_a_feature_once_across_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in rng.integers(0, 50, 3000))
    model = toxicity.Model(np.arange(1 << toxicity.BITS), rng.normal(0, 0.01, 1 << toxicity.BITS), 0.0)
    whole = model.scores([text, None, "", "a"])
    monkeypatch.setattr(hashed, "BLOCK_CHARS", 777)
    assert np.allclose(whole, model.scores([text, None, "", "a"])) and whole[1] == whole[2] == 0.5


def test_quality(many, labels, odd, empty):
    model = quality.train(many, labels)
    rows = quality.score(many, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95 and _separates(held, "quality") > 0.95
    assert quality.score(odd, model).count() == odd.count() and quality.score(empty, model).count() == 0
    plain = odd.select("doc_id", "text")
    assert all(0 <= r.score <= 1 for r in quality.score(plain, model).collect())


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    model = quality.Model(0.1, rng.normal(0, 0.1, quality.WIDTH), rng.normal(0, 0.3, (quality.RANK, quality.WIDTH)))
    texts, sizes = ["one two two three", "", None, "Four! five"], [None, 3, None, 9]
    row, at, x = quality.features(texts, sizes)
    for k, got in enumerate(model.scores(texts, sizes)):
        i = np.flatnonzero(row == k)
        pairs = sum(model.vectors[:, at[a]] @ model.vectors[:, at[b]] * x[a] * x[b] for n, a in enumerate(i) for b in i[:n])
        assert np.isclose(got, quality.sigmoid(np.array(0.1 + model.linear[at[i]] @ x[i] + pairs)))


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    texts = ["abc def" * 40, None, "", "x", "Ünïcödé wörds 12 " * 30]
    collect = lambda: sorted((int(r), int(f)) for rows, feats in hashed.char_grams(texts, (1, 2, 3), 16) for r, f in zip(rows, feats))
    whole = collect()
    monkeypatch.setattr(hashed, "BLOCK_CHARS", 17)
    assert collect() == whole and len(whole) == sum(max(0, len(t or "") - n + 1) for t in texts for n in (1, 2, 3))


def _judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


def test_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x?y#z", "a://b://c.net/es/", "x://net/fr/q", "x://notnet/fr/", "x://www.example.com/en/", "x://example.com?p=/en/", "x://ex\nample.com/a\nb?c", "x://É.COM/"]
    extra = spark.createDataFrame([(None if k == 3 else k, u, "x") for k, u in enumerate(odd * 2)], "page_id bigint, url string, bucket string")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(extra.select("page_id", "url"))
    got = url_filter.judge(pages, RULES).collect()
    want = sorted(map(str, ((r.page_id, *_judged(r.url)[:3]) for r in pages.collect())))
    assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in got) == want
    says = {h + p: v for v, h, p in RULES}
    assert all(r.verdict == says[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge(extra, RULES).count() == len(odd) * 2 and url_filter.judge(extra.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(extra.where("url IS NULL"), RULES).collect()} == {"allow"}


def test_url_trees_on_held_out_rules(spark):
    """Trees fitted on four folds of the URLs that rules decide, judged on the fifth, against the commoner verdict."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_filter.with_features(pages, RULES).withColumn("fold", url_filter.url_fold())
    model = url_filter.train(rows.where("fold <> 0"))
    held = rows.where("fold = 0 AND ruled IS NOT NULL")
    vectors = url_filter.VectorAssembler(inputCols=url_filter.FEATURES, outputCol="features").transform(held)
    got = model.transform(vectors).select("ruled", "prediction").collect()
    right = np.mean([(r.prediction == 1) == (r.ruled == "block") for r in got])
    share = np.mean([r.ruled == "block" for r in got])
    assert len(got) > 100 and right > 0.95 > max(share, 1 - share), (right, share)


def test_own_label_is_no_feature(spark):
    """With the labels of a fold turned round, the suffix statistics of that fold's URLs stay."""
    rows = [(k, f"http://www.s{k}.net/{'es' if k % 3 else 'xx'}/p{k}") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = [("block", "net", "/es/"), ("allow", "net", "/xx/")]
    base = {r.page_id: r for r in url_filter.with_features(pages, rules).withColumn("fold", url_filter.url_fold()).collect()}
    for fold in range(url_filter.FOLDS):
        others = [r for r in base.values() if r.fold != fold]
        want = (sum(r.ruled == "block" for r in others) + 1) / (len(others) + 2)
        assert all(np.isclose(r.suffix_share, want) for r in base.values() if r.fold == fold)
