"""Every operator on nulls, empty and long texts, repeated rows, extra columns and empty tables."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontaminate, languages, licenses, lm, mixing, neardup, secrets, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, size int, _id int, score double"
LONG = " ".join(f"word{i % 977} von der" for i in range(30_000))
ROWS = [
    (None, "some text here", "en", "a", 1),
    (None, None, None, None, None),
    (1, "", "en", None, 0),
    (2, "   \t\n ", "en", "a", 3),
    (3, "the quick brown fox jumps over the lazy dog", "en", "a", 4),
    (3, "the quick brown fox jumps over the lazy dog", "en", "a", 4),
    (4, "the quick brown fox jumps over the lazy dog", None, "b", 4),
    (5, LONG, "de", "b", 5),
    (6, "123 456 --- !!", "de", "", 6),
    (7, 'password = "hunter2hunter2"', "en", "c", 7),
    (8, "Released under the MIT License.", "en", "c", 8),
    (9, "x", None, "c", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 11, "k", 12, 13, 0.5) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, " "), (None, "zz")]
    return spark.createDataFrame(items, "item_id long, text string")


def operators(labels, benchmark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return {
        "mix": mixing.mix_digest,
        "languages": languages.language_digest,
        "tokens": lambda d: tokens.count_tokens(d, path),
        "secrets": secrets.secret_digest,
        "near copies": neardup.similar_groups,
        "lm": lm.lm_digest,
        "toxicity": lambda d: toxicity.toxicity_digest(d, labels),
    }


NAMES = ["mix", "languages", "tokens", "secrets", "near copies", "lm", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_document(docs, labels, benchmark, name):
    run = operators(labels, benchmark)[name]
    assert run(docs).count() == len(ROWS)
    assert run(docs.limit(0)).count() == 0


def test_tokens(docs, spark):
    found = {r.doc_id: r for r in tokens.count_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json"))).collect()}
    assert (found[1].n_bytes, found[1].n_tokens, found[2].n_tokens) == (0, 0, 0)
    assert found[5].over_limit and not found[9].over_limit


def test_languages(docs):
    found = {r.doc_id: r for r in languages.language_digest(docs).collect()}
    assert {found[k].lang_pred for k in (1, 2, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found.values())


def test_secrets(docs):
    found = {r.doc_id: r for r in secrets.secret_digest(docs).collect()}
    assert found[7].n_assign == 1 and found[7].spans == "assign:0:26"
    assert found[1].spans == "" and found[1].base_sha256.startswith("e3b0c442")


def test_near_copies(docs):
    rows = neardup.similar_groups(docs).collect()
    found = {r.doc_id: r for r in rows}
    assert found[4].component_id == 3 and not found[4].kept and found[3].kept
    assert found[1].n_shingles == found[2].n_shingles == 0 and found[2].component_id == 2
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)


def test_mix(docs):
    rows = mixing.mix_sources(docs).collect()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert sum(r["size"] for r in rows if r.source == "b") == next(r.source_size for r in rows if r.source == "b")


def test_lm(docs):
    found = {r.doc_id: r for r in lm.lm_digest(docs).collect()}
    assert found[1].n_tokens == found[2].n_tokens == 1
    assert all(r.score <= 0 and r.base_score <= 0 for r in found.values())


def test_toxicity_without_both_classes(docs, labels):
    scores = {r.score for r in toxicity.toxicity_digest(docs, labels.where("toxic = 0")).collect()}
    assert scores == {0.0}


def test_leaks(docs, benchmark):
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(3, 1), (4, 1)} and all(r.item_id == 1 for r in found)
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


def test_licenses(docs):
    assert [(r.doc_id, r.license) for r in licenses.find_licenses(docs).collect()] == [(8, "MIT")]
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0]), (100, [2.0, 1.0]), (1, None), (2, [float("nan")]), (3, []), (None, [1.0]), (4, [None, 1.0]), (5, [float("inf")])]
    found = topk.topk_digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(found) == 6 and {r.vec_id for r in found} == {0, 100}
    assert topk.topk_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_stages_keep_columns(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            assert out.where("row <> 11 OR key <> 'k' OR score <> 0.5 OR _id <> 13").isEmpty()
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.isEmpty()
    kept = {r.doc_id for r in neardup.drop_near_copies(docs).collect()}
    assert 4 not in kept and neardup.drop_near_copies(docs).where("doc_id = 3").count() == 1
    text = secrets.redact_secrets(docs).where(F.col("doc_id") == 7).first()
    assert text.text == '<secret>"' and text.n_chars == len(text.text)


def test_vectors_of_any_finite_size(spark):
    """Products beyond a double and scores beyond a long."""
    rows = [(0, [1e308, 1.0]), (1, [1e308, 2.0]), (2, [-1e308, 3.0]), (3, [0.5, 1.7e308]), (4, [0.25, 1.0])]
    found = topk.topk_digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    limits = 2**63 - 1, -(2**63)
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(1, limits[0]), (3, limits[0]), (4, limits[0]), (2, limits[1])]


def test_a_repeated_id_does_not_fill_the_driver(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("if(id < 2500, 7, id) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(3000).selectExpr("if(id < 2500, 7, id) AS doc_id", "cast(if(id < 2500, 1, id % 2) AS int) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((len(texts), sum(toxic))) or 0.0)
    toxicity.fit_toxicity(docs, labels, rows=5000)
    toxicity.fit_toxicity(docs, labels, rows=40)
    assert seen[0] == (3000, 2750) and seen[1][0] <= 160 and seen[1][1] <= 80


def test_an_index_in_parts_finds_the_same(spark, monkeypatch):
    draw = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(8, 30)))) for i in range(40)]
    texts = [" ".join(draw.choices(words, k=80) + (draw.choice(items)[1].split() if i % 3 else []) + draw.choices(words, k=50)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
        rows = decontaminate.find_leaks(docs, bench).withColumn("score", F.round("score", 9)).collect()
        return sorted(map(tuple, rows)), kept

    one = found()
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 200)
    assert len(list(decontaminate.indexes(bench))) > 2 and found() == one
    assert one[1] == set(range(60)) - {r[0] for r in one[0]} and len(one[0]) >= 40
