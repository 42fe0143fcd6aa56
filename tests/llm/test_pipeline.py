"""The corpus pipeline stage by stage on planted cases, and whole on the smallest data."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from swathkit.llm import decontaminate
from tests.llm.test_operators import brute_repeats, connected, plain_simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_rejects_only_what_has_no_language(spark, docs):
    kept = corpus_pipeline.language(spark, docs.unionByName(frame(spark, [(9001, "123 456 !!"), (9002, None), (9003, "")])), SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fp = {i: plain_simhash(t) for i, t in rows}
    ids = sorted(fp)
    groups = connected(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    kept = corpus_pipeline.near_dedup(spark, docs.unionByName(docs.limit(20)), SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))


def test_language_rejects_texts_of_no_learned_language(spark, docs):
    strange = frame(spark, [(9100, "γνωστά κείμενα άλλης γλώσσας"), (9101, "日本語 の 文章"), (9102, "ξ" * 40)]).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(strange), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_language_without_labels_keeps_texts_with_letters(spark):
    rows = frame(spark, [(1, "some words"), (2, "123 !!"), (3, None), (4, ""), (5, "é")]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, rows, SF).collect()} == {1, 5}
    one = frame(spark, [(1, "some words"), (2, "123 !!")])
    assert {r.doc_id for r in corpus_pipeline.language(spark, one, SF).collect()} == {1}


def test_near_dedup_loses_no_text(spark):
    rng = random.Random(6)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, a), (7, b + " more"), (8, d), (8, d), (3, None), (4, "")]
    extra = frame(spark, rows).withColumn("text_hash", F.lit("clash")).repartition(4)
    for _ in range(2):  # the same on every run
        got = sorted((str(r.doc_id), r.text or "") for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, extra, SF).collect())
        assert got == sorted([("1", a), ("1", b), ("None", c), ("8", d), ("3", "")])


def test_suffix_dedup_cuts_later_copies(spark):
    rng = random.Random(2)
    passage = words(rng, 60)
    rows = [(1, words(rng, 20) + passage), (2, words(rng, 30)), (3, words(rng, 5) + passage + words(rng, 5)), (4, passage), (5, "é" * 60), (6, "ab" + "é" * 60)]
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, frame(spark, rows), SF).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and passage not in got[3] and 4 not in got and got[6] == "ab"
    assert got[3] == next(x[3] for x in brute_repeats(rows, 50) if x[0] == "3").decode()


def test_benchmark_clean(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, "clean words here"), (2, "before " + item + " after"), (3, item.upper().replace(",", " ")), (4, None)]
    got = {r.doc_id for r in corpus_pipeline.benchmark_clean(spark, frame(spark, rows), SF).collect()}
    assert got == {1, 4} and decontaminate.normalize(item)


def test_whole_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len({r.doc_id for r in out}) > 0.5 * len(texts)
    assert all(r.n_tokens == len(r.ids) and r.text for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "suffix_dedup", "benchmark_clean", "encode"]


def test_empty_input(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
