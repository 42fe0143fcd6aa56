"""Near copies of the pipeline against all pairs by brute force."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from swathkit.llm import common, near_copies
from tests.llm.test_operators import connected
from tests.llm.test_pipeline import SF, frame, words


def shingles(text):
    w = [x for x in re.split("[ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def survivors(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[k + 1 :] if 5 * len(s & t) >= 4 * len(s | t)]
    return sorted(set(connected([i for i, _ in rows], links).values())), len(links)


def stage(spark, rows):
    return sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, rows), SF).collect())


def test_stage_finds_all_similar_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, links = survivors(rows)
    assert links > 12 and stage(spark, rows) == want


def test_stage_on_edited_copies(spark):
    rng = random.Random(8)
    rows, line = [], words(rng, 12)
    for size in (1, 4, 5, 6, 9, 30, 200):
        base = words(rng, size).split()
        for edits in (0, 0, 1, 2, 3, 4, 6):
            text = list(base)
            for k in rng.sample(range(size), min(edits, size)):
                text[k] = words(rng, 1)
            rows.append((len(rows), " ".join(text)))
    base = words(rng, 120).split()
    for _ in range(40):  # a chain: neighbours are similar, ends are not
        base[rng.randrange(120)] = words(rng, 1)
        rows.append((len(rows), " ".join(base)))
    rows += [(len(rows) + k, line + " " + words(rng, 20)) for k in range(60)]  # a common line, else unlike
    rng.shuffle(rows)
    assert stage(spark, rows) == survivors(rows)[0]


def test_bound_itself_is_similar(spark):
    a = words(random.Random(3), 13).split()  # nine shingles; eight of ten with one word at the end replaced
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "qqq"])), (3, " ".join([*a[:-2], "qqq", "qq"]))]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) * 5 == 4 * len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert stage(spark, rows) == survivors(rows)[0]


def edited(seed=8):
    rng = random.Random(seed)
    base = words(rng, 60).split()
    rows = []
    for k in range(90):
        text = list(base)
        for j in rng.sample(range(60), k % 5):
            text[j] = words(rng, 1)
        rows.append((len(rows), " ".join(text + words(rng, k % 7 * 9).split())))
    rng.shuffle(rows)
    return rows


def test_different_texts_of_one_hash_stay(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    rows = [*edited(), (900, "quite another text, of eight words at least"), (901, None), (902, "x")]
    assert stage(spark, rows) == survivors(rows)[0]


def test_hot_tokens_are_cut(spark, monkeypatch):
    """Every token cut into pieces, and every pair met through cells alone."""
    rows = edited(5)
    monkeypatch.setattr(near_copies, "HOT", 3)
    monkeypatch.setattr(near_copies, "CELL", 2)
    monkeypatch.setattr(near_copies, "first_pairs", lambda nodes, radius: nodes.select(F.col("tid").alias("u"), F.col("tid").alias("v")).limit(0))
    assert stage(spark, rows) == survivors(rows)[0]


def test_cells_hold_every_pair_once_and_no_whole_token(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 50)
    monkeypatch.setattr(near_copies, "CELL", 20)
    rng = random.Random(4)
    sizes = [rng.randrange(40, 200) for _ in range(600)]
    kind = "token long, tid long, root long, n int, pos int, many boolean"
    frame = spark.createDataFrame([(7, k, k, n, 0, True) for k, n in enumerate(sizes)] + [(8, k, k, 90, 0, True) for k in range(30)], kind)
    got = near_copies.cells(frame)
    assert max(r["count"] for r in got.where("token = 7").groupBy("low", "a", "b").count().collect()) < 90
    assert got.where("token = 8").count() == 30
    rows = np.array([[r[c] for c in near_copies.MET] for r in got.where("token = 7").collect()], np.int64)
    pairs = [tuple(p) for found in near_copies.bucket_pairs(rows) for p in found.tolist()]
    want = {(u, v) for u in range(600) for v in range(u + 1, 600) if 5 * min(sizes[u], sizes[v]) >= 4 * max(sizes[u], sizes[v])}
    assert set(pairs) == want and len(pairs) == len(want)


def test_counts_are_added_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FAN", 3)
    rows = [(t, r, bytearray(common.squeeze(np.full(near_copies.RANGE, t + r, np.uint32)))) for t in range(20) for r in range(2)]
    got = near_copies.slot_counts(spark.createDataFrame(rows, "task long, range long, seen binary"))
    assert got[0] == sum(range(20)) and got[near_copies.RANGE] == sum(range(20)) + 20 and not got[2 * near_copies.RANGE :].any()


def test_columns_of_the_same_names(spark):
    """Columns of the caller that bear the names used inside come back unchanged."""
    got = near_copies.keep_first(spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "a b", 5, 6, 7)], "doc_id long, text string, _rid long, _also long, tid long"))
    assert [tuple(r) for r in got.collect()] == [(1, "a b", 5, 6, 7)]
