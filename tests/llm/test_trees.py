"""Keys that very many blocks hold are merged before they meet: the same results over several levels."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from swathkit.llm import common, substring_dedup, word_table_bpe
from tests.llm.test_operators import PATH, brute_repeats, text_of


def rows_of(seed):
    rng = random.Random(seed)
    words = ["ab", "the", "one", "é", "x", " qq", "lorem", "ipsum", "zz9", "\n", "3.5"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(30) for _ in range(4)]
    rows = [(i * 3, text(rng.randint(0, 40)) + rng.choice(passages) + text(5)) for i in range(60)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (9, rows[3][1]), (9, "x" * 2000), (12, "x" * 300), (1000, None), (1001, ""), (-5, "x" * 60)]
    rows += [(2000 + i, passages[1] + str(i) + passages[2]) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fan,hot", [(12, 64), (5, 2), (5, 64)])
def test_repeats(spark, monkeypatch, fan, hot):
    monkeypatch.setattr(common, "FAN", fan)
    rows = rows_of(fan)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(df, 50, 500, hot).collect()
    assert sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows, 50)


def test_words(spark, monkeypatch):
    library = Tokenizer.from_file(PATH)
    monkeypatch.setattr(common, "FAN", 5)
    monkeypatch.setattr(word_table_bpe, "BLOCK_BYTES", 500)
    rows = rows_of(1)
    out = word_table_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH)
    got = sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in out.collect())
    assert got == sorted((str(i), tuple(library.encode(text_of(t), add_special_tokens=False).ids), text_of(t)) for i, t in rows)


def test_merged_lists_do_not_depend_on_order():
    rows = [bytes([k]) * 60 for k in (7, 3, 9, 3)]
    runs = [common.squeeze(np.array([len(x)], np.uint32), np.array([k], np.int64), x) for k, x in enumerate(rows)]
    assert substring_dedup.merge_runs(runs) == substring_dedup.merge_runs(runs[::-1])
    sent = substring_dedup.judge_runs([substring_dedup.merge_runs(runs)], 50)[0]
    got = [common.expand(x, bool)[0].tolist() for x in substring_dedup.spread_runs(runs, sent, 50)]
    assert got == [[False] * 11, [False] * 11, [False] * 11, [True] * 11]  # the last one stands in document 1
