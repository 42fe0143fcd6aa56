"""Every registered opN query as it is registered, on a small folder, against libraries or brute force."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathkit.llm import common, decontaminate, html_extract, language_id, queries, simhash_dedup, substring_dedup, token_counts, token_shards, warc_store, word_table_bpe
from swathkit.llm.elias_fano import EliasFano
from tests.llm.test_operators import brute_repeats, connected, edit_search, plain_simhash
from tests.llm.test_pipeline import words

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents, pages and benchmark of the smallest data with odd rows added; three files a table."""
    root = f"file://{tmp_path_factory.mktemp('sf')}"
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_text = words(rng, 4000)
    items = [(1, words(rng, 30)), (2, words(rng, 12)), (3, "brief item"), (4, None), (5, "!!")]
    odd = [
        (90001, None), (90002, ""), (90003, " \t\n"), (90004, "12 3.5 !!"), (90005, "É́ 　 日本 😀 don't WE'LL 'tis<|endoftext|>x"), (90006, long_text),
        (90007, long_text[:9000] + " tail"), (90008, "x" * 5000), (90009, "pre " + items[0][1].upper() + " post"), (90010, "a brief, item!"), (90011, "abrief item"),
    ]
    extra = spark.createDataFrame([(i, t, None, "odd", len(t or "")) for i, t in odd], docs.schema)
    docs.unionByName(extra).repartition(3, "doc_id").write.parquet(f"{root}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = spark.createDataFrame([(90001, None, None), (90002, "u", ""), (90003, "http://x/y", "<p>é &amp; <b>b</b>"), (90004, "u", "<p>é &amp; <b>b</b>")], pages.schema)
    pages.unionByName(more).repartition(3, "page_id").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture
def small(monkeypatch):
    """Sizes so small that several blocks, partitions, chunks and shards occur."""
    monkeypatch.setattr(token_shards, "PARTITION_BYTES", 60_000)
    monkeypatch.setattr(token_shards, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(word_table_bpe, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(word_table_bpe, "LEAST_PARTS", 5)
    monkeypatch.setattr(substring_dedup, "LEAST_SHARDS", 7)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)


def whole(t):
    return t or ""


def plain_language(rows, max_size=5):
    """Word-first backoff with dictionaries, from the rows that may be learned from."""
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and t and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(re.findall(r"[^\W\d_]+", t.lower()))
    langs = sorted(counts)
    tables = {0: counts}
    for n in range(1, max_size + 1):
        tables[n] = defaultdict(Counter)
        for lang in langs:
            for w, c in counts[lang].items():
                m = f"\1{w}\1"
                for k in range(len(m) - n + 1):
                    tables[n][lang][m[k : k + n]] += c
    keys = {n: {k for lang in langs for k in tables[n][lang]} for n in tables}
    sums = {(n, lang): sum(tables[n][lang].values()) for n in tables for lang in langs}

    def log(n, key, lang):
        return math.log((tables[n][lang][key] + 0.5) / (sums[n, lang] + 0.5 * len(keys[n])))

    def score(word):
        if word in keys[0]:
            return [log(0, word, x) for x in langs]
        m = f"\1{word}\1"
        for n in range(max_size, 0, -1):
            known = [g for k in range(len(m) - n + 1) if (g := m[k : k + n]) in keys[n]]
            if known:
                return [sum(log(n, g, x) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    def predict(text):
        found = re.findall(r"[^\W\d_]+", whole(text).lower())
        if not found:
            return "und", 0.0
        cache = {w: score(w) for w in set(found)}
        mean = [sum(cache[w][k] for w in found) / len(found) for k in range(len(langs))]
        top = max(mean)
        return langs[mean.index(top)], 1 / sum(math.exp(x - top) for x in mean)

    return predict


def test_op1_against_plain_backoff(spark, folder):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.doc_id != 90005]  # no marks outside \p{L}
    predict = plain_language(rows)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, folder).collect()}
    for i, t, _ in rows:
        lang, score = predict(t)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3, i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_op1_sample_bound():
    for total in (10**5, 10**11, 4 * 10**13):
        share = (language_id.hash_bound(20_000, total) + (1 << 63)) / (1 << 64)
        assert abs(share * total - 20_000) < 1
    assert language_id.hash_bound(5, 5) == (1 << 63) - 1


def test_op1_learns_rare_languages_and_null_ids(spark):
    rows = [(None, "der die das und", "de")] * 3 + [(k, "the of and to", "en") for k in range(3000)] + [(5, "chat noir", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, max_rows=50)
    assert model.langs == ["de", "en"]
    tie = language_id.build([("b", "same", 2), ("a", "same", 2)])
    assert language_id.predict(spark.createDataFrame([(1, "same")], "doc_id long, text string"), tie).first()["lang_pred"] == "a"


def test_op2_against_library(spark, folder, texts, library, small):
    got = {r.doc_id: r for r in queries.op2_token_shards(spark, folder).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array([*library.encode(whole(texts[i]), add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


@pytest.mark.parametrize("n,universe", [(1, 0), (5, 3), (300, 10**9), (64, 64), (500, 900)])
def test_op2_select_many(n, universe):
    v = np.sort(np.random.default_rng(n).integers(0, universe + 1, n))
    ef = EliasFano.encode(v, universe)
    which = np.random.default_rng(1).integers(0, n, 40)
    assert (ef.select_many(which) == v[which]).all() and (ef.select_many(np.arange(n)) == v).all()
    with pytest.raises(IndexError):
        ef.select_many(np.array([n]))


def test_op3_against_plain_records(spark, folder):
    pages = [(r.page_id, whole(r.html).encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    first = {}
    for i, raw in sorted(pages):
        first.setdefault(raw, i)
    got = {r.page_id: r for r in queries.op3_warc_store(spark, folder).collect()}
    assert len(got) == len(pages)
    for i, raw in pages:
        r = got[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[raw] == i else ("revisit", first[raw]))


def test_op4_against_brute_force(spark, folder, texts, small):
    got = {(r.doc_id, r.item_id): r for r in queries.op4_decontaminate(spark, folder).collect()}
    assert {(90009, 1), (90010, 3)} <= set(got) and (90011, 3) not in got
    items = {r.item_id: decontaminate.normalize(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    ids = random.Random(1).sample(sorted(texts), 25) + list(range(90001, 90012))
    for i in ids:
        t = decontaminate.normalize(texts[i])[:3000] if i < 90000 else decontaminate.normalize(texts[i])
        for k, p in items.items():
            if not p:
                hit = None
            elif len(p) < decontaminate.MIN_CHARS:
                hit = 0 if f" {p} " in f" {t} " else None
            else:
                d, _ = edit_search(p, t) if len(t) < 4000 else (99, 0)
                hit = d if d <= int(len(p) * decontaminate.ERROR_RATE) else None
            if len(t) < 3000 or i >= 90000:
                assert (got[i, k].distance if (i, k) in got else None) == hit
    for (i, k), r in got.items():
        found = decontaminate.normalize(texts[i])[r.match_start : r.match_end]
        assert edit_search(items[k], found)[0] == r.distance and abs(len(found) - len(items[k])) <= r.distance


def test_op5_against_library(spark, folder, texts, library):
    for r in queries.op5_token_counts(spark, folder).collect():
        n = len(library.encode(whole(texts[r.doc_id]), add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(whole(texts[r.doc_id]).encode()), n, n > 512)


@pytest.mark.parametrize("block_bytes", [8 << 20, 3000])
def test_op6_against_brute_force(spark, folder, texts, small, monkeypatch, block_bytes):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block_bytes)
    got = {str(r.doc_id): r for r in queries.op6_suffix_dedup(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, n, spans, kept in brute_repeats(list(texts.items()), 50):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op7_against_brute_force(spark, folder, texts):
    fp = {i: plain_simhash(t) for i, t in texts.items()}
    ids = sorted(fp)
    want = connected(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in queries.op7_simhash_dedup(spark, folder).collect()}
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (fp[i], want[i]) for i in ids}


def test_op7_hot_shard_is_cut(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = set()
    for _ in range(300):  # all agree in 40 bits: one shard of every choice among those bits
        v = base
        for b in rng.sample(range(24), rng.randint(1, 6)):
            v ^= 1 << b
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = common.materialize(spark.createDataFrame([(v,) for v in signed], "fp long"), "t")
    links = [(r.u, r.v) for r in simhash_dedup.link(table, split=16).collect()]
    near = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert connected(signed, links) == connected(signed, near)


def test_op8_against_library(spark, folder, texts, library, small):
    got = {r.doc_id: r for r in queries.op8_bpe_round_trip(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = library.encode(whole(t), add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_op9_digests(spark, folder, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, folder).collect()}
    assert len(got) == len(ids)
    by_text = defaultdict(set)
    for k, i in enumerate(ids):
        t, after = whole(texts[i]), whole(texts[ids[(k + 1) % len(ids)]])
        cut = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def plain_article(page):
    """Another extractor, for pages of the one layout of the test data: headings and paragraphs of <article>."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not found:
        return None
    blocks = re.split(r"</?(?:p|h1|div|ul|li|blockquote|section|figure|figcaption|h2|table|tr|td|pre)\b[^>]*>", found[1])
    lines = (" ".join(entities.unescape(re.sub(r"<br\s*/?>", " ", re.sub(r"</?(?:b|i|em|a|span|strong)\b[^>]*>", "", x))).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def test_op10_against_plain_extractor(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op10_html_text(spark, folder).collect()}
    assert len(got) == len(pages)
    same = [got[i].text == plain_article(h) for i, h in pages.items() if plain_article(h) is not None]
    assert len(same) > 20 and sum(same) == len(same)
    assert got[90001].text == got[90002].text == "" and got[90003].text == got[90004].text == "é & b"
    assert all(r.n_chars == len(r.text) for r in got.values())


P = "<p>" + "words of the article go on and on. " * 5 + "</p>"


@pytest.mark.parametrize(
    "source,n_blocks",
    [
        (f"<div class='layout has-sidebar'><article>{P}</article><div class='sidebar'>{P}</div></div>", 1),
        (f"<div class='main no-ads'>{P}</div>", 1),
        (f"<div id='page-with-nav'>{P}</div>", 1),
        (f"<form id='aspnetForm'>{P}{P}</form>", 2),
        (f"<div><section>{P * 10}</section><section class=b>{P * 3}</section><section class=c>{P * 2}</section></div>", 15),
        ("<p><a href=x>all of it is a link</a></p>", 1),
        (f"<article><header class='entry-header'><h1>Head</h1></header>{P}<footer>tags</footer></article>", 2),
        (f"<div class=post>{P * 3}</div><div id=comments><article>{P * 8}</article></div>", 3),
        (f"<nav><ul>{'<li><a href=x>item</a>' * 9}</ul></nav>", 0),
        ("<p>a < b and 5 > 3 <em>x</em></p><p title='a > b'>next</p>", 2),
    ],
)
def test_op10_odd_layouts(source, n_blocks):
    text = html_extract.Page(source).extract(None)
    assert (text.count("\n") + 1 if text else 0) == n_blocks


@pytest.mark.parametrize("piece", ["<a ", "<b>", "<div>", "<a b='", '<a b="x>', "</p>", "<", '<a b="">', "<!--", "<script>", "<li><p>"])
def test_op10_time_is_linear(piece):
    source = piece * (400_000 // len(piece))
    began = time.process_time()
    html_extract.Page(source).extract(None)
    assert time.process_time() - began < 6


def test_queries_on_empty_tables(spark, folder, tmp_path):
    root = f"file://{tmp_path}/empty"
    for name in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    for name, run in queries.QUERIES.items():
        assert run(spark, root).count() == 0, name


def test_clashing_columns(spark):
    names = ("text_hash", "rid", "tid", "root", "token", "block", "payload", "host", "path", "score", "i", "t", "u", "v")
    df = spark.createDataFrame([(1, "one two three four five six", "<p>x</p>"), (2, None, None)], "doc_id long, text string, html string")
    df = df.withColumns({c: F.lit("clash") for c in names}).withColumn("lang", F.lit("en"))
    assert language_id.annotate(df, language_id.train(df)).count() == 2
    assert decontaminate.mark_leaks(df, spark.createDataFrame([(1, "two three four five")], "item_id long, text string")).where("size(leaks) = 1").count() == 1
    assert substring_dedup.remove_repeats(df, carry=names).count() == 2 and word_table_bpe.encode_decode(df, PATH).count() == 2
    assert simhash_dedup.near_duplicates(df).count() == 2


def test_clashing_columns_of_writers_and_readers(spark, tmp_path):
    names = ("n_tokens", "n_bytes", "start", "ids", "chunk", "block", "payload", "record", "page", "host", "path", "score", "cut", "votes", "term", "part", "class", "train", "item", "rank")
    df = spark.createDataFrame([(1, 1, "http://h/x", "one two three", "<p>one two three</p>"), (2, None, None, None, None)], "doc_id long, page_id long, url string, text string, html string")
    df = df.withColumns({c: F.lit("clash") for c in names}).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert sorted(r.n_tokens for r in token_counts.count_tokens(df, PATH).collect()) == [0, 3]
    token_shards.write_token_shards(df, f"file://{tmp_path}/ids", PATH)
    assert sorted(r.n_tokens for r in token_shards.read_token_shards(spark, f"file://{tmp_path}/ids").collect()) == [1, 4]
    warc_store.write_archive(df, f"file://{tmp_path}/warc")
    assert sorted(r.payload_bytes for r in warc_store.read_records(spark, f"file://{tmp_path}/warc").collect()) == [0, 20]
    assert sorted(r.text for r in html_extract.extract(df).collect()) == ["", "one two three"]
