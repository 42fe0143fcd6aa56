"""The training-data operators on small frames, against brute force, with nulls, ties, long texts and empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathkit.llm import common, decontaminate, fingerprints, html_extract, language_id, queries, simhash_dedup, substring_dedup, suffix_array, token_counts, token_shards, warc_store, word_table_bpe
from swathkit.llm.components import components
from swathkit.llm.elias_fano import EliasFano

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empties, repeats, ties, a long text and columns with clashing names."""
    texts = [None, "", " ", "a", "the cat's  \n\n sat<|endoftext|>x", "É́ 　 日本 😀 don't WE'LL 'tis", "word " * 30000, "12 3.5, x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "no id"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = {c: F.lit("x") for c in ("payload", "block", "n_tokens", "score", "fp", "leaks", "ids", "start", "lang_pred")}
    return df.withColumns(clash).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def text_of(t):
    return t or ""


# --- pretokens, counts, ids -------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abstrevdlm'’  \n\t12é日.,!😀")), max_size=30), min_size=1, max_size=5))
def test_pretokens_encode_like_the_library(texts):
    tokenizer = Tokenizer.from_file(PATH) if not hasattr(test_pretokens_encode_like_the_library, "t") else test_pretokens_encode_like_the_library.t
    test_pretokens_encode_like_the_library.t = tokenizer
    counter = token_counts.counter(PATH)
    data, offsets = common.buffer_of(texts)
    words, index, first = common.words_of(data, offsets, counter.specials)
    words = words.to_pylist()
    for k, text in enumerate(texts):
        own = [words[i] for i in index[first[k] : first[k + 1]]]
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert [i for w in own for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids] == want
        assert sum(map(counter.of, own)) == len(want)


def test_token_counts(odd_docs, empty_docs, library):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd_docs, PATH).collect())
    want = []
    for r in odd_docs.collect():
        n = len(library.encode(text_of(r.text), add_special_tokens=False).ids)
        want.append((str(r.doc_id), len(text_of(r.text).encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.count_tokens(empty_docs, PATH).count() == 0


@pytest.mark.parametrize("n,universe", [(0, 0), (1, 0), (5, 3), (300, 10**6), (64, 64), (129, 5000)])
def test_elias_fano(n, universe):
    v = np.sort(np.random.default_rng(n).integers(0, universe + 1, n))
    ef = EliasFano.encode(v, universe)
    assert (ef.values() == v).all() and [ef.select(i) for i in range(n)] == v.tolist()
    if n:
        assert len(ef.low) + len(ef.high) <= (n * (3 + max(0, (universe // n).bit_length())) + universe // max(n, 1)) / 8 + 16


def test_token_shards(spark, odd_docs, empty_docs, library):
    path = common.shared_path(spark, "t")
    token_shards.write_token_shards(odd_docs, path, PATH)
    got = token_shards.read_token_shards(spark, path).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at, sums = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        sums.append((str(r.doc_id), r.n_tokens, r.ids_crc32))
    want = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text_of(text), add_special_tokens=False).ids, 0], "<u4")
        want.append((str(doc_id), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(sums) == sorted(want)
    ids = {r.doc_id: r.ids for r in token_shards.read_ids(spark, path).where("doc_id = 7").collect()}
    assert ids[7][:-1] == library.encode("12 3.5, x", add_special_tokens=False).ids
    path = common.shared_path(spark, "t")
    token_shards.write_token_shards(empty_docs, path, PATH)
    assert token_shards.read_token_shards(spark, path).count() == 0


def test_bpe_round_trip(odd_docs, empty_docs, library):
    out = word_table_bpe.encode_decode(odd_docs, PATH)
    got = sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in out.collect())
    want = sorted((str(r.doc_id), tuple(library.encode(text_of(r.text), add_special_tokens=False).ids), text_of(r.text)) for r in odd_docs.collect())
    assert got == want
    again = word_table_bpe.decode_ids(out, PATH)
    assert sorted(r.decoded for r in again.collect()) == sorted(w[2] for w in want)
    assert word_table_bpe.encode_decode(empty_docs, PATH).count() == 0


# --- language ---------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    out = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 0
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, odd_docs, empty_docs):
    model = language_id.build([("en", "the", 9), ("en", "cat", 3), ("fr", "les", 9), ("fr", "chats", 3)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd_docs.where("doc_id is not null"), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[4][0] == "en"
    texts = spark.createDataFrame([(1, "THE catz"), (2, "chatsy"), (3, "123 !")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(texts, model).orderBy("doc_id").collect()] == ["en", "fr", "und"]
    nothing = language_id.train(empty_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty_docs, model).count() == 0
    assert set(language_id.annotate(odd_docs, model).columns) == {*odd_docs.columns}


# --- archive ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 2])
def test_warc_round_trip(spark, least):
    rows = [(5, "http://h/a", "x"), (2, "u", "x"), (2, "u", "x"), (None, None, "x"), (9, "v", None), (8, "w\r\nX: 1", ""), (1, "é", "long é"), (3, "z", "long é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = common.shared_path(spark, "w")
    warc_store.write_archive(pages, path, least)
    got = warc_store.read_records(spark, path).collect()
    last = float("inf")
    best = {}
    for i, _, h in rows:
        best[text_of(h)] = min(best.get(text_of(h), last), last if i is None else i)
    want = []
    for i, _, h in rows:
        raw = text_of(h).encode()
        revisit = len(raw) >= least and (last if i is None else i) != best[text_of(h)]
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", str(best[text_of(h)] if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    for r in got:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body.endswith(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(body) == n + 4 and (r.record_type == "revisit" or body[:n] == bytes(r.payload))
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    empty = common.shared_path(spark, "w")
    warc_store.write_archive(pages.limit(0), empty)
    assert warc_store.read_records(spark, empty).count() == 0


def test_warc_refuses_changed_payloads(spark):
    path = common.shared_path(spark, "w")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="does not match"):
        warc_store.read_records(spark, f"{path}-bad").collect()


# --- benchmark --------------------------------------------------------------------------------------------------


def edit_search(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=10), st.text("abc", max_size=16))
def test_myers(p, t):
    assert decontaminate.myers(p, t) == edit_search(p, t)


def test_leaks_against_brute_force(spark, odd_docs, empty_docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(12))) for k in range(6)] + [(6, None), (7, "short"), (8, "")]

    def spoil(text, n):
        chars = list(text)
        for _ in range(n):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        return "".join(chars)

    docs = [(i, " ".join(word() for _ in range(20)) + " " + spoil(items[i % 6][1], i % 9).upper() + ", " + word()) for i in range(48)]
    d = spark.createDataFrame([*docs, (None, items[0][1]), (99, None)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(d, b).collect()}
    want = {}
    for i, t in [*docs, (None, items[0][1])]:
        for k, x in items[:6]:
            p = decontaminate.normalize(x)
            dist, _ = edit_search(p, decontaminate.normalize(t))
            if dist <= int(len(p) * decontaminate.ERROR_RATE):
                want[i, k] = dist
    assert got == want and len(want) > 20
    assert decontaminate.find_leaks(odd_docs, b.limit(0)).count() == 0 and decontaminate.find_leaks(empty_docs, b).count() == 0
    assert decontaminate.mark_leaks(odd_docs, b).where("size(leaks) > 0").count() == 0


def test_shared_openings_cost_nothing_and_lose_nothing(spark, monkeypatch):
    """Items of one template: what all of them share is not searched, and matches equal those of brute force."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(3, 8)))
    opening = "answer the following question with one of the choices below "
    items = [(k, opening + " ".join(word() for _ in range(9))) for k in range(60)] + [(100 + k, opening + word()) for k in range(20)] + [(200 + k, "one short text") for k in range(20)]
    matcher = decontaminate.Matcher([(k, decontaminate.normalize(t)) for k, t in items], decontaminate.ERROR_RATE, decontaminate.MIN_CHARS)
    searched = matcher.searched([0 if s else e for s, e in zip(matcher.short, matcher.errors, strict=True)])
    assert all(len(own) > e for own, e in zip(searched[:60], matcher.errors, strict=False)) and max(len(where) for _, (_, where) in matcher.automaton.items()) <= 40

    def spoil(text, n):
        chars = list(text)
        for _ in range(n):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        return "".join(chars)

    docs = [(i, opening * 3 + " " + spoil(items[i % 80][1], i % 13) + " " + word()) for i in range(160)] + [(500, "so, one short text!"), (501, "none short texts")]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1200)  # more blocks than a chain holds
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for k, x in items:
            p, text = decontaminate.normalize(x), decontaminate.normalize(t)
            d = (0 if f" {p} " in f" {text} " else 99) if len(p) < decontaminate.MIN_CHARS else decontaminate.myers(p, text)[0]
            if d <= int(len(p) * decontaminate.ERROR_RATE):
                want[i, k] = d
    assert got == want and len(want) > 150


# --- repeated passages ------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    place = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in rows:
        raw = text_of(t).encode()
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            first[w] = min(first.get(w, 1 << 63), place(i))
    out = []
    for i, t in rows:
        raw = text_of(t).encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < place(i):
                gone[k : k + length] = b"\1" * length
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone)))
        out.append((str(i), len(raw), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("length,block_bytes,hot", [(50, 8 << 20, 64), (50, 3000, 64), (50, 2000, 2), (30, 2500, 3)])
def test_repeats_against_brute_force(spark, length, block_bytes, hot):
    rng = random.Random(7)
    words = ["ab", "the", "one", "é", "x", " qq", "lorem", "ipsum", "zz9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(30) for _ in range(5)]
    rows = [(i * 3, text(rng.randint(0, 40)) + rng.choice(passages) + text(5)) for i in range(60)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (9, rows[3][1]), (9, "x" * 4000), (12, "x" * 300), (1000, None), (1001, ""), (-5, "x" * 60)]
    rows += [(2000 + i, passages[1] + str(i) + passages[2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(5)
    got = substring_dedup.remove_repeats(df, length, block_bytes, hot).collect()
    assert sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows, length)


def test_repeats_edges(odd_docs, empty_docs):
    assert substring_dedup.remove_repeats(empty_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(text_of(r.text)) < 1000]
    short = odd_docs.where("coalesce(length(text), 0) < 1000")
    got = substring_dedup.remove_repeats(short, carry=("lang",), whole_characters=True).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == sorted((x[0], x[3]) for x in brute_repeats(rows, 50))
    assert {r.carried.lang for r in got} == {"en"}


def test_suffix_arrays():
    rng = random.Random(3)
    for it in range(60):
        depth = rng.choice([8, 9, 12, 20, 50])
        parts = [bytes(rng.choice(b"ab\0" if it % 2 else b"abc") for _ in range(rng.randint(depth, depth + 30))) for _ in range(8)]
        parts += rng.choices(parts, k=3)
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(x) for x in parts])
        begin, doc = np.cumsum(size) - size, np.array([rng.randint(0, 5) for _ in parts])
        least = {}
        for x, d in zip(parts, doc, strict=True):
            for k in range(len(x) - depth + 1):
                least[x[k : k + depth]] = min(least.get(x[k : k + depth], 99), d)
        order = suffix_array.window_order(data, begin, size, depth)
        windows = [data[i : i + depth].tobytes() for i in order]
        assert windows == sorted(windows) and len(windows) == (size - depth + 1).sum()
        for shard in (10**9, 40):
            owner = suffix_array.window_owners(data, begin, size, doc, depth, shard)
            assert all(owner[b + k] == least[x[k : k + depth]] for b, x in zip(begin, parts, strict=True) for k in range(len(x) - depth + 1))


# --- near duplicates --------------------------------------------------------------------------------------------


def plain_simhash(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text_of(t))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connected(nodes, links):
    parent = {v: v for v in nodes}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in nodes}


def near(values, radius=2):
    return [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= radius]


@pytest.mark.parametrize("split", [4, 60, 5000])
def test_bk_tree_links(split):
    rng = random.Random(1)
    values = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(20):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    assert connected(values, simhash_dedup.spanning_links(values, 2, 2**64 - 1, split)) == connected(values, near(values))


def test_near_duplicates(spark, odd_docs, empty_docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = simhash_dedup.near_duplicates(spark.createDataFrame(rows)).collect()
    fp = {r.doc_id: plain_simhash(r.text) for r in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in out} == fp
    ids = sorted(fp)
    want = connected(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in out} == want
    odd = simhash_dedup.near_duplicates(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r.component_id for r in odd if r.fingerprint == "0" * 16} == {0}
    assert simhash_dedup.near_duplicates(empty_docs).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(3, 2, "x"), (2, 3, "x"), (3, 2, "y"), (5, 5, "x"), (None, 2, "x"), (7, None, "x"), (None, None, "x")], "u long, v long, root string")
    assert sorted(map(tuple, components(links).collect())) == [(2, 2), (3, 2)]
    assert components(links.limit(0)).collect() == []


# --- exact fingerprints -----------------------------------------------------------------------------------------


def canon(t):
    return re.sub(r"[\s\x85]+", " ", unicodedata.normalize("NFC", unicodedata.normalize("NFC", text_of(t)).casefold())).strip(" ")


def test_canonically_equal_texts_share_a_fingerprint(spark):
    """Folding takes U+0390 apart; what it leaves must meet the text that was written apart."""
    df = spark.createDataFrame([("\u0390",), ("\u03aa\u0301",), ("\u03b9\u0308\u0301",), ("\u1fd3",)], "t string")
    assert df.select(fingerprints.fingerprint(fingerprints.canonical(F.col("t"))).alias("f")).distinct().count() == 1


@pytest.mark.parametrize("range_bytes,broadcast", [(16 << 20, 10), (40, 0)])
def test_fingerprints(spark, monkeypatch, range_bytes, broadcast):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(fingerprints, "BROADCAST_FINGERPRINTS", broadcast)
    rows = [(i, t) for i, t in enumerate(["Alpha  beta", "alpha BETA ", "Été x", "été X", "", None, "straße", "STRASSE", "z" * 200, "日本 語"])]
    df = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").withColumn("range", F.lit("clash")).repartition(3)
    out = fingerprints.with_classes(fingerprints.compare_neighbours(df), fingerprints.exact_classes(df))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) + 1
    for k, (i, t) in enumerate(rows):
        t, after = text_of(t), text_of(rows[(k + 1) % len(rows)][1])
        cut = len(t) // 4
        r = got[i]
        assert r.edited == t[: len(t) - cut] + after[:cut] and r.n_chars == len(t)
        assert r.near_next == float(canon(t) == canon(after)) and r.near_edited == float(canon(t) == canon(r.edited))
        assert r.class_id == min(j for j, u in rows if canon(u) == canon(t))
    assert fingerprints.compare_neighbours(df.limit(0)).count() == 0


def test_fingerprint_plan_is_native(spark):
    out = queries.op9_fingerprints(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_ids_follow_each_other(spark):
    df = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (2, "bbbb")], "doc_id long, text string")
    assert sorted(r.edited for r in fingerprints.compare_neighbours(df).collect()) == ["aaaa", "aaab", "bbba"]


# --- pages ------------------------------------------------------------------------------------------------------

PAGE = """<html><body class="home"><header><a href="/">Site</a></header><nav><ul><li>One</ul></nav><div class="wrap{n}"><div class="post"><h1>Title &amp; more</h1>
<p>First   para with <a href=x>link</a> text that goes on for a while.</p>loose <b>bold</b><br>text<ul><li>item one<li>item two</ul><div class="share-box">Share</div></div>
<div id="comments"><p>A reader comment long enough to matter.</p></div></div><aside>side</aside><div class="cookie-notice">We use cookies</div><form>f<input></form>
<script>if(a<b)x("</div>")</script><!-- c --><footer>foot</footer>"""
WANT = "Title & more\nFirst para with link text that goes on for a while.\nloose bold text\nitem one\nitem two"


def test_page_text(spark):
    rows = [(i, f"http://h{i % 2}.org/x", PAGE.replace("{n}", str(i))) for i in range(6)]
    rows += [(10, None, None), (11, "bad url", ""), (12, "http://h0.org/y", "<p>plain &lt;b&gt;"), (None, "http://h1.org:80/z", "<div hidden>no</div><title>t</title>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {**{i: WANT for i in range(6)}, 10: "", 11: "", 12: "plain <b>", None: ""}
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_page_text_by_salted_join(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    pages = spark.createDataFrame([(1, "http://h/x", PAGE)], "page_id long, url string, html string")
    assert html_extract.extract(pages).first()["text"] == WANT


def test_long_and_broken_pages():
    assert html_extract.Page("<p>" + "x " * 200_000 + "<a href='unclosed>y").extract(None).startswith("x x")
    assert html_extract.Page("<" * 5000).extract(None) is not None
    assert html_extract.Page("a</p></div></b>b").extract(None) == "a\nb"
    assert html_extract.Page('<div title="the hidden gem">text</div>').extract(None) == "text"


def test_consensus_beats_a_single_page(spark):
    comment = "<section><p>" + "chatter " * 60 + "</p></section>"
    normal = "<div class='story'><p>" + "fact " * 40 + "</p></div>"
    pages = [(i, "http://h/x", f"<body>{normal}</body>") for i in range(9)] + [(9, "http://h/y", f"<body>{normal}{comment}</body>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == got[0] == ("fact " * 40).strip()


def test_a_block_of_repeats_takes_few_bytes_of_a_worker():
    """Round 3: a block's windows were looked at all together, which took over 30 bytes for each byte of text."""
    rng = np.random.default_rng(3)
    passages = [bytes(rng.integers(97, 123, 400, dtype=np.uint8)) for _ in range(40)]
    texts = [b"".join([bytes(rng.integers(97, 123, 900, dtype=np.uint8)), *(passages[k] for k in rng.integers(0, 40, 3))]).decode() for _ in range(1000)]
    docs = pa.table({"doc_id": pa.array(range(1000), pa.int64()), "text": pa.array(texts)})
    left = pa.table({"block": pa.array([0], pa.int64()), "payload": pa.array([common.to_stream(docs)], pa.binary())})
    prints = substring_dedup.Block([common.to_stream(docs)], 50, 1).prints
    codes = [(0, common.squeeze(np.ones(len(prints), np.uint8)))]

    def answered(more):
        kinds, answers = zip(*codes, *more, strict=True)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "shard": pa.array([0] * len(kinds), pa.int32()), "answer": pa.array(answers, pa.binary())})

    peaks = []

    def peak(run):
        tracemalloc.start()
        try:
            out = run()
            peaks.append(tracemalloc.get_traced_memory()[1] / sum(map(len, texts)))
            return out
        finally:
            tracemalloc.stop()

    sent = peak(lambda: substring_dedup.send_runs((pa.scalar(0),), left, answered([]), 50, 1))
    bits = peak(lambda: substring_dedup.judge_runs(sent.column("body").to_pylist(), 50))
    out = peak(lambda: substring_dedup.cut_documents(left, answered([(1, bits[0])]), 50, 1, False))
    seen, kept = set(), []
    for t in texts[:200]:
        own = [t[k : k + 50] for k in range(len(t) - 49)]
        gone = {k + i for k, w in enumerate(own) if w in seen for i in range(50)}
        kept.append("".join(c for i, c in enumerate(t) if i not in gone).encode())
        seen.update(own)
    assert out.column("kept").to_pylist()[:200] == kept
    assert peaks[0] < 40 and peaks[2] < 40, peaks


def test_a_worker_drops_what_its_tasks_no_longer_use():
    """Round 3: encoders and word lists of one stage stayed in the workers through all later ones."""
    made = []
    table = common.kept(lambda of: made.append(of) or [of])
    for _ in range(3 * common.IDLE):
        assert table("a") == ["a"]
        common.give_back()
    assert made == ["a"]
    for _ in range(common.IDLE + 1):
        common.give_back()
    assert table("a") == ["a"] and made == ["a", "a"]


def test_words_are_encoded_together(monkeypatch):
    """Round 3: each new word was a text of its own for the library, and a worker's cache held few words."""
    encoder = token_shards.WordEncoder(PATH)
    calls = []

    class Counting:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return self.of.encode_batch_fast(texts, **how)

    library, encoder.tokenizer = encoder.tokenizer, Counting(encoder.tokenizer)
    texts = [f"wort{i} \u00e4{i}x  b\n{i}'s caf\u00e9\u3000 \u00a0x\x1c\u0085y<|endoftext|>z{'q' * (i % 7)} \u65e5\u672c" for i in range(3000)] + ["", " ", "w" * 5000]
    for least in (1 << 10, 1, 1 << 20):
        monkeypatch.setattr(token_shards, "LINES_BYTES", least)
        encoder.known, encoder.known_n, encoder.known_ids = encoder.known[:0], encoder.known_n[:0], encoder.known_ids[:0]
        calls.clear()
        for _ in range(2):  # anew and from the cache
            ids, ends = token_shards.encode_chunk(encoder, pa.array([*texts, None]), 0)
            want = [e.ids for e in library.encode_batch_fast([*texts, ""], add_special_tokens=False)]
            assert ids.tolist() == [i for w in want for i in [*w, 0]]
            assert ends.tolist() == np.cumsum([len(w) + 1 for w in want]).tolist()
        if least > 1:
            assert sum(calls) < 500, sum(calls)
    monkeypatch.setattr(encoder, "n_bytes", encoder.n_bytes * 2)  # a file whose pieces aren't bytes of their text
    n, at, ids = encoder.ids(pa.array([b" never", b"seen", b" "], pa.binary()))
    assert [ids[a : a + k].tolist() for a, k in zip(at, n, strict=True)] == [library.encode(w, add_special_tokens=False).ids for w in (" never", "seen", " ")]


def test_classes_of_all_code_points():
    kinds = {"L": common.LETTER, "N": common.NUMBER}
    table = common.class_table()
    want = np.array([kinds.get(unicodedata.category(chr(c))[0], common.OTHER) for c in range(0x110000)], np.uint8)
    assert ((table == want) | (table == common.SPACE)).all()


def test_pretokens_of_many_documents_take_few_bytes():
    """Round 3: the pretokens of a block were cut all together, which took 17 bytes for each byte of this text."""
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) + "\u00e9" for _ in range(3000)]
    texts = [" ".join(words[k] for k in rng.integers(0, 3000, 250)) for _ in range(2000)]
    data, offsets = common.buffer_of(["", *texts, "", ""])
    common.class_table()
    tracemalloc.start()
    try:
        found, index, first = common.words_of(data, offsets)
        peak = tracemalloc.get_traced_memory()[1] / len(data)
    finally:
        tracemalloc.stop()
    found = found.to_pylist()
    for k in (0, 1, 2, 1000, 2000, 2001, 2002):
        assert b"".join(found[i] for i in index[first[k] : first[k + 1]]) == data[offsets[k] : offsets[k + 1]]
    assert first[-1] == len(index) and peak < 12, peak


def test_a_block_of_words_takes_few_bytes_of_a_worker():
    """Round 3, the pipeline's encoding: words were hashed and ids gathered for a whole block at once: 38 and 17 bytes for each of these."""
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(60)) for _ in range(4000)]
    data, offsets = common.buffer_of(texts)
    common.class_table(), common.powers(common.STEP, common.POWERS_KEPT), common.powers(pow(common.STEP, -1, 1 << 64), common.POWERS_KEPT)
    peaks = []

    def peak(run):
        tracemalloc.start()
        try:
            out = run()
            peaks.append(tracemalloc.get_traced_memory()[1] / len(data))
            return out
        finally:
            tracemalloc.stop()

    text, sizes, part, index, first = peak(lambda: word_table_bpe.words_by_part(data, offsets, (), 64))
    edges = np.r_[0, np.cumsum(sizes)]
    assert (part == common.stretch_hashes(text, edges[:-1], edges[1:]) % np.uint64(64)).all()
    flat = np.frombuffer(text, np.uint8)
    assert peak(lambda: common.gathered(index, sizes, edges[:-1], flat)).tobytes() == data
    assert first[-1] == len(index) and peaks[0] < 15 and peaks[1] < 8, peaks
    assert len(common.gathered(index[:0], sizes, edges[:-1], flat)) == 0


def test_encoders_are_dropped_where_nothing_is_encoded():
    table = common.kept(lambda of: [of])
    first = table("a")
    assert table("a") is first
    common.drop(table)
    assert table("a") is not first
