"""Source divergence, lattice scores and ranked search against plain Python, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from swathkit.llm import lattice_score, queries, ranked_search, source_divergence, terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
CLASH = ("part", "block", "payload", "term", "class", "train", "name", "item", "rank", "group", "value", "stretch", "task", "n_docs")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows and clashing columns, in three files."""
    root = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [
        (9000, None, "en", "src1"), (9001, "", None, "src2"), (9002, "no lang no source", None, None), (9003, "  \n\t ", "xx", "only"),
        (9004, "the " * 20_000 + "THE End", "en", "src1"), (9005, "日本 é É 😀 Zz9", "en", "src3"), (9006, "w" * 700 + " \x1f x", "de", "src0"),
        (None, "without an id", "en", "src1"), (9007, "the and of", "en", "src1"), (9007, "the and of", "en", "src1"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit("clash") for c in CLASH}
    docs.unionByName(odd).withColumns(clash).repartition(3).write.parquet(f"{root}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(500, None), (501, "the THE the and"), (502, "nowheretobefound"), (None, "of the"), (501, "wwww x")], bench.schema)
    bench.unionByName(more).withColumns(clash).repartition(2).write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('empty')}"
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{root}/{t}.parquet")
    return root


def rows_of(spark, folder, table):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{table}.parquet").collect()]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_lattice_score", "op13_ranked_search"])
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_ranked_search"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


def test_runs_stay_in_their_texts():
    data = "ab1Ü|cd".encode() + b"ef" + b"  gh"
    offsets = np.array([0, 8, 8, 10, 14])
    begin, end, doc = terms.runs(data, offsets, terms.LETTERS)
    assert [(data[a:b].decode(), d) for a, b, d in zip(begin, end, doc, strict=True)] == [("ab", 0), ("Ü", 0), ("cd", 0), ("ef", 2), ("gh", 3)]
    assert terms.pieces(data, begin, end).to_pylist() == [b"ab", "Ü".encode(), b"cd", b"ef", b"gh"]


# --- source divergence --------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        groups.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER)))
        df[lang].update(found.keys())
        count[lang, source] += found
    out = []
    for lang, source in groups:
        kept = [t for t in df[lang] if df[lang][t] >= min_docs]
        v, own = len(kept), [g for g in groups if g[0] == lang]

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        mine, whole = p(count[lang, source]), p(sum((count[g] for g in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(sum(f(mine[t], q[t]) for t in kept), g[1]) for g in own if g[1] != source for q in [p(count[g])]]
        tops = [(f(mine[t], whole[t]), t) for t in kept if count[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", tops)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, i, x, k + 1) for k, (x, i) in enumerate(ordered) if part == "pair" or k < 10]
    return sorted(out)


@pytest.mark.parametrize(("stretch", "tile", "at_once"), [(4_000_000, 512, 512), (50, 3, 7)])
def test_op11_against_plain_counts(spark, folder, monkeypatch, stretch, tile, at_once):
    monkeypatch.setattr(source_divergence, "STRETCH_ROWS", stretch)
    monkeypatch.setattr(source_divergence, "TILE", tile)
    monkeypatch.setattr(source_divergence, "TERMS_AT_ONCE", at_once)
    got = queries.op11_source_divergence(spark, folder).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == plain_audit(rows_of(spark, folder, "documents"), 10)


def test_runs_go_on_in_the_next_batch():
    """A term whose rows fill several batches has one run; frequencies add up."""
    import pyarrow as pa

    def rows(*items):
        posting = [np.array([(g, d, n) for g, d, n in p], source_divergence.POSTING).tobytes() for _, _, p in items]
        return pa.RecordBatch.from_arrays([pa.array([i[0] for i in items], pa.int32()), pa.array([i[1] for i in items]), pa.array(posting, pa.binary())], ["lang", "term", "postings"])

    batches = [rows((0, "a", [(0, 4, 5)]), (0, "b", [(0, 9, 9)])), rows((0, "b", [(1, 1, 7)])), rows((0, "b", [(0, 1, 2)]), (1, "b", [(2, 9, 9)]))]
    out = [r for b in source_divergence.scan_runs(iter(batches), 3, 10) for r in b.to_pylist()]
    assert [(r["lang"], r["term"]) for r in out] == [(0, "b")]
    assert np.frombuffer(out[0]["counts"], source_divergence.TOTAL).tolist() == [(0, 11), (1, 7)]


def test_scaled_is_exact_beyond_64_bits():
    counts = np.array([0, 2, 10**13, 3 * 10**15])
    assert source_divergence.scaled(counts, 3 * 10**15 + 1).tolist() == [1 + 10**9 * int(c) // (3 * 10**15 + 1) for c in counts]


# --- lattice scores -----------------------------------------------------------------------------------------------


def plain_lattice(word, arcs):
    """Sum over all segmentations, and expected count of each piece, by plain forward and backward sums."""
    n, one, none = len(word), Decimal(1), Decimal(0)  # no float: long words would underflow
    found = [[(k, word[i:k]) for k in range(i + 1, min(n, i + 50) + 1) if word[i:k] in arcs] for i in range(n)]
    arcs = {p: Decimal(arcs[p]) for ways in found for _, p in ways}
    a, b = [one] + [none] * n, [none] * n + [one]
    for i in range(n):
        for k, p in found[i]:
            a[k] += a[i] * arcs[p]
    for i in reversed(range(n)):
        b[i] = sum(arcs[p] * b[k] for k, p in found[i])
    expected = Counter()
    for i in range(n):
        for k, p in found[i]:
            expected[p] += float(a[i] * arcs[p] * b[k] / a[n])
    return float(a[n]), expected


def plain_scores(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    score = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or b" " in piece[1:]):
            score[piece] = model.get_score(i)
    lowest = min(score.values())
    score |= {bytes([c]): lowest for c in range(256) if bytes([c]) not in score}
    first = {p for p in score if p[:1] == b" "}
    seed = {p: 1 / (lattice_score.ZIPF - s) for p, s in score.items()}
    mass = {True: sum(seed[p] for p in first), False: sum(v for p, v in seed.items() if p not in first)}
    seed = {p: v / mass[p in first] for p, v in seed.items()}

    def weights(expected, words):
        prior = lattice_score.PRIOR
        a, b = sum(v for p, v in expected.items() if p in first), sum(v for p, v in expected.items() if p not in first)
        stop = (words + prior * lattice_score.STOP) / (words + b + prior)
        return {p: (expected[p] + prior * seed[p]) / (a + prior) if p in first else (expected[p] + prior * seed[p]) / (b + prior) * (1 - stop) for p in score}, stop

    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER).encode()) for r in rows]
    train = [r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for r in rows]
    classes = sorted({r["lang"] or "" for r, t in zip(rows, train, strict=True) if t})
    count, docs = {k: Counter() for k in classes}, Counter()
    for r, words, t in zip(rows, texts, train, strict=True):
        if t:
            count[r["lang"] or ""].update(words)
            docs[r["lang"] or ""] += 1
    whole = sum(count.values(), Counter())
    n, v = whole.total() + docs.total(), len(whole) + 1
    arcs = {}
    for k in classes:
        found, stop = weights(Counter(), 0)
        for _ in range(lattice_score.ROUNDS):
            expected = Counter()
            for w in count[k]:
                expected.update(plain_lattice(b" " + w, found)[1])
            found, stop = weights(expected, len(count[k]))
        arcs[k] = found, stop

    def ln(k, w):
        tokens, kinds = count[k].total() + docs[k], len(count[k]) + 1
        c, own, s = (docs.total(), docs[k], 1 / (v + 1)) if w is None else (whole[w], count[k][w], plain_lattice(b" " + w, arcs[k][0])[0] * arcs[k][1])
        return math.log((own + kinds * (c + v * s) / (n + v)) / (tokens + kinds))

    known = {(k, w): ln(k, w) for k in classes for w in {None, *(w for t in texts for w in t)}}
    out = []
    for r, words in zip(rows, texts, strict=True):
        each = [math.log((docs[k] + 1) / (docs.total() + len(classes))) + sum(known[k, w] for w in [*words, None]) for k in classes]
        base = sum(math.log10((whole[w] + 1) / (n + v + 1)) for w in words) + math.log10((docs.total() + 1) / (n + v + 1))
        out.append((r["doc_id"], len(words) + 1, sum(whole[w] > 0 for w in words) + 1, n, base, np.logaddexp.reduce(each) / math.log(10)))
    return out


@pytest.mark.parametrize(("block", "merge", "at_once"), [(8 << 20, 1_000_000, 20_000), (20_000, 50, 3)])
def test_op12_against_plain_lattices(spark, tmp_path, monkeypatch, block, merge, at_once):
    for name, value in (("BLOCK_BYTES", block), ("MERGE_ROWS", merge), ("WORDS_AT_ONCE", at_once)):
        monkeypatch.setattr(lattice_score, name, value)
    texts = ["the cat sat on the mat.", "The DOG sat\non the log!", None, "", "das Haus ist groß", "日本 😀 the", "x" * 300 + " cat", "unheard-of wörds the", "le chat est là"] * 3
    rows = [(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(texts)] + [(None, "no id here", "en"), (3, "twice", "en"), (3, "twice", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in CLASH})
    df.repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"] or -1, *r[2:]) for r in queries.op12_lattice_score(spark, f"file://{tmp_path}").collect()), key=lambda x: (x[0], x[1]))
    want = sorted(((r[0] or -1, *r[1:]) for r in plain_scores(rows_of(spark, f"file://{tmp_path}", "documents"))), key=lambda x: (x[0], x[1]))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4:] == pytest.approx(w[4:], rel=1e-5)


def test_op12_learns_from_training_rows_only(spark, folder):
    rows = queries.op12_lattice_score(spark, folder).collect()
    assert len(rows) == len(rows_of(spark, folder, "documents"))
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert any(r["held_out"] and r["n_known"] < r["n_tokens"] for r in rows)
    assert all(r["n_known"] == r["n_tokens"] for r in rows if not r["held_out"])


def test_scores_of_all_words_add_up_below_one():
    """Over all words of up to two bytes, and the longest way: the lattice gives no more than probability one."""
    pieces = lattice_score.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    weight, stop = pieces.weights()
    words = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    sizes = np.array([len(w) for w in words])
    total = sum(np.exp(x.forward(weight)[x.tails] + stop).sum() for _, x in lattice_score.lattices(b"".join(words), sizes, pieces))
    assert 0 < total < 1


def test_op12_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = lattice_score.score(df, public_tokenizers.path("piece_bpe_32k.model"), F.lit(None).cast("boolean"), class_col=None).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in out)


# --- ranked search ------------------------------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(r["doc_id"], Counter(find(r["text"]))) for r in docs]
    n, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in items:
        query, found = Counter(find(item["text"])), []
        for doc_id, c in counts:
            m = 100 - 75 + 75 * c.total() * n // length
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in query.items() if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item["item_id"], rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("query_bytes", "shard_bytes", "depth"), [(8 << 20, 32 << 20, 16), (6000, 30_000, 1)])
def test_op13_against_all_scores(spark, folder, monkeypatch, query_bytes, shard_bytes, depth):
    monkeypatch.setattr(ranked_search, "DEPTH", depth)
    monkeypatch.setattr(ranked_search, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(ranked_search, "MERGE_TASKS", 2)
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = ranked_search.search(docs, items, query_bytes=query_bytes, shard_bytes=shard_bytes).collect()
    want = plain_search(rows_of(spark, folder, "documents"), rows_of(spark, folder, "benchmark"))
    assert sorted(map(tuple, got), key=repr) == want


def test_op13_stops_before_the_end_of_the_lists(spark):
    """The threshold ends the search: of many documents that hold the term, few are looked up."""
    texts = [f"rare{'' if i % 500 else ' rare' * 5} word " + "pad " * (i % 40) for i in range(5000)]
    shard_rows = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    items = ranked_search.Items(["rare"])
    shard_rows = list(ranked_search.forward_rows(iter([batch]), items.vocabulary, 1 << 30))
    shard = ranked_search.Shard(shard_rows[0].column("payload")[0].as_py(), 5000, sum(len(t.split()) for t in texts))
    looked = []
    whole = shard.scores
    shard.scores = lambda docs, weight: (looked.append(len(docs)), whole(docs, weight))[1]
    assert len(shard.best(*[items.of(0)[0], np.array([7], np.int64)], 10, 0)) == 10
    assert sum(looked) < 200
