"""Which terms set a source apart from its language, and how far sources lie from each other.

audit() is a sort-based stream. Each task counts the terms of its documents by (language, source) and lists, per language
and term, the counts of its sources (a stretch of documents). The lists are repartitioned by (language, term) and sorted
within partitions by (language, term, stretch), sources ascending inside a list; one scan over the sorted rows finds the
runs of a term, whose document frequency and counts by source are then whole. Terms of fewer than MIN_DOCS documents of
their language end there. The others are written to the shared folder; a second scan over them, which knows the totals of
each group, emits partial pairs (a sum for each two sources of a language) and the ten best terms of each group it has
met, and Spark sums and ranks these. A task holds one stretch, one Arrow batch of runs, or one tile of TILE x TILE pairs.

A very frequent term costs one row per stretch of documents, not one per document, so it needs no salt. The groups
(language, source) are broadcast; their squares per language are rows of the result, so they are the smaller by far.

All arithmetic is exact in 64 bits as long as a group has under 4 x 10^15 terms: floor(10^9 a / b) is done in three
steps of 1,000. Null language, source and text are ''. Each row is a document, also where ids repeat; ids are not read.
Equal values are ranked by the item's UTF-8 bytes. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.llm import common, terms

MIN_DOCS, TOP = 10, 10
CHUNK_BYTES = 4 << 20  #: text bytes cut at once
STRETCH_ROWS, STRETCH_BYTES = 4_000_000, 1 << 30  #: counts and text bytes of a stretch at most
TILE, TERMS_AT_ONCE = 512, 512
SCALE = 1_000_000_000

POSTING = np.dtype([("group", "<u4"), ("docs", "<u4"), ("n", "<u4")])
TOTAL = np.dtype([("group", "<u4"), ("n", "<i8")])


def scaled(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact: long division by 1,000 three times."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of values up to SCALE + 1."""
    return (p - q) ** 2 // (p + q)


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Records as one binary value per run; first: where runs start."""
    edges = (np.r_[first, len(values)] * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(values.tobytes())])


def unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The records of all values end to end, and the row of each."""
    data, offsets = common.buffer_of_array(column)
    return np.frombuffer(data, kind), np.repeat(np.arange(len(column)), np.diff(offsets) // kind.itemsize)


def run_starts(lang: np.ndarray, term: pa.Array) -> np.ndarray:
    """The first row of each run of equal (lang, term)."""
    if len(lang) < 2:
        return np.arange(len(lang))
    other = np.asarray(term.slice(1).cast(pa.binary())) != np.asarray(term.slice(0, len(term) - 1).cast(pa.binary()))
    return np.r_[0, np.flatnonzero(other.astype(bool) | (np.diff(lang) != 0)) + 1]


class Groups:
    """The (lang, source) groups in order, their language's place, and where each language's groups start."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = sorted(rows, key=lambda r: (r[0].encode(), r[1].encode()))
        self.code = {r: i for i, r in enumerate(self.rows)}
        self.langs = sorted({lang for lang, _ in rows}, key=str.encode)
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([place[lang] for lang, _ in self.rows], np.int64)
        self.first = np.searchsorted(self.lang, np.arange(len(self.langs) + 1))


def stretches(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[pa.RecordBatch]:
    """lang, term, stretch, postings: for each stretch a row per language and term, its sources ascending."""
    number = TaskContext.get().partitionId() << 32
    held, n_rows, n_bytes = [], 0, 0

    def listed() -> pa.RecordBatch:
        table = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
        group = table.column("group").to_numpy()
        coded = table.column("term").combine_chunks().dictionary_encode()
        coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
        term, lang = coded.indices.to_numpy(), groups.lang[group]
        order = np.lexsort((group, term, lang))
        first = np.flatnonzero(np.r_[True, (np.diff(term[order]) != 0) | (np.diff(lang[order]) != 0)])
        rows = np.empty(len(order), POSTING)
        rows["group"], rows["docs"], rows["n"] = group[order], table.column("docs_sum").to_numpy()[order], table.column("n_sum").to_numpy()[order]
        own = order[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(lang[own], pa.int32()), coded.dictionary.take(pa.array(term[own])).cast(pa.string()), pa.array(np.full(len(own), number)), packed(rows, first)],
            ["lang", "term", "stretch", "postings"],
        )

    for part, data, offsets in terms.lowered(batches, CHUNK_BYTES):
        begin, end, doc = terms.runs(data, offsets, terms.LETTERS)
        if not len(begin):
            continue
        coded = terms.pieces(data, begin, end).dictionary_encode()
        size = len(coded.dictionary)
        key, tf = terms.counted(doc * size + coded.indices.to_numpy().astype(np.int64))  # a key per document and term
        group = np.array([groups.code[r] for r in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)])
        of = group[key // size] * size + key % size
        own, at, docs = np.unique(of, return_inverse=True, return_counts=True)
        n = np.zeros(len(own), np.int64)
        np.add.at(n, at, tf)
        held.append(pa.table({"group": own // size, "term": coded.dictionary.take(pa.array(own % size)), "docs": docs, "n": n}))
        n_rows, n_bytes = n_rows + len(own), n_bytes + len(data)
        if n_rows >= STRETCH_ROWS or n_bytes >= STRETCH_BYTES:
            yield listed()
            held, n_rows, n_bytes, number = [], 0, 0, number + 1
    if held:
        yield listed()


def summed(rows: np.ndarray, run: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Run, group, documents and count of each group of each run, ascending."""
    key, at = np.unique(run * n_groups + rows["group"], return_inverse=True)
    docs, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    np.add.at(docs, at, rows["docs"].astype(np.int64))
    np.add.at(n, at, rows["n"].astype(np.int64))
    return key // n_groups, key % n_groups, docs, n


WIDE = np.dtype([("group", "<u4"), ("docs", "<i8"), ("n", "<i8")])


def scan_runs(batches: Iterator[pa.RecordBatch], n_groups: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """lang, term, counts of the terms in at least min_docs documents, from rows sorted by (lang, term)."""
    held_lang, held_term = np.zeros(0, np.int64), pa.array([], pa.string())  # the run that may go on in the next batch
    held = np.zeros(0, WIDE)

    def kept(lang: np.ndarray, term: pa.Array, run: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        frequency = np.bincount(run, rows["docs"], minlength=len(lang)).astype(np.int64)
        ok = frequency >= min_docs
        if ok.any():
            counts = np.empty(int(ok[run].sum()), TOTAL)
            counts["group"], counts["n"] = rows["group"][ok[run]], rows["n"][ok[run]]
            first = np.searchsorted(run[ok[run]], np.flatnonzero(ok))
            columns = [pa.array(lang[ok], pa.int32()), term.filter(pa.array(ok)), packed(counts, first)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "counts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows, row = unpacked(batch.column("postings"), POSTING)
        all_rows = np.empty(len(held) + len(rows), WIDE)
        for c in WIDE.names:
            all_rows[c][: len(held)], all_rows[c][len(held) :] = held[c], rows[c]
        lang = np.r_[held_lang, batch.column("lang").to_numpy().astype(np.int64)]
        term = pa.concat_arrays([held_term, batch.column("term").cast(pa.string())])
        first = run_starts(lang, term)
        row = np.r_[np.zeros(len(held), np.int64), row + len(held_lang)]
        run, group, docs, n = summed(all_rows, np.searchsorted(first, row, "right") - 1, n_groups)
        done = run < len(first) - 1
        out = np.empty(len(run), WIDE)
        out["group"], out["docs"], out["n"] = group, docs, n
        runs_lang, runs_term = lang[first], term.take(pa.array(first))
        yield from kept(runs_lang[:-1], runs_term.slice(0, len(first) - 1), run[done], out[done])
        held_lang, held_term, held = runs_lang[-1:], runs_term.slice(len(first) - 1), out[~done]
    if len(held_lang):
        yield from kept(held_lang, held_term, np.zeros(len(held), np.int64), held)


class Pairs:
    """Sums of one task over the terms it has met, by two sources of a language, and the best terms of each group."""

    def __init__(self, groups: Groups, total: np.ndarray, size: np.ndarray):
        self.groups = groups
        self.lang_total = np.bincount(groups.lang, total, minlength=len(groups.langs)).astype(np.int64) if len(total) < 1 else np.add.reduceat(total, groups.first[:-1])
        self.total, self.size = total, size  #: terms of each group; kept terms of each language
        self.best: dict[int, list[tuple[int, bytes]]] = {}

    def add(self, lang: int, term: list[bytes], group: np.ndarray, row: np.ndarray, n: np.ndarray, sums: dict) -> None:
        a, b = self.groups.first[lang], self.groups.first[lang + 1]
        counts = np.zeros((b - a, len(term)), np.int64)
        counts[group - a, row] = n
        all_n = 2 * int(self.size[lang])
        whole = scaled(counts.sum(axis=0) + 2, int(self.lang_total[lang]) + all_n)
        names = np.array(term, object)
        p = np.empty_like(counts)
        for s in range(b - a):
            p[s] = scaled(counts[s] + 2, int(self.total[a + s]) + all_n)
            over = np.flatnonzero((counts[s] > 0) & (p[s] > whole))
            value = apart(p[s][over], whole[over])
            if len(over) > TOP:
                enough = value >= np.partition(value, len(value) - TOP)[-TOP]
                over, value = over[enough], value[enough]
            if len(over):
                found = self.best.get(a + s, []) + list(zip((-value).tolist(), names[over].tolist(), strict=True))
                self.best[a + s] = sorted(found)[:TOP]
        for s in range(0, b - a, TILE):
            for t in range(s, b - a, TILE):
                tile = sums.setdefault((lang, s, t), np.zeros((min(TILE, b - a - s), min(TILE, b - a - t)), np.int64))
                for i in range(len(tile)):
                    j = i + 1 if s == t else 0
                    tile[i, j:] += apart(p[s + i], p[t + j : t + TILE]).sum(axis=1)


def partial_rows(batches: Iterator[pa.RecordBatch], pairs: Pairs) -> Iterator[pa.RecordBatch]:
    """part, a, b, term, value: a partial sum for each two groups a < b, and the best terms of each group a."""
    sums: dict[tuple[int, int, int], np.ndarray] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, s, t), tile in sums.items():
            i, j = np.nonzero(tile)
            a = pairs.groups.first[lang]
            yield rows("pair", i + a + s, j + a + t, [""] * len(i), tile[i, j])
        sums.clear()

    def rows(part: str, a, b, term: list[str], value) -> pa.RecordBatch:
        columns = [pa.array([part] * len(term), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(term, pa.string()), pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["part", "a", "b", "term", "value"])

    for batch in batches:
        counts, row = unpacked(batch.column("counts"), TOTAL)
        lang, term = batch.column("lang").to_numpy(), batch.column("term").cast(pa.binary()).to_pylist()
        for k in np.unique(lang):
            own = np.flatnonzero(lang == k)
            for at in range(0, len(own), TERMS_AT_ONCE):
                some = own[at : at + TERMS_AT_ONCE]
                place = np.full(len(lang), -1)
                place[some] = np.arange(len(some))
                mine = place[row] >= 0
                pairs.add(int(k), [term[i] for i in some], counts["group"][mine].astype(np.int64), place[row[mine]], counts["n"][mine], sums)
                if sum(x.nbytes for x in sums.values()) > 64 << 20:
                    yield from emit()
    yield from emit()
    if pairs.best:
        flat = [(g, value, term) for g, found in pairs.best.items() for value, term in found]
        yield rows("term", [f[0] for f in flat], [0] * len(flat), [f[2].decode() for f in flat], [-f[1] for f in flat])


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group."""
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    groups = Groups([tuple(r) for r in docs.select("lang", "source").distinct().collect()])
    sent = spark.sparkContext.broadcast(groups)
    n_groups = max(len(groups.rows), 1)

    listed = docs.mapInArrow(common.tidy(lambda b: stretches(b, sent.value)), "lang int, term string, stretch bigint, postings binary")
    ordered = listed.repartition("lang", "term").sortWithinPartitions("lang", "term", "stretch")
    kept = common.materialize(
        ordered.mapInArrow(common.tidy(lambda b: scan_runs(b, n_groups, min_docs)), "lang int, term string, counts binary"), "kept-terms"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_groups, np.int64)
        for batch in batches:
            counts, _ = unpacked(batch.column("counts"), TOTAL)
            np.add.at(total, counts["group"], counts["n"])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["group", "n"])

    total, size = np.zeros(len(groups.rows), np.int64), np.zeros(len(groups.langs), np.int64)
    for r in kept.select("counts").mapInArrow(common.tidy(count), "group bigint, n bigint").groupBy("group").agg(F.sum("n").alias("n")).collect():
        total[r["group"]] = r["n"]
    for r in kept.groupBy("lang").count().collect():
        size[r["lang"]] = r["count"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from partial_rows(batches, Pairs(sent.value, total, size))

    partial = common.materialize(kept.mapInArrow(common.tidy(compare), "part string, a bigint, b bigint, term string, value bigint"), "partial")
    named = spark.createDataFrame([(i, *r) for i, r in enumerate(groups.rows)], "a bigint, lang string, source string")
    others = named.select("lang", F.col("a").alias("b"), F.col("source").alias("item"))
    sums = partial.where("part = 'pair'").groupBy("a", "b").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pair = named.join(others, "lang").where("a != b").join(both, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    term = partial.where("part = 'term'").join(named, "a").select("lang", "source", "part", F.col("term").alias("item"), "value")
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", order).unionByName(term.withColumn("rank", order).where(F.col("rank") <= TOP))
