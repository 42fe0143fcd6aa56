"""Language identification by word-first backoff.

train() counts words per language in Spark over a bounded sample of labelled documents, and from them character
n-grams. predict() scores every word of a whole text: a known word by its log frequency in each language, an unseen
one by its longest known n-grams, trying ever shorter ones. The language with the largest mean wins.

The bound is a parameter: about max_rows labelled rows of each language (all of them if there are fewer), chosen by a
64-bit hash of id and text, so that rare languages are learned too and equal ids do not matter. All words and n-grams
of the sample are kept, as sorted 64-bit hashes with a score per language, so the broadcast model is bounded by the
sample however large the corpus is.

Null text or text without a letter gives `und` with score 0. Null labels are not learned from; without any label every
text is `und`. Ties go to the language first in alphabetical order. Null and repeated ids keep their rows; extra columns
are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathkit.llm import common

MAX_ROWS = 3_000  #: labelled rows to learn from, about, of each language
LONGEST_GRAM = 5
CHUNK = 1 << 20  #: text bytes scored at once
UNKNOWN = "und"
# Odd 64-bit multipliers of the hashes.
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass
class Table:
    """Sorted hashes of words, or n-grams of one length, and their log frequency in each language."""

    keys: np.ndarray
    scores: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes in the table, -1 where they are not."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


@dataclass
class Model:
    """A table for words (size 0) and for n-grams of each length."""

    langs: list[str]
    tables: dict[int, Table] = field(default_factory=dict)

    def score(self, cps: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Log frequencies in each language of words whose code points lie end to end."""
        out = np.zeros((len(edges) - 1, len(self.langs)), np.float32)
        if not self.langs or not len(out):
            return out
        at = self.tables[0].find(word_hashes(cps, edges))
        out[at >= 0] = self.tables[0].scores[at[at >= 0]]
        todo = np.flatnonzero(at < 0)
        for size in range(LONGEST_GRAM, 0, -1):
            if not len(todo):
                break
            h, word = gram_hashes(*only(cps, edges, todo), size)
            at = self.tables[size].find(h)
            word, at = word[at >= 0], at[at >= 0]
            n = np.bincount(word, minlength=len(todo))
            for k in range(len(self.langs)):
                total = np.bincount(word, self.tables[size].scores[at, k], len(todo))
                out[todo[n > 0], k] = (total[n > 0] / n[n > 0]).astype(np.float32)
            todo = todo[n == 0]
        return out


def only(cps: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the words, end to end."""
    n = (edges[1:] - edges[:-1])[which]
    new = np.r_[0, np.cumsum(n)]
    return cps[np.repeat(edges[which] - new[:-1], n) + np.arange(new[-1])], new


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def word_hashes(cps: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash of each word's code points (a word has one at least)."""
    if len(edges) < 2:
        return np.zeros(0, np.uint64)
    place = np.arange(len(cps)) - np.repeat(edges[:-1], np.diff(edges))
    each = mixed((cps.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP) + place.astype(np.uint64))
    return mixed(np.add.reduceat(each, edges[:-1]))


def gram_hashes(cps: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words with a mark at both ends, and the word of each."""
    n = np.diff(edges)
    word = np.repeat(np.arange(len(n)), n + 2)
    marked = np.ones(len(word), np.uint64)  # no letter has this code
    marked[np.arange(len(cps)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = cps
    if len(word) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(word) - size + 1
    h = np.zeros(m, np.uint64)
    for k in range(size):
        h = h * np.uint64(STEP) + marked[k : k + m]
    whole = word[:m] == word[size - 1 :]
    return mixed(h[whole]), word[:m][whole]


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def hash_bound(wanted: int, total: int) -> int:
    """Signed 64-bit hashes below it are about `wanted` of `total`."""
    if wanted >= total:
        return (1 << 63) - 1
    return -(1 << 63) + (wanted << 64) // total


def sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """About max_rows rows of each lang (columns doc_id, text, lang), or all if there are fewer."""
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not totals:
        return rows
    bounds = F.create_map(*(F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, hash_bound(max_rows, n))))
    return rows.where(F.xxhash64("doc_id", "text") <= F.element_at(bounds, F.col("lang")))


def count_grams(words: DataFrame) -> DataFrame:
    """lang, size, h, n: n-grams of (lang, word, count) rows; size 0 is the word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, count = batch.column("lang"), batch.column("count").to_numpy()
            for size, h, word in all_hashes(batch.column("word").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [lang.take(pa.array(word)), pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(count[word])],
                    ["lang", "size", "h", "n"],
                )

    made = words.select("lang", "word", "count").mapInArrow(common.tidy(run), "lang string, size int, h bigint, n bigint")
    return made.groupBy("lang", "size", "h").agg(F.sum("n").alias("n"))


def all_hashes(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    edges = np.cumsum([0, *map(len, words)])
    yield 0, word_hashes(cps, edges), np.arange(len(words))
    for size in range(1, LONGEST_GRAM + 1):
        yield size, *gram_hashes(cps, edges, size)


def train(
    labelled: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Learn from a sample of the rows with a non-null label."""
    rows = labelled.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("lang is not null")
    words = sample(rows, max_rows).select("lang", F.explode(words_column(F.col("text"))).alias("word"))
    return assemble(count_grams(words.groupBy("lang", "word").count()).toArrow())


def build(counts: Iterable[tuple[str, str, int]]) -> Model:
    """Model from (language, word, count) rows."""
    counts = list(counts)
    n = np.array([c for _, _, c in counts], np.int64)
    lang = np.array([x for x, _, _ in counts], object)
    parts = [
        pa.table({"lang": pa.array(lang[word].tolist(), pa.string()), "size": pa.array(np.full(len(h), size)), "h": pa.array(h.view(np.int64)), "n": pa.array(n[word])})
        for size, h, word in all_hashes([w for _, w, _ in counts])
    ]
    return assemble(pa.concat_tables(parts))


def assemble(counts: pa.Table) -> Model:
    """Model from counts of hashes: log((count + 1/2) / (total + keys / 2)) of each key in each language."""
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    langs = coded.dictionary.to_pylist()
    order = sorted(range(len(langs)), key=langs.__getitem__)
    rank = np.empty(len(langs), np.int64)
    rank[order] = np.arange(len(langs))
    lang = rank[coded.indices.to_numpy()] if langs else np.zeros(0, np.int64)
    size, h, n = (counts.column(c).to_numpy() for c in ("size", "h", "n"))
    model = Model([langs[k] for k in order])
    for s in range(LONGEST_GRAM + 1):
        own = size == s
        keys, at = np.unique(h[own].view(np.uint64), return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        np.add.at(table, (at, lang[own]), n[own])
        model.tables[s] = Table(keys, np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(len(keys), 1))).astype(np.float32))
    return model


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs (but an earlier lang_pred or score) with lang_pred and score.

    The score is from 0 to 1: the softmax of the mean log frequency per word at the predicted language.
    """
    payload: Broadcast = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(payload.value)
        for batch in batches:
            for part in common.chunks(batch, text_col, CHUNK):
                mean, n = mean_scores(own, part.column(text_col).to_pylist())
                if own.langs:
                    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                    best = odds.argmax(axis=1)
                    score = np.where(n > 0, 1 / odds.sum(axis=1), 0.0)
                    lang = [own.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                else:
                    score, lang = np.zeros(len(n)), [UNKNOWN] * len(n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    [*part.schema.names, "lang_pred", "score"],
                )

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(common.tidy(run), schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return annotate(rows, model).drop("text")


def mean_scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log frequencies of each text's words per language, and its number of words."""
    lower = [(t or "").lower() for t in texts]
    ends = np.cumsum([0, *map(len, lower)])
    n_docs = len(lower)
    cps = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(cps):
        return np.zeros((n_docs, len(model.langs))), np.zeros(n_docs, np.int64)
    letter = common.class_table()[cps] == common.LETTER
    edge = letter.copy()
    edge[1:] &= ~letter[:-1]
    at_start = ends[:-1][ends[:-1] < len(cps)]
    edge[at_start] = letter[at_start]
    starts = np.flatnonzero(edge)
    word_of = np.cumsum(edge)[letter] - 1
    n_chars = np.bincount(word_of, minlength=len(starts))
    doc = np.searchsorted(ends, starts, "right") - 1
    n = np.bincount(doc, minlength=n_docs)
    each = model.score(cps[letter], np.r_[0, np.cumsum(n_chars)])
    total = np.stack([np.bincount(doc, each[:, c], n_docs) for c in range(len(model.langs))], 1) if model.langs else np.zeros((n_docs, 0))
    return total / np.maximum(n, 1)[:, None], n
