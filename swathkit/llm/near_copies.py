"""Documents linked by word shingles of Jaccard similarity 0.8 or more: SimHash and BK-trees first, then what they miss.

Words are those of simhash_dedup; a text of fewer than `words` words is one shingle, one without words has none (all
such texts are alike). A shingle is named by a 64-bit rolling hash of its bytes, so a set is its distinct
hashes; only hashes of unlike shingles that meet could make a similarity wrong. Nodes are distinct texts: their 64-bit
hash names them, and where a second hash tells that one name stands for several texts, both hashes together do.

1. One pass makes each text's SimHash, size, least hash under BANDS permutations, and counts of common hashes.
2. simhash_dedup.link() finds fingerprints within RADIUS bits in BK-trees; each text is also paired with the middle text
   of its bands, if their fingerprints are no more than FAR bits apart. These pairs are verified on the whole sets, and
   components() joins what is similar. A group of many copies becomes one component here, without all its pairs.
3. A radius cannot see every pair of similarity 0.8, so an exact way takes the rest: two such sets share a hash among
   the first n - ceil(0.8 n) + 1 of each in any order common to all (prefix filter; rarest first, by the counts, which
   only saves work). Texts of different components that meet there, and that sizes, places and counts of hashes by bucket
   allow, are verified. A token that many texts share is cut by size (similar sets are of the same or the next class), and
   a class into cells of CELL texts; each two cells meet in a task of their own, so no task holds the whole token.

Every pass reads the texts and writes keys only; texts move just for pairs to be verified. Hot copies meet once per
task, since a task sends each text once; a bucket lists only pairs of different components.

Null text is a text without words. Null and repeated ids are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm import common, simhash_dedup
from swathkit.llm.components import components

WORDS = 5
PART, WHOLE = 4, 5  #: similarity 4 / 5, in whole numbers so that the bound itself is met exactly
RADIUS = 2  #: of the BK-trees
FAR = 24  #: bits between texts that a band may pair; similarity 0.8 differs by about ten
SLOTS, RANGE = 1 << 21, 1 << 16  #: of the table of counts, and slots in a row of it
ROWS = 1 << 16  #: pairs looked at together
HOT, CELL = 2048, 1024  #: texts that share a token before it is cut, and texts of a piece
SIZE_STEP = 1.26  #: ratio of size classes; over 5 / 4, so that similar sets are at most one class apart
FAN = 64  #: tables of counts added up together
FULL = 255  #: a count of this or more is not known
CHUNK = 1 << 20  #: text bytes hashed at once
# Odd 64-bit multipliers, one for each permutation.
BANDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, text after text, and how many each has."""
    text, begin, end, n_words = simhash_dedup.word_spans(texts)
    n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    if not len(begin):
        return np.zeros(0, np.uint64), n
    first, at = np.cumsum(n_words) - n_words, np.cumsum(n) - n
    left = np.arange(n.sum()) - np.repeat(at - first, n)
    right = np.minimum(left + words, np.repeat(first + n_words, n)) - 1
    h = common.stretch_hashes(text, begin[left], end[right])
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    return h[new], np.bincount(doc[new], minlength=len(n))


def sketches(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes of each text fall in each of its buckets (a power of two, a quarter of its hashes), end to end."""
    size = 1 << np.ceil(np.log2(np.maximum(n / 4, 16))).astype(np.int64)
    at = np.cumsum(size) - size
    place = np.repeat(at, n) + (h & (np.repeat(size, n) - 1).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=int(size.sum())), FULL).astype(np.uint8), np.r_[0, np.cumsum(size)]


def may_share(a: bytes, b: bytes, least: int) -> bool:
    """Whether two sets may have `least` hashes in common: in each bucket no more than the smaller count."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if x.max(initial=0) >= FULL or y.max(initial=0) >= FULL:
        return True
    m = min(len(x), len(y))  # the larger one is folded: low bits of the hash name the bucket
    return int(np.minimum(x.reshape(-1, m).sum(axis=0), y.reshape(-1, m).sum(axis=0)).sum()) >= least


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from common.chunks(batch, "text", CHUNK)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """A row per row of docs (rid, tid, also, doc_id, fp, n, bands, sketch), and from each task its counts (task, range, seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "tid", "also", "doc_id", "fp", "n", "bands", "sketch", "task", "range", "seen"]
        counts, kinds = np.zeros(SLOTS, np.int64), None
        for part in _chunks(batches):
            h, n = shingle_sets(part.column("text").to_pylist(), words)
            counts += np.bincount(_slot(h), minlength=SLOTS)
            has, at = n > 0, np.cumsum(n) - n
            bands = np.zeros((len(n), len(BANDS)), np.uint64)
            for k, m in enumerate(BANDS):
                if len(h):
                    bands[has, k] = np.minimum.reduceat(h * np.uint64(m), at[has])
            fp = simhash_dedup.majority_bits(h, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(BANDS)), pa.array(bands.ravel().view(np.int64)))
            counted, edges = sketches(h, n)
            kinds = part.column("doc_id").type
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("rid", "tid", "also", "doc_id")),
                    pa.array(fp.view(np.int64)), pa.array(n), lists, common.slices(counted.tobytes(), edges),
                    pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()),
                ],
                names,
            )
        if kinds is not None:
            some = np.arange(0, SLOTS, RANGE)
            none = [pa.nulls(len(some), t) for t in (*[pa.int64()] * 3, kinds, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
            task = np.full(len(some), TaskContext.get().partitionId())
            packed = [common.squeeze(counts[k : k + RANGE].astype(np.uint32)) for k in some]
            yield pa.RecordBatch.from_arrays([*none, pa.array(task), pa.array(some // RANGE), pa.array(packed, pa.binary())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("rid", "tid", "also", "doc_id", "text").mapInArrow(
        common.tidy(run),
        f"rid bigint, tid bigint, also bigint, doc_id {kind}, fp bigint, n bigint, bands array<bigint>, sketch binary, "
        "task bigint, range bigint, seen binary",
    )


def slot_counts(marked: DataFrame) -> np.ndarray:
    """How many hashes of all sets fall in each slot: a table of fixed size, a row per range and task added up by a tree."""

    def added(kind: type):
        def run(table: pa.Table) -> pa.Table:
            total = np.zeros(RANGE, np.int64)
            for seen in table.column("seen").to_pylist():
                total += common.expand(seen, kind)[0]
            return pa.table({"task": table.column("task").slice(0, 1), "range": table.column("range").slice(0, 1), "seen": pa.array([common.squeeze(total)], pa.binary())})

        return common.tidied(run)

    rows, kind = marked.where("range is not null").select("task", "range", "seen"), np.uint32
    tasks = (rows.agg(F.max("task").alias("last")).first()["last"] or 0) + 1
    while kind is np.uint32 or tasks > 1:  # at most FAN rows of a range are added up together
        groups = rows.withColumn("task", F.expr(f"task div {FAN}")).groupBy("range", "task")
        rows, kind = groups.applyInArrow(added(kind), "task bigint, range bigint, seen binary"), np.int64
        tasks = -(-tasks // FAN)
    out = np.zeros(SLOTS, np.int64)
    got = rows.toArrow()
    for k, seen in zip(got.column("range").to_pylist(), got.column("seen").to_pylist(), strict=True):
        out[k * RANGE : (k + 1) * RANGE] = common.expand(seen, np.int64)[0]
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, words: int) -> DataFrame:
    """token, tid, n (size of the set), pos (place of the token), many: what similar sets share one of.

    Where many is false no more than HOT texts hold the token; where it is true there may be more. A task remembers the
    hashes of the texts that it has sent, some bytes a text of its stretch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = shared.value, set()
        for part in _chunks(batches):
            tids = part.column("tid").to_pylist()
            new = []
            for k, t in enumerate(tids):
                if t not in sent:
                    sent.add(t)
                    new.append(k)
            part = part.take(pa.array(new, pa.int64()))
            h, n = shingle_sets(part.column("text").to_pylist(), words)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, table[_slot(h)], doc))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            take = n - (PART * n + WHOLE - 1) // WHOLE + 1
            first = np.flatnonzero(pos < np.repeat(take, n))
            tid = part.column("tid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[order][first].view(np.int64)), pa.array(tid[doc[first]]), pa.array(n[doc[first]].astype(np.int32)),
                    pa.array(pos[first].astype(np.int32)), pa.array(table[_slot(h[order][first])] > HOT),
                ],
                ["token", "tid", "n", "pos", "many"],
            )

    return docs.select("tid", "text").mapInArrow(common.tidy(run), "token bigint, tid bigint, n int, pos int, many boolean")


def bucket_pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of texts (u < v) of one cell that are of different root and side and may be similar; rows are MET."""
    key, tid, root, n, pos, side = rows[:, :4], *rows[:, 4:].T
    order = np.lexsort((tid, root, *key.T[::-1]))
    key, tid, root, n, pos, side = key[order], tid[order], root[order], n[order], pos[order], side[order]
    if not len(tid):
        return
    other = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
    once = other | np.r_[True, tid[1:] != tid[:-1]]  # a text comes once from each task
    tid, root, n, pos, side = tid[once], root[once], n[once], pos[once], side[once]
    cell = np.cumsum(other)[once]

    def ends(head: np.ndarray) -> np.ndarray:
        """For each row the end of the stretch of rows that starts at a head."""
        at = np.flatnonzero(head)
        return np.repeat(np.r_[at[1:], len(tid)], np.diff(np.r_[at, len(tid)]))

    new = np.r_[True, cell[1:] != cell[:-1]]
    first, last = ends(new | np.r_[True, root[1:] != root[:-1]]), ends(new)
    after = last - first  # partners of a row: the other roots after its own
    total, done = np.cumsum(after), 0
    while done < len(tid):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + ROWS, "right")))
        m = after[done:stop]
        p = np.repeat(np.arange(done, stop), m)
        q = first[p] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        least = (PART * (n[p] + n[q]) + PART + WHOLE - 1) // (PART + WHOLE)  # common hashes needed
        most = np.minimum(n[p] - pos[p], n[q] - pos[q])
        fit = (most >= least) & (WHOLE * np.minimum(n[p], n[q]) >= PART * np.maximum(n[p], n[q]))
        fit &= (side[p] < 0) | (side[p] != side[q])
        if fit.any():
            yield np.unique(np.sort(np.stack([tid[p[fit]], tid[q[fit]]], 1), axis=1), axis=0)
        done = stop


MET = ["token", "low", "a", "b", "tid", "root", "n", "pos", "side"]  #: cell (first four), text, and its side of the cell


def cells(rows: DataFrame) -> DataFrame:
    """The rows (token, tid, root, n, pos, many) with the cells where they meet others, as MET.

    A token of up to HOT rows is one cell. Of others each size class is dealt by the text's hash to pieces of about CELL
    rows. A cell takes two pieces of a class, or one of a class and one of the next; only rows of different sides are
    compared there, and the cell of a piece with itself has no sides (-1).
    """
    rows = rows.withColumn("class", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int"))
    pieces = F.struct("class", F.ceil(F.col("count") / CELL).cast("int").alias("pieces"))
    hot = (
        rows.where("many").groupBy("token", "class").count()
        .groupBy("token").agg(F.sum("count").alias("all"), F.map_from_entries(F.collect_list(pieces)).alias("of"))
        .where(F.col("all") > HOT).select("token", "of", F.explode("of").alias("class", "own"))
        .select("token", "class", "own", *(F.coalesce(F.col("of")[F.col("class") + k], F.lit(0)).alias(c) for c, k in (("under", -1), ("over", 1))))
    )
    met = rows.join(common.broadcast_if_small(hot), ["token", "class"], "left")
    mine = F.pmod(F.xxhash64("tid", "token"), F.col("own")).cast("int")

    def cell(low: Column, a: Column, b: Column, side: Column) -> Column:
        return F.struct(low.cast("int").alias("low"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))

    def each(count: str, make) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.col(count)), lambda k: k < F.col(count)), make)

    same = each("own", lambda k: cell(
        2 * F.col("class"), F.least(mine, k), F.greatest(mine, k), F.when(mine == k, -1).otherwise((mine > k).cast("int"))
    ))
    over = each("over", lambda k: cell(2 * F.col("class") + 1, mine, k, F.lit(0)))
    under = each("under", lambda k: cell(2 * F.col("class") - 1, k, mine, F.lit(1)))
    alone = F.array(cell(F.lit(-1), F.lit(0), F.lit(0), F.lit(-1)))
    where = F.when(F.col("own").isNull(), alone).otherwise(F.concat(same, over, under))
    return met.withColumn("cell", F.explode(where)).select("token", "cell.low", "cell.a", "cell.b", "tid", "root", "n", "pos", "cell.side")


def meetings(rows: DataFrame) -> DataFrame:
    """u < v: texts of different root that share a token and may be similar by size and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, MET, 4):
            for found in bucket_pairs(whole):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["u", "v"])

    dealt = cells(rows).select(MET).repartition(*MET[:4]).sortWithinPartitions(*MET[:4])
    return dealt.mapInArrow(common.tidy(run), "u bigint, v bigint").distinct()


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches do not rule similarity out; no similar pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("n_u", "n_v", "sketch_u", "sketch_v"))
            ok = [may_share(p, q, (PART * (n + m) + PART + WHOLE - 1) // (PART + WHOLE)) for n, m, p, q in zip(a, b, x, y, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    side = [nodes.select(F.col("tid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("u", "v")]
    both = pairs.join(side[0], "u").join(side[1], "v").where(f"{WHOLE} * least(n_u, n_v) >= {PART} * greatest(n_u, n_v)")
    return both.select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(common.tidy(run), "u bigint, v bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) whose whole texts are similar."""
    pairs = common.materialize(possible(pairs, nodes), "near-pairs")
    named = pairs.select(F.col("u").alias("tid")).union(pairs.select("v")).distinct()
    texts = common.keep_keys(docs.select("tid", "text"), named, ["tid"]).groupBy("tid").agg(F.first("text").alias("text"))
    both = pairs.join(texts.select(F.col("tid").alias("u"), F.col("text").alias("a")), "u").join(
        texts.select(F.col("tid").alias("v"), F.col("text").alias("text")), "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            x, nx = shingle_sets(part.column("a").to_pylist(), words)
            y, ny = shingle_sets(part.column("text").to_pylist(), words)
            # a hash that both sets of a pair hold stands twice
            pair = np.r_[np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)]
            h = np.r_[x, y]
            order = np.lexsort((h, pair))
            h, pair = h[order], pair[order]
            twice = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
            shared = np.bincount(pair[1:][twice], minlength=len(nx))
            kept = pa.array(WHOLE * shared >= PART * (nx + ny - shared))
            yield part.select(["u", "v"]).filter(kept)

    return both.select("u", "v", "a", "text").mapInArrow(common.tidy(run), "u bigint, v bigint")


def first_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """u, v: texts of near fingerprints (BK-trees), and each text with the middle one of its bands.

    The middle one has the fingerprint nearest to the majority of bits: of many copies that differ from each other it is
    the one that most are similar to, so that a group becomes one component without all its pairs.
    """
    prints = nodes.groupBy("fp").agg(F.min("tid").alias("first"))
    near = simhash_dedup.link(common.materialize(prints.select("fp"), "near-prints"), radius)
    u, v = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")) for x in ("u", "v"))
    trees = near.join(u, "u").join(v, "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    same = nodes.join(prints, "fp").where("tid <> first").select(F.col("first").alias("u"), F.col("tid").alias("v"))
    bands = nodes.select("tid", "fp", F.posexplode("bands").alias("band", "least"))
    bit = lambda b: F.shiftright("fp", b).bitwiseAND(F.lit(1))
    shared = bands.groupBy("band", "least").agg(F.count(F.lit(1)).alias("n"), *(F.sum(bit(b)).alias(f"b{b}") for b in range(64))).where("n > 1")
    common_bits = functools.reduce(Column.bitwiseOR, (F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(simhash_dedup.signed(1 << b))).otherwise(F.lit(0).cast("bigint")) for b in range(64)))
    met = bands.join(shared.select("band", "least", common_bits.alias("middle")), ["band", "least"])
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    heads = met.groupBy("band", "least").agg(F.min(F.struct(away.alias("away"), "tid", "fp")).alias("head"))
    stars = bands.join(heads, ["band", "least"]).where(
        (F.col("head.tid") != F.col("tid")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head.fp"))) <= FAR)
    )
    return trees.union(same).union(stars.select(F.col("head.tid").alias("u"), F.col("tid").alias("v"))).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """rid, also, tid, doc_id, root of every row of docs: rid is a hash of the whole row, tid and also are hashes of its
    text, root names its group."""
    rows = with_hashes(docs, id_col, text_col)
    marked = common.materialize(signed(rows, words), "near-signed")
    signs = marked.where("range is null").select("rid", "tid", "also", "doc_id", "fp", "n", "bands", "sketch")
    nodes = common.materialize(signs.select("tid", "also", "fp", "n", "bands", "sketch").dropDuplicates(["tid", "also"]), "near-nodes")
    shared = common.materialize(nodes.groupBy("tid").count().where("count > 1").select("tid"), "near-shared")
    if not shared.isEmpty():
        rows, signs, nodes = (apart(x, shared) for x in (rows, signs, nodes))
    first = common.materialize(verified(first_pairs(nodes, radius), nodes, rows, words), "near-first")
    roots = common.broadcast_if_small(components(first).withColumnRenamed("node", "tid"))
    tokens = prefixes(rows, slot_counts(marked), words).join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    rest = verified(meetings(common.materialize(tokens, "near-tokens")), nodes, rows, words)
    found = components(common.materialize(first.union(rest), "near-links")).withColumnRenamed("node", "tid")
    return signs.select("rid", "also", "tid", "doc_id").join(found, "tid", "left").withColumn("root", F.coalesce("root", "tid"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def with_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, tid, also (hashes of the row, of the text, and of the text by another seed), doc_id, text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.xxhash64(*docs.columns).alias("rid"), text_hash(text).alias("tid"), F.xxhash64(F.lit(1), text).alias("also"),
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
    )


def apart(df: DataFrame, shared: DataFrame) -> DataFrame:
    """df with another tid, made of both hashes, where a tid stands for different texts (shared)."""
    named = df.join(common.broadcast_if_small(shared.withColumn("twofold", F.lit(True))), "tid", "left")
    return named.withColumn("tid", F.when(F.col("twofold"), F.xxhash64("tid", "also")).otherwise(F.col("tid"))).drop("twofold")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group with all its columns: that with the smallest id (null last), then text hash, then row hash.

    Rows that are equal in every column count as one. No text is lost but to a similar one, and the choice does not
    depend on the order of tasks. Rows are told apart by 128 bits, a hash of the row and one of the text.
    """
    grouped = common.materialize(near_copies(docs, id_col, text_col), "near-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tid", "rid", "also")
    best = grouped.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    large = best.where("n > 1")
    member = grouped.join(large, "root")
    gone = member.where("rid <> best.rid or also <> best.also").select("rid", "also").distinct()
    twice = member.where("rid = best.rid and also = best.also").groupBy("rid", "also").count().where("count > 1").select("rid", "also")  # equal rows
    keys = [_free(docs, c) for c in ("_rid", "_also")]
    named = docs.withColumns({keys[0]: F.xxhash64(*docs.columns), keys[1]: F.xxhash64(F.lit(1), F.coalesce(F.col(text_col), F.lit("")))})
    kept = common.drop_keys(named, gone.union(twice).toDF(*keys), keys)
    once = common.keep_keys(named, twice.toDF(*keys), keys).dropDuplicates(keys)
    return kept.unionByName(once).drop(*keys)


def _free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name
