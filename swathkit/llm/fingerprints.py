"""Canonical exact fingerprints, native to Spark SQL.

canonical() composes a text to Unicode NFC, folds case, composes again and folds white space; fingerprint() is a wide
(128-bit) xxhash of the canonical text. exact_classes() groups the texts of repeated fingerprints by
fingerprint and canonical bytes together: the hash deals the rows, and Spark's grouping compares the bytes inside
equal buckets, so a collision of hashes cannot join different texts. Partial aggregation folds copies before the
shuffle.

compare_neighbours() sets each document beside the next one in id order and beside its own edited text.
Documents are dealt to ranges of ids (bounds from approximate percentiles, at most MAX_RANGES); the first
document of each range is also put at the end of the range before it, so one window per range is enough.

Everything is DataFrame functions; normalisation and case folding are ICU's, which Spark ships, by
java_method. Null text counts as empty. Rows without an id have no place in the order and stand beside
themselves; rows that repeat an id follow each other in the order of a hash of their texts. An empty
table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.llm import common

RANGE_BYTES = 16 << 20  #: text bytes per range of ids
MAX_RANGES = 65_536
BROADCAST_FINGERPRINTS = 500_000  #: repeated fingerprints (32 bytes each) that are broadcast


def canonical(text: Column) -> Column:
    """NFC, case folded, composed again (folding may take letters apart), white space folded; null is ''."""
    text = F.coalesce(text, F.lit(""))
    nfc = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfc, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(False))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII is its own NFC
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), r"[\s\p{Z}\x{85}]+", " "))


def fingerprint(canonical_text: Column) -> Column:
    """32 hex digits: xxhash64 of the text and of the text after a fixed word."""
    halves = (F.xxhash64(canonical_text), F.xxhash64(F.lit("wide"), canonical_text))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def likeness(a: Column, b: Column) -> Column:
    """Of exact fingerprints: 1 if equal, else 0."""
    return F.when(a == b, 1.0).otherwise(0.0)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint, canonical_sha256, class_id (smallest id), n_docs of each class in buckets of two or more texts.

    Fingerprints are counted first; only texts of repeated fingerprints are shuffled to have their bytes compared. The
    repeated fingerprints filter the scan by a broadcast if they are at most BROADCAST_FINGERPRINTS, else by a join.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("canonical"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("canonical")))
    counted = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    repeated = common.materialize(counted, "repeated-fingerprints")
    few = repeated.count() <= BROADCAST_FINGERPRINTS
    shared = rows.join(F.broadcast(repeated) if few else repeated, "fingerprint", "left_semi")
    return (
        shared.groupBy("fingerprint", "canonical")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"))
        .select("fingerprint", F.sha2("canonical", 256).alias("canonical_sha256"), "class_id", "n_docs")
    )


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= value, looked up in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.array(*(F.lit(x[0]) for x in fine)), lambda b: b <= value))
    own = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in fine)), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(own, lambda b: b <= value)))


def marked(rows: DataFrame) -> DataFrame:
    """Adds fingerprint and canonical_sha256; the canonical text is made once and dropped."""
    made = rows.withColumn("canonical", canonical(F.col("text")))
    return made.withColumns(
        {"fingerprint": fingerprint(F.col("canonical")), "canonical_sha256": F.sha2("canonical", 256)}
    ).drop("canonical")


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, the columns of marked(), and next_text and next_fingerprint of the next document by id."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed, loose = rows.where("doc_id is not null"), rows.where("doc_id is null")
    n = min(MAX_RANGES, 1 + common.text_bytes(rows) // RANGE_BYTES)
    bounds: list[int] = []
    if n > 1:
        shares = F.array(*(F.lit(k / n) for k in range(1, n)))
        found = placed.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n)).alias("b")).first()["b"]
        bounds = sorted(set(found or []))
    placed = placed.withColumn("range", range_of(F.col("doc_id"), bounds))
    firsts = sorted((r["range"], r["first"]) for r in placed.groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    before = [firsts[k - 1][0] for k in range(len(firsts))]  # the very first document follows the last
    pairs = docs.sparkSession.createDataFrame(
        [(doc_id, k) for (_, doc_id), k in zip(firsts, before, strict=True)], "doc_id bigint, range int"
    )
    guests = (
        placed.drop("range").join(F.broadcast(pairs), "doc_id").groupBy("doc_id", "range")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    order = W.partitionBy("range").orderBy("guest", "doc_id", F.xxhash64("text"))
    names = ("text", "fingerprint")
    held = marked(both).withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).where(~F.col("guest"))
    alone = marked(loose).withColumns({f"next_{c}": F.col(c) for c in names})
    return held.select(alone.columns).unionByName(alone)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; and likeness to the next document.

    The edited text has the last quarter of the code points (rounded down) replaced by as many from the start of
    the next document, or all of it if it is shorter. edited is that text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = beside_next(rows)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    return (
        pairs.withColumns({"n_chars": n.cast("bigint"), "edited": edited})
        .withColumn("edited_canonical", canonical(F.col("edited")))
        .withColumn("edited_fingerprint", fingerprint(F.col("edited_canonical")))
        .select(
            "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
            "canonical_sha256",
        )
    )


def with_classes(compared: DataFrame, classes: DataFrame) -> DataFrame:
    """Add class_id and n_docs of each document's class to rows of compare_neighbours(); a text alone is its own class."""
    return (
        compared.join(classes, ["fingerprint", "canonical_sha256"], "left")
        .withColumns({"class_id": F.when(F.col("n_docs").isNull(), F.col("doc_id")).otherwise(F.col("class_id")), "n_docs": F.coalesce("n_docs", F.lit(1))})
        .drop("canonical_sha256")
    )
