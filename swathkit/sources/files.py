"""Readers and writers with declared schemas, allow-lists and digests; all by Spark, so any Hadoop path works."""

from __future__ import annotations

import json
import tempfile
import tomllib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.operators.contracts import ContractError, require_columns, require_count, require_exact_columns, require_finite, require_unique


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a temporary folder, of local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ContractError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="swathkit-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read back: made once, whatever reads it or is lost later."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, allowed: set[str] | None = None) -> DataFrame:
    """CSV (plain or gzip) with a header and a declared schema; columns outside the allow-list are refused before any read."""
    if allowed is not None and (extra := set(columns or []) - allowed):
        raise ContractError(f"columns not allowed: {sorted(extra)}")
    df = spark.read.schema(schema).option("header", True).csv(path)
    return require_columns(df, columns).select(*columns) if columns else df


def read_columns(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Parquet columns, with a filter that reaches the scan."""
    df = require_columns(spark.read.parquet(path), columns)
    return (df.where(where) if where else df).select(*columns)


def read_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], names: tuple[str, str, str, str]) -> DataFrame:
    """Rows whose bounding-box columns (minx, miny, maxx, maxy) meet the box, by pushed comparisons."""
    x0, y0, x1, y1 = (F.col(c) for c in names)
    return spark.read.parquet(path).where((x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1]))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties (JSON text), kind and coordinates (JSON text) of each feature of a collection."""
    shape = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    doc = spark.read.text(path, wholetext=True)  # Spark's multi-line reader reads a document again for each nested text
    f = doc.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    return f.select("f.properties", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates")


def read_geojson_points(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """properties, x, y of the points of a feature collection that lie in the box (minx, miny, maxx, maxy)."""
    xy = F.from_json("coordinates", "array<double>")
    points = read_geojson(spark, path).where("kind = 'Point'").select("properties", xy[0].alias("x"), xy[1].alias("y"))
    return points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def write_geojson(features: DataFrame, path: str, feature: str, part: str) -> None:
    """Feature collections, a document for each value of `part` (keep them small: a document is one row)."""
    docs = features.groupBy(part).agg(F.concat_ws(",", F.collect_list(feature)).alias("all"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}"))
    docs.select(part, text.alias("value")).write.partitionBy(part).text(path)  # a document has a file of its own


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; a NaN or infinite number is an error, since JSON has none."""
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
    if numbers:
        require_finite(df, numbers, nulls=True)
    df.write.json(path)


def replayed_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded pages (page, items, hits): items of each page, and complete: whether all pages hold as many as announced."""
    pages = spark.read.schema(schema).json(path).withColumn("n", F.size("items").cast("bigint"))
    whole = pages.agg(F.sum("n").alias("__got"), F.max("hits").alias("__hits"), F.min("hits").alias("__low"))  # one row
    return pages.join(F.broadcast(whole)).withColumn("complete", (F.col("__got") == F.col("__hits")) & (F.col("__low") == F.col("__hits")))


def read_protocol(spark: SparkSession, path: str, decision_id: str) -> dict:
    """A frozen YAML protocol; another decision id than the frozen one is an error."""
    try:
        import yaml
    except ImportError as e:
        raise ContractError("reading a YAML protocol needs PyYAML") from e
    protocol = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(protocol, dict) or protocol.get("decision_id") != decision_id:
        raise ContractError(f"not the frozen protocol {decision_id}")
    return protocol


def read_domain(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Features of a domain file whose canonical text (sorted features) has the digest; a changed one is an error."""
    features = read_geojson(spark, path)
    lines = F.array_sort(F.collect_list(F.to_json(F.struct("properties", "kind", "coordinates"))))
    if features.agg(F.sha2(F.concat_ws("\n", lines), 256)).first()[0] != sha256:  # a domain has few features
        raise ContractError(f"{path} is not the domain that was frozen")
    return features


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_config(spark: SparkSession, path: str, required: set[str]) -> dict:
    """A small TOML or JSON settings file; missing keys are an error."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    config = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    if missing := required - config.keys():
        raise ContractError(f"missing settings: {sorted(missing)}")
    return config


def listed_files(spark: SparkSession, path: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """path, length and the regex groups of file names below a folder."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    groups = {f: F.regexp_extract(name, pattern, k).try_cast(kind) for k, (f, kind) in enumerate(fields.items(), 1)}
    return names.where(name.rlike(pattern)).withColumns(groups)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 over the sorted names and digests of a folder of few files."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "name", "sha256")))
    return digests(spark, path).agg(F.sha2(F.concat_ws("\n", lines), 256)).first()[0]


class FrozenReader:
    """Reads only paths whose digests were frozen, and refuses a file that has changed since."""

    def __init__(self, spark: SparkSession, frozen: dict[str, str]):
        self.spark, self.frozen, self.read_paths = spark, frozen, []

    def parquet(self, path: str) -> DataFrame:
        if path not in self.frozen:
            raise ContractError(f"{path} was not frozen")
        if tree_digest(self.spark, path) != self.frozen[path]:
            raise ContractError(f"{path} has changed")
        self.read_paths.append(path)
        return self.spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], key: list[str], n_rows: int | None = None, digits: int = 6) -> None:
    """CSV of exactly these columns in order, doubles rounded, after checks of key and row count."""
    require_unique(df, key)
    if n_rows is not None:
        require_count(df, n_rows)
    kinds = dict(df.dtypes)
    out = require_exact_columns(df, columns).select(*(F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns))
    out.write.option("header", True).csv(path)


def write_cells(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet in folders by (city, pass) or the like; a small folder has one file, a large one is written by several tasks."""
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)


def resume_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it is the one that was finished there, otherwise made and written there.

    A finished table has its digest beside it; a table without one, or another one than was finished, is made again.
    """
    done = f"{path}.sha256"
    try:
        frozen = [r[0] for r in spark.read.text(done).collect()]
        if frozen == [tree_digest(spark, path)]:
            return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(tree_digest(spark, path),)], "value string").coalesce(1).write.mode("overwrite").text(done)
    return spark.read.parquet(path)
