"""Identity and text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: granule names end in _<orbit>_<scene>_<tile>_<yyyymmddThhmmss>_<build>_<revision>.
GRANULE = r"_(\d+)_(\d+)_([0-9A-Z]{5})_(\d{8}T\d{6})_(\d+)_(\d+)$"


def granule_fields(name: Column) -> Column:
    """Struct of orbit, scene, tile, stamp, build and revision; null where the name has another form."""
    part = [F.regexp_extract(name, GRANULE, k) for k in range(1, 7)]
    fields = F.struct(
        part[0].try_cast("int").alias("orbit"), part[1].try_cast("int").alias("scene"), part[2].alias("tile"),
        F.try_to_timestamp(F.nullif(part[3], F.lit("")), F.lit("yyyyMMdd'T'HHmmss")).alias("acquired"),
        part[4].try_cast("int").alias("build"), part[5].try_cast("int").alias("revision"),
    )
    return F.when(name.rlike(GRANULE), fields)


def split_from_end(text: Column, mark: str, place: int) -> Column:
    """The place-th part from the end (1 is the last); null if there are fewer."""
    return F.try_element_at(F.split(text, mark), F.lit(-place))


def plain_integer_text(text: Column) -> Column:
    """Without a trailing .0."""
    return F.regexp_replace(text, r"\.0$", "")


def utm_zone(tile: Column) -> Column:
    return F.regexp_extract(tile, r"^(\d{2})[C-X][A-Z]{2}$", 1).try_cast("int")


def block_key(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def coarser_block(block: Column, size: int) -> Column:
    """i_j in groups of size; division floors, also below zero."""
    part = F.split(block, "_")
    return F.concat_ws("_", *(F.floor(part[k].cast("double") / size).cast("string") for k in (0, 1)))


def padded_block(row: Column, col: Column) -> Column:
    return F.format_string("%04d_%04d", row, col)


def asset_name(url: Column) -> Column:
    """Second-last dot part of the file name in a url."""
    return split_from_end(F.element_at(F.split(F.split(url, r"\?")[0], "/"), -1), r"\.", 2)


def text_number(text: Column) -> Column:
    """Double of trimmed text; '', NA, nan, null and none are null."""
    clean = F.trim(text)
    return F.when(~F.lower(clean).isin("", "na", "nan", "null", "none"), clean.try_cast("double"))


def text_integer(text: Column) -> Column:
    """Whole numbers only."""
    number = text_number(text)
    return F.when(number == F.floor(number), number.cast("bigint"))


def text_boolean(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1")


def sector(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return F.concat(F.when(y >= cy, "N").otherwise("S"), F.when(x >= cx, "E").otherwise("W"))


def quadrant(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return (x >= cx).cast("int") + 2 * (y >= cy).cast("int")


def id_set(text: Column) -> Column:
    """Sorted distinct parts of a |-joined list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, r"\|"), F.trim), lambda x: x != "")))


def failed_criteria(criteria: dict[str, Column]) -> Column:
    """Names of the criteria that do not hold, joined by |; null counts as not holding."""
    return F.concat_ws("|", *(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in criteria.items()))


def zero_padded(code: Column, width: int) -> Column:
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def digest_of(ids: Column) -> Column:
    """SHA-256 of the ids of a group, sorted and joined by newlines; an aggregate."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(ids))), 256)
