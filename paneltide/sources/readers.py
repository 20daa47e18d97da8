"""Readers for landed files. Every read has an explicit schema; keys stay text until chosen otherwise.

File-level facts (area, year, series name) come from the file path of one multi-file read, so a thousand small files are one scan.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.scalar import area_code, text_to_double
from paneltide.scale import small_side

FILE = "_metadata.file_path"


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8",
                   sep: str = ",") -> DataFrame:
    """Delimited text with a header row."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("sep", sep).csv(path)


def read_headerless(spark: SparkSession, path: str, names: Sequence[str], numbers: Sequence[str] = (),
                    missing: str = "-") -> DataFrame:
    """Headerless text with given names; ``missing`` marks an absent value."""
    raw = spark.read.schema(text_schema(names)).option("nullValue", missing).csv(path)
    return raw.withColumns({c: text_to_double(c) for c in numbers}) if numbers else raw


def read_positional(spark: SparkSession, path: str, width: int, keys: Mapping[str, int],
                    sums: Mapping[str, Sequence[int]]) -> DataFrame:
    """Columns picked by position; preamble and footer lines fall out because their key is no number.

    ``sums`` adds positions (for example the size classes of a unit count) into one measure.
    """
    raw = spark.read.schema(text_schema([f"_p{i}" for i in range(width)])).csv(path)
    first = next(iter(keys.values()))
    held = raw.filter(F.col(f"_p{first}").try_cast("int").isNotNull())
    total = {}
    for name, places in sums.items():
        value = F.lit(0.0)
        for p in places:
            value = value + F.coalesce(text_to_double(f"_p{p}"), F.lit(0.0))
        total[name] = value.alias(name)
    return held.select(*[F.trim(F.col(f"_p{p}")).alias(k) for k, p in keys.items()], *total.values())


def _array_items(spark: SparkSession, path: str, item: str, lines: bool) -> DataFrame:
    """file_name, start (where the scan's split begins), id, pos (rising together within a split) and ``r`` for each item of one JSON array per file.

    ``lines``: the scan splits a file at line ends, which no JSON string can hold, so a large array is read by many
    tasks a line at a time. A line holds one or more whole items; the brackets of the array itself and the commas between lines
    are taken off. A line of anything else is an error. Otherwise a document is one value, whatever its layout, for responses that are small by nature.
    """
    text = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True).select(
        F.trim("value").alias("v"), F.col(FILE).alias("file_name"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"))
    if lines:
        # an item is an object or an array of scalars: two brackets in a row are an item's and the array's own
        opened, closed = (r"^\[\s*(?=\[)", r"(?<=\])\s*\]$") if item.startswith("array") else (r"^\[", r"\]$")
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("v", r"^,\s*|\s*,$", ""), opened, ""), closed, "")
        bare = F.when(F.col("v").rlike(r"^[\[\],\s]*$"), "").otherwise(F.trim(bare))
        text = text.withColumn("v", bare).filter("v <> ''").withColumn("v", F.concat(F.lit("["), "v", F.lit("]")))
    items = F.from_json("v", f"array<{item}>")
    if lines:
        items = F.coalesce(items, F.raise_error(F.concat(F.lit("no whole JSON items in a line of "), "file_name")).cast(f"array<{item}>"))
    return text.select("file_name", "start", "id", F.posexplode(items).alias("pos", "r")).filter(F.col("r").isNotNull())


def read_json_matrix(spark: SparkSession, path: str, columns: Sequence[str], numbers: Sequence[str], lines: bool = False) -> DataFrame:
    """One JSON array of arrays per file whose first row is the header; columns are found by header name, in any order.

    ``lines``: whole rows on every line (see ``_array_items``). Each file's header is then found in the split that
    begins the file; a later row equal to the header is no data either.
    """
    if lines:
        rows = _array_items(spark, path, "array<string>", True)
        first = rows.filter("start = 0").groupBy("file_name").agg(F.min_by("r", F.struct("id", "pos")).alias("head"))
        body = rows.select("file_name", "r").join(small_side(first), "file_name").filter("r <> head")
    else:
        docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
            F.from_json("value", "array<array<string>>").alias("m"), F.col(FILE).alias("file_name"))
        body = docs.select("file_name", F.element_at("m", 1).alias("head"),
                           F.explode(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1)))).alias("r")).filter(
            F.col("r").isNotNull())
    at = lambda c: F.try_element_at("r", F.array_position("head", c).cast("int"))
    picked = body.select("file_name", *[at(c).alias(c) for c in columns])
    return picked.withColumns({c: text_to_double(c) for c in numbers})


def read_json_records(spark: SparkSession, path: str, area: str = "GeoFips", name: str = "GeoName",
                      period: str = "TimePeriod", value: str = "DataValue", lines: bool = False) -> DataFrame:
    """JSON records with thousands separators; whole-state rows (area code ending 000) are dropped.

    ``lines``: whole records on every line (see ``_array_items``).
    """
    fields = ", ".join(f"`{c}`: string" for c in (area, name, period, value))
    return (_array_items(spark, path, f"struct<{fields}>", lines).select("r.*").filter(F.substring(area, 3, 3) != "000")
            .select(F.col(area).alias("area"), F.col(name).alias("area_name"), F.col(period).alias("period"),
                    text_to_double(value).alias("value")))


def read_padded_tsv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Tab-separated text whose header names carry padding; ``columns`` maps trimmed name to type."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    by_name = {c.strip(): c for c in raw.columns}
    return raw.select(*[F.trim(F.col(f"`{by_name[c]}`")).try_cast(t).alias(c) for c, t in columns.items()])


def read_area_year_files(spark: SparkSession, path: str, schema: T.StructType,
                         pattern: str = r"([^/=]+)_(\d{4})\.csv") -> DataFrame:
    """One file per area and year, read as one scan; area and year come from the file name."""
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    return raw.select("*", F.regexp_extract(F.col(FILE), pattern, 1).alias("area"),
                      F.regexp_extract(F.col(FILE), pattern, 2).cast("int").alias("period"))


def read_series_files(spark: SparkSession, path: str, pattern: str = r"([^/=]+)\.csv") -> DataFrame:
    """One date-indexed series per file; '.' marks a missing observation."""
    raw = (spark.read.schema(text_schema(["date", "value"])).option("header", True)
           .option("recursiveFileLookup", True).csv(path))
    return raw.select(F.regexp_extract(F.col(FILE), pattern, 1).alias("series_id"),
                      F.to_date("date").alias("date"), text_to_double("value").alias("value")).filter(
        F.col("date").isNotNull() & F.col("value").isNotNull())


def read_wide_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Identifier columns plus one column per month end; the header names the months."""
    return spark.read.option("header", True).csv(path)


def read_bridge(spark: SparkSession, path: str, columns: Sequence[str], state: str, county: str, parent: str,
                title: str, kind: str, keep: str = "Metropolitan") -> DataFrame:
    """Child-to-parent bridge; footnote rows lack a numeric key, codes get their leading zeros back."""
    raw = spark.read.schema(text_schema(columns)).option("header", True).csv(path)
    held = raw.filter(F.col(state).try_cast("int").isNotNull() & F.col(county).try_cast("int").isNotNull()
                      & F.contains(F.col(kind), F.lit(keep)))
    return held.select(area_code(state, county).alias("child"), F.trim(F.col(parent)).alias("parent"),
                       F.trim(F.col(title)).alias("parent_title"))


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)
