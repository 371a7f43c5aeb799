"""Sources: listing CSV files of either encoding, polygon GeoJSON, attribute CSV, slice JSON, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import LISTING, RAW, SLICE_COLUMNS


def listing_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path, encoding) of the listings_*.csv files in path order: a file whose bytes aren't all UTF-8 is Latin-1 as a
    whole. Bytes are judged where they are read; only names come back."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "listings_*.csv").load(folder)
    found = files.select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8")).collect()
    return sorted((r["path"], "UTF-8" if r["utf8"] else "ISO-8859-1") for r in found)


def raw_listings(spark: SparkSession, folder: str) -> DataFrame:
    """All rows as strings, with _file and _pos (place in the file). Columns go by header name: unknown ones are
    ignored, missing ones are null. Line breaks inside quotes are kept."""
    out = None
    for path, encoding in listing_files(spark, folder):
        lines = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
        names = {c.lstrip("﻿"): c for c in lines.columns}
        picked = [(F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None).cast("string")).alias(f.name) for f in RAW]
        one = lines.select(F.lit(path).alias("_file"), F.monotonically_increasing_id().alias("_pos"), *picked)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField("_file", T.StringType()), T.StructField("_pos", T.LongType()), *RAW]))


_POINTS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
GEOJSON = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("properties", T.StructType([T.StructField("CVEGEO", T.StringType()), T.StructField("NOM_MUN", T.StringType())])),
                        T.StructField("geometry", T.StructType([T.StructField("coordinates", _POINTS)])),
                    ]
                )
            ),
        )
    ]
)


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings of a FeatureCollection as (lat, lng), with their place in the file and their box."""
    rows = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("ordinal", "f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng")))
    return boxed(rows.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("f.properties.CVEGEO").alias("ageb_id"), F.col("f.properties.NOM_MUN").alias("municipio"), ring.alias("ring")))


def boxed(rows: DataFrame) -> DataFrame:
    """rows with the box of their ring."""
    return rows.withColumns({f"{end}_{axis}": pick(F.col(f"ring.{axis}")) for end, pick in (("min", F.array_min), ("max", F.array_max)) for axis in ("lat", "lng")})


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """(ageb_id, grade, index_value); of a repeated id the last row stays; an index that is no number raises."""
    rows = spark.read.option("header", True).csv(path).select("ageb_id", "grade", F.col("index_value").cast("double").alias("index_value"), F.monotonically_increasing_id().alias("_pos"))
    last = F.row_number().over(Window.partitionBy("ageb_id").orderBy(F.desc("_pos")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n", "_pos")


def slice_json(spark: SparkSession, path: str) -> DataFrame:
    """The explorer's slice from a JSON array."""
    head = spark.read.option("wholetext", True).text(path).select(F.substring(F.ltrim("value"), 1, 1)).first()
    if head is None or head[0] != "[":
        raise ValueError(f"listings at {path} are not an array")
    return spark.read.schema(T.StructType([LISTING[c] for c in SLICE_COLUMNS])).option("multiLine", True).json(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored listings table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"Database not found at {path!r}. Pass --db with the path of a stored table.")
    return spark.read.parquet(path)
