"""Readers of landed files, one per format. All are lazy scans; service payloads are landed first and parsed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Qualifier texts of the readings service and the status letters they stand for.
QUALIFIERS = {
    "static": "", "pumping": "P", "dry": "D", "flowing": "F", "obstructed": "O", "recently pumped": "R",
    "recently flowing nearby": "E", "nearby recently flowing": "G", "injecting": "I", "discontinued": "N", "foreign substance": "V", "other": "Z",
}


def status_code(qualifiers: Column) -> Column:
    """The first non-blank status letter of an array of qualifier texts; '' if there is none."""
    table = F.create_map(*[F.lit(x) for pair in QUALIFIERS.items() for x in pair])
    codes = F.filter(F.transform(qualifiers, lambda x: F.coalesce(table[F.lower(F.trim(x))], F.lit(""))), lambda c: c != "")
    return F.coalesce(F.get(codes, 0), F.lit(""))


def state_files(spark: SparkSession, directory: str, suffix: str, states: list[str] | None = None) -> DataFrame:
    """All <state>_<suffix>.parquet files as one table with a state column."""
    df = spark.read.option("pathGlobFilter", f"*_{suffix}.parquet").parquet(directory)
    df = df.withColumn("state", F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)_{suffix}\.parquet$", 1))
    return df.filter(F.col("state").isin(states)) if states else df


def feature_collection(spark: SparkSession, directory: str) -> DataFrame:
    """site_no, time, value, qualifiers, lon, lat of GeoJSON feature collections, one file each."""
    schema = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<monitoring_location_id:string,time:string,value:string,qualifier:array<string>>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(directory)
    return raw.select(F.explode("features").alias("f")).select(
        F.trim("f.properties.monitoring_location_id").alias("site_no"),
        F.try_to_timestamp("f.properties.time").alias("time"),
        F.col("f.properties.value").try_cast("double").alias("value"),
        status_code(F.col("f.properties.qualifier")).alias("status"),
        F.col("f.geometry.coordinates")[0].alias("lon"),
        F.col("f.geometry.coordinates")[1].alias("lat"),
    )


def year_month_table(spark: SparkSession, path: str, missing: float = -90.0) -> DataFrame:
    """month, value of a text table with a year and twelve monthly values a line; values under `missing` are NULL."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).withColumn("w", words).filter(F.col("w")[0].rlike(r"^\d{4}$"))
    long = lines.select(F.col("w")[0].cast("int").alias("year"), F.posexplode(F.slice("w", 2, 12)).alias("k", "v"))
    value = F.col("v").try_cast("double")
    return long.select(F.make_date("year", F.col("k") + 1, F.lit(1)).alias("month"), F.when(value >= missing, value).alias("value"))


def station_series(spark: SparkSession, directory: str) -> DataFrame:
    """station, ts, value of *.stm text files: a header line, then 'yyyy/MM/dd HH:mm value ...'; values outside [0, 1] go."""
    raw = spark.read.option("pathGlobFilter", "*.stm").option("recursiveFileLookup", True).text(directory)
    w = F.split(F.trim("value"), r"\s+")
    rows = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.stm$", 1).alias("station"),
        F.try_to_timestamp(F.concat_ws(" ", F.get(w, 0), F.get(w, 1)), F.lit("yyyy/MM/dd HH:mm")).alias("ts"),
        F.get(w, 2).try_cast("double").alias("value"),
    )
    return rows.filter(F.col("ts").isNotNull() & F.col("value").between(0, 1))


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of an ESRI ASCII grid; its NODATA value is NULL. The file is one row, as a line's place in it counts; larger grids are flat binary ones (rasters)."""
    text = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\s*\n").alias("lines"))
    header = F.filter("lines", lambda x: x.rlike(r"^\s*[A-Za-z]"))
    body = F.filter("lines", lambda x: ~x.rlike(r"^\s*([A-Za-z]|$)"))
    nodata = F.transform(F.filter(header, lambda x: F.lower(x).startswith("nodata_value")), lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1).cast("double"))
    rows = text.select(F.get(nodata, 0).alias("nodata"), F.posexplode(body).alias("row", "line"))
    cells = rows.select("row", "nodata", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    v = F.col("v").cast("double")
    return cells.select("row", "col", F.when(F.col("nodata").isNull() | (v != F.col("nodata")), v).alias("value"))
