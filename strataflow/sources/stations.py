"""Landed payloads of station services: fixed-column texts and JSON answers as tables, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns (from 0) of the daily climate text with soil moisture, their depths and the thickness (cm) each stands for.
MOISTURE_COLUMNS = {18: (5.0, 7.5), 19: (10.0, 7.5), 20: (20.0, 20.0), 21: (50.0, 40.0), 22: (100.0, 50.0)}
#: Cubic metres in a cubic foot, square metres in a square mile, millimetres in an inch, metres in a foot.
CUBIC_FOOT, SQUARE_MILE, INCH, FOOT = 0.0283168466, 2.589988e6, 25.4, 0.3048

Box = tuple[float, float, float, float]


def within(box: Box, lon: Column, lat: Column) -> Column:
    """Whether a place lies in (west, south, east, north)."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def climate_stations(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """station (the key in file names), name, lat, lon, elev_m, status of the tab-separated station list; only stations that work."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    key = F.concat_ws("_", "STATE", F.regexp_replace("LOCATION", " ", "_"), F.regexp_replace("VECTOR", " ", "_"))
    lon, lat = F.col("LONGITUDE").try_cast("double"), F.col("LATITUDE").try_cast("double")
    rows = raw.select(key.alias("station"), F.col("NAME").alias("name"), lat.alias("lat"), lon.alias("lon"), F.col("ELEVATION").try_cast("double").alias("elev_m"), F.upper("STATUS").alias("status"))
    rows = rows.filter(F.col("status").isin("OPERATIONAL", "COMMISSIONED"))
    return rows.filter(within(box, F.col("lon"), F.col("lat"))) if box else rows


def climate_days(spark: SparkSession, path: str) -> DataFrame:
    """station, date, theta of daily texts <set>-<year>-<station>.txt: the mean of the sensors that have a value, by thickness.

    Values of -90 and less are missing; a day without any sensor, or whose date is none, is left out.
    """
    w = F.split(F.trim("value"), r"\s+")
    raw = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path)
    station = F.regexp_extract(F.col("_metadata.file_name"), r"^[^-]+-\d{4}-(.*)\.txt$", 1)
    rows = raw.select(station.alias("station"), F.to_date(F.try_to_timestamp(F.get(w, 1), F.lit("yyyyMMdd"))).alias("date"), *[F.get(w, k).try_cast("double").alias(f"_s{k}") for k in MOISTURE_COLUMNS])
    seen = {k: F.when(F.col(f"_s{k}") > -90, F.col(f"_s{k}")) for k in MOISTURE_COLUMNS}
    total = sum((F.coalesce(v * MOISTURE_COLUMNS[k][1], F.lit(0.0)) for k, v in seen.items()), F.lit(0.0))
    thick = sum((F.when(v.isNotNull(), MOISTURE_COLUMNS[k][1]).otherwise(0.0) for k, v in seen.items()), F.lit(0.0))
    return rows.select("station", "date", F.when(thick > 0, total / F.when(thick > 0, thick)).alias("theta")).filter("theta is not null and date is not null")


def monthly(daily: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """keys, month, value, days: means of the months with `least` values or more."""
    found = daily.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(F.avg(value).alias(value), F.count(value).alias("days"))
    return found.filter(F.col("days") >= least)


def snow_stations(spark: SparkSession, path: str, element: str, box: Box | None = None, network: str = "SNTL") -> DataFrame:
    """triplet, name, lat, lon, elev_m of the stations in JSON lists that report an element (SMS, WTEQ)."""
    schema = "stationTriplet string, name string, networkCode string, latitude double, longitude double, elevation double, stationElements array<struct<elementCode:string>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    rows = raw.filter((F.col("networkCode") == network) & F.exists("stationElements", lambda e: e["elementCode"] == element))
    rows = rows.filter(within(box, F.col("longitude"), F.col("latitude"))) if box else rows
    return rows.select(F.col("stationTriplet").alias("triplet"), "name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), (F.col("elevation") * FOOT).alias("elev_m")).dropDuplicates(["triplet"])


def snow_series(spark: SparkSession, path: str) -> DataFrame:
    """triplet, element, depth (inches, negative; null above ground), date, value of JSON answers of the data service."""
    schema = "stationTriplet string, data array<struct<stationElement:struct<elementCode:string,heightDepth:int>,values:array<struct<date:string,value:double>>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    each = raw.select(F.col("stationTriplet").alias("triplet"), F.explode("data").alias("d")).select("triplet", F.col("d.stationElement").alias("e"), F.explode("d.values").alias("v"))
    return each.select("triplet", F.col("e.elementCode").alias("element"), F.col("e.heightDepth").alias("depth"), F.to_date(F.try_to_timestamp("v.date")).alias("date"), F.col("v.value").alias("value")).filter("date is not null")


def station_theta(series: DataFrame, deepest: int = 20, least: int = 10, renormalise: bool = False) -> DataFrame:
    """triplet, month, theta, days of snow_series(): soil moisture of the root zone, weighted by depth, of months with `least` days.

    Values outside 0 to 60 % do not count. A station's sensors down to `deepest` inches are used, or all if it has none so shallow.
    Weights are shares of the station's sensors: a day that lacks some is low by theirs, unless renormalise. Days on which
    the shallowest sensor's soil temperature (STO) is 0 or less do not count.
    """
    moisture = series.filter((F.col("element") == "SMS") & F.col("value").between(0, 60))
    depths = moisture.groupBy("triplet", F.abs("depth").alias("_d")).agg(F.lit(1))
    by = Window.partitionBy("triplet")  # a few sensors a station
    used = depths.withColumn("_near", F.min("_d").over(by) <= deepest).filter(~F.col("_near") | (F.col("_d") <= deepest))
    used = used.select("triplet", "_d", F.sum("_d").over(by).alias("_all"), F.min("_d").over(by).alias("_top"))
    days = moisture.withColumn("_d", F.abs("depth")).join(used, ["triplet", "_d"]).groupBy("triplet", "date").agg(
        F.sum(F.col("value") * F.col("_d")).alias("_s"), F.sum("_d").alias("_seen"), F.max("_all").alias("_all"), F.max("_top").alias("_top")
    )
    theta = F.col("_s") / F.col("_seen" if renormalise else "_all") / 100
    frozen = series.filter((F.col("element") == "STO") & (F.col("value") <= 0)).select("triplet", "date", F.abs("depth").alias("_top")).distinct()
    return monthly(days.join(frozen, ["triplet", "date", "_top"], "left_anti").select("triplet", "date", theta.alias("theta")), ["triplet"], "theta", least)


def station_snow(series: DataFrame) -> DataFrame:
    """triplet, date, swe_mm, tmean_c, precip_mm of snow_series(): days with a snow water equivalent (inches and Fahrenheit before)."""

    def of(element: str) -> Column:
        return F.max(F.when(F.col("element") == element, F.col("value")))

    found = series.groupBy("triplet", "date").agg((of("WTEQ") * INCH).alias("swe_mm"), ((of("TAVG") - 32) * 5 / 9).alias("tmean_c"), (of("PRCP") * INCH).alias("precip_mm"))
    return found.filter("swe_mm is not null")


def gauge_values(spark: SparkSession, path: str, parameter: str = "00060") -> DataFrame:
    """site_no, date, value of the JSON answers of a daily-values service for one parameter; negative fill values are NULL."""
    schema = (
        "value struct<timeSeries:array<struct<sourceInfo:struct<siteCode:array<struct<value:string>>>,variable:struct<variableCode:array<struct<value:string>>>,"
        "values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>"
    )
    raw = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("value.timeSeries").alias("t"))
    rows = raw.filter(F.get("t.variable.variableCode", F.lit(0))["value"] == parameter).select(F.get("t.sourceInfo.siteCode", F.lit(0))["value"].alias("site_no"), F.explode("t.values").alias("v"))
    each = rows.select("site_no", F.explode("v.value").alias("x"))
    value = F.col("x.value").try_cast("double")
    return each.select("site_no", F.to_date(F.try_to_timestamp("x.dateTime")).alias("date"), F.when(value > -999_999, value).alias("value"))


def discharge_depth(values: DataFrame, areas: DataFrame) -> DataFrame:
    """site_no, date, q_mm_day, area_km2: cubic feet a second of values(site_no, date, value) over areas(site_no, area_sqmi); sites without an area are left out."""
    known = areas.filter(F.col("area_sqmi") > 0).select("site_no", (F.col("area_sqmi") * SQUARE_MILE).alias("_m2"))
    return values.join(known, "site_no").select("site_no", "date", (F.col("value") * CUBIC_FOOT * 86_400 / F.col("_m2") * 1000).alias("q_mm_day"), (F.col("_m2") / 1e6).alias("area_km2"))


def basin_rings(spark: SparkSession, path: str, key: str = "identifier") -> DataFrame:
    """code, rank, ring of the outer rings of GeoJSON polygons, one feature collection a file: what grid.cells_in_shapes() takes."""
    schema = f"features array<struct<properties:struct<`{key}`:string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    shapes = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", many)).otherwise(F.array(F.from_json("f.geometry.coordinates", one)))
    each = raw.select(F.regexp_replace(F.col(f"f.properties.`{key}`"), "^USGS-", "").alias("code"), F.posexplode(shapes).alias("rank", "polygon"))
    corners = F.transform(F.get("polygon", F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return each.select("code", "rank", corners.alias("ring")).filter("ring is not null")
