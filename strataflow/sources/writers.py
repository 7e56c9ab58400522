"""Sinks: partitioned tables, ASCII grids, provenance sidecars."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cube(df: DataFrame, path: str, month: str = "month") -> None:
    """A (month, row, col, value) table, a directory for each month."""
    df.write.mode("overwrite").partitionBy(month).parquet(path)


def write_tree(nodes: dict[str, DataFrame | None], path: str) -> None:
    """A table per node under one folder; nodes that are None are left out."""
    for name, df in nodes.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def described(df: DataFrame, column: str, **attributes: str) -> DataFrame:
    """The column with metadata such as long_name and units."""
    return df.withMetadata(column, attributes)


def ascii_lines(grid: DataFrame, value: str, x0: float, y0: float, res: float, nodata: float = -9999.0) -> DataFrame:
    """line, text: header and rows of an ESRI ASCII grid; a row is one line, so a task holds single rows only."""
    size = grid.agg((F.max("col") + 1).alias("ncols"), (F.max("row") + 1).alias("nrows")).first()
    rows = grid.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce(F.col(value), F.lit(nodata)).alias("v")))).alias("c"))
    body = rows.select((F.col("row") + 6).cast("int").alias("line"), F.array_join(F.transform("c", lambda x: x["v"].cast("string")), " ").alias("text"))
    head = [f"ncols {size.ncols}", f"nrows {size.nrows}", f"xllcorner {x0}", f"yllcorner {y0}", f"cellsize {res}", f"NODATA_value {nodata}"]
    return grid.sparkSession.createDataFrame(list(enumerate(head)), "line int, text string").unionByName(body)


def write_ascii_grid(grid: DataFrame, value: str, path: str, x0: float, y0: float, res: float, nodata: float = -9999.0) -> None:
    """One file; meant for the export of a grid that one reader can hold."""
    lines = ascii_lines(grid, value, x0, y0, res, nodata).repartitionByRange(1, "line").sortWithinPartitions("line")
    lines.select("text").write.mode("overwrite").text(path)


def provenance(df: DataFrame, **fields: str) -> DataFrame:
    """One JSON row: the given fields, the row count and the columns."""
    stats = df.agg(F.count("*").alias("rows"))
    return stats.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], "rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns"))).alias("value"))


def catalogue_item(name: str, data: str, box: tuple[float, float, float, float], fields: dict[str, object], start: str, end: str | None = None, sigma: str | None = None, kind: str = "application/vnd.apache.parquet") -> dict:
    """A catalogue item (a GeoJSON feature) of a product: its outline in degrees, times, properties and assets."""
    w, s, e, n = box
    if not (w <= e and s <= n):
        raise ValueError(f"box {box} is not west, south, east, north")
    times = {"datetime": start} | ({"start_datetime": start, "end_datetime": end} if end else {})
    assets = {"data": {"href": data, "type": kind, "roles": ["data"]}} | ({"uncertainty": {"href": sigma, "type": kind, "roles": ["uncertainty"]}} if sigma else {})
    ring = [[w, s], [e, s], [e, n], [w, n], [w, s]]
    return {"type": "Feature", "stac_version": "1.0.0", "id": name, "bbox": [w, s, e, n], "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": times | fields, "links": [], "assets": assets}


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document as a text of one line."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: The canonical name and unit of each field that a bundle may hold.
CANONICAL = {"water_table": ("soil__water_table_depth", "m"), "saturation": ("soil__saturation_fraction", "-"), "recharge": ("soil__mean_recharge", "mm/d"), "moisture": ("soil__moisture_content", "m3/m3")}


def write_bundle(fields: list[dict], path: str, x0: float, y0: float, res: float, native: float, note: str = "") -> dict:
    """Grids of one raster as ASCII files under their canonical names, with the standard deviations beside them, and a manifest; returns the manifest.

    A field has key, epoch, grid(row, col, value[, sigma]); other entries go to the manifest. An unknown key, or two fields of one
    name and epoch, end it before anything is written.
    """
    stems = [f"{CANONICAL[f['key']][0]}__{f['epoch']}" if f["key"] in CANONICAL else None for f in fields]
    if None in stems:
        raise ValueError(f"unknown field {fields[stems.index(None)]['key']!r}; there are {sorted(CANONICAL)}")
    if len(set(stems)) < len(stems):
        raise ValueError("two fields of one name and epoch")
    entries, spark = [], None
    for f, stem in zip(fields, stems):
        grid, (name, unit) = f["grid"], CANONICAL[f["key"]]
        spark = grid.sparkSession
        write_ascii_grid(grid, "value", f"{path}/{stem}.asc", x0, y0, res)
        spread = "sigma" in grid.columns
        if spread:
            write_ascii_grid(grid, "sigma", f"{path}/{stem}_std.asc", x0, y0, res)
        rest = {k: v for k, v in f.items() if k not in ("key", "epoch", "grid")}
        entries.append({"key": f["key"], "canonical_name": name, "units": unit, "epoch": f["epoch"], "asc": f"{stem}.asc", "std_asc": f"{stem}_std.asc" if spread else None,
                        "native_resolution_m": native, "export_resolution_m": res, "resampled": abs(res - native) > 1e-6, **rest})
    manifest = {"crs": "EPSG:5070", "native_resolution_m": native, "export_resolution_m": res, "note": note, "fields": entries}
    if spark is not None:
        write_json(spark, manifest, f"{path}/manifest")
    return manifest
