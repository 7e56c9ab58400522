"""Grid and station queries: part as a grid of 40 columns, supplier as stations at hashed places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import spatial
from strataflow.plans.registry import query, read
from strataflow.session import checkpointed

GRID = "SELECT CAST(p_partkey // 40 AS INT) AS row, CAST(p_partkey % 40 AS INT) AS col, p_retailprice AS z, p_size AS hand, p_partkey AS cell FROM part"
POINTS = "SELECT s_suppkey AS pid, ((s_suppkey * 37) % 100) * 0.4::DOUBLE AS px, ((s_suppkey * 53) % 100) * 0.5::DOUBLE AS py, s_acctbal / 1000 AS v FROM supplier"
PAIRS = f"SELECT c.cell, c.col + 0.5::DOUBLE AS x, c.row + 0.5::DOUBLE AS y, p.*, sqrt((c.col+0.5::DOUBLE-px)*(c.col+0.5::DOUBLE-px)+(c.row+0.5::DOUBLE-py)*(c.row+0.5::DOUBLE-py)) AS d FROM ({GRID}) c, ({POINTS}) p"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        F.expr("p_partkey div 40").cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.col("p_retailprice").alias("z"), F.col("p_size").alias("hand"), k.alias("cell")
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(k.alias("pid"), (k * 37 % 100 * F.lit(0.4)).alias("px"), (k * 53 % 100 * F.lit(0.5)).alias("py"), (F.col("s_acctbal") / 1000).alias("v"))


def places(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pid, px, py, n of the different places of stations, each named by its least pid, and (pid, place) of all stations."""
    p = p.filter("pid is not null")
    at = checkpointed(p.groupBy("px", "py").agg(F.min("pid").alias("place"), F.count_distinct("pid").alias("n")))
    return at.select(F.col("place").alias("pid"), "px", "py", "n"), p.join(at, ["px", "py"]).select("pid", "place").distinct()


def pairs(spark: SparkSession, sf: str, reach: float) -> DataFrame:
    cells = grid(spark, sf).select("cell", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return spatial.near_pairs(cells, points(spark, sf), reach)


@query(f"SELECT pid, CAST(floor(51.0 - py) AS INT) AS row, CAST(floor(px) AS INT) AS col, z FROM ({POINTS}) JOIN ({GRID}) g ON g.row = floor(51.0 - py) AND g.col = floor(px)")
def point_cell_lookup(spark: SparkSession, sf: str) -> DataFrame:
    row, col = spatial.cell_of(F.col("px"), F.col("py"), 0.0, 51.0, 1.0)
    return points(spark, sf).withColumn("row", row).withColumn("col", col).join(grid(spark, sf), ["row", "col"]).select("pid", "row", "col", "z")


@query(f"SELECT row // 5 AS brow, col // 5 AS bcol, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, count(z) AS n FROM ({GRID}) GROUP BY ALL")
def block_mean(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.block_stats(grid(spark, sf), "z", 5).select(F.col("brow").cast("int").alias("brow"), F.col("bcol").cast("int").alias("bcol"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query(f"SELECT cell, round(stddev_pop(z) OVER (PARTITION BY row // 5, col // 5), 6) AS sigma FROM ({GRID})")
def block_std_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.block_broadcast(grid(spark, sf), "z", 5, "sigma").select("cell", F.round("sigma", 6).alias("sigma"))


STEPS = ", ".join(f"({k}, {i}, {j}, {2 ** 0.5 if i * j else 1.0!r}::DOUBLE)" for k, (i, j) in enumerate(spatial.D8))
D8_SQL = (
    f"WITH g AS ({GRID}), s(k, di, dj, dist) AS (VALUES {STEPS}), f AS (SELECT a.row, a.col, b.row AS nrow, b.col AS ncol, (a.z-b.z)/dist AS drp, k FROM g a, s, g b "
    "WHERE b.row = a.row + di AND b.col = a.col + dj AND a.z > b.z), t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY drp DESC, k) = 1) "
)


@query(D8_SQL + "SELECT g.row, g.col, g.z, t.nrow, t.ncol FROM g LEFT JOIN t USING (row, col)")
def d8_next(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.steepest_neighbour(grid(spark, sf), "z")


@query(
    D8_SQL.replace("WITH g", "WITH RECURSIVE g") + ", e AS (SELECT g.row*40+g.col AS node, CASE WHEN t.nrow IS NULL THEN g.row*40+g.col ELSE t.nrow*40+t.ncol END AS nxt FROM g LEFT JOIN t USING (row, col)), "
    "w AS (SELECT node, node AS here FROM e UNION ALL SELECT w.node, e.nxt FROM w JOIN e ON e.node = w.here WHERE e.nxt <> w.here) "
    "SELECT w.node, w.here AS root FROM w JOIN e ON e.node = w.here WHERE e.nxt = w.here"
)
def drainage_roots(spark: SparkSession, sf: str) -> DataFrame:
    d8 = spatial.steepest_neighbour(grid(spark, sf), "z")
    graph = d8.select((F.col("row") * 40 + F.col("col")).alias("node"), (F.col("nrow") * 40 + F.col("ncol")).alias("next"))
    return spatial.drain_to(graph, checkpointed)


@query(f"SELECT cell, count(*) AS n, round(min(d), 9) AS d_min, arg_min(pid, (d, pid)) AS nearest FROM ({PAIRS}) WHERE d <= 8 GROUP BY cell")
def knn_distance(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf, 8.0).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.min("d"), 9).alias("d_min"), F.min_by("pid", F.struct("d", "pid")).alias("nearest"))


@query(f"WITH m AS (SELECT cell, min(d) AS d FROM ({PAIRS}) GROUP BY cell) SELECT cell, CASE WHEN d <= 2 THEN 3 WHEN d <= 4 THEN 2 WHEN d <= 6 THEN 1 ELSE 0 END AS level FROM m")
def confidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    near = pairs(spark, sf, 6.0).groupBy("cell").agg(F.min("d").alias("d"))
    level = F.when(F.col("d") <= 2, 3).when(F.col("d") <= 4, 2).when(F.col("d") <= 6, 1).otherwise(0)
    return grid(spark, sf).select("cell").join(near, "cell", "left").select("cell", level.alias("level"))


@query(
    f"WITH w AS (SELECT cell, exp(-d*d/(2*4.0*4.0)) AS w, v FROM ({PAIRS}) WHERE d <= 10), a AS (SELECT cell, sum(w) AS sw, sum(w*v) AS swv, max(w) AS mw FROM w GROUP BY cell) "
    "SELECT cell, round(CASE WHEN sw > 1e-9 THEN swv/sw*mw ELSE 0 END, 6) AS anchor, round(0.02*mw + 0.05*(1-mw), 6) AS sigma FROM a"
)
def residual_anchor(spark: SparkSession, sf: str) -> DataFrame:
    a = spatial.anchor(pairs(spark, sf, 10.0), ["cell"], "v", 4.0, 0.05)
    return a.select("cell", F.round("anchor", 6).alias("anchor"), F.round("sigma", 6).alias("sigma"))


@query(
    f"WITH w AS (SELECT cell, exp(-d*d/(2*4.0*4.0))/(0.1*0.1) AS w, v FROM ({PAIRS}) WHERE d <= 10), a AS (SELECT cell, sum(w) AS sw, sum(w*v) AS swv FROM w GROUP BY cell) "
    "SELECT cell, round(swv/(sw+1/0.25::DOUBLE), 6) AS field, round(sqrt(1/(sw+1/0.25::DOUBLE)), 6) AS sigma FROM a"
)
def assimilate_points(spark: SparkSession, sf: str) -> DataFrame:
    a = spatial.assimilate(pairs(spark, sf, 10.0).withColumn("s", F.lit(0.1)), ["cell"], "v", "s", 4.0, 0.5)
    return a.select("cell", F.round("field", 6).alias("field"), F.round("sigma", 6).alias("sigma"))


@query(f"SELECT cell, round(sum(v/((d+1e-6)*(d+1e-6)))/sum(1/((d+1e-6)*(d+1e-6))), 6) AS idw, round(min(d), 9) AS d_min FROM ({PAIRS}) WHERE d <= 8 GROUP BY cell")
def idw(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.inverse_distance(pairs(spark, sf, 8.0), ["cell"], "v").select("cell", F.round("idw", 6).alias("idw"), F.round("d_min", 9).alias("d_min"))


@query(
    f"WITH p AS ({POINTS}), q AS (SELECT sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)) AS d, 0.5*(a.v-b.v)*(a.v-b.v) AS g FROM p a JOIN p b ON a.pid < b.pid) "
    "SELECT CAST(floor(d/(20.0/10)) AS INT) AS lag, round(avg(g), 6) AS gamma, count(*) AS n FROM q WHERE d < 20 GROUP BY lag"
)
def semivariogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.semivariogram(points(spark, sf), "v", 20.0, 10).select("lag", F.round("gamma", 6).alias("gamma"), "n")


@query(
    "SELECT row, string_agg(CAST(hand AS VARCHAR), ' ' ORDER BY col) AS line FROM (" + GRID + ") GROUP BY row"
)
def asc_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = grid(spark, sf).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "hand"))).alias("c"))
    return rows.select("row", F.array_join(F.transform("c", lambda x: x["hand"].cast("string")), " ").alias("line"))
