"""Station payloads, soil profiles, features, dynamic maps, searches and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import features, geostat, grid, soil
from strataflow.sources import stations, writers


def test_climate_texts(spark, tmp_path):
    def line(day, values):
        return " ".join(["53150", str(day), "2.4", *["0"] * 15, *map(str, values), "1 1 1 1 1"])

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "CRND0103-2020-WA_Darrington_21_NNE.txt").write_text("\n".join([line(20200101, [0.2, 0.3, -99.0, 0.4, -99]), line(20200102, [-99.0] * 5), line(20200203, [0.1] * 5), line("bad", [0.1] * 5)]) + "\n")
    days = {str(r["date"]): r["theta"] for r in stations.climate_days(spark, str(tmp_path / "d")).collect()}
    assert days == {"2020-01-01": pytest.approx((0.2 * 7.5 + 0.3 * 7.5 + 0.4 * 40) / 55), "2020-02-03": pytest.approx(0.1)}
    months = stations.monthly(stations.climate_days(spark, str(tmp_path / "d")), ["station"], "theta").collect()
    assert {(r["station"], str(r["month"]), r["days"]) for r in months} == {("WA_Darrington_21_NNE", "2020-01-01", 1), ("WA_Darrington_21_NNE", "2020-02-01", 1)}
    (tmp_path / "s.tsv").write_text("STATE\tLOCATION\tVECTOR\tNAME\tLATITUDE\tLONGITUDE\tELEVATION\tSTATUS\nWA\tDarrington\t21 NNE\tN\t48.5\t-121.4\t407\tCommissioned\nWA\tX Y\t1 S\tM\t48\t-121\t\tClosed\nOR\tZ\t1 E\tO\t44\t-121\t3\tOperational\n")
    rows = stations.climate_stations(spark, str(tmp_path / "s.tsv"), (-123.0, 46.0, -120.0, 49.0)).collect()
    assert [(r["station"], r["elev_m"]) for r in rows] == [("WA_Darrington_21_NNE", 407.0)]


def test_snow_service(spark, tmp_path):
    def series(code, depth, values):
        return {"stationElement": {"elementCode": code, "heightDepth": depth}, "values": [{"date": f"2020-01-{i + 1:02d}", "value": v} for i, v in enumerate(values)]}

    data = [{"stationTriplet": "679:WA:SNTL", "data": [series("SMS", -2, [10.0] * 12 + [99.0]), series("SMS", -8, [20.0] * 11 + [None] * 2), series("SMS", -40, [50.0] * 13), series("STO", -2, [-1.0] + [3.0] * 12), series("WTEQ", None, [1.0, None, 3.0]), series("TAVG", None, [32.0, 50.0]), series("PRCP", None, [0.5])]}]
    (tmp_path / "a.json").write_text(json.dumps(data))
    found = stations.snow_series(spark, str(tmp_path / "a.json"))
    month = stations.station_theta(found).first()
    days = [(10 * 2 + 20 * 8) / 10 / 100] * 10 + [10 * 2 / 10 / 100]  # day 1 is frozen; day 12 lacks the deeper sensor, day 13 has none
    assert month["days"] == 11 and month["theta"] == pytest.approx(np.mean(days))
    assert stations.station_theta(found, renormalise=True).first()["theta"] == pytest.approx(np.mean([0.18] * 10 + [0.1]))
    assert stations.station_theta(found, least=12).count() == 0
    snow = {str(r["date"]): r for r in stations.station_snow(found).collect()}
    assert set(snow) == {"2020-01-01", "2020-01-03"} and snow["2020-01-01"]["swe_mm"] == 25.4 and snow["2020-01-01"]["tmean_c"] == 0 and snow["2020-01-03"]["precip_mm"] is None
    meta = [{"stationTriplet": t, "name": "n", "networkCode": c, "latitude": 47.0, "longitude": -121.0, "elevation": 1000, "stationElements": [{"elementCode": e}]} for t, c, e in (("a", "SNTL", "SMS"), ("b", "SNTL", "WTEQ"), ("c", "COOP", "SMS"))]
    (tmp_path / "m.json").write_text(json.dumps(meta))
    got = stations.snow_stations(spark, str(tmp_path / "m.json"), "SMS", (-122.0, 46.0, -120.0, 48.0)).collect()
    assert [(r["triplet"], r["elev_m"]) for r in got] == [("a", pytest.approx(304.8))]


def test_gauges_and_basins(spark, tmp_path):
    def site(no, code, values):
        return {"sourceInfo": {"siteCode": [{"value": no}]}, "variable": {"variableCode": [{"value": code}]}, "values": [{"value": [{"value": v, "dateTime": f"2020-01-0{i + 1}T00:00:00.000"} for i, v in enumerate(values)]}]}

    (tmp_path / "q.json").write_text(json.dumps({"value": {"timeSeries": [site("1", "00060", ["100", "-999999", "x"]), site("1", "00065", ["3"]), site("2", "00060", ["5"])]}}))
    values = stations.gauge_values(spark, str(tmp_path / "q.json"))
    areas = spark.createDataFrame([("1", 10.0), ("2", None)], "site_no string, area_sqmi double")
    got = {str(r["date"]): r for r in stations.discharge_depth(values, areas).collect()}
    assert len(got) == 3 and got["2020-01-01"]["q_mm_day"] == pytest.approx(100 * 0.0283168466 * 86400 / 2.589988e7 * 1000) and got["2020-01-02"]["q_mm_day"] is None
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    shapes = {"features": [{"properties": {"identifier": "USGS-1"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"identifier": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[8, 8], [9, 8], [9, 9]]]]}}]}
    (tmp_path / "b.json").write_text(json.dumps(shapes))
    rings = stations.basin_rings(spark, str(tmp_path / "b.json"))
    assert sorted((r["code"], r["rank"], len(r["ring"])) for r in rings.collect()) == [("1", 0, 5), ("2", 0, 5), ("2", 1, 3)]
    cells = spark.createDataFrame([(1, 2.0, 2.0), (2, 8.8, 8.5), (3, 7.0, 1.0)], "cell int, x double, y double")
    assert {r["cell"]: r["code"] for r in grid.cells_in_shapes(cells, rings, 3.0).collect()} == {1: "1", 2: "2", 3: None}


def test_root_zone(spark):
    depths = [0, 5, 15, 30, 60, 100]
    w = {0: 2.5, 5: 7.5, 15: 12.5, 30: 22.5, 60: 35.0, 100: 20.0}
    layers = [(1, "claytotal", float(z), 10.0 + z) for z in depths] + [(1, "soc", float(z), 2000.0) for z in depths[:3]] + [(1, "soc", 150.0, 9e9), (2, "claytotal", 0.0, None)]
    single = spark.createDataFrame([(1, "resdept_all_cm", 60.0), (1, "anylithicdpt_cm", None)], "cell int, property string, value double")
    frame = spark.createDataFrame(layers, "cell int, property string, depth double, value double")
    got = soil.root_zone(frame, single, ["cell"], depths).collect()
    assert len(got) == 1 and got[0]["clay"] == pytest.approx(sum(w[z] * (10 + z) for z in depths) / 100)
    carbon = 2.0 * (2.5 + 7.5 + 12.5) / 100
    assert got[0]["carbon"] == pytest.approx(carbon) and got[0]["om"] == pytest.approx(1.724 * carbon) and got[0]["root_m"] == 0.6 and got[0]["sand"] is None
    assert {r["property"]: r["value"] for r in soil.depth_means(frame, ["cell"], depths, renormalise=True).collect()}["soc"] == pytest.approx(2.0)


def test_feature_matrix(spark):
    sites = spark.createDataFrame([(1, 0.5, 9.5), (2, 3.2, 6.1), (3, 50.0, 1.0)], "site int, x double, y double")
    layer = lambda k: spark.createDataFrame([(r, c, float(k * (10 * r + c)) if (r, c) != (3, 3) or k == 1 else None) for r in range(10) for c in range(10)], "row int, col int, value double")
    got, names = features.feature_matrix(sites, {"a": layer(1), "gone": None, "b": layer(2)}, 0.0, 10.0, 1.0, ["a"])
    assert names == ["a", "b"] and {r["site"]: (r["a"], r["b"]) for r in got.collect()} == {1: (0.0, 0.0), 2: (33.0, None), 3: (None, None)}
    assert [r["site"] for r in features.complete_cases(got, names).collect()] == [1]
    with pytest.raises(ValueError):
        features.feature_matrix(sites, {"gone": None}, 0.0, 10.0, 1.0, ["gone"])


def test_cell_means(spark):
    points = spark.createDataFrame([(1, 0.2, 0.2, 1.0, 3.0), (1, 0.6, 0.4, 3.0, 4.0), (1, 5.0, 5.0, 7.0, 1.0), (1, 0.1, 0.1, None, 1.0)], "k int, px double, py double, v double, s double")
    got = sorted(tuple(r) for r in features.cell_means(points, ["k"], "v", "s", 1.0).select("px", "py", "v", "s", "n").collect())
    assert got == [(pytest.approx(0.4), pytest.approx(0.3), 2.0, 2.5, 2), (5.0, 5.0, 7.0, 1.0, 1)]


def test_dynamic_maps(spark):
    rng = np.random.default_rng(0)
    places = {s: (float(x), float(y)) for s, x, y in zip(range(12), rng.random(12) * 12, rng.random(12) * 9)}
    rows = [(s, f"2020-0{m}-01", *places[s], float(5 + s + 0.3 * m + rng.normal() / 9)) for s in places for m in (1, 2, 3, 4) if not (m == 3 and s > 5)]
    monthly = spark.createDataFrame(rows, "site int, month string, px double, py double, depth double").withColumn("month", F.to_date("month"))
    base = spark.createDataFrame([(r, c, 2.0 + r if (r, c) != (4, 4) else None) for r in range(9) for c in range(12)], "row int, col int, depth double")
    model = (0.01, 1.0, 20.0)
    got = features.dynamic_depth(monthly, base, ("2020-01-01", "2020-03-01"), 3, model)
    found = {(str(r["month"]), r["row"], r["col"]): r for r in got.collect()}
    assert {k[0] for k in found} == {"2020-01-01", "2020-02-01"} and len(found) == 2 * (9 * 12 - 1)
    means = {s: np.mean([d for t, m, _, _, d in rows if t == s and m <= "2020-03-01"]) for s in places}
    z = {m: [(x, y, d - means[s]) for s, t, x, y, d in rows if t == m] for m in ("2020-01-01", "2020-02-01")}
    for m, obs in z.items():
        px, py, v = (np.array(a) for a in zip(*obs))
        gx, gy = np.meshgrid((np.arange(4) + 0.5) * 3, (np.arange(3) + 0.5) * 3)
        e, s = geostat.krige_block(px, py, v, gx.ravel(), gy.ravel(), model)
        e, s = np.clip(e, v.min() - v.std(), v.max() + v.std()).reshape(3, 4), np.minimum(s, v.std()).reshape(3, 4)
        for (r, c) in ((0, 0), (4, 5), (8, 11), (1, 1)):
            u, w = min(max((r + 0.5) / 3 - 0.5, 0), 2), min(max((c + 0.5) / 3 - 0.5, 0), 3)
            i, j = min(int(u), 1), min(int(w), 2)
            a, b = u - i, w - j
            mix = lambda f: (1 - a) * ((1 - b) * f[i, j] + b * f[i, j + 1]) + a * ((1 - b) * f[i + 1, j] + b * f[i + 1, j + 1])  # noqa: E731, B023
            assert found[m, r, c]["depth"] == pytest.approx(2.0 + r + mix(e)) and found[m, r, c]["sigma"] == pytest.approx(mix(s))


def test_search(spark):
    tried = features.candidates(spark.createDataFrame([(1,), (2,)], "k int"), {"a": [1, 2], "b": [10, 20, 30]})
    assert tried.count() == 12 and {(r["candidate"], r["a"], r["b"]) for r in tried.collect()} >= {(0, 1.0, 10.0), (5, 2.0, 30.0)}
    scores = [("u", 0, 0.9), ("u", 1, 0.1), ("v", 0, 0.2), ("v", 1, 0.6), ("w", 0, 0.3), ("w", 1, 0.5), ("w", 2, None)]
    frame = spark.createDataFrame(scores, "unit string, candidate int, r double")
    assert features.best_candidate(frame, "candidate", "r").first()["candidate"] == 0
    got = {r["unit"]: (r["candidate"], r["r"]) for r in features.leave_one_out(frame, "unit", "candidate", "r").collect()}
    assert got == {"u": (1, 0.1), "v": (0, 0.2), "w": (0, 0.3)}


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, r + c / 10, 0.5) for r in range(2) for c in range(3)], "row int, col int, value double, sigma double")
    fields = [{"key": "water_table", "epoch": "2020-01", "grid": cells, "source": "x"}, {"key": "saturation", "epoch": "2020-01", "grid": cells.drop("sigma")}]
    manifest = writers.write_bundle(fields, str(tmp_path / "out"), 0.0, 0.0, 90.0, 90.0)
    again = json.loads(spark.read.text(str(tmp_path / "out" / "manifest")).first()[0])
    assert again == manifest and [f["std_asc"] is None for f in again["fields"]] == [False, True] and again["fields"][0]["source"] == "x"
    assert spark.read.text(str(tmp_path / "out" / again["fields"][0]["std_asc"])).count() == 8
    for wrong in ([{"key": "nothing", "epoch": "e", "grid": cells}], [fields[0], fields[0]]):
        with pytest.raises(ValueError):
            writers.write_bundle(wrong, str(tmp_path / "no"), 0.0, 0.0, 90.0, 90.0)
    item = writers.catalogue_item("p", "data", (-124.0, 42.0, -116.0, 49.0), {"measurement": "depth"}, "2020-01-01", "2020-02-01", "std")
    writers.write_json(spark, item, str(tmp_path / "item"))
    back = json.loads(spark.read.text(str(tmp_path / "item")).first()[0])
    assert back["properties"]["end_datetime"] == "2020-02-01" and back["geometry"]["coordinates"][0][2] == [-116.0, 49.0] and set(back["assets"]) == {"data", "uncertainty"}
    with pytest.raises(ValueError):
        writers.catalogue_item("p", "d", (1.0, 0.0, 0.0, 1.0), {}, "2020")
