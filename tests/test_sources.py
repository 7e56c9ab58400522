"""The paged service and binary rasters."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.sources import rasters, service


@pytest.fixture
def pages(tmp_path):
    root = tmp_path / "pages"
    for s in ("a", "b", "c"):
        (root / s).mkdir(parents=True)
        for p in range(3):
            values = [{"site_no": s, "date": f"2020-0{p + 1}-{d:02d}", "value": d * 1.5 if d % 4 else "", "status": "A"} for d in range(1, 11)]
            (root / s / f"{p}.json").write_text(json.dumps({"values": values, "next": p + 1 if p < 2 else None}))
    (root / "sites.json").write_text(json.dumps(["a", "b", "c"]))
    return root


def load(spark, pages, **options):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(service.PagedService)
    reader = spark.read.format("paged_service").option("pages", str(pages))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_all_pages_of_all_sites(spark, pages):
    got = load(spark, pages)
    assert got.count() == 90 and got.filter("value is null").count() == 18 and got.rdd.getNumPartitions() == 3
    assert load(spark, pages, sites="b").select("site_no").distinct().collect()[0][0] == "b"


def test_filters_reach_the_service(spark, pages, capsys):
    got = load(spark, pages).filter(F.col("site_no").isin("a", "c")).filter(F.col("date") >= "2020-03-05")
    assert got.count() == 12 and got.rdd.getNumPartitions() == 2
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "In(site_no" in plan.replace(" ", "") or "site_no IN" in plan
    assert load(spark, pages).filter("site_no = 'zz'").count() == 0
    assert load(spark, pages).filter("site_no = 'a' and site_no = 'b'").count() == 0


def test_a_stream_goes_on_where_it_was(spark, pages, tmp_path):
    spark.dataSource.register(service.PagedService)

    def run():
        stream = spark.readStream.format("paged_service").option("pages", str(pages)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.schema(service.SCHEMA).parquet(str(tmp_path / "out"))

    assert run().count() == 90
    (pages / "b" / "3.json").write_text(json.dumps({"values": [{"date": "2020-04-01", "value": 7, "status": "P"}], "next": None}))
    for p in range(3):  # what was read is not asked again
        (pages / "a" / f"{p}.json").write_text("no JSON")
    out = run()
    assert out.count() == 91 and out.filter("status = 'P'").first()["site_no"] == "b"


def test_backoff():
    waits, answers = [], [service.Busy(), OSError(), {"ok": 1}]

    def ask():
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert service.with_backoff(ask, sleep=waits.append) == {"ok": 1} and waits == [0.5, 1.0]
    with pytest.raises(service.Busy):
        service.with_backoff(lambda: (_ for _ in ()).throw(service.Busy()), tries=2, sleep=waits.append)
    with pytest.raises(FileNotFoundError):
        service.recorded("/nowhere")("a", "0", None)


def test_pages_that_come_again_end_the_read(spark, pages):
    (pages / "a" / "2.json").write_text(json.dumps({"values": [], "next": 0}))
    with pytest.raises(Exception, match="comes again"):
        load(spark, pages).count()


def test_a_window_of_gzipped_grids(spark, tmp_path):
    rng = np.random.default_rng(0)
    grids = {f"day{k}.dat.gz": rng.integers(-5, 900, (700, 60)).astype(">i2") for k in range(3)}
    for name, g in grids.items():
        g[::7, ::5] = -9999
        data = g.tobytes()
        (tmp_path / name).write_bytes(gzip.compress(data) if "1" not in name else data)
    (tmp_path / "day0.txt").write_text("x")
    got = rasters.flat_grids(spark, str(tmp_path), (700, 60), (90, 640, 10, 40), scale=0.1, glob="*.dat.gz").collect()
    by_file = {}
    for r in got:
        by_file.setdefault(r["path"].rsplit("/", 1)[1], {})[r["row"], r["col"]] = r["value"]
    for name, g in grids.items():
        want = {(i, j): g[i, j] * 0.1 for i in range(90, 640) for j in range(10, 40) if g[i, j] != -9999}
        assert by_file[name].keys() == want.keys() and all(abs(by_file[name][k] - v) < 1e-9 for k, v in want.items())
    with pytest.raises(Exception, match="are no 700 x 61"):
        rasters.flat_grids(spark, str(tmp_path), (700, 61), glob="*.gz").count()
    with pytest.raises(ValueError):
        rasters.flat_grids(spark, str(tmp_path), (5, 5), (0, 6, 0, 5))


def test_header():
    assert rasters.header_of("Number of columns: 60\nncols 5\nnodata = -9\nplain text line") == {"number of columns": "60", "ncols": "5", "nodata": "-9"}
