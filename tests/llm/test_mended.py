"""Cases that once went wrong."""

import numpy as np
import pytest
from helpers import BYTES
from pyspark.sql import functions as F

from strataflow.llm import attribution, tiff


def test_media_columns_may_have_the_new_names(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None), (1, "abc")], "doc_id long, text string")
    media = tiff.store_texts(texts).select("media", F.lit(9).alias("page"), F.lit("w").alias("width"), F.lit("x").alias("media_page"), "doc_id")
    got = tiff.decode_pages(media)
    assert len(set(got.columns)) == len(got.columns) and {"page", "media_page", "media_media_page", "media_width"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 3 and all(r["page"] == 0 and r["media_width"] == "w" and r["error"] is None for r in rows)
    assert tiff.decode_pages(media.limit(0)).count() == 0


def test_a_token_over_both_edges_crosses_once():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 40, 12))
        starts, stops = cuts[:-1], cuts[1:]
        edges = np.sort(rng.integers(0, 40, 8))
        lo, hi = edges[::2], edges[1::2]
        want = [sum(1 for a, b in zip(starts, stops) if h > l and ((a < l < b) or (a < h < b))) for l, h in zip(lo, hi)]
        assert attribution.allocate_edges(starts, stops, lo, hi).tolist() == want


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "hello world again")], "doc_id long, text string")
    kind = "array<struct<name:string,start:int,stop:int>>"
    one = F.array(F.struct(F.lit("a").alias("name"), F.lit(0).alias("start"), F.lit(5).alias("stop")), *[F.struct(F.lit(n).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for n, a, b in (("b", 7, 9), ("c", 12, 17))]).cast(kind)
    got = {r["name"]: r for r in attribution.attribute_tokens(docs, BYTES, one).collect()}
    assert got["b"]["crossing"] == 1 and got["a"]["crossing"] == 0
    bad = F.array(F.struct(F.lit("a").alias("name"), F.lit(0).alias("start"), F.lit(5).alias("stop")), F.struct(F.lit("b").alias("name"), F.lit(4).alias("start"), F.lit(9).alias("stop"))).cast(kind)
    with pytest.raises(Exception, match="do not ascend"):
        attribution.attribute_tokens(docs, BYTES, bad).collect()
