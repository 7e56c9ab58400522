"""Corpus operators against brute force on small inputs."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, TEXTS, docs

from strataflow.llm import cws, mixing, quality, sharding, simhash, tiff, wrapper


def test_lpt_runs_equal_a_heap():
    rng = random.Random(1)
    for _ in range(60):
        histogram = [(s, rng.choice([1, 3, 70, 500])) for s in rng.sample(range(1, 400), 6)]
        heap = [(0, j) for j in range(7)]
        want = {}
        for size, count in sorted(histogram, reverse=True):
            taken = [0] * 7
            for _ in range(count):
                load, j = heap[0]
                taken[j] += 1
                heapq.heapreplace(heap, (load + size, j))
            want[size] = list(np.cumsum(taken))
        assert dict(sharding.schedule(histogram, 7)) == want


def test_shards(spark):
    rows = sharding.lpt_shards(docs(spark), 3).collect()
    assert len(rows) == len(TEXTS)
    assert {r.shard for r in rows if r.doc_id in (1, 2, 8)} == {next(r.shard for r in rows if r.doc_id == 1)}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    null = next(r for r in rows if r.doc_id == 3)
    assert (null.size, null.text_crc32) == (1, 0)
    assert sharding.lpt_shards(docs(spark, []), 3).count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    sizes = [float(rng.randint(1, 500)) for _ in range(800)]
    p = mixing.flight(sizes, [0.37] * 800, 5, land=False)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(0.37 * 800) and sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.37 * sum(sizes))
    assert all(x in (0.0, 1.0) for x in mixing.flight(sizes, [0.37] * 800, 5, land=True))
    assert p == mixing.flight(sizes, [0.37] * 800, 5, land=False)


def test_flight_is_unbiased():
    hits = sum(mixing.flight([3.0, 5.0, 5.0, 9.0], [0.3] * 4, seed, land=True)[0] for seed in range(3000))
    assert hits / 3000 == pytest.approx(0.3, abs=0.03)


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(3000)]
    got = mixing.mix_report(docs(spark, rows)).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.source_size >= r.size
    # water filling by hand: weights 5, 2, 1, 5 in the order a, b, c, null
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in weight if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    for s in weight:
        assert target[s] == pytest.approx(2 * size[s] if s in capped else level * weight[s])
        assert abs(taken[s] - target[s]) <= 80
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs(spark, rows)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_edge_cases(spark):
    d = docs(spark)
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns
    assert len(mixing.mix_report(d).collect()) == len(TEXTS)
    assert mixing.mix_report(docs(spark, [])).count() == 0 and mixing.mix_documents(docs(spark, [])).count() == 0


def words(t):
    return collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t))


def test_fingerprints(spark):
    rng = random.Random(6)
    # Each document has words of its own: draws that documents share would make their errors alike.
    rows = [(i * 3, " ".join(f"w{i}x{rng.randrange(40)}" for _ in range(rng.randint(20, 200))), "en", "a") for i in range(1300)] + [(7000, "", "en", "a"), (7001, " \n ", "en", "a"), (7002, None, "en", "a")]
    got = {r.doc_id: r for r in cws.fingerprint_report(docs(spark, rows)).collect()}
    ordered = [(i, t or "") for i, t, *_ in sorted(rows)]
    off = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = words(t), words(edited)
        off.append(got[i].near_edited - (sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.08
    assert got[7000].fingerprint == got[7001].fingerprint == got[7002].fingerprint and got[7000].near_next == 1.0


def test_fingerprints_edge_cases(spark):
    got = cws.fingerprint_report(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2, 8)}) == 1
    one = cws.fingerprint_report(docs(spark, TEXTS[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert cws.fingerprint_report(docs(spark, [])).count() == 0


def test_simhash_links_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set()
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            prints.add(x)
    fps = np.array(sorted(prints), np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    signed = fps.view(np.int64).tolist()
    labels = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, label long")
    for tile in (4096, 4):
        simhash.TILE, kept = tile, simhash.TILE
        try:
            got = {r.fp: r.label for r in simhash.components(simhash.links(labels.select("fp"), 3), labels).collect()}
        finally:
            simhash.TILE = kept
        assert got == {f: find(i) for i, f in enumerate(signed)}


def test_simhash_documents(spark):
    rows = simhash.simhash_components(docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[3].fp == by[4].fp == by[9].fp == 0 and by[9].component_id == 3
    assert by[1].component_id == by[2].component_id == by[8].component_id == 1
    d = docs(spark)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {1, 3, 5, 6, 7}
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_tiff_round_trips():
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (130, 64, 3), dtype=np.uint8), np.tile(np.arange(7, dtype=np.uint8), (5, 3))[:, :, None]]
    for codec in tiff.SCHEMES:
        for predictor in (1, 2):
            back = tiff.read_pages(tiff.write_pages(pages, codec, predictor, rows_per_strip=50))
            assert len(back) == 2 and all((a == b).all() for a, b in zip(back, pages))
    for bad in (b"", b"II*\0", b"II*\0\xff\0\0\0", tiff.write_pages(pages)[:4000]):
        with pytest.raises(tiff.TiffError):
            tiff.read_pages(bad)


def test_media(spark):
    got = {r.doc_id: r for r in tiff.media_report(docs(spark)).collect()}
    for i, t, *_ in TEXTS:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    bad = spark.createDataFrame([(1, b"no image"), (2, None)], "k int, media binary")
    assert {r.k: r.error for r in tiff.decode_pages(bad).collect()} == {1: "no TIFF header", 2: None}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home {k}</a></li></ul></nav>
<div id="content"><h1>Title {k}</h1><p>First   para {k} &amp; more,<br>same block {w}.<p>Second <b>bold</b> {w}</p><div class="ad">Buy {k}</div>
<form><p>Your mail</p><input></form><p>Third {w} {k}</p><div class="comments"><p>Nice {k}</p></div></div>
<aside><p>Related {w} {w} {w}</p></aside><footer>&copy; {k}</footer></body></html>"""


def test_wrapper(spark):
    rng = random.Random(3)
    rows = [(k, f"https://u@Host.example:80/{k}", PAGE.format(k=k, w=" ".join(rng.choice("abcdefgh") * 3 for _ in range(12))), k) for k in range(9)]
    rows += [(90, None, None, 0), (91, "http://other/", "", 0), (92, "x", "plain &lt;text&gt;\n here", 0), (93, "http://z/", "<article><p>One<p>Two &am</article", 0), (1, rows[1][1], rows[1][2], 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper long")
    got = collections.defaultdict(list)
    for r in wrapper.extract_pages(pages).collect():
        got[r.page_id].append(r)
    assert len(got[1]) == 2
    for k in range(9):
        lines = got[k][0].text.split("\n")
        assert lines[0] == f"Title {k}" and lines[1].startswith(f"First para {k} & more, same block ") and lines[2].startswith("Second bold") and lines[3].endswith(f" {k}")
        assert len(lines) == 4 and got[k][0].by_wrapper and got[k][0].n_chars == len(got[k][0].text)
    assert got[90][0].text == got[91][0].text == "" and got[92][0].text == "plain <text> here" and got[93][0].text == "One\nTwo &am"
    assert wrapper.extract_pages(pages.limit(0)).count() == 0


def brute_kneser_ney(texts, order=quality.ORDER):
    counts = {order: collections.Counter()}
    for t in texts:
        t = quality.START * (order - 1) + t
        for i in range(order - 1, len(t)):
            counts[order][t[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return quality.UNIFORM
        c = counts[n]
        t = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        d = [0.0] + [min(i, max(0.05 * i, i - (i + 1) * y * t[i] / t[i - 1])) for i in (1, 2, 3)]
        follow = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not follow:
            return p(gram[1:])
        weight = min(1.0, sum(d[min(v, 3)] for v in follow) / sum(follow)) if c[gram] == 0 else sum(d[min(v, 3)] for v in follow) / sum(follow)
        return max(0.0, c[gram] - d[min(c[gram], 3)]) / sum(follow) + weight * p(gram[1:])

    return p


def test_kneser_ney_by_brute_force(spark):
    texts = ["the cat sat on the mat", "the hat is on the cat", "a cat"]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    tried = ["the cat", "on a hat", "zzz the", ""]
    rows = spark.createDataFrame([(t, "en") for t in tried], "text string, lang string")
    got = {r.text: r._lm_nll for r in quality.add_scores(rows, quality.kneser_ney(quality.count_grams(df))).collect()}
    p = brute_kneser_ney(texts)
    for t in tried:
        padded = quality.START * (quality.ORDER - 1) + t
        want = -sum(np.log(p(padded[i - quality.ORDER + 1 : i + 1])) for i in range(quality.ORDER - 1, len(padded)))
        assert got[t] == pytest.approx(want, rel=1e-6)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    got = quality.quality_report(d, seen).join(held, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.03 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.1 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_report(docs(spark), labels).count() == len(TEXTS)
    d = docs(spark)
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {1, 2, 3, 4, 5, 8} <= {r.doc_id for r in kept.collect()}
    assert quality.quality_report(docs(spark), labels.limit(0)).filter("not keep").count() == 0
    assert quality.quality_report(docs(spark, []), labels).count() == 0
    assert SCHEMA
