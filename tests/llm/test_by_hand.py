"""Operators against scalar restatements and on inputs that once broke them."""

from __future__ import annotations

import heapq
import itertools
import math
import random
import zlib
from collections import Counter

import pytest
import xxhash
from helpers import BYTES, docs

from strataflow.llm import cws, html_tree, mixing, quality, sharding, simhash, tiff, token_files, wrapper
from strataflow.llm.near import drop_near_copies

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(n, seed=1):
    draw = random.Random(seed)
    return [" ".join(draw.choices(WORDS, k=draw.randint(0, 60))) for _ in range(n)]


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _long(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=value < 0), seed & (2**64 - 1))


def _gamma(x, low):
    """-ln of the product of two uniforms f / 2^e from the bits of x."""
    out = 0.0
    for geo, mantissa in ((0, 13), (27, 40)):
        bits = (x >> geo) & 8191
        e = 1 + (next(k for k in range(14) if (bits | 8192) >> k & 1))
        f = 1 + (((x >> mantissa) & 16383) + 0.5) / 16384
        out -= math.log(f / 2**e)
    return out


def by_hand(text, samples):
    """The samples of a text, with the library's logarithms and exponentials; None where two terms are nearly equal."""
    counts = Counter(text.split())
    out = []
    for k in range(samples):
        group, j = divmod(k, cws.WIDTH)
        found = []
        for word, n in counts.items():
            term = _signed(xxhash.xxh64_intdigest(word.encode(), 42))
            u = xxhash.xxh64_intdigest(group.to_bytes(4, "little"), _long(term, 42))
            x, y = (xxhash.xxh64_intdigest((2 * j + i).to_bytes(4, "little"), _long(_signed(u), 42)) for i in (0, 1))
            r, c, b = _gamma(x, 0), _gamma(y, 0), (((x >> 54) << 10 | y >> 54) + 0.5) / 2**20
            t = math.floor(math.log(n) / r + b)
            a = c * math.exp(-r * (t - b + 1))
            found.append((a, _long(t, _long(term, 42)) >> 48))
        found.sort()
        sure = len(found) < 2 or found[1][0] > found[0][0] * (1 + 1e-4)
        out.append(found[0][1] if found and sure else None if found else -1)
    return out


def test_samples_by_hand(spark):
    rows = [(i, x) for i, x in enumerate([*texts(30), "", "one", "one one one"])]
    frame = spark.createDataFrame(rows, "n long, body string").repartition(3, "n")
    got = {r.n: r.body for r in cws.sampled(frame, ["n"], ["body"]).collect()}
    compared = 0
    for n, text in rows:
        for mine, theirs in zip(by_hand(text, cws.SAMPLES), got[n], strict=True):
            if mine is not None:
                compared += 1
                assert mine == theirs
    assert compared > 0.95 * cws.SAMPLES * len(rows)


def exhaustive(a, b):
    """The most nodes in common by trying every ordered pairing of children."""
    if a.sign != b.sign:
        return 0
    best = 0
    for k in range(min(len(a.children), len(b.children)) + 1):
        for left in itertools.combinations(a.children, k):
            for right in itertools.combinations(b.children, k):
                found = [exhaustive(x, y) for x, y in zip(left, right)]
                if all(found):
                    best = max(best, sum(found))
    return best + 1


def test_tree_matching_by_hand():
    draw = random.Random(5)

    def tree(depth):
        slot = wrapper.Slot(draw.choice("ab"), [])
        slot.children = [tree(depth - 1) for _ in range(draw.randint(0, 3))] if depth else []
        return slot

    for _ in range(60):
        a, b = tree(3), tree(3)
        a.sign = b.sign = "a"
        memo = {}
        assert wrapper.match(a, b, memo) == exhaustive(a, b) == sum(1 for _ in wrapper.matched(a, b, memo))


def test_pages_that_broke(spark):
    content = "<body><div id=content><h1>T</h1><p>first paragraph</p><p>second one</p><section><p>" + "long text " * 30 + "</p></section></div></body>"
    rows = [
        (1, "http://a/", "<div>" * 3000 + "deep text" + "</div>" * 3000 + "tail"),
        (2, "http://a/", "<b>" * 5000 + "deep text"),
        (3, "http://b/", content),
        (4, "http://b/", "<body><article><p>one</p></article><p>between</p><article><p>two</p></article></body>"),
        (5, "http://c/", "<p>" + "x " * 200_000),
        (6, None, None),
    ]
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep text\ntail" and got[2] == "deep text" and got[4] == "one\ntwo" and got[6] == ""
    assert got[3].split("\n")[:3] == ["T", "first paragraph", "second one"] and len(got[5]) == 399_999


def test_copies_do_not_fill_the_sample(spark):
    """A host of many copies of one page and some others still has a template."""
    page = "<body><div><p>Same notice on every page</p><p>Own text {0} of page {0}, long enough to count.</p></div></body>"
    rows = [(i, "http://h/", page.format(0)) for i in range(60)] + [(100 + i, "http://h/", page.format(i)) for i in range(1, 12)]
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Own text 0 of page 0, long enough to count." and got[103].startswith("Own text 3") and "notice" not in got[103]


def test_raw_text_ends():
    assert html_tree.parse("<title>a</title>b").children[1] == "b"


def test_shards_by_hand(spark):
    rows = [(i, x, "en", "a") for i, x in enumerate(texts(300) + ["same text"] * 40 + ["", None])]
    got = sharding.lpt_shards(docs(spark, [(i, t, g, s) for i, t, g, s in rows]), 16).collect()
    groups = Counter()
    for _, t, _, _ in rows:
        groups[t] += len((t or "").encode()) + 1
    heap = [(0, k) for k in range(16)]
    for size in sorted(groups.values(), reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, k))
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert {k: load for load, k in heap} == {k: loads[k] for k in range(16)}
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_simhash_by_hand(spark):
    base = texts(60, 3)
    rows = [(i, x, "en", "a") for i, x in enumerate(base + [x + " omega" for x in base[:20]] + ["", None])]
    got = {r.doc_id: r for r in simhash.simhash_components(docs(spark, rows)).collect()}
    prints = {}
    for i, t, _, _ in rows:
        words = (t or "").split()
        runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(prints, 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == label


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_masks_lose_no_link(radius):
    draw = random.Random(radius)
    masks = simhash.masks(radius)
    for _ in range(300):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), radius):
            y ^= 1 << b
        assert any((x ^ y) & m & (2**64 - 1) == 0 for m in masks)


def test_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|>y  z\n"), (4, "plain words, 12.5 don't"), (5, None)]
    got = {r.doc_id: r for r in token_files.token_file_report(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect()}
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_any_column_names(spark):
    names = ["doc_id", "text", "lang", "source", "_mix_id", "_mix_own", "_lm_text", "_lm_chars", "_sim_fp", "kept", "_near_row", "column0", "lang_2", "keep"]
    row = (1, "alpha beta gamma", "en", "a", *range(10))
    frame = spark.createDataFrame([row, (2, "alpha beta gamma", "en", "a", *range(10)), (None, None, None, None, *range(10))], "doc_id int, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names[4:]))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for got, n in (
        (quality.keep_good(frame, labels), 3),
        (mixing.mix_documents(frame, share=1.0, most=1.0), 2),  # a source without words has the target 0
        (drop_near_copies(frame), 2),
        (simhash.drop_near_duplicates(frame), 1),
    ):
        rows = got.collect()
        assert got.columns == names and len(rows) == n and all(tuple(r)[4:] == tuple(range(10)) for r in rows)
    empty = frame.limit(0)
    for got in (quality.keep_good(empty, labels), quality.keep_good(frame, labels.limit(0)), mixing.mix_documents(empty), drop_near_copies(empty), simhash.drop_near_duplicates(empty)):
        assert got.columns == names and got.count() in (0, 3)


def test_targets_are_near(spark):
    """Where no document is a large part of its source: one that is can't be made up for by others."""
    draw = random.Random(2)
    rows = [(i, "w " * (draw.randint(1, 30) if i % 10 else draw.randint(100, 150)), "en", "abc"[i % 3]) for i in range(900)]
    plan = mixing.mix_plan(docs(spark, rows)).groupBy("source").agg({"target": "max"}).collect()
    taken = {r.source: r.t for r in mixing.mix_plan(docs(spark, rows)).selectExpr("source", "size * n * copies as t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    for r in plan:
        assert abs(taken[r.source] - r["max(target)"]) <= 0.01 * r["max(target)"]


def test_lzw_that_begins_with_no_literal():
    with pytest.raises(tiff.TiffError):
        tiff.unpack_lzw((300 << 7).to_bytes(2, "big"))
