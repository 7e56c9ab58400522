"""The divergence audit against plain counting in Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataflow.llm import divergence as dv

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def by_hand(rows, least):
    """lang, source, part, item, value, rank of rows (text, lang, source)."""
    seen, count, groups = defaultdict(int), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = words(text)
        count[lang, source].update(found)
        for w in set(found):
            seen[lang, w] += 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted({w for (g, w), n in seen.items() if g == lang and n >= least})
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)
        whole = Counter()
        for s in sources:
            whole += count[lang, s]

        def share(c, lang=lang, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(t, sum(gap(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, gap(p[s][w], q[w])) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items) if part == "pair" or i < 10]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, n long, term string")


def some_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "Über", "été", "中文", "a", "zz", "É", "word", "x" * 300, "ß", "b1c"]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 12))
        rows.append((" ".join(rng.choice(vocabulary, k, p=np.arange(1, 13) / 78)) + "\x00,Ab1", ["en", "de", None][i % 3], ["a", "b", "é", None, "c"][int(rng.integers(0, 5))]))
    return [*rows, (None, "en", "nothing"), ("", "xx", "alone"), ("rare words only", "yy", "p"), ("others", "yy", "q"), *rows[:3]]


@pytest.mark.parametrize("least", [1, 10])
def test_by_hand(spark, least):
    rows = some_rows(least)
    got = sorted(tuple(r) for r in dv.divergence(made(spark, rows), least).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == by_hand(rows, least)


def test_tiles_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(dv, "TILE", 2)
    monkeypatch.setattr(dv, "BUCKET", 5)
    rows = some_rows(3)
    got = sorted(tuple(r) for r in dv.divergence(made(spark, rows), 2).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == by_hand(rows, 2)


def test_empty(spark):
    assert dv.divergence(made(spark, [])).count() == 0
    assert dv.divergence(made(spark, [(None, None, None)])).count() == 0


def test_collisions_are_parted():
    text = b"one two one three two one four"
    starts, ends, _ = dv.word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    number, first = dv.group_words(text, starts, ends, lambda w: len(w) % 2)
    found = [text[a:b] for a, b in zip(starts, ends)]
    assert [found[f] for f in first[number]] == found and len(set(number.tolist())) == 4


def test_words_end_with_their_document():
    data, offsets = np.frombuffer("abcdéfg".encode(), np.uint8), np.array([0, 0, 3, 3, 8])
    starts, ends, doc = dv.word_bounds(data, offsets)
    assert (starts.tolist(), ends.tolist(), doc.tolist()) == ([0, 3], [3, 8], [1, 3])


def test_large_counts_stay_exact():
    big = np.array([10**14, 0])
    assert dv.shares(big, np.array([3 * 10**14, 7]), 5).tolist() == [1 + 10**9 * (10**14 + 2) // (3 * 10**14 + 10), 1 + 10**9 * 2 // 17]
