"""Near copies by exact Jaccard similarity against brute force."""

import random

import numpy as np

from helpers import docs

from strataflow.llm import near


def components_of(sets):
    """Smallest key of each key's component, comparing every pair."""
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def edited_texts():
    """Groups of edited copies (Jaccard from about 0.5 to 1), a common passage, short texts."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    texts = ["one two", "one two three four five", "One  two", "one two three four five six"]
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([9, 40, 120, 300]))]
        for _ in range(rng.choice([1, 4, 8])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words + passage * (group % 3 == 0)))
    base = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


def test_near_components_by_brute_force(spark):
    texts = sorted({x.lower(): x for x in edited_texts()}.values())
    want = components_of({i: shingles(x) for i, x in enumerate(texts)})
    assert 20 < len(set(want.values())) < len(texts) - 20
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    sampled, near.SAMPLED = near.SAMPLED, 1
    try:
        for often in (10**9, 8, 2):  # the order must not matter
            kept, near.OFTEN = near.OFTEN, often
            try:
                got = {r.node: r.label for r in near.near_components(rows).collect()}
            finally:
                near.OFTEN = kept
            assert got == want
    finally:
        near.SAMPLED = sampled


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    texts = edited_texts()
    want = components_of({i: shingles(x) for i, x in enumerate(texts)})
    d = docs(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])
    got = corpus_pipeline.near_dedup(spark, d, "")
    assert got.columns == d.columns
    assert {r.doc_id for r in got.collect()} == set(want.values())


def test_pipeline_stage_on_documents(spark):
    import corpus_pipeline

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = components_of({r.doc_id: shingles(r.text or "") for r in rows.select("doc_id", "text").distinct().collect()})
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()} == set(want.values())


def test_near_copies_keep_rows_without_an_id(spark):
    rows = near.drop_near_copies(docs(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, i) for i in (1, 3, 5, 6, 7)] + [(True, 0)]
    same = docs(spark, [(1, "a first text", "en", "a"), (1, "another one altogether", "en", "a"), (None, "a first text", "en", "a")])
    assert sorted(r.text for r in near.drop_near_copies(same).collect()) == ["a first text", "another one altogether"]
    assert near.drop_near_copies(docs(spark, [])).count() == 0


def test_sketches_rule_out_no_link():
    draw = np.random.default_rng(3)
    ruled = 0
    for n in (1, 2, 5, 63, 64, 130, 500, 3000):
        for _ in range(60):
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            keep = draw.random(len(a)) < draw.uniform(0.5, 1)
            b = np.unique(np.r_[a[keep], draw.integers(0, 1 << 63, draw.integers(0, n // 5 + 2), dtype=np.uint64)])
            if near.alike(a, b):
                assert near.may_be_alike(near.sketch(a), near.sketch(b))
            else:
                ruled += not near.may_be_alike(near.sketch(a), near.sketch(b))
    assert ruled > 50
    assert near.sketch(np.arange(1 << 20, dtype=np.uint64) << np.uint64(40)) == b"" and near.may_be_alike(b"", b"\x01" * 64)


def asked_pairs(monkeypatch):
    """What _verified() is asked, round by round."""
    asked, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *a: asked.append(pairs.count()) or verified(pairs, *a))
    return asked


def edited(rng, vocabulary, base, edits):
    words = list(base)
    for k in rng.sample(range(len(words) // 10), edits):
        words[10 * k + 5] = rng.choice(vocabulary)
    return " ".join(words)


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies that are like the text they come from and not like each other: pairs grow with the group, not its square."""
    rng = random.Random(4)
    vocabulary = [f"u{k}" for k in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [edited(rng, vocabulary, base, 3) for _ in range(160)] + [" ".join(base)]
    sets = {i: shingles(x) for i, x in enumerate(texts)}
    assert sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(160) for j in range(i)) < 2000
    asked = asked_pairs(monkeypatch)
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    assert {(r.node, r.label) for r in near.near_components(rows).collect()} == {(i, 0) for i in range(161)}
    assert sum(asked) < 6 * len(texts)


def test_drawn_hubs_change_no_component(spark, monkeypatch):
    texts = sorted({x.lower(): x for x in edited_texts()}.values())
    want = components_of({i: shingles(x) for i, x in enumerate(texts)})
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    monkeypatch.setattr(near, "ROOM", 0)
    monkeypatch.setattr(near, "SAMPLED", 1)
    asked = asked_pairs(monkeypatch)
    assert {r.node: r.label for r in near.near_components(rows).collect()} == want
    assert len(asked) > 2  # hubs were drawn


def test_pipeline_stage_goes_through_simhash(spark, monkeypatch):
    """SimHash's links come first, the exact check follows, and the join is asked only about what these leave apart."""
    import corpus_pipeline
    from strataflow.llm import simhash

    rng = random.Random(8)
    words = [f"v{k}" for k in range(900)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [" ".join(base), " ".join(base) + " end", "x y z " * 200 + "one", "x y z " * 200 + "two", " ".join(reversed(base))]
    prints = [simhash.fingerprint(x) for x in texts]
    near_bits = {(i, j) for i in range(5) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert near_bits == {(1, 0), (3, 2)}
    linked = simhash.linked_nodes(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()
    assert {(r.a, r.b) for r in linked} == near_bits

    asked = []
    verified = near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *a: asked.extend(pairs.collect()) or verified(pairs, *a))
    d = docs(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])
    # 2 and 3 differ in few bits, but share few of their shingles
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()) == [0, 2, 3, 4]
    assert asked == []
