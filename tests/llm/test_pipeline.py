import random

import corpus_pipeline
import sentencepiece
from helpers import PIECES, docs


def test_stages_on_sf0001(spark):
    docs = first = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == first.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.count() == docs.count() and last.filter("not round_trip").count() == 0


def _survivors(rows):
    """Ids by brute force of each component of texts whose sets of five-word shingles are alike by 0.8 or more."""
    split = [(i, tuple((text or "").split())) for i, text, *_ in rows]
    sets = [(i, frozenset(w[k : k + 5] for k in range(max(1, len(w) - 4)))) for i, w in split]
    groups = []
    for i, s in sets:
        near = [g for g in groups if any(len(s & t) >= 0.8 * len(s | t) for _, t in g)]
        groups = [g for g in groups if g not in near] + [[(i, s), *(x for g in near for x in g)]]
    return [{i for i, _ in g} for g in groups]


def _written(spark, folder, rows, labels):
    docs(spark, rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_run_by_brute_force(spark, tmp_path):
    """No labels, so nothing is rejected: whole groups, nulls, repeated rows and a long text go through all stages."""
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(40)), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "a") for i in range(10)] + [(200 + i, rows[0][1], None, None) for i in range(5)]
    rows += [(300, " ".join(words) * 40, "xx", "b"), (None, "a row without an id is a row all the same", "en", "a"), rows[5], rows[5]]
    groups, text = _survivors(rows), {i: t for i, t, *_ in rows}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = _written(spark, tmp_path, rows, [])
    taken = {r.doc_id for r in got}
    assert all(len(taken & g) <= 1 for g in groups) and len(taken) > 0.5 * len(groups)
    for r in got:
        assert r.round_trip and list(r.ids) == model.encode(text[r.doc_id])
    assert max(sum(r.doc_id == i for r in got) for i in taken) <= 2


def test_run_on_nothing(spark, tmp_path):
    assert _written(spark, tmp_path, [], []) == []
