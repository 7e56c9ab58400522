"""The language model is whole at every size: no n-gram is left out, and blocks of any size give the same scores."""

import math
import random

import pytest

from strataflow.llm import quality


def scored_by_hand(model, lang, text):
    """Back-off, character by character, from a dictionary."""
    total, padded = 0.0, quality.START * (quality.ORDER - 1) + text
    for end in range(quality.ORDER - 1, len(padded)):
        for k in range(quality.ORDER, -1, -1):
            gram = padded[end - k + 1 : end + 1]
            if k == 0:
                total -= math.log(quality.UNIFORM)
            elif ("gram", lang, gram) in model:
                total -= model["gram", lang, gram]
                break
            else:
                total -= model.get(("context", lang, gram[:-1]), 0.0)
    return total


def test_large_models_are_not_cut(spark, monkeypatch):
    rng = random.Random(4)
    texts = [("".join(rng.choice("abcdeé中文 ") for _ in range(rng.randint(0, 60))), rng.choice(["en", "xx"])) for _ in range(60)]
    monkeypatch.setattr(quality, "MAX_GRAMS", 40, raising=False)
    trained = spark.createDataFrame([(lang, text) for text, lang in texts[:40]], "lang string, text string")
    counts = quality.count_grams(trained)
    model = spark.createDataFrame(quality.kneser_ney(counts).collect(), "kind string, lang string, gram string, value double")
    rows = {(r.kind, r.lang, r.gram): r.value for r in model.collect()}
    assert sum(kind == "gram" and len(gram) == quality.ORDER for kind, _, gram in rows) == counts.count()
    d = spark.createDataFrame([(i, text, lang) for i, (text, lang) in enumerate([*texts, ("abc", "none"), (None, "en")])], "doc_id long, text string, lang string")
    for size in (1 << 25, 900, 50):
        monkeypatch.setattr(quality, "BLOCK", size)
        got = {r.doc_id: r for r in quality.add_scores(d, model).collect()}
        assert len(got) == len(texts) + 2
        assert got[len(texts)]._lm_nll is None and got[len(texts) + 1]._lm_nll == 0
        for i, (text, lang) in enumerate(texts):
            assert got[i]._lm_nll == pytest.approx(scored_by_hand(rows, lang, text), rel=1e-9)
