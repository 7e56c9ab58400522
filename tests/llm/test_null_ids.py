"""Rows without an id, and unlike texts of one id, in the SimHash operators."""

from helpers import docs

from strataflow.llm import simhash


def test_rows_without_an_id_carry_links(spark, monkeypatch):
    prints = {"a": 0, "b": 0b111, "c": 0b111111, "d": -1, "e": -2}
    monkeypatch.setattr(
        simhash, "add_fingerprint", lambda d, text, name, shingle: d.join(spark.createDataFrame(list(prints.items()), f"{text} string, {name} long"), text)
    )
    rows = [(1, "a", "en", "a"), (None, "b", "en", "a"), (2, "c", "en", "a"), (None, "d", "en", "a"), (None, "e", "en", "a")]
    got = {r.fp: r.component_id for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert got == {0: 1, 0b111: 1, 0b111111: 1, -1: None, -2: None}


def test_unlike_texts_of_one_id_both_stay(spark):
    rows = [(1, "a first text", "en", "a"), (1, "another one altogether", "en", "a"), (2, "a first text", "en", "a")]
    assert sorted(r.text for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()) == ["a first text", "another one altogether"]
