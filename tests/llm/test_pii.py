"""Personal data against Python's patterns, and what the trees add."""

import hashlib
import re

import numpy as np

from strataflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base(t):
    only = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(only(m)) <= 19 and luhn(only(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(only(m)) <= 15]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def docs(spark, texts):
    rows = [(i if i else None, t, 1, "k", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind int, base string, loose string")


PARTS = ["a@b.c", "x.y%z@", "@", ".", "..", "-", " ", "  ", "+", "+1 ", "(555) ", "4111 1111 1111 1111", "4111111111111111", "4111-1111 1111-1112", "1.2.3.4", "256.1.1.1", "001.02.3.255", "é", "🎉", "7", "12", "\n", "a", "%", "1234567890", " ", "0" * 40]


def test_base_by_hand(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(PARTS, int(rng.integers(1, 14)))) for _ in range(1500)]
    texts += [None, "", "9" * 30_000, "1 " * 20_000, "1.2.3.4." * 3000, "a" * 30_000 + "@" + "b." * 9000, "1.1.1." + "0" * 3000 + "1", "a@b.c%d@e.f@g.h-i.j", "+1+1+1(((" * 2000]
    got = {r["doc_id"]: r for r in pii.pii_report(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = base(t or ""), got[i if i else None]
        assert r["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest(), t
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == w[0] for w in want) for k in pii.KINDS]
        spans = [x for x in r["spans"].split(",") if x]
        assert {x for x in written(want).split(",") if x} <= set(spans) and len(spans) == len(want) + r["n_added"]


def card(rng):
    d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    return next(d + str(k) for k in range(10) if luhn(d + str(k)))


def test_trees_add_what_longer_runs_hide(spark):
    rng = np.random.default_rng(2)
    texts = []
    for i in range(400):
        ip = ".".join(map(str, rng.integers(1, 255, 4)))
        phone = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        wrong = str(rng.integers(10**15, 10**16 - 1))
        texts.append([f"Pay with {card(rng)} now.", f"Server {ip} is down.", f"Call {phone} today.", f"Mail to u{i}@host{i}.example.com please.", f"Order {wrong if not luhn(wrong) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)} came."][i % 5])
    one, two, plain = card(rng), card(rng), "No numbers here, version 1.2.3 of 2024-01-01 at 10:30, isbn 9780306406157123."
    texts += [f"Pay with {one} {two} now.", "Call +1 (212) 555-1234 10.20.30.40 today.", "Mail to someone [at] host [dot] example [dot] com please.", plain]
    rows = {r["doc_id"]: r for r in pii.find_pii(docs(spark, texts)).collect()}
    found = [[v["m"] for v in rows[len(texts) - 4 + k]["added"]] for k in range(4)]
    assert found[0] == [one, two] and "+1 (212) 555-1234" in found[1] and found[2] == ["someone [at] host [dot] example [dot] com"] and not found[3]
    clean = [r for r in rows.values() if r["doc_id"] and r["doc_id"] % 5 == 4 and r["doc_id"] < 400]
    assert not any(r["added"] or r["base"] for r in clean)


def test_trees_are_those_of_the_library(spark):
    """The column expression gives the margin that the fitted trees give."""
    stump = (4, 0.5, (1.0,), (3, 2.0, (-1.0,), (0.25,)))
    model = pii.Model([(1.0, stump), (0.5, stump)], {})
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.0, 9.0), (1.0, 2.0), (1.0, 3.0)], "luhn double, marks double")
    f = F.struct(*[F.col(x) if x in ("luhn", "marks") else F.lit(0.0).alias(x) for x in pii.FEATURES])
    assert [r[0] for r in rows.select(model.margin(f)).collect()] == [1.5, -1.5, 0.375]


def test_redacted(spark):
    texts = ["x", "Mail a@b.com, call +1 (212) 555-1234.", None, "clean", "🎉 1.2.3.4"]
    got = {r["doc_id"]: r["text"] for r in pii.redacted(pii.find_pii(docs(spark, texts), keep_text=True)).collect()}
    assert got == {None: "x", 1: "Mail [email], call [phone].", 2: "", 3: "clean", 4: "🎉 [ip]"}


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([1] * n,) for n in (0, 1, 2, 3, 10, 101)], "v array<int>")
    for r in rows.select("v", F.when(F.size("v") > 0, pii.running_sums(F.col("v"))).otherwise(F.array().cast("array<int>")).alias("s")).collect():
        assert r["s"] == list(range(len(r["v"])))


def test_empty(spark):
    assert pii.pii_report(docs(spark, [])).count() == 0


def test_examples_are_all_of_them(spark):
    """More than 20,000: each address once as it is and once spoilt."""
    from pyspark.sql import functions as F

    rows = spark.range(10_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail to a"), "id", F.lit("@example.org now")).alias("text"))
    assert pii.examples(pii.spans_of(rows)).count() == 20_600
