"""Personal data: spans found by fixed patterns, and further ones by boosted trees over what high-recall generators propose.

The base spans are the matches of each kind's pattern that pass the kind's check (Luhn's sum, a number of digits). Beside
them, generators propose spans of looser formats, which may overlap each other and the base's: numbers that a longer run of
digits and blanks hides, addresses written [at] and [dot], telephone numbers without a plus. Each has features of its format
and of its context. Gradient-boosted trees learn from base spans and from the same spans with a digit or a part spoilt, and
from proposals that the base looked at and refused; what lies over a longer run that the base refused as a whole is in
doubt and teaches nothing. For each kind, held-out examples set the least score at which PRECISION of what scores so high is
right. A proposal of that score, with its kind's check passed, is added unless it lies over a base span or a better proposal.

All of it is column expressions: matches come from regexp_extract_all, their places from the lengths of what split() leaves
between them, features and the trees themselves are CASE expressions over each text's few proposals. Patterns are written
without backtracking (possessive, begun only where no earlier start could match), so a long run costs its length once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: One in HELD_OUT of the examples is kept to set the limits; all others are what trees are fitted to.
HELD_OUT, PRECISION, FEWEST = 2, 0.99, 8
TREES, DEPTH = 12, 3
#: Characters before a span that are its context.
CONTEXT = 32

# What is personal data of each kind. _LOCAL is what an address may begin with, a match may begin only where no
# earlier one could have taken it in; nothing after a possessive part could have used what it took.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    EMAIL: rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
HINT = {EMAIL: "@", IP: r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", CARD: r"[0-9](?:[\x20-]?[0-9]){12}+", PHONE: "+"}
LOOSE = {
    EMAIL: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|\[\.\]|[\[(]dot[\])])[0-9]{1,3}+){3}+(?![0-9])",
    CARD: r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20._/-][0-9]{4}){3}+|[0-9]{4}[\x20._/-][0-9]{6}[\x20._/-][0-9]{5})(?![0-9])",
    PHONE: r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_HINT = {EMAIL: r"@|[\[(]at[\])]", IP: r"[0-9](?:\.|\[\.\]|[\[(]dot[\])])[0-9]", CARD: r"[0-9]{4}[\x20._/-]?[0-9]{4}", PHONE: r"[0-9][\x20.-][0-9]{4}"}
# Words that speak for personal data, or for a number of another kind, before a span.
FOR = r"(?i)mail|contact|phone|call|mobile|tel\b|fax|card|visa|payment|address|\bip\b|host|server|login"
AGAINST = r"(?i)isbn|issn|version|serial|order|invoice|\bdoi\b|\bref\b|section|build|release"

FEATURES = ["kind", "chars", "digits", "marks", "luhn", "largest", "parts", "odd", "before", "after", "speaks_for", "speaks_against", "kinds_of_digits"]


def running_sums(values: Column) -> Column:
    """The sums of the values before each, as an array; in pieces of the square root of its size, so that it takes n sqrt(n) steps at most."""
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(values) / wide).cast("int") - 1)), lambda i: F.slice(values, i * wide + 1, wide))

    def sums(array: Column, add: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, start, lambda acc, v: F.struct((acc["at"] + add(v)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    total = sums(pieces, lambda piece: F.aggregate(piece, F.lit(0), lambda a, v: a + v))
    return F.flatten(F.zip_with(pieces, total, lambda piece, at: F.transform(sums(piece, lambda v: v), lambda v: v + at)))


def with_matches(docs: DataFrame, patterns: dict[str, tuple[int, str, Column]]) -> DataFrame:
    """docs with an array of _SPANS for each name of patterns (kind, pattern, what a text must hold for it to be tried).

    s and e are where a match begins and ends, in code points; before and after are the up to CONTEXT characters and the one
    character beside it, as far as the pattern's next match. Steps are columns of their own, so that each is computed once.
    """
    none, text = F.array().cast("array<string>"), F.col("text")
    docs = docs.withColumns({f"_m_{x}": F.when(hint, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for x, (_, p, hint) in patterns.items()})
    docs = docs.withColumns({f"_g_{x}": F.when(F.size(f"_m_{x}") > 0, F.split(text, p, -1)).otherwise(none) for x, (_, p, _) in patterns.items()})

    def steps(x: str) -> Column:
        return F.zip_with(F.slice(f"_g_{x}", 1, F.size(f"_m_{x}")), f"_m_{x}", lambda gap, m: F.length(gap) + F.length(m))

    docs = docs.withColumns({f"_n_{x}": steps(x) for x in patterns})
    docs = docs.withColumns({f"_at_{x}": F.when(F.size(f"_n_{x}") > 0, running_sums(F.col(f"_n_{x}"))).otherwise(F.array().cast("array<int>")) for x in patterns})

    def spans(x: str, kind: int) -> Column:
        many = F.size(f"_m_{x}")
        beside = F.zip_with(F.slice(f"_g_{x}", 1, many), F.slice(f"_g_{x}", 2, many), lambda v, w: F.struct(F.length(v).alias("n"), F.right(v, F.lit(CONTEXT)).alias("before"), F.left(w, F.lit(1)).alias("after")))
        placed = F.zip_with(f"_at_{x}", beside, lambda at, g: F.struct((at + g["n"]).alias("s"), g["before"].alias("before"), g["after"].alias("after")))
        full = lambda v, m: F.struct(F.lit(kind).alias("kind"), v["s"].alias("s"), (v["s"] + F.length(m)).alias("e"), m.alias("m"), v["before"].alias("before"), v["after"].alias("after"))
        return F.zip_with(placed, f"_m_{x}", full).cast(_SPANS)

    return docs.withColumns({x: spans(x, kind) for x, (kind, _, _) in patterns.items()}).drop(*[f"_{y}_{x}" for x in patterns for y in ("m", "g", "n", "at")])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """What Luhn's sum of a number of at most 20 digits leaves over a multiple of 10."""
    wide, total = F.lpad(number, 20, "0"), F.lit(0)
    for i in range(1, 21):
        d = F.ascii(F.substring(wide, i, 1)) - 48
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10


def passes(kind: int, m: Column) -> Column:
    """Whether a match of a kind's pattern passes the kind's check."""
    if kind == IP:

        def large(part: Column) -> Column:
            value = F.ltrim(part, F.lit("0"))
            return F.when(F.length(value) > 3, F.lit(True)).otherwise(F.concat(F.lit("0"), value).cast("int") > 255)

        return ~F.exists(F.split(m, r"\."), large)
    n = F.length(digits(m))
    if kind == CARD:
        return F.when(n.between(13, 19), luhn(digits(m)) == 0).otherwise(F.lit(False))
    return n.between(9, 15) if kind == PHONE else F.lit(True)


_SPANS = "array<struct<kind:int,s:int,e:int,m:string,before:string,after:string>>"


# -- features and examples


def plain(kind: Column, m: Column) -> Column:
    """A proposal with its kind's usual marks."""
    address = F.regexp_replace(F.regexp_replace(m, r"\x20?[\[(]at[\])]\x20?|\x20?@\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?|\x20?\.\x20?", ".")
    return F.when(kind == EMAIL, address).when(kind == IP, F.regexp_replace(m, r"\[\.\]|[\[(]dot[\])]", ".")).otherwise(m)


def check(kind: Column, m: Column) -> Column:
    """Whether a proposal passes its kind's check once its marks are the usual ones."""
    usual = plain(kind, m)
    n = F.length(digits(m))
    return (
        F.when(kind == EMAIL, F.rlike(usual, F.lit(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")))
        .when(kind == IP, F.rlike(usual, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$")) & passes(IP, usual))
        .when(kind == CARD, passes(CARD, m))
        .otherwise(n.between(9, 15))
    )


def features(v: Column) -> Column:
    """FEATURES of a span: of its text (size, digits, marks, Luhn's rest, largest and number of dotted parts, unusual marks) and of what lies beside it."""

    def near(c: Column) -> Column:
        return F.when(F.rlike(c, F.lit("[0-9]")), 3.0).when(F.rlike(c, F.lit(r"\p{L}")), 2.0).when(F.rlike(c, F.lit(r"^\S")), 1.0).otherwise(0.0)

    kind, m, before = v["kind"], v["m"], v["before"]
    usual, number, some = plain(kind, m), digits(m), F.lit(0)
    for d in "0123456789":
        some = some + F.contains(number, F.lit(d)).cast("int")
    parts = F.split(F.when(kind == IP, usual).otherwise(F.lit("")), r"\.")
    largest = F.array_max(F.transform(parts, lambda x: F.concat(F.lit("0"), F.right(digits(x), F.lit(6))).cast("int")))
    host = F.when(kind == EMAIL, F.size(F.split(F.substring_index(usual, "@", -1), r"\."))).otherwise(F.size(parts))
    values = [
        kind, F.length(m), F.length(number), F.length(F.regexp_replace(m, r"[\p{L}0-9]", "")), F.when((kind == CARD) & (F.length(number) <= 20), luhn(number)).otherwise(-1),
        largest, host, (usual != m).cast("int"), near(F.right(before, F.lit(1))), near(v["after"]), F.rlike(before, F.lit(FOR)).cast("int"),
        F.rlike(before, F.lit(AGAINST)).cast("int"), some,
    ]
    return F.struct(*[F.coalesce(x.cast("double"), F.lit(0.0)).alias(name) for name, x in zip(FEATURES, values)])


def _overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _like(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["s"] == b["s"]) & (a["e"] == b["e"])


def spoilt(kind: Column, m: Column) -> Column:
    """The span with what its check looks at made wrong."""
    last = (F.ascii(F.substring(m, -1, 1)) - 48 + 1) % 10
    return (
        F.when(kind == EMAIL, F.regexp_replace(m, r"\..*$", "")).when(kind == IP, F.concat(m, F.lit("999")))
        .when(kind == CARD, F.concat(F.substr(m, F.lit(1), F.length(m) - 1), last.cast("string"))).otherwise(F.substr(m, F.lit(1), F.greatest(F.lit(6), F.length(m) - 8)))
    )


def examples(spans: DataFrame) -> DataFrame:
    """label, features (f) and number of all different spans of spans(base, refused, loose)."""

    def wrong(v: Column) -> Column:
        return F.struct(F.lit(0.0).alias("label"), v.withField("m", spoilt(v["kind"], v["m"])).alias("v"))

    seen = F.filter("refused", lambda v: F.exists("loose", lambda c: _like(v, c)))
    right, refused = F.transform("base", lambda v: F.struct(F.lit(1.0).alias("label"), v.alias("v"))), F.transform(seen, lambda v: F.struct(F.lit(0.0).alias("label"), v.alias("v")))
    each = spans.select(F.explode(F.concat(right, F.transform("base", wrong), refused)).alias("x")).select("x.label", "x.v")
    each = each.groupBy("label", "v.kind", "v.m", "v.before", "v.after").agg(F.count("*").alias("n"))
    # Equal examples are one; the hash tells which ones are held out, whatever the order of rows.
    each = each.withColumn("hash", F.xxhash64("m", "before", "after", "kind", "label")).sortWithinPartitions("hash", "label", "m")
    return each.select("label", features(F.struct("kind", "m", "before", "after")).alias("f"), "n", "hash")


@dataclass
class Model:
    """Boosted trees as a column expression, and the least margin of each kind that is taken (None: none is)."""

    trees: list[tuple[float, tuple]] = field(default_factory=list)
    limits: dict[int, float] = field(default_factory=dict)

    def margin(self, f: Column) -> Column:
        total = F.lit(0.0)
        for weight, node in self.trees:
            total = total + F.lit(weight) * self._case(node, f)
        return total

    def _case(self, node: tuple, f: Column) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        at, limit, left, right = node
        return F.when(f[FEATURES[at]] <= limit, self._case(left, f)).otherwise(self._case(right, f))

    def least(self, kind: Column) -> Column:
        out = F.lit(float("inf"))
        for k, limit in self.limits.items():
            out = F.when(kind == k, F.lit(limit)).otherwise(out)
        return out


def _node(java: object) -> tuple:
    if java.subtreeDepth() == 0:
        return (float(java.prediction()),)
    split = java.split()
    return int(split.featureIndex()), float(split.threshold()), _node(java.leftChild()), _node(java.rightChild())


def fit(spans: DataFrame) -> Model:
    """Trees and limits from all examples; a table without examples of both labels gives a model that takes nothing."""
    sample = materialize(examples(spans), "pii-examples")
    held = F.pmod("hash", F.lit(HELD_OUT)) == 0
    taught = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.filter(~held).select("label", F.col("n").cast("double").alias("n"), "f.*"))
    if taught.select("label").distinct().count() < 2:
        return Model()
    fitted = GBTClassifier(labelCol="label", featuresCol="features", weightCol="n", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=4, seed=7).fit(taught)
    model = Model([(float(w), _node(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees)])
    scored = sample.filter(held).select(F.col("f.kind").cast("int").alias("kind"), "label", model.margin(F.col("f")).alias("score"))
    grouped = scored.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count("*").alias("all"))
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    right = grouped.select("kind", "score", F.sum("good").over(above).alias("good"), F.sum("all").over(above).alias("all"))
    limits = right.filter((F.col("good") >= PRECISION * F.col("all")) & (F.col("good") >= FEWEST)).groupBy("kind").agg(F.min("score").alias("least"))
    model.limits = {r["kind"]: r["least"] for r in limits.collect()}  # a row a kind
    return model


# -- spans


def spans_of(docs: DataFrame) -> DataFrame:
    """docs (with a column text, never null) with base, refused and loose: spans that pass, that the base refused, and proposals."""
    text = F.col("text")
    patterns = {f"_base{k}": (k, BASE[k], F.contains(text, F.lit(HINT[k])) if k in (EMAIL, PHONE) else F.rlike(text, F.lit(HINT[k]))) for k in range(4)}
    patterns |= {f"_loose{k}": (k, LOOSE[k], F.rlike(text, F.lit(LOOSE_HINT[k]))) for k in range(4)}

    def sifted(kind: int, good: bool) -> Column:
        return F.filter(f"_base{kind}", lambda v: passes(kind, v["m"]) == F.lit(good))

    good, bad = (F.concat(*[sifted(k, x) for k in range(4)]) for x in (True, False))
    loose = F.concat(*[F.col(f"_loose{k}") for k in range(4)])
    return with_matches(docs, patterns).withColumns({"base": good, "refused": bad, "loose": loose}).drop(*patterns)


def with_added(spans: DataFrame, model: Model) -> DataFrame:
    """spans with added: the proposals that the model takes, each apart from the base spans and from the other ones."""
    if not model.limits:
        return spans.withColumn("added", F.array().cast(_SPANS))
    unlike = F.filter("loose", lambda c: ~F.exists("base", lambda b: _overlaps(c, b)))

    def scored(v: Column) -> Column:
        return F.struct(F.when(check(v["kind"], v["m"]), model.margin(features(v))).otherwise(F.lit(float("-inf"))).alias("score"), v.alias("v"))

    def rank(x: Column) -> Column:
        return F.struct(x["score"], x["v"]["e"] - x["v"]["s"], -x["v"]["s"], -x["v"]["kind"])

    spans = spans.withColumn("_taken", F.filter(F.transform(unlike, scored), lambda x: x["score"] >= model.least(x["v"]["kind"])))
    best = F.filter("_taken", lambda x: ~F.exists("_taken", lambda y: _overlaps(x["v"], y["v"]) & (rank(y) > rank(x))))
    return spans.withColumn("added", F.transform(best, lambda x: x["v"])).drop("_taken")


def written(spans: Column) -> Column:
    """kind:start:end of each span, by kind, then by start, joined by commas."""
    place = F.array_sort(F.transform(spans, lambda v: F.struct(v["kind"], v["s"], v["e"])))
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(place, lambda v: F.concat_ws(":", names[v["kind"]], v["s"].cast("string"), v["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, base, added (and text) of docs(doc_id, text): arrays of spans, places in code points, ends exclusive.

    kind counts KINDS from 0. Other columns do not matter, a null text is empty, every row (repeated, or without an id)
    gives one. The trees are fitted to spans of docs; where these are too few to set limits, nothing is added. An empty table
    gives no rows.
    """
    spans = spans_of(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    spans = materialize(spans if keep_text else spans.drop("text"), "pii-spans")
    return with_added(spans, fit(spans)).drop("refused", "loose")


def redacted(found: DataFrame) -> DataFrame:
    """doc_id, text of the rows of find_pii() with their text, each span replaced by its kind in square brackets (overlapping spans by the first's)."""
    all_spans = F.array_sort(F.transform(F.concat("base", "added"), lambda v: F.struct(v["s"], v["e"], v["kind"])))
    names, text = F.array(*[F.lit(x) for x in KINDS]), F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        piece = F.concat(F.substr(text, acc["at"] + 1, v["s"] - acc["at"]), F.lit("["), names[v["kind"]], F.lit("]"))
        fresh = v["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], v["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(all_spans, start, step)
    return found.select("doc_id", done.alias("_d"), "text").select("doc_id", F.concat(F.array_join("_d.out", ""), F.substr("text", F.col("_d.at") + 1, F.length("text"))).alias("text"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans, n_added of find_pii()."""
    found = find_pii(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda v: v["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
