"""A quality classifier: per-document perplexity under a character n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model for each language, trained on all trusted documents (labelled of
good quality, or a list the caller gives). Its counts are tables: raw counts of the highest order, continuation counts
below, and for each context how many continuations were seen once, twice, more often. These are shuffled by n-gram
(sharded) and joined level by level into probabilities and back-off weights.

Documents are scored by joins too, so no part of the model is broadcast, collected or left out. They are dealt into blocks of
about BLOCK characters; each block asks once for every different n-gram it holds. The different n-grams of all blocks are
joined with the model level by level, from single characters up (the n-gram's own probability, or its context's back-off
weight and the cost of its suffix), the costs are joined back to the blocks that asked, and each block meets its documents
again, where a document's costs are summed.

A document's score is its mean negative log-likelihood a character, drawn towards its language's median as if PRIOR more
characters of median score had been read. One trusted document in HELD_OUT is kept out of the training, and these give
each language's quantiles. A document is rejected above median + SPREAD x (99 % quantile - median), the margin held in
MARGINS since a small language has few documents to take a quantile from. Text made of immediate repetitions is likely under any n-gram model, so the share of words
equal to the word before is held against the same kind of limit, and never under REPEATS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.common import discard, give_back, lean, materialize, numbered

ORDER, UNIFORM = 4, 1 / 4096
PRIOR, SPREAD, MARGINS, REPEATS, HELD_OUT = 64, 2.0, (0.4, 0.9), 0.2, 5
START = "\x02"
#: Characters of documents scored together (a row weighs ROW more than its text): large blocks ask less often, but a worker holds one.
BLOCK, ROW = 1 << 25, 64
#: Characters counted at once, and the multiplier of the rolling hash.
_STEP, _MIX = 1 << 21, np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ORDER - 1 starts, and where each text's own begin (and the end)."""
    pad = START * (ORDER - 1)
    codes = np.frombuffer("".join(pad + x for x in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.cumsum([0, *(len(x) + ORDER - 1 for x in texts)])


def _last_places(bounds: np.ndarray) -> np.ndarray:
    """The places at which an n-gram of a text ends."""
    inside = np.ones(int(bounds[-1]), bool)
    for k in range(ORDER - 1):
        inside[bounds[:-1] + k] = False
    return np.flatnonzero(inside)


def _gram_counts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The different n-grams of the highest order in the texts, and how often each is there."""
    codes, bounds = _codes(texts)
    ends = _last_places(bounds)
    if not len(ends):
        return [], np.zeros(0, np.int64)
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    letters, small = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[codes]
    del codes
    bits = max(1, int(len(letters) - 1).bit_length())
    columns = (small[ends - (ORDER - 1 - k)] for k in range(ORDER))
    if bits * ORDER > 63:  # too many different characters for one number
        found, counts = np.unique(np.stack([*columns], 1), axis=0, return_counts=True)
        parts = letters[found]
    else:
        key = np.zeros(len(ends), np.int64)
        for column in columns:
            key = (key << bits) | column
        keys, counts = np.unique(key, return_counts=True)
        parts = np.stack([letters[(keys >> (bits * (ORDER - 1 - k))) & ((1 << bits) - 1)] for k in range(ORDER)], 1)
    whole = parts.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)], counts


def _steps(rows: list, size: int, text=lambda x: x) -> Iterator[list]:
    """The rows in lists whose texts have about so many characters."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(text(row))
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def _by_lang(langs: list[str | None], texts: list[str | None]) -> dict[str, list[tuple[int, str]]]:
    """Place and text of the rows of each language; nulls are ''."""
    found: dict[str, list[tuple[int, str]]] = {}
    for i, (lang, text) in enumerate(zip(langs, texts)):
        found.setdefault(lang or "", []).append((i, text or ""))
    return found


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: raw counts of the highest order over all of docs(lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows in _by_lang(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                for some in _steps(rows, _STEP, lambda x: x[1]):
                    grams, counts = _gram_counts([text for _, text in some])
                    columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    counted = docs.mapInArrow(lean(count), "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """kind ('gram' or 'context'), lang, gram, value (log probability or log back-off weight) from count_grams()'s table."""
    out, made = None, []
    tables = {ORDER: materialize(counts, f"grams{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        lower = tables[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        tables[k] = materialize(lower, f"grams{k}")
    below = None
    for k in range(1, ORDER + 1):
        grams = tables[k]
        seen = [F.greatest(F.lit(1), F.count_if(F.col("n") == i)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        discount = grams.groupBy("lang").agg(*seen)
        for i in (1, 2, 3):
            value = i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")
            discount = discount.withColumn(f"d{i}", F.least(F.lit(float(i)), F.greatest(F.lit(0.05 * i), value)))
        discount = discount.select("lang", "d1", "d2", "d3")
        keyed = grams.withColumn("context", F.substring("gram", 1, k - 1))
        contexts = (
            keyed.groupBy("lang", "context")
            .agg(
                F.sum("n").alias("total"),
                F.count_if(F.col("n") == 1).alias("n1"),
                F.count_if(F.col("n") == 2).alias("n2"),
                F.count_if(F.col("n") > 2).alias("n3"),
            )
            .join(discount, "lang")
            .withColumn("weight", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
        )
        contexts = materialize(contexts, f"contexts{k}")
        probs = keyed.join(contexts, ["lang", "context"]).withColumn(
            "own",
            (F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total"),
        )
        if below is None:
            probs = probs.withColumn("p", F.col("own") + F.col("weight") * UNIFORM)
        else:
            suffix = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            probs = (
                probs.withColumn("suffix", F.substring("gram", 2, k - 1))
                .join(suffix, ["lang", "suffix"])
                .withColumn("p", F.col("own") + F.col("weight") * F.col("lower"))
            )
        below = materialize(probs.select("lang", "gram", "p"), f"probs{k}")
        made += [contexts, below]
        found = below.select(F.lit("gram").alias("kind"), "lang", "gram", F.log("p").alias("value")).unionByName(
            contexts.select(F.lit("context").alias("kind"), "lang", F.col("context").alias("gram"), F.log(F.least(F.lit(1.0), "weight")).alias("value"))
        )
        out = found if out is None else out.unionByName(found)
    model = materialize(out, "kneser-ney")
    discard(*tables.values(), *made)
    return model


def _hash(codes: list[np.ndarray]) -> np.ndarray:
    """Of n-grams given as columns of code points."""
    out = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        out = (out + c.astype(np.uint64) + np.uint64(1)) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Costs:
    """Costs by 64-bit key of an n-gram: two tables at hashed slots, and the few keys left over in order."""

    def __init__(self, grams: list[str], costs: np.ndarray) -> None:
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), ORDER)
        keys, values = _hash([codes[:, k] for k in range(ORDER)]), costs
        self.shift = np.uint64(64 - max(10, int(2 * len(keys)).bit_length()))
        self.tables = []
        for mix in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
            size = 1 << (64 - int(self.shift))
            slot = ((keys * mix) >> self.shift).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            key, value = np.zeros(size, np.uint64), np.zeros(size)
            key[slot[first]], value[slot[first]] = keys[first], values[first]
            self.tables.append((mix, key, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The cost of each; all are there."""
        (mix, key, value), (mix2, key2, value2) = self.tables
        slot = ((keys * mix) >> self.shift).astype(np.int64)
        out = value[slot]
        miss = np.flatnonzero(key[slot] != keys)
        if len(miss):
            rest = keys[miss]
            slot = ((rest * mix2) >> self.shift).astype(np.int64)
            out[miss] = value2[slot]
            last = key2[slot] != rest
            if last.any():
                out[miss[last]] = self.values[np.searchsorted(self.keys, rest[last])]
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        """Sum of the costs of each text's characters."""
        codes, bounds = _codes(texts)
        at = _last_places(bounds)
        total = np.zeros(len(codes))
        total[at] = self.find(_hash([codes[at - j] for j in range(ORDER - 1, -1, -1)]))
        sums = np.r_[0.0, np.cumsum(total)]
        return sums[bounds[1:]] - sums[bounds[:-1]]


def gram_costs(grams: DataFrame, model: DataFrame) -> DataFrame:
    """lang, gram, cost of the different grams(lang, gram) of the highest order, by joins with kneser_ney()'s table.

    The cost is the negative log-likelihood of the last character after the others, null for a language that the model has
    not. The gram '' costs 0 in a language that it has.
    """
    wanted = {ORDER: grams.filter(F.length("gram") == ORDER)}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select("lang", F.substring("gram", 2, k).alias("gram")).distinct()
    below = None
    for k in range(1, ORDER + 1):
        own = model.filter((F.col("kind") == "gram") & (F.length("gram") == k)).select("lang", "gram", F.col("value").alias("found"))
        weights = model.filter((F.col("kind") == "context") & (F.length("gram") == k - 1))
        asked = wanted[k].join(own, ["lang", "gram"], "left").withColumn("context", F.substring("gram", 1, k - 1))
        asked = asked.join(weights.select("lang", F.col("gram").alias("context"), F.col("value").alias("weight")), ["lang", "context"], "left")
        if below is None:
            cost = -F.col("weight") - float(np.log(UNIFORM))
        else:
            lower = below.select("lang", F.col("gram").alias("suffix"), F.col("cost").alias("lower"))
            asked = asked.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, ["lang", "suffix"])
            cost = F.col("lower") - F.coalesce("weight", F.lit(0.0))
        below = asked.select("lang", "gram", F.coalesce(-F.col("found"), cost).alias("cost"))
    known = model.filter((F.col("kind") == "context") & (F.col("gram") == "")).select("lang", F.lit(0.0).alias("cost"))
    empty = grams.filter(F.col("gram") == "").join(known, "lang", "left").select("lang", "gram", "cost")
    return below.unionByName(empty)


def repeat_share(text: str) -> float:
    """Words that equal the word before them, as a share of all words but the first."""
    words = text.split()
    return sum(map(str.__eq__, words, words[1:])) / (len(words) - 1) if len(words) > 1 else 0.0


SCORES = ["_lm_chars", "_lm_nll", "_lm_repeats"]


def add_scores(docs: DataFrame, model: DataFrame, lang_col: str = "lang", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns keep, or all) with _lm_chars, _lm_nll (sum; null for a language without trusted text) and _lm_repeats, as a written table.

    Blocks are drawn by a hash of the whole row, so that copies and rows without an id spread; rows equal in all columns share one.
    """
    keep = docs.columns if keep is None else keep
    size = docs.agg(F.sum(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)) + ROW)).first()[0] or 0
    spread = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")], F.lit("block"))
    dealt = docs.withColumn("_lm_block", F.pmod(spread, F.lit(-(-size // BLOCK) or 1)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = None, {}
        for batch in batches:
            if batch.num_rows:
                block = batch.column(0)[0].as_py()
            for lang, rows in _by_lang(batch.column(1).to_pylist(), batch.column(2).to_pylist()).items():
                held = found.setdefault(lang, {""})
                for some in _steps(rows, _STEP, lambda x: x[1]):
                    held.update(_gram_counts([text for _, text in some])[0])
        for lang, grams in found.items():
            columns = [pa.array([block] * len(grams), pa.int64()), pa.array([lang] * len(grams), pa.string()), pa.array(sorted(grams), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "gram"])

    texts = dealt.select("_lm_block", F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    asked = materialize(texts.groupBy("_lm_block").applyInArrow(lean(ask), "block long, lang string, gram string"), "quality-asked")
    grams = materialize(asked.select("lang", "gram").distinct(), "quality-grams")
    costs = materialize(gram_costs(grams, model), "quality-costs")

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        n = docs.num_rows
        chars, nll, repeats = np.zeros(n, np.int64), [None] * n, np.zeros(n)
        by_lang = answers.column("lang").to_pandas().to_numpy()
        for lang, rows in _by_lang(docs.column(lang_col).to_pylist(), docs.column(text_col).to_pylist()).items():
            own = answers.filter(pa.array(by_lang == lang))
            for i, text in rows:
                chars[i], repeats[i] = len(text), repeat_share(text)
            if own.column("cost").null_count:
                continue
            grams, values = own.column("gram").to_pylist(), own.column("cost").to_numpy()
            whole = np.array([x != "" for x in grams], bool)
            costs = Costs([x for x in grams if x], values[whole])
            for some in _steps(rows, _STEP // 4, lambda x: x[1]):
                for (i, _), x in zip(some, costs.of([text for _, text in some]).tolist()):
                    nll[i] = x
            del own, grams, values, costs
            give_back()
        columns = [docs.column(c) for c in keep]
        return pa.table([*columns, pa.array(chars), pa.array(nll, pa.float64()), pa.array(repeats)], names=[*keep, *SCORES])

    kinds = [T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, kind) for c, kind in zip(SCORES, kinds)])
    answers = asked.join(costs, ["lang", "gram"]).select("block", "lang", "gram", "cost")
    scored = materialize(dealt.groupBy("_lm_block").cogroup(answers.groupBy("block")).applyInArrow(score, schema), "quality-scores")
    discard(asked, grams, costs)
    return scored


def _held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("held out")), F.lit(HELD_OUT)) == 0


def train(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The tables of the model of the documents whose ids are in trusted(doc_id), but for those held out. Null texts count as empty."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    # The trusted ids grow with the corpus, so they are shuffled at every size, not broadcast while they happen to be few.
    used = trusted.select("doc_id").distinct().filter(~_held_out())
    chosen = rows.join(used.hint("shuffle_hash"), "doc_id", "left_semi")
    return kneser_ney(count_grams(chosen.select("lang", "text")))


def limits(scores: DataFrame, trusted: DataFrame) -> DataFrame:
    """lang, median, limit, repeat_limit from the scores(doc_id, lang, _lm_*) of the trusted documents that were held out.

    A language none of whose trusted documents was held out takes all of them.
    """
    rate = F.when(F.col("_lm_chars") > 0, F.col("_lm_nll") / F.col("_lm_chars"))
    known = scores.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
    both = F.array(F.lit(0.5), F.lit(0.99))

    def quantiles(c: Column) -> Column:
        return F.coalesce(F.percentile_approx(F.when(_held_out(), c), both, 10000), F.percentile_approx(c, both, 10000))

    stats = known.groupBy("lang").agg(quantiles(rate).alias("q"), quantiles(F.col("_lm_repeats")).alias("r"))
    median, low, high = F.col("q")[0], *map(F.lit, MARGINS)
    return stats.select(
        "lang",
        median.alias("median"),
        (median + F.least(F.greatest(SPREAD * (F.col("q")[1] - median), low), high)).alias("limit"),
        F.greatest(F.lit(REPEATS), F.col("r")[0] + SPREAD * (F.col("r")[1] - F.col("r")[0])).alias("repeat_limit"),
    )


def judged(scores: DataFrame, bounds: DataFrame) -> DataFrame:
    """scores with score, perplexity, limit, repeats and keep. Without a limit for its language a document is kept."""
    prior = F.col("_lm_nll") + PRIOR * F.col("median")
    score = prior / (F.col("_lm_chars") + PRIOR)
    found = scores.join(bounds.withColumnRenamed("lang", "_limit_lang"), F.col("lang") == F.col("_limit_lang"), "left").drop("_limit_lang")
    bad = (score > F.col("limit")) | (F.col("_lm_repeats") > F.col("repeat_limit"))
    return (
        found.withColumn("score", score)
        .withColumn("perplexity", F.when(F.col("_lm_chars") > 0, F.exp(F.col("_lm_nll") / F.col("_lm_chars"))))
        .withColumn("keep", ~F.coalesce(bad, F.lit(False)))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled of good quality."""
    return labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, score, limit, repeats, keep of every row.

    Null languages are the language ''. Empty texts have no perplexity and the median's score, so they are kept. With no
    trusted text at all every document is kept. Repeated rows give repeated rows; an empty table none.
    """
    trusted = materialize(trusted_ids(labels), "trusted")
    model = train(docs, trusted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("text"))
    scores = add_scores(rows, model, keep=["doc_id", "lang"])
    discard(model)
    bounds = materialize(limits(scores, trusted), "quality-limits")
    return judged(scores, bounds).select(
        "doc_id", "lang", F.col("_lm_chars").alias("n_chars"), "perplexity", "score", "limit", F.col("_lm_repeats").alias("repeats"), "keep"
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs, whatever their names.

    Null languages are the language ''. Empty and null texts, rows of a language without trusted text and, with no labels,
    all rows are kept. Rows with a null id are judged like others but train nothing. Repeated rows share one verdict. An
    empty table gives none.
    """
    rows, (id_, lang, text) = numbered(docs, id_col, lang_col, text_col)
    trusted = materialize(trusted_ids(labels), "trusted")
    model = train(rows, trusted, id_, lang, text)
    scored = add_scores(rows, model, lang, text).withColumn("_lm_lang", F.coalesce(lang, F.lit("")))
    discard(model)
    bounds = materialize(limits(scored.select(F.col(id_).cast("long").alias("doc_id"), F.col("_lm_lang").alias("lang"), *SCORES), trusted), "quality-limits")
    found = judged(scored.withColumn("lang", F.col("_lm_lang")), bounds)
    return found.filter("keep").select(*rows.columns).toDF(*docs.columns)
