"""Token counts of fields or sections by offset mapping.

A document is encoded whole, once. Each token covers a span of characters; each section is a span too. The spans are
joined by interval, and a token that crosses a section's edge is dealt by a rule:
  start     to the section of its first character
  end       to the section of its last character
  overlap   to the section it shares most characters with, the earlier one when equal
  split     to each section by the share of its characters there (fractional counts)
Tokens (or parts) outside all sections go to none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "overlap", "split")


def allocate(starts: np.ndarray, stops: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; sections [lo, hi) ascend and do not overlap, nor do their tokens' first characters descend."""
    out = np.zeros(len(lo))
    if not len(starts) or not len(lo):
        return out
    first, last = np.searchsorted(hi, starts, side="right"), np.searchsorted(lo, np.maximum(stops, starts + 1) - 1, side="right") - 1
    if rule in ("start", "end"):
        k = first if rule == "start" else last
        at = starts if rule == "start" else np.maximum(stops, starts + 1) - 1
        safe = np.clip(k, 0, len(lo) - 1)
        ok = (k >= 0) & (k < len(lo)) & (lo[safe] <= at) & (at < hi[safe])
        return np.bincount(k[ok], minlength=len(lo)).astype(float)
    inside = (first == last) & (first < len(lo))
    safe = np.clip(first, 0, len(lo) - 1)
    whole = inside & (lo[safe] <= starts) & (stops <= hi[safe])
    out += np.bincount(first[whole], minlength=len(lo))
    for i in np.flatnonzero(~whole & (first <= last)):
        k = np.arange(first[i], last[i] + 1)
        shared = np.minimum(hi[k], stops[i]) - np.maximum(lo[k], starts[i])
        if rule == "overlap":
            if shared.max() > 0:
                out[k[np.argmax(shared)]] += 1
        else:
            out[k] += np.maximum(shared, 0) / max(1, stops[i] - starts[i])
    return out


def token_spans(enc: object, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token. A character of several tokens counts whole for each."""
    ids = np.frombuffer(enc.ids(text), "<u4")
    stops = np.cumsum(enc.n_bytes[ids])
    starts = stops - enc.n_bytes[ids]
    if not text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((codes & 0xC0) != 0x80) - 1  # of each byte
        starts, stops = char[starts], char[stops - 1] + 1
    return starts, stops


def attribute_tokens(
    docs: DataFrame,
    tokenizer: str,
    sections: Column | None = None,
    rule: str = "overlap",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, section (its place), name, start, stop, tokens, crossing (tokens over its edges), doc_tokens.

    sections: array<struct<name, start, stop>> per row, ascending and apart (others end the query); the lines if not given. Every section
    gives a row, those without tokens too. A null text is empty and has one line, [0, 0). Null sections give no row,
    repeated rows repeated ones, an empty table none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    given = sections is not None
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *([sections.alias("sections")] if given else []))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.pretokens import encoder

        enc = encoder(tokenizer)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            spans = batch.column(2).to_pylist() if given else [None] * len(ids)
            for doc_id, text, own in zip(ids, texts, spans):
                if given:
                    own = own or []
                    names = [x["name"] for x in own]
                    lo, hi = np.array([x["start"] for x in own], np.int64), np.array([x["stop"] for x in own], np.int64)
                    if (hi < lo).any() or (lo[1:] < hi[:-1]).any():
                        raise ValueError(f"sections of {doc_id!r} do not ascend, or overlap")
                else:
                    hi = np.cumsum([len(x) + 1 for x in text.split("\n")])
                    lo = np.r_[0, hi[:-1]]
                    hi[-1] -= 1
                    names = list(map(str, range(len(lo))))
                starts, stops = token_spans(enc, text)
                counts = allocate(starts, stops, lo, hi, rule)
                edge = allocate_edges(starts, stops, lo, hi)
                n = len(lo)
                for col, x in zip(cols, ([doc_id] * n, range(n), names, lo, hi, counts, edge, [len(starts)] * n)):
                    col.extend(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], batch.schema.field(0).type),
                    pa.array(cols[1], pa.int32()),
                    pa.array(cols[2], pa.string()),
                    *(pa.array(c, pa.int64()) for c in cols[3:5]),
                    pa.array(cols[5], pa.float64()),
                    *(pa.array(c, pa.int64()) for c in cols[6:]),
                ],
                names=["doc_id", "section", "name", "start", "stop", "tokens", "crossing", "doc_tokens"],
            )

    return rows.mapInArrow(
        count, f"doc_id {kind}, section int, name string, start long, stop long, tokens double, crossing long, doc_tokens long"
    )


def allocate_edges(starts: np.ndarray, stops: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many tokens lie across an edge of each section: inside in part, outside in part. One across both edges counts once."""
    at_lo = np.searchsorted(starts, lo, side="left") - np.searchsorted(np.maximum.accumulate(stops), lo, side="right") if len(starts) else np.zeros(len(lo), int)
    at_hi = np.searchsorted(starts, hi, side="left") - np.searchsorted(np.maximum.accumulate(stops), hi, side="right") if len(starts) else np.zeros(len(hi), int)
    across = np.searchsorted(starts, lo, side="left") - np.searchsorted(np.maximum.accumulate(stops), hi, side="right") if len(starts) else np.zeros(len(hi), int)
    both = np.maximum(at_lo, 0) + np.maximum(at_hi, 0) - np.maximum(across, 0)
    return np.where(hi > lo, both, 0)
