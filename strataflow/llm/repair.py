"""Re-Pair grammar compression of token ids, in numpy, with random access to each document.

A shard holds the ids of some documents in a row. Every round counts the adjacent pairs that lie within a document,
makes the most frequent ones rules (a new symbol for a pair) and replaces their occurrences; where chosen pairs
overlap, the more frequent one goes first and the rest waits for the next round. Rules refer to ids or earlier rules
only. The block stores the rules, the length each rule expands to, and where each document begins, both in symbols and in
ids, so that one document is decoded without the others.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG1"
#: Slots in which pairs are counted (a power of two), and the odd multipliers that deal them.
_SLOT_BITS = 18
_MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _pack(values: np.ndarray) -> bytes:
    """The low 16 bits of each value, then the bits above them, 8 bits each (symbols are under 2^24)."""
    return (values & 0xFFFF).astype("<u2").tobytes() + (values >> 16).astype(np.uint8).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2", n).astype(np.int64) | (np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.int64) << 16)


def _frequent(seq: np.ndarray, ends: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs in order, the places where they are and the rank of each place's pair; none spans an end.

    Pairs are counted in hashed slots, and only the fullest slots are looked into. A slot stands for its last pair; another
    pair of the same slot waits for the next round.
    """
    slots = 1 << _SLOT_BITS
    slot = (seq[:-1] * _MIX[0]) ^ (seq[1:] * _MIX[1])
    slot = (slot >> np.uint32(32 - _SLOT_BITS)).astype(np.intp)
    slot[ends[(ends > 0) & (ends < len(seq))] - 1] = slots
    load = np.bincount(slot, minlength=slots + 1)[:slots]
    full = np.flatnonzero(load >= least)
    if len(full) > most:
        full = full[np.argpartition(-load[full], most)[:most]]
    rank_of = np.full(slots + 1, -1, np.int32)
    rank_of[full] = np.arange(len(full), dtype=np.int32)
    rank = rank_of.take(slot, mode="clip")
    places = np.flatnonzero(rank >= 0)
    rank = rank.take(places, mode="clip").astype(np.intp)
    pair = seq.take(places, mode="clip").astype(np.uint64) << np.uint64(32)
    pair |= seq[1:].take(places, mode="clip")
    pairs = np.zeros(len(full), np.uint64)
    pairs[rank] = pair
    same = pairs.take(rank, mode="clip") == pair
    counts = np.bincount(rank[same], minlength=len(full))
    order = np.lexsort((pairs, -counts))[: int((counts >= least).sum())]
    new_rank = np.full(len(full), -1, np.int32)
    new_rank[order] = np.arange(len(order), dtype=np.int32)
    rank = new_rank.take(rank, mode="clip")
    same &= rank >= 0
    return pairs[order], places[same], rank[same]


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, rounds: int = 6, per_round: int = 4096, least: int = 6) -> bytes:
    """A block of the documents whose ids (below base) follow each other in `ids`.

    At most `per_round` rules a round, each for a pair that occurs `least` times or more; fewer when none is left.
    """
    seq = ids.astype(np.uint32)
    starts = np.r_[0, np.cumsum(lengths.astype(np.int64))]
    begins = starts.copy()  # of the documents among the symbols, and where the last one ends
    rules: list[np.ndarray] = []
    spans = np.ones(base, np.int64)  # rules are made of ids and earlier rounds' rules
    for _ in range(rounds):
        if len(seq) < 2:
            break
        pairs, places, rank = _frequent(seq, begins[1:], least, per_round)
        if not len(pairs):
            break
        # Of overlapping occurrences the more frequent pair's goes first; of equals the one to the left.
        after = places[1:] == places[:-1] + 1
        stays = np.ones(len(places), bool)
        stays[:-1] &= ~(after & (rank[:-1] > rank[1:]))
        stays[1:] &= ~(after & (rank[1:] >= rank[:-1]))
        chosen, rank = places[stays], rank[stays]
        used = np.bincount(rank, minlength=len(pairs)) > 0
        made = pairs[used].astype(np.int64)
        rules.append(np.stack([made >> 32, made & 0xFFFFFFFF], 1))
        seq[chosen] = (len(spans) + np.cumsum(used) - 1).astype(np.uint32)[rank]
        spans = np.r_[spans, spans[rules[-1]].sum(1)]
        stay = np.ones(len(seq), bool)
        stay[chosen + 1] = False
        seq = seq[stay]
        begins = begins - np.searchsorted(chosen + 1, begins, side="left")
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return b"".join(
        [
            struct.pack("<4sIIII", MAGIC, base, len(grammar), len(lengths), len(seq)),
            grammar.astype("<u4").tobytes(),
            spans[base:].astype("<u4").tobytes(),
            begins.astype("<u4").tobytes(),
            starts.astype("<u4").tobytes(),
            _pack(seq),
        ]
    )


class Block:
    """A block read back: n documents, each decoded on its own by ids(k), or all by all_ids()."""

    def __init__(self, raw: bytes) -> None:
        magic, self.base, n_rules, self.n, n_seq = struct.unpack_from("<4sIIII", raw)
        if magic != MAGIC:
            raise ValueError("not a block of grammar-compressed ids")
        at = struct.calcsize("<4sIIII")

        def array(k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, "<u4", k, at).astype(np.int64)
            at += 4 * k
            return out

        self.rules = array(2 * n_rules).reshape(-1, 2)
        self.spans = array(n_rules)
        self.begins, self.starts = array(self.n + 1), array(self.n + 1)
        self.symbols = _unpack(raw[at:], n_seq)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while True:
            rule = seq >= self.base
            if not rule.any():
                return seq
            place = np.cumsum(1 + rule) - 1 - rule
            out = np.empty(len(seq) + int(rule.sum()), np.int64)
            out[place[~rule]] = seq[~rule]
            pairs = self.rules[seq[rule] - self.base]
            out[place[rule]], out[place[rule] + 1] = pairs[:, 0], pairs[:, 1]
            seq = out

    def all_ids(self) -> np.ndarray:
        """Every rule is written out once; the symbols then copy from there."""
        if not len(self.symbols):
            return self.symbols
        held = np.bincount(self.symbols) > 0
        used = np.flatnonzero(held)
        which = (np.cumsum(held) - 1)[self.symbols]
        text, spans = self._expand(used), np.where(used < self.base, 1, self.spans[np.maximum(used - self.base, 0)] if len(self.spans) else 1)
        begin, length = (np.cumsum(spans) - spans)[which], spans[which]
        at = np.cumsum(length) - length
        return text[np.repeat(begin - at, length) + np.arange(int(length.sum()))]

    def ids(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.begins[k] : self.begins[k + 1]])

    def id_at(self, place: int) -> int:
        """The id at a place of the block: only its symbol is expanded, down one path by the rules' lengths."""
        k = int(np.searchsorted(self.starts, place, side="right")) - 1
        offset = place - int(self.starts[k])
        for symbol in self.symbols[self.begins[k] : self.begins[k + 1]].tolist():
            span = 1 if symbol < self.base else int(self.spans[symbol - self.base])
            if offset >= span:
                offset -= span
                continue
            while symbol >= self.base:
                a, b = self.rules[symbol - self.base].tolist()
                span = 1 if a < self.base else int(self.spans[a - self.base])
                symbol, offset = (a, offset) if offset < span else (b, offset - span)
            return int(symbol)
        raise IndexError(place)
