"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is a path through the pieces that match a text, and its score is a sum in the (max, +) semiring:

* unigram models: a step adds the piece's score; the best path is the encoding.
* BPE models: a step adds 0 if the two pieces are compatible, that is if merging their joined text by the model's ranks
  ends in just these two, and -inf if not. A sequence whose neighbours are all compatible is what merging gives, and
  there is one such path, so the path of score 0 is the encoding.

A text is cut into chunks. At each edge between chunks the boundary states are the pieces that could lie over the last
character before it, as (characters to its left, id, characters to its right). A chunk's transfer matrix holds the best
score from each state at its left edge to each at its right edge. Matrices combine by the max-plus product, which is
associative, so they are multiplied in a tree; once every edge's state is known, each chunk is traced back on its own.

Inside a chunk a piece never goes over the beginning of a word (a meta space after another character), unless the model
has such pieces. All paths meet at these cuts: a matrix is the column of what comes before the first cut times the row of
what comes after the last, and the words between are encoded once, from a bounded memory of words. Words are cut further
where no piece holds the two characters at the cut side by side (mostly letters and punctuation): all paths meet there too.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import lean, materialize

SPACE = "▁"
NEG = float("-inf")
#: Characters in a chunk, chunks whose matrices one task multiplies, words remembered per process, the longest that is.
CHUNK, FAN_IN, WORDS, LONGEST = 32_768, 256, 500_000, 48
State = tuple[int, int, int]

_open: dict[str, PieceModel] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a serialized protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            at += n
            yield key >> 3, raw[at - n : at]
        else:
            n = 8 if key & 7 == 1 else 4
            at += n
            yield key >> 3, raw[at - n : at]


def model_type(raw: bytes) -> str:
    """'unigram' or 'bpe', from the trainer specification in a model file."""
    spec = dict(_fields(dict(_fields(raw)).get(2, b"")))
    kind = {1: "unigram", 2: "bpe"}.get(int(spec.get(3, 1)))
    if kind is None:
        raise ValueError("only unigram and BPE models are supported")
    return kind


class PieceModel:
    """A SentencePiece model: the library reads the file and normalises texts; segmentation is done here."""

    def __init__(self, raw: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=raw)
        sp = self.library
        self.bpe = model_type(raw) == "bpe"
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.bytes = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.fallback = len(self.bytes) == 256
        self.unknown = sp.unk_id()
        self.unknown_score = min((self.score[i] for i in normal), default=0.0) - 10.0
        #: Each piece's id, and -1 for what only begins a piece.
        self.trie: dict[str, int] = {}
        for i in normal:
            p = self.piece[i]
            for k in range(1, len(p)):
                self.trie.setdefault(p[:k], -1)
            self.trie[p] = i
        self.longest = max((len(self.piece[i]) for i in normal), default=1)
        over = [i for i in normal if SPACE in self.piece[i].lstrip(SPACE)]
        #: Words, or parts of words: no piece goes over the places between them.
        self.word = self._parts(normal) if not over else None
        self.split: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.missed = 0
        if self.bpe:
            self._merges(normal)
        self.text = [b""] * n
        for i in range(n):
            p = self.piece[i]
            if sp.is_byte(i):
                self.text[i] = bytes([int(p[3:5], 16)])
            elif sp.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.text[i] = p.replace(SPACE, " ").encode()

    def _parts(self, normal: list[int]) -> re.Pattern:
        """Parts of words, with the meta spaces before them, made of characters that pieces connect with each other, or of others.

        Characters side by side in a piece are connected; the largest set of connected ones (letters, as a rule) is one kind.
        """
        up: dict[str, str] = {}

        def root(c: str) -> str:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for i in normal:
            p = self.piece[i].lstrip(SPACE)
            for a, b in zip(p, p[1:]):
                up[root(a)] = root(b)
        sets: dict[str, list[str]] = {}
        for c in up:
            sets.setdefault(root(c), []).append(c)
        kind = "".join(map(re.escape, max(sets.values(), key=len, default=[])))
        return re.compile(f"{SPACE}*[{kind}]+|{SPACE}*[^{kind}{SPACE}]+|{SPACE}+" if kind else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    # -- BPE: which neighbours merging leaves alone

    def _merges(self, normal: list[int]) -> None:
        """The last merge that makes each piece; pieces that merging never makes are taken out."""
        for i in normal:
            p = self.piece[i]
            if len(p) == 1:
                continue
            parts: list[str] = list(p)
            while len(parts) > 1:
                best = None
                for k in range(len(parts) - 1):
                    j = self.trie.get(parts[k] + parts[k + 1], -1)
                    if j >= 0 and (best is None or self.score[j] > self.score[best[1]]):
                        best = (k, j)
                if best is None:
                    break
                k = best[0]
                if len(parts) == 2:
                    self.split[i] = (self._id(parts[0]), self._id(parts[1]))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) > 1:
                self.trie[p] = -1

    def _id(self, text: str) -> int:
        """Of a piece, or of a character that is none: -1 - its code."""
        i = self.trie.get(text, -1)
        return i if i >= 0 else -1 - ord(text)

    def _string(self, i: int) -> str:
        return self.piece[i] if i >= 0 else chr(-1 - i)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a, b as they are, side by side.

        The last merges of both are undone in turn, latest first, and at each point the pair in the middle is
        tried: if it would have merged before one of the pieces was made, they are not compatible.
        """
        key = (a << 22) ^ b
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            got = self.known[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        score = self.score
        limit, left_bound = NEG, True  # merges of a better score than limit come before; ties: the left one is first
        while True:
            joined = self.trie.get(self._string(a) + self._string(b), -1)
            if joined >= 0 and (score[joined] > limit or (score[joined] == limit and not left_bound)):
                return False
            at, bt = self.split.get(a), self.split.get(b)
            if at is None and bt is None:
                return True
            if bt is None or (at is not None and score[a] < score[b]):
                limit, left_bound, a = score[a], True, at[1]
            else:
                limit, left_bound, b = score[b], False, bt[0]

    # -- paths

    def step(self, before: int | None, piece: int) -> float:
        if not self.bpe:
            return self.score[piece] if piece >= 0 else self.unknown_score
        return 0.0 if before is None or self.compatible(before, piece) else NEG

    def forward(self, text: str, begin: int, stop: int, state: int | None) -> tuple[list[float], list[tuple[int, int] | None]]:
        """Best scores of paths from `begin`, after piece `state`, to each place up to stop and over it, with the last step.

        A step begins before stop. Places count from begin.
        """
        size = min(len(text), stop + self.longest) - begin + 1
        best, back = [NEG] * size, [None] * size
        best[0] = 0.0
        last: list[int | None] = [None] * size
        last[0] = state
        trie = self.trie
        for i in range(stop - begin):
            if best[i] == NEG:
                continue
            before, j, single = last[i], begin + i, False
            for k in range(1, size - i):
                piece = trie.get(text[j : j + k])
                if piece is None:
                    break
                if piece < 0:
                    continue
                single |= k == 1
                step = self.step(before, piece)
                if step != NEG and best[i] + step > best[i + k]:
                    best[i + k], back[i + k], last[i + k] = best[i] + step, (k, piece), piece
            if not single and size > i + 1:  # a character that is no piece
                piece = -1 - ord(text[j])
                step = self.step(before, piece)
                if step != NEG and best[i] + step > best[i + 1]:
                    best[i + 1], back[i + 1], last[i + 1] = best[i] + step, (1, piece), piece
        return best, back

    def _merge_path(self, word: str) -> list[int]:
        """The compatible path through a word from no state: forward() and trace() for BPE, where at most one path
        reaches a place, so a place that has been reached needs no further test."""
        n, trie, known = len(word), self.trie, self.known
        last: list[int | None] = [None] * (n + 1)
        came = [0] * (n + 1)
        for i in range(n):
            before = last[i]
            if before is None and i:
                continue
            single = False
            for k in range(i + 1, n + 1):
                piece = trie.get(word[i:k])
                if piece is None:
                    break
                if piece >= 0:
                    single |= k == i + 1
                    if last[k] is None:
                        ok = True if before is None else known.get((before << 22) ^ piece)
                        if ok or (ok is None and self.compatible(before, piece)):
                            last[k], came[k] = piece, i
            if not single and last[i + 1] is None:
                piece = -1 - ord(word[i])
                if before is None or self.compatible(before, piece):
                    last[i + 1], came[i + 1] = piece, i
        out, at = [], n
        while at:
            out.append(last[at])
            at = came[at]
        return out[::-1]

    @staticmethod
    def trace(back: list[tuple[int, int] | None], at: int) -> list[int]:
        out = []
        while at:
            k, piece = back[at]
            out.append(piece)
            at -= k
        return out[::-1]

    def ids_of(self, path: list[int]) -> bytes:
        out: list[int] = []
        for piece in path:
            if piece >= 0:
                out.append(piece)
            elif self.fallback:
                out.extend(self.bytes[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
        return array("I", out).tobytes()

    def encode_word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            path = self._merge_path(word) if self.bpe else self.trace(self.forward(word, 0, len(word), None)[1], len(word))
            got = self.ids_of(path) if path and min(path) < 0 else array("I", path).tobytes()
            self.missed += 1
            if len(self.words) < WORDS and len(word) <= LONGEST:
                self.words[word] = got
            elif self.missed > 16 * WORDS:  # the corpus has moved on
                self.words.clear()
                self.missed = 0
        return got

    def normal(self, text: str) -> str:
        """Normalised, spaces as meta spaces, the dummy one in front: what the library segments."""
        return self.library.normalize(text) if text else ""

    def encode(self, text: str) -> bytes:
        """Ids of a text of one chunk as little-endian unsigned 32-bit integers."""
        text = self.normal(text)
        if self.word is None or not self.fallback:
            return self.ids_of(self.trace(self.forward(text, 0, len(text), None)[1], len(text))) if text else b""
        return self.encode_words(text)

    def encode_words(self, text: str) -> bytes:
        """Ids of a normalised text that is words."""
        words = self.word.findall(text)
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            return b"".join(map(self.encode_word, words))

    def decode(self, ids: bytes) -> str:
        """The text of ids: meta spaces become spaces, the dummy one in front goes, bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.text.__getitem__, array("I", ids)))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # -- chunks

    def states(self, text: str, edge: int) -> list[State]:
        """Pieces that could lie over the character before the edge."""
        out = []
        for left in range(1, min(self.longest, edge) + 1):
            for right in range(0, min(self.longest - left, len(text) - edge) + 1):
                piece = self.trie.get(text[edge - left : edge + right], -1)
                if piece >= 0:
                    out.append((left, piece, right))
        if self.trie.get(text[edge - 1], -1) < 0:
            out.append((1, -1 - ord(text[edge - 1]), 0))
        return out

    def cuts(self, text: str, begin: int, stop: int) -> tuple[int, int] | None:
        """The first and the last beginning of a word in [begin, stop); paths meet there."""
        if self.word is None:
            return None
        first = text.find(SPACE, max(begin, 1), stop)
        while first > 0 and text[first - 1] == SPACE:
            first = text.find(SPACE, first + 1, stop)
        if first < 0:
            return None
        last = text.rfind(SPACE, first, stop)
        while text[last - 1] == SPACE:
            last = text.rfind(SPACE, first, last)
        return first, last

    def transfer(self, text: str, begin: int, stop: int) -> list[tuple[State | None, State | None, float]]:
        """The chunk's matrix as (left state, right state, score), without the entries of -inf.

        text holds the chunk [begin, stop) with what is around it; None is the state at the text's beginning and end.
        A path from a left state begins where its piece ends and takes the steps that begin in the chunk, up to and with
        the right state's piece.
        """
        lefts: list[State | None] = self.states(text, begin) if begin else [None]
        at_end = stop == len(text)
        rights: list[State | None] = [None] if at_end else self.states(text, stop)
        cut = self.cuts(text, begin, stop)
        out = []

        def run(start: int, piece: int | None, to: list[State | None]) -> list[tuple[State | None, float]]:
            got = []
            best, back = self.forward(text, start, stop, piece)
            for right in to:
                if right is None:
                    if best[stop - start] != NEG:
                        got.append((right, best[stop - start]))
                    continue
                left, p, over = right
                if stop - left < start:
                    continue
                k = stop + over - start
                if stop - left == start:
                    score = self.step(piece, p)
                else:
                    lead = back[stop - left - start]
                    score = best[stop - left - start] + self.step(lead[1], p) if lead else NEG
                if score != NEG and k < len(best):
                    got.append((right, score))
            return got

        tail = run(cut[1], None, rights) if cut else []
        middle = 0.0
        if cut and not self.bpe:
            middle = self.forward(text[cut[0] : cut[1]], 0, cut[1] - cut[0], None)[0][cut[1] - cut[0]]
        for left in lefts:
            start, piece = (begin + left[2], left[1]) if left else (begin, None)
            if cut:
                if start > cut[0]:
                    continue
                head = self.forward(text[: cut[0]], start, cut[0], piece)[0][cut[0] - start]
                if head != NEG:
                    out.extend((left, right, head + middle + score) for right, score in tail)
            elif start > stop or (start == stop and left):
                # the left state's piece goes over the whole chunk
                for right in rights:
                    if right is None:
                        if start == stop:
                            out.append((left, None, 0.0))
                    elif left and right[1] == left[1] and right[0] == left[0] + stop - begin and right[2] == start - stop:
                        out.append((left, right, 0.0))
            else:
                out.extend((left, right, score) for right, score in run(start, piece, rights))
        return out

    def trace_chunk(self, text: str, begin: int, stop: int, left: State | None, right: State | None) -> bytes:
        """Ids of the pieces that begin in the chunk, its edges' states being known."""
        start, piece = (begin + left[2], left[1]) if left else (begin, None)
        if start >= stop:
            return b""
        goal = stop - right[0] if right else stop
        if right and goal < start:
            return b""
        cut = self.cuts(text, begin, stop)
        end = self.ids_of([right[1]]) if right else b""
        if not cut or start > cut[0] or goal < cut[1]:
            _, back = self.forward(text, start, max(goal, start), piece)
            return self.ids_of(self.trace(back, goal - start)) + end
        head = self.trace(self.forward(text[: cut[0]], start, cut[0], piece)[1], cut[0] - start)
        words = self.encode_words(text[cut[0] : cut[1]])
        tail = self.trace(self.forward(text, cut[1], max(goal, cut[1]), None)[1], goal - cut[1])
        return self.ids_of(head) + words + self.ids_of(tail) + end


def combine(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The max-plus product of two matrices."""
    rows: dict[object, list] = {}
    for left, right, score in b:
        rows.setdefault(left, []).append((right, score))
    best: dict[tuple, float] = {}
    for left, mid, score in a:
        for right, more in rows.get(mid, ()):
            if score + more > best.get((left, right), NEG):
                best[left, right] = score + more
    return [(left, right, score) for (left, right), score in best.items()]


def best_states(matrices: list[list[tuple]], first: object, last: object) -> list[tuple[object, object]]:
    """Each matrix's left and right state on the best path from state first to state last."""
    forward = [{first: 0.0}]
    back: list[dict] = []
    for m in matrices:
        best: dict = {}
        via: dict = {}
        for left, right, score in m:
            if left in forward[-1] and forward[-1][left] + score > best.get(right, NEG):
                best[right], via[right] = forward[-1][left] + score, left
        forward.append(best)
        back.append(via)
    out, state = [], last
    for via in reversed(back):
        out.append((via[state], state))
        state = via[state]
    return out[::-1]


def model(path: str) -> PieceModel:
    """The process's model of that file."""
    if path not in _open:
        with open(path, "rb") as f:
            _open[path] = PieceModel(f.read())
    return _open[path]


# -- Spark

_STATE = "struct<l:int,p:int,r:int>"
_MATRIX = f"array<struct<a:{_STATE},b:{_STATE},s:double>>"
_STATE_PA = pa.struct([("l", pa.int32()), ("p", pa.int32()), ("r", pa.int32())])
_MATRIX_PA = pa.list_(pa.struct([("a", _STATE_PA), ("b", _STATE_PA), ("s", pa.float64())]))


def _pack(state: State | None) -> dict | None:
    return None if state is None else dict(zip("lpr", state))


def _unpack(state: dict | None) -> State | None:
    return None if state is None else (state["l"], state["p"], state["r"])


def _rows(matrix: list[dict]) -> list[tuple]:
    return [(_unpack(x["a"]), _unpack(x["b"]), x["s"]) for x in matrix]


def _stored(matrix: list[tuple]) -> list[dict]:
    return [{"a": _pack(a), "b": _pack(b), "s": s} for a, b, s in matrix]


def encode_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """key, no, ids of each chunk of chunks(key, no, n, before, body, after), whose texts are normalised.

    Matrices are multiplied in two levels, FAN_IN chunks to a product: a column of Spark holds 2 GB at most, so a
    text has FAN_IN x FAN_IN chunks at most, and no task gets more than FAN_IN matrices of one text.
    """

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = batch.to_pylist()
            got = [_stored(m.transfer(x["before"] + x["body"] + x["after"], len(x["before"]), len(x["before"]) + len(x["body"]))) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, _MATRIX_PA)], names=["key", "no", "matrix"]
            )

    def product(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["no"])
        total = [_rows(x["matrix"]) for x in rows]
        while len(total) > 1:
            total = [combine(*total[k : k + 2]) if k + 1 < len(total) else total[k] for k in range(0, len(total), 2)]
        return pa.table(
            {"key": pa.array([rows[0]["key"]], pa.int64()), "block": pa.array([rows[0]["block"]], pa.int32()), "matrix": pa.array([_stored(total[0])], _MATRIX_PA)}
        )

    def edges_of_blocks(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["block"])
        states = best_states([_rows(x["matrix"]) for x in rows], None, None)
        return pa.table(
            {
                "key": pa.array([x["key"] for x in rows], pa.int64()),
                "block": pa.array([x["block"] for x in rows], pa.int32()),
                "first": pa.array([_pack(a) for a, _ in states], _STATE_PA),
                "last": pa.array([_pack(b) for _, b in states], _STATE_PA),
            }
        )

    def edges_of_chunks(table: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["no"])
        ends = blocks.to_pylist()[0]
        states = best_states([_rows(x["matrix"]) for x in rows], _unpack(ends["first"]), _unpack(ends["last"]))
        return pa.table(
            {
                "key": pa.array([x["key"] for x in rows], pa.int64()),
                "no": pa.array([x["no"] for x in rows], pa.int32()),
                "first": pa.array([_pack(a) for a, _ in states], _STATE_PA),
                "last": pa.array([_pack(b) for _, b in states], _STATE_PA),
            }
        )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            got = []
            for x in batch.to_pylist():
                text, begin = x["before"] + x["body"] + x["after"], len(x["before"])
                got.append(m.trace_chunk(text, begin, begin + len(x["body"]), _unpack(x["first"]), _unpack(x["last"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["key", "no", "ids"])

    chunks = materialize(chunks, "piece-chunks")
    found = materialize(chunks.mapInArrow(lean(matrices), f"key long, no int, matrix {_MATRIX}"), "piece-matrices")
    found = found.withColumn("block", F.floor(F.col("no") / FAN_IN).cast("int"))
    blocks = found.groupBy("key", "block").applyInArrow(product, f"key long, block int, matrix {_MATRIX}")
    ends = blocks.groupBy("key").applyInArrow(edges_of_blocks, f"key long, block int, first {_STATE}, last {_STATE}")
    edges = (
        found.groupBy("key", "block")
        .cogroup(ends.groupBy("key", "block"))
        .applyInArrow(edges_of_chunks, f"key long, no int, first {_STATE}, last {_STATE}")
    )
    return chunks.join(edges, ["key", "no"]).mapInArrow(lean(traced), "key long, no int, ids binary")


def _ids_array(parts: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


_REPORT = "n_chars long, n_chunks int, n_tokens long, ids array<int>, round_trip boolean"


def _reported(m: PieceModel, ids: pa.Array, texts: list[str | None], chunks: list[int], parts: list[bytes]) -> pa.RecordBatch:
    whole = [x or "" for x in texts]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(x) for x in whole], pa.int64()),
            pa.array(chunks, pa.int32()),
            pa.array([len(x) // 4 for x in parts], pa.int64()),
            _ids_array(parts),
            pa.array([m.decode(p) == x for p, x in zip(parts, whole)], pa.bool_()),
        ],
        names=["doc_id", "n_chars", "n_chunks", "n_tokens", "ids", "round_trip"],
    )


def encode_documents(
    docs: DataFrame, path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_chars, n_chunks, n_tokens, ids and round_trip (the ids decode to the text) of every row.

    Texts of at most `chunk` characters are one chunk; longer ones are dealt out by chunks. A null text is empty and has no
    ids. A text with meta spaces of its own does not round-trip, they become spaces. Repeated rows give repeated rows, an
    empty table none; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    giant = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [m.encode(x) if x else b"" for x in texts]
            yield _reported(m, batch.column(0), texts, [1] * len(texts), parts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        reach = m.longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = m.normal(text)
                for no, at in enumerate(range(0, len(text), chunk)):
                    stop = min(at + chunk, len(text))
                    part = [text[max(0, at - reach) : at], text[at:stop], text[stop : stop + 2 * reach]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.int64()), pa.array([no], pa.int32()), *(pa.array([x], pa.string()) for x in part)],
                        names=["key", "no", "before", "body", "after"],
                    )

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        m = model(path)
        parts = [x for _, x in sorted(zip(right.column("no").to_pylist(), right.column("ids").to_pylist()))]
        row = left.to_pylist()[0]
        got = _reported(m, pa.array([row["doc_id"]], pa.int64()), [row["text"]], [len(parts)], [b"".join(parts)])
        return pa.Table.from_batches([got])

    few = rows.filter(~giant).mapInArrow(lean(short), f"doc_id long, {_REPORT}")
    giants = materialize(rows.filter(giant).withColumn("key", F.monotonically_increasing_id()), "piece-giants")
    chunks = giants.select("key", "text").mapInArrow(split, "key long, no int, before string, body string, after string")
    # Chunks of a text go to different tasks.
    encoded = encode_chunks(chunks.repartition("key", "no"), path)
    many = giants.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(joined, f"doc_id long, {_REPORT}")
    return few.unionByName(many)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row; null ids give an empty text."""
    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(array("I", x or []).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(decode, f"doc_id {kind}, text string")
