"""Token operators against the libraries and against plain loops."""

import random
import zlib

import numpy as np
import pytest
from helpers import BYTES, PIECES, TEXTS, docs
from sentencepiece import SentencePieceProcessor

from strataflow.llm import pieces
from strataflow.llm.attribution import RULES, allocate, attribute_tokens, token_spans
from strataflow.llm.pieces import PieceModel, best_states, combine, decode_documents, encode_documents, model
from strataflow.llm.pretokens import encoder
from strataflow.llm.repair import Block, compress
from strataflow.llm.token_files import token_file_report

ALPHABET = "ab th eion en  AÉéß \t\n\r  ’st0²½.,!%$ é中🎉'll've▁ー分"


def texts(n, most=60, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pieces_equal_the_library():
    m = model(PIECES)
    for t in texts(800):
        assert ids(m.encode(t)) == m.library.encode(t), t
        assert m.decode(m.encode(t)) == m.library.decode(m.library.encode(t)), t


def chunked(m, text, size):
    text, reach = m.normal(text), m.longest
    parts, matrices = [], []
    for at in range(0, len(text), size):
        stop = min(at + size, len(text))
        lo = max(0, at - reach)
        parts.append((text[lo : stop + 2 * reach], at - lo, stop - lo))
        matrices.append(m.transfer(*parts[-1]))
    if not parts:
        return b""
    # associativity: a tree of products has the same entry as the chain
    total = matrices[0]
    for x in matrices[1:]:
        total = combine(total, x)
    assert any(a is None and b is None for a, b, _ in total)
    states = best_states(matrices, None, None)
    return b"".join(m.trace_chunk(*p, a, b) for p, (a, b) in zip(parts, states))


def test_chunks_equal_the_whole():
    m = model(PIECES)
    for k, t in enumerate(texts(300, 120)):
        for size in (1, 3, 8, 25):
            assert chunked(m, t, size) == m.encode(t), (k, size, t)


def test_unigram_scores_equal_the_library():
    raw = bytearray(open(PIECES, "rb").read())
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # the trainer specification's model type: bpe
    raw[at + 1] = 1
    m, lib = PieceModel(bytes(raw)), SentencePieceProcessor(model_proto=bytes(raw))

    def score(found):
        return sum(lib.get_score(i) for i in found if not lib.is_byte(i))

    assert not m.bpe
    for t in ["the cat sat on the mat", "reading and writing things", "internationalisation"]:
        own = ids(m.encode(t))
        assert m.decode(m.encode(t)) == t
        assert score(own) >= score(lib.encode(t)) - 1e-6
        for size in (2, 5):
            assert score(ids(chunked(m, t, size))) == pytest.approx(score(own))


def test_encode_documents(spark):
    rows = encode_documents(docs(spark), PIECES, chunk=1000).collect()
    want = sorted((str(i), model(PIECES).library.encode(t or "")) for i, t, *_ in TEXTS)
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert max(r.n_chunks for r in rows) == 41
    back = decode_documents(encode_documents(docs(spark), PIECES), PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, *_ in TEXTS)
    assert encode_documents(docs(spark, []), PIECES).count() == 0


def test_pretokens_equal_the_library():
    e = encoder(BYTES)
    for t in texts(800):
        assert ids(e.ids(t)) == e.tokenizer.encode(t, add_special_tokens=False).ids, t
        starts, stops = token_spans(e, t)
        assert list(zip(starts.tolist(), stops.tolist())) == e.tokenizer.encode(t, add_special_tokens=False).offsets, t


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (50, 2), (5000, 8), (20000, 300)):
        seq = rng.integers(0, top, n).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n + 1, 7))
        lengths = np.diff(np.r_[0, cuts, n])
        block = Block(compress(seq, lengths, 1000, least=2))
        assert (block.all_ids() == seq).all()
        ends = np.cumsum(lengths)
        assert all((block.ids(k) == seq[ends[k] - lengths[k] : ends[k]]).all() for k in range(len(lengths)))
        assert all(block.id_at(i) == seq[i] for i in range(0, n, max(1, n // 20)))


def test_token_files(spark):
    rows = token_file_report(docs(spark), BYTES).collect()
    e, start, want = encoder(BYTES), 0, []
    for i, t in sorted(((i, t or "") for i, t, *_ in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        raw = e.ids(t) + b"\0\0\0\0"
        want.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.start)] == want
    assert token_file_report(docs(spark, []), BYTES).count() == 0


def test_attribution_rules_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(0, 12)
        edges = sorted(rng.sample(range(30), 2 * (n // 2)))
        lo, hi = np.array(edges[::2], int), np.array(edges[1::2], int)
        cuts = sorted(rng.sample(range(1, 30), rng.randint(0, 10)))
        starts, stops = np.array([0, *cuts], int), np.array([*cuts, 30], int)
        for rule in RULES:
            want = np.zeros(len(lo))
            for a, b in zip(starts, stops):
                shared = [max(0, min(b, y) - max(a, x)) for x, y in zip(lo, hi)]
                if rule in ("start", "end"):
                    at = a if rule == "start" else b - 1
                    for k, (x, y) in enumerate(zip(lo, hi)):
                        want[k] += x <= at < y
                elif rule == "split":
                    want += np.array(shared) / (b - a) if len(lo) else 0
                elif shared and max(shared) > 0:
                    want[int(np.argmax(shared))] += 1
            assert np.allclose(allocate(starts, stops, lo, hi, rule), want), rule


def test_attribute_tokens(spark):
    rows = attribute_tokens(docs(spark), BYTES).collect()
    e = encoder(BYTES)
    for i, t, *_ in TEXTS[:8]:
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.tokens for r in own) == len(e.ids(t or "")) // 4
        assert "".join((t or "")[r.start : r.stop] for r in sorted(own, key=lambda r: r.section)) == (t or "")
    assert attribute_tokens(docs(spark, []), BYTES).count() == 0
    with pytest.raises(ValueError):
        attribute_tokens(docs(spark), BYTES, rule="other")
    assert pieces.CHUNK > 0
