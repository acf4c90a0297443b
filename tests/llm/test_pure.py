"""The numpy and Python parts against plain definitions."""
import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from vigil.llm import decontaminate, pii, quality, warc
from vigil.llm.encoder import Encoder
from vigil.llm.shingles import shingle_sets
from vigil.llm.wavelet import WaveletMatrix, build


@pytest.mark.parametrize("n,high", [(0, 1), (1, 1), (1, 60000), (700, 3), (5000, 50257), (1025, 70000)])
def test_wavelet_reads_back_access_rank_select(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n).astype(np.uint32)
    w = WaveletMatrix(n, *build(ids))
    assert (w.decode() == ids).all()
    for i in rng.integers(0, n, min(n, 40)).tolist():
        token = int(ids[i])
        assert w.access(i) == token
        assert w.rank(token, i) == int((ids[:i] == token).sum())
        assert w.select(token, w.rank(token, i)) == i
        assert w.count(token) == int((ids == token).sum())
    assert w.count(high + 5) == 0
    with pytest.raises(IndexError):
        w.access(n)
    if n == 700:
        assert w.occurrences(1) == np.flatnonzero(ids == 1).tolist()


def test_encoder_equals_the_library_on_odd_texts():
    enc, rng = Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    signs = [" ", " ", "\n", "\n", "\t", "\r", "a", "b", "Word", "'s", "'", ".", "1", "é", "Ж", "中", "\xa0", "\x1c", "\x85", "　", "!!", "<|endoftext|>", "ª", "²", "×", "🙂"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", " ", "x" * 5000, "ab " * 3000]
    for text, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_shingle_sets_equal_sets_of_words():
    rng = random.Random(2)
    words = ["a", "A", "bb", "ç", "d.", "中文", "e\xa0f"]
    texts = [None, "", "  \n"] + [rng.choice([" ", "\n\t", "\x0b\x0c\r"]).join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for k in (1, 3, 5):
        plain = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
            plain.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
        hashed = [frozenset(h.tolist()) for _, h in shingle_sets(pa.array(texts), k)]
        assert [len(x) for x in hashed] == [len(x) for x in plain]
        for (a, x), (b, y) in itertools.combinations(zip(plain, hashed), 2):
            assert len(a & b) == len(x & y)


def test_wu_manber_equals_scanning_every_window():
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "d"]
    items = [(str(k), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 5, 7])))) for k in range(12)] + [(None, "a b c d a")]
    texts = [" ".join(rng.choice(vocabulary + ["z"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "z " * 3000 + "a b c d a"]
    found = decontaminate.Patterns(items, 5).scan([t.encode() for t in texts])
    for text, (n, spans, ids) in zip(texts, found):
        w = text.split()
        hit, want = set(), set()
        for item, body in items:
            b = body.split()
            for p in {tuple(b[i:i + 5]) for i in range(max(1, len(b) - 4))} if b else ():
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i:i + len(p)]) == p:
                        hit.update(range(i, i + len(p)))
                        want.add(item)
        assert n == len(w) and {i for a, b in spans for i in range(a, b)} == hit and ids == want - {None}


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    signs = ["@", ".", "+", "-", " ", "a", "Z", "1", "12", "255", "256", "4111 1111 1111 1111", "+1 (323) 555-8465", "a.b@c.d-e.f", "1.2.3.4", "é", "\n", "(", "0000000000000"]
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            doubled = [int(c) for c in d[::-1]]
            return 13 <= len(d) <= 19 and (sum(doubled[::2]) + sum(sum(divmod(2 * c, 10)) for c in doubled[1::2])) % 10 == 0
        return kind == 0 or 9 <= len(d) <= 15

    for _ in range(6000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        want = [(k, *m.span()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if good(k, m[0])]
        assert pii.base_spans(text) == want, repr(text)


def test_messages_are_exact_on_a_tree_and_pull_repeats_together():
    rng = np.random.default_rng(1)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    tables = rng.normal(size=(3, 3, 3))
    joint = np.zeros((3,) * 4)
    for y in itertools.product(range(3), repeat=4):
        joint[y] = np.exp(sum(unary[k, v] for k, v in enumerate(y)) + sum(t[y[a], y[b]] for (a, b), t in zip(edges, tables)))
    joint /= joint.sum()
    exact = np.array([joint.sum(axis=tuple(j for j in range(4) if j != k)) for k in range(4)])
    assert np.allclose(pii.marginals(unary, edges, tables, rounds=200, close=1e-12), exact, atol=1e-6)
    unsure, certain = np.log([0.5, 0.5]), np.log([0.01, 0.99])
    same = np.array([[[2.0, -2.0], [-2.0, 2.0]]])
    assert pii.marginals(np.array([unsure, certain]), np.array([[0, 1]]), same)[0, 1] > 0.9


def test_skip_edges_join_repeated_and_similar_tokens_at_any_distance():
    tokens = pii.Tokens("call 555-8465, " + "word " * 500 + "(5558465) or jo@x.org then jo@mail.com")
    chain, skip = tokens.edges()
    assert [tokens.core[a] + " " + tokens.core[b] for a, b in skip] == ["555-8465 (5558465)", "jo@x.org jo@mail.com"] and chain == []


def test_codes_hold_the_last_five_bytes_of_each_row():
    data, offsets = np.frombuffer(b"abcdefg", np.uint8), np.array([0, 3, 3, 7])
    want = [b"\n\n\n\na", b"\n\n\nab", b"\n\nabc", b"\n\n\n\nd", b"\n\n\nde", b"\n\ndef", b"\ndefg"]
    assert [int(c).to_bytes(5, "big") for c in quality._codes(data, offsets)] == want


def test_damaged_payload_is_found():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 2\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse_records(iter([head + b"xy\r\n\r\n"])))


def test_counters():
    assert collections.Counter(pii.luhn(x) for x in ("4111111111111111", "4111111111111112")) == {True: 1, False: 1}
