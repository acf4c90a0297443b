"""Personal data (numbered operator 10): fixed patterns, and a skip-chain conditional random field that adds spans.

The base spans of the patterns always stay.  The field labels tokens that hold a digit or an ``@`` with O, email, ip,
card or phone; other tokens are observed as O.  Its graph has an edge between neighbouring tokens and a skip edge
between successive occurrences of the same or a similar token (equal letters and digits, or an equal part before the
``@``), however far apart.  Loopy message passing over the whole document gives each token's marginals, so occurrences
pull each other to one label.  A token whose marginal reaches ``sure`` and that lies outside the base spans is added.

Training is piecewise, on a sample of about ``sample_rows`` documents that hold such tokens: MLlib's multinomial logistic
regression gives the node potentials (shape and neighbour features against the base labels), smoothed pair counts
those of both kinds of edge.

Defined results: a NULL text is empty; without any base span in the sample nothing is added; equal texts get equal
spans; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import small_batches, written

KINDS = ("email", "ip", "card", "phone")
SLICE_CHARS = 2 << 20
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match of the contract's pattern always begins where a run of digits does; looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_ACTIVE, _TOKEN = re.compile(r"[0-9@]"), re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: from each ``@`` back over its local part, so the work is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _ACTIVE.search(text):
        return found
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


_EDGE = ".,;:!?\"'<>[]{}|"


class Tokens:
    """The active tokens of a text: cores without outer punctuation, their place among all tokens, and their keys."""

    def __init__(self, text: str):
        self.spans, self.place, self.core = [], [], []
        if not _ACTIVE.search(text):
            return
        for k, m in enumerate(_TOKEN.finditer(text)):
            word = m[0]
            if _ACTIVE.search(word):
                core = word.strip(_EDGE)
                start = m.start() + len(word) - len(word.lstrip(_EDGE))
                self.spans.append((start, start + len(core)))
                self.place.append(k)
                self.core.append(core)

    def keys(self) -> list[str]:
        out = []
        for core in self.core:
            local = core.split("@")[0] if "@" in core else core
            out.append("".join(c for c in local.lower() if c.isalnum()) or core)
        return out

    def edges(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(neighbours, skip edges) as pairs of token numbers."""
        chain = [(k, k + 1) for k in range(len(self.place) - 1) if self.place[k + 1] == self.place[k] + 1]
        last, skip = {}, []
        for k, key in enumerate(self.keys()):
            if key in last:
                skip.append((last[key], k))
            last[key] = k
        return chain, skip

    def labels(self, spans: list[tuple[int, int, int]]) -> list[int]:
        """0 for O, else 1 + kind of the first base span that overlaps the token."""
        out, ends = [0] * len(self.spans), [e for _, e in self.spans]
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            for k in range(bisect_right(ends, a), len(self.spans)):
                x, y = self.spans[k]
                if x >= b:
                    break
                if y > a and out[k] == 0:
                    out[k] = 1 + kind
        return out


def _shape(core: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    n = max(1, len(core))
    return [digits / n, letters / n, float(digits == n), float("@" in core), float(core.count(".") == 3), float(0 < core.count(".") < 3), float("-" in core),
            float(core[:1] == "+"), float(core[:1] == "(" or core[-1:] == ")"), *[float(lo <= digits <= hi) for lo, hi in ((0, 1), (2, 3), (4, 6), (7, 8), (9, 12), (13, 19), (20, 1 << 30))],
            min(n, 40) / 40]


_BLANK = [0.0] * len(_shape("0"))


def features(tokens: Tokens) -> list[list[float]]:
    """Shape of each token, and of the neighbours that are active."""
    shapes = [_shape(c) for c in tokens.core]
    rows = []
    for k, place in enumerate(tokens.place):
        before = shapes[k - 1] if k and tokens.place[k - 1] == place - 1 else _BLANK
        after = shapes[k + 1] if k + 1 < len(shapes) and tokens.place[k + 1] == place + 1 else _BLANK
        rows.append(shapes[k] + before + after)
    return rows


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for value in batch.column("text"):
            text = value.as_py() or ""
            tokens = Tokens(text)
            labels = tokens.labels(base_spans(text))
            before, same = [-1] * len(labels), [-1] * len(labels)
            chain, skip = tokens.edges()
            for edges, out in ((chain, before), (skip, same)):
                for a, b in edges:
                    out[b] = labels[a]
            for column, more in zip(columns, (labels, before, same, features(tokens))):
                column += more
        types = [pa.int32()] * 3 + [pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["label", "before", "same", "cells"])


def _affinity(pairs: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Logarithm of how much more often two labels meet than by chance."""
    joint = (pairs + smooth) / (pairs + smooth).sum()
    return np.log(joint) - np.log(joint.sum(1, keepdims=True)) - np.log(joint.sum(0, keepdims=True))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 3000) -> dict | None:
    """Potentials of the field, or None where the sample holds no base span."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("pii"), "id"), F.lit(1_000_000)) < F.lit(1_000_000 * sample_rows / max(1, n)))
    drawn = written(drawn.mapInArrow(_training, "label int, before int, same int, cells array<double>"), "pii-sample")
    size = 1 + len(KINDS)
    tables = []
    for column in ("before", "same"):  # at most 25 rows each
        pairs = np.zeros((size, size))
        for r in drawn.filter(F.col(column) >= 0).groupBy(column, "label").count().collect():
            pairs[r[0], r[1]] = r[2]
        tables.append(_affinity(pairs))
    labels = sorted(r[0] for r in drawn.select("label").distinct().collect())
    if not any(labels):
        return None
    train = drawn.select(F.col("label").cast("double").alias("label"), array_to_vector("cells").alias("features"))
    weights, bias = np.zeros((size, 3 * len(_BLANK))), np.full(size, -20.0)
    if len(labels) == 1:
        bias[labels[0]] = 0.0
    else:
        model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-4).fit(train)
        matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        for label in labels:
            weights[label], bias[label] = matrix[label], intercepts[label]
    return {"weights": weights, "bias": bias, "chain": tables[0], "skip": tables[1]}


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def marginals(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, graph: np.ndarray | None = None, rounds: int | None = None,
              damp: float = 0.3, close: float = 1e-4) -> np.ndarray:
    """Sum-product messages on all edges at once: (log potentials per node, (a, b) pairs, log potentials per edge) -> marginals.

    ``graph`` numbers the graph of each node.  A graph is finished when none of its own messages changes any more, so
    its marginals do not depend on the others; one that swings is given up after as many rounds as evidence needs to pass
    all its nodes, and 100 more (``rounds`` sets another bound).
    """
    m = len(edges)
    if not m:
        return np.exp(_normal(unary))
    graph = np.zeros(len(unary), np.int64) if graph is None else graph
    belief = unary.copy()
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair, back = np.concatenate([tables, tables.transpose(0, 2, 1)]), np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    sent, owner = np.zeros((2 * m, unary.shape[1])), graph[source]
    most = np.bincount(graph) + 100 if rounds is None else np.full(int(graph.max()) + 1, rounds)
    done = 0
    while len(source):
        here = unary.copy()
        np.add.at(here, target, sent)
        inward = (here[source] - sent[back])[:, :, None] + pair
        top = inward.max(axis=1, keepdims=True)
        new = _normal((top + np.log(np.exp(inward - top).sum(axis=1, keepdims=True)))[:, 0])
        moved = np.zeros(len(most))
        np.maximum.at(moved, owner, np.abs(np.exp(new) - np.exp(sent)).max(axis=1))
        sent = damp * sent + (1 - damp) * new
        done += 1
        ended = ((moved < close) | (most <= done))[owner]
        if ended.any():
            np.add.at(belief, target[ended], sent[ended])
            keep = np.flatnonzero(~ended)
            place = np.zeros(len(source), np.int64)
            place[keep] = np.arange(len(keep))
            source, target, pair, sent, owner, back = source[keep], target[keep], pair[keep], sent[keep], owner[keep], place[back[keep]]
    return np.exp(_normal(belief))


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: dict, sure: float) -> list[list[tuple[int, int, int]]]:
    """The spans that the field adds to the base spans of each text; the texts' graphs are solved together."""
    every = [Tokens(t) for t in texts]
    sizes = [len(t.core) for t in every]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    if not first[-1]:
        return [[] for _ in texts]
    unary = _normal(np.array([r for t in every for r in features(t)]) @ model["weights"].T + model["bias"])
    edges, tables = [], []
    for tokens, at in zip(every, first):
        chain, skip = tokens.edges()
        edges += [(a + at, b + at) for a, b in chain + skip]
        tables += [model["chain"]] * len(chain) + [model["skip"]] * len(skip)
    found = marginals(unary, np.array(edges, int).reshape(-1, 2), np.array(tables).reshape(-1, *model["chain"].shape), np.repeat(np.arange(len(sizes)), sizes))
    label = np.where(found.max(axis=1) >= sure, found.argmax(axis=1), 0)
    out = []
    for text, tokens, base, at in zip(texts, every, bases, first):
        spans: list[list[int]] = []
        own = tokens.labels(base)
        for k, (a, b) in enumerate(tokens.spans):
            kind = int(label[at + k]) - 1
            if kind < 0 or own[k] or a == b:
                continue
            if spans and spans[-1][0] == kind and k and tokens.place[k - 1] == tokens.place[k] - 1 and spans[-1][2] == tokens.spans[k - 1][1] and kind in (2, 3):
                spans[-1][2] = b  # numbers written in groups
            else:
                spans.append([kind, a, b])
        out.append([tuple(s) for s in spans])
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _find(shared, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts, digests, joined = [[] for _ in KINDS], [], []

            def finish(texts: list[str]) -> None:
                bases = [base_spans(t) for t in texts]
                more = added_spans(texts, bases, model, sure) if model else [[] for _ in texts]
                for base, extra in zip(bases, more):
                    for k, column in enumerate(counts):
                        column.append(sum(s[0] == k for s in base))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    joined.append(_joined(base + extra))

            texts, held = [], 0
            for value in batch.column("text"):
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held > SLICE_CHARS:
                    finish(texts)
                    texts, held = [], 0
            finish(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                                             ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    return run


def find(docs: DataFrame, model: dict | None, *, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """id, number of base spans of each kind, their digest, and all spans (kind:start:end, code points) of every document."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"id {dict(rows.dtypes)['id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return rows.mapInArrow(_find(shared, sure), schema).withColumnRenamed("id", id_col)
