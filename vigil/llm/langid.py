"""Hierarchical language identification (numbered operator 1).

First the language family is predicted, then linear support vector machines, one for each pair of languages
of that family, separate its languages.  Families are told apart by such machines too.  Features are the
shares of the text's byte 1- to 3-grams (letters lower-cased in A-Z, other ASCII signs as blanks) in
``FEATURES`` hashed cells.  Each machine is fitted on a sample of about ``rows_per_language`` whole texts of
each of its languages, drawn by a hash of the id; the contests are dealt over tasks, and a task solves its machine
by dual coordinate descent.  Prediction reads every whole text.

Defined results: a NULL text or one without a letter is ``und`` with score 0, as is every text where no row
is labelled; a language that is not in ``FAMILIES`` is its own family; equal texts get equal predictions; repeated
rows count as often as they occur; where two sides win as many contests the surer wins, then the first in the
alphabet.  Other columns are not read.
"""

from __future__ import annotations


from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import small_batches, written
from vigil.llm.shingles import text_slices

FEATURES, ORDERS = 1 << 12, (1, 2, 3)
#: Family of each ISO 639-1 code, for widely written languages.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayo-polynesian": "id jv mg ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(128)]
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(id_.cast("string")) % 3 == 1


def _cells(data: np.ndarray, n: int) -> np.ndarray:
    """The hashed cell of the n-gram that begins at each byte."""
    code = np.full(max(0, len(data) - n + 1), n, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | data[j:len(data) - n + 1 + j]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in text_slices(batch.column("text")):
            data, rows = _CLASS[data], []
            for a, b in zip(offsets, offsets[1:]):
                counts = sum(np.bincount(_cells(data[a:b], n), minlength=FEATURES) for n in ORDERS)
                rows.append(counts / max(1, counts.sum()))
            labels = batch.column("lang").slice(first, len(rows))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(rows)), labels, pa.array(rows, pa.list_(pa.float32()))], ["id", "lang", "cells"])


def machine(x: np.ndarray, y: np.ndarray, epochs: int, reg: float = 0.01) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the linear support vector machine with hinge loss for labels of 1 and -1.

    Minimises the mean loss plus reg / 2 times the squared weights of features scaled to unit deviation; the intercept counts
    as one weight more.  Rows are visited in a fixed random order.
    """
    scale = x.std(axis=0)
    scale = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)
    z = np.concatenate([x * scale, np.ones((len(x), 1))], axis=1)
    size, most = (z * z).sum(axis=1), 1 / (reg * len(x))
    alpha, w, order = np.zeros(len(x)), np.zeros(z.shape[1]), np.random.default_rng(len(x))
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            step = min(max(alpha[i] - (y[i] * (w @ z[i]) - 1) / size[i], 0.0), most) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * z[i]
                moved = max(moved, abs(step))
        if moved < 1e-4 * most:
            break
    return w[:-1] * scale, float(w[-1])


def _contest(epochs: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "lang", "id"], kind="stable")
        x, y = np.stack(rows["cells"].to_numpy()).astype(np.float64), rows["side"].to_numpy().astype(np.float64)
        weights, intercept = machine(x, y, epochs) if len(set(y)) == 2 else (np.zeros(FEATURES), float(y[0]))
        return pd.DataFrame({"contest": [rows["contest"].iloc[0]], "weights": [weights], "intercept": [intercept]})
    return run


def fit(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows_per_language: int = 500, epochs: int = 30) -> dict:
    """The machines {(side, side): (weights, intercept)}, positive for the first side; sides are families or languages."""
    rows = small_batches(labelled).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return {"languages": [], "machines": {}}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(rows_per_language / n)) for k, n in sizes.items()])
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < share * 1_000_000)
    key = F.col("id").cast("string").alias("id")
    drawn = written(drawn.select(key, "text", "lang").mapInArrow(_features, "id string, lang string, cells array<float>"), "langid-sample")
    groups = defaultdict(list)
    for lang in sorted(sizes):
        groups[family(lang)].append(lang)
    contests = [("family", groups[a], groups[b], a, b) for a, b in combinations(sorted(groups), 2)]
    contests += [("language", [a], [b], a, b) for members in groups.values() for a, b in combinations(members, 2)]
    # A side too rare to be drawn never wins; where neither is drawn, the second does.
    machines = {(level, a, b): (np.zeros(FEATURES), -1.0) for level, _, _, a, b in contests}
    sides = [(lang, n, side) for n, (_, one, other, _, _) in enumerate(contests) for members, side in ((one, 1), (other, -1)) for lang in members]
    if sides:
        # One row per language and contest; the sample has a bound, so has each group.
        seats = labelled.sparkSession.createDataFrame(sides, "lang string, contest int, side int")
        fitted = drawn.join(F.broadcast(seats), "lang").groupBy("contest").applyInPandas(_contest(epochs), "contest int, weights array<double>, intercept double")
        for r in fitted.collect():  # one row per machine
            level, _, _, a, b = contests[r["contest"]]
            machines[level, a, b] = (np.array(r["weights"]), r["intercept"])
    return {"languages": sorted(sizes), "machines": machines}


class Decider:
    """Applies the machines level by level to slices of texts."""

    def __init__(self, model: dict):
        self.groups = defaultdict(list)
        for lang in model["languages"]:
            self.groups[family(lang)].append(lang)
        self.levels = {}
        for key, level, sides in [("", "family", sorted(self.groups)), *[(f, "language", m) for f, m in self.groups.items()]]:
            pairs = [(level, a, b) for a, b in combinations(sides, 2)]
            weights = np.array([model["machines"][p][0] for p in pairs], np.float32).T.reshape(FEATURES, len(pairs))
            self.levels[key] = (sides, pairs, weights, np.array([model["machines"][p][1] for p in pairs]))

    def _winners(self, key: str, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        sides, pairs, weights, intercepts = self.levels[key]
        if len(sides) == 1:
            return sides * len(rows), np.ones(len(rows))
        starts, ends = offsets[:-1][rows], offsets[1:][rows]
        total, size = np.zeros((len(rows), len(pairs))), np.zeros(len(rows))
        for n in ORDERS:
            stop = np.maximum(ends - n + 1, starts)
            values = np.concatenate([weights[_cells(data, n)], np.zeros((n, len(pairs)), np.float32)])
            sums = np.add.reduceat(values, np.stack([starts, stop], 1).ravel(), axis=0)[::2]
            total += np.where((stop > starts)[:, None], sums, 0)
            size += stop - starts
        margin = total / np.maximum(size, 1)[:, None] + intercepts
        votes, sure = np.zeros((len(rows), len(sides))), np.ones((len(rows), len(sides)))
        for k, (_, a, b) in enumerate(pairs):
            chance = 1 / (1 + np.exp(-np.clip(margin[:, k], -30, 30)))
            for side, won, p in ((a, margin[:, k] > 0, chance), (b, margin[:, k] <= 0, 1 - chance)):
                at = sides.index(side)
                votes[:, at] += won
                sure[:, at] = np.minimum(sure[:, at], p)
        best = np.argmax(votes + sure, axis=1)  # most contests won; then the surest
        return [sides[k] for k in best], sure[np.arange(len(rows)), best]

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
        data = _CLASS[data]
        every = np.arange(len(offsets) - 1)
        families, sure = self._winners("", data, offsets, every)
        langs, score = [""] * len(every), np.zeros(len(every))
        for name in set(families):
            rows = np.array([k for k, f in enumerate(families) if f == name])
            found, more = self._winners(name, data, offsets, rows)
            for k, lang in zip(rows, found):
                langs[k] = lang
            score[rows] = sure[rows] * more
        return langs, score.tolist()


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decider = Decider(shared.value)
        for batch in batches:
            langs, scores = [], []
            for _, data, offsets in text_slices(batch.column("text")):
                found = decider.decide(data, offsets)
                langs += found[0]
                scores += found[1]
            und = [t is None or not _LETTER.search(t) for t in (v.as_py() for v in batch.column("text"))]
            langs = ["und" if u else x for u, x in zip(und, langs)]
            scores = [0.0 if u else s for u, s in zip(und, scores)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not model["languages"]:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_predict(shared), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)
