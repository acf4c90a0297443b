"""Quality classifier (numbered operator 2): an interpolated modified Kneser-Ney model of byte n-grams, trained on
trusted text, gives every document a perplexity; quantiles of each language set the accepted range.

All counts are tables keyed by (language, n-gram), where an n-gram of up to five bytes is one long.  The n-grams that
occur in the documents are joined, order by order, with the sharded tables of counts and contexts, which gives the
probability of each; its logarithms come back to the documents in shards of at most ``SHARD_GRAMS`` n-grams, one
broadcast of bounded size and one pass each, and a document's sums over all shards make its perplexity.

Trusted rows are split by a hash of their id: two of three parts train the counts, the third, which the model has not
seen, sets the upper quantiles.  A document is kept where ``low <= perplexity <= high`` of its language and length class: the
``tail`` and ``1 - tail`` quantiles of the logarithm, moved outwards by ``slack`` times their distance from the median.

Defined results: a NULL language is the language ``und``; a language with few unseen trusted rows keeps its own medians,
with ranges at least as wide as those of all languages around theirs; one with fewer than ``least`` different ones cannot be
judged, and its documents are kept (low and high NULL); NULL and empty texts have perplexity NULL and are rejected; equal
rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import drop_dir, flagged, join_side, new_dir, small_batches, written
from vigil.llm.shingles import text_slices

ORDER = 5
SHARD_GRAMS = 4_000_000
#: Distinct n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 750_000
#: Discounts where the counts of counts cannot give any.
DISCOUNTS = (0.5, 1.0, 1.5)
PAD = 10  # a text begins after line feeds


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ``ORDER`` bytes, as one number, at every byte of a slice; each row begins after pad bytes."""
    rows, pad = len(offsets) - 1, ORDER - 1
    sizes = np.diff(offsets)
    wide = np.full(len(data) + pad * rows, PAD, np.uint64)
    at = np.arange(len(data)) + pad * np.repeat(np.arange(1, rows + 1), sizes)
    wide[at] = data
    code = np.zeros(len(data), np.uint64)
    for j in range(pad, -1, -1):
        code = (code << np.uint64(8)) | wide[at - j]
    return code


def _languages(column: pa.Array) -> list[str]:
    return [v if v is not None else "und" for v in column.to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n, trained): counts of a task, summed over its slices before they leave it."""
    held: dict[tuple[str, bool], list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, trained), parts in held.items():
            grams, n = _merge(parts)
            columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n if trained else np.zeros_like(n))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
        held.clear()

    def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        grams = np.concatenate([g for g, _ in parts])
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], np.concatenate([c for _, c in parts])[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        return grams[first], np.add.reduceat(n, first) if len(first) else n

    for batch in batches:
        langs, trained = _languages(batch.column("lang")), batch.column("trained").to_pylist()
        for first, data, offsets in text_slices(batch.column("text"), 1 << 20):
            codes = _codes(data, offsets)
            rows = list(zip(langs[first:first + len(offsets) - 1], trained[first:first + len(offsets) - 1]))
            for kind in set(rows):
                mine = np.repeat(np.array([r == kind for r in rows]), np.diff(offsets))
                if mine.any():
                    grams, n = np.unique(codes[mine], return_counts=True)
                    parts = held.setdefault(kind, [])
                    parts.append((grams, n.astype(np.int64)))
                    if len(parts) >= 8:
                        held[kind] = [_merge(parts)]
            if sum(len(g) for p in held.values() for g, _ in p) > HELD_GRAMS:
                yield from flush()
    yield from flush()


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): every n-gram of the rows (text, lang, trained), and how often it occurs in the trained ones."""
    parts = rows.select("lang", "text", "trained").mapInArrow(_count, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(gram: str, order: int) -> Column:
    """The last ``order`` bytes of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * order) - 1))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the counts of counts of one order."""
    ns = counts.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("long")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    good = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    out = []
    for k, fallback in enumerate(DISCOUNTS, 1):
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        out.append(F.when(good & (d > 0) & (d < k), d).otherwise(F.lit(fallback)).alias(f"d{k}"))
    return ns.select("lang", *out)


def probabilities(grams: DataFrame, path: str) -> DataFrame:
    """(lang, gram, p) for every n-gram of (lang, gram, n), by joins with the counts of all orders.

    The lower orders count in how many contexts an n-gram occurs.  Each order is written below ``path``.
    """
    counts = {ORDER: grams.filter("n > 0")}
    for order in range(ORDER - 1, 0, -1):
        lower = counts[order + 1].groupBy("lang", _tail("gram", order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        counts[order] = written(lower, "", f"{path}/counts{order}")
    asked = {ORDER: grams.select("lang", "gram")}
    for order in range(ORDER - 1, 0, -1):
        asked[order] = asked[order + 1].select("lang", _tail("gram", order).alias("gram")).distinct()
    p = None
    for order in range(1, ORDER + 1):
        # Written, as the size test and both joins would count the n-grams again.
        d = join_side(counts[order], written(_discounts(counts[order]), "", f"{path}/d{order}"), "lang", "inner")
        n = F.col("n")
        taken = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftright("gram", 8)
        contexts = d.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.sum(taken).alias("left"))
        rows = asked[order].withColumn("context", context).join(contexts, ["lang", "context"], "left")
        rows = rows.join(d.select("lang", "gram", (n - taken).alias("own")), ["lang", "gram"], "left")
        if order == 1:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            below = p.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
            rows = rows.withColumn("shorter", _tail("gram", order - 1)).join(below, ["lang", "shorter"])
        seen = (F.coalesce("own", F.lit(0.0)) + F.col("left") * F.col("below")) / F.col("total")
        p = written(rows.select("lang", "gram", F.when(F.col("total") > 0, seen).otherwise(F.col("below")).alias("p")), "", f"{path}/p{order}")
    return p


def _ascending(shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a shard in ascending order, and their logarithms."""
    gram = shard.column("gram").to_numpy().astype(np.uint64)
    order = np.argsort(gram)
    return gram[order], shard.column("log").to_numpy()[order]


def _sums(shared, langs: dict[str, int]):
    """Per row: the sum of the logarithms of the shard's n-grams and the number of bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs = shared.value
        for batch in batches:
            number = np.array([langs.get(x, len(langs)) for x in _languages(batch.column("lang"))], np.uint64)
            sums, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in text_slices(batch.column("text"), 1 << 20):
                rows = slice(first, first + len(offsets) - 1)
                size = np.diff(offsets)
                sizes[rows] = size
                if not len(data) or not len(grams):
                    continue
                codes = _codes(data, offsets) | (np.repeat(number[rows], size) << np.uint64(8 * ORDER))
                at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
                found = np.where(grams[at] == codes, logs[at], 0.0)
                edges = np.concatenate([np.zeros(1), np.cumsum(found)])
                sums[rows] = edges[offsets[1:]] - edges[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), batch.column("lang"), pa.array(sums), pa.array(sizes)], ["id", "key", "lang", "sums", "size"])
    return run


def perplexity(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``trusted`` has one column, the ids of trusted documents.

    id, key (hash of language and text), lang, n_bytes, perplexity, trusted, unseen (trusted, but not trained on); one row per distinct (id, lang, text)."""
    spark = docs.sparkSession
    path = new_dir(spark, "quality")
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    trains = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 3 != 0
    counted = flagged(rows, trusted, "id", "trusted").withColumn("trained", F.col("trusted") & trains)
    grams = written(gram_counts(counted), "", f"{path}/grams")
    rows = rows.withColumn("key", F.xxhash64("lang", "text"))
    found = probabilities(grams, path)
    langs = {r["lang"]: k for k, r in enumerate(found.select("lang").distinct().orderBy("lang").collect())}
    number = F.coalesce(*[F.when(F.col("lang") == k, F.lit(n)) for k, n in langs.items()], F.lit(0)) if langs else F.lit(0)
    shards = max(1, -(-found.count() // shard_grams))
    keyed = found.select(F.shiftleft(number.cast("long"), 8 * ORDER).bitwiseOR(F.col("gram")).alias("gram"), F.log("p").alias("log"))
    parts, broadcasts = [], []
    for k in range(shards):
        # At most about shard_grams rows of 16 bytes; the driver keeps none of them while the jobs after it run.
        shared = spark.sparkContext.broadcast(_ascending(keyed.filter(F.pmod(F.xxhash64("gram"), F.lit(shards)) == k).toArrow()))
        broadcasts.append(shared)
        parts.append(rows.select("id", "key", "lang", "text").mapInArrow(_sums(shared, langs), f"id {dict(rows.dtypes)['id']}, key long, lang string, sums double, size long"))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    # Rows that repeat an id and text add up in both sums; their quotient is the same.
    sums = sums.groupBy("id", "key").agg(F.first("lang").alias("lang"), F.sum("sums").alias("s"), (F.sum("size") / F.lit(shards)).alias("b"))
    out = flagged(sums, trusted, "id", "trusted").select(
        "id", "key", "lang", F.col("b").cast("long").alias("n_bytes"), F.when(F.col("b") > 0, F.exp(-F.col("s") / F.col("b"))).alias("perplexity"),
        "trusted", (F.col("trusted") & ~trains).alias("unseen"))
    out = written(out, "quality-scores")
    for shared in broadcasts:
        shared.destroy()
    drop_dir(spark, path)
    return out


def judge(scores: DataFrame, *, tail: float = 0.01, slack: float = 0.75, min_rows: int = 100, least: int = 10) -> DataFrame:
    """``scores`` with low, high and keep.

    The lower quantile is that of all trusted rows (the model favours those it was trained on), the upper that of the
    unseen ones; both of the language and length class (each four times as long as the one below), or of the
    language alone where the class has fewer than ``min_rows`` unseen trusted rows.  Where the language has fewer than
    ``min_rows`` different ones too, the distances from its medians are no less than those that the rows of all
    judged languages have from theirs, widened for a median of few rows; below ``least`` there is no range.
    """
    length = F.floor(F.log2(F.col("n_bytes").cast("double")) / 2).cast("int")
    scores = scores.withColumn("length", F.coalesce(length, F.lit(-1)))
    known = scores.filter("trusted AND perplexity IS NOT NULL").withColumns({"x": F.log("perplexity"), "y": F.expr("IF(unseen, ln(perplexity), NULL)")})
    quantiles = F.concat(F.percentile_approx("x", [tail, 0.5], 10_000), F.percentile_approx("y", [0.5, 1 - tail], 10_000))
    # One row per language and length class, per language, and for all.  Copies of one text count once per language.
    fine = known.groupBy("lang", "length").agg(quantiles.alias("fine"), F.count("y").alias("c")).filter(F.col("c") >= min_rows).drop("c")
    by = known.groupBy("lang").agg(quantiles.alias("coarse"), F.approx_count_distinct(F.round("y", 6), 0.01).alias("c"))
    by = written(by.filter(F.col("c") >= least), "quality-ranges")
    around = join_side(known, by, "lang", "inner").select((F.col("x") - F.col("coarse")[1]).alias("x"), (F.col("y") - F.col("coarse")[2]).alias("y"))
    spread = around.agg(F.percentile_approx("x", tail, 10_000), F.percentile_approx("y", 1 - tail, 10_000)).first()
    down, up = (F.lit(float(v or 0)) for v in spread)
    lo, seen_mid, mid, hi = (F.col("coarse")[k] for k in range(4))
    grow = F.sqrt(1 + 1 / F.col("c"))
    wide = F.array(seen_mid + grow * F.least(lo - seen_mid, down), seen_mid, mid, mid + grow * F.greatest(hi - mid, up))
    by = by.select("lang", F.when(F.col("c") >= min_rows, F.col("coarse")).otherwise(wide).alias("coarse"))
    scores = join_side(join_side(scores, fine, ["lang", "length"]), by, "lang")
    scores = scores.withColumn("q", F.coalesce("fine", "coarse"))
    lo, seen_mid, mid, hi = (F.col("q")[k] for k in range(4))
    scores = scores.withColumns({"low": F.exp(seen_mid - (1 + slack) * (seen_mid - lo)), "high": F.exp(mid + (1 + slack) * (hi - mid))}).drop("q", "fine", "coarse", "length")
    inside = F.col("perplexity").between(F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(float("inf"))))
    return scores.withColumn("keep", F.coalesce(inside, F.lit(False)))
