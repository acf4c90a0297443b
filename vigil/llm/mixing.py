"""Mixing sources to target weights by Poisson replication (numbered operator 4, native).

Each source has a mean repetition rate = target share x target size / source size.  A document's count is
the Poisson distribution with that mean, inverted at a uniform number hashed from (seed, document key): the
smallest k whose distribution function reaches it.  The document is exploded into that many copies and all
copies are dealt over all partitions, and ordered within them, by a hash of (seed, key, copy).

Defined results: NULL sources form one source; rows with equal keys get equal counts; a NULL key is
replaced by a hash of the whole row; a weight of 0 (or a missing one, where ``default_weight`` is 0) drops
the source; an empty table gives no rows.  All input columns are kept; one named like an output column
(``copy``, ``mix_rate``, ``mix_key``) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import column, join_side

NONE = "\x00none"


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of ``seed:key``."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def rates(sizes: DataFrame, *, weights: dict[str, float] | None = None, default_weight: float = 0.0, alpha: float = 0.5,
          total: float | None = None) -> DataFrame:
    """(_source, mix_rate) from (_source, n): the target weight is ``weights[source]``, or n to the power ``alpha``.

    ``total`` is the wanted number of copies (default: as many as there are documents).  Rates are kept to six decimals, those
    below one to six digits behind the zeros, so that they do not depend on the order of summation and none vanishes.
    """
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("_source")) if pairs else F.lit(None), F.lit(float(default_weight)))
    sizes = sizes.withColumn("_w", weight)
    sums = sizes.agg(F.sum("_w").alias("w"), F.sum("n").alias("n")).first()
    if not sums["w"]:
        return sizes.select("_source", F.lit(0.0).alias("mix_rate"))
    want = float(sums["n"] if total is None else total)
    rate = F.col("_w") / F.lit(sums["w"]) * F.lit(want) / F.col("n")
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(6.0), 6.0 - F.floor(F.log10(rate)).cast("double")))
    return sizes.select("_source", F.when(rate > 0, F.round(rate * scale) / scale).otherwise(F.lit(0.0)).alias("mix_rate"))


def distribution(rate: DataFrame) -> DataFrame:
    """(_source, mix_rate, _cdf): the Poisson distribution function of each source at 0, 1, 2, ... until nothing is left.

    Terms are summed as logarithms, so large means do not underflow.
    """
    last = F.ceil(F.col("mix_rate") + 12 * F.sqrt("mix_rate") + 30).cast("int")
    by_k = Window.partitionBy("_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = rate.filter("mix_rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    steps = steps.withColumn("_lf", F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(by_k))
    steps = steps.withColumn("_p", F.exp(-F.col("mix_rate") + F.col("k") * F.log("mix_rate") - F.col("_lf")))
    steps = steps.withColumn("_c", F.sum("_p").over(by_k))
    lists = steps.groupBy("_source", "mix_rate").agg(F.sort_array(F.collect_list(F.struct("k", "_c"))).alias("_s"))
    return lists.select("_source", "mix_rate", F.col("_s._c").alias("_cdf"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, weights: dict[str, float] | None = None,
        default_weight: float = 0.0, alpha: float = 0.5, total: float | None = None) -> DataFrame:
    """Every input column, and ``copy`` (1..count), ``mix_rate``, ``mix_key``: one row per copy, globally shuffled."""
    keep = [c for c in docs.columns if c not in ("copy", "mix_rate", "mix_key")]
    carried = [f"c{k}" for k in range(len(keep))]  # input columns go under names that clash with nothing
    source = F.coalesce(column(source_col).cast("string"), F.lit(NONE))
    sizes = docs.select(source.alias("_source")).groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
    table = distribution(rates(sizes, weights=weights, default_weight=default_weight, alpha=alpha, total=total))
    key = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("row:"), F.xxhash64(*map(column, keep)).cast("string")))
    rows = docs.select(*[column(c).alias(a) for c, a in zip(keep, carried)], source.alias("_source"), key.alias("_key"))
    rows = join_side(rows, table, "_source", "inner")
    u = uniform(F.col("_key"), seed)
    count = F.size(F.filter("_cdf", lambda c: c < F.col("_u")))
    rows = rows.withColumn("_u", u).withColumn("_n", count).filter("_n > 0")
    rows = rows.select(*carried, "mix_rate", "_key", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    rows = rows.withColumn("mix_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key"), F.lit(":"), F.col("copy").cast("string"))))
    return rows.repartition("mix_key").sortWithinPartitions("mix_key").select(
        *[F.col(a).alias(c) for c, a in zip(keep, carried)], "copy", "mix_rate", "mix_key")
