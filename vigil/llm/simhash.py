"""SimHash document fingerprints and their Hamming search (numbered operator 3, native).

Terms are pairs of neighbouring words, weighted by how often they occur.  Each occurrence of a term votes
on 128 bits with two 64-bit hashes; a bit is set where more than half of all votes are.  Votes are summed in
64 long columns of two 32-bit lanes each, by a hash aggregate on exploded terms, so no text is ever one
task's group.  The search deals every fingerprint to permuted block tables: with radius r and B blocks, two
fingerprints within r agree on B - r blocks at least, so a join on each choice of B - r blocks finds them all.
Beyond ``FEW`` bits these choices are too many; there r < 2 B, so one block at least differs in at most one bit: a
stored fingerprint goes to one table per block, and a query asks each with its block and all one-bit changes of it.
A pair counts in the first table where it meets.  Neither side of this join is ever broadcast.

Defined results: a NULL text is empty; a text of one word has that word as its term, one without words the
empty term; equal texts have equal fingerprints; rows with equal ids follow each other in the order of their
text; NULL ids come last in descending order; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import written
from vigil.llm.ordering import range_number

BITS, LANES = 128, 0x0000000100000001
FEW = 5  # radius up to which choices of blocks are joined


def term_hashes(text: Column) -> Column:
    """One 64-bit hash per occurrence of a term; never empty."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    # transform() over the one-element array names the words once, so they are split once.
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(F.array(F.xxhash64(F.coalesce(F.get(w, F.lit(0)), F.lit("")))))))


def _votes() -> list[Column]:
    """Sums whose two 32-bit lanes count the votes on bits i and i + 32 of either hash (columns _h, _g)."""
    return [F.sum(F.shiftright(F.col(h), i).bitwiseAND(F.lit(LANES))).alias(f"_{h}{i}") for h in ("_h", "_g") for i in range(32)]


def _signs(h: str) -> Column:
    """The 64 bits of one hash: 1 where more than half of the ``_terms`` votes are."""
    bits = [F.shiftleft((F.col(f"_{h}{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("_terms")).cast("long"), i).bitwiseOR(
        F.shiftleft((F.shiftrightunsigned(f"_{h}{i}", 32) * 2 > F.col("_terms")).cast("long"), i + 32)) for i in range(32)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, f1, f2 (the two halves of the fingerprint) of every text; ``keys`` must name a row."""
    terms = df.select(*keys, F.explode(term_hashes(F.col(text))).alias("_h")).withColumn("_g", F.xxhash64(F.lit("second"), F.col("_h")))
    votes = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_terms"), *_votes())
    return votes.select(*keys, _signs("_h").alias("f1"), _signs("_g").alias("f2"))


def hexed(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(*halves: Column) -> Column:
    return 1.0 - distance(*halves) / float(BITS)


def _tables(radius: int, blocks: int) -> Column:
    """Array of (table number, f1 and f2 with all but the table's blocks cleared)."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        low, high = (m - (1 << 64) if m >> 63 else m for m in (mask & (1 << 64) - 1, mask >> 64))
        out.append(F.struct(F.lit(number).alias("t"), F.col("f1").bitwiseAND(F.lit(low)).alias("k1"), F.col("f2").bitwiseAND(F.lit(high)).alias("k2")))
    return F.array(*out)


def _signed(mask: int) -> tuple[int, int]:
    """The two halves of 128 bits, as f1 and f2 hold them."""
    return tuple(m - (1 << 64) if m >> 63 else m for m in (mask & (1 << 64) - 1, mask >> 64))


def _blocks(blocks: int, changed: bool) -> Column:
    """Array of (block number, f1 and f2 with all but the block cleared); ``changed``: also with each bit of it inverted."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = []
    for t, (a, b) in enumerate(zip(edges, edges[1:])):
        for bit in [0, *[1 << i for i in range(a, b) if changed]]:
            masks.append(F.struct(F.lit(t).alias("t"), *[F.lit(v).cast("long").alias(n) for n, v in zip(("m1", "m2", "x1", "x2"), (*_signed(((1 << b - a) - 1) << a), *_signed(bit)))]))
    return F.transform(F.array(*masks), lambda m: F.struct(
        m["t"].alias("t"), F.col("f1").bitwiseAND(m["m1"]).bitwiseXOR(m["x1"]).alias("k1"), F.col("f2").bitwiseAND(m["m2"]).bitwiseXOR(m["x2"]).alias("k2")))


def _first_met(blocks: int, chosen: int, bits: int) -> Column:
    """Whether table ``t`` is the first in which a pair meets: its ``chosen`` blocks are the first that differ in at most ``bits`` bits."""
    last = F.get(F.lit([c[-1] for c in combinations(range(blocks), chosen)]), F.col("t"))
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    alike = F.lit(0)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        off = sum((F.bit_count(F.col(q).bitwiseXOR(F.col(f)).bitwiseAND(F.lit(m).cast("long"))) for q, f, m in zip(("q1", "q2"), ("f1", "f2"), _signed(((1 << b - a) - 1) << a)) if m), F.lit(0))
        alike = alike + ((last >= k) & (off <= bits)).cast("int")
    return alike == chosen


def near(queries: DataFrame, stored: DataFrame, *, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """q1, q2, f1, f2, distance for every distinct query and stored fingerprint (columns f1, f2) within ``radius`` bits."""
    if blocks is None and radius > FEW:
        blocks = radius // 2 + 1
        probes, tables = (F.inline(_blocks(blocks, changed)) for changed in (True, False))
        first = blocks, 1, 1
    else:
        blocks = blocks or radius + 2
        probes = tables = F.inline(_tables(radius, blocks))
        first = blocks, blocks - radius, 0
    asked = queries.select("f1", "f2").distinct().select(F.col("f1").alias("q1"), F.col("f2").alias("q2"), probes)
    there = stored.select("f1", "f2").distinct().select("f1", "f2", tables)
    far = distance(*(F.col(c) for c in ("q1", "q2", "f1", "f2")))
    # Spark takes probes and tables to be as small as the fingerprints they are made of; broadcast, they would fill the driver.
    met = asked.hint("merge").join(there, ["t", "k1", "k2"])
    return met.filter((far <= radius) & _first_met(*first)).select("q1", "q2", "f1", "f2", far.alias("distance"))


def compare(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4096) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and how like they and the next document's are.

    Edited: the last floor(n/2) code points are replaced by the first as many of the next document in
    descending id order (after the last: the first).  Texts move once, dealt by id ranges; the first document of
    each range is carried to the range above by a join on the range number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("part", range_number(rows.select("id"), "id", rows_per_range).cast("int"))
    down = [F.col("id").desc_nulls_last(), F.col("text")]
    in_part = Window.partitionBy("part").orderBy(*down)
    heads = rows.groupBy("part").agg(F.max("id").alias("id"))
    heads = rows.join(F.broadcast(heads.toDF("part_", "id_")), (F.col("part") == F.col("part_")) & F.col("id").eqNullSafe(F.col("id_"))).groupBy("part").agg(F.min("text").alias("text"))
    heads = written(heads.withColumn("_row", F.monotonically_increasing_id()), "heads")
    heads = heads.join(fingerprints(heads, ["_row"], "text"), "_row").drop("_row")
    # One row per range: the head of the range below, or of the highest after the lowest.
    all_ = Window.orderBy(F.col("part").desc())
    below = lambda c: F.coalesce(F.lead(c).over(all_), F.first(c).over(all_)).alias(f"head_{c}")
    heads = heads.select("part", below("text"), below("f1"), below("f2"))
    rows = rows.select("part", "id", "text", F.row_number().over(in_part).alias("rn"), F.lead("text").over(in_part).alias("next"))
    rows = rows.join(heads.select("part", "head_text"), "part").withColumn("n", F.char_length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - half), F.substring(F.coalesce("next", "head_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))
    keys = ["part", "rn", "id", "n", "sha"]
    prints = fingerprints(rows.select("part", "rn", "id", "n", F.sha2("edited", 256).alias("sha"), F.inline(both)), [*keys, "which"], "body")
    own = lambda c, w: F.max(F.when(F.col("which") == w, F.col(c)))
    pairs = prints.groupBy(*keys).agg(own("f1", 0).alias("f1"), own("f2", 0).alias("f2"), own("f1", 1).alias("e1"), own("f2", 1).alias("e2"))
    by_rn = Window.partitionBy("part").orderBy("rn")
    pairs = pairs.withColumns({"x1": F.lead("f1").over(by_rn), "x2": F.lead("f2").over(by_rn)}).join(heads.select("part", "head_f1", "head_f2"), "part")
    c = F.col
    next_ = [F.coalesce("x1", "head_f1"), F.coalesce("x2", "head_f2")]
    return pairs.select(
        c("id").alias(id_col), c("n").alias("n_chars"), c("sha").alias("edited_sha256"), hexed(c("f1"), c("f2")).alias("fingerprint"),
        hexed(c("e1"), c("e2")).alias("edited_fingerprint"), likeness(c("f1"), c("f2"), c("e1"), c("e2")).alias("near_edited"),
        likeness(c("f1"), c("f2"), *next_).alias("near_next"), "f1", "f2")


def with_near(found: DataFrame, *, id_col: str = "doc_id", every: int = 20, radius: int = 3) -> DataFrame:
    """Adds ``same_id``, the least id with the row's fingerprint; and, for every row whose id is divisible by ``every``, else NULL:
    ``n_within``, how many other rows have a fingerprint within ``radius`` bits, and ``within_ids``, the ``same_id`` of each
    other such fingerprint, ascending (fingerprints of rows without id have none).
    """
    asks = F.col(id_col) % every == 0
    copies = found.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("same_id"))
    other = (F.col("f1") != F.col("q1")) | (F.col("f2") != F.col("q2"))
    hits = near(found.filter(asks), copies, radius=radius).join(copies, ["f1", "f2"]).groupBy("q1", "q2").agg(
        (F.sum("copies") - 1).alias("n"), F.array_sort(F.collect_list(F.when(other, F.col("same_id")))).alias("ids"))
    groups = copies.drop("copies").join(hits.withColumnsRenamed({"q1": "f1", "q2": "f2"}), ["f1", "f2"], "left")
    return found.join(groups, ["f1", "f2"], "left").withColumns({"n_within": F.when(asks, F.col("n")), "within_ids": F.when(asks, F.col("ids"))}).drop("n", "ids", "f1", "f2")
