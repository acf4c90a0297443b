"""Phrase collocations (numbered operator 11) by multikey quicksort of suffixes, cut at the greatest phrase length.

Texts are split into pieces and words.  Every word of a piece begins a suffix of up to ``longest`` words; the phrases
are the beginnings of suffixes, so the size of a partition of equal leading words is a phrase's count.

1. Words are counted by group (here a language), and prefixes that begin more than 1/(2 ``HOT``) of the suffixes of
   a slice are summed; those whose sum is as great a share of all are hot: at most 2 ``HOT`` of each length whatever the
   input, and among them every prefix of 1/``HOT`` of all suffixes.
2. Words rarer than ``least`` are in no frequent phrase and end the suffixes before them; a bitmap of ``FILTER_BITS`` hashed
   frequent words, whatever their number, tells most of them (one that it lets pass is abandoned below).  Slices sort their
   suffixes and send every distinct one once, with its count, to the partition that owns
   its leading words: one word, or as many as make a prefix that is not hot.  A slice sends a hot prefix itself
   once, so that its count is known too.
3. A partition is sorted and read in stretches of ``SORT_ROWS`` suffixes or of one owner.  Multikey three-way quicksort
   parts a stretch by a pivot word; a part lighter than ``least`` is abandoned, and the equal part goes one word
   deeper, its weight being the count of the phrase so far.
4. Counts of parts, scores, containment and ranks are joins and aggregates of the frequent phrases.

Defined results: a NULL group is ``und``; a NULL or empty text has no words; ties of rank end with the phrase itself;
repeated rows count each time; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vigil.llm.common import column, small_batches, written
from vigil.llm.covering import heavy_join

#: Blanks and tabs end words, these signs end pieces (fixed values of the contract).
_TABLE = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + b"\n" * 9)
HOT = 4096
SLICE_WORDS, OUT_ROWS = 1 << 20, 1 << 16
#: A slice ends before its words no longer fit 16 bits, where one text has not so many.
SLICE_VOCABULARY = 50_000
SORT_ROWS = 1 << 20
#: Suffixes of one partition, as long as there are no more than ``MOST_PARTITIONS``; sorting may spill beyond.
PARTITION_ROWS, MOST_PARTITIONS = 1 << 20, 20_000
FILTER_BITS, BITMAP = 1 << 26, 32_768


class _Numbers(dict):
    """Word -> number from 2; 1 is the end of a piece, 0 no word."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(group, words, numbers of the words of its pieces) of runs of texts of one group; 1 ends each piece."""
    held: dict[str, tuple[_Numbers, list[np.ndarray], list[int]]] = {}

    def used(group: str):
        numbers, parts, _ = held.pop(group)
        return group, list(numbers), np.concatenate(parts)

    for batch in batches:
        for group, text in zip(batch.column("grp").to_pylist(), batch.column("text")):
            tokens = (text.as_py() or "").encode().lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
            numbers, parts, size = held.setdefault(group, (_Numbers(), [], [0]))
            found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
            parts += [found[found > 0], np.ones(1, np.int32)]
            size[0] += len(tokens)
            if size[0] >= SLICE_WORDS or len(numbers) >= SLICE_VOCABULARY:
                yield used(group)
            elif sum(s[0] for _, _, s in held.values()) >= 2 * SLICE_WORDS:
                yield used(max(held, key=lambda g: held[g][2][0]))
    for group in list(held):
        yield used(group)


def _joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words of each row, each followed by a blank; number 0 is none."""
    parts = [words.take(pa.array(c, mask=c == 0)) for c in columns]
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.string()), " ", null_handling="skip")


def _words_of(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _grouped(columns: list[np.ndarray], weights: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` (numbers below ``size``) in their order, and the sums of their weights."""
    bits = max(1, (size - 1).bit_length())
    per, keys = 64 // bits, []
    for first in range(0, len(columns), per):
        key = np.zeros(len(weights), np.uint64)
        for c in columns[first:first + per]:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    firsts = np.flatnonzero(new)
    sums = np.add.reduceat(weights[order], firsts) if len(firsts) else weights[:0]
    return [c[order[firsts]] for c in columns], sums


def _count(longest: int):
    """Rows (grp, phrase, words, n, hot): every word with its count, and the counts of prefixes that are hot in a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, words, t in _slices(batches):
            texts = _words_of(words)
            counts = np.bincount(t, minlength=len(words))
            counts[:2] = 0
            total = int(counts.sum())
            at = np.flatnonzero(t > 1)
            rows = [([np.flatnonzero(counts)], counts[counts > 0], True)]
            hot = counts * 2 * HOT > total
            columns = [t[at]]
            for _ in range(longest - 2):
                # prefixes of one word more, where the words before are hot in this slice
                keep = hot[columns[0]] if len(columns) == 1 else np.isin(_key(columns, len(words)), _key(listed, len(words)))
                at, columns = at[keep], [c[keep] for c in columns]
                keep = t[np.minimum(at + len(columns), len(t) - 1)] > 1
                at, columns = at[keep], [c[keep] for c in columns]
                columns = [*columns, t[at + len(columns)]]
                listed, sums = _grouped(columns, np.ones(len(at), np.int64), len(words))
                many = sums * 2 * HOT > total
                listed = [c[many] for c in listed]
                rows.append((listed, sums[many], False))
                if not many.any():
                    break
            for phrase, n, whole in rows:
                warm = np.where(n * 2 * HOT > total, n, 0)
                size = len(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([group] * size, pa.string()), _joined(texts, phrase), pa.array(np.full(size, len(phrase), np.int32)),
                    pa.array((n if whole else np.zeros(size)).astype(np.int64)), pa.array(warm.astype(np.int64))], ["grp", "phrase", "words", "n", "hot"])
    return run


def _key(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number per row; rows of more bits than 64 are told apart by a structured key."""
    bits = max(1, (size - 1).bit_length())
    if bits * len(columns) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        return key
    return np.array([b"%d " * len(columns) % row for row in zip(*(c.tolist() for c in columns))], dtype="S")


def _frequent_words(words: DataFrame, least: int) -> np.ndarray:
    """The bitmap of the frequent words of (grp, phrase, n): at most FILTER_BITS / BITMAP rows reach the driver."""
    place = F.pmod(F.xxhash64("grp", "phrase"), F.lit(FILTER_BITS)) + 1
    rows = words.filter(F.col("n") >= least).select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        first = (r["b"] - 1) * BITMAP // 8
        bits[first:first + BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _kept(bits: np.ndarray, group: str, words: list[bytes]) -> np.ndarray:
    """Which words of a slice the bitmap holds; the hash is that of the engine's ``xxhash64`` over both columns."""
    seed = xxh64_intdigest(group.encode(), 42)
    place = np.array([xxh64_intdigest(w + b" ", seed) for w in words], np.uint64) & np.uint64(FILTER_BITS - 1)
    kept = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    kept[:2] = False
    return kept


def _suffixes(longest: int, hot: dict[tuple[str, int], list[str]], shared=None):
    """Rows (s, c): the digit of the owner's length, the group, a tab and the words of a distinct suffix, each with a blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, words, t in _slices(batches):
            texts, place = _words_of(words), {w: k for k, w in enumerate(words)}
            if shared is not None:
                t = np.where(_kept(shared.value, group, words)[t], t, 1)
            at = np.flatnonzero(t[:-1] > 1)
            at = at[t[at + 1] > 1]  # a suffix of one word begins no phrase
            columns, alive = [t[at]], np.ones(len(at), bool)
            for j in range(1, longest):
                c = t[np.minimum(at + j, len(t) - 1)]
                alive = alive & (c > 1)
                columns.append(np.where(alive, c, 0))
            columns, sums = _grouped(columns, np.ones(len(at), np.int64), len(words))
            lead = np.ones(len(sums), np.int64)
            for d in range(1, longest):
                found = [p for p in ([place.get(w.encode()) for w in phrase.split(" ")] for phrase in hot.get((group, d), [])) if None not in p]
                rows = np.flatnonzero((lead == d) & (columns[d] > 0))
                if found and len(rows):
                    listed = [np.array(c, np.int32) for c in zip(*found)]
                    lead[rows[np.isin(_key([c[rows] for c in columns[:d]], len(words)), _key(listed, len(words)))]] = d + 1
            sent = [(columns, sums, lead)]
            for d in range(2, longest):
                beyond = lead > d
                if beyond.any():  # a hot prefix itself
                    part, weights = _grouped([c[beyond] for c in columns[:d]], sums[beyond], len(words))
                    sent.append((part, weights, np.full(len(weights), d, np.int64)))
            heads = pa.array([f"{d}{group}\t" for d in range(longest + 1)])
            for phrase, weights, owner in sent:
                for first in range(0, len(weights), OUT_ROWS):
                    cut = slice(first, first + OUT_ROWS)
                    body = _joined(texts, [c[cut] for c in phrase])
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(heads.take(pa.array(owner[cut])), body, ""), pa.array(weights[cut])], ["s", "c"])
    return run


def _pivot(keys: np.ndarray) -> int:
    """The median of some keys."""
    some = np.sort(keys[::max(1, len(keys) // 9)])
    return int(some[len(some) // 2])


def frequent(keys: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(a row, number of keys, weight) of every beginning of rows that weighs ``least`` or more, by multikey three-way quicksort.

    Key 0 ends a row.
    """
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1:
            row, weight = int(rows[0]), int(weights[rows[0]])
            while weight >= least and depth < len(keys) and keys[depth][row] > 0:
                depth += 1
                yield row, depth, weight
            continue
        k = keys[depth][rows]
        pivot = _pivot(k)
        for part, equal in ((rows[k < pivot], False), (rows[k == pivot], True), (rows[k > pivot], False)):
            weight = int(weights[part].sum())
            if weight < least:
                continue  # abandoned
            if not equal:
                stack.append((part, depth))
            elif pivot > 0:
                yield int(part[0]), depth + 1, weight
                if depth + 1 < len(keys):
                    part = part[keys[depth + 1][part] > 0]
                    if len(part):
                        stack.append((part, depth + 1))


def _sorted(longest: int, least: int):
    """Rows (grp, phrase, words, f) of the frequent phrases of a sorted partition."""
    def phrases(s: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
        halves = pc.split_pattern(s, "\t", max_splits=1).flatten()
        heads = halves.take(pa.array(np.arange(0, len(halves), 2))).dictionary_encode()
        lists = pc.split_pattern(halves.take(pa.array(np.arange(1, len(halves), 2))), " ")
        words = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = words.indices.to_numpy().astype(np.int32) + 1
        columns = [np.zeros(len(sizes), np.int32) for _ in range(longest)]
        for j, c in enumerate(columns):
            here = (place == j) & (j < sizes[row] - 1)  # the last part is behind the last blank
            c[row[here]] = codes[here]
        owners = heads.indices.to_numpy().astype(np.int32) + 1
        names = heads.dictionary.to_pylist()
        out = [(r, d - 1, w) for r, d, w in frequent([owners, *columns], weights, least) if d > 2 and d > int(names[owners[r] - 1][0])]
        rows, depth, weight = (np.array([o[i] for o in out], np.int64) for i in range(3))
        texts = pa.concat_arrays([pa.array([""]), words.dictionary.cast(pa.string())])
        body = _joined(texts, [np.where(depth > j, c[rows], 0) for j, c in enumerate(columns)])
        groups = pa.array([names[k - 1][1:] for k in owners[rows].tolist()], pa.string())
        return pa.RecordBatch.from_arrays([groups, body, pa.array(depth.astype(np.int32)), pa.array(weight)], ["grp", "phrase", "words", "f"])

    def owner(s: str) -> str:
        return " ".join(s.split(" ", int(s[0]))[:int(s[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, weights, size = [], [], 0
        for batch in batches:
            texts.append(batch.column("s"))
            weights.append(batch.column("c").to_numpy())
            size += batch.num_rows
            if size < SORT_ROWS:
                continue
            s, c = pa.concat_arrays(texts), np.concatenate(weights)
            # The last owner may go on in the next batch.
            last = owner(s[size - 1].as_py())
            low, high = 0, size - 1
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if owner(s[mid].as_py()) == last else (mid + 1, high)
            if low:
                yield phrases(s[:low], c[:low])
            texts, weights, size = [s[low:]], [c[low:]], size - low
        if size:
            yield phrases(pa.concat_arrays(texts), np.concatenate(weights))
    return run


def counts(docs: DataFrame, *, group_col: str, text_col: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): grp, phrase, n of every word; grp, phrase, words, f of phrases of 2 to ``longest`` words with f >= ``least``.

    Phrases have a blank behind each word.
    """
    rows = small_batches(docs).select(F.coalesce(column(group_col).cast("string"), F.lit("und")).alias("grp"), column(text_col).alias("text"))
    listed = rows.mapInArrow(_count(longest), "grp string, phrase string, words int, n long, hot long")
    listed = written(listed.groupBy("grp", "phrase", "words").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot")), "words")
    total = listed.agg(F.sum("n")).first()[0] or 0
    hot: dict[tuple[str, int], list[str]] = {}
    for r in listed.filter(F.col("hot") * (2 * HOT) >= total).filter("hot > 0").select("grp", "words", "phrase").collect():  # at most 2 HOT a length
        hot.setdefault((r["grp"], r["words"]), []).append(r["phrase"][:-1])
    parts = min(MOST_PARTITIONS, max(1, int(total) // PARTITION_ROWS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent_words(listed.filter("words = 1"), least))
    sent = rows.mapInArrow(_suffixes(longest, hot, shared), "s string, c long")
    owner = F.expr("substring_index(s, ' ', cast(substring(s, 1, 1) as int))")
    found = sent.repartition(parts, owner).sortWithinPartitions("s").mapInArrow(_sorted(longest, least), "grp string, phrase string, words int, f long")
    return listed.filter("words = 1").select("grp", "phrase", "n"), written(found, "phrases")


def collocations(docs: DataFrame, *, group_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30, top: int = 2000,
                 inside: int = 80, buckets: int = 256) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score of each group's ``top`` phrases of 2 to ``longest`` words.

    ``inside``: a phrase is dropped where a longer one that holds it has that percentage of its count.
    """
    words, found = counts(docs, group_col=group_col, text_col=text_col, longest=longest, least=least)
    known = found.select("grp", "phrase", "f").union(words.filter(F.col("n") >= least))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    parts = F.split(F.col("phrase"), " ")
    at = lambda a, n: F.concat(F.array_join(F.slice(parts, a, n), " "), F.lit(" "))
    cuts = found.select("grp", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": at(F.lit(1), F.col("k")), "rest": at(F.col("k") + 1, F.col("words") - F.col("k"))})
    for part, name in (("first", "l"), ("rest", "r")):
        uses = cuts.groupBy("grp", part).agg(F.count(F.lit(1)).alias("uses"))
        side = written(uses.join(known.select("grp", F.col("phrase").alias(part), F.col("f").alias(name)), ["grp", part]), f"parts-{name}")
        cuts = heavy_join(cuts, side, ["grp", part], "uses", "left").drop("uses")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("grp", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.concat(F.array_join(F.slice(parts, i, n), " "), F.lit(" ")))))
    longer = found.filter("words > 2").select("grp", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("grp", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(longer, ["grp", "phrase"], "left").filter(F.col("most").isNull() | (big("most") * 100 < big("a") * inside))
    kept = kept.select("grp", F.rtrim("phrase").alias("phrase"), "a", "b.l", "b.r", "b.score")
    # Ranked in parts of a group first, so no task sees all of a group.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    sizes = words.groupBy("grp").agg(F.sum("n").alias("n"))
    return kept.join(sizes, "grp").select("grp", "rank", "phrase", "a", "l", "r", "n", "score")
