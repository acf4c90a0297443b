"""Operators 11 to 13 against brute force, and on NULLs, empty, long, repeated and tied rows and clashing columns."""
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vigil.llm import covering, periodic, phrases, queries

SMALL = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- 11 phrase collocations


def plain_counts(rows, longest=4):
    """{group: Counter of phrases as tuples of words}."""
    out = collections.defaultdict(collections.Counter)
    for group, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                out[group or "und"].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return out


def plain_collocations(rows, least, top, inside=80):
    out = []
    for group, f in plain_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found, ranked = {p: c for p, c in f.items() if len(p) > 1 and c >= least}, []
        for p, a in found.items():
            if any(100 * c >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in found.items() if len(q) > len(p)):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(group, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def mixed_texts(rng, n, words):
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice([". ", ",", "\n", " ; ", "\t"]).join(parts))
    return texts


def test_collocations_equal_plain_counts(spark, docs_of):
    rng = random.Random(5)
    words = ["the"] * 8 + ["New", "york", "ÉTÉ", "été", "a\x01", "a", "x!y", "b c", " "]
    texts = mixed_texts(rng, 120, words) + ["new york " * 400, None, "", " \t ", "...", "one", "a " * 300]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    docs = docs_of(texts, langs=langs, extra=("grp", "phrase", "a", "rank", "n"))
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=5, top=40).collect())
    assert got == plain_collocations(list(zip(langs, texts)), 5, 40) and len(got) > 60
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_query_equals_plain_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = sorted(tuple(r) for r in queries.op11_collocations(spark, SMALL).collect())
    assert got == plain_collocations([(d.lang, d.text) for d in docs], 30, 2000) and got


@pytest.mark.parametrize("hot,slice_words,sort_rows", [(4096, 1 << 20, 1 << 20), (8, 50, 10), (2, 7, 1), (1, 1, 3), (32, 400, 100)])
def test_owners_slices_and_stretches_never_change_the_counts(monkeypatch, hot, slice_words, sort_rows):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(phrases, "SORT_ROWS", sort_rows)
    rng = random.Random(hot)
    texts = mixed_texts(rng, 60, ["the"] * 12 + ["of"] * 6 + list("abcdefgh")) + ["the of the of " * 60, "the of the of the of. " * 20]
    rows = [(rng.choice(["en", "d e"]), t) for t in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in part]), pa.array([t for _, t in part])], ["grp", "text"]) for part in (rows[:20], rows[20:])]
    table = lambda made: [r for b in made for r in b.to_pylist()]
    words, listed, total = collections.Counter(), collections.Counter(), 0
    for r in table(phrases._count(4)(iter(batches))):
        words[r["grp"], r["phrase"]] += r["n"]
        listed[r["grp"], r["words"], r["phrase"]] += r["hot"]
        total += r["n"]
    hots = collections.defaultdict(list)
    for (g, n, p), c in listed.items():
        if c and c * 2 * hot >= total:
            hots[g, n].append(p[:-1])
    plain = plain_counts(rows)
    assert {k: v for k, v in words.items() if v} == {(g, p[0] + " "): c for g, f in plain.items() for p, c in f.items() if len(p) == 1}
    if 8 <= hot <= 32:
        assert any(n == 3 for _, n in hots)
    owners = collections.defaultdict(list)
    for r in table(phrases._suffixes(4, hots)(iter(batches))):
        d = int(r["s"][0])
        # as substring_index deals them: heads of groups with a blank fall to fewer words, all of one owner still meet
        owners[" ".join(r["s"].split(" ")[:d])].append((r["s"], r["c"]))
    # two partitions, sorted
    got = []
    for side in (0, 1):
        part = sorted((x for o, xs in owners.items() if hash(o) % 2 == side for x in xs), key=lambda x: x[0].encode())
        cut = [part[k:k + 9] for k in range(0, len(part), 9)]
        got += table(phrases._sorted(4, 4)(pa.RecordBatch.from_arrays([pa.array([s for s, _ in b]), pa.array([c for _, c in b], pa.int64())], ["s", "c"]) for b in cut))
    want = {(g, " ".join(p) + " "): c for g, f in plain.items() for p, c in f.items() if len(p) > 1 and c >= 4}
    assert {(r["grp"], r["phrase"]): r["f"] for r in got} == want and len(got) == len(want)


def test_the_bitmap_holds_the_frequent_words_alone(spark):
    rows = [(g, f"{w} ", n) for g in ("en", "dé") for w, n in (("the", 30), ("rare", 29), ("été", 500), ("x\x01", 31), ("中文", 3))]
    bits = phrases._frequent_words(spark.createDataFrame(rows, "grp string, phrase string, n long"), 30)
    words = [b"", b"\n", b"the", b"rare", "été".encode(), b"x\x01", "中文".encode(), b"never"]
    for g in ("en", "dé"):
        assert phrases._kept(bits, g, words).tolist() == [False, False, True, False, True, True, False, False]
    assert int(np.bitwise_count(bits).sum()) == 6 and not phrases._kept(bits, "fr", words).any()


# --- 12 periodic runs


def plain_runs(t, least=12):
    found = {}
    for q in range(1, len(t) // 2 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j - i >= max(q, least - q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_hard_words_equal_plain_search():
    thue_morse = [bin(i).count("1") & 1 for i in range(1200)]
    two = [0, 1]
    hard = [fibonacci(900), thue_morse, [0] * 500, two * 250 + [0] + two * 300, (two * 90 + [0]) * 4, [], [1], ([3, 3, 4] * 60 + [4]) * 3, thue_morse[:64] * 9]
    got = periodic.runs_of([np.array(t, np.int64) for t in hard])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in hard]
    assert sum(map(len, got)) > 300


def test_runs_of_random_copies_equal_plain_search():
    rng = random.Random(3)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 4)):
            t, n, letters = [], rng.randint(0, 700), rng.choice([1, 2, 3, 40])
            while len(t) < n:
                kind = rng.random()
                if kind < 0.35 or not t:
                    t += [rng.randrange(letters) for _ in range(rng.randint(1, 50))]
                elif kind < 0.7:
                    p = rng.randint(1, min(len(t), rng.choice([3, 20, 250])))
                    for _ in range(rng.randint(1, p * rng.choice([2, 4, 25]))):
                        t.append(t[-p])
                else:
                    t += t[-rng.randint(1, len(t)):]
            texts.append(t[:n])
        got = periodic.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]


def plain_digest(doc_id, text):
    import zlib
    w = re.findall("[^ \t-\r]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n, w0 = h // 10, len(w), w
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w0[i] if i < a else w0[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_runs_query_equals_plain_search(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").filter("length(text) < 9000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert all(got[d.doc_id] == plain_digest(d.doc_id, d.text) for d in docs) and len(docs) > 150
    assert sum(1 for r in got.values() if r[1]) > 5


def test_runs_edges(spark, docs_of):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen x "
    texts = [None, "", " \t\n\x0b\x0c\r", "a " * 11, "a " * 12, line * 2, "pre " + line * 3 + "post", "x\x1cy " * 40, "w " * 50_000, line * 3000, "a " * 12]
    ids = [3, 3, 5, 6, 7, 8, 9, 11, 12, 13, None]
    docs = docs_of(texts, ids=ids, extra=("id", "runs", "n_runs", "text_"))
    got = [tuple(r) for r in periodic.digest(docs, rewrite=periodic.repeated_tail).collect()]
    for r, i, t in zip(got, ids, texts):
        assert r == plain_digest(i, t) if len(t or "") < 2000 else r[1] == 1
    full = {r.doc_id: r for r in periodic.find(docs.filter("doc_id in (7, 9)")).collect()}
    assert [tuple(x) for x in full[9].runs] == plain_runs(texts[6].split(" "))
    assert full[7].collapsed == "a" and full[9].collapsed == "pre " + line + "post"
    assert periodic.digest(docs.limit(0)).count() == 0


# --- 13 covering locality-sensitive hashing


def plain_print(text, k=3):
    w = re.findall("[^ \t-\r]+", lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(prints, ids, radius=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(prints))]


def test_masks_cover_every_pair_of_positions():
    for radius in (2, 4):
        masks = covering.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(1)
        for _ in range(2000):
            far = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & far for m in masks)


def test_fingerprints_equal_plain_votes():
    rng = random.Random(2)
    texts = [None, "", "A", "a b", "A b C", "É x y z", "a\x1cb \x0b c d e", "a a a a a", " ".join(rng.choice("abcdefg") for _ in range(70_000))]
    assert [covering.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def test_links_connect_all_within_the_radius(spark):
    rng = random.Random(7)
    prints, centre = set(), rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 3), 2)}  # a crowd in one bucket
    for _ in range(150):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(rng.randint(0, 4)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
            prints.add(f)
    prints |= {0, 1, 3, 7, 15, 1 << 63}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = covering.links(spark.createDataFrame([(s,) for s in signed], "f long"))
    edges = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges) and len(edges) < 66 * len(prints)
    labels = {r.f: r.label for r in covering.components(found).collect()}
    want = plain_components(prints, signed)
    assert [labels.get(s, s) for s in signed] == want


def test_near_duplicates_equal_all_pairs(spark, docs_of):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(8)]
    texts = [t for b in base for t in (b, b.upper(), b + " tail", " ".join(w for w in b.split() if w != rng.choice(words)))]
    texts += [None, "", " \n", "one", "ONE two", "one two", base[0], base[0], None]
    ids = [rng.randint(0, 10_000) for _ in texts]
    ids[-1], ids[-2], ids[5] = None, ids[-3], None
    docs = docs_of(texts, ids=ids, extra=("id", "f", "n", "label", "fingerprint", "component_id"))
    got = sorted((tuple(r) for r in covering.near_duplicates(docs).collect()), key=str)
    prints = [plain_print(t) for t in texts]
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(prints, ids))]
    assert got == sorted(want, key=str)
    assert covering.near_duplicates(docs.limit(0)).count() == 0


def test_component_of_rows_without_ids_has_no_name(spark):
    docs = spark.createDataFrame([(None, "only here now"), (None, "only here now"), (4, "else where then")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in covering.near_duplicates(docs).collect())
    assert got == [(0, None), (0, None), (4, 4)]


def test_hot_keys_join_like_any_other(spark):
    left = spark.createDataFrame([(k % 5 if k < 900 else k, k) for k in range(1000)], "k long, v long")
    counted = left.groupBy("k").count().withColumnRenamed("count", "n").filter("k <> 3")
    got = covering.heavy_join(left, counted, ["k"], "n", "left").collect()
    assert sorted((r.k, r.v, r.n) for r in got) == sorted((k, v, None if k == 3 else 180 if k < 5 else 1) for k, v in ((k % 5 if k < 900 else k, k) for k in range(1000)))
    assert covering.heavy_join(left, counted.filter("n > 1"), ["k"], "n", "left_semi").count() == 720
