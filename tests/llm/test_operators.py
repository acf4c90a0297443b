"""Each operator on small tables: brute force, NULLs, empty and long texts, repeats, ties, empty tables, clashing columns."""
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import decontaminate, graph, jaccard, langid, mixing, pii, quality, queries, simhash, tokens, urlfilter, warc
from vigil.llm.common import new_dir, shared_dir

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and to in that was with this from over under near after".split()


def rows(df, key):
    return {r[key]: r for r in df.collect()}


# --- 1 language id


def test_language_id_on_held_out_rows(spark):
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    judged = found.join(docs, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").collect()
    assert len(judged) > 200 and sum(r.ok for r in judged) >= 0.97 * len(judged) and all(0 <= r.score <= 1 for r in judged)
    ids = [r.doc_id for r in found.filter("held_out").select("doc_id").collect()]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids) and found.count() == docs.count()


def test_language_id_edges(spark, docs_of):
    machine = (np.zeros(langid.FEATURES), 1.0)
    model = {"languages": ["de", "en", "xx"], "machines": {("family", "germanic", "xx"): machine, ("language", "de", "en"): machine}}
    docs = docs_of(["abc", None, "", "12 !", "é", "z" * 200_000], extra=("score", "lang_pred", "id"))
    got = rows(langid.predict(docs, model), "doc_id")
    assert [got[k].lang_pred for k in range(1, 7)] == ["de", "und", "und", "und", "de", "de"] and got[2].score == 0
    unlabelled = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), id_col="doc_id", text_col="text", lang_col="lang")
    assert {r.lang_pred for r in langid.predict(docs, unlabelled).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


# --- 2 quality


def plain_kneser_ney(trained, text, order=5):
    """Interpolated modified Kneser-Ney by dictionaries."""
    padded = lambda t: b"\n" * (order - 1) + t
    counts = {order: collections.Counter(padded(t)[i:i + order] for t in trained for i in range(len(t)))}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[1] and n[2] and n[3] else -1
            out.append(d if 0 < d < k else quality.DISCOUNTS[k - 1])
        return out

    d = {n: discounts(counts[n]) for n in counts}
    contexts = {n: collections.defaultdict(lambda: [0, 0.0]) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            contexts[n][g[:-1]][0] += v
            contexts[n][g[:-1]][1] += d[n][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        below = p(g[1:])
        n = len(g)
        if g[:-1] not in contexts[n]:
            return below
        total, left = contexts[n][g[:-1]]
        v = counts[n].get(g, 0)
        return (max(v - (d[n][min(v, 3) - 1] if v else 0), 0) + left * below) / total

    wide = padded(text)
    return math.exp(-sum(math.log(p(wide[i:i + order])) for i in range(len(text))) / len(text))


def test_perplexity_equals_plain_model_in_any_number_of_shards(docs_of):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["ZZZ!! été", None, ""]
    docs = docs_of(texts, langs=["en"] * 41 + [None, None], extra=("key", "unseen", "trusted"))
    trusted = docs.filter("doc_id <= 30").select("doc_id").union(docs.limit(3).select("doc_id"))
    trained = [t.encode() for k, t in enumerate(texts[:30], 1) if zlib.crc32(str(k).encode()) % 3 != 0]
    for size in (quality.SHARD_GRAMS, 300):
        got = rows(quality.perplexity(docs, trusted, shard_grams=size), "id")
        assert len(got) == 43 and got[42].perplexity is None and got[43].perplexity is None and got[42].lang == "und"
        for k in (1, 2, 31, 40, 41):
            assert got[k].perplexity == pytest.approx(plain_kneser_ney(trained, texts[k - 1].encode()), rel=1e-9)
        assert got[5].unseen == (zlib.crc32(b"5") % 3 == 0) and not got[35].unseen


def test_quality_keeps_trusted_text_and_drops_junk(spark):
    found = queries.op2_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    share = {r.quality: r.k for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < 0.25 and found.count() == 1000


def test_quality_without_trusted_rows_or_rows(docs_of):
    docs = docs_of(["abc abc", None])
    none = docs.limit(0).select("doc_id")
    got = rows(quality.judge(quality.perplexity(docs, none)), "id")
    assert got[1].keep and not got[2].keep
    assert quality.judge(quality.perplexity(docs.limit(0), none)).count() == 0


def test_quality_keeps_languages_without_enough_trusted_text(docs_of):
    rng = random.Random(4)
    prose = lambda w: " ".join(rng.choice(w) for _ in range(40))
    other = "og det som er ikke til på av for med han var".split()
    few = [k for k in range(1000, 1040) if zlib.crc32(str(k).encode()) % 3 == 0]
    junk = "".join(rng.choice("0123456789#@%&") for _ in range(200))
    texts = [prose(WORDS) for _ in range(400)] + [prose(other) for _ in range(30)] + [prose(other) for _ in range(30)] + [junk, junk, "", None]
    ids, langs = [*range(1, 401), *range(601, 631), few[0], *range(2001, 2030), 3001, 3002, 3003, 3004], ["en"] * 400 + [None] * 30 + ["da"] * 30 + ["en", "da", None, "da"]
    docs = docs_of(texts, ids=ids, langs=langs)
    trusted = docs.filter(f"doc_id <= 400 OR doc_id = {few[0]}").select("doc_id")  # none of und, one unseen row of da
    got = rows(quality.judge(quality.perplexity(docs, trusted)), "id")
    assert all(got[k].keep for k in range(601, 631)) and all(got[k].keep for k in (few[0], *range(2001, 2030)))
    assert got[601].high is None and got[2001].high is None
    assert not got[3001].keep and not got[3003].keep and not got[3004].keep
    assert sum(got[k].keep for k in range(1, 401)) > 390


def test_quality_ranges_of_few_rows_are_as_wide_as_others(spark):
    row = "id long, key long, lang string, n_bytes long, perplexity double, trusted boolean, unseen boolean"
    rng = random.Random(8)
    many = [(k, k, "en", 5000, math.exp(rng.gauss(1.5, 0.05)), True, True) for k in range(400)]
    narrow = [(500 + k, k, "da", 5000, math.exp(3 + 0.001 * k), True, True) for k in range(12)]
    copies = [(600 + k, 1, "fi", 5000, 9.0, True, True) for k in range(300)]
    asked = [(700, 1, "da", 5000, math.exp(3.1), False, False), (701, 1, "da", 5000, math.exp(4.5), False, False), (702, 1, "fi", 5000, 9.5, False, False)]
    got = rows(quality.judge(spark.createDataFrame([*many, *narrow, *copies, *asked], row), min_rows=301), "id")
    assert got[700].keep and not got[701].keep and got[702].keep and all(got[k].keep for k in range(500, 512))


# --- 3 fingerprints


def test_simhash_by_plain_votes(docs_of):
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(6)
    texts = [None, "", "one", " \n", "é中🙂" * 3] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 60))) for _ in range(30)]
    texts += [texts[-1]] * 3
    docs = docs_of(texts, extra=("f1", "part", "which", "n"))
    h = lambda b, seed: xxhash.xxh64_intdigest(b, seed)

    def plain(text):
        w = text.split()
        terms = [h(b.encode(), h(a.encode(), 42)) for a, b in zip(w, w[1:])] if len(w) > 1 else [h((w or [""])[0].encode(), 42)]
        more = [h(t.to_bytes(8, "little"), h(b"second", 42)) for t in terms]
        return "".join(f"{sum(1 << i for i in range(64) if 2 * sum(t >> i & 1 for t in part) > len(terms)):016x}" for part in (terms, more))

    for per_range in (4, 4096):
        got = rows(simhash.compare(docs, rows_per_range=per_range), "doc_id")
        down = list(reversed(texts))
        for k, text in enumerate(down):
            text, after, r = text or "", down[(k + 1) % len(down)] or "", got[len(texts) - k]
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), plain(text), plain(edited))
            like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
            assert r.near_edited == like(plain(text), plain(edited)) and r.near_next == like(plain(text), plain(after))
    assert simhash.compare(docs.limit(0)).count() == 0


def test_simhash_repeated_and_null_ids(docs_of):
    got = simhash.compare(docs_of(["a b", "c d", "c d", "e f"], ids=[1, 1, 1, None])).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 3


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 5), (3, 4), (6, 8)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(30)]
    every = base + [b ^ sum(1 << i for i in rng.sample(range(128), rng.randint(0, 9))) for b in base for _ in range(6)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v & (1 << 64) - 1), signed(v >> 64)) for v in every], "f1 long, f2 long")
    got = {((r.q2 & (1 << 64) - 1) << 64 | r.q1 & (1 << 64) - 1, (r.f2 & (1 << 64) - 1) << 64 | r.f1 & (1 << 64) - 1) for r in simhash.near(df.limit(40), df, radius=radius, blocks=blocks).collect()}
    assert got == {(a, b) for a in set(every[:40]) for b in set(every) if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("radius", [6, 13])
def test_changed_blocks_find_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(30)]
    every = base + [b ^ sum(1 << i for i in rng.sample(range(128), rng.randint(0, 17))) for b in base for _ in range(12)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v & (1 << 64) - 1), signed(v >> 64)) for v in every], "f1 long, f2 long")
    got = {((r.q2 & (1 << 64) - 1) << 64 | r.q1 & (1 << 64) - 1, (r.f2 & (1 << 64) - 1) << 64 | r.f1 & (1 << 64) - 1) for r in simhash.near(df.limit(40), df, radius=radius).collect()}
    assert got == {(a, b) for a in set(every[:40]) for b in set(every) if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("radius", [3, 13])
def test_probes_of_few_fingerprints_are_not_broadcast(spark, radius):
    # 300 fingerprints are far below the threshold of a broadcast, their probes are up to 135 times as many.
    df = spark.range(300).select(F.xxhash64("id").alias("f1"), F.xxhash64("id", "id").alias("f2"))
    found = simhash.near(df.limit(40), df, radius=radius)
    assert len(found.collect()) == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, None), (3, 4), (6, 8), (6, None), (13, None)])
def test_the_search_joins_a_pair_once(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(8)]
    every = sorted({b ^ sum(1 << i for i in rng.sample(range(128), rng.randint(0, radius + 2))) for b in base for _ in range(25)})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v & (1 << 64) - 1), signed(v >> 64)) for v in every], "f1 long, f2 long")
    found = simhash.near(df.limit(40), df, radius=radius, blocks=blocks)
    got = [((r.q2 & (1 << 64) - 1) << 64 | r.q1 & (1 << 64) - 1, (r.f2 & (1 << 64) - 1) << 64 | r.f1 & (1 << 64) - 1, r.distance) for r in found.collect()]
    assert sorted(got) == sorted((a, b, (a ^ b).bit_count()) for a in every[:40] for b in every if (a ^ b).bit_count() <= radius)
    # The pairs leave the join as they are returned: no aggregate removes repeated ones behind it.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Join Inner")]


def test_simhash_query_names_near_copies_of_one_changed_word(spark, docs_of):
    rng = random.Random(12)
    words = [[f"w{rng.randint(0, 5000)}" for _ in range(250)] for _ in range(10)]
    texts, ids = [" ".join(w) for w in words], [20 * k for k in range(1, 11)]
    for k, w in enumerate(words):
        texts += [" ".join([*w[:120], "changed", *w[121:]])] * 2
        ids += [1001 + 20 * k, 1002 + 20 * k]
    folder = new_dir(spark, "t3-in")
    docs_of(texts, ids=ids).write.parquet(f"{folder}/documents.parquet")
    got = rows(queries.op3_simhash(spark, folder), "doc_id")
    halves = {k: int(got[k].fingerprint, 16) for k in ids}
    far = [(halves[20 * k + 20] ^ halves[1001 + 20 * k]).bit_count() for k in range(10)]
    assert max(far) > 3
    for k in range(10):
        asked, copy = got[20 * k + 20], got[1002 + 20 * k]
        assert copy.same_id == (1001 + 20 * k if far[k] else 20 * k + 20) and asked.same_id == 20 * k + 20
        assert copy.within_ids is None and copy.n_within is None
        assert asked.within_ids == [1001 + 20 * k] * (0 < far[k] <= 13) and asked.n_within == 2 * (far[k] <= 13)
    assert sum(f <= 13 for f in far) >= 9


# --- 4 mixing


def test_mixing_inverts_the_poisson_distribution(docs_of, spark):
    docs = docs_of([f"t{k}" for k in range(400)], ids=[*range(1, 400), None], extra=("copy", "_u", "_key", "mix_rate")).withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")))
    out = mixing.mix(docs, weights={"a": 3.0, "b": 1.0}, default_weight=0.5, total=900, seed=5)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_u", "_key", "copy", "mix_rate", "mix_key"]
    got = collections.Counter(r.doc_id for r in out.collect())
    sizes = collections.Counter(r.source for r in docs.collect())
    rate = {s: round({"a": 3.0, "b": 1.0}.get(s, 0.5) / 4.5 * 900 / n, 6) for s, n in sizes.items()}
    for r in docs.filter("doc_id IS NOT NULL").collect():
        u = (int(hashlib.md5(f"5:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate[r.source])
        c = p
        while c < u:
            k += 1
            p *= rate[r.source] / k
            c += p
        assert got[r.doc_id] == k
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, weights={}).count() == 0


def test_mixing_large_rate_does_not_underflow(docs_of):
    n = mixing.mix(docs_of(["x"] * 3), total=6000).count()
    assert abs(n - 6000) < 6 * 6000**0.5


def test_large_side_is_salted(spark, monkeypatch):
    from vigil.llm import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    left = spark.createDataFrame([(str(k % 3), k) for k in range(30)], "k string, v long")
    side = spark.createDataFrame([(str(k), k) for k in range(9)], "k string, w long")
    got = common.join_side(left, side, "k").collect()
    assert sorted((r.v, r.w) for r in got) == [(k, k % 3) for k in range(30)]


# --- 5 url filter


def test_urls_and_rules(spark):
    urls = [None, "no scheme", "http://", "HTTP://EXAMPLE.org", "http://example.org/es/1?a#b", "http://a.Example.ORG/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/", "http://notexample.org/es/",
            "http://www.b.net/p/?utm_source=1&x=2#f", "ftp://b.net/p?x=2", "http://b.net/q", "a://b?c", "http://b.net/q", "x\n://h/p"]
    pages = spark.createDataFrame([(k, u, "h", "z") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("b.net/p?x=2",), ("b.net/p?x=2",), (None,), ("x.com/fr/1",)], "u string")
    got = rows(urlfilter.judge(pages, listed), "page_id")
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "", None, "allow"), ("example.org", "/es/1", "example.org/es/", "block"),
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block"),
        ("notexample.org", "/es/", "org/", "allow"), ("www.b.net", "/p/", None, "block"), ("b.net", "/p", None, "block"), ("b.net", "/q", None, "allow"), ("b", "", None, "allow"), ("b.net", "/q", None, "allow"), ("h", "/p", None, "allow")]
    assert got[7].listed and urlfilter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, listed.limit(0)).filter("rule IS NULL").collect()} == {"allow"}


@pytest.mark.parametrize("limit", [urlfilter.FILTER_BROADCAST_BYTES, 0])
def test_bloom_filter_passes_all_and_few_others(spark, limit, monkeypatch):
    monkeypatch.setattr(urlfilter, "FILTER_BROADCAST_BYTES", limit)
    listed = spark.range(2000).select(F.concat(F.lit("l"), "id").alias("u"))
    urls = listed.union(spark.range(20000).select(F.concat(F.lit("o"), "id")))
    assert urlfilter.listed_urls(urls, listed).count() == 2000
    filter_, blocks = urlfilter.bloom_filter(listed)
    probes = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("u"))
    hit = F.lit(True)
    for i, m in enumerate(urlfilter._masks(F.col("u"))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) == m)
    passed = probes.withColumn("_block", urlfilter._block(F.col("u"), blocks)).join(filter_, "_block").filter(hit).count()
    assert 0 < blocks and passed < 0.01 * 20000


# --- 6 token files


@pytest.mark.parametrize("shard_tokens,shard_chars", [(8 << 20, 16 << 20), (40, 400)])
def test_token_files_hold_the_library_ids(spark, docs_of, shard_tokens, shard_chars):
    rng = random.Random(9)
    texts = [None, "", "été <|endoftext|> x", "a" * 9000] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    docs = docs_of(texts, ids=[*range(len(texts), 1, -1), 2], extra=("part", "seq", "ids"))  # the last two share an id
    path, file = new_dir(spark, "t6"), public_tokenizers.path("byte_bpe_50k.json")
    tokens.write_tokens(docs, path, vocabulary=file, shard_tokens=shard_tokens, shard_chars=shard_chars)
    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    want, start = [], 0
    for i, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tokens.read_documents(spark, path).orderBy("start").collect()] == want
    assert sum(len(r.ids) for r in tokens.read_ids(spark, path).collect()) == start
    shards = tokens.read_shards(spark, path).orderBy("part", "seq").collect()
    zeros = [tokens.shard_reader(r).count(0) for r in shards]
    assert sum(zeros) == len(texts) and (len(shards) > 1) == (shard_tokens == 40)


def test_token_query_and_stage_encode_as_the_untouched_library(spark, docs_of):
    import corpus_pipeline
    texts = ["été <|endoftext|> x", "plain", "a<|endoftext|>", "<|endoftext|><|endoftext|>\n b", "<|endoftext> c", None]
    folder, t, start, want = new_dir(spark, "t6-in"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    docs_of(texts).write.parquet(f"{folder}/documents.parquet")
    for k, text in enumerate(texts, 1):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in queries.op6_token_files(spark, folder).orderBy("start").collect()] == want
    assert [tuple(r) for r in dict(corpus_pipeline.STAGES)["tokens"](spark, docs_of(texts), folder).orderBy("start").collect()] == want


def test_token_files_of_an_empty_table(spark, docs_of):
    path = new_dir(spark, "t6")
    tokens.write_tokens(docs_of([]), path, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.read_documents(spark, path).count() == 0


# --- 7 decontamination


@pytest.mark.parametrize("chars", [decontaminate.PATTERN_CHARS, 60])
def test_decontamination_in_any_number_of_groups(spark, docs_of, chars):
    items = spark.createDataFrame([(1, "Alpha beta-gamma delta, one two three four five six seven"), (2, "short Item"), (2, "other text of the item two"), (3, None), (4, "..."), (None, "lonely words here")], "item_id long, text string")
    texts = ["x ALPHA beta gamma Delta one two three four five six y", "a short item b", None, "", "lonely words here", "alpha beta gamma delta one two three four five", "q short item; other TEXT of the item two short item"]
    docs = docs_of(texts, extra=("n_words", "spans", "items", "c0"))
    got = rows(decontaminate.summary(decontaminate.scan(docs, items, pattern_chars=chars)), "doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) for k in range(1, 8)] == [
        (12, 10, 1, sha("1"), True), (4, 2, 1, sha("2"), True), (0, 0, 0, sha(""), False), (0, 0, 0, sha(""), False), (3, 3, 0, sha(""), True), (9, 0, 0, sha(""), False), (11, 10, 1, sha("2"), True)]
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert decontaminate.summary(decontaminate.scan(docs, items.limit(0))).filter("contaminated").count() == 0


# --- 8 Jaccard join


def plain_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_components_equal_all_pairs(docs_of, k, num, den):
    rng = random.Random(k)
    vocabulary = WORDS + [f"w{j}" for j in range(200)]
    texts = [None, "", "one", "one", "one two"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 70))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
            if rng.random() < 0.3:
                base = copy  # chains of edits
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs_of(texts, extra=("n", "id", "digest", "pos")), k=k, num=num, den=den).collect()}
    want = plain_components(dict(enumerate(texts, 1)), k, num, den)
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 5


def test_jaccard_edges_and_survivors(docs_of):
    text = "a b c d e f g h i j"
    docs = docs_of([text, text, text + " k", None, None, "", text, "z z"], ids=[5, 3, 9, 1, 2, 4, None, 5], extra=("component_id", "_rank", "_repeated"))
    got = [(r.doc_id, r.component_id) for r in jaccard.join(docs, k=5).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (5, 3), (9, 3)] and (None, None) in got
    kept = jaccard.survivors(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [
        (1, ""), (2, ""), (3, text), (4, ""), (5, "z z")]  # an id and its text make a document
    again = docs_of([text, text, "q r s t u"], ids=[7, 7, 8])
    assert sorted(r.doc_id for r in jaccard.survivors(again).collect()) == [7, 8]
    assert jaccard.join(docs.limit(0)).count() == 0 and jaccard.survivors(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 103)], "a long, b long")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100}


# --- 9 archive


def test_archive_round_trip(spark):
    body = "x\r\n\r\nWARC/1.1\r\n" * 12 + "é中"
    data = [(3, "http://a\r\nX: y", body), (1, None, body), (2, "u", None), (7, "u", ""), (8, "u", "short"), (9, "u", "short"), (4, "u", body + "!"), (None, "u", body), (1, "again", body), (5, "u", body)]
    pages = spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, html string, id string")
    path = new_dir(spark, "t9")
    warc.write_archive(pages.withColumn("head", F.lit("X-Own: 1\r\n")), path, id_col="page_id", uri_col="url", payload_col="html", headers_col="head")
    records = warc.read_archive(spark, path)
    assert {(r.id, r.record_type, r.refers_to) for r in records.collect()} == {(None, "response", None), ("1", "response", None), ("2", "response", None), ("7", "response", None), ("8", "response", None),
                                                                               ("9", "response", None), ("4", "response", None), ("3", "revisit", "1"), ("5", "revisit", "1")}
    back = warc.restore(records, ("payload", "payload_bytes")).collect()
    key = lambda i: i if i is not None else -1
    assert sorted((key(None if r.id is None else int(r.id)), bytes(r.payload), r.payload_bytes) for r in back) == sorted((key(i), (h or "").encode(), len((h or "").encode())) for i, _, h in data)
    assert all("\r\nX-Own: 1\r\n\r\n" in r.headers and r.headers.count("WARC-Target-URI") <= 1 for r in back)
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in back)


def test_archive_of_an_empty_table(spark):
    path = new_dir(spark, "t9")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path, id_col="page_id", uri_col="url", payload_col="html")
    assert warc.read_archive(spark, path).count() == 0


# --- 10 personal data


def test_pii_adds_but_keeps_base_spans(spark, docs_of):
    found = queries.op10_pii(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(found) == len(texts) and sum(r.n_email for r in found) > 10
    for r in found:
        base = pii.base_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(pii._joined(base).encode()).hexdigest()
        assert set(filter(None, pii._joined(base).split(","))) <= set(filter(None, r.spans.split(",")))


def test_pii_field_reaches_distant_repeats(docs_of, spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    number = "4501 0423 2399 4846"  # passes the check sum in groups; alone, glued to letters, no pattern takes it
    far = "card 4111-1111-1111-1111 " + "word " * 400 + "again 4111-1111-1111-1112 x 4111-1111-1111-1112"
    got = rows(pii.find(docs_of([None, "", far, "no digits", "year 1999", number], extra=("spans", "n_card")), model), "doc_id")
    assert got[1].spans == got[2].spans == got[4].spans == got[5].spans == "" and got[3].n_card == 1
    assert got[3].spans.startswith("card:5:24")
    assert pii.find(docs_of([]), None).count() == 0
    assert pii.fit(docs_of(["plain 1 2 3", None])) is None


# --- shared parts


def test_shared_folder_is_that_of_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_flags_and_drops_do_not_depend_on_the_size_of_the_list(spark, monkeypatch, limit):
    from vigil.llm import common
    monkeypatch.setattr(common, "DROP_ROWS", limit)
    rows_ = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, None)], "id long, t string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "x long")
    assert sorted((r.id or 0, r.f) for r in common.flagged(rows_, ids, "id", "f").collect()) == [(0, False), (1, True), (1, True), (2, False), (3, False)]
    drop = spark.createDataFrame([(2, "b"), (None, "c"), (3, "x")], "id long, t string")
    assert sorted((r.id, r.t or "") for r in common.without(rows_, drop, ["id", "t"]).collect()) == [(1, "a"), (1, "a"), (3, "")]


def test_large_candidate_lists_are_joined(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "CANDIDATE_ROWS", 0)
    text = "a b c d e f g h i j k l m n o p q r s t"
    got = {r.doc_id: r.component_id for r in jaccard.join(docs_of([text, text + " u", "x y z", text + " u"]), k=3, num=9, den=10).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_pipeline_stages_keep_the_columns_and_do_their_work(spark, docs_of):
    import corpus_pipeline
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    body = " ".join(f"w{k}" for k in range(60))
    docs = docs_of([body, body, body + " more", f"before {item} after", None, ""], ids=[4, 2, 7, 9, 10, 11], extra=("spans", "copy", "_key", "_drop0", "_rank", "a.b`c"))
    near, clean_, mixed, files_ = (f for _, f in corpus_pipeline.STAGES[1:])
    kept = near(spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 9, 10, 11]
    left = clean_(spark, kept, SMALL)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 10, 11]
    copies = mixed(spark, left, SMALL)
    assert copies.schema == docs.schema and left.schema == docs.schema and {r.doc_id for r in copies.collect()} <= {2, 10, 11}
    out = files_(spark, copies, SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == copies.count()


def test_every_operator_query_is_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())
