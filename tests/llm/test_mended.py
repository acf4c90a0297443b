"""Cases that lost data or memory before: tiny rates, foreign archives, colliding ids, far evidence, caches, order of files."""
import gzip
import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import encoder, jaccard, mixing, pii, tokens, warc, wavelet
from vigil.llm.common import new_dir, written


def test_a_tiny_rate_does_not_vanish(spark):
    sizes = spark.createDataFrame([("big", 10**10), ("small", 3)], "_source string, n long")
    got = {r._source: r.mix_rate for r in mixing.rates(sizes, weights={"big": 1.0, "small": 1.0}, total=1000.0).collect()}
    assert got["big"] == pytest.approx(500 / 10**10, rel=1e-6) and got["small"] == pytest.approx(500 / 3, rel=1e-6)
    cdf = {r._source: r._cdf for r in mixing.distribution(mixing.rates(sizes, weights={"big": 1.0, "small": 0.0}, total=1000.0)).collect()}
    assert set(cdf) == {"big"} and cdf["big"][0] == pytest.approx(1 - 1e-7, abs=1e-9)


def _record(n, payload, kind="response", refers=None, digest=None):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{n}>", "WARC-Date: 2024-01-01T00:00:00Z",
             *([f"WARC-Refers-To: <urn:uuid:{refers}>"] if refers else []), *([f"WARC-Payload-Digest: {digest}"] if digest else []), f"Content-Length: {len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def test_every_member_of_a_foreign_archive_is_read(spark):
    body = os.urandom(3 << 20)  # larger than a piece
    records = [_record("info", b"software: x", "warcinfo"), _record("1", body), _record("2", b"two"), _record("3", b"", "revisit", "2", "sha256:" + hashlib.sha256(b"two").hexdigest())]
    path = new_dir(spark, "foreign").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/a.warc.gz", "wb") as f:
        for r in records:
            f.write(gzip.compress(r))
    found = warc.read_archive(spark, path)
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {"urn:uuid:1", "urn:uuid:2", "urn:uuid:3"} and bytes(rows["urn:uuid:1"].payload) == body
    back = {r.id: bytes(r.payload) for r in warc.restore(found).collect()}
    assert back["urn:uuid:3"] == b"two"
    with open(f"{path}/a.warc.gz", "ab") as f:
        f.write(gzip.compress(records[2])[:-9])
    with pytest.raises(Exception, match="without its end"):
        warc.read_archive(spark, path).count()


def test_a_revisit_without_its_response_raises(spark):
    body = "b" * 200
    path = new_dir(spark, "lost")
    warc.write_archive(spark.createDataFrame([(1, "u", body), (2, "u", body)], "id long, u string, p string"), path, id_col="id", uri_col="u", payload_col="p")
    records = warc.read_archive(spark, path)
    head = {r.id: r.headers for r in records.collect()}
    assert all("WARC-Date: 1970-01-01T00:00:00Z\r\n" in h for h in head.values()) and "WARC-Profile: " in head["2"] and "WARC-Profile" not in head["1"]
    with pytest.raises(Exception, match="no response for revisit"):
        warc.restore(records.filter("record_type = 'revisit'")).collect()


def test_files_of_an_archive_are_bounded_by_bytes(spark):
    path = new_dir(spark, "bytes")
    pages = spark.range(300).select(F.col("id"), F.lit("u").alias("u"), F.repeat(F.col("id").cast("string"), 400).alias("p"))
    warc.write_archive(pages, path, id_col="id", uri_col="u", payload_col="p", file_bytes=40_000)
    sizes = [len(b"".join(warc.inflated(bytes(r.content)))) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).collect()]
    assert len(sizes) > 5 and max(sizes) < 200_000 and warc.read_archive(spark, path).count() == 300


def test_texts_that_share_an_id_are_documents_of_their_own(docs_of):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    docs = docs_of([a, b, a + " k", b, b, None, None, a], ids=[7, 7, 8, None, None, 9, 9, 7], extra=("_node", "_row"))
    kept = jaccard.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter("text IS NOT NULL").collect()) == [(7, a), (7, b)]
    assert kept.filter("text IS NULL").count() == 1
    orphans = docs_of([a, a, b], ids=[None, None, None])
    assert sorted(r.text for r in jaccard.survivors(orphans).collect()) == [a, b]


def test_evidence_passes_a_long_chain_and_graphs_stay_apart():
    n = 200
    same = np.log(np.array([[0.99, 0.01], [0.01, 0.99]]))
    unary = np.log(np.full((n, 2), 0.5))
    unary[0] = np.log([1e-6, 1 - 1e-6])
    edges = np.array([[k, k + 1] for k in range(n - 1)])
    tables = np.repeat(same[None], n - 1, axis=0)
    exact, p = [], np.array([1e-6, 1 - 1e-6])
    for _ in range(n):
        exact.append(p[1])
        p = p @ np.exp(same)
    alone = pii.marginals(unary, edges, tables)
    assert np.allclose(alone[:, 1], exact, atol=0.02) and alone[120, 1] > 0.53
    rng = np.random.default_rng(0)
    other = rng.normal(size=(50, 2))
    links = np.array([[a, b] for a in range(50) for b in range(a + 1, 50, 7)]) + n
    wild = rng.normal(size=(len(links), 2, 2)) * 4
    both = pii.marginals(np.concatenate([unary, other]), np.concatenate([edges, links]), np.concatenate([tables, wild]), np.array([0] * n + [1] * 50))
    assert np.array_equal(both[:n], alone)


def test_units_kept_by_an_encoder_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(encoder, "CACHE_BYTES", 20_000)
    enc = encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"unit{k * 50 + j}" for j in range(50)) for k in range(100)]
    for t in texts:
        assert enc.encode([t])[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(enc._units) < 300
    enc = encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    common = [f"common{j}" for j in range(20)]
    for t in texts:  # common units outlive the rare ones
        enc.encode([" ".join(common) + " " + " ".join(common) + " " + t])
        assert enc.encode([t + " end"])[0].tolist() == enc.tokenizer.encode(t + " end", add_special_tokens=False).ids
    assert all(u in enc._units for u in common[1:]) and enc._held <= 2 * 20_000


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 5000])
def test_wavelet_matrix_gives_back_its_ids(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    w = wavelet.WaveletMatrix(n, *wavelet.build(ids))
    assert w.decode().tolist() == ids.tolist()
    assert all(w.access(k) == ids[k] for k in range(0, n, 97)) and w.count(5) == int((ids == 5).sum())


def test_token_files_keep_the_order_of_mixing(spark, docs_of):
    docs = docs_of([f"text number {k}" for k in range(300)], extra=("mix_key", "_order"))
    docs = written(corpus_pipeline.mix_sources(spark, docs.withColumn("doc_id", F.col("doc_id") % 40), "unused"), "mixed")
    order = [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    ordered, name = corpus_pipeline.in_file_order(docs)
    path = new_dir(spark, "ordered")
    tokens.write_tokens(ordered, path, vocabulary=public_tokenizers.path("byte_bpe_50k.json"), order_col=name, shard_chars=3000)
    found = tokens.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == order and order != sorted(order) and len(order) > 200
    shards = tokens.read_shards(spark, path).count()
    assert shards > 3


def test_short_benchmark_items_delete_nothing(spark, docs_of, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, "yes"), (2, item), (3, None), (4, "New York City")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(["yes we can", "in New York City now", "so " + item.upper() + " end", None])
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_pipeline_runs_end_to_end(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < len(got) <= 2 * docs
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] != sorted(r.doc_id for r in got)


def test_quality_counts_discounts_once(spark, monkeypatch):
    from vigil.llm import quality
    sides, join_side = [], quality.join_side

    def seen(left, side, key, how="left"):
        sides.append(side._jdf.queryExecution().optimizedPlan().toString())
        return join_side(left, side, key, how)

    monkeypatch.setattr(quality, "join_side", seen)
    docs = spark.createDataFrame([(i, "ab cd ef %d" % i, "en" if i % 2 else None) for i in range(12)], "doc_id long, text string, lang string")
    assert quality.perplexity(docs, docs.select("doc_id").filter("doc_id < 9")).count() == 12
    assert len(sides) == quality.ORDER and not any("Aggregate" in p for p in sides)  # the joins read a written table
    grams, logs = quality._ascending(quality.pa.table({"gram": quality.pa.array([5, 1, 3]), "log": quality.pa.array([-0.5, -0.1, -0.3])}))
    assert grams.tolist() == [1, 3, 5] and logs.tolist() == [-0.1, -0.3, -0.5]
