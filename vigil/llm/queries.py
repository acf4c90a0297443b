"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import covering, decontaminate, jaccard, langid, mixing, periodic, phrases, pii, quality, simhash, sql, tokens, urlfilter, warc
from vigil.llm.common import new_dir, table, written

#: Words that put a page's url on the block list of the query.
ABUSE_TERMS = ("trash", "scum", "pathetic", "loser")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))), id_col="doc_id", text_col="text", lang_col="lang")
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and whether its language's quantiles accept it."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    found = quality.judge(quality.perplexity(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted))
    return found.select(F.col("id").alias("doc_id"), "lang", "n_bytes", "perplexity", "low", "high", "keep")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; for ids divisible by 20, the rows within 13 bits (README: recall)."""
    found = written(simhash.compare(table(spark, sf_dir, "documents")), "op3-fingerprints")
    return simhash.with_near(found, every=20, radius=13)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to square-root source weights, globally shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents"), alpha=0.5, seed=17)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page: the contract's rules, else the list of canonical urls of pages that hold an abuse term."""
    pages = table(spark, sf_dir, "pages")
    abusive = F.lit(False)
    for term in ABUSE_TERMS:
        abusive = abusive | F.col("html").contains(f" {term} ")
    listed = pages.filter(abusive).select(urlfilter.canonical(F.col("url")).alias("url"))
    return urlfilter.judge(pages, listed)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document into wavelet-matrix shards, read the files back, and describe each document's ids."""
    import public_tokenizers
    path = new_dir(spark, "op6-tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary=public_tokenizers.path("byte_bpe_50k.json"), end_id=0, added_tokens=True)
    return tokens.read_documents(spark, path)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of ten-word benchmark windows in every document."""
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.summary(found)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a similarity of 0.9 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the files back, and describe the restored records."""
    path = new_dir(spark, "op9-warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, id_col="page_id", uri_col="url", payload_col="html", min_bytes=100)
    stored = warc.read_archive(spark, path).select("id", "record_type", "refers_to", "payload_digest", "payload_bytes")
    return warc.restore(stored, ("payload_bytes",)).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data in every document, and those that the skip-chain field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language, of phrases of two to four words that occur 30 times or more."""
    return phrases.collocations(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, after the contract's rewriting of a tenth of them."""
    return periodic.digest(table(spark, sf_dir, "documents"), rewrite=periodic.repeated_tail)


def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 64-bit fingerprints differ in two bits or fewer."""
    return covering.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_quality, op3_simhash, op4_mix_sources, op5_url_filter, op6_token_files, op7_decontaminate, op8_jaccard_join, op9_warc_archive, op10_pii,
                                    op11_collocations, op12_periodic_runs, op13_covering_simhash)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
