"""The operators over their whole tables, with the parameters of production, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratacube.llm import bpe, decontam, fingerprints, langid, line_dedup, minhash, pii, secret_scan, token_counts, warc
from stratacube.llm.common import table

#: The tokenizer file of the token operators; another may be given by name.
TOKENIZER = "word_bpe_49k.json"
#: The setting that holds the pseudonyms' key, and the key for the test tables where it is unset.
KEY_CONF, TEST_KEY = "spark.stratacube.pseudonyms.key", "only for the synthetic test tables"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. As langid.identify(): null and letterless texts are und; repeated rows repeat; an empty table is empty."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts. As fingerprints.fingerprint(): a null text is empty, ids and repeats as there."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents. As secret_scan.scan(): null and empty texts have none; repeated rows repeat."""
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and counts by kind. As pii.pseudonymise(): a null text stays null; repeated rows repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, spark.conf.get(KEY_CONF, None) or TEST_KEY).select("doc_id", "text", "_pii.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without boilerplate lines of their source. As line_dedup.drop_lines(): a null text or source loses nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "_dedup.n_lines", "_dedup.n_dropped", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back through the index. As warc.archive(): a null body is an empty payload; pages have no time."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents. As token_counts.count_tokens(): a null text has none; repeated rows repeat."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents. As minhash.near_duplicates(): wordless texts are linked with nothing; repeated ids share a node."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded. As bpe.encode_digests(): a null text has no ids; repeated rows repeat."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents. As decontam.scan(): null texts have no words, null items are left out."""
    return decontam.digests(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_fingerprints": op2_fingerprints,
    "op3_secret_scan": op3_secret_scan,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_minhash": op8_minhash,
    "op9_bpe": op9_bpe,
    "op10_decontam": op10_decontam,
}

ORACLE: dict[str, str] = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_minhash": minhash.ORACLE,
    "op10_decontam": decontam.ORACLE,
}
