"""The registered queries of this package, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cxlens.llm.common import documents

#: Byte limit of a shard. Small, so that the small test tables need several shards too.
SHARD_BYTES = 1 << 20


#: Longest text, in tokens, that is not flagged as over the limit.
TOKEN_LIMIT = 512
SEQUENCE_TOKENS = 2048
#: Length of a passage that counts as repeated.
REPEAT_BYTES = 50
#: Documents ranked for each benchmark item.
TOP_DOCUMENTS = 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.simhash import near_duplicates
    return near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.token_counts import token_counts
    return token_counts(documents(spark, sf_dir), tokenizer_path(), TOKEN_LIMIT)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.bpe_codec import codec_report
    return codec_report(documents(spark, sf_dir), tokenizer_path())


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.sharding import shard_documents
    return shard_documents(documents(spark, sf_dir), SHARD_BYTES)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.packing import Capacity, pack
    return pack(documents(spark, sf_dir), tokenizer_path(), Capacity(SEQUENCE_TOKENS))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.warc import round_trip
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.suffix_dedup import removal_report
    return removal_report(documents(spark, sf_dir), depth=REPEAT_BYTES)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.embedding_dedup import near_duplicates
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), limit=0.95)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.quality import quality_report
    return quality_report(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.language_id import language_report
    return language_report(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.lexical import ranked_search
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=TOP_DOCUMENTS)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.merkle import tamper_report
    return tamper_report(documents(spark, sf_dir))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cxlens.llm.secrets import secret_report
    return secret_report(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_token_counts, op3_bpe_round_trip, op4_extendible_sharding, op5_best_fit_packing, op6_warc, op7_suffix_array_dedup, op8_embedding_near_dedup, op9_quality_rules, op10_language_id, op11_ranked_search, op12_merkle_manifest, op13_secret_scan,
)}
