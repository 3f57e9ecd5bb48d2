"""The registered queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm import oracles
from axonframe.llm.common import shared_dir
from axonframe.llm.fingerprints import compare_with_edits
from axonframe.llm.jaccard_join import JoinParams, jaccard_components
from axonframe.llm.licenses import scan_licenses
from axonframe.llm.merkle import verify_documents
from axonframe.llm.mixing import poisson_mix
from axonframe.llm.packing import pack
from axonframe.llm.prefix_trie import prefix_trie
from axonframe.llm.quality import quality_rules
from axonframe.llm.secret_scan import find_secrets, new_ledger
from axonframe.llm.token_output import read_token_files, write_token_files
from axonframe.llm.top_k import exact_top_k
from axonframe.llm.toxicity import score_toxicity
from axonframe.llm.warc import convert, read_warc, write_arc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_legacy_archives", oracles.ARCHIVES)
def op1_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    # Both header versions: odd pages in version 1 files, the others in version 2 files.
    odd = F.coalesce(F.pmod("page_id", F.lit(2)) == 1, F.lit(False))
    write_arc(pages.filter(odd), f"{arc}/v1", version=1)
    write_arc(pages.filter(~odd), f"{arc}/v2", version=2)
    convert(spark, f"{arc}/*", warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_bottom_k_fingerprints")
def op3_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


@query("op4_toxicity_trees")
def op4_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_blob_ledger_secrets", oracles.secrets())
def op5_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), new_ledger(spark))


@query("op6_metric_jaccard_join", oracles.components_of(4, 85))
def op6_metric_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), JoinParams(words=4, percent=85))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)


@query("op8_poisson_mixture", oracles.MIXTURE)
def op8_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


@query("op9_diagonal_licenses", oracles.licenses())
def op9_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op10_tokeniser_fertility")
def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return quality_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), second)


@query("op11_merkle_descent", oracles.merkle())
def op11_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", oracles.prefix_trie())
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_kd_tree_top_k", oracles.TOP_K)
def op13_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)
