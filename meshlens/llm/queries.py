"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, merge_dropout, packing, pii, shard, simhash, substring_dedup, toxicity, url_filter
from .common import table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
PII_KEY = "meshlens-demo-key"
TOXIC_FROM = 0.7


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), min_words=20, digest=True)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("trust", "distrust")


def held_out() -> F.Column:
    """Whether a row is held out of the labels; rows without an id are not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, labels.filter(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_shards(table(spark, sf_dir, "documents"), 40)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, bits=2)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), dropout=0.1, seed=20)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY, count_col="n_private").select("doc_id", "text", "n_private")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_url_filter, op3_toxicity, op4_minimax_shards, op5_simhash, op6_best_fit_packing, op7_nearest, op8_merge_dropout, op9_pii_pseudonyms, op10_exact_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
        win as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) s from d where len(ws) >= 20)),
        dup as (select doc_id, s from win qualify row_number() over (partition by k order by doc_id, s) > 1),
        cover as (select distinct doc_id, s + o p from dup, range(0, 20) t(o)),
        word as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) p from d),
        kept as (select word.doc_id, w, word.p from word anti join cover on word.doc_id = cover.doc_id and word.p = cover.p),
        joined as (select doc_id, count(*) n, string_agg(w, ' ' order by p) t from kept group by doc_id)
        select doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
        from d left join joined using (doc_id)""",
    "op2_url_filter": url_filter.oracle(URL_RULES),
    "op10_exact_dedup": """
        select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, sha256(t) text_sha256
        from (select doc_id, coalesce(text, '') t from documents) window g as (partition by t)""",
}
