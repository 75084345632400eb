"""One query per operator with its contract's columns, over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import (
    bpe,
    collocations,
    decontaminate,
    html_text,
    licenses,
    minhash,
    mixture,
    oracles,
    quality,
    secrets,
    spelling,
    suffix_dedup,
    topk,
    toxicity,
)
from emberwatch.llm.common import Query, table
from emberwatch.session import written

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op2_topk": oracles.TOPK,
    "op4_minhash": oracles.MINHASH,
    "op7_decontamination": oracles.DECONTAMINATION,
    "op11_collocations": oracles.COLLOCATIONS,
    "op12_mixture": oracles.MIXTURE,
    "op13_spelling": oracles.SPELLING,
}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_spec(name: str = "word_bpe_49k.json") -> str:
    """JSON text of an installed public tokenizer (a fixed few megabytes)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@register
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.is_held_out("doc_id", 5, 0)
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scores = toxicity.scored(docs, toxicity.trained(docs, labels))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.searched(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


@register
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@register
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.grouped(table(spark, sf_dir, "documents")).drop("text_key")


@register
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("spans")


@register
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.is_held_out("doc_id", 3, 1)
    labels = table(spark, sf_dir, "labels").where(~held_out)
    values = written(quality.described(table(spark, sf_dir, "documents")), "quality")
    scores = quality.scored(values, quality.fitted(values, labels))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), tokenizer_spec())


@register
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@register
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register
def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixture.scheduled(table(spark, sf_dir, "documents"))
    position = F.try_element_at("places", F.lit(1))["position"]
    rows = planned.select("doc_id", "size", "source_size", "target", mixture.taken().alias("taken"), position.alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


@register
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))
