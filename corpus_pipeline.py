"""From raw documents to training tokens, stage by stage.

``STAGES`` names the stages in order.  Each takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next stage's documents:

1. toxicity: documents scored 0.5 or more are dropped; the model learns from the labelled rows
   of ``documents`` that the operator's own query learns from.
2. near_duplicates: one document of every near-duplicate group stays.
3. decontamination: documents holding a benchmark window are dropped.
4. secrets: secrets are cut out of the texts; every document stays.
5. bpe: texts become token ids.

Stages 1 to 4 return the columns of ``documents``.  Null texts count as empty and stay, repeated
rows leave with their group in stage 2, and empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberwatch.llm import bpe, decontaminate, minhash, secrets, toxicity
from emberwatch.llm.common import table, with_package
from emberwatch.llm.queries import tokenizer_spec
from emberwatch.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.is_held_out("doc_id", 5, 0))
    return toxicity.clean(docs, toxicity.trained(table(spark, sf_dir, "documents"), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package(spark)
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package(spark)
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package(spark)
    return bpe.encoded_digests(docs, tokenizer_spec())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", cut_secrets),
    ("bpe", encode),
]
#: The first stage is a trained model, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
