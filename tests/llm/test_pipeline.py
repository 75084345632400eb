"""The pipeline against its stages written plainly, and the registered queries' columns."""

import duckdb
import pytest
from check_oracle import TABLES, compare

import corpus_pipeline
from emberwatch.llm import bpe, queries, secrets, toxicity
from test_operators import plain_components, plain_hits

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.is_held_out("doc_id", 5, 0))
    model = toxicity.trained(docs, labels)
    good = {r["doc_id"] for r in toxicity.scored(docs, model).where("score < 0.5").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    texts = {i: texts[i] for i, _, c, _ in plain_components(texts) if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: texts[i] for i, _, hits, _ in plain_hits(list(texts.items()), items) if not hits}
    novelty, encoder = secrets.Novelty(), bpe.Encoder(queries.tokenizer_spec())
    want = {}
    for i, t in texts.items():
        done = 0
        out = ""
        for start, end, _ in secrets.spans_of(t.encode(), novelty):
            out += (t[done:start] + "[SECRET]") if start > done or not out else ""
            done = max(done, end)
        want[i] = encoder.encode(out + t[done:])[0]
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(got, con.execute(queries.ORACLES[name]).df()) == "ok"
