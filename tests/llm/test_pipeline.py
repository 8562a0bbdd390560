"""The pipeline's stages one by one against their contracts, and the entry points."""

import collections
import pathlib
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stackscope.llm import secrets

sys.path.insert(0, str(pathlib.Path(__file__).parent))
from test_contracts import brute_components, brute_scan, brute_secrets  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test data")


def test_registered():
    q = entry.queries()
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in q)] == list(range(1, 11)) and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert {r[0] for r in out.select("doc_id").collect()} == {i for i, _ in before}
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            gone = {i for i, _ in before} - set(after)
            assert sum(toxic.get(i) == 0 for i in gone) == 0
        elif name == "near_duplicates":
            want = brute_components(before, 5, 80)
            assert set(after) == {i for i, c in want.items() if i == c}
        elif name == "decontamination":
            assert set(after) == {i for i, t in before if not brute_scan(t, bench)[-1]}
        else:
            assert set(after) == {i for i, _ in before} and not any(brute_secrets(t) for t in after.values())
            keys = secrets.automaton()
            assert all(after[i] == secrets.hide(t, keys, "[secret]") for i, t in before)
        docs = out


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    at = collections.Counter()
    for r in rows:
        at[r.sequence_id] += r.length
    assert rows and max(at.values()) <= 2048
