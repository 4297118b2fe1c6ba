"""The pipeline's stages, each on what the one before kept, against plain versions."""

import importlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shardlight.llm import minhash, mixing, packing, quality, queries, shared

from .test_chat_mixing_packing import plain_mix
from .test_near_quality import components
from .test_repeats import without_repeats

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(shared.written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mix", "pack"]
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[1:-1])
    assert set(queries.QUERIES) == {f"op{n}_{x}" for n, x in enumerate(("chat_format", "repeats", "pack", "html_extract", "near_duplicates", "mix_sources", "quality", "fingerprints", "id_store", "nearest"), 1)}
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_quality_stage(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = rows_of(stages[0])
    p = quality.score_texts(pa.array([r["text"] for r in rows], pa.string()), model, model.dense())
    want = {r["doc_id"] for r, x in zip(rows, p, strict=True) if np.round(x, 9) >= 0.5}
    assert {r["doc_id"] for r in rows_of(stages[1])} == want and 0 < len(want) < len(rows)


def test_near_stage(stages):
    rows, plan = rows_of(stages[1]), minhash.Plan()
    sig, index = minhash.signatures(pa.array([r["text"] for r in rows]), plan.slots)
    ids = [rows[i]["doc_id"] for i in index]
    roots = components(ids, [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if (sig[a] != sig[b]).sum() <= plan.radius])
    assert {r["doc_id"] for r in rows_of(stages[2])} == {r["doc_id"] for r in rows if roots.get(r["doc_id"], r["doc_id"]) == r["doc_id"]}


def test_repeat_stage(stages):
    before, after = {r["doc_id"]: r["text"] for r in rows_of(stages[2])}, {r["doc_id"]: r for r in rows_of(stages[3])}
    want = without_repeats(before, 50)
    cut = 0
    for d, text in before.items():
        assert (after[d]["text"].split() if d in after else []) == want[d]
        cut += len(text.split()) - len(want[d])
        if d in after and len(want[d]) < len(text.split()):
            assert after[d]["n_chars"] == len(after[d]["text"])
    assert cut > 0


def test_mix_and_pack_stages(stages):
    rows = rows_of(stages[3])
    want = plain_mix([(r["doc_id"], r["source"], r["text"]) for r in rows], mixing.WEIGHTS, (0.8,))
    kept = rows_of(stages[4])
    assert sorted(r["doc_id"] for r in kept) == sorted(rows[i]["doc_id"] for i in want)
    assert Counter((r["doc_id"], r["length"]) for r in rows_of(stages[5])) == Counter((r["doc_id"], min(packing.CAPACITY, n - p)) for r in kept for n in [len(r["text"].split())] for p in range(0, n, packing.CAPACITY))


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r["doc_id"], r["part"], r["length"])
    assert sorted(map(key, rows_of(pipeline.run(spark, SF)))) == sorted(map(key, rows_of(stages[-1])))
    assert pipeline.ORACLE_SQL is None


def test_stages_on_an_empty_table_and_on_nulls(spark, stages):
    empty = stages[0].where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0), (None, "text " * 20, None, None, 1), (3, "text " * 20, "de", None, 1), (3, "text " * 20, "de", None, 1)], stages[0].schema)
    for _, stage in pipeline.STAGES:
        stage(spark, odd, SF).collect()
