"""The pipeline against a brute-force account of its stages, on small tables."""

import random

import pytest

import corpus_pipeline
from locusmill.llm.common import stored

from .helpers import duplicate_components, edge_rows, frame, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(r, 40)
    rows = edge_rows()
    docs = [(400 + i, prose(r, r.randint(60, 300)), *rows[0][2:]) for i in range(40)]
    docs += [(500, docs[3][1], *rows[0][2:]), (501, prose(r, 60) + " " + item + " " + prose(r, 60), *rows[0][2:])]
    frame(spark, [*rows, *docs]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect() if r["doc_id"] is not None)
    before, after = seen["near_duplicates"]
    want = duplicate_components({r["doc_id"]: r["text"] for r in before.collect() if r["doc_id"] is not None}, 5)
    assert ids(after) == sorted(i for i in want if want[i] == i) and 500 not in ids(after)
    before, after = seen["decontamination"]
    assert set(ids(before)) - set(ids(after)) == {501}
    before, after = seen["personal_data"]
    assert ids(before) == ids(after) and after.filter("text like '%<EMAIL>%'").count() == 1
    assert ids(seen["packing"][1].select("doc_id").distinct()) == ids(after)
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == seen["packing"][1].count()


def test_stages_on_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
