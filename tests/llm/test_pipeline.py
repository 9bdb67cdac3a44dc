import random

import corpus_pipeline
import pytest
from test_near_duplicates import shingle_set

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for _, function in corpus_pipeline.STAGES:
        rows = function(spark, docs, FOLDER)
        if out is not None and rows.columns == docs.columns:
            docs = spark.createDataFrame(rows.collect(), rows.schema)
        else:
            docs = rows
        out.append(docs.collect())
    return out


def test_names_and_columns(spark, kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    for rows in kept[1:5]:
        assert list(rows[0].asDict()) == list(kept[0][0].asDict())
    assert [len(rows) for rows in kept[:5]] == sorted((len(rows) for rows in kept[:5]), reverse=True)


def test_good_documents_stay(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[1]}
    long = {r.doc_id for r in kept[0] if len((r.text or "").split()) >= 20}
    good = [d for d, quality in labels.items() if quality == 1 and d in long]
    assert sum(d in left for d in good) >= 0.97 * len(good)


def test_no_line_twice(kept):
    lines = [x for r in kept[2] for x in r.text.split("\n") if len(x) >= 24]
    assert len(lines) == len(set(lines))
    assert all(r.n_chars == len(r.text) for r in kept[2])


def test_no_two_alike(kept):
    sets = [shingle_set(r.text) for r in kept[3]]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert 100 * len(a & b) < 80 * len(a | b)


def test_run_gives_packed_sequences(spark, kept):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept[5])
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept[4]}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 4096
