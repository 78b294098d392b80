"""The whole pipeline over odd rows: null, empty, repeated, extra columns, no rows."""

import random

import corpus_pipeline
import pytest

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, spans string"


def prose(i, n=80):
    return " ".join(random.Random(i).sample(WORDS, n))


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(
            f"{tmp_path}/labels.parquet")
        items = [(1, prose(50, 20)), (2, "w3"), (3, None), (None, "")]
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)
    return write


def test_odd_rows(spark, folder):
    rows = [(1, prose(1), "en", "s", 5), (2, prose(2), None, None, None), (2, prose(3), "de", "s", 1),
            (4, prose(1), "en", "t", 5), (5, None, "en", "s", 0), (6, "", "en", "s", 0), (None, None, None, None, None),
            (7, prose(7) + " " + prose(50, 20), "en", "s", 9), (8, prose(8) + "\npassword = hunter2222", "en", "s", 3),
            (9, prose(9), "en", "s", 1), (9, prose(9), "en", "s", 1), (None, prose(10), "", "s", 2)]
    out = corpus_pipeline.run(spark, folder(rows))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["round_trip"]) for r in out.collect())
    # 4 is a copy of 1, one of the rows 9 stays, 7 holds a passage, empty ones go; both rows 2 are texts of their own
    assert got == [(False, 0, True), (True, 1, True), (True, 2, True), (True, 2, True), (True, 8, True), (True, 9, True)]


def test_no_rows(spark, folder):
    out = corpus_pipeline.run(spark, folder([]))
    assert out.count() == 0 and {"doc_id", "ids"} <= set(out.columns)
