"""The pipeline's stages on the smallest table: each decision against brute force, rows and columns kept."""

import re

import pytest

import corpus_pipeline as pipeline
from memloom.llm.base import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), name))
    return docs


def test_columns(stages):
    for docs in stages[1:5]:
        assert docs.columns == stages[0].columns
    counts = [docs.count() for docs in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2


def test_toxicity_decides_by_the_score(spark, stages):
    from memloom.llm import toxicity
    from memloom.llm.learn import labelled

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(*labelled(stages[0], labels, "toxic", toxicity.DIVISOR, toxicity.REST))
    scores = {r.doc_id: r.score for r in toxicity.score(stages[0], model).collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {i for i, x in scores.items() if x < 0.5} and len(kept) < len(scores)


def test_rows_without_ids_and_empty_tables(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(20))
    words = item.split()
    edited = " ".join([*words[:5], "other", *words[6:12], *words[13:]])
    texts = [(1, "clean text"), (None, f"before {item} after"), (2, f"x {edited} y"), (3, None), (None, "no id but clean"), (4, "")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = pipeline.drop_leaks(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns and sorted(str(r.text) for r in kept.collect()) == ["", "None", "clean text", "no id but clean"]
    for part in (rows, rows.limit(0)):
        docs = part
        for name, stage in pipeline.STAGES[1:]:
            docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == (4 if part is rows else 0)


def test_run_leaves_one_table(spark, stages):
    import glob

    from memloom.llm import base

    top = base.shared_dir(spark, "x").rsplit("/", 1)[0]
    there = lambda: set(glob.glob(f"{top.removeprefix('file:')}/*"))
    before = there()
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages[5].collect())
    assert len(there() - before) == 1


def test_runs_have_tables_of_their_own(spark):
    import os
    import threading

    from memloom.llm.base import Run

    rows, there = spark.range(3), lambda path: os.path.exists(path.removeprefix("file:"))
    with Run(spark) as one:
        written(rows, "a")

        def other():
            with Run(spark) as two:
                written(rows, "b")
                written(rows, "c")
                two.drop()
                assert [there(p) for p in two.tables] == [True]

        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert len(one.tables) == 1 and there(one.tables[0])
    with pytest.raises(ValueError, match="stops"), Run(spark) as failed:
        written(rows, "d")
        path = failed.tables[0]
        raise ValueError("stops")
    assert not there(path) and there(one.tables[0])


def test_near_duplicates(stages):
    from test_operators import groups

    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {i for i, (_, c) in groups(before, 5).items() if c == i}


def test_passages(stages):
    from test_operators import cut

    expected = cut([(r.doc_id, r.text) for r in stages[2].collect()], 50)
    for row in stages[3].collect():
        assert WORD.findall(row.text) == expected[row.doc_id][2].split() and row.n_chars == len(row.text)


def test_leaks(spark, stages):
    items = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [" " + " ".join(x) + " " for x in items]
    for row in stages[4].collect():
        text = " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", row.text.lower())) + " "
        assert not any(item in text for item in items)


def test_tokens(stages):
    rows = stages[5].collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in rows) and {r.doc_id for r in rows} == {r.doc_id for r in stages[4].collect()}
