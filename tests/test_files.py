"""Arrow IPC files, the validating Parquet sink, and whole samples of tokens."""

import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from memloom.operators import samples
from memloom.sources import arrow_files, sinks

SCHEMA = "id long, ids array<int>, mask array<tinyint>, spans array<struct<s:int,e:int>>, t string"


def some_rows(n=1500):
    return [(k, None if k % 7 == 0 else list(range(k % 5)), [k % 2] * (k % 3), [(k, k + 1)] if k % 4 else [], None if k % 11 == 0 else "é" * (k % 6)) for k in range(n)]


def key(row):
    return json.dumps([row.id, row.ids, row.mask, [tuple(x) for x in row.spans or []], row.t])


def test_arrow_round_trip(spark, tmp_path):
    rows, path = spark.createDataFrame(some_rows(), SCHEMA).repartition(3), str(tmp_path / "a")
    assert arrow_files.write_arrow(rows, path, "ids") == (sum(r[1] is not None for r in some_rows()), sum(r[1] is None for r in some_rows()))
    back = arrow_files.read_arrow(spark, path)
    assert [f.dataType for f in back.schema.fields] == [f.dataType for f in rows.schema.fields]
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.where("ids is not null").collect()))
    for name in arrow_files.files(path):
        held = pa.ipc.open_file(name)
        sizes = [held.get_batch(k).num_rows for k in range(held.num_record_batches)]
        assert max(sizes) <= arrow_files.ROWS and all(n == arrow_files.ROWS for n in sizes[:-1])
    assert arrow_files.read_arrow(spark, path, "t string, id long").where("id = 5").collect()[0].t == "é" * 5
    assert arrow_files.write_arrow(rows.limit(3), f"file://{path}") == (3, 0) and arrow_files.read_arrow(spark, f"file://{path}").count() == 3  # in place of the old ones
    one = arrow_files.files(path)[0]
    assert arrow_files.read_arrow(spark, one).count() <= 3
    assert arrow_files.write_arrow(rows.limit(0), str(tmp_path / "none")) == (0, 0)
    with pytest.raises(Exception, match="no Arrow files"):
        arrow_files.read_arrow(spark, str(tmp_path / "none")).count()
    assert arrow_files.read_arrow(spark, str(tmp_path / "none"), "id long").count() == 0


def test_a_task_is_handed_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    seen, save = [], DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *args: (seen.append(int(spark.conf.get(arrow_files.BATCH_ROWS))), save(self, *args))[1])
    before = spark.conf.get(arrow_files.BATCH_ROWS)
    assert arrow_files.write_arrow(spark.range(1000).coalesce(1), str(tmp_path / "a")) == (1000, 0)
    assert seen == [arrow_files.ROWS] and spark.conf.get(arrow_files.BATCH_ROWS) == before
    with pytest.raises(Exception, match="lost"):
        arrow_files.write_arrow(spark.range(1000).withColumn("x", F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))), str(tmp_path / "a"))
    assert spark.conf.get(arrow_files.BATCH_ROWS) == before


def test_a_scan_is_many_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    arrow_files.write_arrow(spark.createDataFrame(some_rows(), SCHEMA).coalesce(1), path)
    monkeypatch.setattr(arrow_files, "BATCHES", 3)
    reader = arrow_files.Reader(path, spark.createDataFrame([], "t string, id long").schema)
    slices = reader.partitions()
    assert len(slices) == 3 and sorted(x for s in slices for b in reader.read(s) for x in b.column(1).to_pylist()) == list(range(1500))
    assert all(b.schema.names == ["t", "id"] for s in slices for b in reader.read(s))


def test_a_task_that_dies_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(1000).repartition(4)
    arrow_files.write_arrow(rows, path)
    before = sorted(os.listdir(path))
    broken = rows.withColumn("x", F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        arrow_files.write_arrow(broken, path)
    assert sorted(os.listdir(path)) == before and arrow_files.read_arrow(spark, path).count() == 1000
    writer = arrow_files.Writer(path, None, False)
    with open(f"{path}/_{writer.job}-00000-left", "wb") as f:
        f.write(b"half a file")
    writer.commit([None])
    assert not [x for x in os.listdir(path) if x.startswith(f"_{writer.job}")] and arrow_files.read_arrow(spark, path).count() == 1000


# ---- the validating sink


def test_first_violation_is_found_by_its_number(spark, tmp_path):
    rows = spark.createDataFrame([(k * 10, "" if k in (700, 41, 43) else "x") for k in range(1000)], "at long, t string").repartition(5)
    rule = F.when(F.col("t") == "", F.concat(F.lit("empty at "), F.col("at").cast("string")))
    assert sinks.first_violation(rows, rule, "at") == (42, "empty at 410") and sinks.first_violation(rows.where("t <> ''"), rule, "at") is None
    with pytest.raises(ValueError, match="row 42: empty at 410"):
        sinks.write_rows(rows, str(tmp_path / "p"), rule, "at")
    assert not os.path.exists(tmp_path / "p")
    assert sinks.write_rows(rows.where("t <> ''"), str(tmp_path / "p"), rule, "at") == 997


def test_schema_of_the_first_batch_holds(spark, tmp_path):
    path = str(tmp_path / "p")
    first = spark.createDataFrame([("a", ["d", None], [("q", ["x"])], {"k": 1}, 5)], "id string, memory_docs array<string>, qa array<struct<question:string,answer:array<string>>>, meta map<string,int>, n int")
    assert sinks.write_rows(first, path) == 1
    later = spark.createDataFrame([("6", 7), ("8", None)], "n string, id long")
    assert sinks.write_rows(later, path) == 2
    back = sinks.read_rows(spark, path, qa="array<struct<question:string,answer:array<string>>>", meta="map<string,int>")
    assert [f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields] == ["string", "array<string>", "string", "string", "int"]
    got = {r.n: r for r in back.collect()}
    assert got[5].qa[0].answer == ["x"] and got[5].meta == {"k": 1} and got[5].memory_docs == ["d", None]
    assert got[6].id == "7" and got[6].qa is None and got[8].id is None
    with pytest.raises(ValueError, match="not in the stored rows: other"):
        sinks.write_rows(spark.createDataFrame([(1,)], "other int"), path)
    with pytest.raises(Exception, match="cast|CAST"):
        sinks.write_rows(spark.createDataFrame([("x",)], "n string"), path)
    assert spark.read.parquet(path).count() == 3


def test_row_groups_and_the_placeholder(spark, tmp_path):
    path = str(tmp_path / "p")
    assert sinks.write_rows(spark.createDataFrame([], "a int"), path) == 0
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 0
    rows = spark.range(2500).select("id", F.lit(None).cast("array<string>").alias("memory_docs")).coalesce(1)
    assert sinks.write_rows(rows, path) == 2500 and spark.read.parquet(path).count() == 2500  # in place of the placeholder
    name = next(x for x in os.listdir(path) if x.endswith(".parquet"))
    meta = pq.ParquetFile(f"{path}/{name}").metadata
    assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= sinks.BATCH and meta.num_row_groups == 3
    assert sinks.write_rows(rows.limit(0), path) == 0 and spark.read.parquet(path).count() == 2500
    assert sinks.read_rows(spark, path).first().memory_docs == []


# ---- samples


def sample_by_hand(docs, prompt, answer, mode, size, limit, opener, joints):
    chunks, tail = [], prompt + answer
    if mode == "unit":
        for a in range(0, len(docs), size):
            ids = list(opener) if a == 0 else []
            for k, d in enumerate(docs[a : a + size]):
                ids += (joints[0] if k else []) + d
            step = limit // 2 if 0 < limit < len(ids) else max(1, len(ids))
            chunks += [ids[j : j + step] for j in range(0, max(1, len(ids)), step)]
        tails, chunks = [len(chunks)], [*chunks, tail]
    else:
        memory = list(opener)
        for k, d in enumerate(docs):
            memory += (joints[1] if k else []) + d
        whole = memory + tail
        chunks = [whole[j : j + size] for j in range(0, len(whole), size)]
        tails = list(range(len(memory) // size, len(chunks)))
    ids, spans, at = [x for c in chunks for x in c], [], 0
    for c in chunks:
        spans.append((at, at + len(c)))
        at += len(c)
    mask = [0] * (len(ids) - len(answer)) + [1] * len(answer)
    return (ids, mask, spans, tails) if len(ids) <= samples.MAX_LEN else None


def test_samples_of_tokens(spark):
    rng, cases = random.Random(3), []
    for k in range(120):
        docs = [[rng.randint(1, 99) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(0 if k % 2 else 1, 9))]
        cases.append((k, docs, [1, 2, 3][: rng.randint(1, 3)], [7] * rng.randint(1, 40), "token" if k % 2 else "unit", rng.randint(1, 20), rng.choice([-1, 10, 25])))
    cases.append((999, [[5] * 128_000], [1], [2], "unit", 3, -1))
    opener, joints = [900, 901], ([910], [911, 912, 913])
    frame = spark.createDataFrame(cases, "k int, docs array<array<int>>, prompt array<int>, answer array<int>, mode string, size int, cap int")
    made = samples.assembled(F.col("docs"), F.col("prompt"), F.col("answer"), F.col("mode"), F.col("size"), F.col("cap"), F.lit(8), opener, joints)
    rows = frame.select("k", "cap", made.alias("sample"))
    for r in rows.collect():
        expected = sample_by_hand(*next(c[1:] for c in cases if c[0] == r.k), opener, joints)
        if expected is None:
            assert r.k == 999 and r.sample is None
            continue
        s = r.sample
        assert (s.input_ids, s.loss_mask, [tuple(x) for x in s.chunk_spans], s.qa_chunk_idx) == expected
        assert (s.chunk_limit, s.token_limit) == (8, r.cap) and s.meta.asDict() == {"n_chunks": len(expected[2]), "total_len": len(expected[0]), "n_qa_chunks": len(expected[3])}
    ids = {r.k: r.id for r in samples.numbered(rows, "k", "set", "single_sft").collect()}
    assert ids == {k: f"set-single_sft-{k}" for k in range(120)}
