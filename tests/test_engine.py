"""The engine's queries against DuckDB on the smallest tables, and the documented edge cases."""

import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from memloom.functions import extract, judge, rules, spans, text
from memloom.operators import matrix, regroup, sequential
from memloom.plans import adapted, corpus, outputs, pieces, scoring, spans_and_prompts, stateful, streams, training  # noqa: F401
from memloom.plans.registry import ORACLE, QUERIES, TABLES
from memloom.sources import adapters, io
from memloom.streaming import folds

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted(tuple(plain(r[names.index(c)]) for c in got.columns) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    got = row.select(F.explode(F.array(F.struct(column.alias("v")))).alias("x")).first()[0]["v"]
    return got.asDict(recursive=True) if hasattr(got, "asDict") else [x.asDict() if hasattr(x, "asDict") else x for x in got] if isinstance(got, list) else got


@pytest.mark.parametrize(
    ("output", "answers"),
    [("```textA1: k```", {1: "k"}), ("```text\nA1: a\nA2: b\nA1: c\n```", {1: "c", 2: "b"}), ("x\rA1: no", None), ("```text\nA1: a\n b\nA2:\n", {1: "a\n b", 2: ""}), ("```text\nx\n``` ```text\nA3: z\n```", {3: "z"})],
)
def test_numbered_answers(spark, output, answers):
    assert value(spark, extract.numbered_answers(F.col("o")), o=output) == answers


def test_single_answers(spark):
    assert value(spark, extract.single_answer(F.col("o")), o="```text\n only this \n```") == "only this"
    assert value(spark, extract.raw_answer(F.col("o")), o=" Answer： x") == "x"
    found = value(spark, extract.extracted(F.col("o"), "single", F.lit(1)), o="  free text ")
    assert (found["answers"], found["has_block"], found["n_found"], found["format_ok"]) == ({1: "free text"}, False, 1, False)
    assert value(spark, extract.extracted(F.col("o"), "official_pack", F.lit(2)), o="A1: x\n a2. y\n")["format_ok"] is True


def test_judges(spark):
    assert value(spark, text.normalize(F.col("t")), t="The U.S.A., an  apple") == "usa apple"
    assert value(spark, judge.exact(F.array(F.lit("")), F.lit(""))) is False
    assert value(spark, judge.contained(F.array(F.lit("")), F.lit("x"))) is False
    assert value(spark, judge.needles(F.array(*map(F.lit, "abcd")), F.lit("b"))) == 0.25
    assert value(spark, judge.category_f1(F.lit(2), F.array(F.lit("")), F.lit("x"))) == 0.0
    assert value(spark, judge.comma_f1(F.lit("red, blue"), F.lit("blue, green"))) == 0.5
    assert value(spark, judge.recall_at(F.array(F.lit("Up (2009)"), F.lit("Big")), F.lit("1. Up | 2. Heat"), 5)) == 0.5
    assert value(spark, judge.token_f1(F.array(F.lit("a red red car")), F.lit("red car and car"))) == pytest.approx(2 * 2 / 6)


def test_rouge_and_similar_titles(spark):
    rows = spark.createDataFrame([(["the cat sat"], "cat sat down"), ([], "x"), (["abc"], "")], "g array<string>, p string")
    assert [r[0] for r in rows.select(judge.rouge_l("g", "p")).collect()] == [pytest.approx(2 / 3), 0.0, 0.0]
    assert spark.range(1).select(judge.similar_share(F.array(F.lit("the godfather")), F.array(F.lit("the godfathr")))).first()[0] == 1.0


@pytest.mark.parametrize(("n", "number"), [(767, None), (768, 1), (1791, 1), (1792, 2), (7680, 3), (61439, 5), (61440, None)])
def test_buckets(spark, n, number):
    assert value(spark, rules.bucket(F.lit(n))) == number


def test_rules(spark):
    assert value(spark, rules.resolved(F.lit(10)))["window"] == 512 and value(spark, rules.resolved(F.lit(10**6)))["window"] == 8192
    assert [value(spark, rules.block_budget(F.lit(n), h)) for n, h in ((0, 16384), (100, 16384), (100, 8192))] == [2048, 16384, 8192]
    assert [value(spark, rules.neighbours_wanted(F.lit(n))) for n in (20, 21)] == [1, 3]
    assert value(spark, rules.clip(F.col("t"), 40), t="x" * 30 + "y" * 30) == "x" * 10 + "y" * 30
    assert value(spark, rules.clip(F.col("t"), 40), t="short") == "short"


def test_schedule(spark):
    lengths = F.array(*map(F.lit, (3, 5, 5, 5, 2, 9)))
    assert value(spark, spans.evict_schedule(lengths, F.lit(1 << 30), F.lit(14), F.lit(1))) == [6, 3, 4, 5, 6, 6]
    assert value(spark, spans.evict_schedule(lengths, F.lit(2), F.lit(-1), F.lit(1))) == [6, 3, 4, 5, 6, 6]


def test_marked_spans(spark):
    ids = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.when(i.isin(0, 9, 19, 27), 5).otherwise(1))
    assert [(x["s"], x["e"]) for x in value(spark, spans.marked_spans(ids, 5, 1000))] == [(0, 9), (9, 19), (19, 27), (27, 30)]


def simulate(lengths, most, tokens, sinks):
    held, out = [], [len(lengths)] * len(lengths)
    for i in range(len(lengths)):
        held.append(i)
        while len([j for j in held if j >= sinks]) > 1 and (sum(j >= sinks for j in held) > most or tokens > 0 and sum(lengths[j] for j in held) > tokens):
            oldest = next(j for j in held if j >= sinks)
            out[oldest] = i
            held.remove(oldest)
    return out


def test_schedule_is_the_simulation(spark):
    import random

    rng = random.Random(4)
    cases = [([rng.randint(1, 9) for _ in range(rng.randint(1, 12))], rng.randint(1, 5), rng.choice([-1, 8, 15, 30]), rng.randint(0, 2)) for _ in range(150)]
    rows = spark.createDataFrame(cases, "n array<int>, most int, tokens int, sinks int")
    for (lengths, most, tokens, sinks), row in zip(cases, rows.select(spans.evict_schedule(F.col("n"), F.col("most"), F.col("tokens"), F.col("sinks"))).collect()):
        assert row[0] == simulate(lengths, most, tokens, sinks)


def test_packs_and_splits(spark):
    rows = spark.createDataFrame([("a", [str(k) for k in range(23)]), ("b", ["x"])], "id string, qa array<string>")
    assert sorted((r.id, len(r.qa)) for r in regroup.split_packs(rows, 10).collect()) == [("a#pack0", 10), ("a#pack1", 10), ("a#pack2", 3), ("b", 1)]
    rows = spark.createDataFrame([(1, 0, ["a", "b", "c"], [1]), (1, 1, ["d", "e"], [0])], "pack int, pos int, docs array<string>, evidence array<int>")
    assert regroup.pack_with_offsets(rows, "pack", "pos").first().evidence == [1, 3]
    index = regroup.dense_index(spark.createDataFrame([(7,), (100000,), (8,)], "k long"), "k").collect()
    assert sorted((r.k, r.idx) for r in index) == [(7, 0), (8, 1), (100000, 2)]


def test_bins_hold_and_cover(spark):
    rows = spark.range(300).select(F.col("id").alias("idx"), (F.col("id") * 37 % 120 + 1).alias("n"))
    packs = sequential.bin_packs(rows, 100).toPandas()
    assert packs.groupby("pack").n.sum().max() <= 100 and len(packs) == rows.where("n <= 100").count() and packs.idx.is_unique


def two_ends(sizes, target):
    """The members of packs: the largest left opens one, the smallest left fill it."""
    left, packs = sorted((n, -i) for i, n in sizes if n <= target), []
    while left:
        packs.append([left.pop()])
        while left and sum(n for n, _ in packs[-1]) + left[0][0] <= target:
            packs[-1].append(left.pop(0))
    return [{-i for _, i in p} for p in packs]


def test_packs_are_those_of_two_ends(spark):
    import random

    rng = random.Random(3)
    for target in (1, 20, 100):
        sizes = [(i, rng.choice([0, 1, 5, 20, 21, 33, 60, 100])) for i in rng.sample(range(10**6), 150)]
        found = sequential.bin_packs(spark.createDataFrame(sizes, "idx long, n long").repartition(3), target).collect()
        packs = {}
        for r in found:
            packs.setdefault(r.pack, set()).add(r.idx)
        assert [packs[k] for k in range(len(packs))] == two_ends(sizes, target)
    assert sequential.bin_packs(spark.createDataFrame([], "idx long, n long"), 5).count() == 0


def test_steps_are_balanced(spark, monkeypatch):
    import random

    rng = random.Random(4)
    monkeypatch.setattr(regroup, "RANGE_ROWS", 100)
    for weights, per in (([rng.randint(1, 50) for _ in range(1003)], 8), ([7] * 500, 10), ([10**9, *[1] * 63], 8), ([3] * 5, 8)):
        rows = spark.createDataFrame([(k * 10**12, w) for k, w in enumerate(weights)], "pack long, weight long").repartition(4)
        found = sequential.balanced_steps(rows, per, 2).toPandas()
        assert len(found) == len(weights) // per * per and found.pack.is_unique
        sums = found.groupby("step").weight.sum()
        assert (found.groupby("step").size() == per).all() and set(found.step) == set(range(len(weights) // per))
        assert all(sorted(x) == list(range(per)) for _, x in found.groupby("step").slot)
        if len(sums):
            assert sums.max() - sums.min() <= max(weights) - min(weights)
    first = {frozenset(x) for _, x in sequential.balanced_steps(rows, 2, 2).toPandas().groupby("step").pack}
    assert len({tuple(sorted(r.pack for r in sequential.balanced_steps(rows, 2, seed).collect())) for seed in range(12)}) > 1 and first  # which packs go is drawn


def test_steps_of_many_packs_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(regroup, "RANGE_ROWS", 500)
    rows = spark.range(20_000).select(F.col("id").alias("pack"), F.lit(5).alias("weight"))
    drawn = rows.withColumn("at", -(F.col("weight") + F.rand(1)))
    sizes = drawn.select(regroup.range_of(drawn, "at").alias("r")).groupBy("r").count().collect()
    assert len(sizes) == 40 and max(r["count"] for r in sizes) < 1000


def test_pieces_keep_the_text(spark):
    pieces = ["aa", "bbb", "c" * 25, "d", "ee"]
    assert value(spark, sequential.pack_pieces(F.array(*map(F.lit, pieces)), 10)) == ["aa\nbbb", "c" * 10, "c" * 10, "c" * 5, "d\nee"]


def test_matrix(spark):
    counts = {r.model: r["count"] for r in matrix.runs(spark).groupBy("model").count().collect()}
    assert counts == {"memory": 72, "qwen3-4b": 62, "delta": 62, "c2l": 48, "rag": 21, "recurrent": 24}
    assert {r.profile for r in matrix.runs(spark, "state-8k").collect()} == {"state-8k"}


def test_streams_are_batches(spark, tmp_path):
    groups = [(k % 2, k, 0.0 if k % 3 else 0.5, k % 9) for k in range(60)]
    schema = "pool int, k int, spread double, window int"
    fold = folds.GroupFilter(row=3, budget=4)
    expected = {(r.pool, r.k): r.kept for r in folds.batch_fold(spark.createDataFrame(groups, schema), fold, "pool", "k", "kept", "boolean").collect()}
    for part in range(3):
        spark.createDataFrame(groups[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in" / "*"))
    query = folds.stream_fold(stream, fold, "pool", "k", "kept", "boolean").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.pool, r.k): r.kept for r in spark.table("kept").collect()} == expected


def test_router_keeps_groups_together():
    router = folds.Router(3)
    state, servers = router.start(), []
    for event in [{"group": 1, "acquire": True, "weight": 5}, {"group": 2, "acquire": True, "weight": 1}, {"group": 1, "acquire": True, "weight": 1}, {"group": 1, "acquire": False, "weight": 5}, {"group": 1, "acquire": False, "weight": 1}, {"group": 1, "acquire": True, "weight": 1}]:
        state, server = router.step(state, event)
        servers.append(server)
    assert servers == [0, 1, 0, 0, 0, 0]


def test_a_step_costs_the_same_however_much_is_held(spark):
    router, evict = folds.Router(8), folds.StrideEvict(32, 64, 512)
    state, requests = router.start(), evict.start()
    held = state["held"]
    for k in range(100):
        state, _ = router.step(state, {"group": k, "acquire": True, "weight": 1})
        requests_, _ = evict.step(requests, {"request": k, "finish": False, "tokens": 1})
        assert state["held"] is held and requests_ is requests
    rows = [(k, k * 7 % 3, k * 5 % 11, k % 4 != 3, float(k % 6)) for k in range(500)]
    frame = spark.createDataFrame(rows, "event_id long, pool long, group long, acquire boolean, weight double").repartition(5)
    expected = {}
    for pool in range(3):
        state = router.start()
        for k, p, group, acquire, weight in rows:
            if p == pool:
                state, expected[pool, k] = router.step(state, {"group": group, "acquire": acquire, "weight": weight})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = folds.batch_fold(frame, router, "pool", "event_id", "server", "long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.pool, r.event_id): r.server for r in got} == expected


# ---- adapters


def adapted(spark, function, schema, record, *rest):
    frame = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(record)]))
    rows = function(frame, *rest).collect()
    return rows[0].asDict(recursive=True) if rows else None


def test_adapters(spark):
    got = adapted(spark, adapters.musique, "id string, paragraphs array<struct<paragraph_text:string,is_supporting:boolean>>, question string, answer string, answer_aliases array<string>", {"id": "2hop__1", "paragraphs": [{"paragraph_text": "a", "is_supporting": False}, {"paragraph_text": "b", "is_supporting": True}], "question": "q", "answer": "x", "answer_aliases": []})
    assert got["memory_docs"] == ["a", "b"] and got["qa"][0]["evidence_doc_idx"] == [1] and json.loads(got["meta"])["hop"] == "2"
    got = adapted(spark, adapters.titled, "id string, question string, answer string, type string, supporting_facts struct<title:array<string>>, context struct<title:array<string>,sentences:array<array<string>>>", {"id": "1", "question": "q", "answer": "x", "type": "t", "supporting_facts": {"title": ["B"]}, "context": {"title": ["A", "B"], "sentences": [["a."], ["b.", "c."]]}}, "2wiki")
    assert got["memory_docs"] == ["A\na.", "B\nb. c."] and got["qa"][0]["evidence_doc_idx"] == [1]
    alpaca = "row_idx long, instruction string, output string"
    got = adapted(spark, adapters.longalpaca, alpaca, {"row_idx": 3, "instruction": "Read. The paper begins. Body. Now the paper ends. Question: why?", "output": "so"})
    assert got["memory_docs"] == ["Body."] and got["qa"][0]["question"] == "why?"
    assert adapted(spark, adapters.longalpaca, alpaca, {"row_idx": 3, "instruction": "no paper", "output": "so"}) is None
    got = adapted(spark, adapters.longalign, "id string, messages array<struct<role:string,content:string>>", {"id": "1", "messages": [{"role": "user", "content": "text\n\nmore\n\nq0"}, {"role": "assistant", "content": "a0"}, {"role": "user", "content": "q1"}, {"role": "assistant", "content": "a1"}]})
    assert got["memory_docs"] == ["text\n\nmore"] and [q["question"] for q in got["qa"]] == ["q0", "q1"]
    got = adapted(spark, adapters.long_data, "row_idx long, prompt string, completion string", {"row_idx": 1, "prompt": "ctx\n\nQ: old\nA: x\n\nQ: new\nA:", "completion": "y"})
    assert got["qa"][0]["question"] == "new" and got["memory_docs"] == ["ctx\n\nQ: old\nA: x"]
    got = adapted(spark, adapters.mab, "row_idx long, context string, questions array<string>, answers array<array<string>>, metadata struct<source:string>", {"row_idx": 0, "context": "c", "questions": ["a", "b"], "answers": [["1"]], "metadata": {"source": "icl_nlu_8k"}}, "mab_ttl", "TTL", "icl_")
    assert len(got["qa"]) == 1
    got = adapted(spark, adapters.longmemeval, "question_id string, question_type string, question string, answer string, answer_session_ids array<string>, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>", {"question_id": "1", "question_type": "t", "question": "q", "answer": "a", "answer_session_ids": ["s2"], "haystack_dates": ["d1", ""], "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "x"}], [{"role": "user", "content": "y"}]]}, "longmemeval_s")
    assert got["memory_docs"] == ["[Date: d1]\nuser: x", "user: y"] and got["qa"][0]["evidence_doc_idx"] == [1]
    got = adapted(spark, adapters.locomo, "sample_id string, sessions map<string,array<struct<speaker:string,text:string,blip_caption:string>>>, dates map<string,string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:int>>", {"sample_id": "1", "sessions": {"session_10": [{"speaker": "A", "text": "late"}], "session_2": [{"speaker": "B", "text": "hi", "blip_caption": "a cat"}]}, "dates": {"session_2": "May"}, "qa": [{"question": "q", "answer": "x; y", "evidence": ["D10:1", "D10:2"], "category": 3}, {"question": "when", "answer": "May", "evidence": [], "category": 2}, {"question": "no", "answer": "a decoy", "evidence": None, "category": 5}, {"question": "n", "answer": None, "evidence": ["D2:1"], "category": None}]})
    assert got["memory_docs"] == ["[Date: May]\nB: hi and shared a cat.", "A: late"] and got["qa"][0]["evidence_doc_idx"] == [1] and got["qa"][0]["answer"] == ["x; y", "x"]
    assert got["id"] == "locomo-1" and [(q["question"], q["answer"], q["category"]) for q in got["qa"][1:]] == [("when Use DATE of CONVERSATION to answer with an approximate date.", ["May"], 2), ("no", ["No information available", "Not mentioned"], 5), ("n", [""], None)]


def test_recommendations_get_names(spark):
    raw = spark.createDataFrame([(4, "c", ["a", "b", "x"], [["1, 2"], [" "]], ("recsys_redial",)), (9, "d", ["q"], [["7"]], ("icl_nlu",))], "row_idx long, context string, questions array<string>, answers array<array<string>>, metadata struct<source:string>")
    entities = spark.createDataFrame([("http://e/Up_(2009_film)>", 1), ("http://e/The-Big_Heat", 2)], "uri string, entity int")
    got = {r.id: [q.answer for q in r.qa] for r in adapters.mab(raw, "mab_ttl", "TTL", "", adapters.entity_names(entities)).collect()}
    assert got == {"mab_ttl-0": [["Up", "The Big Heat"], []], "mab_ttl-1": [["7"]]}
    with pytest.raises(Exception, match="no name for entity 2"):
        adapters.mab(raw, "mab_ttl", "TTL", "", adapters.entity_names(entities.where("entity = 1"))).collect()
    assert [r.id for r in adapters.mab(raw, "icl", "TTL", "icl_").collect()] == ["icl-0"]


def test_sinks_and_readers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    assert io.write_json(rows, str(tmp_path / "j")) == 2 and io.json_lines(spark, str(tmp_path / "j"), "id long, t string").count() == 2
    assert io.json_lines(spark, str(tmp_path / "none"), "id long", missing_ok=True).count() == 0
    assert io.write_valid(rows, str(tmp_path / "p"), F.when(F.col("id") > 5, F.lit("id"))) == 2
    with pytest.raises(Exception, match="too large"):
        io.write_valid(rows, str(tmp_path / "q"), F.when(F.col("id") > 1, F.lit("too large")))
    (tmp_path / "texts").mkdir()
    for name, body in (("b", "two\n"), ("a", "one")):
        (tmp_path / "texts" / f"{name}.txt").write_text(body)
    assert io.text_folder(spark, str(tmp_path / "texts")).first().text == "one\n\ntwo"


# ---- operators of places, schedules, samples


def test_window_schedules_are_the_simulation(spark):
    import random

    from memloom.operators import schedules

    rng = random.Random(7)
    for most, tokens, sinks in ((3, -1, 1), (4, 15, 0), (2, 30, 2), (50, 9, 1)):
        texts = [[rng.randint(0, 9) for _ in range(rng.randint(1, 25))] for _ in range(40)]
        rows = spark.createDataFrame([(k, i, n) for k, t in enumerate(texts) for i, n in enumerate(t)], "doc_id int, i int, n int")
        plan = schedules.evict_at(rows, "doc_id", most, tokens, sinks)
        got = {(r.doc_id, r.i): r.evict_at for r in plan.collect()}
        seen = {(r.doc_id, r.i): r.visible for r in schedules.visible(plan, "doc_id").collect()}
        for k, t in enumerate(texts):
            out = simulate(t, most, tokens, sinks)
            assert [got[k, i] for i in range(len(t))] == out
            assert [seen[k, q] for q in range(len(t))] == [sum(t[j] for j in range(q + 1) if out[j] > q) for q in range(len(t))]


def test_places_of_hot_keys_and_skewed_ids(spark, monkeypatch):
    import random

    from memloom.operators import splits

    monkeypatch.setattr(regroup, "RANGE_ROWS", 16)
    ids = [*range(300), 10**15, -5, 10**12, *{random.Random(k).randrange(-(2**62), 2**62) for k in range(200)}]
    rows = spark.createDataFrame([(i, "hot" if k % 10 else f"k{k % 3}") for k, i in enumerate(ids)], "id long, key string")
    ranges = rows.select(regroup.range_of(rows, "id").alias("r")).groupBy("r").count().collect()
    assert max(r["count"] for r in ranges) < 0.1 * len(ids)
    before = {r.id: r.s for r in splits.sums_before(rows.withColumn("n", F.lit(3)), "id", "n", "s").collect()}
    assert [before[i] for i in sorted(ids)] == list(range(0, 3 * len(ids), 3))
    for found, order in ((splits.by_id(rows, ["key"], "id"), lambda i: i), (splits.by_hash(rows, ["key"], 3, "s", "id"), lambda i: (__import__("hashlib").md5(f"3|s|{i}".encode()).hexdigest(), i))):
        by_key = {}
        for r in found.collect():
            by_key.setdefault(r.key, []).append((r.place, r.id, r.n))
        for members in by_key.values():
            ranked = sorted((i for _, i, _ in members), key=order)
            assert [i for _, i, _ in sorted(members)] == ranked and {n for *_, n in members} == {len(members)} and [p for p, *_ in sorted(members)] == list(range(len(members)))
    index = regroup.dense_index(rows, "id", per_range=20).collect()
    assert [r.id for r in sorted(index, key=lambda r: r.idx)] == sorted(ids) and sorted(r.idx for r in index) == list(range(len(ids)))


def test_bisected_texts(spark):
    from memloom.operators import samples

    def cut(text):
        if max(1, len(text) // 3) <= 7:
            return [text]
        middle = len(text) // 2
        at = text.rfind(" ", 0, middle)
        at = at + 1 if at > 0 else middle
        return cut(text[:at]) + cut(text[at:])

    texts = ["", "short", "one two three four five six seven eight nine ten", "x" * 100, " " * 60, "é a" * 40]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", samples.bisected(F.col("t"), 7).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: cut(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(samples.bisected(F.col("t"), 7).alias("p")).first().p is None


def test_texts_that_contain_items(spark):
    from memloom.operators import retrieval

    texts = ["a b c d e f", "xa b c d ey", "a b  c d e", "b c", "", "c d e f g h a b c d e"]
    items = ["a b c d e", "b c d", "b", "a b  c", "zz"]
    got = retrieval.containing(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((i, k) for i, t in enumerate(texts) for k, q in enumerate(items) if q in t)


def test_long_samples_are_left_out(spark):
    from memloom.operators import samples

    rows = spark.createDataFrame([([130_000], "unit"), ([10, 20, 30], "unit"), ([10, 20, 30], "token")], "docs array<int>, mode string")
    got = [r[0] for r in rows.select(F.explode(F.array(samples.layout(F.col("docs"), F.lit(4), F.lit(2), F.col("mode"), F.lit(2), F.lit(-1), 5)).alias("x"))).collect()]
    assert got[0] is None
    assert [(x.s, x.e) for x in got[1].chunk_spans] == [(0, 36), (36, 66), (66, 72)] and got[1].qa_chunk_idx == [2]
    assert got[2].total_len == 5 + 60 + 4 + 6 and got[2].qa_chunk_idx[0] == 69 // 2 and len(got[2].chunk_spans) == 38


def test_training_rows_have_all_fields(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"input_ids": [1], "is_evicted": [0], "labels": [-100]}\n')
    (tmp_path / "bad.json").write_text('{"input_ids": [1], "labels": [-100]}\n')
    assert io.training_rows(spark, str(tmp_path / "good.json")).count() == 1
    with pytest.raises(Exception, match="no is_evicted"):
        io.training_rows(spark, str(tmp_path / "bad.json")).collect()


def test_nearest_vectors_by_blocks(spark, monkeypatch):
    import numpy as np

    from memloom.operators import retrieval

    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in rng.integers(-2, 3, (60, 4))] + [[0.0] * 4, [0.0] * 4]
    rows = spark.createDataFrame(list(enumerate(vectors)) + [(99, None)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 7 = 0").selectExpr("vec_id AS query_id", "embedding")
    unit = [np.array(v) / max(np.linalg.norm(v), 1e-12) for v in vectors]
    expected = {(q, r, i) for q in range(0, 62, 7) for r, i in enumerate(sorted((k for k in range(62) if k != q), key=lambda k: (-round(float(unit[k] @ unit[q]), 6), k))[:3], 1)}
    for block in (10, 1000):
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
        assert {(r.query_id, r["rank"], r.vec_id) for r in retrieval.cosine(rows, asked, 3).collect()} == expected
