"""Registered queries over small tables of their own, against brute force: no row and no part of a text is left out."""

import math
import re
from collections import Counter

import pytest

from memloom.plans import adapted, corpus, scoring, spans_and_prompts  # noqa: F401
from memloom.plans.registry import ORACLE, QUERIES
from memloom.sources import adapters

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def run(spark, tmp_path):
    """run(name, table=(schema, rows), ...): the rows of a query over these tables."""

    def over(name, **tables):
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return QUERIES[name](spark, str(tmp_path)).collect()

    return over


def documents(texts, lang="en"):
    return DOCUMENTS, [(k, t, lang, "s", len(t)) for k, t in enumerate(texts)]


# ---- bm25_topk, bm25_stats, rag_context

TEXTS = ["red car", "blue blue boat on the sea", "green", "blue car", "a red boat", "old blue sea", "red red red sea", "tree"]
ITEMS = ("item_id long, text string", [(0, "blue sea"), (1, "red boat"), (7, "green tree")])


def test_retrieval_reads_every_document(run):
    words = [re.findall("[a-z0-9]+", t.lower()) for t in TEXTS]
    df, mean = Counter(w for ws in words for w in set(ws)), sum(map(len, words)) / len(words)
    expected = set()
    for item, text in ITEMS[1]:
        scores = []
        for k, ws in enumerate(words):
            parts = [math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for t in set(text.split())]
            scores.append((-round(sum(parts), 9), k))
        expected |= {(item, k, round(-s, 6), rank) for rank, (s, k) in enumerate(sorted(scores)[:3], 1)}
    got = run("bm25_topk", documents=documents(TEXTS), benchmark=ITEMS)
    assert {(r.query_id, r.unit_id, r.score, r["rank"]) for r in got} == expected
    tf = Counter(w for ws in words for w in ws)
    assert {(r.term, r.df, r.tf) for r in run("bm25_stats", documents=documents(TEXTS))} == {(w, df[w], tf[w]) for w in tf}


def test_every_document_is_a_candidate_of_every_item(run):
    texts = [*TEXTS, *(f"filler {k}" for k in range(20))]
    tables = {"documents": documents(texts), "benchmark": ITEMS}
    best = {}
    for r in run("bm25_topk", **tables):
        best.setdefault(r.query_id, []).append(r.unit_id)
    assert {r.item_id: r.units for r in run("rag_context", **tables)} == {q: ",".join(map(str, sorted(ids))) for q, ids in best.items()}
    few = {r.query_id: str(r.unit_id) for r in run("bm25_topk", documents=documents(TEXTS), benchmark=ITEMS) if r["rank"] == 1}
    assert {r.item_id: r.units for r in run("rag_context", documents=documents(TEXTS), benchmark=ITEMS)} == few


def test_units_meet_queries_where_they_lie(spark):
    """A task passes on k units a query: what is shuffled after the scores is no row a pair."""
    from memloom.operators import retrieval

    units = spark.createDataFrame([(k, f"red boat {k % 7} sea{k % 5}") for k in range(4000)], "unit_id long, text string")
    queries = spark.createDataFrame([(q, f"red boat sea{q % 5} {q}") for q in range(20)], "query_id long, text string")
    found = retrieval.bm25(units, queries, 3)
    assert found.count() == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, unit_id#\d+L?", plan)


# ---- judge_niah, token_f1, rouge_l, judge_em, judge_dispatch, locomo_f1, aux_scores, normalize_text, clip_context

LATE = "filler " * 100 + "Zebra crossing at noon"


@pytest.mark.parametrize("lang", ["en", "fr"])
def test_answers_are_judged_whole(run, lang):
    gold = LATE.replace("filler", "füller") if lang == "fr" else LATE
    tables = {"documents": (DOCUMENTS, [(3, gold, lang, "s", len(gold))]), "benchmark": ("item_id long, text string", [(23, "zebra crossing at noon")])}
    score = lambda name, column: [r[column] for r in run(name, **tables)]
    assert score("judge_niah", "score") == [1.0]
    assert score("token_f1", "f1") == [round(2 * 4 / (104 + 4), 4)]
    words = len(re.findall("[a-z0-9]+", gold.lower()))
    assert score("rouge_l", "rouge_l") == [pytest.approx(2 * 4 / (words + 4), abs=1e-6)]
    assert score("aux_scores", "rule") == [True]


def test_texts_outside_ascii_are_kept(run):
    texts = ["plain words", "Ünïcode wörds", "été " * 400]
    for name in ("normalize_text", "clip_context"):
        assert {r.doc_id for r in run(name, documents=documents(texts, "de"))} == {0, 1, 2}


def test_rouge_l_is_the_recursion(spark):
    import random

    from memloom.functions import judge

    draw, rows = random.Random(5), []
    for _ in range(60):
        rows.append(tuple(" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 90))) for _ in range(2)))
    got = spark.createDataFrame(rows, "g string, p string").selectExpr("array(g) AS g", "p").select(judge.rouge_l("g", "p")).collect()
    for (gold, pred), row in zip(rows, got, strict=True):
        g, p = gold.split(), pred.split()
        best = [[0] * (len(g) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(g):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        same = best[-1][-1]
        assert row[0] == pytest.approx(2 * same / (len(p) + len(g)) if same else 0.0)


# ---- evict_schedule, visible_counts


def test_schedules_go_to_the_last_line(run):
    lengths = [30] + [k % 90 + 50 for k in range(59)]
    texts = ["\n".join("x" * n for n in lengths)]
    n = len(lengths)

    def leaves(j, tokens):
        over = (i for i in range(j + 1, n) if i - j + 1 > 6 or tokens and lengths[0] + sum(lengths[j : i + 1]) > tokens)
        return n if j < 1 else next(over, n)

    assert {(r.i, r.evict_at) for r in run("evict_schedule", documents=documents(texts))} == {(j, leaves(j, 900)) for j in range(n)}
    seen = {(q, sum(lengths[k] for k in range(q + 1) if leaves(k, 0) > q)) for q in range(n)}
    assert {(r.i, r.visible) for r in run("visible_counts", documents=documents(texts))} == seen


# ---- regroup_by_memory, common_prefix, label_set, memory_query_split


def test_memories_differ_by_their_whole_texts(run):
    rows = [(k, t, "en", f"s{k}", len(t)) for k, t in enumerate(["alike", "also", "alike"])]
    assert sorted((r.row_idx, r.n) for r in run("regroup_by_memory", documents=(DOCUMENTS, rows))) == [(0, 2), (1, 1)]


def test_whole_texts_are_compared_and_split(run):
    texts = ["é" * 300 + "a", "é" * 300 + "b", "", "", "\U0001f600x", "\U0001f600y"]
    assert {r.doc_id: r.n for r in run("common_prefix", documents=documents(texts))} == {0: 300, 1: 0, 2: 0, 3: 0, 4: 1}
    assert {r.doc_id: (r.m, r.query) for r in run("memory_query_split", documents=documents(texts))} == {k: (len(t), "what?") for k, t in enumerate(texts)}


def test_labels_are_read_from_whole_texts(run):
    labels = ("doc_id long, quality int, toxic int", [(0, 1, 1)])
    assert [r.labels for r in run("label_set", documents=documents(["words " * 20 + "\nlabel: 7\nmore"]), labels=labels)] == ["3,7"]


# ---- qa_json_roundtrip, synthetic_recall, mix_len_stats


def test_no_subset_of_ids(run):
    events = ("event_id long, props string", [(k, f'{{"k": "{k}"}}') for k in range(25)])
    assert {(r.event_id, r.k) for r in run("qa_json_roundtrip", events=events)} == {(k, str(k)) for k in range(25)}
    texts = ["x" * (k + 1) for k in range(60)]
    assert {(r.doc_id, r.k) for r in run("synthetic_recall", documents=documents(texts))} == {(d, k) for d in range(60) for k in range(8)}


def test_lengths_of_the_first_2000_rows(run):
    rows = [(k, "", "en", "s", k + 1) for k in range(2100)]
    assert [(r.mean, r.longest) for r in run("mix_len_stats", documents=(DOCUMENTS, rows))] == [(1000.5, 2000)]


def test_every_document_is_judged_against_every_item(run):
    texts = ["Blue sea", "red, boat, and blue sea", "", None, "the blue blue sea", "red boat", "=", "sea blue"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [(5, "blue", "en", "s", 4), (None, "red boat", "en", "s", 8)]  # an id twice, and none
    items = [(0, "blue sea, red boat, green"), (1, "blue sea"), (2, "The red boat!"), (25, "red"), (7, "a blue blue blue tree")]
    tables = {"documents": (DOCUMENTS, rows), "benchmark": ("item_id long, text string", items)}

    def normal(t):
        t = re.sub(r"\b(a|an|the)\b", " ", re.sub(r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "", t.lower()))
        return " ".join(t.split())

    def f1(pred, gold):
        p, g = ([w for w in normal(t).split() if w != "and"] for t in (pred, gold))
        return 2 * sum((Counter(p) & Counter(g)).values()) / max(len(p) + len(g), 1)

    def commas(pred, gold):
        golds, preds = ([x.strip() for x in t.split(",") if x.strip()] for t in (gold, pred))
        return sum(max((f1(p, g) for p in preds), default=0) for g in golds) / len(golds)

    pairs = [(i, t, j, g) for i, t, *_ in rows for j, g in items]
    order = lambda found: sorted(found, key=str)
    assert order((r.doc_id, r.item_id, r.f1) for r in run("token_f1", **tables)) == order((i, j, round(f1(t or "", g), 4)) for i, t, j, g in pairs)
    assert order((r.doc_id, r.item_id, r.correct) for r in run("judge_em", **tables)) == order((i, j, None if t is None else normal(t) == normal(g)) for i, t, j, g in pairs)
    assert order((r.doc_id, r.item_id, r.rule, r.em, r.f1) for r in run("aux_scores", **tables)) == order((i, j, normal(g) in normal(t or ""), normal(t or "") == normal(g), round(f1(t or "", g), 4)) for i, t, j, g in pairs)
    expected = order((i, j, round((commas if j % 5 == 0 else f1)(t or "", g), 6)) for i, t, j, g in pairs)
    assert order((r.doc_id, r.item_id, r.f1) for r in run("locomo_f1", **tables)) == expected


# ---- adapt_longalpaca, adapt_longalign

BLANK = ["One.", "", " \n\t", "Two\n\nand more.\n", "\n\n", " three ", "", "four", "\n"]


def by_sql(name, folder):
    import duckdb

    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        return sorted(duck.execute(ORACLE[name]).fetchall())


def test_blank_papers_stay_and_count(spark, run, tmp_path):
    got = sorted(map(tuple, run("adapt_longalpaca", documents=documents(BLANK))))
    assert len(got) == 6 and got == by_sql("adapt_longalpaca", tmp_path)
    schema, rows = documents(BLANK)
    nulls = run("adapt_longalpaca", documents=(schema, [(1, None, "en", "s", None), *rows[2:]]))
    assert sorted((r.id, r.n_docs, r.question) for r in nulls) == [(r[0], r[2], r[4]) for r in got]
    raw = spark.createDataFrame([(k, f"The paper begins.{t}Now the paper ends. why?", "so") for k, t in enumerate(BLANK)], "row_idx long, instruction string, output string")
    assert sorted((r.id, r.memory_docs) for r in adapters.longalpaca(raw).collect()) == [(f"longalpaca-{n}", [t.strip()]) for n, t in enumerate(filter(str.strip, BLANK))]


def test_blank_texts_before_a_question_stay(spark, run, tmp_path):
    got = sorted(map(tuple, run("adapt_longalign", documents=documents(BLANK))))
    assert len(got) == len(BLANK) and got == by_sql("adapt_longalign", tmp_path)
    schema, rows = documents(BLANK)
    nulls = run("adapt_longalign", documents=(schema, [*rows[:3], (3, None, "en", "s", None), *rows[4:]]))
    assert sorted((r.id, r.n, r.question) for r in nulls) == [(r[0], r[3], r[4]) for r in got]
    raw = spark.createDataFrame([(str(k), [("user", f"{t}\n\nwhy?"), ("assistant", "so")]) for k, t in enumerate(BLANK)], "id string, messages array<struct<role:string,content:string>>")
    assert sorted((r.id, r.memory_docs) for r in adapters.longalign(raw).collect()) == [(str(k), [t]) for k, t in enumerate(BLANK) if t.strip()]
