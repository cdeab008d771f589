"""Vectors, patterns, rounds, evidence blocks, replies, caches and keyed state on fixtures and against brute force."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, embed, evaluate, evidence, index, patterns, prefix, replies, rounds, stored, vectors
from quarry.sources import files
from quarry.storage import fresh_dir
from quarry.streaming import stream

# ---------------------------------------------------------------- vectors


def clustered(n, width, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, width))
    return (centres[draw.integers(0, 12, n)] + 0.4 * draw.normal(size=(n, width))).astype(float)


def test_approximate_index_against_brute_force(spark):
    m = clustered(1500, 16, 1)
    m[700:800] = m[700]  # copies
    store = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(9001, None), (9002, [0.0] * 16)], "pos long, embedding array<float>")
    asked = spark.createDataFrame([(f"q{k}", m[k].tolist()) for k in range(0, 1500, 50)], "query_id string, query_vector array<float>")
    own = vectors.VectorIndex(spark, fresh_dir(spark, "ix"), "x", 16)
    own.fit(store)
    own.upsert(store.where("pos % 5 <> 0"))
    assert own.count() == 1200
    found = vectors.nearest(own, store, asked, 10).collect()
    assert own.count() == 1500  # brought up to date: vectors without a length are none
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    recall = []
    for k in range(0, 1500, 50):
        score = unit @ unit[k]
        tenth = np.sort(score)[-10]
        mine = [r["pos"] for r in found if r["query_id"] == f"q{k}"]
        assert len(mine) == len(set(mine)) == 10
        recall.append(np.mean([score[p] >= tenth - 1e-6 for p in mine]))
    assert np.mean(recall) >= 0.95
    visits = own._about()["probes"]
    assert visits < own.spark.read.parquet(f"{own.root}/centroids").count()
    plan = own.search(asked.limit(1), 3)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_index_is_bound_and_batches_replace(spark):
    root = fresh_dir(spark, "ix")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0])], "pos string, embedding array<float>")
    own = vectors.VectorIndex(spark, root, "two", 2)
    own.upsert(rows)
    with pytest.raises(ValueError):
        own.upsert(spark.createDataFrame([("c", [1.0])], "pos string, embedding array<float>"))
    for name, width in (("two", 3), ("other", 2)):
        with pytest.raises(ValueError):
            vectors.VectorIndex(spark, root, name, width)
    q = spark.createDataFrame([("q", [1.0, 0.2])], "query_id string, query_vector array<float>")
    top = lambda ix, **k: [r["pos"] for r in ix.search(q, 5, 9, **k).orderBy("rank").collect()]
    assert top(own) == ["a", "b"]
    own.upsert(spark.createDataFrame([("a", [0.0, 2.0]), ("c", [3.0, 0.0])], "pos string, embedding array<float>"))
    again = vectors.VectorIndex(spark, root, "two", 2)
    assert top(again) == ["c", "a", "b"] and again.count() == 3
    assert top(again, scope=spark.createDataFrame([("b",)], "pos string")) == ["b"]
    again.delete(spark.createDataFrame([("c",), ("none",)], "pos string"))
    again.upsert(spark.createDataFrame([("b", None)], "pos string, embedding array<float>"))
    assert top(again) == ["a"]
    wide = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, query_vector array<float>")
    store = spark.createDataFrame([("z", [1.0, 1.0, 0.0])], "pos string, embedding array<float>")
    assert [r["pos"] for r in vectors.nearest(again, store, wide, 3).collect()] == ["z"]  # another width: the exact way


def test_hashed_terms(spark):
    rows = spark.createDataFrame([(1, "alpha beta beta"), (2, "Beta, alpha beta"), (3, "gamma"), (4, "?"), (5, None)], "pos long, text string")
    got = {r["pos"]: r["embedding"] for r in embed.HashedTerms(32).embedded(rows).collect()}
    assert got[1] == got[2] and got[4] is None and got[5] is None and abs(np.linalg.norm(got[3]) - 1) < 1e-6 and len(got[1]) == 32


def test_dense_deals_blocks_when_questions_are_many(spark, monkeypatch):
    m = clustered(60, 4, 2)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "pos long, embedding array<float>")
    q = spark.createDataFrame([(f"q{k}", m[k].tolist()) for k in range(20)], "query_id string, query_vector array<float>")
    best = lambda: {(r["query_id"], r["pos"], r["rank"]) for r in index.top_k(index.dense(v, q, 3, rows=6), 3, [F.desc(F.round("score", 9)), F.col("pos")]).collect()}
    small = best()
    monkeypatch.setattr(index, "BROADCAST_BYTES", 0)
    assert best() == small and len(small) == 60


# ---------------------------------------------------------------- patterns


def test_patterns_against_brute_force(spark):
    draw = random.Random(7)
    words = ["ab", "abc", "b", "cab", "a.b", "(x)", "\\E", "ÄB", "zz", "漢字", "a"]
    texts = [(k, draw.choice([" ", "\n", "  "]).join(draw.choices(words, k=draw.randint(0, 12)))) for k in range(150)] + [(900, None), (901, "")]
    sought = ["ab", "B C", "b ca", "a", "zz zz", "ab abc b", "(x) ", " cab", "\\E", "a.b", "axb", "äb a", "  ", "", "字 漢", "c ab ab z", "none of it", "ab"]
    found = {tuple(r) for r in patterns.occurrences(spark.createDataFrame(list(enumerate(sought)), "pattern_id int, pattern string"), spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = set()
    for i, p in enumerate(sought):
        for k, t in texts:
            low = p.lower()
            if t and low.strip() and low in t.lower():
                parts = t.lower().split(low)
                want.add((i, k, len(parts) - 1, len(parts[0]), len(t) - len(parts[-1])))
    assert found == want and len(want) > 300


def test_patterns_have_no_nested_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = patterns.occurrences(items, docs, "item_id", "text")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_anchors_and_spans(spark):
    members = spark.createDataFrame([("Alpha", 3), ("beta", 1), ("gamma", 2), ("delta", None)], "name string, declared int")
    passages = spark.createDataFrame([(1, "alpha first"), (2, "BETA and alpha"), (3, "again ALPHA"), (4, "delta")], "passage int, text string")
    assert {tuple(r) for r in patterns.anchors(members, passages).collect()} == {("Alpha", 3, 6), ("beta", 2, 0), ("delta", 4, 0)}
    one = spark.createDataFrame([("xaaya",)], "t string").select(patterns.regex_span(F.col("t"), "a+").alias("a"), patterns.regex_span(F.col("t"), "z").alias("z")).first()
    assert tuple(one["a"]) == (1, 5) and one["z"] is None


# ---------------------------------------------------------------- rounds


@pytest.fixture(scope="module")
def small_index(spark):
    own = stored.TextIndex(spark, fresh_dir(spark, "ix"))
    rows = ["alpha beta", "gamma delta", "epsilon zeta xzetay", "alpha alpha", "beta beta beta", "theta"]
    own.add(spark.createDataFrame([(k, f"d{k}", "c0", t) for k, t in enumerate(rows)], "pos long, doc_id string, chunk_id string, text string"))
    return own


def test_rounds_end_when_enough_is_found_and_repeat_nothing(spark, small_index):
    asked = spark.createDataFrame([("full", "alpha beta"), ("part", "alpha beta gamma zeta theta"), ("none", "omega quux"), ("blank", " ?")], "query_id string, query string")
    state, pool, calls = rounds.retrieve(small_index, asked, found=1, probed=2)
    by = {r["query_id"]: r for r in state.collect()}
    assert by["full"]["verdict"] == "sufficient" and by["full"]["rounds"] == 1
    assert by["part"]["verdict"] == "sufficient" and by["part"]["rounds"] == 2 and by["part"]["n_pool"] >= 2
    assert by["none"]["verdict"] == "insufficient" and by["none"]["n_pool"] == 0 and by["none"]["missing"] == ["omega", "quux"] and by["none"]["rounds"] == 3
    assert by["blank"]["rounds"] == 1 and by["blank"]["n_pool"] == 0
    made = [(r["query_id"], r["tool"], r["argument"]) for r in calls.collect()]
    assert len(made) == len(set(made)) and sum(q == "none" for q, *_ in made) == 4  # the third round repeats all of the second
    assert {r["query_id"] for r in pool.collect()} == {"full", "part"}


def test_rounds_stay_in_scope_and_budget(spark, small_index):
    asked = spark.createDataFrame([("q", "alpha beta"), ("w", "alpha beta")], "query_id string, query string")
    scope = spark.createDataFrame([("q", 3), ("q", 1)], "query_id string, pos long")
    _, pool, _ = rounds.retrieve(small_index, asked, scope=scope)
    got = {(r["query_id"], r["pos"]) for r in pool.collect()}
    assert {p for q, p in got if q == "q"} == {3} and ("w", 0) in got
    new = rounds.changed_scope(scope, spark.createDataFrame([("q", 5), ("v", 1)], "query_id string, pos long"), spark.createDataFrame([("v",)], "query_id string"))
    assert {tuple(r) for r in new.collect()} == {("q", 5)}
    calls = rounds.planned_calls(spark.createDataFrame([("q", "a b", ["x", " ", "y"])], "query_id string, search string, missing array<string>"))
    assert sorted((r["turn"], r["argument"]) for r in calls.collect()) == [(0, "a b"), (1, "x")]
    made = spark.createDataFrame([("q", "search", "a b")], "query_id string, tool string, argument string")
    assert [r["argument"] for r in rounds.not_made(calls, made, 1).collect()] == ["x"]


def test_parts_are_merged(spark, small_index):
    parts = spark.createDataFrame([(1, 0, "a", "alpha beta"), (1, 1, "b", "omega"), (2, 0, "c", "gamma delta")], "question_id int, part int, query_id string, query string")
    state, pool, _ = rounds.retrieve(small_index, parts.select("query_id", "query"), rounds=2)
    out, together = rounds.merged(parts, state, pool, small_index)
    by = {r["question_id"]: r for r in out.collect()}
    assert (by[1]["rounds"], by[1]["n_sufficient"], by[1]["open_parts"]) == (2, 1, [1]) and by[2]["open_parts"] == [] and by[2]["n_pool"] == 1
    assert together.where("question_id = 1").count() == by[1]["n_pool"]


# ---------------------------------------------------------------- evidence, evaluation


def block(question, passages, budget):
    """The rule, one passage after another."""
    out, shown = f"Question: {question}\n\nEvidence:\n", 0
    for k, (doc, text) in enumerate(passages):
        header, text = f"[{k + 1}] ({doc} p.1) ", " ".join(text.split())
        room = budget - len(out.encode()) - len(header.encode()) - 1
        if room < 120:
            break
        out += header + (text if len(text.encode()) <= room else text[:room] + "…") + "\n"
        shown += 1
    return out + (f"\n({len(passages) - shown} of {len(passages)} passage(s) omitted to fit the context window.)\n" if shown < len(passages) else "")


def test_evidence_blocks(spark):
    draw = random.Random(9)
    questions, rows, want = [], [], {}
    for k in range(40):
        passages = [(f"d{i}", "".join(draw.choices("abc 漢\n", k=draw.randint(0, 500)))) for i in range(draw.randint(0, 6))]
        questions.append((f"q{k}", f"what {k}"))
        rows += [(f"q{k}", i + 1, d, t) for i, (d, t) in enumerate(passages)]
        want[f"q{k}"] = block(f"what {k}", passages, 900)
    got = evidence.evidence_block(spark.createDataFrame(questions, "query_id string, query string"), spark.createDataFrame(rows, "query_id string, rank int, doc_id string, text string"), 900)
    assert {r["query_id"]: r["block"] for r in got.collect()} == want
    assert evidence.prompt_budget() == (8192 - 1280) * 3 and evidence.prompt_budget(100) == 512 * 3


def test_snippets_cover_their_hits(spark):
    draw = random.Random(3)
    for _ in range(300):
        t = "".join(draw.choice(" ") if draw.random() < 0.15 else draw.choice([".", "a", "b", "c", "c", "c"]) for _ in range(draw.randint(700, 4000)))
        first = draw.randint(300, len(t) - 20)
        shown, cut = answers.snippet(t, first, first + 10)
        assert len(shown) <= answers.WINDOW + answers.TOLERANCE + 6 and cut == (len(shown) < len(answers._flat(t)))


def test_metrics_without_numbers_are_missing(spark):
    rows = spark.createDataFrame([(0.5, float("nan")), (1.0, 0.25), (None, 0.75)], "a double, b double")
    got = evaluate.metric_means(rows, "a", "b").first()
    assert (got["a"], got["a_missing"], got["b"], got["b_missing"], got["quality_macro"]) == (0.75, 1, 0.5, 1, 0.625)
    records = spark.createDataFrame([(1, "x" * 201, 0), (2, "x" * 201, 3), (3, "short", 0), (4, "x" * 300, None)], "id int, answer string, n_contexts int")
    assert sorted(r["id"] for r in evaluate.violations(records).collect()) == [1, 4]


# ---------------------------------------------------------------- order without one task, caches


def test_running_numbers_over_ranges(spark):
    draw = random.Random(2)
    rows = [(draw.randint(0, 500), k, draw.randint(0, 9)) for k in range(2000)]
    got = prefix.numbered(spark.createDataFrame(rows, "a int, k int, v int"), ["a", "k"], {"upto": F.col("v")}, 7).orderBy("_n").collect()
    total = 0
    for n, (r, w) in enumerate(zip(got, sorted(rows), strict=True)):
        total += w[2]
        assert (r["_n"], r["a"], r["k"], r["upto"]) == (n + 1, w[0], w[1], total)
    assert prefix.numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_parse_cache_reads_through_and_forgets(spark):
    own, seen = files.ParseCache(spark, fresh_dir(spark, "cache")), []

    def parse(df):
        seen.append(sorted(r["key"] for r in df.collect()))
        return df.select("key", F.upper("text").alias("value"))

    ask = lambda keys, at: sorted((r["key"], r["value"], r["hit"]) for r in own.read_through(spark.createDataFrame([(k, k * 10) for k in keys], "key string, text string"), parse, at).collect())
    assert ask(["a", "b", "b"], 1) == [("a", "A" * 10, False), ("b", "B" * 10, False)]
    assert ask(["b", "c"], 2) == [("b", "B" * 10, True), ("c", "C" * 10, False)] and seen == [["a", "b"], ["c"]]
    assert own.trim(20) == 2 and sorted(r["key"] for r in own.entries.collect()) == ["b", "c"]
    assert ask(["a", "c"], 3) == [("a", "A" * 10, False), ("c", "C" * 10, True)]


# ---------------------------------------------------------------- replies and metadata


REPLIES = [
    ('{"queries": ["One two", {"query": "three"}, {"question": " "}, {"sub_query": "four"}, 5, "one TWO", "five"]}', ["One two", "three", "four"]),
    ('["a b", {"search_query": "c"}]', ["a b", "c"]),
    ('```json\n{"queries": ["fenced"]}\n```', ["fenced"]),
    ('Here are the queries:\n- first one\n* second\n3. "third",\n4) fourth', ["first one", "second", "third"]),
    ('{"queries": "none"}', []),
    ('{"broken": [', []),
    ("Just prose.\nMore prose.", []),
    ('["according to the text", "https://x.y", "' + "w " * 25 + '", "fine"]', ["fine"]),
    ("", []),
    (None, []),
]


def test_reply_queries(spark):
    rows = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(REPLIES)], "k int, r string")
    got = {r["k"]: r["q"] for r in rows.select("k", replies.reply_queries(F.col("r")).alias("q")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(REPLIES)}


def test_reply_slots(spark):
    reply = json.dumps({"queries": [], "slots": [{"kind": "set ", "who": "A|B", "scan": "won, lost，won"}, "count", {"note": 1}, {"terms": ["x", 3, "X", "y"], "acts": "z"}]})
    rows = spark.createDataFrame([(1, reply), (2, "[]"), (3, '{"slots": {}}')], "k int, r string")
    got = {r["k"]: [tuple(s) for s in r["s"]] for r in rows.select("k", replies.reply_slots(F.col("r")).alias("s")).collect()}
    assert got == {1: [("set", "A|B", ["won", "lost"]), ("count", "", []), ("", "", ["x", "y", "z"])], 2: [], 3: []}


def test_metadata_of_any_shape(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": ["x、y", "x", " "], "c": null, "d": {"e": 1}, "f": true}'), (2, "no json"), (3, '{"a": "Two", "b": [1, 2]}'), (4, "[1]")], "k int, j string")
    got = {(r["k"], r["field"], r["value"]) for r in replies.long_values(rows, "k", "j").collect()}
    assert {g for g in got if g[0] == 1} == {(1, "a", "1"), (1, "b", "x"), (1, "b", "y"), (1, "f", "true")} and (3, "a", "Two") in got and not {g for g in got if g[0] in (2, 4)}
    fields = spark.createDataFrame([("t", 0, "x", "number", "a number", None), ("t", 1, "x", "string", "", None), ("t", 2, " ", "string", "", None), ("t", 3, "y", "number", "", ["p", "q"])], "g string, at int, key string, type string, description string, enum array<string>")
    schema = json.loads(replies.json_schema(fields, "g").first()["schema"])
    assert schema == {"type": "object", "properties": {"x": {"type": "number", "description": "a number"}, "y": {"type": "string", "enum": ["p", "q"]}}, "additionalProperties": False}


# ---------------------------------------------------------------- keyed state


def test_tools_out_of_use_over_restarts_and_expiry(spark, tmp_path):
    shape = "conv_id string, tool string, failed boolean, ts timestamp"

    def batch(n, rows):
        made = [(c, t, f, f"2025-01-01 {at}") for c, t, f, at in rows]
        spark.createDataFrame(made, "conv_id string, tool string, failed boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        got = []
        calls = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = stream.disabled_stream(calls).writeStream.foreachBatch(lambda df, n: got.extend((r["conv_id"], r["tool"], r["ts"].strftime("%H:%M"), r["disabled"]) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(got)

    batch(1, [("c", "nav", True, "10:00:00"), ("c", "nav", False, "10:05:00"), ("d", "nav", False, "10:06:00"), ("", "nav", True, "10:00:00")])
    assert run() == [("c", "nav", "10:00", False), ("c", "nav", "10:05", True), ("d", "nav", "10:06", False)]
    batch(2, [("c", "nav", False, "10:29:00"), ("c", "web", False, "10:29:00")])
    assert run() == [("c", "nav", "10:29", True), ("c", "web", "10:29", False)]  # after a restart
    batch(3, [("c", "nav", False, "10:31:00"), ("d", "nav", True, "11:30:00")])
    assert ("c", "nav", "10:31", False) in run()
    batch(4, [("c", "nav", False, "11:31:00"), ("d", "nav", False, "11:59:00")])
    assert run() == [("c", "nav", "11:31", False), ("d", "nav", "11:59", True)]


# ---------------------------------------------------------------- batches with faults


def test_batches_keep_order_and_faults(spark):
    from quarry.operators import outcomes

    def work(x):
        if x is None or x < 0:
            raise ValueError(f"bad {x}")
        return x * 2

    rows = spark.createDataFrame([(f"f{k}", k, None if k == 3 else -k if k == 7 else k) for k in range(25)], "name string, no int, x int")
    out, seen = outcomes.run_batch(rows, "name", "no", "x", work, "long", group=10)
    got = [(r["name"], r["result"], r["error"]) for r in out.orderBy("at").collect()]
    assert got == [(f"f{k}", None if k in (3, 7) else k * 2, {3: "ValueError: bad None", 7: "ValueError: bad -7"}.get(k)) for k in range(25)]
    assert seen == {"done": 25, "failed": 2}
    out, seen = outcomes.run_batch(rows, "name", "no", "x", work, "long", group=10, stop=lambda s: s["done"] >= 10)
    assert seen == {"done": 10, "failed": 2} and out.where("error = 'cancelled'").count() == 15 and out.where("at > 10 AND error IS NULL").isEmpty()


def test_term_counts_are_those_of_the_terms(spark):
    rows = spark.createDataFrame([(1, "a", "bb aa bb cc bb"), (2, "b", ""), (3, "c", "漢字漢 漢字 x")], "pos long, doc_id string, text string")
    got = {(r["pos"], r["dl"], r["term"], r["tf"]) for r in stored.term_counts(rows).collect()}
    assert got == {(1, 5, "aa", 1), (1, 5, "bb", 3), (1, 5, "cc", 1), (3, 3, "漢字", 2), (3, 3, "字漢", 1)}
