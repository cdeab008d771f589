"""Reports, scopes and the catalogue of bases on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import evaluate, filters
from quarry.sources.registry import Registry


def test_modal_length(spark):
    def of(*texts):
        return tuple(evaluate.modal_length(spark.createDataFrame([(t,) for t in texts], "text string")).first())

    assert of("a" * 3000, "b" * 3000, "c", None) == (3000, 2, 4, True)
    assert of("a" * 3000, "b" * 3000, "c") == (3000, 2, 3, False)
    assert of("a" * 2999, "b" * 2999, "c", "") == (2999, 2, 4, False)
    assert of("a", "bb", "ccc", "dddd") == (1, 1, 4, False)
    assert of() == (None, None, 0, False)


def test_contexts_that_a_judge_is_shown(spark):
    row = spark.createDataFrame([(["", "alpha", None, "beta"],)], "c array<string>")
    shown = lambda **k: row.select(evaluate.shown_contexts(F.col("c"), **k).alias("x")).first()["x"]
    assert shown() == ["alpha", "beta"] and shown(most=1) == ["alpha"] and shown(chars=2) == ["al", "be"]


def test_prompt_stats_and_calls(spark):
    rows = spark.createDataFrame([("q", "abcdef", "ab"), ("q", "xy", "xy"), ("e", "", "")], "q string, raw string, shown string")
    out = {r["q"]: r.asDict() for r in evaluate.prompt_stats(rows, "q").collect()}
    assert out["q"] == {"q": "q", "passages": 2, "expanded": 1, "compressed": 1, "chars": 4, "chars_raw": 8, "ratio": 2.0} and out["e"]["ratio"] == 1.0
    calls = spark.createDataFrame([("grep", True, 5), ("grep", False, None), ("read", None, 7)], "tool string, failed boolean, ms long")
    assert sorted(map(tuple, evaluate.tool_calls(calls).collect())) == [("grep", 2, 1, 5), ("read", 1, 0, 7)]


def test_balanced_sample_is_the_same_however_rows_lie(spark):
    rows = [(k, "a" if k % 10 else "b") for k in range(60)]
    draw = lambda r: sorted((x["k"], x["c"]) for x in evaluate.balanced_sample(spark.createDataFrame(r, "k long, c string").repartition(3), "c", "k", 5, 3).collect())
    first = draw(rows)
    assert first == draw(rows[::-1]) and sum(c == "a" for _, c in first) == sum(c == "b" for _, c in first) == 5


def test_scopes_and_places(spark):
    assert filters.bound_scope(["a", "b"], []) == ["a", "b"] and filters.bound_scope(["a", "b"], ["b"]) == ["b"]
    with pytest.raises(ValueError):
        filters.bound_scope(["a"], ["a", "c"])
    rows = spark.createDataFrame([("d", 7, "x"), ("d", 3, "y"), ("e", 1, "z")], "doc_id string, pos long, chunk_id string")
    assert {r["chunk_id"]: r["chunk_index"] for r in filters.chunk_index(rows).collect()} == {"y": 0, "x": 1, "z": 0}
    assert [r["chunk_id"] for r in filters.fetch_chunks(rows, ["x", "z"], "d").collect()] == ["x"]


def test_hash_and_terms(spark):
    def of(text):
        value = 2166136261
        for c in text:
            value = ((value ^ ord(c)) * 16777619) % 2**32
        return value

    texts = ["", "a", "question|node", "机器 学习 😀"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.rune_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: of(t) for t in texts}
    row = spark.createDataFrame([([" Alpha ", "THE", "ab", "", "机器人", "News"],)], "t array<string>")
    assert row.select(tx.greppable(F.col("t")).alias("x")).first()["x"] == ["Alpha", "机器人"]


def test_registry(spark, tmp_path):
    bases = Registry(spark, str(tmp_path / "bases"))
    with pytest.raises(KeyError):
        bases.resolve()
    one = bases.create(" First ")
    for name in ("", "  ", "fIRST"):
        with pytest.raises(ValueError):
            bases.create(name)
    with pytest.raises(ValueError):
        bases.remove(one["base_id"])
    two = bases.create("Second")
    assert bases.resolve()["name"] == "First" and bases.resolve(two["base_id"])["name"] == "Second"
    with pytest.raises(ValueError):
        bases.rename(two["base_id"], "first")
    bases.rename(one["base_id"], "FIRST")
    bases.set_counts(two["base_id"], 3, 9)
    (tmp_path / "bases" / "v00000099").mkdir()  # a version whose writer died
    assert [(r["name"], r["n_docs"], r["n_chunks"]) for r in bases.table().collect()] == [("FIRST", 0, 0), ("Second", 3, 9)]
    bases.remove(one["base_id"])
    assert [r["name"] for r in bases.table().collect()] == ["Second"]
    with pytest.raises(KeyError):
        bases.set_counts("none", 1, 1)
