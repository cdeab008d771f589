"""Operators 11 to 13 against brute force, on odd rows, and the queries whole."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fim, licenses, periodic

DOCS = "doc_id long, text string, n long, words string, k long, f long, row string, fim string, cut long, runs string, label string"
CLASH = (7, "words", 1, 2, "row", "fim", 3, "runs", "label")


def table(spark, texts, keys=None):
    return spark.createDataFrame([(k, t, *CLASH) for k, t in zip(keys or range(len(texts)), texts, strict=True)], DOCS)


# ---------------------------------------------------------------- periodic runs


def brute_runs(x, least=24):
    """Every maximal stretch of every period, under its smallest period."""
    found = {}
    for p in range(1, len(x) // 3 + 1):
        start = 0
        while start < len(x) - p:
            end = start
            while end < len(x) - p and x[end] == x[end + p]:
                end += 1
            if end + p - start >= max(least, 3 * p):
                found.setdefault((start, end + p), p)
            start = end + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_texts(n, seed=3):
    draw = random.Random(seed)
    for _ in range(n):
        x = []
        for _ in range(draw.randint(0, 5)):
            if draw.random() < 0.5:
                x += draw.choices(range(draw.choice([1, 2, 5, 50])), k=draw.randint(0, 60))
            else:
                unit = draw.choices(range(draw.choice([1, 2, 3, 30])), k=draw.randint(1, 25))
                x += (unit * draw.randint(1, 12))[: draw.randint(1, 200)]
        yield np.array(x, np.int32)


@pytest.mark.parametrize("flat", [periodic.FLAT, 8])
def test_op11_is_brute_force(flat):
    some = 0
    for x in periodic_texts(400):
        for least in (24, 1):
            want = brute_runs(x.tolist(), least)
            assert periodic.find_runs(x, least, flat) == want
            some += len(want)
    assert some > 1000


def test_op11_long_texts_take_few_steps():
    """A million equal words, many runs in a row, and random words: all within seconds."""
    assert periodic.find_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    blocks = np.repeat(np.arange(4000, dtype=np.int32), 25)
    assert periodic.find_runs(blocks) == [(25 * k, 25, 1) for k in range(4000)]
    noise = np.random.default_rng(1).integers(0, 50, 100_000).astype(np.int32)
    noise[40_000:70_000] = np.tile(noise[40_000:50_000], 3)
    found = periodic.find_runs(noise)
    assert len(found) == 1 and found[0][2] == 10_000 and found[0][0] <= 40_000 and sum(found[0][:2]) >= 70_000


def op11_row(key, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_op11_query_is_brute_force(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for k, t in docs:
        assert found[k] == op11_row(k, t), k
    assert sum(v[0] for v in found.values()) > 5


def test_op11_odd_rows(spark):
    texts = [None, "", " \n\t ", "a b " * 30, "a b " * 30, "x" * 100_000, "é 漢\x0b" * 12, "one two", "so \x1c so " * 10]
    docs = table(spark, texts + texts[3:4], [0, 1, 2, 3, None, 5, 6, 7, 8, 3])
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == 10 and len([r for r in rows if r["doc_id"] == 3]) == 2
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_words"] == by[1]["n_words"] == by[2]["n_words"] == 0 and by[0]["best"] is None and by[0]["collapsed"] == ""
    assert tuple(by[3]["best"]) == tuple(by[None]["best"]) == (0, 60, 2) and by[3]["collapsed"] == "a b"
    assert tuple(by[6]["best"]) == (0, 24, 2) and by[5]["n_words"] == 1 and tuple(by[8]["best"]) == (0, 30, 3)
    assert periodic.best_run([(0, 24, 8), (30, 24, 8), (60, 30, 10)]) == (0, 24, 8)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- licenses


def test_op12_finds_whole_and_altered_texts_and_phrases(spark):
    mit = dict((t, label) for label, t in licenses.TEXTS)
    long = next(t for t in mit if t.startswith("permission is hereby granted"))
    w = long.split()
    other = " ".join(w[:9] + ["surely"] + w[9:17] + w[18:])  # a word put in, one left out
    texts = [None, "", "CC BY! and cc--by, General public license; general public", long.upper(), other, " ".join(w[:14]), "All rights\nreserved. " * 5000, "ccby cc  by", "é cc by", "Released under the MIT License.", "by cc all rights rights reserved"]
    rows = {r["doc_id"]: r for r in licenses.license_scan(table(spark, texts)).collect()}
    assert [rows[k]["n_phrases"] for k in range(len(texts))] == [0, 0, 3, 0, 0, 0, 5000, 1, 1, 0, 0]
    assert rows[2]["phrase_labels"] == ["cc-by", "gpl"] and (rows[2]["first_word"], rows[2]["last_word"]) == (0, 5)
    assert rows[3]["labels"] == rows[4]["labels"] == rows[9]["labels"] == ["mit"] and rows[3]["cover"] == 1.0 and 0.8 <= rows[4]["cover"] < 1
    assert rows[5]["labels"] == [] and rows[5]["cover"] == 0
    assert (rows[6]["first_word"], rows[6]["last_word"], rows[6]["n_words"]) == (0, 14_997, 15_000)
    assert rows[0]["n_words"] == 0 and rows[0]["first_word"] is None


def test_op12_odd_rows(spark):
    docs = table(spark, ["cc by", "cc by", "all rights reserved", "cc by", None], [3, 3, 3, None, None])
    rows = sorted(((r["doc_id"], r["n_phrases"], r["labels"]) for r in licenses.license_scan(docs).collect()), key=repr)
    assert rows == sorted([(3, 1, ["cc-by"]), (3, 1, ["cc-by"]), (3, 1, ["reserved"]), (None, 1, ["cc-by"]), (None, 0, [])], key=repr)
    assert licenses.license_scan(docs.limit(0)).count() == 0
    found = licenses.license_scan(docs, phrases=[("x", "rights reserved")], texts=[])
    assert sum(r["n_phrases"] for r in found.collect()) == 1


def test_op12_runs_no_python(spark):
    plan = licenses.op12_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- fill in middle


def op13_row(key, text):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(v % (len(u) + 1) for v in h[:2])
    p, m, s = ("".join(v) for v in (u[:a], u[a:b], u[b:]))
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    if not t or any(v in t for v in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, sha(t), sha(t)
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), sha(out), sha(t)


def test_op13_query_is_brute_force(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in fim.op13_fill_in_middle(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs) and {v[1] for v in found.values()} == {"plain", "psm", "spm"}
    for k, t in docs:
        assert found[k] == op13_row(k, t), k


def test_op13_units_are_those_of_the_pattern():
    draw = random.Random(5)
    own = fim.UnitOffsets(most=50, longest=6)
    for _ in range(3000):
        t = "".join(draw.choices([*" \n\t\r\x00\x85\xa0abZé漢😀1<>_", "word", "  ", "<P>", "é"], k=draw.randint(0, 25)))
        assert own.of(t).tolist() == [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)]
    assert len(own) <= 50
    assert len(own.of("x" * 300_000)) == 1 and len(own.of("漢" * 50_000)) == 50_000


def test_op13_odd_rows(spark):
    texts = [None, "", "a", "<P", "a<S>b", "tail <", "P>S>M>", "x" * 50_000, "<<P<S<M 漢😀 word" * 30] * 6
    keys = [*range(len(texts) - 2), None, 3]
    docs = table(spark, texts, keys)
    made = fim.fill_in_middle(docs)
    assert made.columns == [c for c in docs.columns if c != "fim"] + ["fim"] and made.select("cut", "row", "n").distinct().collect() == [(3, "row", 7)]
    rows = made.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, out, _ = op13_row(r["doc_id"], r["text"])
        got = r["fim"]
        assert (got["n"], got["form"], got["prefix"] and len(got["prefix"]), hashlib.sha256(got["output"].encode()).hexdigest()) == (n, form, p and p or got["prefix"] and 0, out)
        assert r["back"] == (r["text"] or "")
        assert form == "plain" or got["prefix"] + got["middle"] + got["suffix"] == r["text"]
    assert {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
