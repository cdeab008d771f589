"""Plans and sizes that the larger tables depend on."""

import re

from pyspark.sql import functions as F

from quarry.functions.text import terms
from quarry.operators import directory_tree, index, rounds, stored
from quarry.storage import fresh_dir, spread, written


def made_index(spark, texts):
    own = stored.TextIndex(spark, fresh_dir(spark, "text-index"))
    own.add(spark.createDataFrame([(i, f"d{i}", "c0", t) for i, t in enumerate(texts)], "pos long, doc_id string, chunk_id string, text string"))
    return own


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_cut_once_and_no_row_carries_its_text(spark):
    texts = [(0, "a", "b bb BB é xé 1 22 bb"), (1, "b", "漢字語 ab 漢"), (2, "c", "⹿ ⺀ \U00020000 z"), (3, "d", None), (4, "e", "z")]
    rows = stored.term_counts(spark.createDataFrame(texts, "pos long, doc_id string, text string"))
    found = sorted((r.pos, r.term, r.tf, r.dl) for r in rows.collect())
    assert found[:4] == [(0, "22", 1, 6), (0, "bb", 3, 6), (0, "xé", 1, 6), (0, "é", 1, 6)]
    assert [r[1:3] for r in found if r[0] == 1] == [("ab", 1), ("字語", 1), ("漢", 1), ("漢字", 1)]
    assert [r[1] for r in found if r[0] == 2] == ["⺀", "\U00020000"] and {r[0] for r in found} == {0, 1, 2}
    read = spark.createDataFrame(texts, "pos long, doc_id string, text string").repartition(1)
    assert optimized(stored.term_counts(read)).count("regexp_extract_all") == optimized(read.select(terms(F.col("text")).alias("t"))).count("regexp_extract_all")
    generate = next(line for line in stored.term_counts(read)._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line)
    assert not re.search(r"\bs#", generate), generate


def test_scores_are_summed_where_postings_meet_without_a_shuffle_of_contributions(spark):
    own = made_index(spark, ["aa bb cc", "aa aa bb", "cc dd", "bb"])
    asked = spark.createDataFrame([("q1", "aa bb"), ("q2", "bb cc zz")], "query_id string, query string")
    scores = stored.bm25(own, asked)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and plan.count("Exchange hashpartitioning(pos") == 1
    chunks = own.chunks
    wanted = {(r.query_id, r.pos): round(r.score, 9) for r in index.bm25(chunks, asked).collect()}
    assert {(r.query_id, r.pos): round(r.score, 9) for r in scores.collect()} == wanted


def test_a_term_is_looked_for_in_the_vocabulary(spark, monkeypatch):
    texts = ["Banana an", "ANnex 漢字語", "x ban-an", "İan 漢", "nothing", "canoe"]
    own = made_index(spark, texts)
    asked = spark.createDataFrame([("an",), ("AN",), ("字",), ("漢字",), ("e",), ("n-a",), ("zz",)], "argument string")
    wanted = {(a, i) for (a,) in asked.collect() for i, t in enumerate(texts) if a.lower() in t.lower()}
    assert {tuple(r) for r in rounds.holders(own, asked).collect()} == wanted
    first = {(a, i) for a, i in wanted if sum(b == a and j < i for b, j in wanted) < 2}
    assert {tuple(r) for r in rounds.holders(own, asked, 2).collect()} == first
    monkeypatch.setattr(rounds, "occurrences", None)  # texts are not read for terms
    calls = spark.createDataFrame([("q", 1, "grep", "an")], "query_id string, turn int, tool string, argument string")
    assert sorted(r.pos for r in rounds.executed(own, calls, probed=3).collect()) == [0, 1, 2]


def test_terms_are_weighed_only_for_clusters(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"a/b{i % 2}/{i}.txt") for i in range(6)], "doc_id string, path string")
    counts = docs.select("doc_id", F.lit("t").alias("term"), F.lit(1).alias("tf"))
    monkeypatch.setattr(directory_tree, "weights", None)
    nodes, leaves = directory_tree.build(docs, counts, leaf=10)
    assert nodes.count() == 3 and leaves.count() == 6


def test_cosines_are_held_a_slice_at_a_time(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("pos"), F.array(*[F.cos(F.col("id") * k) for k in (1, 2, 3)]).alias("embedding"))
    asked = rows.where("pos % 5 = 0").select(F.concat(F.lit("q"), "pos").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = {tuple(r) for r in index.dense(rows, asked, 4).collect()}
    monkeypatch.setattr(index, "SCORES", 100)
    assert {tuple(r) for r in index.dense(rows, asked, 4).collect()} == whole and len({r[0] for r in whole}) == 12


def test_a_file_of_one_row_group_is_dealt_out(spark):
    one = written(spark.range(1000).select(F.col("id").alias("pos")).coalesce(1), "one")
    assert spread(one, "pos").rdd.getNumPartitions() >= 4
    even = written(spark.range(0, 1000, 1, 4).select(F.col("id").alias("pos")), "even")
    assert spread(even, "pos") is even or spread(even, "pos").count() == 1000


def test_clusters_are_those_of_plain_k_means_and_centroids_are_never_joined_with_postings(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    w = np.round(rng.random((40, 12)) * (rng.random((40, 12)) < 0.25), 3)
    w[7] = 0
    group = [f"g{i % 3}" for i in range(40)]
    members = spark.createDataFrame([(group[i], f"d{i:02}") for i in range(40)], "nid string, doc_id string")
    weighed = spark.createDataFrame([(f"d{i:02}", f"t{t}", float(w[i, t])) for i in range(40) for t in range(12) if w[i, t]], "doc_id string, term string, w double")
    wanted = {}
    for g in ("g0", "g1", "g2"):
        ids = [i for i in range(40) if group[i] == g]
        own, centroids, part = w[ids], w[ids][[c * (len(ids) // 4) for c in range(4)]], None
        for _ in range(8):
            size = np.outer(np.linalg.norm(own, axis=1), np.linalg.norm(centroids, axis=1))
            cosine = np.round(np.divide(own @ centroids.T, size, out=np.zeros_like(size), where=size > 0), 12)
            now = cosine.argmax(1)
            if part is not None and (now == part).all():
                break
            part = now
            centroids = np.stack([own[part == c].mean(0) if (part == c).any() else centroids[c] for c in range(4)])
        order = sorted(set(part.tolist()), key=lambda c: (-(part == c).sum(), c))
        wanted |= {(g, f"d{i:02}"): order.index(p) for i, p in zip(ids, part.tolist(), strict=True)}
    labels, put = [], directory_tree.written
    monkeypatch.setattr(directory_tree, "written", lambda df, label: labels.append(label) or put(df, label))
    assert {(r.nid, r.doc_id): r.part for r in directory_tree.split_groups(members, weighed, 4).collect()} == wanted
    assert "centroids" not in labels


def test_names_meet_postings_once_and_rare_terms_apart(spark, monkeypatch):
    import math
    import random

    from quarry import storage

    random.seed(3)
    texts = {f"d{i:02}": [f"t{min(int(random.expovariate(0.2)), 30)}" for _ in range(random.randint(3, 30))] for i in range(40)}
    place = {x: f"d0.{1 + i % 3}.{1 + i % 2}" if i % 3 else "d0.1" for i, x in enumerate(texts)}
    known = sorted({".".join(p.split(".")[:k]) for p in place.values() for k in range(1, p.count(".") + 2)})
    nodes = spark.createDataFrame([(n, n.rpartition(".")[0] or None, n.count(".")) for n in known], "nid string, parent string, level int")
    leaves = spark.createDataFrame([(p, x) for x, p in place.items()], "nid string, doc_id string")
    counts = spark.createDataFrame([(x, t, w.count(t)) for x, w in texts.items() for t in set(w)], "doc_id string, term string, tf int")
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    df = lambda docs: {t: sum(t in texts[x] for x in docs) for t in {t for x in docs for t in texts[x]}}
    of_all, wanted = df(texts), {}
    for n in known[1:]:
        own = [x for x, p in place.items() if p == n or p.startswith(n + ".")]
        here = df(own)
        score = {x: sum(texts[x].count(t) * idf(40, of_all[t]) * idf(len(own), here[t]) for t in set(texts[x])) for x in own}
        wanted[n] = " / ".join(sorted(own, key=lambda x: (-round(score[x], 9), x))[:2])
    titles = leaves.select("doc_id", F.col("doc_id").alias("name"))
    rows, put = {}, directory_tree.written

    def noted(table, label):
        out = put(table, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(directory_tree, "written", noted)
    for room in (1 << 20, 3000, 0):
        monkeypatch.setattr(storage, "BROADCAST_BYTES", room)
        told = directory_tree.sibling_names(nodes, leaves, directory_tree.weights(counts, 40), titles)
        assert {r.nid: r.titles for r in told.collect()} == wanted
    assert max(rows.values()) <= counts.count()  # no row for each level above a posting


def test_a_round_of_k_means_sums_many_documents_a_row(spark, monkeypatch):
    members = spark.range(90).select(F.concat(F.lit("g"), F.col("id") % 2).alias("nid"), F.format_string("d%02d", "id").alias("doc_id"))
    weighed = spark.range(900).select(F.format_string("d%02d", F.col("id") % 90).alias("doc_id"), F.concat(F.lit("t"), F.col("id") * 7 % 31).alias("term"), (1 + F.col("id") * 13 % 5).cast("double").alias("w"))
    weighed = weighed.groupBy("doc_id", "term").agg(F.sum("w").alias("w"))
    rows, put = {}, directory_tree.written

    def noted(table, label):
        out = put(table, label)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    monkeypatch.setattr(directory_tree, "written", noted)
    whole = {tuple(r) for r in directory_tree.split_groups(members, weighed, 3).collect()}
    assert len(whole) == 90 and rows["products"] == 2 + 1
    for name, n in (("HELD", 40), ("POSTINGS_IN_TASK", 60), ("SPAN", 7)):
        monkeypatch.setattr(directory_tree, name, n)
    assert {tuple(r) for r in directory_tree.split_groups(members, weighed, 3).collect()} == whole
    assert rows["products"] == 2 + 13
