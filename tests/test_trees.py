"""Section trees, directory trees and answers on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, chunking, directory_tree, index, section_tree

CHUNK = "doc_id string, pos long, chunk_id string, block_type string, text string, level int, font_size double"


@pytest.fixture(scope="module")
def handbook(spark):
    rows = [(24, "Handbook of the company"), (16, "Working hours"), (None, "Work begins at nine."), (16, "Leave and holidays"), (13, "Annual leave"), (None, "Every employee has twenty days of annual vacation."), (13, "Sick leave"), (None, "A doctor's note is needed."), (24, "Appendix of forms")]
    out = [("h", k, f"c{k}", "Text" if size is None else "Title", text, None, float(size or 0)) for k, (size, text) in enumerate(rows)]
    flat = [("f", k, f"c{k}", kind, text, None, 10.0) for k, (kind, text) in enumerate([("Title", "First part"), ("Text", "Some vacation text"), ("Title", "Second part")])]
    plain = [("p", 0, "c0", "Text", "No heading, vacation only", None, 0.0)]
    return spark.createDataFrame(out + flat + plain, CHUNK)


def test_section_tree(handbook):
    anchored = section_tree.anchors(handbook)
    tree = {(r["doc_id"], r["nid"]): r for r in section_tree.nodes(anchored, handbook).collect()}
    assert tree["h", "n4"]["title"] == "Annual leave" and tree["h", "n4"]["path"] == ["n0", "n1", "n3", "n4"] and tree["h", "n4"]["level"] == 3
    assert tree["h", "n6"]["parent"] == "n0" and {tree["f", n]["level"] for n in ("n1", "n2")} == {1} and ("p", "n1") not in tree
    held = {(r["doc_id"], r["chunk_id"]): r["nid"] for r in anchored.collect()}
    assert held["h", "c5"] == "n4" and held["p", "c0"] == "n0" and len(held) == handbook.count()


def test_declared_levels_are_clamped(spark):
    rows = [("d", 0, "c0", "Title", "Chapter", 2, 0.0), ("d", 1, "c1", "Title", "Deep", 5, 0.0), ("d", 2, "c2", "Title", "Next", 2, 0.0), ("d", 3, "c3", "Title", "Mid", 4, 0.0)]
    anchored = section_tree.anchors(spark.createDataFrame(rows, CHUNK))
    assert [(r["nid"], r["level"], r["parent"]) for r in anchored.orderBy("pos").collect()] == [("n1", 1, "n0"), ("n2", 2, "n1"), ("n3", 1, "n0"), ("n4", 2, "n3")]


def test_summaries_and_keywords(handbook):
    anchored = section_tree.anchors(handbook)
    tree = section_tree.nodes(anchored, handbook)
    say = {(r["doc_id"], r["nid"]): r["summary"] for r in section_tree.summaries(tree, anchored, handbook).collect()}
    assert say["h", "n0"].startswith("h — 含：Handbook") and say["f", "n1"] == "First part"
    words = {(r["doc_id"], r["nid"]): r["keywords"] for r in section_tree.node_keywords(section_tree.node_texts(tree, anchored, handbook)).collect()}
    assert "vacation" in words["h", "n4"]


def test_section_search(spark, handbook):
    q = spark.createDataFrame([("q", "annual leave vacation")], "query_id string, query string")
    c = handbook.withColumn("key", F.concat_ws("|", "doc_id", "chunk_id"))
    passages = index.bm25(c, q, "key").select("query_id", F.split("key", r"\|")[0].alias("doc_id"), F.split("key", r"\|")[1].alias("chunk_id"), "score", F.xxhash64("key").alias("pos"))
    out = section_tree.search(handbook, q, passages).orderBy("rank").collect()
    best = {(r["doc_id"], r["chunk_id"]): r for r in out}
    assert len(out) == passages.count() and {r["source"] for r in out} <= {"bm25", "both"}
    assert best["h", "c5"]["source"] == "both" and best["h", "c5"]["path"] == ["h", "Handbook of the company", "Leave and holidays", "Annual leave"]
    only = section_tree.search(handbook, q, passages, fallback=False).collect()
    assert only and {r["source"] for r in only} == {"tree"}


def test_documents_share_batches(spark, handbook):
    """Chunks and trees of many documents come out of one pass over sorted rows, not of a group in pandas for each; batches end within documents."""
    blocks = [(f"d{n}", k, 1, "Title" if k % 3 == 0 else "Text", f"Block {k} of document {n} holds some words", 1 + k // 3 if k % 3 == 0 else None, 0.0, [0.0] * 4) for n in range(7) for k in range(5)]
    b = spark.createDataFrame(blocks, "doc_id string, pos int, page_num int, block_type string, text string, level int, font_size double, bbox array<double>").repartition(3)
    made = {"chunks": chunking.to_chunks(b), "anchors": section_tree.anchors(handbook)}
    for found in made.values():
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    whole = {name: sorted(map(str, found.collect())) for name, found in made.items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        assert {name: sorted(map(str, found.collect())) for name, found in made.items()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    of = {n: made["chunks"].where(F.col("doc_id") == f"d{n}").orderBy("chunk_id").collect() for n in range(7)}
    assert all([(r["block_type"], r["n_blocks"], r["level"]) for r in rows] == [("Section", 3, 1), ("Section", 2, 2)] for rows in of.values())
    assert of[6][1]["text"].startswith("Block 3 of document 6") and of[6][1]["merged_from"] == ["b00004"]


def test_descent_and_picks():
    children = {"n0": [("n1", 0.0), ("n2", 2.0), ("n3", 1.0)], "n2": [("n4", 0.0), ("n5", 0.0)]}
    reached = section_tree.descend(children, {"n0", "n4"})
    assert [n for n, _ in reached] == ["n0", "n3", "n4"] and dict(reached)["n4"] == pytest.approx(1.2)
    own = {"n0": [("a1", 0.0), ("a2", 5.0)], "n4": [("a3", 1.0)], "n3": [("a4", 9.0), ("a5", 8.0)]}
    assert section_tree.pick(reached, own, 4) == ["a2", "a4", "a3", "a5"]


@pytest.fixture(scope="module")
def corpus(spark):
    words = {"sea": "ship sail wave", "sky": "cloud wind star", "kin": "mother child home"}
    rows = [(f"{folder}{k}", f"{top}/{folder}/{k}.txt", f"{text} {text.split()[k % 3]} x{k}") for top, folder in (("a", "sea"), ("a", "sky"), ("b", "kin")) for text in [words[folder]] for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id string, path string, text string")
    counts = index.postings(docs, "doc_id")
    return docs, counts


def test_directory_tree_by_folders_and_content(corpus):
    docs, counts = corpus
    nodes, leaves = directory_tree.build(docs.select("doc_id", "path"), counts, leaf=4)
    by_level = {}
    for r in nodes.collect():
        by_level.setdefault(r["level"], []).append((r["origin"], r["name"]))
    assert sorted(by_level[1]) == [("path", "kin"), ("path", "sea"), ("path", "sky")] and all(o == "cluster" for o, _ in by_level[2])
    assert sorted(r["doc_id"] for r in leaves.collect()) == sorted(r["doc_id"] for r in docs.collect())
    below = directory_tree.subtree(nodes, leaves)
    assert below.where("nid = 'd0'").count() == docs.count()
    flat, at = directory_tree.build(docs.select("doc_id", F.lit("x.txt").alias("path")), counts, branch=3, leaf=6)
    groups = {}
    for r in at.collect():
        groups.setdefault(r["nid"], set()).add(r["doc_id"][:3])
    assert {r["origin"] for r in flat.collect()} == {"root", "cluster"} and all(len(g) == 1 for g in groups.values())
    assert {r["origin"]: r["nodes"] for r in directory_tree.status(flat).collect()}[None] == flat.count()
    told = directory_tree.described(flat, at, directory_tree.weights(counts, docs.count()), docs.select("doc_id", F.col("doc_id").alias("name"))).where("nid = 'd0'").first()
    assert told["n_docs"] == 18 and told["summary"].startswith("18 篇，")


def test_directory_search(spark, corpus):
    docs, counts = corpus
    nodes, leaves = directory_tree.build(docs.select("doc_id", "path"), counts, leaf=4)
    q = spark.createDataFrame([("q", "ship wave cloud")], "query_id string, query string")
    scores = index.bm25(docs, q, "doc_id")
    out = directory_tree.search(nodes, leaves, scores, limit=6).orderBy("rank").collect()
    assert [r["source"] for r in out] == ["route"] * 3 + ["keyword"] * 3 and out[0]["doc_id"].startswith("sea")
    both = directory_tree.search(nodes, leaves, scores, limit=6, branches=2, net=0).collect()
    assert {r["doc_id"][:3] for r in both} == {"sea", "sky"}


def small_tree(spark, leaves, inner):
    nodes = spark.createDataFrame([("d0", None, 0)] + [(n, n.rpartition(".")[0], n.count(".")) for n in [*inner, *leaves]], "nid string, parent string, level int")
    return nodes, spark.createDataFrame([(n, x) for n, docs in leaves.items() for x in docs], "nid string, doc_id string")


def found(spark, tree, scores, **how):
    given = spark.createDataFrame([("q", x, float(s)) for x, s in scores.items()], "query_id string, doc_id string, score double")
    return [(r["doc_id"], r["source"]) for r in directory_tree.search(*tree, given, **how).orderBy("rank").collect()]


def test_directory_search_by_the_reference_rules(spark):
    tree = small_tree(spark, {"d0.1.1": ["1"], "d0.1.2": ["2"], "d0.2": ["3"]}, ["d0.1"])
    docs = lambda rows: [x for x, _ in rows]
    assert docs(found(spark, tree, {"2": 2, "3": 1}, limit=9, beam=2, net=0)) == ["2", "1", "3"]
    assert docs(found(spark, tree, {"2": 2, "3": 1}, limit=9, beam=1, net=0)) == ["2"]
    assert docs(found(spark, tree, {"2": 2, "3": 1}, limit=9, beam=2, net=0, steps=1)) == []  # the first choice is no leaf, and no step is left for it
    assert found(spark, tree, {"2": 2, "3": 1}, limit=2, beam=1, net=3) == [("2", "route"), ("3", "keyword")]
    # Leaves keep documents without a query term; a leaf opened first fills the limit and nothing is opened behind it.
    wide = small_tree(spark, {"d0.1": [f"a{k}" for k in range(8)], "d0.2": ["b"]}, [])
    assert docs(found(spark, wide, {"a3": 3, "b": 2}, limit=8, branches=2, net=0)) == ["a3", "b", "a0", "a1", "a2", "a4", "a5", "a6"]
    assert docs(found(spark, wide, {"a3": 3, "b": 2}, limit=5, beam=2, net=0)) == ["a3", "a0", "a1", "a2", "a4"]
    assert found(spark, wide, {"a3": 3, "b": 2}, limit=5, beam=2, net=3)[-1] == ("b", "keyword")
    # Ties go by the number of the child.
    many = small_tree(spark, {f"d0.{k}": [f"x{k}"] for k in range(1, 13)}, [])
    assert docs(found(spark, many, {"x5": 1}, limit=4, branches=4, net=0)) == ["x5", "x1", "x2", "x3"]


def test_directions_of_a_decider(spark):
    nodes, leaves = small_tree(spark, {f"d0.{k}": [f"x{k}"] for k in range(1, 5)}, [])
    frontier = spark.createDataFrame([("q", "d0")], "query_id string, nid string")
    scores = spark.createDataFrame([("q", "d0.2", 5.0), ("q", "d0.4", 3.0), ("q", "d0.1", 1.0)], "query_id string, nid string, score double")
    order = lambda **k: [(r["child"][-1], r["by"]) for r in directory_tree.directions(frontier, nodes, scores, **k).orderBy("place").collect()]
    choice = spark.createDataFrame([("q", f"d0.{k}", s, 0.4) for k, s in ((1, 0.9), (2, 0.1), (3, 0.95), (4, 0.2))], "query_id string, nid string, choice_score double, probability double")
    assert "".join(c for c, _ in order()) == "2413"
    assert order(decided=choice) == [(c, "decider") for c in "3142"]
    assert "".join(c for c, _ in order(decided=choice, candidates=2)) == "4213"  # 4 and 2 are asked about, the others stay behind them
    assert order(decided=choice, least=0.5) == [(c, "keyword") for c in "2413"]


def test_best_coverage_is_brute_force(spark):
    import random
    from itertools import combinations

    draw = random.Random(4)
    leaves, n = {}, 0
    for k in range(9):
        size = draw.randint(1, 6)
        leaves[f"l{k}"] = [f"x{n + i}" for i in range(size)]
        n += size
    gold = {f"q{k}": draw.sample([f"x{i}" for i in range(n)], draw.randint(1, 9)) for k in range(8)}
    at = spark.createDataFrame([(name, x) for name, docs in leaves.items() for x in docs], "nid string, doc_id string")
    g = spark.createDataFrame([(q, x) for q, docs in gold.items() for x in docs], "query_id string, doc_id string")
    for m, budget in ((1, 4), (2, 7), (4, 11), (4, 100)):
        best = {q: max((len(set(docs) & {x for c in combo for x in leaves[c]}) for size in range(1, m + 1) for combo in combinations(leaves, size) if sum(len(leaves[c]) for c in combo) <= budget), default=0) for q, docs in gold.items()}
        assert {r["query_id"]: r["best"] for r in directory_tree.best_coverage(g, at, m, budget).collect()} == best


def test_citations(spark):
    text = "`chunk_id: c1` says\nplain chunk_id: c2, chunk_id: zz end\nchunk_id: c1 [ID:0]\nnothing"
    marked = "\n".join(answers.mark_line(line, {"c1": 0, "c2": 1}) for line in text.split("\n"))
    assert marked == "`chunk_id: c1` [ID:0] says\nplain chunk_id: c2, chunk_id: zz [ID:1] end\nchunk_id: c1 [ID:0]\nnothing"
    assert answers.expand_group("a [ID:1, ID:7] [ID: 2 , ID: 0]", 3) == "a [ID:1] [ID:2][ID:0]"
    assert answers.resolve("x [ID:5] y [ID:2] z [ID:5] [ID:9]", list("abcdef"), ["f", "a"]) == ("x [ID:0] y  z [ID:0] ", ["f"])
    df = spark.createDataFrame([(text, ["c1", "c2"])], "a string, i array<string>")
    row = df.select(answers.insert_markers("a", "i").alias("m"), answers.cited_chunks(F.col("a")).alias("c"), answers.compact_citations(F.lit("[ID:1, ID:0]"), "i", "i").alias("k")).first()
    assert row["m"] == marked and row["c"] == ["c1", "c2", "zz"] and row["k"]["answer"] == "[ID:1][ID:0]" and row["k"]["cited"] == ["c2", "c1"]


def test_snippets():
    short = "Some words\nhere"
    assert answers.snippet(short, 0, 4) == ("Some words here", False) and answers.preview(short) == ("Some words here", False)
    paragraphs = "\n\n".join(f"Paragraph {k} " + "word " * 60 for k in range(10))
    at = paragraphs.index("Paragraph 5")
    shown, cut = answers.snippet(paragraphs, at, at + 5)
    assert cut and shown.startswith("...Paragraph 5") and "Paragraph 6" not in shown
    long = " ".join(f"Sentence number {k} stands here." for k in range(200))
    at = long.index("number 100 ")
    shown, cut = answers.snippet(long, at, at + 6)
    assert cut and "number 100 " in shown and shown.startswith("...Sentence") and shown.endswith("here....") and len(shown) < answers.WINDOW + answers.TOLERANCE + 6
    wide = "start " + "x " * 700 + "end"
    assert answers.snippet(wide, 0, len(wide)) == (wide, False) and answers.term_span("aXbxa", ["X"]) == (1, 4)


def test_decision_state_and_enumerations(spark):
    p = spark.createDataFrame([("q", 1, "a" * 10), ("q", 2, "  "), ("q", 3, "b" * 10), ("q", 4, "c" * 50), ("r", 1, "d" * 99)], "query_id string, rank int, text string")
    state = {r["query_id"]: r["state"] for r in answers.decision_state(p, 30).collect()}
    assert state == {"q": "a" * 10 + "\n\n" + "b" * 10, "r": "d" * 30}
    slots = spark.createDataFrame([("a", 0, "List", "A｜B, a", ["bought", " "]), ("a", 1, "date", None, ["Bought", "sold"]), ("b", 0, "count", "x", ["did"]), ("c", 0, "person", "x", [])], "query_id string, at int, type string, subject string, terms array<string>")
    assert {r["query_id"]: r["asks"] for r in answers.coverage_gate(slots).collect()} == {"a": True, "b": False, "c": False}
    assert [r["operand"] for r in answers.operands(slots).where("query_id = 'a'").orderBy("at").collect()] == ["A", "B", "bought", "sold"]
    m = spark.createDataFrame([("q", 0, "Ann", None, "x"), ("q", 1, " ann ", "c1", "y  z"), ("q", 2, "ANN", "c2", ""), ("q", 3, "Bo", "c3", None)], "query_id string, at int, name string, chunk_id string, quote string")
    merged = answers.merged_members(m)
    assert [r["name"] for r in merged.orderBy("at").collect()] == ["ann", "Bo"]
    assert answers.member_record(merged).first()["record"] == "- ann — y z\n- Bo\nEnumerated members across all evidence: 2"
