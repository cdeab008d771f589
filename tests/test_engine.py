"""The reference operators on small fixtures."""

import duckdb
import glob
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunking, evidence, filters, geometry, index
from quarry.plans.queries import ORACLE_SQL, QUERIES
from quarry.sources import files
from quarry.streaming import stream

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, wanted", [("Hello World, go1", ["hello", "world", "go1"]), ("机器学习", ["机器", "器学", "学习"]), ("猫", ["猫"]), ("é e", ["é"]), ("a文b", ["文"]), ("", [])])
def test_terms(spark, text, wanted):
    assert one(spark, tx.terms(F.col("t")), t=text) == wanted


def test_bm25_ranks_the_document_with_both_terms_first(spark):
    c = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta")], "pos long, text string")
    q = spark.createDataFrame([("q", "alpha beta"), ("none", "omega")], "query_id string, query string")
    rows = index.top_k(index.bm25(c, q), 5, [F.desc("score"), F.col("pos")]).orderBy("rank").collect()
    assert [r["pos"] for r in rows] == [1, 2]


def test_cosine_edges(spark):
    for a, b, wanted in (([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], None), ([1.0], [1.0, 0.0], None)):
        assert one(spark, index.cosine(F.col("a"), F.col("b")), a=a, b=b) == wanted


def test_fusion_bounds(spark):
    leg = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, pos long, rank int")
    top = index.fuse(leg, leg).agg(F.max("score")).first()[0]
    assert top == pytest.approx(2 / 61)


def test_unknown_fields_and_operators_are_errors():
    for c in (("author", "=", "x"), ("doc_id", "~", "x")):
        with pytest.raises(ValueError):
            filters.condition(*c)


def test_empty_values_match_everything(spark):
    v = spark.createDataFrame([("a", ""), ("b", "2025-01-01 00:00:00")], "doc_id string, indexed_at string")
    assert filters.metadata_filter(v, [("doc_id", "contains", None)]).count() == 2
    assert filters.metadata_filter(v, [("doc_id", "in", "a")]).count() == 0
    assert filters.metadata_filter(v, [("indexed_at", "empty")]).count() == 1


def test_grep_literal_is_quoted_and_case_blind(spark):
    c = spark.createDataFrame([(1, "a.b A.B\naxb"), (2, "none")], "pos long, text string")
    assert [tuple(r) for r in filters.grep(c, "a.b").collect()] == [(1, 2, "a.b A.B")]


def blocks(spark, rows):
    """Blocks of one document from ``(type, text[, box[, page]])``."""
    full = [("d", k, *(r[3:] or (1,)), r[0], r[1], (r[2:3] or ([0.0] * 4,))[0], None, 0.0) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id string, pos int, page_num int, block_type string, text string, bbox array<double>, level int, font_size double")


def test_chunks_keep_all_text(spark):
    rows = [("Title", "Heading one here"), ("Text", "Some longer text of the body."), ("Caption", "Table 1: numbers"), ("Table", "| a | b |"), ("Text", "x")]
    out = chunking.to_chunks(blocks(spark, rows)).orderBy("chunk_id").collect()
    assert [r["block_type"] for r in out] == ["Section", "TableWithCaption"]


def test_sentences_are_packed_and_cut():
    assert chunking.split_sentences("Aaa. Bbb. Ccc.", 9) == ["Aaa. Bbb.", "Ccc."]
    assert chunking.split_sentences("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_suppression_and_reading_order(spark):
    b = spark.createDataFrame([(1, 1, "T", 0.9, [0.0, 0.0, 10.0, 10.0]), (1, 2, "T", 0.8, [0.0, 0.0, 10.0, 9.0]), (1, 3, "F", 0.7, [0.0, 0.0, 10.0, 10.0])], "page_id int, box_id int, label string, score double, bbox array<double>")
    assert sorted(r["box_id"] for r in geometry.suppress(b).collect()) == [1, 3]
    assert geometry.reading_order([[100, 0, 150, 10], [0, 50, 50, 60], [0, 0, 50, 10]]) == [2, 1, 0]


def test_pool_keeps_equal_text_of_other_documents(spark):
    a = spark.createDataFrame([(1, "a", "c1", "Same  text"), (2, "a", "c1", "Same  text"), (3, "a", "c2", "same text"), (4, "b", "c1", "Same text")], "arrival int, doc_id string, chunk_id string, text string")
    assert sorted(r["arrival"] for r in evidence.pool(a).collect()) == [1, 4]


def test_citations(spark):
    assert one(spark, evidence.cited_ids(F.col("t")), t="a [ID:3] b [ID:1, ID:3] c [ID: 12]") == ["3", "1", "12"]


def test_markdown_blocks(spark):
    t = spark.createDataFrame([("d", ".md", "# Head\n\nBody one\n\n## Sub"), ("e", ".txt", "# not a head")], "doc_id string, suffix string, text string")
    rows = files.text_blocks(t).orderBy("doc_id", "pos").collect()
    assert [(r["block_type"], r["text"], r["level"]) for r in rows] == [("Title", "Head", 1), ("Text", "Body one", None), ("Title", "Sub", 2), ("Text", "# not a head", None)]


def test_fragments_lose_no_text(spark):
    f = spark.createDataFrame([("s", i, i * 50, c) for i, c in enumerate("abcdef")], "stream_id string, seq int, ts_ms long, text string")
    frames = stream.coalesce_fragments(f).orderBy("frame").collect()
    assert [r["text"] for r in frames] == ["a", "bcd", "ef"]
    *done, (_, left, _, _) = stream.frames([(0, "a"), (10, "bb"), (20, "cc"), (125, "d"), (140, "e")], 120, most_bytes=4)
    assert [t for t, _ in done] == ["a", "bbcc", "d"] and left == "e"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c1", "2025-01-01 00:00:00"), ("a", "c1", "2025-01-01 00:01:00"), ("b", "c1", "2025-01-01 00:02:00")], "doc_id string, chunk_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    arriving = stream.pool_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.index_stream(arriving, lambda batch, n: got.extend(r["doc_id"] for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == ["a", "b"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    a = c.sql(ORACLE_SQL[name]).df()
    b = QUERIES[name](spark, SF).toPandas()
    assert set(a.columns) == set(b.columns)
    show = lambda df: sorted(tuple("" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[list(a.columns)].itertuples(index=False))
    assert show(a) == show(b)


def test_rules_of_texts(spark):
    say = lambda f, **v: one(spark, f, **v)
    assert say(tx.gist(F.col("t"), 20), t="One two; three four five six") == "One two; three four […]"
    assert say(tx.gist(F.col("t"), 20), t="aaaa bbbb cccc; ddd eeee ffff") == "aaaa bbbb cccc; […]"
    assert say(tx.first_sentence(F.col("t"), 10), t="Short. Rest of a long text") == "Short." and say(tx.first_sentence(F.col("t"), 10), t="no stop in here") == "no stop in…"
    assert say(tx.display_name(F.col("t")), t="ccf355_A_long_name.pdf") == "A long name" and say(tx.display_name(F.col("t")), t="x" * 70) == "x" * 59 + "…"
    assert say(tx.is_short(F.col("t")), t="  ") and not say(tx.is_short(F.col("t")), t="word " * 20) and say(tx.is_short(F.col("t")), t="漢字 " + "word " * 6)
    assert say(tx.sentences(F.col("t")), t="甲；乙。c d! e\nf") == ["甲；", "乙。", "c d!", "e", "f"]


@pytest.mark.parametrize("question, wanted", [("Compare A and B", "complex"), ("What is the relationship?", "simple"), ("A vs B", "complex"), ("一? 二？", "complex"), ("哪些人", "complex"), ("x" * 41, "complex"), ("Who?", "simple")])
def test_routes(spark, question, wanted):
    from quarry.operators import routing

    assert one(spark, routing.route(F.col("q")), q=question) == wanted


def test_dates_that_do_not_exist_are_texts(spark):
    v = spark.createDataFrame([("a", "2025-13-40"), ("b", "2025-01-02")], "doc_id string, indexed_at string")
    assert [r["doc_id"] for r in filters.metadata_filter(v, [("indexed_at", ">", "2025-01-01")]).collect()] == ["b"]
    assert filters.metadata_filter(v, [("indexed_at", ">", "2025-13-39")]).count() == 1


def test_manifest_ties_go_to_the_least_md5(spark):
    from quarry.operators import manifest

    m = spark.createDataFrame([("a", "zb", 1, "p", 1), ("a", "az", 1, "p", 1), ("a", "ba", 0, "p", 1)], "doc_id string, md5 string, indexed_at int, pipeline string, chunk_count int")
    assert manifest.newest(m).first()["md5"] == "az"
    assert {r["doc_id"] for r in manifest.forget(m, spark.createDataFrame([("ba",), ("no",)], "value string")).collect()} == {"a"}


def test_stored_index(spark, tmp_path):
    from quarry.operators import stored

    rows = [(1, "a", "c0", "Alpha beta"), (2, "a", "c1", "alpha alpha gamma"), (3, "b", "c0", "delta"), (4, "b", "c1", "   "), (5, "a", "c0", "again")]
    own, shape = stored.TextIndex(spark, f"file://{tmp_path}/ix"), "pos long, doc_id string, chunk_id string, text string"
    assert own.add(spark.createDataFrame(rows, shape)) == 3 and own.add(spark.createDataFrame(rows, shape)) == 0
    q = spark.createDataFrame([("q", "alpha beta"), ("none", "omega")], "query_id string, query string")
    order = lambda: [r["pos"] for r in index.top_k(stored.bm25(own, q), 5, [F.desc("score"), F.col("pos")]).orderBy("rank").collect()]
    assert order() == [1, 2]
    assert own.add(spark.createDataFrame([(6, "c", "c0", "beta beta")], shape)) == 1 and order() == [1, 6, 2]
    own.remove(spark.createDataFrame([("a",)], "doc_id string"))
    assert order() == [6] and {r["term"]: r["df"] for r in own.df.collect()} == {"delta": 1, "beta": 1}
    assert own.replace(spark.createDataFrame([(7, "c", "c0", "epsilon alpha")], shape)) == 1 and order() == [7]
    s = stored.TextIndex(spark, own.root).stats.first()
    assert (s["n"], s["total"], s["avgdl"]) == (2, 3, 1.5)
    fresh = index.bm25(own.chunks, q).collect()
    assert {(r["pos"], round(r["score"], 9)) for r in stored.bm25(own, q).collect()} == {(r["pos"], round(r["score"], 9)) for r in fresh}


def test_dense_blocks(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0, -1.0]) for k in range(40)] + [(50, [0.0, 0.0, 0.0]), (51, None), (52, [1.0])], "pos long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "query_id string, query_vector array<float>")
    got = index.top_k(index.dense(v, q, 3, rows=7), 3, [F.desc(F.round("score", 9)), F.col("pos")]).orderBy("query_id", "rank").collect()
    assert [r["pos"] for r in got] == [39, 38, 37, 0, 1, 2] and got[0]["score"] == pytest.approx(39 / (39**2 + 2) ** 0.5)


def test_chunking_rules(spark):
    box = lambda x, y, w=100, h=20: [float(v) for v in (x, y, x + w, y + h)]
    kinds = lambda rows, **k: [(r["block_type"], r["text"]) for r in chunking.to_chunks(blocks(spark, rows), **k).orderBy("chunk_id").collect()]
    assert kinds([("Title", "A heading alone"), ("Table", "| a | b | c |")]) == [("Title", "A heading alone"), ("Table", "| a | b | c |")]
    assert kinds([("Table", "| a | b | c |", box(0, 0)), ("Text", "Table 4: Results of ablation", box(0, 25))]) == [("TableWithCaption", "Table 4: Results of ablation\n| a | b | c |")]
    assert [k for k, _ in kinds([("Table", "| a | b | c |", box(0, 0)), ("Caption", "Table 4: far away", box(300, 25))])] == ["Table", "Caption"]
    assert kinds([("Text", "left column text", box(0, 100)), ("Text", "right column text", box(300, 0))]) == [("Text", "left column text"), ("Text", "right column text")]
    assert kinds([("Text", "first page text"), ("Text", "second page text", [0.0] * 4, 2)]) == [("Text", "first page text"), ("Text", "second page text")]
    head = [("Reference", "running head")] * 3
    assert kinds([*head, ("Title", "running head"), ("Text", "12"), ("Text", "body of the text")]) == [("Section", "running head\n\nbody of the text")]
    assert kinds([("Text", "footer", box(0, 960)), ("Text", "body text here", box(0, 500))], page_height=F.lit(1000.0)) == [("Text", "body text here")]
    assert kinds([("Text", "tiny"), ("Table", "漢字")]) == [("Table", "漢字")]
    caps = [r for k in range(3) for r in (("Caption", "Journal of X"), ("Text", f"some paragraph of text {k}"))]
    assert [k for k, _ in kinds(caps)] == ["Text"]
    (only,) = chunking.to_chunks(blocks(spark, [("Title", "The heading", box(0, 0)), ("Text", "Body of the section", box(10, 30, 200))])).collect()
    assert only["bbox"] == [0.0, 0.0, 210.0, 50.0] and only["merged_from"] == ["b00001"] and only["parent_section"] == "The heading"
    long = chunking.merge_blocks([{"text": "Aaaa bbbb. " * 60, "page_num": 1, "block_type": "Title", "bbox": [0.0] * 4, "section": "", "level": None, "noise": False}, {"text": "Another one here", "page_num": 2, "block_type": "Table", "bbox": [0.0] * 4, "section": "", "level": None, "noise": False}], 3000, 400)
    assert [c["chunk_id"] for c in long] == ["c00000p0", "c00000p1", "c00002"] and all(len(c["text"]) <= 400 for c in long)


def test_reading_order_of_columns_under_a_heading():
    heading, l1, l2, r1, r2 = [0, 0, 400, 20], [0, 40, 190, 90], [0, 110, 190, 160], [210, 40, 400, 90], [210, 110, 400, 160]
    assert geometry.reading_order([r2, r1, l2, l1, heading])[0] == 4
    wide = [[0, 0, 400, 20], [0, 60, 190, 90], [0, 100, 190, 160], [210, 60, 400, 90], [210, 100, 400, 160]]
    assert geometry.reading_order(wide) == [0, 1, 2, 3, 4]


def test_table_structure(spark):
    boxes = [("t", "table row", [0.0, 30.0 * k, 300.0, 30.0 * k + 30]) for k in range(3)] + [("t", "table column", [100.0 * k, 0.0, 100.0 * k + 104, 90.0]) for k in range(3)]
    boxes += [("t", "table column header", [0.0, 0.0, 300.0, 30.0]), ("u", "table row", [0.0, 0.0, 10.0, 10.0])]
    words = [("t", 3 * r + c, [100.0 * c + 10, 30.0 * r + 5, 100.0 * c + 50, 30.0 * r + 20], f"w{r}{c}|") for r in range(3) for c in range(3)]
    out = {r["table_id"]: r for r in geometry.table_from_structure(spark.createDataFrame(boxes, "table_id string, label string, bbox array<double>"), spark.createDataFrame(words, "table_id string, word_no int, bbox array<double>, text string")).collect()}
    assert out["t"]["markdown"].split("\n")[:3] == ["| w00\\| | w01\\| | w02\\| |", "| --- | --- | --- |", "| w10\\| | w11\\| | w12\\| |"] and out["t"]["n_cells"] == 9
    assert out["u"]["markdown"] == "" and geometry.covered_share([0, 0, 10, 10], [[0, 0, 5, 10], [3, 0, 8, 5]]) == pytest.approx(0.65)


def test_refusals_and_facts(spark):
    from quarry.operators import evaluate

    a = spark.createDataFrame([("No information on that.",), ("It cannot be determined",), ("无法回答",), ("The licence is free",)], "text string")
    assert evaluate.refusal_rate(a).first()["rate"] == 0.75
    f = lambda fact, text: one(spark, evaluate.fact_found(F.col("f"), F.col("t")), f=fact, t=text)
    assert f("A-b, c!", "x a b c y") and f("alpha gamma delta kappa omega", "omega kappa delta gamma") and not f("", "x") and not f("alpha gamma delta", "alpha")


def test_reasoning_is_left_out_wherever_it_is_cut():
    from itertools import product

    text = "a<think>b</think>c<thin d"
    for cuts in product([False, True], repeat=10):
        parts, now = [], ""
        for k, ch in enumerate(text):
            now += ch
            if cuts[k % 10]:
                parts.append(now)
                now = ""
        shown, held, inside = stream.without_reasoning([*parts, now])
        assert "".join(shown) + held == "ac<thin d" and not inside
