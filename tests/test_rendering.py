"""Word documents, pages of spans, markup, prompts, catalogues, arguments and stored trees on small fixtures."""

import io
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from quarry.operators import arguments, directory_tree, markup
from quarry.operators.stored_trees import TreeStore
from quarry.sources import office

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None):
    named = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{named}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"


def word(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>")
    return out.getvalue()


def test_word_documents(spark, tmp_path):
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in (["a", "b"], ["", ""], ["c"])) + "</w:tbl>"
    broken = "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p>"
    good = word(paragraph("Chapter", "Heading2"), paragraph("x" * 121, "Heading1"), paragraph("  Some   text  "), paragraph(""), table, broken, paragraph("标题文字", "标题"), paragraph("Name", "TitleStyle"))
    for name, content in {"a.docx": good, "b.docx": b"no zip", "c.md": b"# Top\n\ntext", "d.docx": word(), "e.DOCX": word(paragraph("big suffix"))}.items():
        (tmp_path / name).write_bytes(content)
    blocks, faults = office.load_blocks(spark, str(tmp_path))
    rows = blocks.orderBy("doc_id", "pos").collect()
    told = [(r["block_type"], r["text"], r["level"]) for r in rows if r["doc_id"] == "a.docx"]
    assert told == [("Title", "Chapter", 2), ("Text", "x" * 121, None), ("Text", "Some text", None), ("Table", "| a | b |\n| --- | --- |\n| c |  |", None), ("Text", "one two\nthree", None), ("Title", "标题文字", None), ("Title", "Name", None)]
    assert [(r["block_type"], r["text"]) for r in rows if r["doc_id"] == "c.md"] == [("Title", "Top"), ("Text", "text")]
    assert [r["text"] for r in rows if r["doc_id"] == "e.DOCX"] == ["big suffix"]
    assert [(r["doc_id"], r["fault"].split(":")[0]) for r in faults.collect()] == [("b.docx", "BadZipFile")]


def test_word_documents_without_content_or_rows(spark):
    blocks, faults = office.word_documents(spark.createDataFrame([("n", None)], "doc_id string, content binary"))
    assert blocks.count() == 0 and [r["doc_id"] for r in faults.collect()] == ["n"]
    blocks, faults = office.word_documents(spark.createDataFrame([], "doc_id string, content binary"))
    assert blocks.count() == 0 and faults.count() == 0


def test_pages_of_spans(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    spans = [("d", 1, 0, 0, 0, "Head", 12.0, box), ("d", 1, 0, 0, 1, "ing  ", 11.6, box), ("d", 1, 1, 0, 0, "body", 10.0, box), ("d", 1, 1, 1, 0, "  ", 10.0, box), ("d", 1, 1, 2, 0, "more", 10.0, box), ("d", 1, 2, 0, 0, "cell", 10.0, [50.0, 50.0, 60.0, 60.0]), ("d", 1, 3, 0, 0, " ", 30.0, box), ("d", 1, 4, 0, 0, "L" * 81, 20.0, box), ("d", 1, 5, 0, 0, "half", 10.0, [95.0, 50.0, 105.0, 60.0])]
    spans += [("d", 2, 0, 0, 0, "no size", 0.0, box)]
    tables = [("d", 1, 0, "| t |", [40.0, 40.0, 100.0, 100.0]), ("d", 1, 1, "", box)]
    out = office.pdf_blocks(spark.createDataFrame(spans, "doc_id string, page_num int, block int, line int, span int, text string, size double, bbox array<double>"), spark.createDataFrame(tables, "doc_id string, page_num int, table_no int, markdown string, bbox array<double>"))
    rows = [(r["page_num"], r["block_type"], r["text"], r["font_size"]) for r in out.orderBy("pos").collect()]
    assert rows == [(1, "Title", "Heading", 12.0), (1, "Text", "body\nmore", 10.0), (1, "Text", "L" * 81, 20.0), (1, "Text", "half", 10.0), (1, "Table", "| t |", 0.0), (2, "Text", "no size", 0.0)]


def test_table_text_by_precision(spark):
    rows = spark.createDataFrame([(" ", "s", "p"), ("r", "s", "p"), (None, "", None)], "a string, b string, c string")
    assert [r[0] for r in rows.select(office.preferred_table_text(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["s", "r", ""]


def test_search_markup(spark):
    queries = spark.createDataFrame([("q", "a & <b>"), ("e", "nothing"), ("n", None)], "query_id string, query string")
    hit = "query_id string, rank int, chunk_id string, doc_id string, page_num int, chunk_index int, dataset_id string, doc_name string, score double, n_chars int, snippet string, truncated boolean, unmatched boolean, ref int"
    rows = [("q", 2, "c2", "d", 1, 2, "k", "it's.txt", 0.25, 9, "", False, True, None), ("q", 1, "c1", "d", 1, 1, "k", '"x".txt', 1.0, 5, "<s>", True, False, 0)]
    told = {r["query_id"]: r["markup"] for r in markup.search_markup(queries, spark.createDataFrame(rows, hit), empty="none", cut="{truncated} and {unmatched}").collect()}
    assert told["q"] == (
        '<search_results count="2" query="a &amp; &lt;b&gt;">\n'
        '<chunk rank="1" chunk_id="c1" doc_id="d" page_num="1" chunk_index="1" dataset_id="k" doc_name="&quot;x&quot;.txt" score="1.000" chunk_runes="5" ref="0" truncated="true">\n<match_snippet>&lt;s&gt;</match_snippet>\n</chunk>\n'
        '<chunk rank="2" chunk_id="c2" doc_id="d" page_num="1" chunk_index="2" dataset_id="k" doc_name="it&apos;s.txt" score="0.250" chunk_runes="9" match="none">\n</chunk>\n'
        "<snippet_note>1 and 1</snippet_note>\n</search_results>"
    )
    assert told["e"] == '<search_results count="0" query="nothing">\n<hint>none</hint>\n</search_results>'
    assert told["n"] == '<search_results count="0">\n<hint>none</hint>\n</search_results>'


def test_passage_markup_with_notices(spark):
    rows = spark.createDataFrame([("d", 1, "c1", 1, 1, "k", "n", ""), ("d", 0, "c0", 1, 0, "k", "n", "t")], "doc_id string, pos long, chunk_id string, page_num int, chunk_index int, dataset_id string, doc_name string, text string")
    notices = spark.createDataFrame([("d", "c9 isn't there")], "doc_id string, notice string")
    row = markup.passage_markup(rows, notices).first()
    assert row["n"] == 2 and row["markup"].startswith('<chunks doc_id="d" fetched="2">\n<notice>c9 isn&apos;t there</notice>\n<chunk chunk_id="c0"')
    assert row["markup"].count("<content>") == 1 and row["markup"].endswith("</chunk>\n</chunks>")


def test_prompts(spark):
    asked = spark.createDataFrame([("q", "Who?"), ("e", "What?")], "query_id string, query string")
    ranked = spark.createDataFrame([("q", 1, "d", "first"), ("q", 2, "d", "y" * 400)], "query_id string, rank int, doc_id string, text string")
    parts = spark.createDataFrame([("q", 7, "b"), ("q", 3, "a")], "query_id string, part int, text string")
    told = {r["query_id"]: r for r in markup.synthesis_prompt(asked, ranked, 320, parts).collect()}
    assert told["q"]["block"].startswith("Original question: Who?\n\nParts it was split into (the evidence below was gathered for them):\n1. a\n2. b\n\nEvidence:\n[1] (d p.1) first\n[2] (d p.1) yyy")
    assert "…\n" in told["q"]["block"] and told["q"]["n_omitted"] == 0
    assert told["e"]["block"] == "Original question: What?\n\nEvidence:\n"
    said = spark.range(1).select(markup.language_directive(F.lit(" ZH ")), markup.language_directive(F.lit("fr")), markup.language_directive(F.lit(None).cast("string")), markup.scope_prefix(F.lit(" 2024 ")), markup.scope_prefix(F.lit(" "))).first()
    assert "in Chinese (简体中文)," in said[0] and said[1] == said[2] == said[4] == "" and "a subset of the corpus — 2024." in said[3]


def test_catalogue(spark):
    docs = spark.createDataFrame([("en", None), ("de", 'a"b'), ("en", "")], "lang string, source string")
    samples, n = markup.field_samples(docs, ["lang", "source", "lang"][:2], 1), docs.agg(F.count("*").alias("n"))
    assert markup.availability(samples, n, ["lang", "source"]).first()[0] == 'lang = "en" (2 doc(s)); source = "a\\"b" (1 doc(s)); 3 document(s) indexed'
    assert '- lang (iso); values: "en" (2 doc(s))\n' in markup.catalogue(samples, n, ["lang", "source"], {"lang": "iso"}).first()[0]
    none = docs.limit(0)
    empty, zero = markup.field_samples(none, ["lang"]), none.agg(F.count("*").alias("n"))
    assert markup.catalogue(empty, zero, ["lang"]).first()[0] == ""
    assert markup.availability(empty, zero, ["lang"]).first()[0] == "lang has no values; 0 document(s) indexed"


def test_arguments(spark):
    row = spark.range(1).select(F.parse_json(F.lit('{"n": 3, "f": 3.9, "m": -3.9, "t": "3", "b": true, "e": 1e2, "o": {}, "z": null}')).alias("v"))
    read = lambda of, *keys: list(row.select(*[of(F.col("v"), k).alias(k) for k in keys]).first())
    assert read(arguments.int_argument, "n", "f", "m", "t", "b", "e", "o", "z", "gone") == [3, 3, -3, None, None, 100, None, None, None]
    assert read(arguments.text_argument, "t", "n", "z", "gone") == ["3", None, None, None]
    assert read(arguments.flag_argument, "b", "n", "t", "gone") == [True, None, None, None]
    none = spark.range(1).select(arguments.int_argument(F.try_parse_json(F.lit("no json")), "n")).first()[0]
    assert none is None


def test_thresholds(spark):
    boxes = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0],), ([0.0, 0.0, 0.0, 1.0],), ([1.0, 0.0, 0.0, 1.0],), ([0.0, 1.0],), (None,)], "b array<double>")
    assert [r[0] for r in boxes.select(arguments.is_region(F.col("b"))).collect()] == [True, False, False, False, False]
    rows = spark.createDataFrame([(True, 0.6), (True, 0.59), (False, 0.9), (None, 0.9), (True, None)], "s boolean, p double")
    assert [r[0] for r in rows.select(arguments.verdict(F.col("s"), F.col("p"))).collect()] == ["sufficient", "unknown", "insufficient", "unknown", "unknown"]
    assert [r[0] for r in rows.select(arguments.accepted(F.lit("x"), F.col("p"), 0.6)).collect()] == ["x", None, "x", "x", None]


@pytest.fixture
def small_tree(spark):
    nodes = spark.createDataFrame([("d0", None, 0, ""), ("d0.1", "d0", 1, "A"), ("d0.2", "d0", 1, "B"), ("d0.10", "d0", 1, "C")], "nid string, parent string, level int, name string")
    leaves = spark.createDataFrame([("d0.1", "x"), ("d0.2", "y"), ("d0.10", "z")], "nid string, doc_id string")
    return nodes, leaves


def test_stored_trees(spark, tmp_path, small_tree):
    store = TreeStore(spark, str(tmp_path / "trees"))
    assert store.open("t", "p1") is None
    nodes, leaves = small_tree
    store.save("t", "p1", {"nodes": (nodes, ["nid"]), "leaves": (leaves, ["nid"])})
    store.save("t", "p1", {"nodes": (nodes.where("nid <> 'd0.2'"), ["nid"])})
    later = TreeStore(spark, str(tmp_path / "trees"))
    assert set(later.open("t", "p1")) == {"nodes"} and later.open("t", "p1")["nodes"].count() == 3 and later.open("t", "p2") is None and later.open("u", "p1") is None
    later.save("t", "p2", {"nodes": (nodes, ["nid"])})
    assert later.open("t", "p1") is None and store.open("t", "p2")["nodes"].count() == 4
    store.save("any", "", {"nodes": (nodes, ["nid"])})
    assert store.open("any", "whatever") is not None
    lines = []
    for k in range(2):
        store.export_json("t", "p2", "nodes", ["nid"], str(tmp_path / f"out{k}"))
        lines.append([r[0] for r in spark.read.text(str(tmp_path / f"out{k}")).collect()])
    assert lines[0] == lines[1] and lines[0][0] == '{"level":0,"name":"","nid":"d0","parent":null}'
    assert len([p for p in (tmp_path / "trees").iterdir() if p.name.startswith("t-")]) == 1


def test_explained_and_skipped(spark, small_tree):
    nodes, leaves = small_tree
    queries = spark.createDataFrame([("q", "red fox"), ("r", "blue")], "query_id string, query string")
    parts = spark.createDataFrame([("q", "x", "fox", 2.0), ("q", "x", "red", 1.0), ("q", "z", "red", 0.5)], "query_id string, doc_id string, term string, part double")
    scores = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    skipped = {r["query_id"]: r["skipped"] for r in directory_tree.skipped_branches(nodes, directory_tree.best_of_nodes(nodes, leaves, scores), queries, 1).collect()}
    assert skipped == {"q": "未开启的分支：B (BM25 0.0)；C (BM25 0.5)", "r": "未开启的分支：B (BM25 0.0)；C (BM25 0.0)"}
    none = directory_tree.skipped_branches(nodes, directory_tree.best_of_nodes(nodes, leaves, scores), queries, 3).collect()
    assert len(none) == 2 and all(r["skipped"] is None for r in none)
    hits = spark.createDataFrame([("q", 1, "x", "route", 1), ("q", 2, "y", "route", 2), ("q", 3, "z", "keyword", None)], "query_id string, rank int, doc_id string, source string, branch int")
    why = [r["why"] for r in directory_tree.explained(hits, parts, queries, directory_tree.document_paths(nodes, leaves)).orderBy("rank").collect()]
    assert why == ["由第 1 个分支召回；命中 2/2 个查询词（fox、red），BM25 3.0；目录 A", "由第 2 个分支召回；未命中任何查询词（BM25 0）", "由关键词兜底网召回；命中 1/2 个查询词（red），BM25 0.5"]


def test_fan_out_takes_turns(spark):
    hits = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b"), ("s2", 1, "a"), ("s2", 2, "c"), ("s2", 3, "d")], "query_id string, rank int, doc_id string")
    slots = spark.createDataFrame([("q", 1, "s1"), ("q", 2, "s2"), ("q", 3, "s3")], "question_id string, slot int, query_id string")
    out = directory_tree.fan_out(hits, slots, 3).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"], r["query_id"]) for r in out] == [(1, "a", "s1"), (2, "b", "s1"), (3, "c", "s2")]


def test_sibling_names(spark, small_tree):
    nodes, leaves = small_tree
    nodes = nodes.unionByName(spark.createDataFrame([("d0.3", "d0", 1, "E")], nodes.schema))
    counts = spark.createDataFrame([("x", "apple", 3), ("x", "the", 9), ("y", "pear", 4), ("y", "the", 9), ("z", "the", 9)], "doc_id string, term string, tf int")
    titles = spark.createDataFrame([("x", "Same"), ("z", "Same"), ("y", None)], "doc_id string, name string")
    rows = {r["nid"]: (r["titles"], r["terms"], r["name"]) for r in directory_tree.sibling_names(nodes, leaves, directory_tree.weights(counts, 3), titles, most_terms=1).collect()}
    assert rows == {"d0.1": ("Same", "apple", "Same"), "d0.2": (None, "pear", "pear"), "d0.10": ("Same", "the", "Same(10)"), "d0.3": (None, None, "组3")}
