"""Goldens of the parsers, chunkers and order repair, and worked examples of fusion and metrics."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import chunk, embed, evaluate, fuse, parse, scan, vector

PAGE = "<html><head><title>T</title></head><body><p>Intro <b>x<p>two</p><h2>A</h2><p>one</p><pre><code class='language-java'>int a;</code></pre><h4>deep</h4><p>lost</p><h3>B</h3><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"


def test_html_sections():
    got = parse.html_sections(PAGE, "u")
    assert [c for c, _ in got] == ["Intro x\n\ntwo", "## A\n\none\n\n```java\nint a;\n```", "## B\n\n| k | v | \n| --- | --- | \n| 1 | 2 |"]
    assert got[1][1] == {"source_url": "u", "title": "T", "section_title": "A", "heading_level": "h2"}
    assert parse.html_sections("<p>only text", "u") == [("only text", {"source_url": "u"})]


def test_code_keeps_its_lines():
    page = "<h2>A</h2><p>x\n  y</p><pre><code class='language-java'>\nint a;\n    int b;\n\n</code></pre><div>one <pre>  p\n\tq </pre> two</div>"
    assert parse.html_sections(page, "u")[0][0] == "## A\n\nx y\n\n```java\nint a;\n    int b;\n```\n\none   p\n\tq two"


def test_html_in_one_box_repeats_the_page_as_introduction():
    got = parse.html_sections("<body><div><h2>A</h2><p>one</p></div></body>", "u")
    assert [c for c, _ in got] == ["A one", "## A\n\none"]


def test_plain_text_skips_navigation():
    assert parse.plain_text("<nav>menu</nav><p>a <b>b</b></p><script>x</script>") == "a b"


def test_markdown_sections():
    text = "# Title\r\nintro\r\n## One\r\nx\r\n```\r\n## no\r\n```\r\n### Two\r\ny"
    got = parse.markdown_sections(text, "u")
    assert [c for c, _ in got] == ["# Title\nintro", "## One\nx\n```\n## no\n```", "### Two\ny"]
    assert got[2][1] == {"source_url": "u", "title": "Title", "section_title": "Two", "heading_level": "3"}


def test_java_sections():
    body = 'package a.b;\n\n/** Doc. */\npublic class C {\n    private int n;\n\n    public int f(int x) {\n        String s = "}"; // }\n        return x;\n    }\n}\n'
    (head, meta), (method, info) = parse.java_sections(body, "u")
    assert head == "/** Doc. */\npublic class C {\n\n    // Fields\n    // - n\n}" and meta["fqcn"] == "a.b.C"
    assert method.startswith("// Class: C (a.b.C)\n// Fields: n\n\npublic int f(int x) {\n") and method.endswith("return x;\n    }")
    assert info["method_name"] == "f"


def test_java_members_by_tokens():
    body = """package a.b;
import java.util.*;
/** Top. */
@Component(name = "x{", value = {1, 2})
public final class C<T extends List<?>> implements D {
    @Inject private Map<String, Integer> m = new HashMap<>() {{ put("}", 1); }};
    protected static final int[] N = {1, 2};
    public C(int n) { this.n = n; }
    static { int q = 1; }
    int hidden() { return 0; }
    /* plain */ @Override public <R> R f(@Named("k(") List<R> xs) throws E, F { for (int i = 0; i < 3; i++) { g(); } return null; }
    private enum Kind { A { void x() {} }, B }
    public char open() { return '{'; }
"""
    package, got = parse.java_members(body)
    assert package == "a.b"
    assert [(k, n) for k, n, *_ in got] == [("class", "C"), ("field", "m"), ("field", "N"), ("method", "f"), ("class", "Kind"), ("method", "open")]
    (_, method, begin, brace, end) = got[3]
    assert body[begin:brace].startswith("@Override public") and body[brace - 1] == "{" and body[brace:end].endswith("return null; }")
    assert got[0][4] == 0 and parse.java_sections(body, "u")[0][0].startswith("/** Top. */\n@Component")
    cut = parse.java_sections("public class C { public int f() { return 1; " + "x" * 900, "u")
    assert len(cut[1][0].split("{\n", 1)[1]) == parse.UNBALANCED - 1


def test_xml_sections():
    got = parse.xml_sections('<r><c name="n" class="a.B"/><d/></r>', "u")
    assert len(got) == 2 and got[0][0].startswith("<!-- File: u -->\n<!-- Parent: <r> -->\n<c ")
    assert got[0][1] == {"source_url": "u", "element_type": "c", "element_name": "n", "fqcn": "a.B", "parent_element": "r"}
    assert "parse_error" in parse.xml_sections("<!DOCTYPE x><r/>", "u")[0][1]
    assert "parse_error" in parse.xml_sections("<r>", "u")[0][1]


def test_chunks_keep_overlap_and_write_the_separator_twice():
    a, b = "A" * 1000 + ". " + "b" * 400, "C" * 1500
    text = f"{a}\n\n{b}"
    first, second = chunk.chunk_text(text, "TEXT")
    assert first == a and second == "b" * 400 + "\n\n\n\n" + b
    assert chunk.chunk_text("short", "TEXT") == [] and chunk.chunk_text("x" * 5000, "XML") == ["x" * 5000]


def test_long_paragraph_is_cut_by_sentences():
    text = ("word " * 200 + "end. ") * 5
    got = chunk.chunk_text(text, "JAVA")
    assert len(got) == 3 and all(len(c) <= 2048 for c in got)


def test_fixed_windows_stop_after_the_tail():
    got = chunk.fixed_windows("x" * 2000)
    assert [len(c) for c in got] == [800, 800, 600]


def test_order_repair():
    assert scan.repaired_order(["a", "b", "c"], {"c": ["a"]}, {}) == ["c", "a", "b"]
    assert scan.repaired_order(["a", "b"], {}, {"a": ["b"]}) == ["b", "a"]
    assert sorted(scan.repaired_order(["a", "b"], {"a": ["b"], "b": ["a"]}, {})) == ["a", "b"]


def test_rank_fusion_example(spark):
    """Two lists A B C D and C A E: A leads, C follows."""
    rows = lambda ids: spark.createDataFrame([(1, "doc", i, r) for r, i in enumerate(ids, 1)], "query_id int, tbl string, id int, rank int")
    got = fuse.reciprocal(rows([1, 2, 3, 4]), rows([3, 1, 5]), k=10).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3, 2, 5, 4]


def test_metric_example(spark):
    rows = [(1, 1, False), (1, 2, True), (2, 1, True), (3, 4, True), (3, 1, False), (4, 1, False)]
    got = {r["query_id"]: r for r in evaluate.per_query(spark.createDataFrame(rows, "query_id int, rank int, rel boolean")).collect()}
    assert [got[q]["mrr"] for q in (1, 2, 3, 4)] == [0.5, 1.0, 0.25, 0.0]
    assert got[1]["ndcg_5"] == pytest.approx(0.63093) and got[4]["ndcg_5"] == 0.0


def test_rerank_with_a_failing_scorer_keeps_the_order(spark):
    rows = spark.createDataFrame([(1, "doc", i, 1.0 / i, "q", f"c{i}") for i in range(1, 5)], "query_id int, tbl string, id int, score double, query string, content string")

    def broken(queries, contents):
        raise RuntimeError("no model")

    assert [r["id"] for r in fuse.rerank(rows, 3, broken).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["id"] for r in fuse.rerank(rows, 2, lambda q, c: [float(x[1:]) for x in c]).orderBy("rank").collect()] == [4, 3]


def test_probed_lists_find_what_the_exact_search_finds(spark, sf):
    from inkwell.plans.views import chunk_vectors, vector_queries

    rows, asked = chunk_vectors(spark, sf), vector_queries(spark, sf)
    exact = vector.search(rows, asked, 10)
    assert vector.recall(vector.approximate(rows, asked, 10, lists=8, probes=5), exact).first()[0] >= 0.9


def test_embedding_sees_equal_contents_once(spark):
    rows = spark.createDataFrame([(1, "abcd"), (2, "abcd"), (3, None)], "id int, content string")
    got = {r["id"]: r["vector"] for r in embed.embedded(rows).collect()}
    assert got[1] == got[2] and sum(got[1]) == 2.0 and got[3] is None


def test_query_language_and_versions(spark):
    row = spark.sql("SELECT 'ハンドラキュー' AS a, 'plain words' AS b, '設定 file' AS c, '5.1.2' AS v")
    got = row.select(X.query_language(F.col("a")), X.query_language(F.col("b")), X.query_language(F.col("c")), X.normal_version(F.col("v"), "5")).first()
    assert list(got) == ["JAPANESE", "ENGLISH", "MIXED", "5.1"]
