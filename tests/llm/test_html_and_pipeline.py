import hashlib
import random
import re
from html.parser import HTMLParser

import pytest

import corpus_pipeline
from cloakframe.llm import html_text, ngram_join
from cloakframe.llm.common import words
from cloakframe.llm.html_text import visible_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>a<li>b<ol start=4><li>c</li><li>d</ol></ul>e", "- a\n- b\n  4. c\n  5. d\n\ne"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name      | n\nlong name | 1"),
        ("<table><td>a<td>b<tr><td colspan=2>wide</table>", "a | b\nwide"),
        ("<pre> x\n  y</pre>z", " x\n  y\n\nz"),
        ("<head><title>t</title></head><body>b<script>if(a<b)c()</script><style>p{}</style>c", "bc"),
        ("<title>t</title>b", "b"),
        ("<p hidden>x</p><p style='display:none'>y</p><p style=\"visibility: hidden\">z</p>w", "w"),
        ("<div title='a>b' class=hidden>ok</div>", "ok"),
        ("&lt;b&gt; &amp;amp &copy; &bogus;", "<b> &amp © &bogus;"),
        ("1 < 2 <!-- no --> 3 <! x> 4", "1 < 2 3 4"),
        ("<b>x<p>y</b>z", "x\n\nyz"),
        ("a<textarea><b>t</b></textarea>", "a<b>t</b>"),
        ("<script>never closed", ""),
        ("x<a href='unclosed", "x"),
        ("<p>a</div></table>b", "ab"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ],
)
def test_rendering(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then", "if x=1 then"),
        ("<math><semantics><mi>x</mi><annotation>\\x</annotation><annotation-xml><ci>x</ci></annotation-xml></semantics></math>y", "xy"),
        ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>", "1 2"),
        ("a<svg><title>t</title><desc>d</desc><metadata>m</metadata><text>one</text><text>two</text></svg>b", "a one two b"),
        ("<svg><title/><desc/><path style='display:none' d='M0'/><text>one</text></svg>two", "one two"),
        ("<svg><style>text > a {}</style><script>if(1)x()</script><text><![CDATA[1 < 2 > 0]]></text></svg>", "1 < 2 > 0"),
        ("<p>a<svg><foreignObject><div>in</div></foreignObject><desc>d</desc><text>t</text></svg>b", "a\nin\nt b"),
        ("<svg><metadata><p>out of it</svg><title>t</title>b", "out of itb"),
        ("<svg hidden><text>x</text></svg>y", "y"),
        ("<table><tr><td colspan='--1'>a<td colspan='\u00b2'>b</table>", "a | b"),
        ("<ol start='\u00b2'><li>a<li value='-'>b<li value='--1'>c</ol>", "1. a\n2. b\n3. c"),
        ("<ol start='-2'><li>a</ol>", "-2. a"),
    ],
)
def test_formulas_drawings_and_numbers(page, text):
    assert visible_text(page) == text


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert visible_text("<b>" * 50_000 + "x<p>y") == "x\n\ny"
    assert visible_text("<a \"x" * 20_000) == ""
    assert len(visible_text("<p>word</p>" * 50_000).split()) == 50_000


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("title", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("title", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def test_all_visible_words_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        parser = Words()
        parser.feed(r["html"])
        parser.close()
        own = re.sub(r"^(- |\d+\. )", "", got[r["page_id"]], flags=re.M)
        assert "".join(own.split()) == "".join("".join(parser.found).split())


def test_extract_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "<p>x", "c"), (2, "", "b")]
    pages = spark.createDataFrame(rows, "page_id long, html string, page string").selectExpr("*", "1 as text")
    assert sorted(map(str, (tuple(r) for r in html_text.extract_pages(pages).collect()))) == ["(1, None)", "(2, '')", "(2, '')", "(None, 'x')"]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_stages_keep_columns_and_decide(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), odd_docs.schema)
        assert docs.columns == odd_docs.columns, name
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert not {100, 101, 102} & set(ids)  # no language
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in pieces.collect()} == set(ids)


def test_near_copies_leave_one(spark, odd_docs, no_docs):
    kept = corpus_pipeline.drop_near_copies(spark, odd_docs, "")
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [*range(30), 100, 101, 102, 106, 107, 108]
    assert ids.count(None) == 0  # a copy of document 0
    assert corpus_pipeline.drop_near_copies(spark, no_docs, "").count() == 0
    assert ngram_join.join_near(kept, n=5, percent=80).where("component_id <> doc_id").count() == 0


def test_repeated_and_null_ids_lose_copies_only(spark, sentences):
    rng = random.Random(7)
    t = [sentences(rng, 120) for _ in range(6)]
    rows = [(1, t[0], "a"), (1, t[1], "a"), (2, t[2], "a"), (2, t[0] + " more", "a"), (3, t[3], "b"), (3, t[3], "a"), (4, "", "a"), (4, None, "a")]
    rows += [(None, t[4], "b"), (None, t[4], "a"), (None, t[4] + " more", "a"), (None, t[5], "a"), (None, "", "a"), (None, "", "a"), (None, t[2], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())))
    kept = [(1, t[0], "a"), (1, t[1], "a"), (2, t[2], "a"), (3, t[3], "a"), (4, "", "a"), (4, None, "a"), (None, t[5], "a"), (None, "", "a"), (None, "", "a")]
    least = min([t[4], t[4] + " more"], key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert got == sorted(map(str, [*kept, (None, least, "a")]))
    again = sorted(map(str, (tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(5), "").collect())))
    assert again == got


def test_whole_pipeline(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert pieces and max(r["offset"] + r["length"] for r in pieces) <= 2048
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, again)) == sorted(map(str, pieces))


def test_whole_pipeline_on_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_null_id_among_unique_ones(spark, sentences):
    rng = random.Random(3)
    t = [sentences(rng, 60) for _ in range(3)]
    rows = [(1, t[0], "a"), (2, t[1], "a"), (None, t[1], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 2]


def test_words():
    assert words(" a\tb\x0bc\x0c\r\nd\x1ce\xa0f g ") == ["a", "b", "c", "d\x1ce\xa0f g"]
    assert words(None) == words("") == words(" \n") == []
