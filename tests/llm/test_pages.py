import html as markup
import re

from feedops.llm import pages

CASES = {
    "": "",
    "plain text only": "plain text only",
    "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>a <b>b</b>\n c<p>d<br>e</article><footer>f</footer>": "T & t\n\na b c\n\nd e",
    "<body><div class='cookie-notice'>ok?</div><main><p>x</p><aside>side</aside><form>q <p>r</p></form><section id=comments><p>nice</p></section></main>": "x",
    "<article><p>1 < 2 &lt;b&gt; &#233;&eacute; &nbsp; z</p><script>var t='</p><p>no';</script><!-- <p>no --><style>p{}</style></article>": "1 < 2 <b> éé z",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>": "a\n\nb\n\nc\n\nd",
    "<article><p>one</p></article><article><p>two</p></article>": "one\n\ntwo",
    "<body><header>top</header><p>body only</p><div class='ad'>buy</div></body>": "body only",
    "<article><header><h1>Head</h1></header><p>x</p><footer>foot</footer></article>": "Head\n\nx",
    "<article><p>unclosed <i>text": "unclosed text",
    "<article><p title='a > b'>q</p><script>never closed <p>x": "q",
    "<article>a <a href=x>link</a> b<img src=y> c</article>": "a link b c",
}


def test_deep_nesting():
    assert pages.blocks("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end</article>", []) == ["deep", "end"]
    assert max(map(len, pages.tokens("<div>" * 5000)[0])) < 1100


def run(spark, rows):
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted((str(r.page_id), r.url, r.text) for r in got)


def test_single_pages():
    for page, want in CASES.items():
        assert "\n\n".join(pages.blocks(page, [])) == want, page


def test_extract_cases_and_odd_rows(spark):
    rows = [(i, f"http://h{i}.com/", page, "x") for i, page in enumerate(CASES)] + [(50, None, None, "x"), (51, "http://h1.com/", None, "x"), (1, "http://h1.com/", "plain text only", "x")]
    want = sorted([(str(i), f"http://h{i}.com/", t) for i, t in enumerate(CASES.values())] + [("50", None, ""), ("51", "http://h1.com/", ""), ("1", "http://h1.com/", "plain text only")], key=str)
    assert sorted(run(spark, rows), key=str) == want
    assert run(spark, []) == []


def test_template_without_article_is_found_by_its_text(spark):
    page = "<html><body><div class='top'><a>x</a></div><div class='story'><p>{}</p><p>{}</p></div><div class='nav'>n</div><div class='tail'>t</div></body></html>"
    rows = [(i, f"http://one.com/{i}", page.format(f"long text number {i} " * 9, "more " * 8), "") for i in range(6)]
    got = run(spark, rows)
    assert [t for *_, t in got] == [" ".join(f"long text number {i} ".split() * 9) + "\n\n" + " ".join(["more"] * 8) for i in range(6)]
    made = pages.templates(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.host, r.roots) for r in made] == [("one.com", ["html/body/div.story"])]


def test_whole_table(spark, data):
    table = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract(table).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(markup.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in parts if b)
