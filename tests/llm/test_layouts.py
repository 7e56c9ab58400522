"""Main text of pages whose layout and truth are written by hand: 36 layouts, 8 pages each."""

import itertools

import pytest

from strataflow.llm import html_tree, wrapper

NOISE = (
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News {k}</a></li></ul></nav><div class='cookie-banner'>We use cookies on this site {k}.</div>",
    "<div class=ad>Buy {w} now, only today, {k} left.</div><form><input name=q><button>Go</button></form>",
    "<aside><h2>Also</h2><p>Other {w} story number {k} of this week.</p></aside><div id=comments><p>First! says reader {k}.</p></div><footer><p>About us {k}</p></footer>",
)
BODY = "<p>{w} one runs long enough to be a paragraph of page {k}.</p><p>{w} two<br>goes on &amp; ends  here {k}.</p><ul><li>{w} item {k}</li></ul>"
LINES = ["{w} one runs long enough to be a paragraph of page {k}.", "{w} two goes on & ends here {k}.", "{w} item {k}"]
#: How the article is held, the title before it and the lead.
HOLDERS = {
    "article": "<article>{title}{lead}{body}</article>",
    "main": "<main>{title}{lead}{body}</main>",
    "main with article": "<main>{title}{lead}<article>{body}</article></main>",
    "search-results": "<div class='search-results'>{title}{lead}{body}</div>",
    "title outside": "<div>{title}{lead}<div class=text>{body}</div></div>",
    "deep": "<div id=page><div class=wrap>{title}{lead}<div><section>{body}</section></div></div></div>",
}
PARTS = {
    "plain": ("", []),
    "related-work": ("<section id=related-work><h2>Related work {k}</h2><p>Others did {w} before, in {k}.</p></section>", ["Related work {k}", "Others did {w} before, in {k}."]),
    "social-history": ("<div class=social-history><p>A history of {w} in {k}.</p></div>", ["A history of {w} in {k}."]),
}
WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath"]


def site(holder, part, lead):
    extra, extra_lines = PARTS[part]
    pages = []
    for k, w in enumerate(WORDS):
        lead_html = "<p class=lead>{w} lead {k}.</p>" if lead else ""
        held = HOLDERS[holder].format(title="<h1>Title {w} {k}</h1>", lead=lead_html, body=BODY + extra)
        source = "<html><head><title>t</title></head><body>" + NOISE[0] + NOISE[1] + held + NOISE[2] + "</body></html>"
        lines = ["Title {w} {k}", *(["{w} lead {k}."] if lead else []), *LINES, *extra_lines]
        pages.append((source.replace("{k}", str(k + 100)).replace("{w}", w), "\n".join(lines).replace("{k}", str(k + 100)).replace("{w}", w)))
    return pages


def test_layouts(spark):
    rows, truth = [], {}
    for n, (holder, part, lead) in enumerate(itertools.product(HOLDERS, PARTS, (False, True))):
        for k, (source, text) in enumerate(site(holder, part, lead)):
            rows.append((n * 100 + k, f"http://h{n}.example/{k}", source))
            truth[n * 100 + k] = (holder, part, lead, text)
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [(truth[i][:3], got[i], truth[i][3]) for i in truth if got[i] != truth[i][3]]
    assert not wrong, wrong[:2]


@pytest.mark.parametrize("holder", list(HOLDERS))
def test_one_page_alone(holder):
    """Without a host's other pages the article is still whole (a title may come with more)."""
    source, text = site(holder, "related-work", True)[0]
    assert wrapper.extract(source, None)[0].endswith(text)


def test_a_quote_inside_a_bare_value():
    source = "<body><article><p title=it's>One.</p><p>Two's.</p><p title='a>b'>Three.</p><p title=\"x\">Four</p></article></body>"
    assert wrapper.extract(source, None)[0] == "One.\nTwo's.\nThree.\nFour"
    assert html_tree.parse("<p title=it's>x").children[0].attrs == {"title": "it's"}


def test_an_advert_inside_the_article_goes():
    source = "<body><article><p>One paragraph of text.</p><div class='ad'>Buy now.</div><div class=comment-list><p>Nice!</p></div><p>Another one.</p></article></body>"
    assert wrapper.extract(source, None)[0] == "One paragraph of text.\nAnother one."
