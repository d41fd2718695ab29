"""Pages of many layouts, each with its article known, and broken markup."""

import html
import itertools

import pytest

from mailsieve.llm.html_text import main_text

WORDS = "the river ran slowly past old mills, where grain was once ground, and children still fish from the bank in summer".split()
ARTICLE = [" ".join(WORDS[k:] + WORDS[:k]) + f", part {k} & more <{k}>." for k in range(0, 15, 3)]
INNER = {
    "paragraphs": "".join(f"<p>{html.escape(t)}</p>" for t in ARTICLE),
    "open paragraphs": "".join(f"<p>{html.escape(t)}" for t in ARTICLE),
    "quote and list": f"<p>{html.escape(ARTICLE[0])}</p><blockquote><p>{html.escape(ARTICLE[1])}</p></blockquote><ul><li>{html.escape(ARTICLE[2])}</li><li>{html.escape(ARTICLE[3])}</li></ul><p>{html.escape(ARTICLE[4])}</p>",
    "odd attributes": f"<p title=don't data-x='a>b'>{html.escape(ARTICLE[0])}</p>" + "".join(f'<p class="x">{html.escape(t)}</p >' for t in ARTICLE[1:]),
    "line breaks": "<div>" + "<br/><br/>".join(html.escape(t) for t in ARTICLE) + "</div>",
}
OUTER = {
    "article": "<article>{}</article>",
    "main": "<main><div class=inner>{}</div></main>",
    "named by words of boilerplate": "<div class='legal-page side-content'>{}</div>",
    "modifier": "<div class='layout has-sidebar'><div id=post-body>{}</div></div>",
    "table": "<table><tr><td>{}</td></tr></table>",
    "form around all": "<form id=f action=/go><div>{}</div></form>",
}
BESIDE = {
    "none": ("", ""),
    "menus": ("<header><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>", "<footer>All rights, and so on, reserved.</footer>"),
    "notices": ("<div class='cookie-banner'><p>We use cookies, as everybody, so accept.</p></div><div class=ad>Buy now, pay later.</div>", "<div id=comments><p>Great text, thanks a lot, really.</p></div><aside><p>Read this, too.</p></aside>"),
    "code": ("<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->", "<noscript><p>Turn scripts on.</p></noscript><div class='related'><a href=/x>More like this</a></div>"),
}


@pytest.mark.parametrize("inner,outer,beside", [*itertools.product(INNER, OUTER, BESIDE)])
def test_page(inner, outer, beside):
    before, after = BESIDE[beside]
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{OUTER[outer].format(INNER[inner])}{after}</body></html>"
    assert main_text(page) == " ".join(ARTICLE)


def test_pages_without_an_article():
    for page in ("", "<html></html>", "<nav><a href=/>x</a></nav>", "<form><p>Your name</p><input></form>", "<script>x</script>", "<aside><p>Only, a, sidebar, here.</p></aside>"):
        assert main_text(page) == "", page
    assert main_text("just text") == "just text"
