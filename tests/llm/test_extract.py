"""Main text of articles in many shapes, and that how many lines there are says nothing."""

import re

import pytest

from pagewarden.llm import extract

NAV, FOOT = "<nav><ul><li><a href=/x>Home</a></li></ul></nav>", "<footer>© site. All words.</footer>"
FIRST, LAST = "The first paragraph says some things here.", "The last one says more."


def blocks(core, before=NAV, after=FOOT):
    return [x for x in extract.default_model().text(f"<html><body>{before}{core}{after}</body></html>").split("\n") if x]


def many(lines, tag="p", attributes=""):
    return "".join(f"<{tag}{attributes}>{x}</{tag}>" for x in lines)


@pytest.mark.parametrize("piece", [
    "<ol><li>Step one here.</li><li>Two</li></ol>", "<h5>Small head</h5>", "<h6>Smaller</h6>", "<div><div><p>Nested deep text here.</p></div></div>", "<dl><dt>Term</dt><dd>Its meaning.</dd></dl>",
    "<dl><dt>Term</dt><dd>Its meaning is told at some length here, and then some more.</dd></dl>", "<ul><li><a href=/a>One link</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul>",
    "<table><caption>Cap</caption><tr><th>Name</th><th>Age</th></tr><tr><td>Ann</td><td>3</td></tr></table>", "<address>Street 1, Town</address>", "<details><summary>More</summary><p>Hidden words.</p></details>",
    "<figure><figcaption>A picture</figcaption></figure>", "<pre>code x</pre>", "<section><h2>Part</h2><p>Short.</p></section>", "<div>Bare</div>", "<p class=verse>One</p><p class=verse>Two</p>", "<div class='stanza l1'>One</div>",
])
def test_article_keeps(piece):
    core = f"<article><h1>Title of it</h1><p>{FIRST}</p>{piece}<p>{LAST}</p></article>"
    want = [x for x in re.sub("<[^>]*>", "\n", core).split("\n") if x]
    assert blocks(core) == want


@pytest.mark.parametrize("frame", ["<article>", "<main>", "<div id=content>", "<div class='post-body'>", "<section class=article-text>", "<div>"])
@pytest.mark.parametrize("n", [3, 30, 3000])
def test_number_of_lines_says_nothing(frame, n):
    end = f"</{re.match('<([a-z]+)', frame)[1]}>"
    for tag, attributes, line in (("p", "", "x{}"), ("p", "", "Soft rain 7"), ("div", "", "Soft rain {}"), ("p", " class=verse", "- No."), ("li", "", "Entry {}")):
        lines = [line.format(i) for i in range(n)]
        body = many(lines, tag, attributes)
        body = f"<ul>{body}</ul>" if tag == "li" else body
        assert blocks(f"{frame}<h1>Title</h1>{body}{end}") == ["Title", *lines], (tag, line)


@pytest.mark.parametrize("n", [1, 30, 300])
def test_article_is_rid_of(n):
    core, want = f"<h1>Title</h1><p>{FIRST}</p><p>{LAST}</p>", ["Title", FIRST, LAST]
    comments = "".join(f"<div class=comment><p>I like it, number {i}.</p></div>" for i in range(n))
    assert blocks(f"<article>{core}{comments}</article>") == want
    assert blocks(f"<article>{core}<section class=comments>{comments}</section></article>") == want
    assert blocks(f"<article>{core}</article><ol class=commentlist>{many(['Nice one.', 'I agree with it.'] * n, 'li')}</ol>") == want
    assert blocks(f"<article>{core}</article><aside><ul>{many(['<a href=x>Other story</a>'] * n, 'li')}</ul></aside><div class=sidebar>{many(['Read more of it.'] * n)}</div>") == want
    assert blocks(f"<article>{core}</article>", before=f"<nav><ul>{many(['<a href=/x>Entry</a>'] * n, 'li')}</ul></nav><div class=menu>{many(['<a href=/x>Entry</a>'] * n, 'div')}</div>") == want
    for advert in ("<div class=ad>Buy now.</div>", "<p class=advert>Buy now.</p>", "<form><p>Sign up for it here.</p><button>Go</button></form>"):
        assert blocks("<article><h1>Title</h1>" + f"<p>Some text is here.</p>{advert}" * n + "</article>") == ["Title"] + ["Some text is here."] * n


@pytest.mark.parametrize("n", [3, 30, 300])
def test_number_of_parts_says_nothing(n):
    for part, texts in (("<div><p>x y</p></div>", ["x y"]), ("<ul><li>x y</li><li>z</li></ul>", ["x y", "z"]), ("<section><h2>x y</h2><p>Nil.</p></section>", ["x y", "Nil."]), ("<dl><dt>x</dt><dd>y</dd></dl>", ["x", "y"])):
        assert blocks(f"<article><h1>Title</h1>{part * n}</article>") == ["Title", *texts * n], part


def test_odd_rows(spark):
    """Null and repeated ids, columns of the names that come out, a very long page."""
    page = f"<article><h1>Title</h1><p>{FIRST}</p></article>"
    long = "<article>" + many([FIRST] * 30_000) + "</article>"
    df = spark.createDataFrame([(None, "u", page, "x", 9), (None, "u", page, "x", 9), (1, None, None, "x", 9), (1, "u", long, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract.main_text(df).collect()), key=str)
    text = f"Title\n{FIRST}"
    whole = "\n".join([FIRST] * 30_000)
    assert got == sorted([(None, "u", text, len(text))] * 2 + [(1, None, "", 0), (1, "u", whole, len(whole))], key=str)
