"""Forward scans give what plain patterns give, and take the time of the text's length."""

import random
import re
import time

import pytest

from pagewarden.functions import contacts, scan
from pagewarden.operators import intent, site
from pagewarden.sources import html

# The plain patterns, which take up to the cube of the length.
MONEY = intent._MONEY
PRICE = re.compile(rf"(?i)(?:{MONEY})(?:<[^>]+>|\s)*[\d,]*\d[\d.]*|[\d,]*\d[\d.]*(?:<[^>]+>|\s)*(?:{MONEY})")
SCRIPTS = re.compile(r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>")
QUANTITY = re.compile(r"(?i)<input[^>]+(?:name=[\"']?(?:qty|quantity)[\"']?|type=[\"']?number[\"']?)")
FORM = re.compile(r"(?i)<form[^>]*>[\s\S]{0,40}?(?:name=[\"']?(?:email|message|subject|contact)[\"']?|type=[\"']?email[\"']?|<textarea)[\s\S]{0,40}?</form>")


def texts(pieces, n=4000, most=14):
    r = random.Random(9)
    return ["".join(r.choice(pieces) for _ in range(r.randrange(most))) for _ in range(n)]


def test_prices():
    for t in texts(["1", "23", ",", ".", "€", "usd", "CHF", " ", "<b>", "<", ">", "<i 1>", "x", "\n"], 20000):
        assert scan.prices(MONEY, t) == [m.start() for m in PRICE.finditer(t)], t


def test_elements():
    for t in texts(["<script", "<STYLE", ">", "</script>", "</style>", "x", " a=1", "<p>"]):
        assert scan.without(intent.SCRIPT, intent.SCRIPT_END, t) == SCRIPTS.sub(" ", t), t


def test_inputs():
    for t in texts(["<input", "<INPUT", ">", " name=qty", " type='number'", "x", " "]):
        assert scan.inputs(intent.INPUT, intent.QUANTITY, t) == [m.start() for m in QUANTITY.finditer(t)], t


def test_near():
    for t in texts(["<form", ">", "</form>", " name=email", "<textarea", "x" * 9, "x" * 25, "<FORM a>"], 6000):
        assert scan.near(intent.FORM, intent.ASKED, intent.FORM_END, t, 40) == bool(FORM.search(t)), t


def test_hidden_signs():
    plain = lambda t: re.sub(r"(?i)\s*[\[(]\s*dot\s*[\])]\s*", ".", re.sub(r"(?i)\s*[\[(]\s*at\s*[\])]\s*|%40", "@", t))
    for t in texts(["ab", " ", "[at]", "( AT )", "(dot]", "[ dot ]", "%40", "com", "@", "."]):
        assert contacts._unhidden(contacts._unhidden(t.replace("%40", "@"), contacts._AT, "@"), contacts._DOT, ".") == plain(t), t
    assert contacts.find_emails("me (at) example [dot] org") == ["me@example.org"]


@pytest.mark.parametrize("piece", ["1", "1,", "1.", "1.1,", "$", "$<", "1<", "1 ", "<a>", "$ <b> ", " ", "<input ", "<script>", "<script", "<style", "<tr>", "<tr", "<dt", "<form>", "<form", "<form> name=email", "<p>", "<", "class='pagination", "published ", "published", "published  ", "by A", "by a", "(at", "( ", "a@", "a.", "-", "<div ", "<noscript>", "<noscript", "<ul><li>", "x<br>", "<a href=x>y</a> ", "<h1>"])
def test_a_megabyte_takes_seconds(piece):
    """Each repeated to a megabyte on a page that has every hint, inside a body and with a tail that ends no element."""
    known = ["1", " ", "<input ", "<script>", "<p>", "published ", "("]  # others take a call a piece
    text = "<html><body> try usd price buy in stock updated rel= <input <form " + piece * (1_000_000 // len(piece)) + " a"
    began = time.time()
    page = {"links": [], "open_graph": [], "h1_primary": None, "word_count": 1}
    intent.facts(page, text, "https://e.com/a/b")
    facts = time.time() - began
    began = time.time()
    contacts.find_emails(text)
    mails = time.time() - began
    assert facts < (3 if piece in known else 8) and mails < 2


def test_page_that_hung():
    began = time.time()
    html.parse_html("<p>" + "1" * 1000 + " try</p>", "https://e.com/")
    html.parse_html("<p>" + "1" * 1_000_000 + " try</p>", "https://e.com/")
    html.parse_html("<p>" + "-" * 1_000_000 + "x</p>", "https://e.com/")
    assert time.time() - began < 8


def test_markdown_of_many_paragraphs():
    began = time.time()
    text = site.to_markdown("<p>some text</p>" * 60_000 + "<ul><li><a href='/x'>a  b</a></ul>", "https://e.com/")
    assert time.time() - began < 6 and text.startswith("some text\n\nsome text\n\n")
    assert site.to_markdown("<p>a <a href='/x'>b <p> c</p></a> d</p>x  <br>y<hr>z<ol><li>1<ul><li>2</ul></ol>", "https://e.com/") == "a [b c](https://e.com/x) d\n\nx\ny\n\n---\n\nz\n\n1. 1\n  - 2"
