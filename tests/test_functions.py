"""URLs, text, contacts, design, JSON-LD: single values."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagewarden.functions import contacts as co
from pagewarden.functions import design as de
from pagewarden.functions import url as ux
from pagewarden.functions.dialect import SPARK
from pagewarden.sources import html, jsonld

URLS = [
    ("HTTP://Example.COM:80/a//b/./c/?z=3&a=1&m=2#x", "http://example.com/a/b/c/?a=1&m=2&z=3"),
    ("https://e.com/?utm_source=newsletter&q=rust&gclid=999", "https://e.com/?q=rust"),
    ("https://e.com/?", "https://e.com/"),
    ("//e.com/x", "https://e.com/x"),
    ("https://e.com.:443", "https://e.com/"),
    ("ftp://e.com/", None),
    ("mailto:a@b.c", None),
    ("", None),
]


@pytest.mark.parametrize("raw,want", URLS)
def test_normalize(spark, raw, want):
    assert ux.normalize_url(raw) == want
    assert spark.createDataFrame([(raw,)], "u string").select(ux.column(ux.normalize, "u")).first()[0] == want


def test_normalize_dots_and_punycode():
    assert ux.normalize_url("https://e.com/a/../b/") == "https://e.com/b/"
    assert ux.normalize_url("https://bücher.de/ä") == "https://xn--bcher-kva.de/%C3%A4"


@given(st.lists(st.tuples(st.sampled_from("abcxyz"), st.sampled_from("123")), max_size=5), st.randoms())
def test_normalize_is_stable(pairs, rnd):
    mixed = pairs[:]
    rnd.shuffle(mixed)
    make = lambda ps: "https://e.com/p?" + "&".join(f"{k}={v}" for k, v in ps)
    one = ux.normalize_url(make(pairs))
    assert one == ux.normalize_url(make(mixed)) == ux.normalize_url(one)


def test_facets_and_importance(spark):
    d = SPARK
    u = "'https://e.com/shop/x?color=red&size=2&sort=price&utm_x=1&brand=q'"
    row = spark.sql(f"SELECT {ux.content_facets(d, u)}, {ux.sorting_facets(d, u)}, {ux.is_asset(d, chr(39) + 'https://e.com/a.PDF?x' + chr(39)) }, {ux.is_pagination_page(d, chr(39) + 'https://e.com/p/x' + chr(39))}, {ux.is_pagination_number(d, chr(39) + 'https://e.com/p/x' + chr(39))}").first()
    assert tuple(row) == (3, 1, True, True, False)
    assert spark.sql(f"SELECT {ux.importance(d, chr(39) + 'https://e.com/a/b?page=2' + chr(39), '1', '30')}").first()[0] == 500 + 1000 + 100 - 40 - 150 - 300


def test_addresses():
    assert not any(map(ux.is_public_address, ["127.0.0.1", "10.1.1.1", "169.254.169.254", "[::1]", "localhost", "x.internal", "[::ffff:10.0.0.1]", "127.1", "2130706433", "0x7f.1", "012.1.1.1", "256.1.1.1"]))
    assert ux.is_public_address("example.com") and ux.is_public_address("8.8.8.8") and ux.is_public_address("134744072")


def test_words_and_robots_bits():
    assert [len(html.words(x)) for x in ("two  words", "", "-- * 7 (x)", "l\u00e4ngs der Stra\u00dfe 12-14", "\u65e5\u672c \u00a0 ok")] == [2, 0, 2, 4, 2]
    assert html.robots_bits("NoIndex, nofollow") == 3 and html.robots_bits("none,noarchive") == 19
    assert html.decoded("a &amp;lt; b") == "a < b"


def test_contacts():
    assert co.find_phones("Phone +880 1856-909131, at night 01856909131. Helpline: 16247\nInvoice no 730915") == ["+880 1856-909131", "16247"]
    assert co.find_phones("Mobile hours 9.30 - 17.15, call since 2019-03-08, taka 41500") == []
    assert co.find_phones("মোবাইল ০১৮৫৬৯০৯১৩১") == ["01856909131"]
    assert co.find_emails("a [at] b [dot] com, x@y.png, Foo@Bar.org 0123456789abcdef0@x.com") == ["a@b.com", "foo@bar.org"]
    assert co.find_whatsapp("https://wa.me/88019347 21560") == ["https://wa.me/8801934721560"]
    assert co.facebook_page("https://m.facebook.com/profile.php?id=12") == "https://www.facebook.com/profile.php?id=12"
    assert co.facebook_page("https://facebook.com/sharer.php?u=x") is None
    assert co.instagram_profile("http://instagram.com/p/abc") is None
    assert co.find_social("//instagram.com/cakes_ok/ https://fb.com/My.Page.") == (["https://www.facebook.com/My.Page"], ["https://www.instagram.com/cakes_ok/"])


def test_design():
    assert de.parse_color("#abc") == ("#AABBCC", 1.0)
    assert de.parse_color("rgb(300,0,0)") is None
    assert de.parse_color("hsl(210 40% 50%)")[0] == "#4D80B3"
    assert de.colors_in("url(#fff) '#eee' #123 rgba(0,0,0,.2)") == ["#112233"]
    found = de.analyse(":root{--f:'Open Sans'} body{font-family:var(--f),serif;color:#111111} h1{font:700 2em/1.2 Inter, sans-serif} @media x{a{color:#111111;box-shadow:0 0 #123456}}")
    assert found["colors"] == [{"hex": "#111111", "count": 2}]
    assert [(f["family"], f["roles"]) for f in found["fonts"]] == [("Inter", ["headings"]), ("Open Sans", ["body"])]
    assert de.google_fonts("https://fonts.googleapis.com/css?family=Open+Sans:400,700|Roboto") == {"Open Sans": [400, 700], "Roboto": []}


def test_json_ld():
    bad = jsonld.parse_json_ld("{x")
    assert bad[0]["schema_type"] == "InvalidJson" and not bad[0]["is_valid_json"]
    some = jsonld.parse_json_ld('{"@graph":[{"@type":"Product","offers":{"lowPrice":1}},{"@type":["Article","X"],"datePublished":"2020-02-31"},{"@type":5}]}')
    assert [r["schema_type"] for r in some] == ["Product", "Article", "Unknown"]
    assert jsonld.bad_dates({"datePublished": "01/02/2020", "a": [{"endDate": "2020-13-01"}]}) == 2
    audit = jsonld.audit_schemas(some)
    assert audit["n_products_no_offer"] == 0 and audit["n_products_no_availability"] == 1
    v = jsonld.validate('<script type="application/ld+json">{"@type":"Product","name":"x"}</script>')
    assert v["detected_type"] == "Product" and not v["is_rich_result_eligible"]


def test_protected_emails():
    hide = lambda mail, key: bytes([key, *(b ^ key for b in mail.encode())]).hex()
    html = f'<a href="/cdn-cgi/l/email-protection#{hide("desk@shop.org", 7)}">x</a><span data-cfemail="{hide("Lee@inn.net", 0x5A).upper()}"></span><i data-cfemail="zz12"></i><i data-cfemail="{hide("not a mail", 3)}"></i>'
    assert co.protected_emails(html).splitlines() == ["desk@shop.org", "Lee@inn.net"]
    assert co.protected_emails("") == ""
