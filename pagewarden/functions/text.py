"""Text functions: white space, entities, robots directives, words, hashes, simhash."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D\x{00A0}]"
# Entities decoded in fields, in this order, and bits of robots directives.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]
DIRECTIVES = {"noindex": 1, "nofollow": 2, "nosnippet": 4, "noimageindex": 8, "noarchive": 16, "none": 3}
EXCLUDED = ("head", "nav", "header", "footer", "script", "style", "noscript")


def clean(d, x):
    """White space collapsed and trimmed."""
    return d.rep(d.rep(x, SPACE + "+", " "), "^ | $")


def decode(d, x):
    for a, b in ENTITIES:
        x = f"replace({x}, {d.text(a)}, {d.text(b)})"
    return x


def field(d, x):
    """A field's text: tags out, entities decoded, white space collapsed."""
    return clean(d, decode(d, d.rep(x, "<[^>]*>", "")))


def robots_flags(d, x):
    """Bits of a robots directive list."""
    items = d.map(d.split(f"lower({x})", ","), "i", clean(d, "i"))
    # Bits are distinct per directive except none = noindex + nofollow, so each is tested for itself.
    def bit(value, *names):
        chosen = d.keep(items, "i", "i IN (" + ", ".join(f"'{n}'" for n in names) + ")")
        return f"CASE WHEN {d.size(chosen)} > 0 THEN {value} ELSE 0 END"

    both = {n: [n, "none"] if DIRECTIVES["none"] & v else [n] for n, v in DIRECTIVES.items() if n != "none"}
    return " + ".join(bit(DIRECTIVES[n], *names) for n, names in both.items())


def words(d, x):
    """Tokens that hold a letter or digit."""
    return d.keep(d.split(x, SPACE + "+"), "w", d.has("w", r"[\p{L}\p{N}]"))


def word_count(d, x):
    return d.size(words(d, x))


def editorial(d, html):
    """Text outside of head, menus, headers, footers and scripts; every tag splits words."""
    for tag in ("script", "style", "noscript", "head", "nav", "header", "footer"):
        html = d.rep(html, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    return clean(d, d.rep(d.rep(html, "(?s)<!--.*?-->", " "), "<[^>]*>", " "))


def tokens(d, x):
    """Words in lower case without punctuation around them, for simhash."""
    bare = d.map(d.split(f"lower({x})", SPACE + "+"), "w", d.rep("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"))
    return d.keep(bare, "w", "w <> ''")


SIMHASH_BITS = 60


def simhash_sums(d, h):
    """Aggregates over token hashes h: the votes of each bit put together."""
    one = lambda i: f"CASE WHEN sum(CASE WHEN ({h} & {1 << i}) <> 0 THEN 1 ELSE -1 END) > 0 THEN {1 << i} ELSE 0 END"
    return "cast(" + " + ".join(f"cast({one(i)} AS BIGINT)" for i in range(SIMHASH_BITS)) + " AS BIGINT)"
