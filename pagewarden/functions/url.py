"""URL functions: normalising, classes of query parameters, internal links, importance.

The functions that take a dialect give SQL text; the others are Columns or plain Python."""

from __future__ import annotations

import ipaddress
import re
import socket
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK

# Parameters that are tracking, that sort or shape a listing, extensions of static assets.
TRACKING = "fbclid gclid msclkid mc_eid _ga _gl ref source affiliate scm spm pvid clicktrackinfo wh_pid hybrid data_prefetch".split()
SORTING = "sort order dir orderby sort_by limit count per_page view display mode layout".split()
ASSETS = (
    "pdf doc docx xls xlsx ppt pptx odt rtf gpg ascii sig txt csv tsv zip tar gz tgz 7z rar bz2 xz iso bin exe dmg pkg deb rpm apk "
    "png jpg jpeg gif svg webp avif ico bmp tiff tif psd mp4 webm mkv avi mov mp3 wav ogg m4a flac aac css js mjs cjs json xml woff woff2 ttf eot otf map"
).split()

_FRONT = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def _any(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def scheme(d, u):
    return f"lower({d.ext(u, '^([A-Za-z][A-Za-z0-9+.-]*)://')})"


def authority(d, u):
    return d.ext(u, _FRONT + r"([^/?#]*)")


def host(d, u):
    """Host in lower case, without user, port and trailing dot."""
    return f"lower({d.rep(d.rep(authority(d, u), '^[^@]*@'), '[.]?(:[0-9]*)?$')})"


def path(d, u):
    return d.ext(u, _FRONT + r"[^/?#]*([^?#]*)")


def query(d, u):
    return d.ext(u, r"^[^?#]*[?]([^#]*)")


def parameters(d, u):
    """Non-empty key=value pairs of the query."""
    return d.keep(d.split(query(d, u), "&"), "p", "p <> ''")


def key(d, p):
    return f"lower({d.ext(p, '^([^=]*)')})"


def is_tracking(d, p):
    return f"({key(d, p)} LIKE 'utm!_%' ESCAPE '!' OR {key(d, p)} IN {_any(TRACKING)})"


def is_sorting(d, p):
    return f"({key(d, p)} IN {_any(SORTING)})"


def content_facets(d, u):
    """Number of parameters that are neither tracking nor sorting."""
    return d.size(d.keep(parameters(d, u), "p", f"NOT {is_tracking(d, 'p')} AND NOT {is_sorting(d, 'p')}"))


def sorting_facets(d, u):
    return d.size(d.keep(parameters(d, u), "p", is_sorting(d, "p")))


def segments(d, u):
    return d.keep(d.split(path(d, u), "/"), "s", "s NOT IN ('', '.')")


def normalize(d, u):
    """The normal form of an absolute http(s) URL, or NULL: lower-case scheme and host, no default port,
    fragment or tracking parameter, sorted parameters, single slashes. Parent segments and escapes need
    normalize_url() below."""
    raw = d.rep(d.rep(u, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"), "^//", "https://")
    port = d.ext(authority(d, raw), ":([0-9]+)$")
    shown = f"CASE WHEN {port} = '' OR ({scheme(d, raw)} = 'http' AND {port} = '80') OR ({scheme(d, raw)} = 'https' AND {port} = '443') THEN '' ELSE concat(':', {port}) END"
    kept = d.sort(d.keep(parameters(d, raw), "p", f"NOT {is_tracking(d, 'p')}"))
    clean = f"CASE WHEN {d.size(segments(d, raw))} = 0 THEN '/' ELSE concat('/', {d.join(segments(d, raw), '/')}, CASE WHEN {d.has(path(d, raw), '/$')} THEN '/' ELSE '' END) END"
    tail = f"CASE WHEN {d.size(kept)} = 0 THEN '' ELSE concat('?', {d.join(kept, '&')}) END"
    return f"CASE WHEN {scheme(d, raw)} IN ('http', 'https') AND {host(d, raw)} <> '' THEN concat({scheme(d, raw)}, '://', {host(d, raw)}, {shown}, {clean}, {tail}) END"


def is_asset(d, u):
    return f"(lower({d.ext(path(d, u), '[.]([^./]+)$')}) IN {_any(ASSETS)})"


def is_pagination_page(d, u):
    """As page rules see it: a page, p, pg or paged parameter, or a page path."""
    return f"({d.size(d.keep(parameters(d, u), 'p', key(d, 'p') + ' IN ' + _any(['page', 'p', 'pg', 'paged'])))} > 0 OR {d.has(f'lower({path(d, u)})', '/(page|p)/')})"


def is_pagination_number(d, u):
    """As the frontier sees it: such a parameter, or a page path, with a number."""
    p = d.size(d.keep(parameters(d, u), "p", d.has("lower(p)", "^(page|p|pg|paged)=[0-9]+$")))
    return f"({p} > 0 OR {d.has(f'lower({path(d, u)})', '/(page|p|pg)/[0-9]+(/|$)')})"


def importance(d, u, depth, in_degree, seed="FALSE"):
    """Priority of a URL in the crawl frontier."""
    return (
        f"(CASE WHEN {seed} THEN 500 ELSE 0 END + {d.div(1000, f'1 + {depth}')} + 50 * least({in_degree}, 20) + 100"
        f" - 20 * {d.size(segments(d, u))} - 150 * {d.size(parameters(d, u))} - CASE WHEN {is_pagination_number(d, u)} THEN 300 ELSE 0 END"
        f" - CASE WHEN {sorting_facets(d, u)} > 0 THEN 500 ELSE 0 END)"
    )


def resolve(d, u, base):
    """A link's target against its page: absolute, protocol-relative, root-relative, query or relative."""
    root = f"concat({scheme(d, base)}, '://', {authority(d, base)})"
    folder = d.ext(path(d, base), "^(.*/)")
    return (
        f"CASE WHEN {u} IS NULL THEN NULL WHEN {d.has(u, '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN {u} WHEN {u} LIKE '//%' THEN concat({scheme(d, base)}, ':', {u})"
        f" WHEN {u} LIKE '/%' THEN concat({root}, {u}) WHEN {u} LIKE '?%' THEN concat({root}, {path(d, base)}, {u})"
        f" WHEN {u} LIKE '#%' OR {u} = '' THEN NULL ELSE concat({root}, CASE WHEN {folder} = '' THEN '/' ELSE {folder} END, {u}) END"
    )


def column(f, *names: str, **more) -> Column:
    """One of the functions above as a Column over columns."""
    return F.expr(f(SPARK, *names, **more))


# Plain Python, for parsers that run in Arrow batches.

_SAFE_PATH = "/%:@!$&'()*+,;=-._~"


def normalize_url(raw: str) -> str | None:
    """The normal form of a URL, with dot segments, Punycode and escapes; None if it isn't http(s)."""
    raw = raw.strip()
    if raw.startswith("//"):
        raw = "https:" + raw
    try:
        u = urlsplit(raw)
        name, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not name:
        return None
    if not name.isascii():
        try:
            name = name.encode("idna").decode()
        except UnicodeError:
            return None
    if port == {"http": 80, "https": 443}[u.scheme.lower()]:
        port = None
    parts: list[str] = []
    for s in u.path.split("/"):
        if s == "..":
            del parts[-1:]
        elif s not in ("", "."):
            parts.append(s)
    way = "/" + "/".join(parts)
    if parts and u.path.endswith("/"):
        way += "/"
    pairs = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING))
    tail = "?" + "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in pairs) if pairs else ""
    return f"{u.scheme.lower()}://{name.lower()}{f':{port}' if port else ''}{quote(way, safe=_SAFE_PATH)}{tail}"


def resolve_url(base: str, href: str) -> str | None:
    try:
        return normalize_url(urljoin(base, href.strip()))
    except ValueError:
        return None


def same_host(a: str, b: str) -> bool:
    return (urlsplit(a).hostname or "").lower() == (urlsplit(b).hostname or "")


def is_public_address(name: str) -> bool:
    """Whether a host may be fetched: no loopback, private, link-local, metadata or reserved address."""
    bare = name.strip("[]").rstrip(".").lower()
    if bare in ("localhost", "metadata.google.internal") or bare.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        ip = ipaddress.ip_address(bare)
    except ValueError:
        if not re.search(r"(?:^|[.])(?:[0-9]+|0x[0-9a-f]*)$", bare):
            return True
        try:  # what ends in a number is an address, as short or as odd as URLs may write it, or nothing
            ip = ipaddress.ip_address(socket.inet_aton(bare))
        except OSError:
            return False
    inner = getattr(ip, "ipv4_mapped", None) or getattr(ip, "sixtofour", None)
    return ip.is_global and not ip.is_multicast and (inner is None or inner.is_global)


def decoded(text: str) -> str:
    return unquote(text)


WORD = re.compile(r"[^\W_]+")
