"""Colours and fonts of style sheets."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from urllib.parse import parse_qsl, urlsplit

# Properties whose colours are effects, families that name no font, least opacity.
EFFECTS = {"box-shadow", "-webkit-box-shadow", "text-shadow", "filter", "-webkit-filter", "backdrop-filter", "-webkit-backdrop-filter"}
GENERIC = set("serif sans-serif monospace cursive fantasy system-ui ui-serif ui-sans-serif ui-monospace ui-rounded emoji math fangsong inherit initial unset revert".split())
LEAST_ALPHA = 0.5
ICONS = re.compile(r"(?i)icon|awesome|glyph|material symbols|dashicons|slick|swiper")
COLOUR = re.compile(r"(?i)\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|url\([^)]*\)|(#[0-9a-z-]+)|(?<![\w-])((?:rgba?|hsla?|oklch)\([^()]{1,90}\))")


def _numbers(text: str) -> tuple[list[float], float]:
    """The first three numbers of a colour function, and its alpha."""
    inner = text[text.index("(") + 1 : -1]
    main, slash, alpha = inner.partition("/")
    parts = [p for p in re.split(r"[,\s]+", main) if p]
    if not slash and len(parts) > 3:
        alpha = parts[3]
    read = lambda p: float(p.removesuffix("deg").rstrip("%")) / (100 if p.endswith("%") else 1)
    return [read(p) for p in parts[:3]], read(alpha.strip()) if alpha.strip() else 1.0


def _hex(*channels: float) -> str:
    return "#" + "".join(f"{int(min(1, max(0, c)) * 255 + 0.5):02X}" for c in channels)


def parse_color(literal: str) -> tuple[str, float] | None:
    """#RRGGBB and alpha of a literal; None for anything else."""
    text = literal.strip().lower()
    if text.startswith("#"):
        digits = text[1:]
        if len(digits) not in (3, 4, 6, 8) or not re.fullmatch("[0-9a-f]+", digits):
            return None
        if len(digits) < 6:
            digits = "".join(c * 2 for c in digits)
        return "#" + digits[:6].upper(), int(digits[6:] or "ff", 16) / 255
    try:
        numbers, alpha = _numbers(text)
        x, y, z = numbers
    except ValueError:
        return None
    if text.startswith("rgb"):
        if max(numbers) > 255 or any(n != int(n) for n in numbers):
            return None
        return "#" + "".join(f"{int(n):02X}" for n in numbers), alpha
    if text.startswith("hsl"):
        chroma = (1 - abs(2 * z - 1)) * y
        part = lambda n: z - chroma / 2 * max(-1.0, min(1.0, (k := (n + x % 360 / 30) % 12) - 3, 9 - k))
        return _hex(part(0), part(8), part(4)), alpha
    # OKLCH by way of OKLab to linear and then gamma-encoded sRGB (CSS Color 4); the matrices are fixed values.
    light = x / 100 if x > 1 else x
    a, b = y * math.cos(math.radians(z)), y * math.sin(math.radians(z))
    cone = [(light + p * a + q * b) ** 3 for p, q in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.291485548))]
    linear = [sum(m * c for m, c in zip(row, cone)) for row in ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))]
    return _hex(*(12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055 for c in linear)), alpha


def colors_in(value: str) -> list[str]:
    """Colours of a declaration's value, outside of strings and urls, that are at least half opaque."""
    found = [parse_color(a or b) for a, b in COLOUR.findall(value) if a or b]
    return [c for c, alpha in filter(None, found) if alpha >= LEAST_ALPHA]


def rules_of(css: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Selector and declarations of every style rule, nested ones and those inside of @ groups included."""
    css = re.sub(r"(?s)/\*.*?\*/", "", css.lstrip("﻿"))
    out, stack, text = [], [], ""
    for piece in re.findall(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|url\([^)]*\)|[{};]|[^{};\"'u]+|u", css):
        if piece == "{":
            stack.append((text.strip(), []))
            text = ""
        elif piece in ";}":
            if stack and ":" in text:
                name, _, value = text.partition(":")
                stack[-1][1].append((name.strip().lower(), value.replace("!important", "").strip()))
            text = ""
            if piece == "}" and stack:
                out.append(stack.pop())
        else:
            text += piece
    return out + stack[::-1]


def resolve_vars(value: str, variables: dict[str, str], levels: int = 3) -> str:
    """var(--x) replaced by its value or fallback, so many levels deep."""
    for _ in range(levels):
        new = re.sub(r"var\(\s*(--[\w-]+)\s*(?:,((?:[^()]|\([^()]*\))*))?\)", lambda m: variables.get(m[1], (m[2] or "").strip()), value)
        if new == value or len(new) > 10_000:
            break
        value = new
    return value


def family_of(value: str, variables: dict[str, str]) -> str | None:
    """The first named family of a font-family value, without the hashing of build tools."""
    for part in re.findall(r"(?:\"[^\"]*\"|'[^']*'|[^,\"'])+", resolve_vars(value, variables).replace("\\", "")):
        name = " ".join(part.strip().strip("\"'").split())
        if m := re.fullmatch(r"__(.+?)(_Fallback)?(?:_[0-9a-fA-F]{5,})?", name):
            name = m[1].replace("_", " ") + (" Fallback" if m[2] else "")
        low = name.lower()
        if name and low not in GENERIC and not low.endswith(" fallback") and not low.startswith(("--", "var(")) and "(" not in name:
            return name[:80]
    return None


def shorthand_family(value: str, variables: dict[str, str]) -> str | None:
    m = re.search(r"(?:^|\s)[\d.]+(?:[a-z]+|%)(?:\s*/\s*\S+)?\s+(.+)$", resolve_vars(value, variables), re.I | re.S)
    return family_of(m[1], {}) if m else None


def roles_of(selectors: str) -> set[str]:
    """The kinds of text that a selector list targets."""
    out = set()
    for s in map(str.strip, selectors.lower().split(",")):
        types = set(re.findall(r"(?:^|[\s>+~(])([a-z][\w-]*)", s))
        classes = set(re.findall(r"\.([\w-]+)", s))
        out |= {"headings"} if types & {"h1", "h2", "h3"} else set()
        out |= {"body"} if types & {"body", "html", "p"} or s in (":root", "*") else set()
        out |= {"buttons"} if "button" in types or classes & {"btn", "button"} or "submit" in s else set()
        out |= {"links"} if "a" in types else set()
    return out


def google_fonts(url: str) -> dict[str, list[int]]:
    """Families and weights that a font service's address names."""
    u = urlsplit(url)
    out: dict[str, set[int]] = defaultdict(set)
    if (u.hostname or "").lower() in ("fonts.googleapis.com", "fonts.gstatic.com"):
        for key, value in parse_qsl(u.query):
            for entry in value.split("|") if key == "family" else ():
                name, _, spec = entry.partition(":")
                if name.strip():
                    out[name.strip()] |= {int(w) for w in re.findall(r"(?<!\d)([1-9]00)(?!\d)", spec)}
    return {k: sorted(v) for k, v in sorted(out.items())}


def analyse(css: str) -> dict:
    """colors (by count, then code) and fonts (family, roles, weights) of a style sheet."""
    rules = rules_of(css)
    variables = {n: v for _, declared in rules for n, v in declared if n.startswith("--")}
    colors: Counter = Counter()
    fonts: dict[str, tuple[set, set]] = {}
    for selector, declared in rules:
        roles = roles_of(selector) if not selector.startswith("@") else set()
        weights = [int(w) for n, v in declared if n == "font-weight" for w in re.findall(r"(?<!\d)([1-9]00)(?!\d)", {"normal": "400", "bold": "700"}.get(v.lower(), v))]
        for name, value in declared:
            if name in ("font", "font-family"):
                family = (shorthand_family if name == "font" else family_of)(value, variables)
                if family and not ICONS.search(family):
                    known = fonts.setdefault(family, (set(), set()))
                    known[0].update(roles)
                    known[1].update(weights[:1] if roles or selector.lower().startswith("@font-face") else [])
            if not (name in EFFECTS or name.startswith("--") and "shadow" in name or "drop-shadow(" in value):
                colors.update(colors_in(value if name.startswith("--") else resolve_vars(value, variables)))
    ranked = sorted(colors.items(), key=lambda x: (-x[1], x[0]))
    named = sorted(fonts.items(), key=lambda x: (not x[1][0], x[0]))
    return {"colors": [{"hex": h, "count": n} for h, n in ranked], "fonts": [{"family": f, "roles": sorted(r), "weights": sorted(w)} for f, (r, w) in named]}
