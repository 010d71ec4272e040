"""Scans of markup in one pass forward: the time for a text grows with its length alone, whatever it holds.

Patterns that may begin anywhere and run on to something far away take the square of the length where it is missing; here
what ends an element or a tag is looked up, and nothing is passed over twice."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator


def tags(pattern: re.Pattern, text: str, at: int = 0) -> Iterator[re.Match]:
    """Matches of a pattern that ends in `[^>]*>`."""
    return pattern.finditer(text, at, text.rfind(">") + 1)


def elements(start: re.Pattern, end: re.Pattern, text: str) -> Iterator[tuple[int, int, int, int]]:
    """Where each element begins, its content begins and ends, and it ends; it ends at the first end after its start."""
    at, last = 0, text.rfind(">") + 1
    while (opened := start.search(text, at, last)) and (closed := end.search(text, opened.end())):
        yield opened.start(), opened.end(), closed.start(), closed.end()
        at = closed.end()


def without(start: re.Pattern, end: re.Pattern, text: str, instead: str = " ") -> str:
    out, at = [], 0
    for a, _, _, b in elements(start, end, text):
        out += [text[at:a], instead]
        at = b
    return "".join(out) + text[at:]


class Gaps:
    """How far a run of tags and white space goes from a place."""

    _SPACE = re.compile(r"\s*+")

    def __init__(self, text: str):
        self.text, self.ends, self.known = text, [m.start() for m in re.finditer(">", text)], {}

    def end(self, at: int) -> int:
        met = []
        while True:
            at = self._SPACE.match(self.text, at).end()
            if at in self.known:
                at = self.known[at]
                break
            met.append(at)
            if self.text[at : at + 1] != "<" or self.text[at + 1 : at + 2] == ">":
                break
            k = bisect_left(self.ends, at)
            if k == len(self.ends):
                break
            at = self.ends[k] + 1
        self.known.update(dict.fromkeys(met, at))
        return at


_RUN = r"[\d,.]++"
#: A number as it may follow or precede a currency: digits and commas, then digits and points.
_NUMBER = re.compile(r",*+\d++(?:,++\d++)*+(?:\.[\d.]*+)?+")


def prices(money: str, text: str) -> list[int]:
    """Where each number with a currency before or after it begins, tags and white space between them or not.
    money: a pattern of currencies."""
    token, currency = re.compile(rf"({money})(?=[\s<\d,])|{_RUN}", re.I), re.compile(money, re.I)
    gaps, out, at = Gaps(text), [], 0
    while m := token.search(text, at):
        at = m.end()
        if m[1] is not None:
            if found := _NUMBER.match(text, gaps.end(at)):
                out.append(m.start())
                at = found.end()
            else:
                at = m.start() + 1
            continue
        run = m[0]
        comma = run.rfind(",")
        # no point may stand before the last comma, and that needs a digit after it
        begin = run.rfind(".", 0, comma) + 1 if comma >= 0 and run[comma + 1 : comma + 2].isdecimal() else comma + 1
        begin += len(run[begin:]) - len(run[begin:].lstrip("."))
        if _NUMBER.fullmatch(run, begin) and (found := currency.match(text, gaps.end(at))):
            out.append(m.start() + begin)
            at = found.end()
    return out


def inputs(start: re.Pattern, attribute: re.Pattern, text: str) -> list[int]:
    """Where tags begin that have an attribute; a start within a tag that is open is part of that tag."""
    out, at = [], 0
    while m := start.search(text, at):
        end = text.find(">", m.end())
        end = len(text) if end < 0 else end
        if attribute.search(text, m.end() + 1, end):
            out.append(m.start())
        at = end
    return out


def near(start: re.Pattern, mark: re.Pattern, end: re.Pattern, text: str, most: int) -> bool:
    """Whether, after some start, a mark follows within `most` characters, and after that an end within as many."""
    ends = [m.start() for m in end.finditer(text)]
    good = []
    for m in mark.finditer(text):
        k = bisect_left(ends, m.end())
        if k < len(ends) and ends[k] - m.end() <= most:
            good.append(m.start())
    for m in tags(start, text):
        k = bisect_left(good, m.end())
        if k < len(good) and good[k] - m.end() <= most:
            return True
    return False
