"""Text blocks of one HTML page; the per-row helper of ``sources.pages``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, elements whose text does not count,
# and the elements that are taken when no selector is given.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
DEFAULT_SELECTOR = "p, article, main"


class _Page(HTMLParser):
    """Flat list of elements; each spans a range of the page's text pieces.

    Whitespace is collapsed per piece, so text under nested elements is collapsed
    once.

    An end tag closes the nearest open element of its name and all inside it;
    nothing is closed implicitly, so an unclosed <p> goes on to its parent's end.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.silent = 0
        self.run: list[str] = []

    def _flush(self):
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text and not self.silent:
            self.pieces.append(text)

    def _close_from(self, depth: int):
        for i in self.open[depth:]:
            self.elements[i]["end"] = len(self.pieces)
            self.silent -= self.elements[i]["tag"] in SILENT
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self._flush()
        parent = self.open[-1] if self.open else None
        start = len(self.pieces)
        self.elements.append({
            "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "parent": parent, "start": start, "end": start})
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_from(len(self.open) - 1)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]]["tag"] == tag:
                self._close_from(depth)
                return

    def handle_data(self, data):
        self.run.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self, html: str):
        self.feed(html)
        self.close()
        self._flush()
        self._close_from(0)
        return self


_STEP = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[\w-]+))\s*)?\]""",
    re.VERBOSE,
)


def parse_selector(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Comma list of chains; a chain is [(combinator, tests), ...] from outside to inside.

    Known are tag, *, .class, #id, [attr], [attr=value], descendant and child.
    """
    chains = []
    for part in re.split(r",(?![^\[]*\])", selector):
        chain, how, rest = [], " ", part.strip()
        while rest:
            tests, pos = [], 0
            while (m := _STEP.match(rest, pos)) and m.end() > pos:
                if m["tag"] and tests:
                    break
                value = m["dq"] if m["dq"] is not None else m["sq"] if m["sq"] is not None else m["raw"]
                tests.append((m.lastgroup if not m["attr"] else "attr", m["tag"] or m["cls"] or m["id"] or m["attr"], value))
                pos = m.end()
            gap = re.match(r"\s*>\s*|\s+|$", rest[pos:])
            if not tests or gap is None or (">" in gap[0] and not rest[pos + gap.end():]):
                raise ValueError(f"unsupported selector: {selector!r}")
            chain.append((how, tests))
            how, rest = (">" if ">" in gap[0] else " "), rest[pos + gap.end():]
        if not chain:
            raise ValueError(f"empty selector in {selector!r}")
        chains.append(chain)
    return chains


def _passes(element: dict, tests: list[tuple]) -> bool:
    attrs = element["attrs"]
    for kind, name, value in tests:
        if kind == "tag":
            ok = name == "*" or name.lower() == element["tag"]
        elif kind == "cls":
            ok = name in attrs.get("class", "").split()
        elif kind == "id":
            ok = attrs.get("id") == name
        else:
            ok = name.lower() in attrs and (value is None or attrs[name.lower()] == value)
        if not ok:
            return False
    return True


def _selected(elements: list[dict], chain: list) -> set[int]:
    """Elements that end the chain. One pass per step, each over all elements once."""
    reached = {i for i, e in enumerate(elements) if _passes(e, chain[0][1])}
    for how, tests in chain[1:]:
        below: list[bool] = []
        for e in elements:
            parent = e["parent"]
            inside = parent is not None and (parent in reached or (how == " " and below[parent]))
            below.append(inside)
        reached = {i for i, e in enumerate(elements) if below[i] and _passes(e, tests)}
    return reached


def block_ranges(html: str, chains: list) -> tuple[str, list[tuple[int, int]]]:
    """The whole text of a page, and where each selected element lies in it (first character, number of characters).

    Elements come in document order; nested ones all count. Ranges that overlap share the text, so unclosed elements
    cost no more memory than others.
    """
    page = _Page().finish(html)
    hits = set().union(*(_selected(page.elements, chain) for chain in chains))
    at = [0]
    for piece in page.pieces:
        at.append(at[-1] + len(piece) + 1)
    ranges = [(at[e["start"]], max(0, at[e["end"]] - at[e["start"]] - 1)) for i, e in enumerate(page.elements) if i in hits]
    return " ".join(page.pieces), ranges


def text_blocks(html: str, chains: list) -> Iterator[str]:
    """Joined text of every selected element; see ``block_ranges``."""
    text, ranges = block_ranges(html, chains)
    return (text[first:first + n] for first, n in ranges)
