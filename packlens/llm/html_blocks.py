"""Reads a page into its leaf blocks in order: each block's tag path, text and share of link text.

A block is the text between two block-level tags; inline tags join, line breaks are white space, and so is every character that Unicode calls
a space (a no-break space too). Markup, comments, scripts, styles,
frames, form fields (also lists to choose from and buttons), graphics, templates (which are never shown) and the head are dropped here; text inside math, object and noscript is
read like any other. Whether a block is main text is for the labeller to say. Broken pages (unclosed or cut tags,
stray brackets, unfinished comments) give the blocks that can be read.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"  # comment
    r"|<[!?][^>]*(?:>|\Z)"  # doctype, processing instruction
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",  # a quote that isn't closed
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

#: HTML's elements by how their text is read.
RAW = frozenset("script style template iframe svg title textarea head select datalist button".split())
#: Of these, the ones that run to the page's end if they aren't closed; the text after any other unclosed one is read.
TO_END = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
#: A start of the first closes an open element of the second kind nearest to it.
CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    link_share: float


def _names(attributes: str) -> str:
    """The words of class, id and role, joined."""
    if "=" not in attributes:
        return ""
    words = []
    for m in _NAMES.finditer(attributes):
        words += _PART.findall((m[2] or m[3] or m[4] or "").lower())
    return " ".join(dict.fromkeys(words))


def blocks_of(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # block-level elements: tag, tag with its names
    parts: list[str] = []
    linked = 0
    in_link = False
    unended: set[str] = set()  # no end tag from here on

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(x for _, x in stack), text, min(1.0, linked / max(1, sum(map(len, parts))))))
            parts, linked = [], 0

    def pop(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            linked += len(text) if in_link else 0
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing:
                if tag == "head":  # a head that isn't closed ends where the body begins
                    end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                    if end:
                        at = end.end()
                elif tag not in unended and not (tag == "svg" and attributes.endswith("/")):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    if end:
                        at = end.end()
                    elif tag in TO_END:
                        at = len(page)
                    else:
                        unended.add(tag)
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            end_block()
            if closing:
                pop(tag)
            elif tag not in VOID:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if tag in CLOSES and stack and stack[-1][0] in (tag, CLOSES[tag]):
                    stack.pop()
                names = _names(attributes)
                stack.append((tag, f"{tag} {names}" if names else tag))
    end_block()
    return out
