"""HTML to plain text, without what a reader would not see.

One pass over the tokens of the page keeps a stack of open elements.  Blocks become lines, cells are joined by bars,
quotations get marks, links show where they lead.  What is hidden (by attribute, by style, by size, colour of the
ground, position or a class of the page's own style sheet) is left out and reported, as is text in comments that
reads like sentences.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_IN, LONGEST_OUT, DEEPEST = 4_000_000, 2_000_000, 512
# Kinds of elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template object iframe svg math textarea select".split())

_TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<!(?P<decl>[^>]*)>|<\?[^>]*>|<(?P<close>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_SENTENCES = re.compile(r"[^\W\d_]{2,}")


def declarations(style: str) -> dict[str, str]:
    out = {}
    for part in html.unescape(style or "").split(";"):
        name, _, value = part.partition(":")
        if value:
            out[name.strip().lower()] = value.strip().lower().removesuffix("!important").strip()
    return out


def _length(value: str | None) -> float | None:
    m = re.match(r"(-?\d*\.?\d+)\s*(px|pt|em|rem|%|)", value or "")
    return float(m[1]) * {"pt": 1.33, "em": 16, "rem": 16}.get(m[2], 1) if m and m[1] not in (".", "-") else None


def _colour(value: str | None) -> tuple[int, ...] | None:
    v = (value or "").strip()
    if m := re.search(r"#([0-9a-f]{6}|[0-9a-f]{3})\b", v):
        h = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
        return tuple(int(h[i : i + 2], 16) for i in (0, 2, 4))
    if m := re.search(r"rgba?\(\s*(\d+)[,\s]+(\d+)[,\s]+(\d+)(?:[,/\s]+([\d.]+%?))?", v):
        return tuple(map(int, m.groups()[:3]))
    return {"white": (255, 255, 255), "black": (0, 0, 0)}.get(v)


def removed(style: dict[str, str]) -> bool:
    """Whether these declarations take an element and all inside of it out of sight; nothing inside can undo it."""
    small = lambda k, most: (n := _length(style.get(k))) is not None and n <= most
    if style.get("display") == "none" or style.get("mso-hide") == "all" or small("opacity", 0.049) or small("text-indent", -500):
        return True
    clipped = "hidden" in style.get("overflow", "") or "hidden" in style.get("overflow-y", "")
    if clipped and (small("max-height", 1) or small("height", 1) or small("width", 1) or small("max-width", 1)):
        return True
    return style.get("position") in ("absolute", "fixed") and (small("left", -500) or small("top", -500) or "rect(0" in style.get("clip", ""))


@dataclass(frozen=True)
class Look:
    """What text inherits from the elements around it, and what an element inside may set anew."""

    ground: tuple[int, ...] | None = (255, 255, 255)
    colour: tuple[int, ...] | None = None
    clear: bool = False
    tiny: bool = False
    unseen: bool = False

    def inside(self, style: dict[str, str]) -> Look:
        if not style:
            return self
        size, colour, seen = _length(style.get("font-size")), style.get("color"), style.get("visibility")
        return Look(
            _colour(style.get("background-color") or style.get("background")) or self.ground, _colour(colour) if colour else self.colour,
            colour == "transparent" or bool(re.search(r"rgba\([^)]*[,/]\s*0?\.?0+%?\s*\)", colour)) if colour else self.clear,
            size <= 2 if size is not None else self.tiny, seen in ("hidden", "collapse") if seen else self.unseen,
        )

    @property
    def invisible(self) -> bool:
        same = self.colour and self.ground and max(abs(a - b) for a, b in zip(self.colour, self.ground)) <= 8
        return self.tiny or self.unseen or self.clear or bool(same)


def hides(style: dict[str, str], ground: tuple[int, ...] | None = None) -> bool:
    """Whether text right inside an element with these declarations is invisible."""
    return removed(style) or Look(ground).inside(style).invisible


_ALWAYS = re.compile(r"@media\s*(?:(?:only\s+)?(?:all|screen)(?:\s*,\s*(?:all|screen))*)?$", re.I)


def style_rules(page: str, longest: int = 512 * 1024) -> dict[str, dict[str, str]]:
    """Declarations of .class, #id and tag from the style sheets of a page.

    Of a selector the classes and ids of its last part count; a tag counts where it stands alone.  Rules that hold under
    conditions only (widths, print, states, attributes) are left out.
    """
    rules: dict[str, dict[str, str]] = {}
    for sheet in re.findall(r"<style\b[^>]*>(.*?)(?:</style|\Z)", page, re.S | re.I):
        sheet, longest = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet[: max(0, longest)], flags=re.S), longest - len(sheet)
        depth = conditional = 0
        head = ""
        for part, mark in re.findall(r"([^{}]*)([{}])", sheet):
            if mark == "{":
                depth, head = depth + 1, part.rsplit(";", 1)[-1].strip()
                if head.startswith("@") and not _ALWAYS.match(head) and not conditional:
                    conditional = depth
                continue
            if head and not head.startswith("@") and not conditional and (found := declarations(part)):
                for selector in head.split(","):
                    last = (re.split(r"[\s>+~]+", selector.strip()) or [""])[-1]
                    if not re.search(r"[:\[*]", last):
                        names = [m[0].lower() for m in re.finditer(r"[.#][\w-]{1,100}", last)]
                        if re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", selector.strip()) and last.lower() not in ("html", "body"):
                            names.append(last.lower())
                        for name in names:
                            rules.setdefault(name, {}).update(found)
            conditional = 0 if conditional == depth else conditional
            depth, head = max(0, depth - 1), ""
    return rules


def to_text(page: str | None) -> tuple[str, bool]:
    """(text, whether something hidden was left out)."""
    page = (page or "")[:LONGEST_IN]
    rules = style_rules(page)
    out: list[str] = []
    size, hidden_removed = 0, False
    stack: list[tuple[str, bool, Look, str]] = []  # tag, removed, look, link
    silent = quote = pre = 0
    lists: list[int] = []

    def emit(text: str) -> None:
        nonlocal size
        if size < LONGEST_OUT:
            out.append(text)
            size += len(text)

    def line() -> None:
        emit("\n" + "> " * quote)

    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if m["comment"] is not None:
            hidden_removed |= len(_SENTENCES.findall(re.sub(r"<[^>]*>|\[if.*?\]", " ", m["comment"]))) >= 8 and "<" not in m["comment"]
            continue
        if m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                while any(s[0] == tag for s in stack):
                    top = stack.pop()
                    silent -= top[0] in SILENT
                    if top[0] == "blockquote":
                        quote -= 1
                    if top[0] in ("ol", "ul") and lists:
                        lists.pop()
                    pre -= top[0] == "pre"
                    if not silent and top[0] == "a" and top[3] and not top[1]:
                        emit(f" <{top[3]}>")
                    if top[0] in ("td", "th") and not silent:
                        emit(" | ")
                    if top[0] == tag:
                        break
                if tag in BLOCKS and not silent:
                    line()
                continue
            attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(m["attrs"] or "")}
            style: dict[str, str] = dict(rules.get(tag, ()))
            for name in [f".{c}" for c in attrs.get("class", "").lower().split()] + ([f"#{attrs['id'].lower()}"] if attrs.get("id") else []):
                style.update(rules.get(name, {}))
            if attrs.get("bgcolor"):
                style.setdefault("background-color", attrs["bgcolor"].lower())
            if attrs.get("color"):
                style.setdefault("color", attrs["color"].lower())
            style.update(declarations(attrs.get("style", "")))
            parent = stack[-1] if stack else ("", False, Look(), "")
            hidden = parent[1] or "hidden" in attrs or removed(style)
            look = parent[2].inside(style)
            if tag in BLOCKS and not silent and not hidden:
                line()
            if tag == "br" and not silent and not hidden:
                line()
            if tag == "hr" and not silent and not hidden:
                emit("---")
                line()
            if tag == "li" and not silent and not hidden:
                if lists and lists[-1] >= 0:
                    lists[-1] += 1
                    emit(f"{lists[-1]}. ")
                else:
                    emit("- ")
            if tag == "img" and attrs.get("alt") and not silent and not hidden and _length(attrs.get("width", "9")) not in (0.0, 1.0):
                emit(f"[{attrs['alt'].strip()}]")
            if tag in VOID or (m["attrs"] or "").rstrip().endswith("/") or len(stack) >= DEEPEST:
                continue
            href = attrs.get("href", "")
            stack.append((tag, hidden, look, href[:200] if tag == "a" and re.match(r"https?:|mailto:", href, re.I) else ""))
            silent += tag in SILENT
            pre += tag == "pre"
            if tag == "blockquote" and not silent:
                quote += 1
                if not hidden:
                    line()
            if tag in ("ol", "ul"):
                lists.append(0 if tag == "ol" else -1)
            continue
        if kind == "text" and not silent:
            text = html.unescape(m["text"])
            if stack and (stack[-1][1] or stack[-1][2].invisible):
                hidden_removed |= bool(text.strip())
            else:
                emit(text if pre else re.sub(r"[ \t\r\n\f]+", " ", text))
    text = "".join(out)
    text = re.sub(r"(?: \| )+(?=\n|$)", "", re.sub(r"[ \t]+\n", "\n", text))
    text = re.sub(r"(?m)^((?:> )*)[ \t]+", r"\1", text)
    text = re.sub(r"[ \t]{2,}", " ", text) if "<pre" not in page.lower() else text
    text = re.sub(r"(?:\n(?:> )*[ \t]*){3,}(?=(?:> )*\S)", lambda m: "\n\n" + m[0].rsplit("\n", 1)[1], text)
    return text.strip(), hidden_removed


def html_to_text(page: Column) -> Column:
    """struct(text, hidden_removed) of a column of pages, in Arrow batches; null gives empty text."""

    @F.pandas_udf("text string, hidden_removed boolean")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            yield pd.DataFrame([to_text(p) for p in pages], columns=["text", "hidden_removed"])

    return convert(page)
