"""Layout-aware HTML rendering: all visible text of a page, laid out as a browser would place it.

A tokenizer of states reads each character of a page a bounded number of times. A tolerant tree builder (implied end
tags, void elements, raw text, misplaced end tags) feeds a renderer that follows visibility rules and lays out blocks
with their spacing, lists with markers and indentation, and tables with aligned cells, column and row spans included.

Visibility: elements that are never displayed, ``hidden``, closed ``details`` but for their summary, ``dialog`` that is
not open, and ``display: none`` hide all below them; ``visibility: hidden`` hides what below does not say ``visible``.
Both are read from ``style`` attributes and from the style sheets that apply to a screen (no other type or medium, not inside
``noscript`` or ``template``), there from rules whose selectors are compounds of tag, id and classes. Other rules (combinators,
attributes, pseudo-classes, nesting, conditional groups) hide nothing; where one of them may show an element, no
sheet hides that element, since whether it does is not known and text must not be lost. Form fields
show their value, else their placeholder; lists of choices show what is chosen, or all choices where several show.

Defined results: a null or empty page has empty text; text outside any tag is kept; elements deeper than ``DEEPEST``
are attached to their ancestor at that depth, as browsers do; an unclosed comment or raw text element runs to the end
of the page, and a tag that the page ends in is dropped; rows that repeat a page_id are rendered one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import bounded, lean

#: Fixed values of browsers and of the HTML standard.
DEEPEST, MOST_COLUMNS = 512, 1000
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_VALUE = frozenset("hidden checkbox radio file image range color password".split())
HIDDEN = frozenset("area audio base canvas datalist embed head iframe link map meta meter noembed noframes noscript object param progress rp script source style template title track video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp plaintext listing".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp dir fieldset listing".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp listing".split()
)
#: start tag -> (open elements that it ends, elements beyond which it does not look)
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{t: (frozenset([t]), frozenset(["ul", "ol", "menu", "dir", "table", "td", "th"])) for t in ("li",)},
    **{t: (frozenset(["dd", "dt"]), frozenset(["dl", "table", "td", "th"])) for t in ("dd", "dt")},
    **{t: (frozenset(["td", "th"]), frozenset(["tr", "table"])) for t in ("td", "th")},
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    **{t: (frozenset(["rt", "rp"]), frozenset(["ruby"])) for t in ("rt", "rp")},
}
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())

_SKIP = re.compile(r"[\s/]*")
_TAG_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTR_NAME = re.compile(r"=?[^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_BARE = re.compile(r"[^\t\n\f\r >]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I) for t in RAW}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?\d{1,18})")
_NO_ATTRS: dict[str, str] = {}
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[.#][A-Za-z_-][\w-]*)*)")
_CSS_SIGN = re.compile(r"""[{};]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""")
_LOOSE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[.#](?:[\w-]|\\.|[^\x00-\x7f])+|:[\w-]+)*)")
_BRACKETS = re.compile(r"\[[^\[\]]*\]|\([^()]*\)")
_PSEUDO_ELEMENT = re.compile(r"::|:(?:before|after|first-line|first-letter)\b", re.I)
_HEX_ESCAPE, _ESCAPED = re.compile(r"\\[0-9A-Fa-f]"), re.compile(r"\\(.)")
_MEDIA_ONLY = re.compile(r"^only\s+")
OTHER_MEDIA = frozenset("print speech aural braille embossed handheld projection tty tv".split())
GROUPS = frozenset("supports layer container scope document starting-style -moz-document".split())
_SAYS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "gone", "seen")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.gone, self.seen = False, None  # not displayed; visible (None: as the parent)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes, where the tag has ended) from behind a tag's name; -1: the page ends in the tag."""
    attrs, end = _NO_ATTRS, len(page)
    while True:
        at = _SKIP.match(page, at).end()
        if at >= end:
            return attrs, -1
        if page[at] == ">":
            return attrs, at + 1
        name = _ATTR_NAME.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                close = page.find(quote, at + 1)
                if close < 0:
                    return attrs, -1
                value, at = page[at + 1 : close], close + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare.group(), bare.end()
        if attrs is _NO_ATTRS:
            attrs = {}
        attrs.setdefault(name.group().lower(), unescape(value) if "&" in value else value)


class _Open(list):
    """Open elements, and how many there are of each tag, so that one that is not open is not searched."""

    def __init__(self, nodes: list[Node]):
        super().__init__(nodes)
        self.count: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def cut(self, at: int) -> None:
        for node in self[at:]:
            self.count[node.tag] -= 1
        del self[at:]


def parse(page: str) -> Node:
    """The page's tree. Text is unescaped, except in raw elements that take none."""
    root = Node("html", _NO_ATTRS)
    stack = _Open([root])
    at = text = 0  # text: where the text that is not yet in the tree starts
    end = len(page)

    def flush(until: int) -> None:
        if until > text:
            stack[-1].kids.append(unescape(page[text:until]))

    while (at := page.find("<", at)) >= 0:
        kind = page[at + 1 : at + 2]
        closing = kind == "/"
        name = _TAG_NAME.match(page, at + 1 + closing)
        if not name:
            if not (closing or kind in ("!", "?")) or not kind:
                at += 1  # a sign of the text
                continue
            flush(at)
            if page.startswith("<!--", at):
                if page.startswith((">", "->"), at + 4):
                    stop = page.find(">", at) + 1
                else:
                    found = _COMMENT_END.search(page, at + 4)
                    stop = found.end() if found else end
            else:
                stop = page.find(">", at) + 1 or end
            at = text = stop
            continue
        flush(at)
        attrs, stop = _attributes(page, name.end())
        at = text = end if stop < 0 else stop
        if stop < 0:
            break
        tag = name.group().lower()
        if closing:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag == "plaintext":
            node.kids.append(page[at:])
            at = text = end
            break
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            inside = page[at : found.start() if found else end]
            node.kids.append(unescape(inside) if tag in ("textarea", "title") else inside)
            stop = _attributes(page, found.end())[1] if found else -1
            at = text = end if stop < 0 else stop
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.push(node)
    flush(end)
    _mark(root)
    return root


def _medium(query: str) -> bool | None:
    """Whether a list of media applies to a screen; None where it depends on more than the kind of medium."""
    found = {_MEDIA_ONLY.sub("", x.strip().lower()) for x in query.split(",")}
    if found & {"", "all", "screen"}:
        return True
    return False if found <= OTHER_MEDIA else None


def _outside(text: str, sign: str) -> list[str]:
    """``text`` cut at ``sign`` outside of brackets."""
    out, depth, at = [], 0, 0
    for found in re.finditer(rf"[()\[\]{sign}]", text):
        if found.group() in "([":
            depth += 1
        elif found.group() in ")]":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(text[at : found.start()])
            at = found.end()
    return [*out, text[at:]]


def _subject(selector: str) -> tuple[str, set[str], frozenset[str]] | None:
    """(tag, ids, classes) that the elements of any selector have at least; None if it selects no element."""
    if _PSEUDO_ELEMENT.search(selector):
        return None
    while selector != (shorter := _BRACKETS.sub("", selector)):
        selector = shorter
    parts = [x for x in re.split(r"(?<!\\)[\s>+~&]+", selector) if x]
    found = _LOOSE.fullmatch(parts[-1]) if parts and not selector.rstrip().endswith("&") else None
    if not found or _HEX_ESCAPE.search(parts[-1]):
        return "*", set(), frozenset()
    names = [_ESCAPED.sub(r"\1", x) for x in re.findall(r"[.#](?:[\w-]|\\.|[^\x00-\x7f])+", found["rest"])]
    return (found["tag"] or "*").lower(), {x[1:] for x in names if x[0] == "#"}, frozenset(x[1:] for x in names if x[0] == ".")


def _rules(css: str, rules: list[tuple], lifts: list[tuple], sure: bool) -> None:
    """Adds a sheet's rules on display and visibility.

    ``rules``: (rank, tag, ids, classes, property, value) of those that are understood. ``lifts``: (tag, ids, classes, property) of those that may
    show an element. ``sure``: whether the sheet surely applies.
    """
    css = _CSS_COMMENT.sub("", css)
    groups: list[tuple] = [("group", sure)]  # open blocks: a group of rules, a rule (selector, sure, declarations), or one to skip
    at = 0

    def end(block: tuple) -> None:
        if block[0] != "rule":
            return
        _, known, selectors, body = block
        for says in _SAYS.finditer(";".join(body)):
            what, value = says[1].lower(), says[2].lower()
            shows = value not in ("none", "hidden", "collapse")
            for one in _outside(selectors, ","):
                found = _COMPOUND.fullmatch(one.strip()) if known else None
                if found and found.group():
                    parts = re.findall(r"[.#][^.#]+", found["rest"])
                    ids, classes = {x[1:] for x in parts if x[0] == "#"}, frozenset(x[1:] for x in parts if x[0] == ".")
                    tag = (found["tag"] or "*").lower()
                    rules.append(((bool(says[3]), False, len(ids), len(classes), tag != "*", len(rules)), tag, ids, classes, what, value))
                elif shows and (subject := _subject(one)):
                    lifts.append((*subject, what))

    for sign in _CSS_SIGN.finditer(css):
        if sign.group() not in "{};":
            continue
        text, at = css[at : sign.start()].strip(), sign.end()
        kind = groups[-1][0]
        if kind == "rule" and sign.group() != "{":
            groups[-1][3].append(text)
        if sign.group() == "{":
            known = groups[-1][1]
            if kind == "skip":
                groups.append(("skip", False))
            elif text.startswith("@"):
                name, _, rest = text[1:].partition(" ")
                name = name.partition("(")[0].lower()
                if name == "media":
                    applies = _medium(rest)
                    groups.append(("skip", False) if applies is False else ("group", known and applies is True and kind == "group"))
                else:
                    groups.append(("group", False) if name in GROUPS else ("skip", False))
            else:
                groups.append(("rule", known and kind == "group", text, []))
        elif sign.group() == "}" and len(groups) > 1:
            end(groups.pop())
    if groups[-1][0] == "rule":  # the page ends in a rule
        groups[-1][3].append(css[at:].strip())
    while groups:
        end(groups.pop())


def _by_key(rules: list[tuple], tag: int) -> dict[str, list[tuple]]:
    """Rules by an id, else a class, else the tag that their elements have; ``tag``: place of (tag, ids, classes) in a rule."""
    out: dict[str, list[tuple]] = {}
    for rule in rules:
        own, ids, classes = rule[tag : tag + 3]
        out.setdefault(next((f"#{i}" for i in sorted(ids)), None) or next((f".{c}" for c in sorted(classes)), None) or own, []).append(rule)
    return out


def _mark(root: Node) -> None:
    """Sets what each node of a tree says of its own visibility."""
    nodes, todo = [], [(root, False)]
    rules: list[tuple] = []
    lifts: list[tuple] = []
    while todo:
        node, inert = todo.pop()
        nodes.append(node)
        inert = inert or node.tag in ("noscript", "template")
        if node.tag == "style" and not inert and node.attrs.get("type", "").strip().lower() in ("", "text/css"):
            applies = _medium(node.attrs.get("media", ""))
            if applies is not False:
                _rules("".join(x for x in node.kids if isinstance(x, str)), rules, lifts, applies is True)
        todo += [(x, inert) for x in reversed(node.kids) if isinstance(x, Node)]
    by_key, lifting = _by_key(rules, 1), _by_key(lifts, 0)
    for node in nodes:
        attrs, said = node.attrs, {}
        node.gone = node.tag in HIDDEN or "hidden" in attrs or node.tag == "dialog" and "open" not in attrs
        if by_key:
            classes, own_id = set(attrs.get("class", "").split()), attrs.get("id")
            keys = (node.tag, "*", f"#{own_id}", *(f".{c}" for c in classes))
            for key in keys:
                for rank, tag, ids, needs, what, value in by_key.get(key, ()):
                    if tag in ("*", node.tag) and ids <= {own_id} and needs <= classes and rank > said.get(what, ((),))[0]:
                        said[what] = (rank, value)
            if lifting:
                for what in [k for k, (_, value) in said.items() if value in ("none", "hidden", "collapse")]:
                    if any(prop == what and tag in ("*", node.tag) and ids <= {own_id} and needs <= classes for key in keys for tag, ids, needs, prop in lifting.get(key, ())):
                        del said[what]
        if "style" in attrs:
            for k, says in enumerate(_SAYS.finditer(attrs["style"])):
                rank, what = (bool(says[3]), True, k), says[1].lower()
                if rank > said.get(what, ((),))[0]:
                    said[what] = (rank, says[2].lower())
        if "display" in said and node.tag not in HIDDEN:
            node.gone = said["display"][1] == "none"
        if "visibility" in said:
            node.seen = {"visible": True, "hidden": False, "collapse": False}.get(said["visibility"][1])


def _imply(stack: _Open, name: str) -> None:
    """Ends the open elements that a start tag ends."""
    if name in CLOSES_P and stack.count.get("p"):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                stack.cut(i)
                break
            if stack[i].tag in ("td", "th", "table", "button", "caption", "object"):
                break
    if name in ENDS:
        own, barrier = ENDS[name]
        if any(stack.count.get(x) for x in own):
            cut = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in barrier:
                    break
                if stack[i].tag in own:
                    cut = i
            if cut:
                stack.cut(cut)
    if stack[-1].tag == "head" and (name == "body" or name not in HIDDEN and name not in ("html", "head")):
        stack.cut(len(stack) - 1)


def _close(stack: _Open, name: str) -> None:
    if name == "br":
        stack[-1].kids.append(Node("br", _NO_ATTRS))
        return
    if stack.count.get(name):
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag == name:
                stack.cut(i)
                return
            if tag in TABLE_PARTS and name not in TABLE_PARTS:
                break
    if name == "p":
        stack[-1].kids.append(Node("p", _NO_ATTRS))


class Flow:
    """Lines of a block and the line that is being filled."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = True  # whether a following space would be dropped
        self.gap = False  # whether a blank line is due before the next text
        self.seen = True  # whether text is visible

    def text(self, text: str) -> None:
        if not self.seen:
            return
        text = _SPACE.sub(" ", text)
        if self.space and text[:1] == " ":
            text = text[1:]
        if text:
            self._room()
            self.line.append(text)
            self.space = text[-1] == " "

    def exact(self, text: str) -> None:
        if not self.seen:
            return
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, part in enumerate((first, *rest)):
            if k:
                self.newline()
            if part:
                self._room()
                self.line.append(part)
                self.space = False

    def _room(self) -> None:
        if self.gap and not self.line:
            if self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False

    def newline(self) -> None:
        self._room()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], True

    def end_line(self) -> None:
        if self.line:
            self.newline()
        self.space = True

    def margin(self) -> None:
        self.end_line()
        self.gap = True

    def add(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            self._room()
            self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        start = next((i for i, x in enumerate(self.lines) if x), 0)
        return self.lines[start:]


def _inside(node: Node, pre: bool, seen: bool = True) -> list[str]:
    flow = Flow()
    flow.seen = seen if node.seen is None else node.seen
    _kids(node, flow, pre)
    return flow.done()


def _kids(node: Node, flow: Flow, pre: bool) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            (flow.exact if pre else flow.text)(kid)
        else:
            _render(kid, flow, pre)


def _render(node: Node, flow: Flow, pre: bool) -> None:
    if node.gone:
        return
    if node.seen is None or node.seen == flow.seen:
        _shown(node, flow, pre)
    else:
        was, flow.seen = flow.seen, node.seen
        _shown(node, flow, pre)
        flow.seen = was


def _shown(node: Node, flow: Flow, pre: bool) -> None:
    tag, attrs = node.tag, node.attrs
    if tag == "br":
        flow.newline()
    elif tag in VOID:
        if tag == "hr":
            flow.margin()
        elif tag == "input" and attrs.get("type", "").strip().lower() not in NO_VALUE:
            flow.text(attrs.get("value") or attrs.get("placeholder") or "")
    elif tag == "textarea":
        flow.exact("".join(x for x in node.kids if isinstance(x, str)).removeprefix("\n") or attrs.get("placeholder", ""))
    elif tag == "select":
        _choices(node, flow)
    elif tag == "svg":
        _drawn(node, flow)
    elif tag == "details" and "open" not in attrs:
        flow.end_line()
        summary = next((x for x in node.kids if isinstance(x, Node) and x.tag == "summary"), None)
        if summary:
            _render(summary, flow, pre)
        flow.end_line()
    elif tag not in BLOCK:
        _kids(node, flow, pre)
    else:
        spaced = tag in SPACED
        flow.margin() if spaced else flow.end_line()
        if tag == "table":
            flow.add(_table(node, flow.seen))
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.add(_list(node, flow.seen))
        elif tag == "blockquote" or tag == "dd":
            flow.add(["  " + x if x else "" for x in _inside(node, pre, flow.seen)])
        elif tag in ("pre", "listing", "xmp", "plaintext"):
            flow.add(_inside(node, True, flow.seen))
        elif tag == "li":
            flow.add(_item(_inside(node, pre, flow.seen), "- " if flow.seen else ""))
        else:
            _kids(node, flow, pre)
        flow.margin() if spaced else flow.end_line()


def _choices(node: Node, flow: Flow) -> None:
    """The chosen option, or a line for each where several show."""
    options = list(_options(node))
    if "multiple" in node.attrs or _number(node.attrs.get("size"), 1) > 1:
        flow.end_line()
        for kid in options:
            flow.text(_option_text(kid))
            flow.end_line()
        return
    options = [x for x in options if x.tag == "option"]
    for kid in ([x for x in options if "selected" in x.attrs] or [x for x in options if "disabled" not in x.attrs][:1])[-1:]:
        flow.text(_option_text(kid) + " ")


def _options(node: Node) -> Iterator[Node]:
    for kid in node.kids:
        if isinstance(kid, Node) and not kid.gone:
            if kid.tag in ("option", "optgroup"):
                yield kid
            if kid.tag != "option":
                yield from _options(kid)


def _option_text(node: Node) -> str:
    return node.attrs.get("label") or (" ".join(_inside(node, False)) if node.tag == "option" else "")


def _drawn(node: Node, flow: Flow) -> None:
    """Text elements of a drawing."""
    for kid in node.kids:
        if isinstance(kid, Node) and not kid.gone:
            if kid.tag in ("text", "foreignobject"):
                flow.text(" ")
                _render(kid, flow, False)
                flow.text(" ")
            else:
                _drawn(kid, flow)


def _item(lines: list[str], marker: str) -> list[str]:
    pad = " " * len(marker)
    return [(pad if k else marker) + x if x else "" for k, x in enumerate(lines or [""])] if lines else [marker.rstrip()]


def _number(text: str | None, otherwise: int) -> int:
    found = _NUMBER.match(text) if text else None
    return int(found[1]) if found else otherwise


def _list(node: Node, seen: bool) -> list[str]:
    numbered = node.tag == "ol"
    step = -1 if "reversed" in node.attrs else 1
    count = _number(node.attrs.get("start"), 1 if step > 0 else sum(isinstance(x, Node) and x.tag == "li" and not x.gone for x in node.kids))
    out, loose = [], Flow()
    loose.seen = seen

    def settle() -> None:
        nonlocal loose
        out.extend(loose.done())
        loose = Flow()
        loose.seen = seen

    for kid in node.kids:
        if isinstance(kid, str):
            loose.text(kid)
        elif kid.tag == "li":
            settle()
            if not kid.gone:
                count = _number(kid.attrs.get("value"), count)
                own = seen if kid.seen is None else kid.seen
                out += _item(_inside(kid, False, own), (f"{count}. " if numbered else "- ") if own else "")
                count += step
        elif kid.tag in ("ul", "ol", "menu", "dir"):
            settle()
            if not kid.gone:
                out += ["  " + x if x else "" for x in _list(kid, seen if kid.seen is None else kid.seen)]
        else:
            _render(kid, loose, False)
    return out + loose.done()


def _table_rows(node: Node, out: list[tuple[Node, bool]], captions: list[list[str]], seen: bool) -> None:
    """Rows in order of display: heads, bodies, feet; captions and stray content apart."""
    loose = Flow()
    loose.seen = seen
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    for kid in node.kids:
        if isinstance(kid, str):
            loose.text(kid)
            continue
        if kid.gone:
            continue
        own = seen if kid.seen is None else kid.seen
        if kid.tag in parts:
            _table_rows(kid, parts[kid.tag], captions, own)
        elif kid.tag == "tr":
            parts["tbody"].append((kid, own))
        elif kid.tag in ("td", "th"):  # a cell without its row
            row = Node("tr", _NO_ATTRS)
            row.kids.append(kid)
            parts["tbody"].append((row, seen))
        elif kid.tag == "caption":
            captions.append(_inside(kid, False, seen))
        elif kid.tag not in ("colgroup", "col"):
            _render(kid, loose, False)
    captions.append(loose.done())
    out += parts["thead"] + parts["tbody"] + parts["tfoot"]


def _cells(rows: list[tuple[Node, bool]], captions: list[list[str]]) -> list[list[tuple[int, int, list[str]]]]:
    """Of each row, its cells as (first column, end column, lines); columns that a cell above reaches into are left free."""
    grid, above = [], []  # above: (first column, end column, end row) of cells that go on below their row
    for r, (row, seen) in enumerate(rows):
        above = [x for x in above if x[2] > r]
        taken, cells, new, c = iter(above), [], [], 0
        ahead = next(taken, None)
        loose = Flow()
        loose.seen = seen
        for kid in row.kids:
            if isinstance(kid, str):
                loose.text(kid)
            elif kid.tag not in ("td", "th"):
                _render(kid, loose, False)
            elif not kid.gone:
                while ahead and ahead[0] <= c:
                    c, ahead = max(c, ahead[1]), next(taken, None)
                wide = min(max(1, _number(kid.attrs.get("colspan"), 1)), MOST_COLUMNS)
                tall = _number(kid.attrs.get("rowspan"), 1)
                end = len(rows) if tall == 0 else r + max(1, tall)
                if end > r + 1:
                    new.append((c, c + wide, min(end, len(rows))))
                cells.append((c, c + wide, _inside(kid, False, seen)))
                c += wide
        merged: list[tuple[int, int, int]] = []
        for x in sorted(above + new) if new else above:
            if merged and merged[-1][1] >= x[0] and merged[-1][2] == x[2]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], x[1]), x[2])
            else:
                merged.append(x)
        above = merged
        captions.append(loose.done())
        grid.append(cells)
    return grid


def _columns(text: str) -> int:
    """Columns that a line takes: two for a wide East Asian character."""
    return len(text) if text.isascii() else len(text) + sum(east_asian_width(c) in "WF" for c in text)


def _table(node: Node, seen: bool = True) -> list[str]:
    rows: list[tuple[Node, bool]] = []
    captions: list[list[str]] = []
    _table_rows(node, rows, captions, seen)
    grid = _cells(rows, captions)
    columns = sorted({c for cells in grid for c, _, _ in cells})  # only columns that some cell starts in take room
    place = [[(bisect_left(columns, a), bisect_left(columns, b), lines) for a, b, lines in cells] for cells in grid]
    widths = [0] * len(columns)
    for cells in place:
        for a, b, lines in cells:
            if b == a + 1:
                widths[a] = max([widths[a], *map(_columns, lines)])
    for cells in place:
        for a, b, lines in cells:
            if b > a + 1:
                widths[b - 1] += max(0, max([0, *map(_columns, lines)]) - sum(widths[a:b]) - 3 * (b - a - 1))
    out = [x for lines in captions for x in lines]
    for cells in place:
        for y in range(max([0, *(len(lines) for _, _, lines in cells)])):
            line, at = [], 0
            for a, b, lines in cells:
                line += [" " * widths[k] for k in range(at, a)]
                text = lines[y] if y < len(lines) else ""
                line.append(text + " " * (sum(widths[a:b]) + 3 * (b - a - 1) - _columns(text)))
                at = b
            out.append(" | ".join(line).rstrip())
    return out


def visible_text(page: str | None) -> str:
    """The page as laid-out plain text."""
    if not page:
        return ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))  # a few calls for each level of a page
    return "\n".join(_inside(parse(page), False))


def extract_text(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per input row: page_id, text."""
    bounded(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pages = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_arrays([ids[a : a + 256], pa.array([visible_text(x) for x in pages[a : a + 256].to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).cast("string").alias("html")).mapInArrow(lean(run), "page_id long, text string")
