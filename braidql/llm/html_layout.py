"""HTML to text as a page lays it out.

A tokenizer, a tree builder that supplies implied tags (html, head, body, p,
li, dd, tbody, tr, td, ... open and close as browsers do), visibility rules
(elements that are never shown, ``hidden``, inline and embedded ``display`` and
``visibility``, closed ``details`` and ``dialog``), and a layout that keeps
block spacing, list markers and nesting, preformatted text, and table cells in
aligned columns.  All visible text is emitted; nothing is cut however long or
deep a page is.

Defined results: a null or empty page gives an empty text; broken mark-up is
repaired, never refused; repeated pages are rendered each.
"""

from __future__ import annotations

import html as _html
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
NEVER_SHOWN = frozenset("head script style template noscript noframes noembed iframe title meta link base datalist audio video canvas param source track area rp".split())
#: Parts of a drawing that are not drawn where they stand.
NOT_DRAWN = frozenset("defs symbol clippath mask marker pattern desc metadata".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp caption".split())
SPACED = frozenset("p ul ol dl blockquote pre h1 h2 h3 h4 h5 h6 table figure fieldset listing xmp plaintext menu dir hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption optgroup option".split())
FORMATTING = frozenset("a b big code em font i nobr s small span strike strong tt u abbr cite q sub sup kbd label mark".split())
SCOPE_ENDS = frozenset("html table td th caption template button body".split())

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*(?:>|\Z))", re.S)
_MARKS = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CSS = re.compile(r"[{};]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_FEATURE = re.compile(r"\(\s*(min-|max-)?(width|height)\s*:\s*([\d.]+)(px|em|rem)?\s*\)|\(\s*(orientation|hover|pointer|any-hover|any-pointer)\s*:\s*(\w+)\s*\)|\(\s*(color|hover)\s*\)")
#: The screen that conditional rules are read for.
SCREEN = {"width": 1280, "height": 720, "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine"}
_COMPOUND = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<names>(?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)")
_NAMES = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:(=)\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "style", "tag", "within")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent
        self.style: dict[str, str] | None = None  # once it is known
        self.within: tuple[frozenset, frozenset] | None = None  # parts of selectors that it, and that it or an element around it, matches


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
    return out


class _Closes:
    """Which places of a page a tag can be closed from, found in one pass from its end."""

    def __init__(self, page: str):
        marks = [(m.start(), m[0]) for m in _MARKS.finditer(page)]
        self.places = [at for at, _ in marks]
        self.closed = [False] * (len(marks) + 1)
        latest: dict[str, int] = {}
        for i in range(len(marks) - 1, -1, -1):
            mark = marks[i][1]
            self.closed[i] = mark == ">" or mark in latest and self.closed[latest[mark] + 1]
            latest[mark] = i

    def after(self, at: int) -> bool:
        return self.closed[bisect_left(self.places, at)]


class TreeBuilder:
    """Builds the tree of a page from its mark-up."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.open = {"html": 1}
        self.styles: list[str] = []
        self.tables = 0  # how deep tables are nested

    def _push(self, tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "table":
            self.tables = max(self.tables, self.open[tag])
        return node

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _up_to(self, tags: frozenset[str] | set[str], bounds: frozenset[str]) -> bool:
        """Close elements up to the nearest open one of ``tags``; not past one of ``bounds``."""
        if not any(self.open.get(t) for t in tags):
            return False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return True
            if self.stack[i].tag in bounds:
                return False
        return False

    def _implied_before(self, tag: str) -> None:
        """Open and close what a start tag implies."""
        if tag in CLOSES_P:
            self._up_to({"p"}, SCOPE_ENDS)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop()
        if tag == "li":
            self._up_to({"li"}, SCOPE_ENDS | {"ul", "ol", "menu", "dir"})
        elif tag in ("dd", "dt"):
            self._up_to({"dd", "dt"}, SCOPE_ENDS | {"dl"})
        elif tag == "option":
            self._up_to({"option"}, SCOPE_ENDS | {"select", "datalist", "optgroup"})
        elif tag == "optgroup":
            self._up_to({"option"}, SCOPE_ENDS | {"select"})
            self._up_to({"optgroup"}, SCOPE_ENDS | {"select"})
        elif tag in ("rt", "rp"):
            self._up_to({"rt", "rp"}, SCOPE_ENDS | {"ruby"})
        elif tag in ("td", "th"):
            self._up_to({"td", "th"}, frozenset({"table", "tr"}))
            if self.open.get("table") and not self._in_table("tr"):
                self._implied_before("tr")
                self._push("tr")
        elif tag == "tr":
            self._up_to({"tr"}, frozenset({"table"}))
            if self.open.get("table") and not self._in_table("tbody", "thead", "tfoot"):
                self._up_to({"caption", "colgroup"}, frozenset({"table"}))
                self._push("tbody")
        elif tag in ("tbody", "thead", "tfoot", "colgroup", "caption"):
            self._up_to({"tbody", "thead", "tfoot", "colgroup", "caption"}, frozenset({"table"}))
        elif tag == "body":
            self._up_to({"head"}, frozenset())

    def _in_table(self, *tags: str) -> bool:
        """Whether one of ``tags`` is open inside the innermost table."""
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag == "table":
                return False
        return False

    def _in_drawing(self) -> bool:
        """Whether the innermost element is one of SVG or MathML, where a tag may close itself."""
        if not (self.open.get("svg") or self.open.get("math")):
            return False
        return next((n.tag != "foreignobject" for n in reversed(self.stack) if n.tag in ("svg", "math", "foreignobject")), False)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if tag in ("head", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in ("head", "title", "meta", "link", "base", "script", "style", "template", "noscript"):
            self._up_to({"head"}, frozenset())
        self._implied_before(tag)
        if tag in VOID:
            self.stack[-1].children.append(Node(tag, attrs, self.stack[-1]))
        else:
            self._push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].children.append(Node("br", None, self.stack[-1]))
        elif tag == "p" and not self.open.get("p"):
            self.stack[-1].children.append(Node("p", None, self.stack[-1]))
        elif not self.open.get(tag) or tag in ("html", "body"):
            return
        elif tag in FORMATTING:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:  # blocks opened inside it stay open
                    if all(n.tag in FORMATTING for n in self.stack[i:]):
                        while len(self.stack) > i:
                            self._pop()
                    else:
                        self.open[tag] -= 1
                        self.stack.pop(i)
                    return
                if self.stack[i].tag in SCOPE_ENDS:
                    return
        elif tag in HEADINGS:
            self._up_to(HEADINGS, SCOPE_ENDS)
        elif tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self._up_to({tag}, frozenset({"table"}) - {tag})
        else:
            self._up_to({tag}, SCOPE_ENDS - {tag})

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if top.tag == "head" and data.strip():
            self._up_to({"head"}, frozenset())
            top = self.stack[-1]
        top.children.append(data)

    def feed(self, page: str) -> Node:
        at, n = 0, len(page)
        closes: _Closes | None = None  # made when a tag turns out to have no end
        while at < n:
            begin, found = at, None
            while found is None:
                begin = page.find("<", begin)
                if begin < 0:
                    break
                if closes is None or not page[begin + 1 : begin + 2].isalpha() or closes.after(begin):
                    found = _TAG.match(page, begin)
                    if found is None and closes is None:
                        closes = _Closes(page)
                begin += found is None
            if not found:
                self.text(_html.unescape(page[at:]))
                break
            if found.start() > at:
                data = page[at : found.start()]
                self.text(_html.unescape(data) if "&" in data else data)
            at = found.end()
            name = found["name"]
            if not name:
                continue
            name = name.lower()
            if found["close"]:
                self.end(name)
                continue
            attrs = _attributes(found["attrs"]) if found["attrs"] else {}
            self.start(name, attrs)
            if found["attrs"].endswith("/") and name not in VOID and self.stack[-1].tag == name and self._in_drawing() and not re.search(r"=\s*[^\s\"']+$", found["attrs"]):
                self._pop()
                continue
            if name in RAW_TEXT:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at) if name != "plaintext" else None
                data = page[at : stop.start() if stop else n]
                at = stop.end() if stop else n
                if name == "style":
                    if on_screen(attrs.get("media", "")):
                        self.styles.append(data)
                elif data:
                    self.stack[-1].children.append(_html.unescape(data) if name in ("textarea", "title") else data)
                if self.stack[-1].tag == name:
                    self._pop()
        return self.root


def _declarations(text: str) -> tuple[dict[str, str], dict[str, str]]:
    """(declarations, those marked as important)."""
    plain, important = {}, {}
    for part in text.split(";"):
        name, _, value = part.partition(":")
        value = value.strip().lower()
        if value.endswith("important") and "!" in value:
            important[name.strip().lower()] = value[: value.rindex("!")].strip()
        elif value:
            plain[name.strip().lower()] = value
    return plain, important


def _feature(text: str) -> bool | None:
    """Whether one media feature holds for the screen; None if it is not known."""
    found = _FEATURE.fullmatch(text.strip())
    if not found:
        return None
    bound, side, number, unit, name, value, plain = found.groups()
    if side:
        try:
            size = float(number) * (16 if unit in ("em", "rem") else 1)
        except ValueError:
            return None
        return SCREEN[side] >= size if bound == "min-" else SCREEN[side] <= size if bound == "max-" else SCREEN[side] == size
    return bool(plain) or SCREEN[name] == value


def on_screen(media: str) -> bool:
    """Whether a list of media queries surely holds for the screen."""
    media = media.strip().lower()
    for query in media.split(",") if media else ["all"]:
        query = query.strip()
        negated = query.startswith("not ")
        parts = re.split(r"\s+and\s+", re.sub(r"^(?:not|only)\s+", "", query))
        held = [part in ("all", "screen") if re.fullmatch(r"[\w-]+", part) else _feature(part) for part in parts]
        if negated and False in held or not negated and all(held):
            return True
    return False


def _applies(prelude: str) -> bool:
    """Whether the rules in an @-block apply; those in doubt do not, so that no text is lost."""
    name, _, condition = prelude.lower().partition(" ") if "(" not in prelude.split(" ")[0] else (*prelude.lower().partition("(")[:1], "", prelude[prelude.index("(") :])
    if name == "@media":
        return on_screen(condition)
    return name == "@layer" or name == "@supports" and re.match(r"\s*\(\s*(?:display|visibility)\s*:[^()]*\)\s*$", condition) is not None


class Part:
    """One compound of a selector and how it stands to the one before."""

    __slots__ = ("classes", "child", "id", "number", "others", "tag")

    def __init__(self, tag: str | None, id_: str | None, classes: frozenset[str], others: tuple, child: bool, number: int):
        self.tag, self.id, self.classes, self.others, self.child, self.number = tag, id_, classes, others, child, number

    def fits(self, node: Node, classes: frozenset[str]) -> bool:
        return (
            (self.tag is None or self.tag == node.tag)
            and (self.id is None or self.id == node.attrs.get("id"))
            and self.classes <= classes
            and all(name in node.attrs and (value is None or node.attrs[name] == value) for name, value in self.others)
        )


class Rules:
    """Rules of style sheets that touch visibility, as they hold for a screen.

    Selectors are chains of compounds (tag, classes, ids, attributes) joined by
    descendant and child combinators; rules with any other selector are in doubt
    and do not apply, so that no text is lost.  More specific rules win, then
    later ones; important declarations win over all others.
    """

    def __init__(self, styles: list[str]):
        self.starts: dict[str, list[tuple[Part, Part | None, int]]] = {}  # by what a node must have: (part, the one before, rule or -1)
        self.rules: list[tuple[tuple[int, int, int, int], dict[str, str], dict[str, str]]] = []
        self.parts = 0
        for selectors, text in _blocks(styles):
            plain, important = _declarations(text)
            for selector in selectors.split(","):
                self._add(selector.strip(), plain, important)

    def _add(self, selector: str, plain: dict[str, str], important: dict[str, str]) -> None:
        chain: list[tuple[Part, Part | None, str]] = []
        ids = classes = tags = 0
        child = False
        for token in re.findall(r"(?:\[[^\]]*\]|[^\s>])+|>", selector):
            if token == ">":
                if child or not chain:
                    return
                child = True
                continue
            found = _COMPOUND.fullmatch(token)
            if not found or not token:
                return
            tag = found["tag"].lower() if found["tag"] and found["tag"] != "*" else None
            id_, names, others = None, [], []
            for mark, name, attr, equal, a, b, c in _NAMES.findall(found["names"]):
                if mark == "#":
                    if id_ not in (None, name):
                        return
                    id_ = name
                elif mark:
                    names.append(name)
                else:
                    others.append((attr.lower(), a or b or c if equal else None))
            ids, classes, tags = ids + (id_ is not None), classes + len(names) + len(others), tags + (tag is not None)
            part = Part(tag, id_, frozenset(names), tuple(others), child, self.parts)
            self.parts += 1
            chain.append((part, chain[-1][0] if chain else None, f"#{id_}" if id_ else f".{names[0]}" if names else tag or "*"))
            child = False
        if not chain or child:
            return
        for i, (part, before, key) in enumerate(chain):
            self.starts.setdefault(key, []).append((part, before, len(self.rules) if i == len(chain) - 1 else -1))
        self.rules.append(((ids, classes, tags, len(self.rules)), plain, important))

    def style(self, node: Node) -> dict[str, str]:
        """Declarations that hold for an element; those of the elements around it are found first."""
        if node.style is None:
            chain = [node]
            while chain[-1].parent is not None and chain[-1].parent.style is None:
                chain.append(chain[-1].parent)
            for each in reversed(chain):
                self._find(each)
        return node.style

    def _find(self, node: Node) -> None:
        parent, around = node.parent.within if node.parent is not None else (frozenset(), frozenset())
        own, hit = set(), []
        if self.starts:
            classes = frozenset(node.attrs["class"].split()) if "class" in node.attrs else frozenset()
            keys = [node.tag, "*", *(f".{c}" for c in classes), *([f"#{node.attrs['id']}"] if "id" in node.attrs else [])]
            for key in keys:
                for part, before, rule in self.starts.get(key, ()):
                    if (before is None or before.number in (parent if part.child else around)) and part.fits(node, classes):
                        if rule < 0:
                            own.add(part.number)
                        else:
                            hit.append(self.rules[rule])
        hit.sort(key=lambda r: r[0])
        inline, urgent = _declarations(node.attrs["style"]) if "style" in node.attrs else ({}, {})
        out: dict[str, str] = {}
        for found in (*(r[1] for r in hit), inline, *(r[2] for r in hit), urgent):
            out |= found
        mine = frozenset(own)
        node.style, node.within = out, (mine, around | mine if mine - around else around)


def _blocks(styles: list[str]) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold for a screen and touch visibility."""
    for sheet in styles:
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
        frames: list[tuple[str, bool]] = [("", True)]  # (selectors of the rule, whether it applies)
        begin = 0
        for token in [*_CSS.finditer(sheet), None]:
            mark, at, end = (token[0], token.start(), token.end()) if token else ("}", len(sheet), len(sheet))
            if mark not in ("{", "}", ";"):
                continue
            text, begin = sheet[begin:at].strip(), end
            selectors, live = frames[-1]
            if mark == "{":
                if text.startswith("@"):
                    frames.append((selectors, live and _applies(" ".join(text.split()))))
                else:  # what is nested in a rule is in doubt
                    frames.append((text, live and not selectors))
                continue
            if mark == "}" and len(frames) > 1:
                frames.pop()
            if live and selectors and any(k in text.lower() for k in ("display", "visibility", "white-space")):
                yield selectors, text


def width(text: str) -> int:
    """Columns a line takes: wide characters count two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Collects lines: collapses white space, spaces blocks, indents lists."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # 1: a new line is due, 2: an empty line too
        self.blank = False
        self.indent: list[str] = []
        self.marker = ""
        self.pre = 0

    def _begin(self) -> None:
        if self.gap == 2 and self.lines:
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.indent)
        if self.marker:
            lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        self.line.append(lead)

    def text(self, data: str) -> None:
        if self.pre:
            for i, part in enumerate(data.replace("\r\n", "\n").split("\n")):
                if i:
                    self.newline()
                if part:
                    if not self.line:
                        self._begin()
                    self.line.append(part.replace("\xa0", " "))
            return
        data = _BLANKS.sub(" ", data)
        if data[:1] == " ":
            self.blank = True
            data = data[1:]
        if not data:
            return
        if not self.line:
            self._begin()
        elif self.blank:
            self.line.append(" ")
        self.blank = data[-1:] == " "
        self.line.append((data[:-1] if self.blank else data).replace("\xa0", " "))

    def newline(self) -> None:
        """A forced line break."""
        if not self.line and (self.marker or self.gap):
            self._begin()
        self._flush(True)

    def _flush(self, forced: bool = False) -> None:
        if self.line or forced:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False

    def block(self, gap: int) -> None:
        self._flush()
        self.gap = max(self.gap, gap)

    def verbatim(self, lines: list[str]) -> None:
        self._flush()
        for line in lines:
            self._begin()
            self.line.append(line)
            self._flush(True)

    def finish(self) -> list[str]:
        self._flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


#: Padding of a table grows its text by this factor at most, and by ``ROOM`` columns; beyond that its widest columns are not filled.
GROWTH, ROOM = 8, 1 << 16


def column_limit(wide: dict[int, int], lines: int, content: int) -> int:
    """The largest width that columns may be filled to."""
    most = GROWTH * content + ROOM
    low, high = 0, max(wide.values(), default=0)
    if lines * sum(wide.values()) <= most:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if lines * sum(min(w, middle) for w in wide.values()) <= most else (low, middle - 1)
    return low


class Renderer:
    def __init__(self, rules: Rules):
        self.rules = rules

    def style(self, node: Node) -> dict[str, str]:
        return self.rules.style(node)

    def hidden(self, node: Node, style: dict[str, str]) -> bool:
        if node.tag in NEVER_SHOWN or style.get("display") == "none":
            return True
        if "hidden" in node.attrs and style.get("display") is None:
            return True
        return node.tag == "dialog" and "open" not in node.attrs or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"

    def render(self, root: Node, visible: bool = True) -> list[str]:
        """Lines of a subtree.  Walks with a stack of its own; only tables in tables call it again."""
        out = Layout()
        counters: list[list[int]] = []
        todo: list[tuple] = [("open", root, visible)]
        while todo:
            what, node, shown = todo.pop()
            if what == "call":
                node()
                continue
            if isinstance(node, str):
                if shown and what != "draw":
                    out.text(node)
                continue
            style = self.style(node)
            if what in ("draw", "label"):
                style = {k: node.attrs[k].lower() for k in ("display", "visibility") if k in node.attrs} | style
                if node.tag in NOT_DRAWN:
                    continue
            if node is not root and self.hidden(node, style):
                continue
            seen = style.get("visibility", "visible" if shown else "hidden") == "visible"
            tag = node.tag
            if tag == "br":
                out.newline()
                continue
            if tag == "input":
                value = node.attrs.get("value") or node.attrs.get("placeholder", "")
                if seen and value and node.attrs.get("type", "text").lower() in ("text", "search", "email", "url", "tel", "number", "submit", "button", "reset"):
                    out.text(value)
                continue
            if tag == "table":
                out.block(2)
                out.verbatim(self.table(node, seen))
                out.block(2)
                continue
            after: list = []
            children = node.children
            if tag == "svg":
                what = "draw"
            elif what == "draw" and tag in ("text", "foreignobject"):  # each has a place of its own
                what = "label" if tag == "text" else "open"
                out.block(1)
                after.append(lambda: out.block(1))
            elif tag == "semantics":  # what follows its first element annotates it
                children = [c for c in children if isinstance(c, Node)][:1]
            elif tag == "mphantom":
                continue
            display = style.get("display", "")
            if tag in BLOCKS and display not in ("inline", "inline-block") or display in ("block", "flex", "grid", "list-item"):
                gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and counters) else 1
                out.block(gap)
                after.append(lambda gap=gap: out.block(gap))
            if tag in ("ul", "ol", "menu", "dir"):
                step = -1 if "reversed" in node.attrs else 1
                begin = _number(node.attrs.get("start"), sum(1 for c in children if isinstance(c, Node) and c.tag == "li") if step < 0 else 1)
                counters.append([begin if tag == "ol" else 0, step, tag == "ol"])
                after.append(counters.pop)
            elif tag == "li":
                counter = counters[-1] if counters else [0, 1, False]
                if counter[2]:
                    counter[0] = _number(node.attrs.get("value"), counter[0])
                marker = f"{counter[0]}. " if counter[2] else "- "
                counter[0] += counter[1]
                out.indent.append(" " * len(marker))
                if seen:
                    out.marker = marker
                after.append(lambda: (out.indent.pop(), setattr(out, "marker", "")))
            elif tag in ("blockquote", "dd"):
                out.indent.append("  ")
                after.append(out.indent.pop)
            elif tag == "q":
                if seen:
                    out.text("“")
                    after.append(lambda: out.text("”"))
            elif tag in ("td", "th"):
                after.append(lambda: out.text(" "))
            if tag in ("pre", "textarea", "listing", "xmp", "plaintext") or style.get("white-space", "").startswith("pre"):
                out.pre += 1
                after.append(lambda: setattr(out, "pre", out.pre - 1))
                if tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0][:1] == "\n":
                    children = [children[0][1:], *children[1:]]
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            for act in after:  # blocks end last: they were added first
                todo.append(("call", act, True))
            todo.extend((what, c, seen) for c in reversed(children))
        return out.finish()

    def table(self, table: Node, shown: bool) -> list[str]:
        rows: list[tuple[Node, bool]] = []
        title: list[str] = []
        head, foot = [], []
        for part in table.children:
            if not isinstance(part, Node):
                if part.strip() and shown:
                    title.append(_BLANKS.sub(" ", part).strip())
                continue
            style = self.style(part)
            if self.hidden(part, style):
                continue
            seen = style.get("visibility", "visible" if shown else "hidden") == "visible"
            if part.tag == "tr":
                rows.append((part, seen))
            elif part.tag in ("thead", "tbody", "tfoot"):
                into = {"thead": head, "tfoot": foot}.get(part.tag, rows)
                loose = Node("tr", None, part)
                for c in part.children:
                    if isinstance(c, Node) and c.tag == "tr":
                        into.append((c, seen))
                    elif isinstance(c, Node) or c.strip():
                        loose.children.append(c)
                if loose.children:
                    title += self.render(loose, seen)
            elif part.tag not in ("colgroup", "col"):
                title += self.render(part, seen)
        grid: list[dict[int, tuple[list[str], int, str]]] = []
        taken: dict[int, int] = {}  # column -> rows it is still covered for
        for row, seen in [*head, *rows, *foot]:
            style = self.style(row)
            if self.hidden(row, style):
                continue
            seen = style.get("visibility", "visible" if seen else "hidden") == "visible"
            cells, column, fresh = {}, 0, {}
            for cell in row.children:
                if isinstance(cell, str):
                    if cell.strip() and seen:
                        title.append(_BLANKS.sub(" ", cell).strip())
                    continue
                if self.hidden(cell, self.style(cell)):
                    continue
                while taken.get(column, 0) > 0:
                    column += 1
                span = max(1, min(1000, _number(cell.attrs.get("colspan"), 1)))
                deep = max(1, min(65534, _number(cell.attrs.get("rowspan"), 1)))
                align = cell.attrs.get("align", self.style(cell).get("text-align", "")).lower()
                cells[column] = (self.render(cell, seen), span, align)
                if deep > 1:
                    fresh |= dict.fromkeys(range(column, column + span), deep - 1)
                column += span
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | fresh
            grid.append(cells)
        wide: dict[int, int] = {}
        for cells in grid:
            for column, (lines, span, _) in cells.items():
                if span == 1:
                    wide[column] = max([wide.get(column, 0), *map(width, lines)])
        heights = [max((len(lines) for lines, _, _ in cells.values()), default=0) for cells in grid]
        limit = column_limit(wide, sum(heights), sum(width(x) for cells in grid for lines, _, _ in cells.values() for x in lines))
        wide = {c: min(w, limit) for c, w in wide.items()}
        out = title
        for cells in grid:
            if not any(lines for lines, _, _ in cells.values()):
                continue
            for i in range(max(len(lines) for lines, _, _ in cells.values())):
                line, column = [], 0
                for at in sorted(cells):
                    for c in range(column, at):
                        line.append(" " * wide.get(c, 0))
                    lines, span, align = cells[at]
                    own = lines[i] if i < len(lines) else ""
                    room = sum(wide.get(c, 0) for c in range(at, at + min(span, len(wide) + 1))) + 3 * (min(span, len(wide) or 1) - 1)
                    space = max(0, room - width(own))
                    line.append(" " * space + own if align == "right" else " " * (space // 2) + own + " " * (space - space // 2) if align == "center" else own + " " * space)
                    column = at + span
                out.append(" | ".join(line).rstrip())
        return out


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*[+-]?\d{1,9}", text or "")
    return int(found[0]) if found else default


def render_html(page: str | None) -> str:
    """The visible text of one page."""
    if not page:
        return ""
    builder = TreeBuilder()
    root = builder.feed(page)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + 8 * builder.tables))
    try:
        return "\n".join(Renderer(Rules(builder.styles)).render(root))
    finally:
        sys.setrecursionlimit(before)


def render(page: Column) -> Column:
    """Column of visible texts."""

    @F.arrow_udf("string")
    def laid_out(pages: pa.Array) -> pa.Array:
        return pa.array([render_html(p.as_py()) for p in pages], pa.string())

    return laid_out(page)


def words_of(lines: Iterator[str]) -> list[str]:
    return [w for line in lines for w in line.split()]
