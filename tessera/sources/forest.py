"""Pages as forests: the document, its open shadow roots in place, and readable frames as roots of their own.

One parse a page gives a row a node: controls with everything that classifying and auditing them reads, blind spots (frames
that cannot be read, closed custom elements, canvases), and one row for the page. Parsing and the walk over a page's own
tree run in Arrow batches, as no operator of Spark parses markup; everything after that is columns.

What a browser would compute is taken from the markup: hiding from ``hidden``, inline style and plain class, id or tag rules of the
page's own style elements; blocks from the element's kind; open and closed shadow roots from ``template shadowrootmode``; a frame
is readable if it has ``srcdoc`` or no source. Nothing is drawn, so positions count only where the style states them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import parser as markup
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.html import GENERATED, HEADINGS, NO_CONTROL, ROLES, SKIPPED, VOID

# Limits of the page walk, separators of selectors, attributes of frameworks that name a control.
MOST_CONTROLS, MOST_OPTIONS, FRAME_DEPTH, CANVAS_AREA = 500, 24, 8, 10_000
SHADOW, FRAME = " >>> ", " >> "
FRAMEWORK = ("formcontrolname", "ng-reflect-name", "ng-model", "v-model", "x-model", "wire:model")
# Elements that are blocks by themselves, and start tags that end an open element without its end tag.
BLOCKS = frozenset("address article aside blockquote body button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html input legend li main menu nav ol p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
BLOCK_DISPLAYS = frozenset("block flex grid list-item table-cell flow-root inline-block".split())
ENDS = {"li": ("li",), "option": ("option",), "optgroup": ("option", "optgroup"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "tbody", "thead"), "tfoot": ("td", "th", "tr", "tbody", "thead")}
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("table ul ol dl select template body html fieldset form div section".split())

_TEXTS = ("label_for", "label_ancestor", "aria_label", "aria_labelledby_text", "aria_describedby_text", "title", "placeholder", "preceding_text", "legend", "section_heading", "form_accessible_name")
_FLAGS = ("required", "readonly", "disabled", "multiple")
NODES = pa.schema(
    [("page_id", pa.string()), ("kind", pa.string()), ("document_index", pa.int32()), ("frame_path", pa.list_(pa.string())), ("shadow_path", pa.list_(pa.string()))]
    + [(c, pa.string()) for c in ("selector", "undetectable_reason", "tag", "input_type", "inputmode", "pattern", "name", "element_id", "autocomplete_raw", "form_key", "fieldset_key", "parent_key", *_TEXTS)]
    + [(c, pa.list_(pa.string())) for c in ("css_classes", "data_keys", "framework_values", "option_labels", "option_values")]
    + [(c, pa.int32()) for c in ("maxlength", "option_count", "form_index", "fieldset_index", "sibling_controls", "controls_seen", "roots")]
    + [(c, pa.bool_()) for c in (*_FLAGS, "style_hidden", "zero_size", "offscreen", "truncated")]
    + [("unreadable_frames", pa.list_(pa.string()))]
)


class Element:
    __slots__ = ("tag", "at", "parent", "nodes", "shadow", "closed", "host", "place", "nth", "controls")

    def __init__(self, tag: str, at: dict[str, str], parent: Element | None):
        self.tag, self.at, self.parent, self.nodes = tag, at, parent, []
        self.shadow: Element | None = None
        self.closed, self.host = False, None
        self.place = self.nth = -1  # among its siblings, and among those of its tag; known once the tree is whole
        self.controls = -1  # how many of its children are controls

    def children(self) -> Iterator[Element]:
        return (n for n in self.nodes if n.__class__ is Element)

    def number(self) -> None:
        """Tell the children their places."""
        seen: dict[str, int] = {}
        for k, n in enumerate(self.nodes):
            if n.__class__ is Element:
                n.place, n.nth = k, seen.get(n.tag, 0) + 1
                seen[n.tag] = n.nth

    def above(self, across: bool = True) -> Iterator[Element]:
        """The ancestors, from a shadow root on to its host."""
        e = self.parent
        while e is not None:
            if e.tag == "#root":
                e = e.host if across else None
            else:
                yield e
                e = e.parent

    def all(self) -> Iterator[Element]:
        """All elements below, in order, of this root only."""
        todo = [n for n in reversed(self.nodes) if n.__class__ is Element]
        while todo:
            e = todo.pop()
            yield e
            if e.nodes:
                todo += [n for n in reversed(e.nodes) if n.__class__ is Element]

    def text(self, without: frozenset = frozenset(("script", "style"))) -> str:
        out, todo = [], self.nodes[::-1]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in without:
                todo += n.nodes[::-1]
        return collapsed("".join(out))


def collapsed(text: str) -> str:
    return " ".join(text.split())


class _Parser(HTMLParser):
    """A document's tree with the elements that HTML implies: html, head, body, tbody, and the ends of paragraphs, rows and items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.open = [self.root]
        self.body = self.html = None

    def push(self, tag: str, at: dict[str, str]) -> Element:
        e = Element(tag, at, self.open[-1])
        self.open[-1].nodes.append(e)
        if tag not in VOID:
            self.open.append(e)
        return e

    def ensure_body(self) -> None:
        if self.html is None:
            self.html = self.push("html", {})
        if self.body is None:
            del self.open[2:]
            self.body = self.push("body", {})

    def close_open(self, tags, within: frozenset = SCOPES) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return self.close_open(tags, within)
            if self.open[k].tag in within:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body"):
            if tag == "body":
                self.html = self.html or self.push("html", {})
            known = getattr(self, tag)
            if known is None:
                del self.open[1 if tag == "html" else 2 :]
                setattr(self, tag, self.push(tag, at))
            else:
                known.at.update({k: v for k, v in at.items() if k not in known.at})
            return
        if tag == "head" or self.body is None and tag in ("title", "meta", "link", "base", "style", "script"):
            self.html = self.html or self.push("html", {})
        else:
            in_head = any(e.tag in ("head", "template") for e in self.open) and tag in SKIPPED | {"title", "meta", "link", "base"}
            if not in_head:
                self.ensure_body()
        if tag in ENDS_PARAGRAPH:
            self.close_open(("p",))
        if tag in ENDS:
            self.close_open(ENDS[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self.push("tbody", {})
        self.push(tag, at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends no element of HTML

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("template", "body"):
                return

    def handle_data(self, data):
        if self.body is None and not data.strip():
            return
        if self.open[-1].tag in ("#root", "html", "head"):
            self.ensure_body()
        self.open[-1].nodes.append(data)


_TAG = re.compile(r"""<(?:([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:="[^"]*")?)*)[ \t\n\r\f]*>|/([a-zA-Z][a-zA-Z0-9-]*)>|![dD][oO][cC][tT][yY][pP][eE] [a-zA-Z]+>)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:="([^"]*)")?""")
#: Elements whose content is read in another way; without signs of markup in it, the way does not matter.
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp plaintext svg math".split())
_value = getattr(markup, "_unescape_attrvalue", unescape)


def _plain(html: str, parser: _Parser) -> bool:
    """Read markup that is written plainly: tags with quoted attributes, texts, a doctype. False at the first thing that is not."""
    at, end = 0, len(html)
    while at < end:
        tag = _TAG.match(html, at)
        if tag is None:
            if html[at] == "<":
                return False
            to = html.find("<", at)
            to = end if to < 0 else to
            text = html[at:to]
            parser.handle_data(unescape(text) if "&" in text else text)
            at = to
            continue
        at = tag.end()
        name, attributes, closed = tag.groups()
        if name is not None:
            name = name.lower()
            if name in _RAW:
                to = html.find("<", at)
                if to < 0 or "&" in html[at:to] or not html.startswith("/", to + 1) or html[to + 2 : to + 3 + len(name)].lower() != f"{name}>":
                    return False
            parser.handle_starttag(name, [(k.lower(), _value(v) if "&" in v else v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else [])
        elif closed is not None:
            parser.handle_endtag(closed.lower())
    return True


def tree(html: str) -> Element:
    """The document root; templates with a shadow root mode become their host's shadow root."""
    parser = _Parser()
    if not _plain(html, parser):
        parser = _Parser()
        parser.feed(html)
        parser.close()
    if "shadowrootmode" not in html.lower():
        return parser.root
    for e in [*parser.root.all()]:
        mode = e.at.get("shadowrootmode", "").lower() if e.tag == "template" else ""
        host = e.parent
        if mode in ("open", "closed") and host.shadow is None and not host.closed:
            host.nodes.remove(e)
            host.closed = mode == "closed"
            if mode == "open":
                e.tag, e.host, e.parent, host.shadow = "#root", host, None, e
    return parser.root


def is_control(e: Element) -> bool:
    editable, role = e.at.get("contenteditable"), e.at.get("role", "").lower()
    if e.tag == "input":
        return e.at.get("type", "text").lower() not in NO_CONTROL
    return e.tag in ("select", "textarea") or editable is not None and editable.lower() != "false" or role in ROLES


class Root:
    """What is known of one root: ids, labels, names in forms."""

    def __init__(self, top: Element):
        self.top, self.ids, self.labels, self.by_id = top, Counter(), {}, {}
        for e in top.all():
            if e.at.get("id"):
                self.ids[e.at["id"]] += 1
                self.by_id.setdefault(e.at["id"], e)
            if e.tag == "label" and "for" in e.at:
                self.labels.setdefault(e.at["for"], e)

    def known(self, e: Element) -> str | None:
        own = e.at.get("id")
        return own if own and self.ids[own] == 1 and not GENERATED.search(own) else None

    def selector(self, e: Element, anchor: str, unique_name: bool = False) -> str:
        """Its own id, else its name in a named form, else the path from the nearest known id, named form or the anchor."""
        if self.known(e):
            return f"#{e.at['id']}"
        named = next((a for a in e.above(across=False) if a.tag == "form" and a.at.get("name")), None)
        if named is not None and unique_name and e.at.get("name"):
            return f'form[name="{named.at["name"]}"] [name="{e.at["name"]}"]'
        steps, form_steps, at = [], None, e
        while at.tag not in ("#root", "html"):
            if at is not e and self.known(at):
                return " > ".join([f"#{at.at['id']}", *reversed(steps)])
            if at is named:
                form_steps = len(steps)
            steps.append(f"{at.tag}:nth-of-type({nth(at)})")
            at = at.parent
        if form_steps is not None:
            return " > ".join([f'form[name="{named.at["name"]}"]', *reversed(steps[:form_steps])])
        return " > ".join([anchor, *reversed(steps)] if anchor else reversed(steps))

    def listed(self, e: Element, attribute: str) -> str | None:
        """The texts of the elements that an attribute lists; empty if none has a text, None without the attribute."""
        if attribute not in e.at:
            return None
        return " ".join(filter(None, (self.by_id[i].text() for i in e.at[attribute].split() if i in self.by_id)))


def nth(e: Element) -> int:
    if e.nth < 0:
        e.parent.number()
    return e.nth


def _before(e: Element) -> Iterator[Element | str]:
    """The preceding siblings, nearest first."""
    if e.place < 0:
        e.parent.number()
    nodes = e.parent.nodes
    return (nodes[k] for k in range(e.place - 1, -1, -1))


class Styles:
    """Hiding that the markup states: plain rules of style elements, inline style, the hidden attribute."""

    _RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
    _PLAIN = re.compile(r"[.#]?[\w-]+")

    def __init__(self, top: Element):
        self.rules: dict[str, dict[str, str]] = {}
        self.known: dict[int, tuple[bool, bool, str]] = {}  # by identity; the walk holds the trees
        for e in top.all():
            if e.tag == "style":
                for selectors, body in self._RULE.findall(re.sub(r"/\*.*?\*/", "", e.text(frozenset()), flags=re.DOTALL)):
                    for s in map(str.strip, selectors.split(",")):
                        if self._PLAIN.fullmatch(s):
                            self.rules.setdefault(s, {}).update(_declarations(body))

    def of(self, e: Element) -> dict[str, str]:
        if not self.rules:
            return _declarations(e.at["style"]) if "style" in e.at else {}
        own = dict(self.rules.get(e.tag, {}))
        for c in e.at.get("class", "").split():
            own |= self.rules.get(f".{c}", {})
        return own | self.rules.get(f"#{e.at.get('id')}", {}) | _declarations(e.at.get("style", ""))

    def block(self, e: Element) -> bool:
        display = self.of(e).get("display")
        return display in BLOCK_DISPLAYS if display else e.tag in BLOCKS

    def hiding(self, e: Element) -> tuple[bool, bool, bool]:
        """style_hidden, zero_size, offscreen."""
        own, (gone, off, visibility) = self.of(e), self.handed(e)
        faint = (n := _number(own.get("opacity"))) is not None and n < 0.05
        zero = gone or any(_number(own.get(side)) == 0 and _number(own.get("border", "1")) in (0, None) for side in ("width", "height"))
        return own.get("display") == "none" or "hidden" in e.at or visibility in ("hidden", "collapse") or faint, zero, off

    def handed(self, e: Element) -> tuple[bool, bool, str]:
        """Gone, offscreen, visibility: what an element has or gets from above."""
        todo, held = [], (False, False, "visible")
        for at in (e, *e.above()):
            if id(at) in self.known:
                held = self.known[id(at)]
                break
            todo.append(at)
        for at in reversed(todo):
            gone, off, visibility = held
            style = self.of(at)
            gone |= "hidden" in at.at or style.get("display") == "none"
            if style.get("position") in ("absolute", "fixed"):
                off |= any((n := _number(style.get(side))) is not None and n <= -500 for side in ("left", "top"))
            held = self.known[id(at)] = (gone, off, style.get("visibility") or visibility)
        return held


def _declarations(body: str) -> dict[str, str]:
    return {k.strip().lower(): v.replace("!important", "").strip().lower() for k, _, v in (d.partition(":") for d in body.split(";")) if v.strip()}


def _number(text: str | None) -> float | None:
    m = re.match(r"\s*(-?\d*\.?\d+)", text or "")
    return float(m[1]) if m else None


def preceding_text(e: Element, styles: Styles) -> str | None:
    """The nearest text before a control within its block, rising at most eight times; in a shadow root without one, before the host."""
    block = next((a for a in e.above(across=False) if styles.block(a)), None)
    at, rises = e, 0
    while at is not None and at is not block and rises < 8 and at.tag != "#root":
        for n in _before(at):
            text = collapsed(n) if isinstance(n, str) else n.text() if n.tag not in SKIPPED and n.tag != "label" else ""
            if text:
                return text
        at, rises = at.parent, rises + 1
    top = [*e.above(across=False)][-1:] or [e]
    host = top[0].parent.host if top[0].parent is not None else None
    return preceding_text(host, styles) if host is not None else None


def section_heading(e: Element) -> str | None:
    """The last heading before the branch that leads to a control, in the nearest ancestor that has one."""
    child = e
    for a in e.above():
        found = None
        for s in a.children():
            if s is child:
                break
            if s.tag in HEADINGS:
                found = s
        if found is not None:
            return found.text()
        if a.tag == "body":
            return None
        child = a
    return None


def siblings(e: Element) -> int:
    """How many other controls a control's parent holds."""
    if e.parent.controls < 0:
        e.parent.controls = sum(map(is_control, e.parent.children()))
    return e.parent.controls - 1


def _whole(text: str | None) -> int | None:
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return int(m[1]) if m else None


#: Columns that the walk has without looking at a control's surroundings.
WALKED = frozenset(("page_id", "kind", "document_index", "frame_path", "shadow_path", "selector", "undetectable_reason", "tag", "controls_seen", "roots", "truncated", "unreadable_frames"))


class _Walk:
    """A page's nodes in reading order: the document first, then each readable frame after the root that holds it."""

    def __init__(self, page_id: str | None, whole: bool = True):
        self.whole = whole
        self.page_id, self.rows, self.canvases, self.index, self.controls, self.seen, self.roots = page_id, [], [], 0, 0, 0, 0
        self.truncated, self.unreadable = False, []
        self.keys: dict[int, str] = {}
        self.in_form, self.in_fieldset = Counter(), Counter()
        self.held = []  # trees, so that no two elements share an identity

    def document(self, html: str, frame_path: tuple[str, ...], depth: int) -> None:
        top = tree(html)
        self.held.append(top)
        self.roots += 1
        styles, frames, named = Styles(top), [], []
        self.walk(top, Root(top), styles, frame_path, (), frames, named)
        forms = [id(f) if (f := self.form(e, root)) is not None else None for _, e, root, _ in named]
        names = Counter((f, e.at["name"]) for f, (_, e, *_) in zip(forms, named, strict=True) if f and "name" in e.at)
        for f, (k, e, root, hosts) in zip(forms, named, strict=True):
            unique = names[f, e.at.get("name")] == 1
            self.rows[k]["selector"] = FRAME.join((*frame_path, SHADOW.join((*hosts, root.selector(e, "" if hosts else "html", unique)))))
        if depth < FRAME_DEPTH:
            for token, inner in frames:
                self.document(inner, (*frame_path, token), depth + 1)

    @staticmethod
    def form(e: Element, root: Root) -> Element | None:
        """The form that a control belongs to: the one it names, else the nearest."""
        if "form" in e.at and e.tag in ("input", "select", "textarea"):
            form = root.by_id.get(e.at["form"])
            return form if form is not None and form.tag == "form" else None
        return next((a for a in e.above() if a.tag == "form"), None)

    def key(self, e: Element | None) -> str | None:
        return None if e is None else self.keys.setdefault(id(e), f"e{len(self.keys) + 1}")

    def add(self, kind: str, e: Element, root: Root, frame_path, hosts, **more) -> None:
        selector = FRAME.join((*frame_path, SHADOW.join((*hosts, root.selector(e, "" if hosts else "html")))))
        self.rows.append({"page_id": self.page_id, "kind": kind, "document_index": self.index, "frame_path": list(frame_path), "shadow_path": list(hosts), "selector": selector, "tag": e.tag, **more})
        self.index += 1

    def walk(self, at: Element, root: Root, styles: Styles, frame_path, hosts, frames, named) -> None:
        todo = [*at.children()][::-1]
        while todo and not self.truncated:
            e = todo.pop()
            if e.tag in SKIPPED:
                continue
            if is_control(e):
                self.seen += 1
                if self.controls >= MOST_CONTROLS:
                    self.truncated = True
                    return
                self.controls += 1
                named.append((len(self.rows), e, root, hosts))
                self.rows.append({"page_id": self.page_id, "kind": "control", "document_index": self.index, "frame_path": list(frame_path), "shadow_path": list(hosts), "tag": e.tag} | (self.control(e, root, styles) if self.whole else {}))
                self.index += 1
            elif e.tag in ("iframe", "frame"):
                selector = FRAME.join((*frame_path, SHADOW.join((*hosts, root.selector(e, "" if hosts else "html")))))
                if "srcdoc" in e.at or e.at.get("src", "") in ("", "about:blank"):
                    frames.append((f"frame[{selector}]", e.at.get("srcdoc", "")))
                else:
                    self.add("frame", e, root, frame_path, hosts, undetectable_reason="cross_origin_frame")
                    self.rows[-1]["selector"] = f"frame[{selector}]"
                    self.unreadable.append(f"frame[{selector}]")
            elif e.tag == "canvas":
                if (_number(e.at.get("width", "300")) or 0) * (_number(e.at.get("height", "150")) or 0) >= CANVAS_AREA:
                    self.add("canvas", e, root, frame_path, hosts, undetectable_reason="canvas_region")
                    self.index -= 1
                    self.canvases.append(self.rows.pop())
            elif e.shadow is not None:
                host = root.selector(e, "html")
                self.walk(e.shadow, Root(e.shadow), styles, frame_path, (*hosts, host), frames, named)
                todo += [*e.children()][::-1]
            elif "-" in e.tag and self.stands_for_a_control(e):
                self.add("closed", e, root, frame_path, hosts, undetectable_reason="closed_shadow_root")
            else:
                todo += [*e.children()][::-1]

    @staticmethod
    def stands_for_a_control(e: Element) -> bool:
        tab = _whole(e.at.get("tabindex"))
        shown = any(a in e.at for a in ("name", "placeholder", "aria-label")) or tab is not None and tab >= 0
        return shown and not any(c.tag in ("input", "select", "textarea") for c in e.all())

    def control(self, e: Element, root: Root, styles: Styles) -> dict:
        nearest: dict[str, Element] = {}
        for a in e.above():
            nearest.setdefault(a.tag, a)
        at, label, fieldset = e.at, nearest.get("label"), nearest.get("fieldset")
        form = self.form(e, root)
        options = [o for o in e.all() if o.tag == "option"] if e.tag == "select" else []
        legend = next((x for x in fieldset.all() if x.tag == "legend"), None) if fieldset is not None else None
        own = at.get("id")
        found = root.labels.get(own) if own and root.by_id[own] is e else None
        clean = lambda name: collapsed(at[name]) if name in at else None
        row = {c: c in at for c in _FLAGS} | dict(zip(("style_hidden", "zero_size", "offscreen"), styles.hiding(e), strict=True))
        for name, of, count in (("form", form, self.in_form), ("fieldset", fieldset, self.in_fieldset)):
            key = row[f"{name}_key"] = self.key(of)
            row[f"{name}_index"] = None if key is None else count[key]
            count[key] += 1
        form_name = None
        if form is not None:
            form_name = collapsed(form.at["aria-label"]) if "aria-label" in form.at else root.listed(form, "aria-labelledby") or (collapsed(form.at["title"]) if "title" in form.at else None)
        return row | {
            "input_type": at.get("type", "text").lower() if e.tag == "input" else None, "inputmode": at.get("inputmode"), "pattern": at.get("pattern"), "maxlength": _whole(at.get("maxlength")),
            "name": at.get("name"), "element_id": own or None, "autocomplete_raw": at.get("autocomplete"), "parent_key": self.key(e.parent if e.parent.tag != "#root" else None) or "",
            "label_for": found.text() if found is not None else None, "label_ancestor": label.text(frozenset(("script", "style", "input", "select", "textarea"))) if label is not None else None,
            "aria_label": clean("aria-label"), "aria_labelledby_text": root.listed(e, "aria-labelledby"), "aria_describedby_text": root.listed(e, "aria-describedby"), "title": clean("title"),
            "placeholder": clean("placeholder"), "preceding_text": preceding_text(e, styles), "legend": legend.text() if legend is not None else None, "section_heading": section_heading(e),
            "form_accessible_name": form_name, "css_classes": at.get("class", "").split(), "data_keys": [k[5:] for k in at if k.startswith("data-") and len(k) > 5],
            "framework_values": [at[k] for k in FRAMEWORK if k in at], "option_labels": [o.text() for o in options[:MOST_OPTIONS]], "option_values": [o.at.get("value", o.text()) for o in options[:MOST_OPTIONS]],
            "option_count": len(options), "sibling_controls": siblings(e),
        }

    def page(self) -> list[dict]:
        """The page's nodes, its canvases behind them, and a row for the page itself."""
        for row in self.canvases:
            row["document_index"] = self.index
        own = {"page_id": self.page_id, "kind": "page", "controls_seen": self.seen, "roots": self.roots, "truncated": self.truncated, "unreadable_frames": self.unreadable}
        return [*self.rows, *self.canvases, own]


def page_nodes(page_id: str | None, html: str | None, names: frozenset[str] | None = None) -> list[dict]:
    """A page's rows. ``names``: the columns that are read; what only others need is not made."""
    walk = _Walk(page_id, names is None or not names <= WALKED)
    walk.document(html or "", (), 0)
    return walk.page()


def _batched(rows: Iterator[list[dict]], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of whole pages in batches of about as many rows."""
    held: list[dict] = []
    for own in rows:
        held += own
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None]]:
    for batch in batches:
        yield from zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True)


_KINDS = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}


def nodes(pages: DataFrame, *columns: str) -> DataFrame:
    """One row a control, blind spot, canvas and page of ``pages`` (page_id, html); the columns of NODES that are named, else all.
    A null html is an empty page."""
    kept = pa.schema([f for f in NODES if not columns or f.name in columns])
    schema = ", ".join(f"{f.name} {_KINDS[f.type]}" for f in kept)
    own = pages.select(F.col("page_id").cast("string").alias("page_id"), "html")
    found = own.mapInArrow(lambda batches: _batched((page_nodes(*p, names=frozenset(kept.names)) for p in _read(batches)), kept), schema)
    return found.withColumn("page_id", F.col("page_id").cast("long"))


ELEMENTS = pa.schema(
    [("page_id", pa.string()), ("root", pa.string()), ("ordinal", pa.int32()), ("path", pa.list_(pa.struct([("tag", pa.string()), ("id", pa.string()), ("name", pa.string()), ("nth", pa.int32())])))]
)


def page_elements(page_id: str | None, html: str | None) -> Iterator[dict]:
    """Every element of every readable root, in the order of the document, with the way to its root and its path below it."""
    todo = [(tree(html or ""), (), (), 0)]
    ordinal = 0
    while todo:
        top, frame_path, hosts, depth = todo.pop(0)
        own, paths = Root(top), {}
        key = FRAME.join((*frame_path, *([SHADOW.join(hosts)] if hosts else [])))
        for e in top.all():
            above = [] if e.parent is top else paths[id(e.parent)]
            paths[id(e)] = [*above, {"tag": e.tag, "id": e.at.get("id") or None, "name": e.at.get("name"), "nth": nth(e)}]
            yield {"page_id": page_id, "root": key, "ordinal": ordinal, "path": paths[id(e)]}
            ordinal += 1
            if e.shadow is not None:
                todo.append((e.shadow, frame_path, (*hosts, own.selector(e, "html")), depth))
            if e.tag in ("iframe", "frame") and depth < FRAME_DEPTH and "srcdoc" in e.at:
                selector = FRAME.join((*frame_path, SHADOW.join((*hosts, own.selector(e, "" if hosts else "html")))))
                todo.append((tree(e.at["srcdoc"]), (*frame_path, f"frame[{selector}]"), (), depth + 1))


def elements(pages: DataFrame) -> DataFrame:
    """page_id, root, ordinal, path: every element of ``pages`` (page_id, html) where selectors look for it."""
    found = pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInArrow(lambda batches: _batched((list(page_elements(*p)) for p in _read(batches)), ELEMENTS), "page_id string, root string, ordinal int, path array<struct<tag:string,id:string,name:string,nth:int>>")
    return found.withColumn("page_id", F.col("page_id").cast("long"))
