"""X3 helper: HTML body -> markdown for one document (called per row
inside an Arrow batch by ``webloom.operators.extract``).

Two small pieces, both stdlib only:

1. ``build_tree``: an ``html.parser`` driven tree builder implementing
   the subset of HTML5 tree construction that changes the text of real
   pages: raw-text elements, void elements, implied ``</p>``, ``</li>``,
   ``</dd>``/``</dt>`` and heading ends, and reconstruction of active
   formatting elements (an unclosed ``<b>`` reopens in later paragraphs,
   at most three identical entries are kept).
2. ``to_markdown``: a renderer following the common markdown conversion
   conventions the reference is configured with: ATX headings, fenced
   code blocks, ``-`` bullets; ``**``/``_`` emphasis; ``[text](href)``
   links; block separation by blank lines; markdown-significant
   characters escaped in text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Fixed values (HTML standard element classes).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
REMOVED = {"script", "style", "noscript", "iframe", "svg"}
HEAD_ONLY = {"head", "title", "meta", "link", "base"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "tt", "u"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset",
            "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
            "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Block elements of the markdown converter (rendered between blank lines).
BLOCK = {"address", "article", "aside", "audio", "blockquote", "body", "canvas", "center", "dd", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2",
         "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "isindex", "li", "main", "menu", "nav",
         "noframes", "noscript", "ol", "output", "p", "pre", "section", "table", "tbody", "td", "tfoot",
         "th", "thead", "tr", "ul"}
# Markdown escapes applied to text (pattern, replacement), in order.
ESCAPES = [
    (re.compile(r"\\"), r"\\\\"),
    (re.compile(r"\*"), r"\\*"),
    (re.compile(r"^-", re.M), r"\\-"),
    (re.compile(r"^\+ ", re.M), r"\\+ "),
    (re.compile(r"^(=+)", re.M), r"\\\1"),
    (re.compile(r"^(#{1,6}) ", re.M), r"\\\1 "),
    (re.compile(r"`"), r"\\`"),
    (re.compile(r"^~~~", re.M), r"\\~~~"),
    (re.compile(r"\["), r"\\["),
    (re.compile(r"\]"), r"\\]"),
    (re.compile(r"^>", re.M), r"\\>"),
    (re.compile(r"_"), r"\\_"),
    (re.compile(r"^(\d+)\. ", re.M), r"\1\\. "),
]

_WS = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs or {}), [], parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.body = None
        self.stack = [self.root]
        self.active: list[Node] = []
        self.skip = 0  # depth inside removed elements

    # -- helpers
    def _open(self, tag):
        return any(n.tag == tag for n in self.stack)

    def _pop_until(self, tag):
        while len(self.stack) > 1:
            n = self.stack.pop()
            if n.tag == tag:
                return

    def _close_p(self):
        if self._open("p"):
            self._pop_until("p")

    def _insert(self, node):
        node.parent = self.stack[-1]
        self.stack[-1].children.append(node)

    def _reconstruct(self):
        if not self.active:
            return
        i = len(self.active)
        while i > 0 and self.active[i - 1] not in self.stack:
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            clone = Node(old.tag, old.attrs)
            self._insert(clone)
            self.stack.append(clone)
            self.active[j] = clone

    # -- parser callbacks
    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag in REMOVED and tag not in ("script", "style"):
                self.skip += 1
            return
        if tag in REMOVED:
            if tag not in ("script", "style"):
                self.skip = 1
            else:
                self.skip = -1  # cdata content follows; cleared at the end tag
            return
        if tag in HEAD_ONLY or tag == "html":
            return
        if tag == "body":
            if self.body is None:
                self.body = Node("body", attrs)
                self._insert(self.body)
                self.stack.append(self.body)
            return
        if tag in CLOSES_P:
            self._close_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag == "li":
            for n in reversed(self.stack):
                if n.tag == "li":
                    self._pop_until("li")
                    break
                if n.tag in ("ul", "ol"):
                    break
        if tag in ("dd", "dt"):
            for n in reversed(self.stack):
                if n.tag in ("dd", "dt"):
                    self._pop_until(n.tag)
                    break
                if n.tag == "dl":
                    break
        if tag == "a":
            for n in reversed(self.active):
                if n.tag == "a":
                    self._end_formatting("a")
                    break
        if tag not in CLOSES_P and tag not in ("li", "dd", "dt"):
            self._reconstruct()
        node = Node(tag, attrs)
        self._insert(node)
        if tag in VOID:
            return
        self.stack.append(node)
        if tag in FORMATTING:
            same = [n for n in self.active if n.tag == tag and n.attrs == node.attrs]
            if len(same) >= 3:
                self.active.remove(same[0])
            self.active.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.skip and self.stack[-1].tag == tag:
            self.handle_endtag(tag)

    def _end_formatting(self, tag):
        entry = next((n for n in reversed(self.active) if n.tag == tag), None)
        if entry is None:
            return
        if entry in self.stack:
            while len(self.stack) > 1:
                n = self.stack.pop()
                if n is entry:
                    break
        self.active.remove(entry)

    def handle_endtag(self, tag):
        if self.skip:
            if self.skip == -1:
                if tag in ("script", "style"):
                    self.skip = 0
                return
            if tag in REMOVED and tag not in ("script", "style"):
                self.skip -= 1
            return
        if tag in REMOVED or tag in HEAD_ONLY or tag in ("html", "body"):
            return
        if tag in FORMATTING:
            self._end_formatting(tag)
            return
        if tag in HEADINGS:
            for n in reversed(self.stack):
                if n.tag in HEADINGS:
                    self._pop_until(n.tag)
                    return
            return
        if self._open(tag):
            self._pop_until(tag)

    def parse_marked_section(self, i, report=1):
        """``<![...]>`` outside of foreign content is a bogus comment."""
        return self.parse_bogus_comment(i, 0)

    def handle_data(self, data):
        if self.skip or not data:
            return
        top = self.stack[-1]
        if top is self.root and self.body is None and not data.strip():
            return
        if data.strip() or top.tag not in ("#root",):
            self._reconstruct()
        self._insert_text(data)

    def _insert_text(self, data):
        parent = self.stack[-1]
        if parent.children and isinstance(parent.children[-1], str):
            parent.children[-1] += data
        else:
            parent.children.append(data)


def build_tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.body if b.body is not None else b.root


# ------------------------------------------------------------------ render

def _escape(text: str) -> str:
    for pat, rep in ESCAPES:
        text = pat.sub(rep, text)
    return text


def _join(out: str, rep: str) -> str:
    s1 = out.rstrip("\n")
    s2 = rep.lstrip("\n")
    nls = max(len(out) - len(s1), len(rep) - len(s2))
    if nls and s1.endswith(" ") and not s1.endswith("  "):
        s1 = s1.rstrip(" ")
    if nls:
        s2 = s2.lstrip(" ")
    return s1 + "\n\n"[:nls] + s2


def _flank(content: str, left: str, right: str) -> str:
    if not content.strip():
        return ""
    lead = content[: len(content) - len(content.lstrip())]
    trail = content[len(content.rstrip()):]
    return lead + left + content.strip() + right + trail


def _text_of(node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return "".join(out)


def _render_children(root: Node, ctx: dict) -> str:
    """Children first, with a stack of (node, parent, next child, text so
    far): any depth of nesting."""
    frames = [[root, None, 0, ""]]
    while True:
        frame = frames[-1]
        node, parent, i, out = frame
        if i < len(node.children):
            child = node.children[i]
            frame[2] += 1
            if isinstance(child, str):
                frame[3] = _join(out, _escape(child))
            elif child.tag == "pre":     # rendered from its text
                frame[3] = _join(out, _render(child, node, "", ctx))
            else:
                frames.append([child, node, 0, ""])
            continue
        frames.pop()
        if not frames:
            return out
        frames[-1][3] = _join(frames[-1][3], _render(node, parent, out, ctx))


def _item_number(node: Node, parent: Node, ctx: dict) -> int:
    """Place of a list item among its parent's elements, numbered once."""
    if ctx.get("list") is not parent:
        ctx["list"] = parent
        ctx["place"] = {id(n): i for i, n in enumerate(n for n in parent.children if isinstance(n, Node))}
    return ctx["place"][id(node)]


def _render(node: Node, parent: Node, content: str, ctx: dict) -> str:
    tag = node.tag
    if tag == "pre":
        code = node.children[0] if len(node.children) == 1 and isinstance(node.children[0], Node) \
            and node.children[0].tag == "code" else None
        lang = ""
        if code is not None:
            m = re.search(r"language-(\S+)", code.attrs.get("class") or "")
            lang = m.group(1) if m else ""
        text = _text_of(node).rstrip("\n") if code is None else _text_of(code).rstrip("\n")
        return "\n\n```" + lang + "\n" + text + "\n```\n\n"
    if tag in HEADINGS:
        return "\n\n" + "#" * int(tag[1]) + " " + content.strip() + "\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag in ("strong", "b"):
        return _flank(content, "**", "**")
    if tag in ("em", "i"):
        return _flank(content, "_", "_")
    if tag == "code":
        t = _text_of(node)
        if not t:
            return ""
        fence = "`"
        while fence in t:
            fence += "`"
        pad = " " if t.startswith("`") or t.endswith("`") else ""
        return fence + pad + t + pad + fence
    if tag == "a":
        href = node.attrs.get("href")
        if href:
            title = node.attrs.get("title")
            t = f' "{title}"' if title else ""
            return _flank(content, "[", f"]({href}{t})") or f"[]({href}{t})"
        return content
    if tag == "img":
        src = node.attrs.get("src")
        if not src:
            return ""
        alt = node.attrs.get("alt") or ""
        title = node.attrs.get("title")
        return f"![{alt}]({src}" + (f' "{title}"' if title else "") + ")"
    if tag in ("ul", "ol"):
        if parent is not None and parent.tag == "li":
            return "\n" + content + "\n"
        return "\n\n" + content + "\n\n"
    if tag == "li":
        c = re.sub(r"^\n+", "", content.strip(" "))
        c = re.sub(r"\n+$", "\n", c)
        c = c.replace("\n", "\n    ")
        if parent is not None and parent.tag == "ol":
            start = parent.attrs.get("start")
            idx = _item_number(node, parent, ctx)
            try:
                num = int(start) + idx if start else idx + 1
            except ValueError:
                num = idx + 1
            prefix = f"{num}.  "
        else:
            prefix = "-   "
        siblings = parent.children if parent is not None else []
        has_next = siblings and siblings[-1] is not node
        return prefix + c + ("\n" if has_next and not c.endswith("\n") else "")
    if tag == "blockquote":
        c = content.strip("\n")
        c = re.sub(r"^", "> ", c, flags=re.M)
        return "\n\n" + c + "\n\n"
    if tag in BLOCK:
        return "\n\n" + content.strip(" ") + "\n\n"
    return content


def _collapse_whitespace(root: Node) -> None:
    """Collapse whitespace in document order like a browser: runs become one
    space, a space after a space (even across inline elements) is dropped,
    and text is trimmed at block boundaries. ``pre`` content is kept."""
    state = {"prev_space": True, "last": None}  # last = (parent, index) of the latest text

    def boundary():
        last = state["last"]
        if last is not None:
            parent, i = last
            parent.children[i] = parent.children[i].rstrip(" ")
        state["prev_space"], state["last"] = True, None

    frames = [[root, 0, False]]         # node, next child, is a block
    while frames:
        frame = frames[-1]
        node, i, block = frame
        if i == len(node.children):
            frames.pop()
            if block:
                boundary()
            continue
        frame[1] += 1
        ch = node.children[i]
        if isinstance(ch, str):
            t = _WS.sub(" ", ch)
            if state["prev_space"]:
                t = t.lstrip(" ")
            node.children[i] = t
            if t:
                state["prev_space"] = t.endswith(" ")
                state["last"] = (node, i)
        elif ch.tag == "pre":      # content kept verbatim; a block on both sides
            boundary()
        else:
            inner = ch.tag in BLOCK or ch.tag in ("br", "hr")
            if inner:
                boundary()
            frames.append([ch, 0, inner])
    boundary()


def to_markdown(html: str | None) -> str:
    """Markdown of the document body ('' when there is no body content)."""
    if not html:
        return ""
    root = build_tree(html)
    _collapse_whitespace(root)
    out = _render_children(root, {})
    out = re.sub(r"^[\t\r\n]+", "", out)
    return re.sub(r"[\t\r\n\s]+$", "", out)
