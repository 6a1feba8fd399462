"""Plain versions of the page parser and the chunker, for comparison: other code, the same rules."""

import re
from html.parser import HTMLParser

HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Events(HTMLParser):
    """Start, end and text events of pages whose elements are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("<", tag, dict(attrs)))
        if tag in EMPTY:
            self.events.append((">", tag, None))

    def handle_endtag(self, tag):
        if tag not in EMPTY:
            self.events.append((">", tag, None))

    def handle_data(self, data):
        self.events.append(("t", data, None))


def tree_of(html):
    """Nested lists [tag, attributes, children]; an end closes up to its start, a paragraph ends where a block begins."""
    blocks = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
    parser, root = _Events(), ["root", {}, []]
    parser.feed(html)
    parser.close()
    stack = [root]
    for kind, name, attrs in parser.events:
        if kind == "t":
            stack[-1][2].append(name)
        elif kind == "<":
            if name in blocks and stack[-1][0] == "p":
                stack.pop()
            for closed, until in (("li", ("ul", "ol")), ("tr", ("table",)), ("td", ("tr",)), ("th", ("tr",))):
                if name == closed or (name in ("td", "th") and closed in ("td", "th")):
                    names = [n[0] for n in stack]
                    last = max((i for i, n in enumerate(names) if n == closed), default=-1)
                    if last > max((i for i, n in enumerate(names) if n in until), default=-1):
                        del stack[last:]
            node = [name, attrs, []]
            stack[-1][2].append(node)
            stack.append(node)
        elif name in [n[0] for n in stack[1:]]:
            while stack.pop()[0] != name:
                pass
    return root


def text_of(node, inside=False):
    inside = inside or node[0] == "pre"
    edge = "\x00" if node[0] not in ("a", "b", "i", "em", "strong", "span", "code", "body", "html", "title", "root", "u", "small") else ""
    inner = "".join(((c if inside else re.sub(r"\s+", "\x00", c)) if isinstance(c, str) else "" if c[0] in ("script", "style", "title", "head", "noscript", "template") else text_of(c, inside)) for c in node[2])
    return edge + inner + edge


def shown(node):
    return re.sub("\x00+", " ", text_of(node)).strip()


def nodes_of(node):
    yield node
    for c in node[2]:
        if not isinstance(c, str):
            yield from nodes_of(c)


def rendered(node):
    if node[0] == "pre":
        code = next((n for n in nodes_of(node) if n[0] == "code"), node)
        name = (code[1].get("class") or "") if code is not node else ""
        return "```" + re.sub("^language-", "", name) + "\n" + re.sub("\x00+", " ", text_of(code, True)).strip() + "\n```"
    if node[0] == "table":
        rows = [["".join(shown(c)) for c in nodes_of(r) if c[0] in ("td", "th")] for r in nodes_of(node) if r[0] == "tr"]
        lines = ["| " + "".join(c + " | " for c in r) for r in rows]
        return "\n".join(lines[:1] + ["| " + "--- | " * len(rows[0])] + lines[1:]).strip() if rows else ""
    return shown(node)


def sections_of(html):
    """Contents of the sections of a page."""
    root = tree_of(html)
    every = list(nodes_of(root))
    body = next((n for n in every if n[0] == "body"), root)
    if not any(n[0] in ("h2", "h3") for n in every):
        return [t for t in [rendered(body)] if t]

    def from_here(siblings):
        out = []
        for n in siblings:
            if not isinstance(n, str):
                if n[0] in HEADS:
                    break
                out.append(rendered(n))
        return "\n\n".join(t for t in out if t).strip()

    out = [from_here(body[2])]
    for head in (n for n in every if n[0] in ("h2", "h3")):
        parent = next(n for n in every if any(c is head for c in n[2]))
        at = next(i for i, c in enumerate(parent[2]) if c is head)
        content = from_here(parent[2][at + 1 :])
        out.append(f"## {shown(head)}\n\n{content}" if content else "")
    return [t for t in out if t]


JAPANESE = [(0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF)]


def letters_for(tokens, text):
    seen = [c for c in text if not c.isspace()]
    share = sum(any(lo <= ord(c) <= hi for lo, hi in JAPANESE) for c in seen) / len(seen) if seen else 0
    return int(tokens * (4.0 - 2.0 * share))


def tail(text, keep):
    """The last keep characters of a closed chunk, from after the first end of a sentence or paragraph in them."""
    if keep <= 0 or len(text) <= keep:
        return ""
    last = text[-keep:]
    for mark in ("。", ". ", "\n\n"):
        before, found, after = last.partition(mark)
        if found and after:
            return after.strip()
    return last.strip()


def gathered(pieces, most, keep, glue):
    """Pieces joined by glue in chunks of at most `most`, each beginning with the last one's tail."""
    done, now = [], ""
    for piece in pieces:
        if now and len(now) + len(piece) + len(glue) > most:
            done.append(now.strip())
            rest = tail(now.strip(), keep)
            now = rest + glue if rest else ""
        now += (glue if now else "") + piece
    return done + ([now.strip()] if now.strip() else [])


def sentences(text):
    return [s for s in re.split(r"(?<=。)|(?<=\. )", text) if s]


def chunks_of(text, tokens=None, overlap=0):
    """Chunks of a text by paragraphs of a token budget; long paragraphs by sentences. None: one chunk."""
    if tokens is None:
        made = [text]
    else:
        most, keep = letters_for(tokens, text), letters_for(overlap, text)
        if len(text) <= most:
            made = [text]
        else:
            made, waiting = [], []
            for paragraph in text.split("\n\n"):
                paragraph = paragraph.strip()
                if not paragraph:
                    continue
                if len(paragraph) <= most:
                    waiting.append(paragraph)
                else:
                    made += gathered(waiting, most, keep, "\n\n") + gathered(sentences(paragraph), most, keep, "")
                    waiting = []
            made += gathered(waiting, most, keep, "\n\n")
    return [c for c in made if len(c) >= 50] or ([text] if len(text) >= 50 else [])


def plain_text_of(html):
    """Pieces of a page's text outside of scripts, styles and navigation."""
    out = []

    def collect(node):
        for c in node[2]:
            if isinstance(c, str):
                out.extend([c.strip()] if c.strip() else [])
            elif c[0] not in ("script", "style", "nav", "footer", "header"):
                collect(c)

    collect(tree_of(html))
    return " ".join(out)
