"""HTML: a tolerant reader on html.parser with implied end tags, and a printer.

Whitespace-only text between tags goes, other text stays as it is; block tags become blocks under the path of their open
block ancestors; inline tags become marks; unknown tags are transparent containers whose text stays."""

from __future__ import annotations

import html
import json
from html.parser import HTMLParser

from .tree import attrs_of, plain

#: HTML's void, inline and transparent elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em i img ins kbd mark q s samp small span strong sub sup time u var wbr label font".split())
TRANSPARENT = frozenset("html head body".split())
#: Start tags that end an open element of the named kinds.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), **{t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}}
SCOPE = frozenset("ul ol dl table td th blockquote div section article".split())
MARKERLESS = "￼"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.size = 0
        self.rows: list[dict] = []
        self.open: list[tuple[str, dict, int, int]] = []  # tag, attributes, start, place among rows

    def put(self, s: str) -> tuple[int, int]:
        start = self.size
        self.size += len(s.encode())
        self.text.append(s)
        return start, self.size

    def add(self, s: int, e: int, name: str, fields: dict, at: int | None = None) -> None:
        row = {"byte_start": s, "byte_end": e, "name": name, "data": {"name": name} | fields}
        self.rows.insert(len(self.rows) if at is None else at, row)

    def parents(self) -> list[str]:
        return [t for t, *_ in self.open if t not in INLINE and t not in TRANSPARENT]

    def attributes(self, pairs: list[tuple[str, str | None]]) -> dict:
        return {k: (v or "").split() if k == "class" else v or "" for k, v in pairs}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for t in CLOSES.get(tag, ()):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == t:
                    while len(self.open) > i:
                        self.end(self.open[-1][0])
                    break
                if self.open[i][0] in SCOPE:
                    break
        fields = self.attributes(attrs)
        if tag in TRANSPARENT:
            return
        if tag in INLINE:
            if tag in VOID:
                s, e = self.put(MARKERLESS)
                self.add(s, e, tag, fields)
            else:
                self.open.append((tag, fields, self.size, len(self.rows)))
            return
        s, e = self.put(MARKERLESS if self.size == 0 else "\n")
        self.add(s, e, tag, {"parents": self.parents()} | ({"attrs": fields} if fields else {}))
        if tag not in VOID:
            self.open.append((tag, fields, self.size, len(self.rows)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.end(tag)

    def end(self, tag: str) -> None:
        t, fields, start, at = self.open.pop()
        if t in INLINE and self.size > start:
            self.add(start, self.size, t, fields, at)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open):
            while self.open[-1][0] != tag:
                self.end(self.open[-1][0])
            self.end(tag)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.put(data)

    def handle_comment(self, data: str) -> None:
        s, e = self.put(MARKERLESS)
        self.add(s, e, "comment", {"content": data})


def read(raw: str, namespace: str) -> tuple[str, list[dict]]:
    r = _Reader()
    r.feed(raw)
    r.close()  # what the parser has held back: text after an unfinished tag or reference
    if r.rawdata:  # and what stands in a script or style without an end
        r.handle_data(r.rawdata)
    for t in [t for t, *_ in reversed(r.open)]:
        r.end(t)
    order = sorted(range(len(r.rows)), key=lambda i: (r.rows[i]["byte_start"], -r.rows[i]["byte_end"], i))
    rows, facet, feat, last = [], -1, 0, None
    for i in order:
        x = r.rows[i]
        key = (x["byte_start"], x["byte_end"])
        facet, feat = (facet, feat + 1) if key == last else (facet + 1, 0)
        last = key
        rows.append({"facet_ord": facet, "feat_ord": feat, "byte_start": key[0], "byte_end": key[1], "type_id": namespace, "name": x["name"], "data": json.dumps(x["data"], ensure_ascii=False)})
    return "".join(r.text), rows


def _attributes(fields: dict) -> str:
    return "".join(f' {k}="{html.escape(" ".join(v) if isinstance(v, list) else str(v))}"' for k, v in fields.items() if k not in ("name", "parents", "expandStart", "expandEnd") and not isinstance(v, dict))


#: Tags of the common names.
TAGS = {"bold": "strong", "italic": "em", "strikethrough": "s", "underline": "u", "code": "code", "superscript": "sup", "subscript": "sub", "highlight": "mark", "keyboard": "kbd", "insertion": "ins", "deletion": "del", "link": "a", "image": "img", "line-break": "br"}


def print_tree(tree: list[dict]) -> str:
    """The common tree as HTML."""

    def runs(rs: list, level: int = 0) -> str:
        out, i = [], 0
        ranked = [(t, tuple(sorted(ms, key=lambda m: m[0] != "link"))) for t, ms in rs] if level == 0 else rs
        while i < len(ranked):
            text, ms = ranked[i]
            if len(ms) <= level:
                out.append(html.escape(text, quote=False))
                i += 1
                continue
            m, j = ms[level], i
            while j < len(ranked) and len(ranked[j][1]) > level and ranked[j][1][level] == m:
                j += 1
            tag, a = TAGS.get(m[0], m[0] if m[0] in INLINE else "span"), attrs_of(m)
            out.append(f"<{tag}{_attributes(a)}>" if tag in VOID else f"<{tag}{_attributes(a)}>{runs(ranked[i:j], level + 1)}</{tag}>")
            i = j
        return "".join(out)

    def walk(nodes: list[dict], tight: bool = False) -> str:
        out = []
        for n in nodes:
            k = n["kind"]
            if k == "quote":
                out.append(f"<blockquote>{walk(n['children'])}</blockquote>")
            elif k == "list":
                tag = "ol" if n["ordered"] else "ul"
                start = f' start="{n["start"]}"' if n["ordered"] and n.get("start", 1) != 1 else ""
                out.append(f"<{tag}{start}>" + "".join(f"<li>{walk(i, sum(c['kind'] == 'paragraph' for c in i) < 2)}</li>" for i in n["items"]) + f"</{tag}>")
            elif k == "heading":
                h = f"h{n['attrs'].get('level', 1)}"
                out.append(f"<{h}>{runs(n['runs'])}</{h}>")
            elif k == "code-block":
                lang = n["attrs"].get("language")
                out.append(f"<pre><code{f' class=\"language-{html.escape(lang)}\"' if lang else ''}>{html.escape(plain(n['runs']), quote=False)}</code></pre>")
            elif k == "horizontal-rule":
                out.append("<hr>")
            elif tight:
                out.append(runs(n["runs"]))
            else:
                out.append(f"<p>{runs(n['runs'])}</p>")
        return "".join(out)

    return walk(tree)


def print_rows(text: str, rows: list[dict]) -> str:
    """Features of the HTML vocabulary as HTML: the block tags nest by their parents, marks nest within blocks."""
    raw = text.encode()
    feats = [r | {"f": json.loads(r["data"] or "{}")} for r in sorted(rows, key=lambda r: (r["byte_start"], -r["byte_end"], r.get("facet_ord", 0), r.get("feat_ord", 0)))]
    blocks = [f for f in feats if "parents" in f["f"]]
    marks = [f for f in feats if "parents" not in f["f"] and f["byte_end"] > f["byte_start"]]

    def inline(lo: int, hi: int) -> str:
        own = [m for m in marks if m["byte_start"] < hi and m["byte_end"] > lo]
        cuts = sorted({lo, hi, *(min(max(x, lo), hi) for m in own for x in (m["byte_start"], m["byte_end"]))})
        out, stack = [], []
        for s, e in zip(cuts, cuts[1:], strict=False):
            held = [m for m in own if m["byte_start"] <= s and m["byte_end"] >= e]
            keep = 0
            while keep < len(stack) and keep < len(held) and stack[keep] is held[keep]:
                keep += 1
            while len(stack) > keep:
                out.append(f"</{stack.pop()['name']}>")
            void = None
            for m in held[keep:]:
                if m["name"] in VOID or m["name"] == "comment":
                    void = m
                    continue
                out.append(f"<{m['name']}{_attributes(m['f'])}>")
                stack.append(m)
            if void is not None:
                out.append(f"<!--{void['f'].get('content', '')}-->" if void["name"] == "comment" else f"<{void['name']}{_attributes(void['f'])}>")
            else:
                out.append(html.escape(raw[s:e].decode(errors="replace"), quote=False))
        while stack:
            out.append(f"</{stack.pop()['name']}>")
        return "".join(out)

    if not blocks:
        return inline(0, len(raw))
    out, open_ = [inline(0, blocks[0]["byte_start"])], []
    for i, b in enumerate(blocks):
        parents = b["f"]["parents"]
        keep = 0
        while keep < len(open_) and keep < len(parents) and open_[keep] == parents[keep]:
            keep += 1
        while len(open_) > keep:
            out.append(f"</{open_.pop()}>")
        end = blocks[i + 1]["byte_start"] if i + 1 < len(blocks) else len(raw)
        out.append(f"<{b['name']}{_attributes(b['f'].get('attrs') or {})}>" + inline(b["byte_end"], end))
        if b["name"] not in VOID:
            open_.append(b["name"])
    while open_:
        out.append(f"</{open_.pop()}>")
    return "".join(out)
