"""The line-based formats as tables over ``markup``."""

from __future__ import annotations

import re

from .markup import Syntax
from .tree import leaf, mark, plain


def _link(m, inner):  # noqa: ANN001, ANN202
    return inner(m["text"], (mark("link", href=m["href"]),))


def _bare_link(m, inner):  # noqa: ANN001, ANN202
    return [(m["href"], (mark("link", href=m["href"]),))]


def _piped(m, inner):  # noqa: ANN001, ANN202
    return [(m["text"] or m["href"], (mark("link", href=m["href"]),))]


def _image(m, inner):  # noqa: ANN001, ANN202
    return [("￼", (mark("image", src=m["src"], alt=m.groupdict().get("alt") or ""),))]


def _token(name: str, key: str):  # noqa: ANN202
    return lambda m, inner: [(m[0], (mark(name, **{key: m["v"]}),))]


def _kept(m, inner):  # noqa: ANN001, ANN202
    return [(m[0], ())]


MD_LINK = r"\[(?P<text>[^\]\n]+)\]\((?P<href>[^)\s]+)\)"
MD_IMAGE = r"!\[(?P<alt>[^\]\n]*)\]\((?P<src>[^)\s]+)\)"
URL = r"(?P<href>https?://[^\s,\"'<>]*[^\s,\"'<>.!?)])"
MENTION, HASHTAG = r"(?<!\w)@(?P<v>[\w.-]*\w)", r"(?<!\w)#(?P<v>[\w-]+)"
LINK_OUT = {"link": lambda s, a: f"[{s}]({a.get('href', '')})", "image": lambda s, a: f"![{a.get('alt', '')}]({a.get('src', '')})", "mention": lambda s, a: s, "hashtag": lambda s, a: s}
HASHES = {"heading": r"(?P<level>#{1,6}) +(?P<text>.*)", "print_heading": lambda n, s: "#" * n + " " + s}
DOTTED = {"heading": r"h(?P<level>[1-6])\. +(?P<text>.*)", "heading_level": int, "print_heading": lambda n, s: f"h{n}. {s}"}

slack = Syntax(
    delimiters=(("`", "`", "code"), ("*", "*", "bold"), ("_", "_", "italic"), ("~", "~", "strikethrough")), nest=False,
    patterns=((r"<[@#!][^>\n]*>", _kept), (r"<(?P<href>[^|>\n]+)(?:\|(?P<text>[^>\n]*))?>", _piped)), ordered=None, bullet=r"(?P<indent>\s*)[•*-] +(?P<text>.*)",
    print_bullet=lambda d, o, n: "• ", print_mark={"link": lambda s, a: f"<{a.get('href', '')}>" if s == a.get("href") else f"<{a.get('href', '')}|{s}>"},
)
discord = Syntax(
    delimiters=(("`", "`", "code"), ("**", "**", "bold"), ("__", "__", "underline"), ("~~", "~~", "strikethrough"), ("||", "||", "spoiler"), ("*", "*", "italic"), ("_", "_", "italic")),
    patterns=((MD_IMAGE, _image), (MD_LINK, _link)), rule=r"-{3,}", print_mark=LINK_OUT, **HASHES | {"heading": r"(?P<level>#{1,3}) +(?P<text>.*)"},
)
telegram = Syntax(
    delimiters=(("`", "`", "code"), ("__", "__", "underline"), ("||", "||", "spoiler"), ("*", "*", "bold"), ("_", "_", "italic"), ("~", "~", "strikethrough")),
    patterns=((MD_LINK, _link),), escape="\\", print_mark=LINK_OUT,
)
whatsapp = Syntax(delimiters=(("`", "`", "code"), ("*", "*", "bold"), ("_", "_", "italic"), ("~", "~", "strikethrough")), nest=False, rule=r"-{3,}")
linkedin = Syntax(
    delimiters=(("**", "**", "bold"), ("*", "*", "italic"), ("_", "_", "italic")), nest=False, blank_splits=True, quote=None, fence=None,
    patterns=((r"@\[(?P<text>[^\]\n]+)\]\((?P<href>[^)\s]+)\)", lambda m, i: [("@" + m["text"], (mark("mention", urn=m["href"]),))]), (MENTION, _token("mention", "handle")), (HASHTAG, _token("hashtag", "tag"))),
    print_mark={"mention": lambda s, a: f"@[{s.lstrip('@')}]({a['urn']})" if a.get("urn") else s, "hashtag": lambda s, a: s},
)
threads = Syntax(delimiters=(("**", "**", "bold"), ("_", "_", "italic")), nest=False, blank_splits=True, quote=None, fence=None, bullet=None, ordered=None, patterns=((URL, _bare_link), (MENTION, _token("mention", "handle")), (HASHTAG, _token("hashtag", "tag"))), print_mark={"link": lambda s, a: a.get("href", s)})
textile = Syntax(
    delimiters=(("==", "==", "literal"), ("@", "@", "code"), ("**", "**", "strong"), ("__", "__", "italic"), ("*", "*", "bold"), ("_", "_", "italic"), ("+", "+", "underline"), ("-", "-", "strikethrough"), ("^", "^", "superscript"), ("~", "~", "subscript")),
    patterns=((r"\"(?P<text>[^\"\n]+)\":(?P<href>[^\s]*[^\s.,;:!?)])", _link), (r"!(?P<src>[^\s!(]+)(?:\((?P<alt>[^)]*)\))?!", _image)),
    bullet=r"(?P<stars>\*+) +(?P<text>.*)", ordered=r"(?P<stars>#+) +(?P<text>.*)", print_bullet=lambda d, o, n: ("#" if o else "*") * (d + 1) + " ", quote=r"bq\. +(.*)", print_quote="bq. ", fence=None, print_fence=("", ""), rule=r"-{3,}", blank_splits=True,
    line_blocks=((r"bc\. +(.*)", lambda m, i: leaf("code-block", [(m[1], ())])), (r"p\. +(.*)", lambda m, i: leaf("paragraph", i(m[1])))), print_block={}, **DOTTED,
    print_mark={"link": lambda s, a: f'"{s}":{a.get("href", "")}', "image": lambda s, a: f"!{a.get('src', '')}" + (f"({a['alt']})" if a.get("alt") else "") + "!"},
)
dokuwiki = Syntax(
    delimiters=(("%%", "%%", "literal"), ("''", "''", "monospace"), ("**", "**", "bold"), ("//", "//", "italic"), ("__", "__", "underline"), ("<del>", "</del>", "strikethrough"), ("<nowiki>", "</nowiki>", "literal")),
    patterns=((r"https?://[^\s]+", lambda m, i: [(m[0], (mark("extlink", href=m[0]),))]), (r"\[\[(?P<href>https?://[^|\]]+)(?:\|(?P<text>[^\]]*))?\]\]", lambda m, i: [(m["text"] or m["href"], (mark("extlink", href=m["href"]),))]), (r"\[\[(?P<href>[^|\]]+)(?:\|(?P<text>[^\]]*))?\]\]", lambda m, i: [(m["text"] or m["href"], (mark("wikilink", page=m["href"]),))]), (r"\{\{(?P<src>[^|}]+)(?:\|(?P<alt>[^}]*))?\}\}", _image), (r"\\\\(?:\s|$)", lambda m, i: [("￼", (mark("line-break"),))])),
    heading=r"(?P<level>={2,6}) *(?P<text>.*?) *={2,6}", heading_level=lambda s: 7 - len(s), print_heading=lambda n, s: "=" * (7 - n) + f" {s} " + "=" * (7 - n),
    bullet=r"(?P<indent>(?:  )+)\* +(?P<text>.*)", ordered=r"(?P<indent>(?:  )+)- +(?P<text>.*)", print_bullet=lambda d, o, n: "  " * (d + 1) + ("- " if o else "* "), fence=(r"<code ?(?P<lang>\w*)>", r"</code>"), print_fence=("<code {lang}>", "</code>"), rule=r"-{4,}", print_rule="----", blank_splits=True,
    print_mark={"extlink": lambda s, a: f"[[{a.get('href', '')}|{s}]]", "link": lambda s, a: f"[[{a.get('href', '')}|{s}]]", "wikilink": lambda s, a: f"[[{a.get('page', '')}|{s}]]", "image": lambda s, a: "{{" + a.get("src", "") + "}}", "line-break": lambda s, a: "\\\\ "},
)
confluence = Syntax(
    delimiters=(("{{", "}}", "monospace"), ("*", "*", "bold"), ("_", "_", "italic"), ("+", "+", "underline"), ("-", "-", "strikethrough"), ("^", "^", "superscript"), ("~", "~", "subscript")),
    patterns=((r"\[(?P<text>[^|\]\n]+)\|(?P<href>[^\]\n]+)\]", _link), (r"\[(?P<href>[^|\]\n]+)\]", _bare_link), (r"!(?P<src>[^\s!|]+)(?:\|(?P<alt>[^!]*))?!", _image)),
    bullet=r"(?P<stars>[*-]+) +(?P<text>.*)", ordered=r"(?P<stars>#+) +(?P<text>.*)", print_bullet=lambda d, o, n: ("#" if o else "*") * (d + 1) + " ", quote=r"(?:bq\.|>) *(.*)", print_quote="bq. ", fence=(r"\{code:?(?P<lang>\w*)\}", r"\{code\}"), print_fence=("{{code:{lang}}}", "{{code}}"), rule=r"-{4,}", print_rule="----", **DOTTED,
    line_blocks=((r"\{(note|warning|tip|info)\}(.*)\{\1\}", lambda m, i: leaf("admonition", i(m[2]), type=m[1])),), print_block={"admonition": lambda n, i: "{%s}%s{%s}" % (n["attrs"].get("type", "note"), i(n["runs"]), n["attrs"].get("type", "note"))},
    print_mark={"link": lambda s, a: f"[{s}|{a.get('href', '')}]", "image": lambda s, a: f"!{a.get('src', '')}!"},
)
org = Syntax(
    delimiters=(("=", "=", "verbatim"), ("~", "~", "code"), ("*", "*", "bold"), ("/", "/", "italic"), ("_", "_", "underline"), ("+", "+", "strikethrough")),
    patterns=((r"\[\[(?P<href>[^\]]+)\](?:\[(?P<text>[^\]]+)\])?\]", _piped), (r"<\d{4}-\d\d-\d\d[^>\n]*>", lambda m, i: [(m[0], (mark("timestamp", value=m[0][1:-1]),))])),
    heading=r"(?P<level>\*+) +(?P<text>.*)", print_heading=lambda n, s: "*" * n + " " + s, bullet=r"(?P<indent>\s*)[-+] +(?P<text>.*)", quote=None, fence=(r"#\+(?i:begin_(?:src|example)) ?(?P<lang>\w*)", r"#\+(?i:end_(?:src|example))"), print_fence=("#+BEGIN_SRC {lang}", "#+END_SRC"), rule=r"-{5,}", print_rule="-----", blank_splits=True,
    line_blocks=((r"# .*", lambda m, i: []), (r"(\*+) (TODO|DONE) (.*)", lambda m, i: leaf("heading", i(m[3]), level=len(m[1]), todo=m[2]))), print_mark={"link": lambda s, a: f"[[{a.get('href', '')}][{s}]]"}, print_quote=": ",
)
logseq = Syntax(
    delimiters=(("`", "`", "code"), ("**", "**", "bold"), ("~~", "~~", "strikethrough"), ("*", "*", "italic"), ("_", "_", "italic")),
    patterns=((r"\[\[(?P<v>[^\]\n]+)\]\]", _token("page-ref", "page")), (r"\(\((?P<v>[^)\n]+)\)\)", _token("block-ref", "uid")), (HASHTAG, _token("hashtag", "tag")), (MD_LINK, _link)),
    line_blocks=((r"\s*([\w-]+):: (.*)", lambda m, i: leaf("property", i(m[2]), key=m[1])), (r"(\s*)[-*+] (?:(TODO|DONE) )?(.*)", lambda m, i: leaf("block", i(m[3]), level=len(m[1].expandtabs(2)) // 2, **({"todo": m[2]} if m[2] else {})))), bullet=None, ordered=None, quote=None,
    print_block={"property": lambda n, i: f"{n['attrs'].get('key', '')}:: {i(n['runs'])}", "block": lambda n, i: "  " * int(n["attrs"].get("level", 0)) + "- " + (n["attrs"]["todo"] + " " if n["attrs"].get("todo") else "") + i(n["runs"])}, print_mark=LINK_OUT | {"page-ref": lambda s, a: s, "block-ref": lambda s, a: s},
)
fountain = Syntax(
    delimiters=(("**", "**", "bold"), ("*", "*", "italic"), ("_", "_", "underline")), patterns=((r"\[\[(?P<v>[^\]]+)\]\]", lambda m, i: [(m["v"], (mark("note"),))]),), bullet=None, ordered=None, quote=None, fence=None,
    line_blocks=(
        (r"(?i:(?:INT|EXT|EST|INT\./EXT|INT/EXT|I/E)[. ].*)", lambda m, i: leaf("scene-heading", [(m[0], ())])), (r"={3,}", lambda m, i: leaf("page-break")), (r"= (.*)", lambda m, i: leaf("synopsis", i(m[1]))), (r"(#+) (.*)", lambda m, i: leaf("section", i(m[2]), level=len(m[1]))),
        (r"~(.*)", lambda m, i: leaf("lyric", i(m[1]))), (r"> ?(.*[^<])|([A-Z ]+ TO:)", lambda m, i: leaf("transition", [(m[1] or m[2], ())])), (r"\(.*\)", lambda m, i: leaf("parenthetical", [(m[0], ())])), (r"(?P<k>Title|Credit|Author|Source|Draft date|Contact): (.*)", lambda m, i: leaf("title-page", [(m[2], ())], key=m[1])), (r"[A-Z][A-Z0-9 .'()-]*[A-Z)]", lambda m, i: leaf("character", [(m[0], ())])),
    ),
    print_block={"page-break": lambda n, i: "===", "synopsis": lambda n, i: "= " + i(n["runs"]), "section": lambda n, i: "#" * int(n["attrs"].get("level", 1)) + " " + i(n["runs"]), "lyric": lambda n, i: "~" + i(n["runs"]), "transition": lambda n, i: "> " + i(n["runs"]), "title-page": lambda n, i: f"{n['attrs'].get('key', 'Title')}: {i(n['runs'])}"}, print_mark={"note": lambda s, a: f"[[{s}]]"},
)


def fountain_dialogue(tree: list[dict]) -> list[dict]:
    """Plain lines after a character or parenthetical are dialogue, others action."""
    last = ""
    for n in tree:
        if n["kind"] == "paragraph":
            n["kind"] = "dialogue" if last in ("character", "parenthetical", "dialogue") else "action"
        last = n["kind"]
    return tree


mediawiki = Syntax(
    delimiters=(("<nowiki>", "</nowiki>", "nowiki"), ("<code>", "</code>", "code"), ("'''", "'''", "bold"), ("''", "''", "italic")),
    patterns=(
        (r"<ref(?: name=\"?(?P<name>[^\"/>]*)\"?)?\s*(?:/>|>(?P<body>.*?)</ref>)", lambda m, i: [("￼", (mark("ref", **{k: v for k, v in (("name", m["name"]), ("content", m["body"])) if v}),))]), (r"<br ?/?>", lambda m, i: [("￼", (mark("line-break"),))]), (r"\{\{(?P<v>[^{}]*)\}\}", lambda m, i: [("￼", (mark("template", content=m["v"]),))]),
        (r"\[\[(?:File|Image):(?P<src>[^|\]]+)(?:\|(?P<alt>[^\]]*))?\]\]", _image), (r"\[\[Category:(?P<v>[^|\]]+)[^\]]*\]\]", lambda m, i: [("￼", (mark("category", name_=m["v"]),))]), (r"\[\[(?P<href>[^|\]]+)(?:\|(?P<text>[^\]]*))?\]\]", lambda m, i: [(m["text"] or m["href"], (mark("wikilink", page=m["href"]),))]), (r"\[(?P<href>https?://[^\s\]]+)(?: (?P<text>[^\]]*))?\]", lambda m, i: [(m["text"] or m["href"], (mark("extlink", href=m["href"]),))]),
    ),
    heading=r"(?P<level>={1,6}) *(?P<text>.*?) *={1,6}", print_heading=lambda n, s: "=" * n + f" {s} " + "=" * n, bullet=r"(?P<stars>\*+) *(?P<text>.*)", ordered=r"(?P<stars>#+) *(?P<text>.*)", print_bullet=lambda d, o, n: ("#" if o else "*") * (d + 1) + " ", quote=None, fence=None, print_fence=(" ", ""), rule=r"-{4,}", print_rule="----", blank_splits=True, word_edges=False,
    line_blocks=((r";(.*?)(?::(.*))?", lambda m, i: [leaf("definition-term", i(m[1].strip())), *([leaf("definition-detail", i(m[2].strip()))] if m[2] else [])]), (r":(.*)", lambda m, i: leaf("definition-detail", i(m[1].strip()))), (r" (.*)", lambda m, i: leaf("preformatted", [(m[1], ())])), (r"\{\|(.*)", lambda m, i: leaf("table", [], attributes=m[1].strip())), (r"\|\+(.*)", lambda m, i: leaf("table-caption", i(m[1].strip()))), (r"\|-.*", lambda m, i: leaf("table-row")), (r"\|\}", lambda m, i: []), (r"!(.*)", lambda m, i: [leaf("table-heading", i(c.strip())) for c in re.split(r"!!", m[1])]), (r"\|(.*)", lambda m, i: [leaf("table-cell", i(c.strip())) for c in re.split(r"\|\|", m[1])])),
    print_block={"definition-term": lambda n, i: "; " + i(n["runs"]), "definition-detail": lambda n, i: ": " + i(n["runs"]), "preformatted": lambda n, i: " " + plain(n["runs"]), "table": lambda n, i: "{| " + n["attrs"].get("attributes", ""), "table-caption": lambda n, i: "|+ " + i(n["runs"]), "table-row": lambda n, i: "|-", "table-heading": lambda n, i: "! " + i(n["runs"]), "table-cell": lambda n, i: "| " + i(n["runs"])},
    print_mark={"wikilink": lambda s, a: f"[[{a.get('page', '')}|{s}]]" if a.get("page") != s else f"[[{s}]]", "extlink": lambda s, a: f"[{a.get('href', '')} {s}]", "link": lambda s, a: f"[{a.get('href', '')} {s}]", "template": lambda s, a: "{{" + a.get("content", "") + "}}", "ref": lambda s, a: f"<ref>{a.get('content', '')}</ref>", "line-break": lambda s, a: "<br>", "image": lambda s, a: f"[[File:{a.get('src', '')}]]", "category": lambda s, a: f"[[Category:{a.get('name_', '')}]]"},
)
bbcode = Syntax(
    delimiters=tuple((f"[{t}]", f"[/{t}]", n) for t, n in (("b", "bold"), ("i", "italic"), ("u", "underline"), ("s", "strikethrough"), ("code", "code"))), word_edges=False,
    patterns=((r"\[url=(?P<href>[^\]]+)\](?P<text>.*?)\[/url\]", _link), (r"\[url\](?P<href>.*?)\[/url\]", _bare_link), (r"\[img\](?P<src>.*?)\[/img\]", _image), (r"\[color=(?P<v>[^\]]+)\](?P<text>.*?)\[/color\]", lambda m, i: i(m["text"], (mark("color", value=m["v"]),))), (r"\[size=(?P<v>[^\]]+)\](?P<text>.*?)\[/size\]", lambda m, i: i(m["text"], (mark("size", value=m["v"]),)))),
    bullet=r"(?P<indent>\s*)\[\*\] *(?P<text>.*)", ordered=None, print_bullet=lambda d, o, n: "[*] ", quote=r"\[quote\](.*)\[/quote\]", print_quote="", fence=(r"\[code\]", r"\[/code\]"), print_fence=("[code]", "[/code]"), line_blocks=((r"\[/?list(?:=1)?\]", lambda m, i: []),),
    print_mark={"link": lambda s, a: f"[url={a.get('href', '')}]{s}[/url]", "image": lambda s, a: f"[img]{a.get('src', '')}[/img]", "color": lambda s, a: f"[color={a.get('value', '')}]{s}[/color]", "size": lambda s, a: f"[size={a.get('value', '')}]{s}[/size]"},
)

#: Markdown and its relatives.
_MD = dict(delimiters=(("`", "`", "code"), ("**", "**", "bold"), ("__", "__", "bold"), ("~~", "~~", "strikethrough"), ("*", "*", "italic"), ("_", "_", "italic")), escape="\\", blank_splits=True, rule=r"(?:-{3,}|\*{3,}|_{3,})")
_MD_PATTERNS = ((MD_IMAGE, _image), (MD_LINK, _link), (r"<(?P<href>https?://[^>\s]+)>", _bare_link), *((p, lambda m, i: [("￼", (mark("line-break"),))]) for p in (r"  +\n", r"\\\n")))
_MD_MARKS = LINK_OUT | {"line-break": lambda s, a: "  \n"}
_FOOT = ((r"\[\^(?P<v>[^\]]+)\](?!:)", lambda m, i: [("￼", (mark("footnote-ref", label=m["v"]),))]),)
_FOOT_DEF = (r"\[\^([^\]]+)\]: (.*)", lambda m, i: leaf("footnote-def", i(m[2]), label=m[1]))
_FOOT_OUT = {"footnote-def": lambda n, i: f"[^{n['attrs'].get('label', '')}]: {i(n['runs'])}"}


def _md(delimiters: tuple = (), patterns: tuple = (), line_blocks: tuple = (), print_block: dict | None = None, print_mark: dict | None = None) -> Syntax:
    return Syntax(**_MD | {"delimiters": (*delimiters, *_MD["delimiters"])}, patterns=(*patterns, *_MD_PATTERNS), line_blocks=line_blocks, print_block=print_block or {}, print_mark=_MD_MARKS | (print_mark or {}), **HASHES)


commonmark = _md(print_mark={n: (lambda t: lambda s, a: f"<{t}>{s}</{t}>")(t) for n, t in (("underline", "u"), ("superscript", "sup"), ("subscript", "sub"), ("keyboard", "kbd"), ("insertion", "ins"), ("deletion", "del"), ("highlight", "mark"))})
gitlab = _md((("{+", "+}", "ins"), ("{-", "-}", "del")), (*_FOOT, (r"\$`(?P<v>[^`]+)`\$", lambda m, i: [(m["v"], (mark("math-inline"),))]), (MENTION, _token("mention", "handle")), (r"(?<!\w)#(?P<v>\d+)", _token("issue-ref", "id")), (r"(?<!\w)!(?P<v>\d+)", _token("mr-ref", "id"))), (_FOOT_DEF,), _FOOT_OUT, {"footnote-ref": lambda s, a: f"[^{a.get('label', '')}]", "math-inline": lambda s, a: f"$`{s}`$"})
obsidian = _md((("==", "==", "highlight"),), ((r"\[\[(?P<href>[^|\]\n]+)(?:\|(?P<text>[^\]\n]*))?\]\]", lambda m, i: [(m["text"] or m["href"], (mark("wikilink", page=m["href"]),))]), (r"(?<!\w)#(?P<v>[A-Za-z][\w/-]*)", _token("hashtag", "tag"))), ((r"> ?\[!(\w+)\] ?(.*)", lambda m, i: leaf("callout", i(m[2]), type=m[1])),), {"callout": lambda n, i: f"> [!{n['attrs'].get('type', 'note')}] {i(n['runs'])}"}, {"wikilink": lambda s, a: f"[[{a.get('page', '')}]]" if s == a.get("page") else f"[[{a.get('page', '')}|{s}]]"})
myst = _md((), ((r"\{(?P<role>[\w:-]+)\}`(?P<v>[^`]*)`", lambda m, i: [(m["v"], (mark("role", role=m["role"]),))]), (r"\$(?P<v>[^$\n]+)\$", lambda m, i: [(m["v"], (mark("math-inline"),))])), ((r":::\{(\w+)\} ?(.*)", lambda m, i: leaf("directive", i(m[2]), directive=m[1])), (r":::", lambda m, i: [])), {"directive": lambda n, i: ":::{%s} %s\n:::" % (n["attrs"].get("directive", "note"), i(n["runs"]))}, {"role": lambda s, a: "{%s}`%s`" % (a.get("role", ""), s), "math-inline": lambda s, a: f"${s}$"})
multimarkdown = _md((("^", "^", "superscript"), ("==", "==", "highlight")), _FOOT, (_FOOT_DEF,), _FOOT_OUT, {"footnote-ref": lambda s, a: f"[^{a.get('label', '')}]", "subscript": lambda s, a: f"~{s}~"})
mdx = _md((), ((r"<(?P<v>[A-Z]\w*[^>\n]*)/>", lambda m, i: [("￼", (mark("jsx-inline", source=m[0]),))]), (r"\{(?P<v>[^{}\n]+)\}", lambda m, i: [("￼", (mark("expression", value=m["v"]),))])), ((r"(?:import|export) .*", lambda m, i: leaf("import-stmt", [(m[0], ())])), (r"</?[A-Z]\w*[^>]*>", lambda m, i: leaf("jsx-block", [(m[0], ())]))), None, {"jsx-inline": lambda s, a: a.get("source", ""), "expression": lambda s, a: "{" + a.get("value", "") + "}"})
markdoc = _md((), ((r"\{% \$(?P<v>[\w.]+) %\}", lambda m, i: [("￼", (mark("variable", name_=m["v"]),))]), (r"\{% (?P<v>[^%\n]+?) /%\}", lambda m, i: [("￼", (mark("inline-tag", source=m["v"]),))])), ((r"\{% (/?)if ?(.*?) %\}", lambda m, i: leaf("conditional", [], condition=m[2], close=bool(m[1]))), (r"\{% (/?)(\w+) ?(.*?) %\}", lambda m, i: leaf("tag", [], tag=m[2], attributes=m[3], close=bool(m[1])))), {"conditional": lambda n, i: "{%% %sif %s%%}" % ("/" * bool(n["attrs"].get("close")), (n["attrs"].get("condition") or "") + " " * bool(n["attrs"].get("condition"))), "tag": lambda n, i: "{%% %s%s %s%%}" % ("/" * bool(n["attrs"].get("close")), n["attrs"].get("tag", ""), (n["attrs"].get("attributes") or "") + " " * bool(n["attrs"].get("attributes")))}, {"variable": lambda s, a: "{%% $%s %%}" % a.get("name_", ""), "inline-tag": lambda s, a: "{%% %s /%%}" % a.get("source", "")})
pandoc = _md((("~", "~", "subscript"), ("^", "^", "superscript")), (*_FOOT, (r"\^\[(?P<v>[^\]]+)\]", lambda m, i: [("￼", (mark("Note", content=m["v"]),))]), (r"\[(?P<text>[^\]\n]+)\]\{(?P<v>[^}\n]+)\}", lambda m, i: i(m["text"], (mark("Span", attributes=m["v"]),)))), (_FOOT_DEF, (r":{3,} *(.+)", lambda m, i: leaf("Div", [], attributes=m[1])), (r":{3,}", lambda m, i: []), (r"(#{1,6}) (.*?) \{([^}]*)\}", lambda m, i: leaf("heading", i(m[2]), level=len(m[1]), attributes=m[3]))), _FOOT_OUT | {"Div": lambda n, i: "::: " + n["attrs"].get("attributes", "")}, {"Note": lambda s, a: f"^[{a.get('content', '')}]", "Span": lambda s, a: f"[{s}]{{{a.get('attributes', '')}}}", "footnote-ref": lambda s, a: f"[^{a.get('label', '')}]"})


def front_matter(raw: str, kind: str) -> tuple[list[dict], str]:
    """A leading block between --- lines, as one leaf."""
    m = re.match(r"---\n(.*?)\n---\n?", raw, re.S)
    return ([leaf(kind, [(m[1], ())])], raw[m.end() :]) if m else ([], raw)


roam = Syntax(
    delimiters=(("`", "`", "code"), ("**", "**", "bold"), ("__", "__", "italic"), ("^^", "^^", "highlight")),
    patterns=((r"\[\[(?P<v>[^\]\n]+)\]\]", _token("page-ref", "page")), (r"\(\((?P<v>[^)\n]+)\)\)", _token("block-ref", "uid")), (HASHTAG, _token("hashtag", "tag")), (MD_IMAGE, _image), (MD_LINK, _link)), print_mark=LINK_OUT | {"page-ref": lambda s, a: s, "block-ref": lambda s, a: s},
)
