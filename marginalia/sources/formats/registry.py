"""The formats by name, and their Spark form: parsers and printers run over Arrow batches at the edges; everything
between - changing vocabularies above all - is expressions on the features table."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...lens.spec import Lens, Pattern, Replacement, Rule
from . import html, lines, objects
from .markup import Syntax, parse, render
from .tree import from_features, leaf, to_features

HUB = "org.marginalia.facet"
FEATURE_ARRAY = "array<struct<facet_ord:int,feat_ord:int,byte_start:int,byte_end:int,type_id:string,name:string,data:string>>"


@dataclass(frozen=True)
class Format:
    """names: common name -> the format's own, where they differ. read/write: whole functions where the tree does not
    fit; else parser and printer of trees."""

    name: str
    namespace: str
    parser: Callable[[str], list[dict]] | None = None
    printer: Callable[[list[dict]], str] | None = None
    names: dict[str, str] = field(default_factory=dict)
    reader: Callable[[str, str], tuple[str, list[dict]]] | None = None
    writer: Callable[[str, list[dict]], str] | None = None

    def read(self, raw: str) -> tuple[str, list[dict]]:
        """Raw string, or a JSON object {text: raw}, to text and feature rows."""
        if raw.lstrip().startswith('{"text"') and self.reader is None:
            try:
                inner = json.loads(raw)
                if set(inner) <= {"text"}:
                    raw = inner["text"]
            except ValueError:
                pass
        if self.reader is not None:
            return self.reader(raw, self.namespace)
        return to_features(self.parser(raw), self.namespace, lambda n: self.names.get(n, n))

    def write(self, text: str, rows: list[dict]) -> str:
        own = [r for r in rows if (r["type_id"] or "").startswith(self.namespace)]
        if self.writer is not None:
            return self.writer(text, own)
        back = {v: k for k, v in self.names.items()}
        return self.printer(from_features(text, own, lambda n: back.get(n, n)))


_FORMATS: dict[str, Format] = {}


def register_format(fmt: Format, *aliases: str) -> None:
    for name in (fmt.name, *aliases):
        _FORMATS[name] = fmt


def get_format(name: str) -> Format:
    if name not in _FORMATS:
        raise KeyError(f"no format {name}; there are {', '.join(list_formats())}")
    return _FORMATS[name]


def has_format(name: str) -> bool:
    return name in _FORMATS


def list_formats() -> list[str]:
    return sorted(_FORMATS)


def _syntax(name: str, namespace: str, x: Syntax, names: dict[str, str] | None = None, *aliases: str, before: str | None = None, after: Callable | None = None) -> None:
    def parser(raw: str) -> list[dict]:
        first, rest = lines.front_matter(raw, before) if before else ([], raw)
        tree = first + parse(rest, x)
        return after(tree) if after else tree

    def printer(tree: list[dict]) -> str:
        head = [n for n in tree[:1] if before and n["kind"] == before]
        body = render(tree[len(head) :], x)
        return ("---\n" + "".join(t for t, _ in head[0]["runs"]) + "\n---\n" if head else "") + body

    register_format(Format(name, namespace, parser, printer, names or {}), *aliases)


#: What vocabularies call the common features.
_STRONG = {"bold": "strong", "italic": "emphasis", "code": "code-span"}
_syntax("slack", "com.slack.mrkdwn.facet", lines.slack)
_syntax("discord", "com.discord.facet", lines.discord, {"line-break": "hard-break"})
_syntax("telegram", "org.telegram.facet", lines.telegram, {"link": "text_link"})
_syntax("whatsapp", "com.whatsapp.facet", lines.whatsapp)
_syntax("linkedin", "com.linkedin.facet", lines.linkedin)
_syntax("threads", "com.threads.facet", lines.threads)
_syntax("textile", "org.textile.facet", lines.textile)
_syntax("dokuwiki", "org.dokuwiki.facet", lines.dokuwiki, {"link": "extlink", "code": "monospace"})
_syntax("confluence", "com.atlassian.wiki.facet", lines.confluence, {"code": "monospace"}, "jira")
_syntax("org", "org.orgmode.facet", lines.org)
_syntax("logseq", "com.logseq.facet", lines.logseq, {"hashtag": "tag"})
_syntax("fountain", "com.fountain.facet", lines.fountain, after=lines.fountain_dialogue)
_syntax("mediawiki", "org.mediawiki.facet", lines.mediawiki, {"link": "extlink"})
_syntax("bbcode", "org.bbcode.facet", lines.bbcode, {"bold": "b", "italic": "i", "underline": "u", "strikethrough": "s", "link": "url", "image": "img"})
_syntax("markdown", "org.commonmark.facet", lines.commonmark, _STRONG, "commonmark", "gfm")
_syntax("gitlab", "com.gitlab.facet", lines.gitlab, _STRONG)
_syntax("obsidian", "md.obsidian.facet", lines.obsidian, _STRONG | {"hashtag": "tag"})
_syntax("myst", "org.mystmd.facet", lines.myst, _STRONG, before="frontmatter")
_syntax("multimarkdown", "org.multimarkdown.facet", lines.multimarkdown, _STRONG, before="metadata")
_syntax("mdx", "dev.mdxjs.facet", lines.mdx, _STRONG, before="frontmatter")
_syntax("markdoc", "com.markdoc.facet", lines.markdoc, _STRONG, before="frontmatter")
_syntax("pandoc", "org.pandoc.facet", lines.pandoc, {"bold": "Strong", "italic": "Emph", "strikethrough": "Strikeout", "superscript": "Superscript", "subscript": "Subscript", "code": "Code", "link": "Link", "image": "Image", "line-break": "LineBreak", "paragraph": "Para", "heading": "Header", "code-block": "CodeBlock", "horizontal-rule": "HorizontalRule", "blockquote-marker": "BlockQuote", "bullet-list-marker": "BulletList", "ordered-list-marker": "OrderedList"}, before="Meta")
for _name, _space, _read, _write, _names in (
    ("prosemirror", "org.prosemirror.facet", objects.parse_prosemirror, objects.print_prosemirror, {"strikethrough": "strike", "line-break": "hard_break", "code-block": "code_block", "horizontal-rule": "horizontal_rule", "bullet-list-marker": "bullet_list", "ordered-list-marker": "ordered_list"}),
    ("tiptap", "dev.tiptap.facet", objects.parse_prosemirror, objects.print_tiptap, {"strikethrough": "strike", "line-break": "hardBreak", "code-block": "codeBlock", "horizontal-rule": "horizontalRule"}),
    ("quill", "org.quilljs.delta.facet", objects.parse_quill, objects.print_quill, {"strikethrough": "strike", "heading": "header"}),
    ("lexical", "io.lexical.facet", objects.parse_lexical, objects.print_lexical, {"line-break": "linebreak", "horizontal-rule": "horizontalrule"}),
    ("slate", "rocks.slate.facet", objects.parse_slate, objects.print_slate, {"line-break": "hard-break"}),
    ("contentful", "com.contentful.richtext.facet", objects.parse_contentful, objects.print_contentful, {"link": "hyperlink", "horizontal-rule": "hr"}),
    ("notion", "com.notion.facet", objects.parse_notion, objects.print_notion, {"horizontal-rule": "divider"}),
    ("sanity", "io.sanity.portabletext.facet", objects.parse_sanity, objects.print_sanity, {"bold": "strong", "italic": "em", "strikethrough": "strike-through", "superscript": "sup", "subscript": "sub", "paragraph": "normal"}),
    ("applenews", "com.apple.news.facet", objects.parse_applenews, objects.print_applenews, {"paragraph": "body"}),
    ("jupyter", "org.jupyter.facet", objects.parse_jupyter, objects.print_jupyter, {}),
    ("roam", "com.roamresearch.facet", objects.parse_roam, objects.print_roam, {"hashtag": "tag"}),
    ("opml", "org.opml.facet", objects.parse_opml, objects.print_opml, {}),
):
    register_format(Format(_name, _space, _read, _write, _names))
register_format(Format("html", "org.w3c.html.facet", reader=html.read, writer=html.print_rows, names={k: v for k, v in html.TAGS.items()}))
register_format(Format("mastodon", "org.joinmastodon.facet", reader=html.read, writer=html.print_rows))
register_format(Format("hub-html", HUB, printer=html.print_tree, parser=lambda raw: [leaf("paragraph", [(raw, ())])]))
register_format(Format("plaintext", "org.marginalia.plain.facet", parser=lambda raw: [leaf("paragraph", [(s, ())]) for s in raw.split("\n")], printer=lambda tree: "\n".join("".join(t for t, _ in n.get("runs", [])) for n in tree)))


def _read_bluesky(raw: str, namespace: str) -> tuple[str, list[dict]]:
    """Documents of text and facets pass as they are."""
    doc = json.loads(raw)
    rows = []
    for i, facet in enumerate(doc.get("facets") or []):
        for j, f in enumerate(facet.get("features") or []):
            kind, _, name = f.get("$type", "").partition("#")
            rows.append({"facet_ord": i, "feat_ord": j, "byte_start": facet["index"]["byteStart"], "byte_end": facet["index"]["byteEnd"], "type_id": kind, "name": f.get("name") or name or None, "data": json.dumps({k: v for k, v in f.items() if k != "$type"}, ensure_ascii=False)})
    return doc.get("text", ""), rows


def _write_bluesky(text: str, rows: list[dict]) -> str:
    facets: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["byte_start"], -r["byte_end"], r["facet_ord"], r["feat_ord"])):
        fields = {k: v for k, v in json.loads(r["data"] or "{}").items() if k != "name"}
        facets.setdefault((r["byte_start"], r["byte_end"]), []).append({"$type": r["type_id"] + (f"#{r['name']}" if r["name"] else "")} | fields)
    return json.dumps({"text": text} | ({"facets": [{"index": {"byteStart": s, "byteEnd": e}, "features": fs} for (s, e), fs in facets.items()]} if facets else {}), ensure_ascii=False)


register_format(Format("bluesky", "app.bsky.richtext.facet", reader=_read_bluesky, writer=_write_bluesky))


def lens_to_hub(name: str) -> Lens:
    """A format's vocabulary to the common one; names that agree pass with their type."""
    f = get_format(name)
    rules = tuple(Rule(Pattern(f.namespace, own), Replacement(HUB, common)) for common, own in f.names.items())
    if name in ("html", "mastodon"):
        block = {"p": "paragraph", "pre": "code-block", "hr": "horizontal-rule", "blockquote": "blockquote-marker", "ul": "bullet-list-marker", "ol": "ordered-list-marker", "li": "list-item-marker", "b": "bold", "i": "italic"}
        rules += tuple(Rule(Pattern(f.namespace, own), Replacement(HUB, common)) for own, common in block.items())
        rules += tuple(Rule(Pattern(f.namespace, f"h{n}"), Replacement(HUB, "heading", add={"level": n})) for n in range(1, 7))
    return Lens(f"{name}.to.hub", f.namespace, HUB, (*rules, Rule(Pattern(f.namespace), Replacement(HUB))), "keep", False)


def lens_from_hub(name: str) -> Lens:
    f = get_format(name)
    rules = tuple(Rule(Pattern(HUB, common), Replacement(f.namespace, own)) for common, own in f.names.items())
    if name == "html":
        rules = (Rule(Pattern(HUB, "heading"), Replacement(f.namespace, None, "h{level}", drop=("level",))), Rule(Pattern(HUB, "paragraph"), Replacement(f.namespace, "p")), *rules)
    return Lens(f"hub.to.{name}", HUB, f.namespace, (*rules, Rule(Pattern(HUB), Replacement(f.namespace))), "keep", False)


def read_format(df: DataFrame, name: str, raw: str = "raw", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """df(doc_id, raw) -> (docs(doc_id, text), features). A raw string that can't be parsed raises; null is empty. One
    pass parses; both results read its output, so store it (checkpoint) where both are used over a large corpus."""
    fmt = get_format(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.struct([("facet_ord", pa.int32()), ("feat_ord", pa.int32()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("type_id", pa.string()), ("name", pa.string()), ("data", pa.string())])
        for batch in batches:
            done = [fmt.read(x) if x else ("", []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([t for t, _ in done], pa.string()), "fs": pa.array([fs for _, fs in done], pa.list_(row))})

    parsed = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(raw).alias("raw")).mapInArrow(run, f"doc_id long, text string, fs {FEATURE_ARRAY}")
    return parsed.select("doc_id", "text"), parsed.select("doc_id", F.explode("fs").alias("f")).select("doc_id", "f.*")


def write_format(docs: DataFrame, features: DataFrame, name: str) -> DataFrame:
    """(doc_id, raw): features of the format's own vocabulary are printed; bring others there with a lens first."""
    fmt = get_format(name)
    own = features.where(F.startswith("type_id", F.lit(fmt.namespace)))
    row = F.struct("facet_ord", "feat_ord", "byte_start", "byte_end", "type_id", "name", "data")
    grouped = own.groupBy("doc_id").agg(F.collect_list(row).alias("fs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fmt.write(t or "", fs or []) for t, fs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "raw": pa.array(out, pa.string())})

    return docs.select("doc_id", "text").join(grouped, "doc_id", "left").mapInArrow(run, "doc_id long, raw string")


def convert(df: DataFrame, source: str, target: str, raw: str = "raw", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, raw) from one format to another: parse, two lenses through the hub, print - a document at a time in one
    Arrow stage, without a shuffle. Null is an empty document."""
    from ...lens.interpret import apply_to_feature, rule_finder

    read, write = get_format(source), get_format(target)
    lenses = [lens_to_hub(source), lens_from_hub(target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [rule_finder(x) for x in lenses]

        def one(x: str | None) -> str:
            text, rows = read.read(x) if x else ("", [])
            out = []
            for r in rows:
                made = (r["type_id"], r["name"], json.loads(r["data"] or "{}"))
                for lens, find in zip(lenses, finders, strict=True):
                    made = made and apply_to_feature(lens, *made, find)
                if made and (made[0] or "").startswith(write.namespace):
                    out.append(r | {"type_id": made[0], "name": made[1], "data": json.dumps(made[2], ensure_ascii=False)})
            return write.write(text, out)

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "raw": pa.array([one(x) for x in batch.column(1).to_pylist()], pa.string())})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(raw).alias("raw")).mapInArrow(run, "doc_id long, raw string")


def round_trip(df: DataFrame, name: str, raw: str = "raw", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, same_text, same_features), a row a row of df: whether what is printed is read as the same text and
    features - read, printed and read again a document at a time in one Arrow stage, without a shuffle. Null is an empty
    document; null and repeated ids change nothing."""
    fmt = get_format(name)

    def flat(rows: list[dict]) -> Counter:
        return Counter((r["byte_start"], r["byte_end"], r["name"], r["data"]) for r in rows)

    def one(x: str | None) -> tuple[int, bool, bool]:
        text, rows = fmt.read(x) if x else ("", [])
        printed = fmt.write(text, rows)
        again, found = fmt.read(printed) if printed else ("", [])
        return len(text), again == text, flat(found) == flat(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                done = [one(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_chars": pa.array([x[0] for x in done], pa.int32()), "same_text": pa.array([x[1] for x in done], pa.bool_()), "same_features": pa.array([x[2] for x in done], pa.bool_())})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(raw).alias("raw")).mapInArrow(run, "doc_id long, n_chars int, same_text boolean, same_features boolean")
