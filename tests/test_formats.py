"""Connectors: what is read, printed and read again is the same document."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.lens import apply_lens
from marginalia.sources.formats import get_format, has_format, lens_to_hub, list_formats, read_format, round_trip
from marginalia.sources.formats import lines, markup
from marginalia.sources.formats.registry import convert

CASES = {
    'slack': 'Hi *bold* and _it_ <https://x.y|link>\n> quoted\n• one\n• two\n```\ncode\n```',
    'discord': '# Head\n**b** __u__ ||sp|| [t](http://u)\n- a\n- b\n1. x',
    'telegram': '*b* _i_ __u__ \\* ~s~',
    'whatsapp': '*b* _i_\n> q',
    'linkedin': '**b** @[Ann](urn:1) #tag\n\n- x',
    'threads': 'hello @bob #x https://a.b/c.',
    'textile': 'h2. Title\n\n*b* _i_ "t":http://x.y\n\n* a\n** b\n\nbq. quo',
    'dokuwiki': '====== H ======\n\n**b** //i// [[page|text]]\n\n  * a\n    * b',
    'confluence': 'h1. T\n*b* [x|http://y]\n* a\n** b\n{note}hey{note}',
    'org': '* Head\n\n*b* /i/ [[http://x][y]]\n\n- a\n- b',
    'logseq': '- TODO *a* [[P]]\n  - b #t\nkey:: v',
    'fountain': 'Title: X\n\nINT. HOUSE - DAY\n\nBOB\n(low)\nHello *you*.\n\n> CUT',
    'mediawiki': "== H ==\n\n'''b''' ''i'' [[Page|t]] {{tpl}} <ref>c</ref>\n\n* a\n* b",
    'bbcode': '[b]x[/b] [url=http://a]t[/url]\n[list]\n[*] a\n[*] b\n[/list]',
    'markdown': '# T\n\nA **b** *i* `c` [l](http://x) ![a](s)\n\n> q1\n> q2\n\n- a\n  - b\n- c\n\n1. x\n2. y\n\n```py\ncode\n```\n\n---',
    'gitlab': 'a {+ins+} #12 @bob',
    'obsidian': '[[P|t]] ==h== #tag',
    'myst': '{ref}`x` $a$',
    'multimarkdown': 'a[^1]\n\n[^1]: note',
    'mdx': 'import X\n\n<Foo />\n\na {b}',
    'markdoc': '{% callout %}\n\nx\n\n{% /callout %}',
    'pandoc': '# H {#id}\n\n**b** ^[n]',
    'prosemirror': '{"type":"doc","content":[{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"T","marks":[{"type":"strong"}]}]},{"type":"bullet_list","content":[{"type":"list_item","content":[{"type":"paragraph","content":[{"type":"text","text":"a"}]}]}]}]}',
    'quill': '{"ops":[{"insert":"T"},{"insert":"\\n","attributes":{"header":1}},{"insert":"b","attributes":{"bold":true}},{"insert":"\\n"},{"insert":"x\\n","attributes":{"list":"bullet"}}]}',
    'lexical': '{"root":{"children":[{"type":"paragraph","children":[{"type":"text","text":"b","format":3}]}]}}',
    'slate': '[{"type":"heading-two","children":[{"text":"T","bold":true}]},{"type":"bulleted-list","children":[{"type":"list-item","children":[{"text":"a"}]}]}]',
    'notion': '[{"type":"heading_1","heading_1":{"rich_text":[{"plain_text":"T","annotations":{"bold":true}}]}},{"type":"bulleted_list_item","bulleted_list_item":{"rich_text":[{"plain_text":"x"}]}}]',
    'sanity': '[{"_type":"block","style":"h2","children":[{"text":"T","marks":["strong"]}],"markDefs":[]}]',
    'applenews': '{"components":[{"role":"title","text":"Hello","inlineTextStyles":[{"rangeStart":0,"rangeLength":2,"textStyle":"bold"}]}]}',
    'jupyter': '{"cells":[{"cell_type":"code","source":["a\\n","b"]}]}',
    'roam': '[{"title":"P","children":[{"string":"**a** [[b]]","children":[{"string":"c"}]}]}]',
    'opml': '<opml><head><title>T</title></head><body><outline text="a"><outline text="b" type="rss" xmlUrl="u"/></outline></body></opml>',
    'contentful': '{"nodeType":"document","content":[{"nodeType":"paragraph","content":[{"nodeType":"text","value":"x","marks":[{"type":"bold"}]}]}]}',
    'html': '<div><h1>T</h1><p>a <b>b <i>c</i></b><br>d<p>e<ul><li>x<li>y</ul><!--c--></div>',
    'bluesky': '{"text":"a b","facets":[{"index":{"byteStart":0,"byteEnd":1},"features":[{"$type":"app.bsky.richtext.facet#tag","tag":"a"}]}]}',
}


def flat(rows):
    return [(r["byte_start"], r["byte_end"], r["name"], json.loads(r["data"])) for r in rows]


@pytest.mark.parametrize("name", sorted(CASES))
def test_round_trip(name):
    f = get_format(name)
    text, rows = f.read(CASES[name])
    assert rows, "something is recognised"
    again = f.read(f.write(text, rows))
    assert (again[0], flat(again[1])) == (text, flat(rows))
    size = len(text.encode())
    assert all(0 <= r["byte_start"] <= r["byte_end"] <= size for r in rows)


def test_markdown_structure():
    text, rows = get_format("markdown").read("# T\n\na **b *c***\n\n> q\n\n1. x\n2. y")
    names = [r["name"] for r in rows]
    assert names[:2] == ["heading", "paragraph"] and {"strong", "emphasis", "blockquote-marker", "ordered-list-marker", "list-item-marker", "list-item-text"} <= set(names)
    assert json.loads(rows[0]["data"])["attrs"] == {"level": 1}
    assert json.loads(next(r for r in rows if r["name"] == "list-item-text")["data"])["parents"] == ["ol", "ordered-list-item"]


def test_html_implied_ends():
    text, rows = get_format("html").read("<p>a<p>b<ul><li>x<li>y</ul><script>s</script>")
    parents = [(r["name"], json.loads(r["data"]).get("parents")) for r in rows if "parents" in r["data"]]
    assert parents == [("p", []), ("p", []), ("ul", []), ("li", ["ul"]), ("li", ["ul"]), ("script", [])]
    assert text.startswith("￼a\nb")


def test_names():
    assert has_format("gfm") and get_format("jira") is get_format("confluence") and len(list_formats()) >= 38
    with pytest.raises(KeyError):
        get_format("none")


def test_conversion(spark):
    df = spark.createDataFrame([(1, "a **b** [l](http://x)\n\n- i"), (2, None)], "doc_id long, raw string")
    got = {r.doc_id: r.raw for r in convert(df, "markdown", "slack").collect()}
    assert got[1] == "a *b* <http://x|l>\n• i" and got[2] == ""


def test_hub_vocabulary(spark):
    df = spark.createDataFrame([(1, "<h2>T</h2><p>a <b>c</b></p>")], "doc_id long, raw string")
    hub = apply_lens(read_format(df, "html")[1], lens_to_hub("html"))
    assert sorted((r.name, r.level) for r in hub.select("name", F.get_json_object("data", "$.level").alias("level")).collect()) == [("bold", None), ("heading", "2"), ("paragraph", None)]


@pytest.mark.parametrize("raw,text", [("<p>We do R&D", "￼We do R&D"), ("AT&T", "AT&T"), ("<p>text &copy", "￼text ©"), ("<p>x<script>var a", "￼x\nvar a"), ("<p>a <b", "￼a "), ("<p>1 < 2", "￼1 < 2"), ("x<i>y &lt", "xy <")])
def test_html_keeps_its_tail(raw, text):
    got = get_format("html").read(raw)[0]
    assert got.replace(" ", "").startswith(text.replace(" ", "")), got


@pytest.mark.parametrize("name", ["markdown", "mediawiki"])
def test_round_trip_of_a_table(spark, name):
    """A row a row, whatever the ids; nothing is shuffled or read twice."""
    from marginalia.plans import catalog

    mark = {"markdown": "**", "mediawiki": "'''"}[name]
    rows = [(None, f"a {mark}b{mark} c"), (1, "a line\n\nanother\nline"), (1, "# T\n\n- i\n- [l](http://x)"), (2, None), (3, "")]
    got = round_trip(spark.createDataFrame(rows, "doc_id long, raw string"), name).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 2, 3] and all(r.same_text and r.same_features for r in got)
    plan = catalog.queries()[f"{name}_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["commonmark", "mediawiki"])
def test_plain_text_is_skipped(name):
    """Patterns are tried only where one can begin."""
    tried, x = [], getattr(lines, name)
    whole = x.compiled

    class Counted:
        def match(self, s, at):
            tried.append(at)

    x.__dict__["compiled"] = ([(Counted(), None)], whole[1])
    mark = {"commonmark": "*", "mediawiki": "''"}[name]
    try:
        assert markup.scan("plain words, " * 1000 + f"and {mark}one{mark} mark", x)[1][0] == "one"
    finally:
        x.__dict__["compiled"] = whole
    assert len(tried) <= 3


def test_syntaxes_do_not_share_what_is_compiled():
    """Copies of one syntax go, and another's may lie in their place, as in a worker that serves several formats."""
    import copy

    for _ in range(20):
        for name, text, found in (("commonmark", "a **b**", "bold"), ("mediawiki", "a [[b]]", "wikilink")):
            assert markup.scan(text, copy.copy(getattr(lines, name)))[1][1][0][0] == found
