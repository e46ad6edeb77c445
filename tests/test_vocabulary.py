"""Lexicons, spans and references."""

import json

import pytest

from marginalia.functions import refs
from marginalia.sources import lexicon, spans
from marginalia.sources.document import FEATURES


def test_lexicon(spark):
    lex = lexicon.load(spark, [{"id": "x", "features": [{"typeId": "a.facet#bold", "featureClass": "inline", "expandEnd": True}, {"typeId": "a.facet@2", "featureClass": "block"}, {"typeId": "odd", "featureClass": "??"}]}])
    f = spark.createDataFrame([(1, 0, 0, 0, 3, "a.facet", "p", "{}"), (1, 1, 0, 3, 5, "a.facet", "bold", "{}"), (1, 2, 0, 3, 5, "none", None, '{"expandStart":true}')], FEATURES)
    got = {(r.type_id, r.name): (r.feature_class, r.expand_start, r.expand_end) for r in lexicon.classify(f, lex).collect()}
    assert got == {("a.facet", "p"): ("Block", False, False), ("a.facet", "bold"): ("InlineMark", False, True), ("none", None): ("InlineMark", True, False)}
    assert [r.type_name for r in lexicon.annotations(f, lex).orderBy("ord").collect()] == ["a.facet#p", "a.facet#bold", "none"]
    with pytest.raises(ValueError):
        lexicon.entries({"features": [{}]})


def test_spans(spark):
    given = [{"type": "block", "value": {"type": "heading", "parents": [], "attrs": {"level": 2}}}, {"type": "text", "value": "é a", "marks": {"bold": True}}, {"type": "text", "value": "b", "marks": {"bold": True, "link": "http://x"}}, {"type": "text", "value": "c"}]
    text, rows = spans.read_spans(given, "n")
    assert text == "￼é abc" and spans.write_spans(text, rows) == given
    docs, f = spans.from_spans(spark.createDataFrame([(1, json.dumps(given)), (2, None)], "doc_id long, spans string"), "n")
    assert docs.count() == 2 and sorted(r.name for r in f.collect()) == ["bold", "heading", "link"]


def test_references(spark):
    d = spark.createDataFrame([(1, 'a<ref name="x">{{cite|url=http://u|title=T}}</ref> b<ref>http://v</ref> c<ref name="x"/> d<ref group="g">n</ref>'), (2, None), (3, "none")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in refs.expand(d).collect()} == {1: "a[1] b[2] c[1] d[g 1]", 2: None, 3: "none"}
    got = refs.references(d).orderBy("ord").collect()
    assert [(r.number, r.url, r.title) for r in got] == [(1, "http://u", "T"), (2, "http://v", None), (1, "http://u", "T"), (1, None, None)]
