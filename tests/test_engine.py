"""Document engine: laws and small cases."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import detect, jsonfn, offsets
from marginalia.lens import Lens, LensError, LensGraph, apply_lens, compose, inverse
from marginalia.operators import blocks as blk
from marginalia.operators import edit, facet_sql, layers, normalize
from marginalia.operators.hir import fold
from marginalia.sources import document as D

NS = "a.facet"


def features(spark, rows):
    return spark.createDataFrame([(r[0], r[1], 0, *r[2:4], NS, r[4], json.dumps({"name": r[4]} | (r[5] if len(r) > 5 else {}))) for r in rows], D.FEATURES)


@pytest.fixture(scope="module")
def f(spark):
    return features(spark, [(1, 0, 0, 3, "heading", {"parents": [], "attrs": {"level": 2}}), (1, 1, 3, 8, "bold"), (1, 2, 5, 14, "link", {"href": "u", "class": ["x", "y"]}), (1, 3, 14, 15, "paragraph", {"parents": ["ul"]})])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "￼hello world\nand more é")], "doc_id long, text string")


def test_json_round_trip(spark, f, docs):
    nested = D.nest(f, docs)
    again = D.feature_rows(nested.select("doc_id", D.parse(F.col("doc")).alias("doc")))
    key = ["doc_id", "byte_start", "byte_end", "type_id", "name"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, f.select(key).collect()))


def test_malformed_json_raises(spark):
    bad = spark.createDataFrame([(1, '{"text": ')], "doc_id long, j string")
    with pytest.raises(Exception):
        bad.select(D.parse(F.col("j"))).collect()


def test_positions(spark):
    text = "a é🌍\nz"
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for c in range(len(text) + 1):
        b = len(text[:c].encode())
        u = len(text[:c].encode("utf-16-le")) // 2
        got = row.select(offsets.char_to_byte(F.col("text"), F.lit(c)), offsets.byte_to_char(F.col("text"), F.lit(b)), offsets.byte_to_utf16(F.col("text"), F.lit(b)), offsets.utf16_to_byte(F.col("text"), F.lit(u))).first()
        assert tuple(got) == (b, c, u, b)
    assert row.select(offsets.on_boundary(F.col("text"), F.lit(3))).first()[0] is False
    with pytest.raises(Exception):
        row.select(offsets.checked_text_at(F.col("text"), F.lit(3), F.lit(4))).collect()


def test_typed_json(spark):
    r = spark.createDataFrame([('{"n":1,"s":"1","b":true,"class":"x y"}',)], "data string")
    v = lambda k: F.variant_get(F.parse_json("data"), f"$.{k}", "variant")
    assert tuple(r.select(jsonfn.same_typed(v("n"), 1), jsonfn.same_typed(v("s"), 1), jsonfn.same_typed(v("b"), 1), jsonfn.class_contains(F.col("data"), F.lit("y"))).first()) == (True, False, False, True)


def test_normalize_is_idempotent(spark, f):
    once = normalize.normalize(f)
    twice = normalize.normalize(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_blocks_and_segments(spark, f, docs):
    b = blk.blocks(docs, f)
    assert [(r.name, r.text) for r in b.orderBy("block_index").collect()] == [("heading", "hello world"), ("paragraph", "and more é")]
    segs = blk.segments(b, f).orderBy("block_index", "seg_ord").collect()
    assert ["".join(s.content for s in segs if s.block_index == i) for i in (0, 1)] == ["hello world", "and more é"]
    assert [[m.name for m in s.marks] for s in segs if s.block_index == 0] == [["bold"], ["bold", "link"], ["link"]]


def test_insert_then_delete_restores(spark, f, docs):
    d1, f1 = edit.insert_text(docs, f, spark.createDataFrame([(1, 6, "éé")], "doc_id long, pos int, ins string"))
    d2, f2 = edit.delete_text(d1, f1, spark.createDataFrame([(1, 6, 10)], "doc_id long, lo int, hi int"))
    assert d2.first().text == docs.first().text
    key = ["facet_ord", "byte_start", "byte_end"]
    assert sorted(map(tuple, f2.select(key).collect())) == sorted(map(tuple, f.select(key).collect()))


def test_detect(spark):
    d = spark.createDataFrame([(1, "héy @bob. and @al http://x.y/#a?@b). #tag")], "doc_id long, text string")
    got = [(r.kind, r.value, r.byte_start, r.byte_end) for r in detect.detect(d).collect()]
    assert got == [("mention", "al", 15, 18), ("link", "http://x.y/#a?@b", 19, 35), ("tag", "tag", 38, 42)]


def lens(rules, source=NS, target="b.facet", **more):
    return Lens.from_json({"id": f"{source}>{target}", "source": source, "target": target, "rules": rules} | more)


def test_first_match_wins(spark, f):
    l1 = lens([{"match": {"name": "link", "matchAttrsAny": {"class": ["q"]}}, "replace": {"name": "no"}}, {"match": {"name": "link", "matchAttrsAll": {"class": ["x", "y"]}}, "replace": {"name": "yes"}}, {"match": {"name": "link"}, "replace": {"name": "late"}}], passthrough="drop")
    assert [r.name for r in apply_lens(f, l1).collect()] == ["yes"]


def test_inverse_laws(spark, f):
    l1 = lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "link"}, "replace": {"name": "a", "renameAttrs": {"href": "url"}}}])
    back = apply_lens(apply_lens(f, l1), inverse(l1))
    assert sorted(map(tuple, back.where("name in ('bold','link')").select("name", "type_id", F.get_json_object("data", "$.href")).collect()), key=str) == [("bold", NS, None), ("link", NS, "u")]
    assert inverse(inverse(l1)).rules == l1.rules


@pytest.mark.parametrize("replace", [None, {"name": {"template": "h{x}"}}, {"keepAttrs": ["a"]}, {"dropAttrs": ["a"]}, {"mapAttrValue": {"a": {"op": "prefix", "value": "x"}}}, {"mapAttrValue": {"a": {"op": "multiply", "value": 0}}}])
def test_no_inverse(replace):
    with pytest.raises(LensError):
        inverse(lens([{"match": {"name": "x"}, "replace": replace}]))


def test_compose_is_one_after_the_other(spark, f):
    a = lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "link"}, "replace": {"name": "a", "addAttrs": {"k": 1}}}])
    b = lens([{"match": {"name": "strong"}, "replace": {"name": "b"}}, {"match": {"name": "a", "matchAttrs": {"k": 2}}, "replace": {"name": "never"}}, {"match": {"name": "a"}, "replace": {"name": "anchor"}}], "b.facet", "c.facet")
    show = lambda x: sorted(map(tuple, x.select("facet_ord", "type_id", "name").collect()))
    assert show(apply_lens(f, compose(a, b))) == show(apply_lens(apply_lens(f, a), b))
    assert compose(b, a) is None


def test_graph_takes_the_shortest_path():
    g = LensGraph()
    for s, t in (("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")):
        g.register(lens([], s, t))
    assert g.find_path("a", "d").id == "a>d" and g.find_path("a", "c").id == "a>b+b>c"
    assert g.find_path("d", "a") is None and g.find_path("a", "a").rules == ()


def test_statements(spark, f):
    out, selects = facet_sql.apply_facet_sql(f, "UPDATE features SET name = 'x;y' WHERE name = 'bold'; SELECT count(*) AS n FROM features; DELETE FROM features WHERE name = 'link'")
    assert sorted(r.name for r in out.collect()) == ["heading", "paragraph", "x;y"] and selects[0].first().n == 4
    assert facet_sql.validate_sql(spark, "UPDATE features SET nope = 1")


def test_layers_round_trip(spark, f):
    a, c = layers.to_layers(f)
    back = layers.from_layers(a, c)
    key = ["doc_id", "byte_start", "byte_end", "type_id", "name"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, f.select(key).collect()))


def test_container_folding():
    seg = [{"content": "x", "marks": "[]"}]
    nodes = fold([{"name": "p", "attrs": "{}", "parents": ["ul", "li"], "segments": seg}, {"name": "p", "attrs": "{}", "parents": ["ul"], "segments": []}])
    assert [(n["kind"], n["name"], n["depth"]) for n in nodes] == [("container", "ul", 0), ("container", "li", 1), ("block", "p", 2), ("text", None, 3), ("block", "p", 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é🌍\n", max_size=20), st.lists(st.tuples(st.integers(0, 20), st.text(alphabet="xé", min_size=1, max_size=3)), max_size=5))
def test_patches_fold_to_the_text(text, splices):
    from marginalia.streaming.edits import fold as fold_patches

    want = text
    patches = []
    for at, new in splices:
        at = min(at, len(want))
        units = len(want[:at].encode("utf-16-le")) // 2
        patches.append({"action": "splice", "path": ["text", str(units)], "value": json.dumps(new), "length": 0})
        want = want[:at] + new + want[at:]
    assert fold_patches(text, [], patches, NS)[0] == want


def test_stream_equals_batch(spark, tmp_path):
    from marginalia.streaming import edits

    rows = [(1, 0, "splice", ["text", "0"], '"￼"', 0), (1, 1, "put", ["text", "0", "name"], '"heading"', 0), (1, 2, "splice", ["text", "1"], '"hello"', 0), (1, 3, "mark", ["text"], '{"start":1,"end":6,"name":"bold","value":true}', 0), (1, 4, "del", ["text", "1"], None, 2)]
    schema = "doc_id long, seq long, action string, path array<string>, value string, length long"
    df = spark.createDataFrame(rows, schema)
    batch = edits.apply_patches(df, spark.createDataFrame([(1, "")], "doc_id long, text string"), NS).first()
    for i, lo in enumerate((0, 2)):
        df.where(f"seq >= {lo} and seq < {lo + 2 + i}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = edits.stream_patches(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), NS)
    q = stream.writeStream.format("memory").queryName("patched").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("patched").orderBy(F.desc("seq")).first()
    assert (last.text, json.loads(last.facets)) == (batch.text, json.loads(batch.facets))
    assert batch.text == "￼llo"


def random_lens(rng, source, target):
    names, keys = ["p", "q", "r"], ["k", "l", "m"]
    value = lambda: rng.choice([1, 2, "x", "y", True])
    rules = []
    for _ in range(rng.randint(1, 4)):
        match = {"name": rng.choice(names)} if rng.random() < 0.8 else {}
        if rng.random() < 0.4:
            match["matchAttrs"] = {rng.choice(keys): value()}
        if rng.random() < 0.3:
            match[rng.choice(["matchAttrsAny", "matchAttrsAll"])] = {rng.choice(keys): [value() for _ in range(rng.randint(1, 2))]}
        replace = {}
        if rng.random() < 0.7:
            replace["name"] = rng.choice(names)
        if rng.random() < 0.4:
            a, b = rng.sample(keys, 2)
            replace["renameAttrs"] = {a: b}
        if rng.random() < 0.3:
            replace["addAttrs"] = {rng.choice(keys): value()}
        if rng.random() < 0.3:
            replace["dropAttrs"] = [rng.choice(keys)]
        if rng.random() < 0.2:
            replace["keepAttrs"] = rng.sample(keys, 2)
        if rng.random() < 0.3:
            replace["mapAttrValue"] = {rng.choice(keys): rng.choice([{"op": "add", "value": 1}, {"op": "negate"}, {"op": "prefix", "value": "x"}])}
        rules.append({"match": match, "replace": None if rng.random() < 0.15 else replace})
    return lens(rules, source, target, passthrough=rng.choice(["keep", "drop"]))


def random_features(rng, n):
    out = []
    for i in range(n):
        attrs = {k: rng.choice([1, 2, 3, "x", "y", "xy", True, False, ["x", 1], [2, "y"]]) for k in rng.sample(["k", "l", "m"], rng.randint(0, 3))}
        name = rng.choice(["p", "q", "r", None])
        fields = ({"name": name} if name else {}) | (attrs if i % 2 else {"attrs": attrs}) | ({"parents": rng.sample(["p", "q", "z"], 2)} if i % 3 == 0 else {})
        out.append((rng.choice([NS, NS, "b.facet", "other"]), name, fields))
    return out


def test_composition_is_application_in_turn():
    import random

    from marginalia.lens.interpret import apply_to_feature

    rng, composed, changed = random.Random(5), 0, 0
    for _ in range(600):
        a, b = random_lens(rng, NS, "b.facet"), random_lens(rng, "b.facet", "c.facet")
        try:
            both = compose(a, b)
        except LensError:
            continue
        composed += 1
        for type_id, name, fields in random_features(rng, 25):
            once = apply_to_feature(a, type_id, name, fields)
            want = once and apply_to_feature(b, *once)
            assert apply_to_feature(both, type_id, name, fields) == want, (a, b, type_id, name, fields)
            changed += want is not None and want[0] == "c.facet"
    assert composed > 300 and changed > 1000


def test_compiled_lenses_equal_the_plain_form(spark):
    import random

    from marginalia.lens.interpret import apply_to_feature

    rng = random.Random(6)
    rows = random_features(rng, 120)
    df = spark.createDataFrame([(1, i, 0, i, i + 1, t, n, json.dumps(x)) for i, (t, n, x) in enumerate(rows)], D.FEATURES)
    lenses = [random_lens(rng, NS, "b.facet") for _ in range(6)]
    lenses.append(lens([{"match": {"name": "p"}, "replace": {"name": {"template": "t-{k}-{zz}"}}}]))
    for a in list(lenses[:6]):
        try:
            lenses.append(compose(a, random_lens(rng, "b.facet", "c.facet")))
        except LensError:
            pass
    for x in lenses:
        want = {i: y for i, (t, n, fields) in enumerate(rows) if (y := apply_to_feature(x, t, n, fields)) is not None}
        got = {r.facet_ord: (r.type_id, r.name, json.loads(r.data)) for r in apply_lens(df, x).collect()}
        assert got == want, x


def test_a_second_lens_sees_what_the_first_made(spark):
    f = features(spark, [(1, 0, 0, 1, "p", {"attrs": {"y": 1}}), (1, 1, 1, 2, "p", {"attrs": {"y": 2}})])
    a = lens([{"match": {"name": "p"}, "replace": {"renameAttrs": {"y": "x"}}}])
    b = lens([{"match": {"name": "p", "matchAttrsAny": {"x": [1]}}, "replace": {"name": "one"}}], "b.facet", "c.facet")
    assert sorted((r.type_id, r.name) for r in apply_lens(f, compose(a, b)).collect()) == [("b.facet", "p"), ("c.facet", "one")]


def test_statements_leave_literals_alone(spark):
    f = features(spark, [(1, 0, 0, 3, "features"), (1, 1, 3, 4, "{x}")])
    _, (a, b, c) = facet_sql.apply_facet_sql(f, "SELECT count(*) AS n FROM features WHERE name = 'features'; SELECT features.name FROM features WHERE name = '{x}'; SELECT json_object('k', name, 'n', json_object()) AS j FROM features WHERE byte_start = 0")
    assert a.first().n == 1 and b.first().name == "{x}" and json.loads(c.first().j) == {"k": "features", "n": "{}"}
    out, _ = facet_sql.apply_facet_sql(f, "UPDATE features SET data = json_object('name', 'text_at(1, 2)') WHERE name = 'features'")
    assert json.loads(out.where("byte_start = 0").first().data) == {"name": "text_at(1, 2)"}
    assert "features" not in [t.name for t in spark.catalog.listTables()]


DOC = json.dumps({"text": "￼héllo\nx", "facets": [{"index": {"byteStart": 0, "byteEnd": 3}, "features": [{"$type": NS, "name": "p", "parents": []}]}, {"index": {"byteStart": 3, "byteEnd": 6}, "features": [{"$type": NS, "name": "b", "expandEnd": True}, {"$type": NS, "name": "i"}]}, {"index": {"byteStart": 9, "byteEnd": 10}, "features": [{"$type": NS, "name": "q", "parents": ["ul"], "attrs": {"n": 1}}]}]}, ensure_ascii=False)


def test_sql_functions_over_documents(spark):
    facet_sql.register_functions(spark)
    df = spark.createDataFrame([(DOC,)], "doc string")
    shown = lambda e: (lambda d: (d["text"], [(f["index"]["byteStart"], f["index"]["byteEnd"], [x["name"] for x in f["features"]]) for f in d.get("facets", [])]))(json.loads(df.selectExpr(f"{e} AS d").first().d))
    assert shown("rt_insert_text(doc, 6, 'éé')") == ("￼hé" + "éé" + "llo\nx", [(0, 3, ["p"]), (3, 10, ["b", "i"]), (13, 14, ["q"])])
    assert shown("rt_delete_text(doc, 3, 6)") == ("￼llo\nx", [(0, 3, ["p"]), (6, 7, ["q"])])
    assert shown("rt_delete_text(doc, 5, 99)")[0] == "￼héllo\nx"
    assert shown(f"rt_remove_mark(doc, 3, 6, '{NS}#b')")[1][1] == (3, 6, ["i"]) and len(shown(f"rt_remove_mark(doc, 3, 6, '{NS}')")[1]) == 2
    with pytest.raises(Exception):
        shown("rt_insert_text(doc, 5, 'x')")
    rows = spark.sql("SELECT b.* FROM {d} d, LATERAL rt_blocks(d.doc) b ORDER BY block_index", d=df).collect()
    assert [tuple(r) for r in rows] == [(0, "p", "{}", "[]", "héllo"), (1, "q", '{"n":1}', '["ul"]', "x")]
    spec = json.dumps(lens([{"match": {"name": "b"}, "replace": {"name": "strong"}}, {"match": {"name": "i"}, "replace": None, "deleteText": True}]).to_json())
    assert shown(f"rt_apply_lens(doc, '{spec}')") == ("￼llo\nx", [(0, 3, ["p"]), (6, 7, ["q"])])


def test_two_edits_of_a_document(spark, docs, f):
    from marginalia.streaming import edits

    two = spark.createDataFrame([(1, 3, "a"), (1, 5, "b")], "doc_id long, pos int, ins string")
    with pytest.raises(Exception):
        edit.insert_text(docs, f, two)[0].collect()
    muts = [(1, 0, json.dumps({"op": "insertText", "byte_pos": 3, "text": "ab"})), (1, 1, json.dumps({"op": "deleteText", "byte_start": 3, "byte_end": 4}))]
    d, g = edits.apply_mutations(spark.createDataFrame(muts, "doc_id long, seq long, mutation string"), docs, f, NS)
    assert d.first().text == "￼bhello world\nand more é"
    assert sorted((r.byte_start, r.byte_end, r.name) for r in g.collect()) == [(0, 3, "heading"), (4, 9, "bold"), (6, 15, "link"), (15, 16, "paragraph")]


def test_patches_keep_existing_features(spark, docs, f):
    from marginalia.streaming import edits

    p = spark.createDataFrame([(1, 0, "splice", ["text", "1"], '"xy"', 0)], "doc_id long, seq long, action string, path array<string>, value string, length long")
    done = {r.doc_id: r for r in edits.apply_patches(p, docs.union(spark.createDataFrame([(2, "still")], docs.schema)), NS, features=f).collect()}
    assert done[1].text.startswith("￼xyhello") and [(x["s"], x["e"], x["name"]) for x in json.loads(done[1].facets)] == [(0, 3, "heading"), (5, 10, "bold"), (7, 16, "link"), (16, 17, "paragraph")]
    assert done[2].text == "still" and done[2].facets == "[]"


def test_mutations_and_patches_go_both_ways():
    from marginalia.streaming.edits import PatchReader, mutation_patches

    text = "￼a🌍é b"
    muts = [{"op": "insertText", "byte_pos": 4, "text": "xé"}, {"op": "deleteText", "byte_start": 3, "byte_end": 4}, {"op": "addMark", "byte_start": 3, "byte_end": 6, "name": "bold", "value": True, "expand": True}, {"op": "removeMark", "byte_start": 3, "byte_end": 6, "name": "bold"}, {"op": "addBlock", "byte_pos": 6, "marker": "\n", "name": "heading", "type_id": "t", "parents": ["ul"], "attrs": {"level": 2}}, {"op": "insertText", "byte_pos": 7, "text": "zz"}]
    reader = PatchReader(text)
    got = [m for p in mutation_patches(text, muts) for m in reader.read(p)] + reader.flush()
    assert got == muts


def test_alignment_stays_within_a_document(spark):
    links = spark.createDataFrame([(d, 1, [0], [1]) for d in (1, 2)], "doc_id long, link_id int, source_indices array<int>, target_indices array<int>")
    tokens = spark.createDataFrame([(d, i, f"{d}-{i}") for d in (1, 2) for i in (0, 1)], "doc_id long, token_index int, text string")
    got = sorted((r.doc_id, r.source_text, r.target_text) for r in layers.aligned_tokens(links, tokens, tokens).collect())
    assert got == [(1, "1-0", "1-1"), (2, "2-0", "2-1")]


@pytest.mark.parametrize("name", ["sql_delete_text", "sql_insert_text", "sql_apply_lens", "sql_remove_mark"])
def test_lateral_rows_meet_no_document(spark, name):
    """The table function's rows come out of the document's own row: no join, shuffle or grouping by whole documents, and its
    text is digested below it."""
    from marginalia.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1  # those that make the documents
    assert "md5(" not in plan[: plan.index("Generate")]
