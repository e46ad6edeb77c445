"""A lens as one projection: the first matching rule's number by a CASE chain, then type, name and data by that number.

Rules that only rename touch nothing but ``name`` in the data; only rules with attribute operations rewrite it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonfn
from ..functions.offsets import strip_version as strip_version_col
from ..sources.document import FEATURE_COLUMNS
from .spec import Lens, LensError, Pattern, Replacement, Rule, strip_version


def _nested(data: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(data), "$.attrs", "map<string,variant>")


def _variant(key: str) -> Column:
    """Nested under attrs first, else flat."""
    return F.coalesce(F.element_at(_nested(F.col("data")), F.lit(key)), F.element_at(jsonfn.as_map(F.col("data")), F.lit(key)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _members(v: Column) -> Column:
    """JSON texts of an array's members, or of a scalar alone."""
    return F.when(_kind(v).startswith("ARRAY"), F.transform(v.cast("array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.to_json(v)))


def _texts(values: list) -> Column:
    import json

    return F.array(*[F.lit(json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)) for x in values]) if values else F.array().cast("array<string>")


def matches(p: Pattern) -> Column:
    """Boolean column over features rows."""
    kind, whole = strip_version_col(F.col("type_id")), strip_version(p.type_id)
    if p.name is None:
        test = kind == whole
    else:
        test = ((kind == whole) & F.coalesce(F.col("name") == p.name, F.lit(False))) | (kind == f"{whole}#{p.name}")
    for q in (p, *p.also):
        test &= _tests(q)
    return F.coalesce(test, F.lit(False))


def _tests(p: Pattern) -> Column:
    """The attribute tests alone."""
    test = F.lit(True)
    for k, x in p.attrs.items():
        test &= jsonfn.same_typed(_variant(k), x)
    for k, xs in p.any.items():
        test &= F.coalesce(F.arrays_overlap(_members(_variant(k)), _texts(xs)), F.lit(False))
    for k, xs in p.all.items():
        v = _variant(k)
        scalar = ~_kind(v).startswith("ARRAY") & F.lit(len(xs) == 1)
        test &= F.coalesce(((_kind(v).startswith("ARRAY")) | scalar) & (F.size(F.array_except(_texts(xs), _members(v))) == 0), F.lit(False))
    return test


def _number(x: Column) -> Column:
    """A double as a VARIANT, integral values as integers."""
    whole = (x == F.floor(x)) & (F.abs(x) < 9e15)
    return F.when(whole, F.parse_json(x.cast("bigint").cast("string"))).otherwise(F.parse_json(x.cast("string")))


def _quoted(x: Column) -> Column:
    return F.parse_json(F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def value_op(v: Column, op: dict) -> Column:
    """A value op on a VARIANT; values of other types stay."""
    kind = _kind(v)
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    text, boolean, void = kind == "STRING", kind == "BOOLEAN", kind == "VOID"
    as_double, as_text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    name, arg = op["op"], op.get("value")
    if name in ("add", "subtract", "multiply"):
        made = {"add": as_double + F.lit(float(arg or 0)), "subtract": as_double - F.lit(float(arg or 0)), "multiply": as_double * F.lit(float(arg or 0))}[name]
        return F.when(number, _number(made)).otherwise(v)
    if name in ("prefix", "suffix"):
        return F.when(text, _quoted(F.concat(F.lit(arg), as_text) if name == "prefix" else F.concat(as_text, F.lit(arg)))).otherwise(v)
    if name == "negate":
        return F.when(boolean, F.parse_json((~F.try_variant_get(v, "$", "boolean")).cast("string"))).otherwise(v)
    if name == "to-string":
        return F.when(text, v).when(void, F.parse_json(F.lit('"null"'))).when(number | boolean, _quoted(F.to_json(v))).otherwise(v)
    if name == "to-number":
        parsed = as_text.try_cast("double")
        return F.when(number, v).when(boolean, F.when(F.try_variant_get(v, "$", "boolean"), F.parse_json(F.lit("1"))).otherwise(F.parse_json(F.lit("0")))).when(text & parsed.isNotNull(), _number(parsed)).when(text | void, F.parse_json(F.lit("null"))).otherwise(v)
    if name == "to-boolean":
        truth = F.when(text, ~as_text.isin("", "false", "0")).when(number, as_double != 0).when(void, F.lit(False))
        return F.when(boolean, v).when(truth.isNotNull(), F.parse_json(truth.cast("string"))).otherwise(v)
    raise LensError(f"unknown value op {name}")


def _only(k: str, op: dict):  # noqa: ANN202
    return lambda key, v: F.when(key == k, value_op(v, op)).otherwise(v)


def _attrs(m: Column, r: Replacement, flat: bool) -> Column:
    """rename, map, add, drop, keep - in this order."""
    if r.rename:
        old = F.create_map(*[x for a, b in r.rename.items() for x in (F.lit(a), F.lit(b))])
        m = F.map_from_entries(F.transform(F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*r.rename.values()) | e["key"].isin(*r.rename)), lambda e: F.struct(F.coalesce(F.element_at(old, e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    for k, op in r.value_ops.items():
        m = F.transform_values(m, _only(k, op))
    if r.add:
        m = jsonfn.with_values(m, {k: jsonfn.literal(v) for k, v in r.add.items()})
    m = jsonfn.without_keys(m, r.drop)
    if r.keep is not None:
        m = jsonfn.only_keys(m, (*r.keep, *(("name", "parents") if flat else ())))
    return m


def _new_name(r: Replacement, name: Column, nested: Column, flat: Column) -> Column:
    if r.template is None:
        return F.lit(r.name) if r.name is not None else name
    parts, at = [], 0
    for m in re.finditer(r"\{([^{}]+)\}", r.template):
        parts.append(F.lit(r.template[at : m.start()]))
        default = r.add.get(m[1])
        v = F.coalesce(F.element_at(nested, F.lit(m[1])), F.element_at(flat, F.lit(m[1])))
        told = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        parts.append(F.coalesce(told, F.lit(m[0] if default is None else str(default))))
        at = m.end()
    return F.concat(*parts, F.lit(r.template[at:]))


def _json_text(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def parent_steps(lens: Lens) -> tuple:
    """What happens to everyone's parents: (names that literal rules rename, names they drop), a lens at a time."""
    if lens.parent_steps is not None:
        return lens.parent_steps
    renamed, dropped = {}, []
    for r in lens.rules:
        if r.match is None or r.match.name is None or r.join or r.sql:
            continue
        if r.replace is None:
            dropped.append(r.match.name)
        elif r.replace.template is None and r.replace.name not in (None, r.match.name):
            renamed.setdefault(r.match.name, r.replace.name)
    dropped = [d for d in dropped if d not in renamed]
    return ((renamed, dropped),) if renamed or dropped else ()


def _changed_parents(parents: Column, renamed: dict[str, str], gone: list[str]) -> Column:
    if gone:
        parents = F.filter(parents, lambda x: ~x.isin(*gone))
    if renamed:
        to = F.create_map(*[x for kv in renamed.items() for x in map(F.lit, kv)])
        parents = F.transform(parents, lambda x: F.coalesce(F.element_at(to, x), x))
    return parents


def plain_rules(lens: Lens) -> list[Rule]:
    return [r for r in lens.rules if r.match is not None and r.join is None and r.sql is None]


def _numbers(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def matched_rule(lens: Lens) -> Column:
    """Number of the first rule that matches, null for none. Rules on type and name alone are one lookup in a constant
    map, however many there are; only rules with attribute tests need a chain."""
    exact: dict[str, int] = {}
    chain = None
    for i, r in enumerate(plain_rules(lens)):
        p = r.match
        if p.tests_attrs:
            chain = F.when(matches(p), i) if chain is None else chain.when(matches(p), i)
        else:
            exact.setdefault(strip_version(p.type_id) + ("" if p.name is None else f"#{p.name}"), i)
    found = [] if chain is None else [chain]
    if exact:
        kind = strip_version_col(F.col("type_id"))
        found += [F.try_element_at(_numbers(exact), kind), F.try_element_at(_numbers(exact), F.concat_ws("#", kind, "name"))]
    return F.lit(None).cast("int") if not found else found[0] if len(found) == 1 else F.least(*found)


def apply_lens(features: DataFrame, lens: Lens) -> DataFrame:
    """Rewrite features: first match decides; without one, ``passthrough``. Ranges stay."""
    if lens.user_function:
        raise LensError("a lens with a user function runs as a registered transform")
    rules = plain_rules(lens)
    f = features.withColumn("__rule", matched_rule(lens))
    kept = [i for i, r in enumerate(rules) if r.replace is not None]
    dropped = [i for i, r in enumerate(rules) if r.replace is None]
    if dropped:
        f = f.where(F.col("__rule").isNull() | ~F.col("__rule").isin(*dropped))
    if lens.passthrough == "drop":
        f = f.where(F.col("__rule").isNotNull())
    type_id, name = F.col("type_id"), F.col("name")
    by_rule = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("__rule"))
    last = {i: rules[i].replace.steps[-1] for i in kept}
    if kept:
        type_id = F.coalesce(by_rule({i: r.type_id for i, r in last.items()}), type_id)
    literal = {i: [s.name for s in rules[i].replace.steps if s.name is not None] for i in kept if all(s.template is None for s in rules[i].replace.steps)}
    if named := {i: names[-1] for i, names in literal.items() if names}:
        name = F.coalesce(by_rule(named), name)
    # data is parsed once, rewritten as maps, and written once, where it changes
    rewritten = [i for i in kept if rules[i].replace.touches_attrs]
    templates = [i for i in kept if i not in literal]
    steps = parent_steps(lens)
    if rewritten or templates or named or steps:
        f = f.withColumn("__m", jsonfn.as_map(F.col("data"))).withColumn("__a", _nested(F.col("data")))
    m, a = F.col("__m"), F.col("__a")
    for i in sorted({*rewritten, *templates}):
        on, flat, nested, own = F.col("__rule") == i, F.col("__m"), F.col("__a"), F.col("name")
        for r in rules[i].replace.steps:
            own = _new_name(r, own, nested, flat)
            if r.touches_attrs:
                one = Replacement("", None, None, r.rename, r.value_ops, r.add, r.drop, r.keep)
                flat = F.when(F.col("__a").isNull(), _attrs(flat, one, True)).otherwise(flat)
                nested = _attrs(nested, one, False)
        if i in templates:
            name = F.when(on, own).otherwise(name)
        if i in rewritten:
            m, a = F.when(on, flat).otherwise(m), F.when(on, nested).otherwise(a)
    columns = ["doc_id", "facet_ord", "feat_ord", "byte_start", "byte_end"]
    f = f.select(*columns, type_id.alias("type_id"), name.alias("name"), F.col("name").alias("__old"), "data", "__rule", *([m.alias("__m"), a.alias("__a")] if "__m" in f.columns else []))
    if "__m" in f.columns:
        void = F.lit(None).cast("variant")
        touched = F.coalesce(F.col("__rule").isin(*rewritten), F.lit(False)) if rewritten else F.lit(False)
        renamed = ~F.col("name").eqNullSafe(F.col("__old")) & F.col("name").isNotNull()
        parents = F.try_variant_get(F.element_at("__m", F.lit("parents")), "$", "array<string>")
        new = parents
        for names, gone in steps:
            new = _changed_parents(new, names, gone)
        moved = F.coalesce(F.size(parents) > 0, F.lit(False)) if steps else F.lit(False)
        values = [F.when(touched & F.col("__a").isNotNull(), F.to_variant_object("__a")).otherwise(void), F.when(renamed, F.parse_json(_json_text(F.col("name")))).otherwise(void), F.when(moved, F.parse_json(F.to_json(new))).otherwise(void)]
        update = F.map_filter(F.map_from_arrays(F.array(F.lit("attrs"), F.lit("name"), F.lit("parents")), F.array(*values)), lambda k, v: v.isNotNull())
        whole = F.map_concat(F.map_filter("__m", lambda k, v: ~F.map_contains_key(F.col("__u"), k)), F.col("__u"))
        f = f.withColumn("__u", update).withColumn("data", F.when(touched | renamed | moved, jsonfn.as_json(whole)).otherwise(F.col("data")))
    f = f.select(FEATURE_COLUMNS)
    for r in lens.rules:
        if r.join is not None:
            f = join_rule(f, r.join)
    return f


def trace_lens(features: DataFrame, lens: Lens) -> DataFrame:
    """(rule_index, matched, action, is_sql): how many features each rule took first."""
    spark = features.sparkSession
    index = [i for i, r in enumerate(lens.rules) if r.match is not None and r.join is None and r.sql is None]
    rows = [(i, "sql" if r.sql else "join" if r.join else "drop" if r.replace is None else "replace", r.sql is not None) for i, r in enumerate(lens.rules)]
    counts = features.select(matched_rule(lens).alias("n")).where("n is not null").groupBy("n").count()
    at = F.create_map(*[x for n, i in enumerate(index) for x in (F.lit(n), F.lit(i))]) if index else F.create_map(F.lit(-1), F.lit(-1))
    counts = counts.select(F.element_at(at, F.col("n")).alias("rule_index"), F.col("count").alias("matched"))
    return spark.createDataFrame(rows, "rule_index int, action string, is_sql boolean").join(counts, "rule_index", "left").select("rule_index", F.coalesce("matched", F.lit(0)).alias("matched"), "action", "is_sql")


def _transform(x: Column, transform: dict | None) -> Column:
    for op in (transform or {}).get("ops", []):
        kind = op["op"]
        if kind in ("ltrim", "rtrim", "trim"):
            chars = F.lit(op["chars"])
            x = {"ltrim": F.ltrim, "rtrim": F.rtrim, "trim": F.trim}[kind](x, chars)
        else:
            x = F.concat(F.lit(op["value"]), x) if kind == "prefix" else F.concat(x, F.lit(op["value"]))
    return x


def join_rule(features: DataFrame, rule: dict, docs: DataFrame | None = None) -> DataFrame:
    """Merge features of one range: the first of the primary name with the first of each joined name; ``required`` is an
    inner join, else a left one. The product is appended; facets holding a name of deleteMatched go whole. ``docs`` is
    needed where an attribute comes from the text."""
    key = ["doc_id", "byte_start", "byte_end"]
    first = Window.partitionBy(*key, "name").orderBy("facet_ord", "feat_ord")

    def pick(part: dict, alias: str) -> DataFrame:
        own = features.where(F.col("name") == part["name"]).withColumn("__n", F.row_number().over(first)).where("__n = 1")
        for k, v in (part.get("matchAttrs") or {}).items():
            own = own.where(jsonfn.same_typed(_variant(k), v))
        return own.select(*key, F.col("data").alias(f"__{alias}"), *(["facet_ord"] if alias == "primary" else []))

    made = pick(rule["primary"], "primary")
    for j in rule["joined"]:
        made = made.join(pick(j, j["alias"]), key, "inner" if j.get("required") else "left")
    if docs is not None:
        made = made.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id")

    def source(s: dict) -> Column | None:
        kind = s["from"]
        if kind == "literal":
            return jsonfn.literal(s["value"])
        if kind == "text":
            if docs is None:
                return None
            part = F.decode(F.substring(F.encode("__text", "UTF-8"), F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start")), "UTF-8")
            return _quoted(_transform(part, s.get("transform")))
        column = f"__{s['alias']}" if kind == "joinedAttr" else "__primary"
        parsed = F.try_parse_json(column)
        nested = F.variant_get(parsed, "$.attrs", "map<string,variant>")
        v = F.coalesce(F.element_at(nested, F.lit(s["attr"])), F.element_at(jsonfn.as_map(F.col(column)), F.lit(s["attr"])))
        if not s.get("transform"):
            return v
        return F.when(_kind(v) == "STRING", _quoted(_transform(F.try_variant_get(v, "$", "string"), s["transform"]))).otherwise(v)

    produce = rule["produce"]
    name = source(produce["name"])
    values = {"name": name} | {k: v for k, s in (produce.get("attrs") or {}).items() if (v := source(s)) is not None}
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull())
    product = made.select("doc_id", (F.col("facet_ord") + 1_000_000).alias("facet_ord"), F.lit(0).alias("feat_ord"), "byte_start", "byte_end", F.lit(produce["typeId"]).alias("type_id"), F.try_variant_get(name, "$", "string").alias("name"), jsonfn.as_json(F.map_from_entries(entries)).alias("data"))
    rest = features
    if rule.get("deleteMatched"):
        gone = features.where(F.col("name").isin(*rule["deleteMatched"])).select("doc_id", "facet_ord").distinct()
        rest = features.join(gone, ["doc_id", "facet_ord"], "left_anti")
    return rest.unionByName(product)


def apply_lens_to_docs(docs: DataFrame, features: DataFrame, lens: Lens) -> tuple[DataFrame, DataFrame]:
    """apply_lens, and the text under rules with deleteText goes: ranges are taken from the input and merged first."""
    rules = [r for r in lens.rules if r.delete_text and r.match is not None]
    out = apply_lens(features, lens)
    if not rules:
        return docs, out
    hit = matches(rules[0].match)
    for r in rules[1:]:
        hit |= matches(r.match)
    ranges = features.where(hit & (F.col("byte_start") < F.col("byte_end"))).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("byte_start", "byte_end"))).alias("rs"))
    merged = ranges.select("doc_id", F.expr(
        "aggregate(rs, cast(array() as array<struct<s:int,e:int>>), (acc, r) -> case when size(acc) > 0 and try_element_at(acc, -1).e >= r.byte_start"
        " then concat(slice(acc, 1, greatest(size(acc) - 1, 0)), array(named_struct('s', try_element_at(acc, -1).s, 'e', greatest(try_element_at(acc, -1).e, r.byte_end))))"
        " else concat(acc, array(named_struct('s', r.byte_start, 'e', r.byte_end))) end)").alias("cuts"))  # fmt: skip
    raw = "encode(text, 'UTF-8')"
    kept = f"aggregate(cuts, named_struct('at', 0, 'out', cast('' as binary)), (a, c) -> named_struct('at', c.e, 'out', concat(a.out, substring({raw}, a.at + 1, c.s - a.at))), a -> decode(concat(a.out, substring({raw}, a.at + 1)), 'UTF-8'))"
    d = docs.join(merged, "doc_id", "left").withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.expr(kept))).select(docs.columns)
    gone = lambda c: f"aggregate(cuts, 0, (a, c) -> a + greatest(0, least({c}, c.e) - c.s))"
    f = out.join(merged, "doc_id", "left").withColumn("__s", F.expr(f"byte_start - coalesce({gone('byte_start')}, 0)").cast("int")).withColumn("__e", F.expr(f"byte_end - coalesce({gone('byte_end')}, 0)").cast("int"))
    f = f.where(F.col("cuts").isNull() | (F.col("__s") < F.col("__e")))
    return d, f.select("doc_id", "facet_ord", "feat_ord", F.col("__s").alias("byte_start"), F.col("__e").alias("byte_end"), "type_id", "name", "data")
