"""SELECT, INSERT, UPDATE and DELETE over ``features``, run one after another as DataFrame steps.

Files behind a view can't be updated in place, so UPDATE is a projection with CASE, DELETE a filter and INSERT a union.
Only the shell of a statement is parsed here; expressions go to Spark's parser, with the functions of
``register_functions``. A SELECT leaves the features as they are and is returned beside them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfn
from ..sources.document import FEATURE_COLUMNS

WRITABLE = ("byte_start", "byte_end", "type_id", "name", "data")


class StatementError(ValueError):
    pass


def split_outside(text: str, separator: str) -> list[str]:
    """Split at a separator outside quotes and brackets."""
    parts, depth, quote, last, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and text.startswith(separator, i):
            parts.append(text[last:i])
            last = i + len(separator)
        i += 1
    return [*parts, text[last:]]


def _word_outside(text: str, word: str) -> int:
    """Place of a key word outside quotes and brackets, -1 if there is none."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif depth == 0 and re.match(rf"\b{word}\b", text[i:], re.I) and (i == 0 or not text[i - 1].isalnum()):
            return i
    return -1


_QUOTED = re.compile(r"""('(?:\\.|''|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`)""")


def replace_outside(text: str, pattern: str, new: str) -> str:
    """Replace a pattern outside quotes."""
    return "".join(part if i % 2 else re.sub(pattern, new, part, flags=re.I) for i, part in enumerate(_QUOTED.split(text)))


def _json_objects(text: str) -> str:
    """json_object(key, value, ...) in Spark's functions."""
    while True:
        plain = "".join(" " * len(part) if i % 2 else part for i, part in enumerate(_QUOTED.split(text)))
        found = list(re.finditer(r"\bjson_object\s*\(", plain, re.I))
        if not found:
            return text
        start, depth, end = found[-1], 1, found[-1].end()  # the last holds no other
        while depth and end < len(plain):
            depth += {"(": 1, ")": -1}.get(plain[end], 0)
            end += 1
        inner = text[start.end() : end - 1].strip()
        made = f"to_json(named_struct({inner}), map('ignoreNullFields', 'false'))" if inner else "'{}'"
        text = text[: start.start()] + made + text[end:]


def _sync_name(f: DataFrame, changed_name: bool, changed_data: bool) -> DataFrame:
    """``name`` is what counts on write: data.name follows it; where only data was written, name follows data."""
    if changed_name:
        quoted = F.parse_json(F.regexp_extract(F.to_json(F.struct(F.col("name").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
        m = jsonfn.as_map(F.col("data"))
        differs = ~F.get_json_object("data", "$.name").eqNullSafe(F.col("name"))
        data = F.when(differs & F.col("name").isNotNull(), jsonfn.as_json(jsonfn.with_values(m, {"name": quoted}))).when(differs, jsonfn.as_json(jsonfn.without_keys(m, ["name"]))).otherwise(F.col("data"))
        return f.withColumn("data", data)
    return f.withColumn("name", F.get_json_object("data", "$.name")) if changed_data else f


def _with_text(f: DataFrame, docs: DataFrame | None) -> DataFrame:
    return f if docs is None else f.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id", "left")


def apply_facet_sql(features: DataFrame, sql: str, docs: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(features after all statements, results of SELECTs). In expressions ``doc_text`` is the text, where ``docs`` is
    given, and ``text_at(byte_start, byte_end)`` a part of it."""
    spark, selects = features.sparkSession, []
    register_functions(spark)
    for statement in (s.strip() for s in split_outside(sql, ";")):
        if not statement:
            continue
        body = _json_objects(replace_outside(statement, r"\btext_at\s*\(", "text_at(doc_text, ") if docs is not None else statement)
        head = body.split(None, 1)[0].upper()
        if head == "SELECT":
            selects.append(_select(spark, _with_text(features, docs), body))
        elif head == "DELETE":
            m = re.match(r"DELETE\s+FROM\s+features\b\s*(?:WHERE\s+(.*))?$", body, re.I | re.S)
            if not m:
                raise StatementError(statement)
            features = _with_text(features, docs).where(~F.coalesce(F.expr(m[1]), F.lit(False)) if m[1] else F.lit(False)).select(FEATURE_COLUMNS)
        elif head == "UPDATE":
            features = _update(_with_text(features, docs), body, statement)
        elif head == "INSERT":
            features = _insert(spark, features, _with_text(features, docs), body, statement)
        else:
            raise StatementError(statement)
    return features, selects


def _select(spark: SparkSession, f: DataFrame, body: str) -> DataFrame:
    """The query over a view of its own name, which is analysed at once, so the view can go."""
    view = "features_" + uuid.uuid4().hex
    f.createOrReplaceTempView(view)
    try:
        return spark.sql(replace_outside(body, r"\bfeatures\b", view))
    finally:
        spark.catalog.dropTempView(view)


def _update(f: DataFrame, body: str, statement: str) -> DataFrame:
    m = re.match(r"UPDATE\s+features\s+SET\s+", body, re.I)
    if not m:
        raise StatementError(statement)
    rest = body[m.end() :]
    at = _word_outside(rest, "WHERE")
    sets, cond = (rest, F.lit(True)) if at < 0 else (rest[:at], F.coalesce(F.expr(rest[at + 5 :]), F.lit(False)))
    new = {}
    for part in split_outside(sets, ","):
        column, _, value = part.partition("=")
        column = column.strip().lower()
        if column not in WRITABLE:
            raise StatementError(f"column {column} can't be set")
        new[column] = F.when(cond, F.expr(value)).otherwise(F.col(column))
    out = f.select(*[new[c].cast(f.schema[c].dataType).alias(c) if c in new else F.col(c) for c in FEATURE_COLUMNS])
    return _sync_name(out, "name" in new, "data" in new)


def _insert(spark: SparkSession, features: DataFrame, f: DataFrame, body: str, statement: str) -> DataFrame:
    m = re.match(r"INSERT\s+INTO\s+features\s*\(([^)]*)\)\s*(VALUES|SELECT)\b", body, re.I)
    if not m:
        raise StatementError(statement)
    columns = [c.strip().lower() for c in m[1].split(",")]
    if m[2].upper() == "SELECT":
        rows = _select(spark, f, body[m.start(2) :]).toDF(*columns)
        if "doc_id" not in columns:
            raise StatementError("INSERT ... SELECT over a corpus names doc_id")
    else:
        tuples = [split_outside(t.strip()[1:-1], ",") for t in split_outside(body[m.end() :], ",")]
        ids = features.select("doc_id").distinct()
        made = F.array(*[F.struct(*[F.expr(v).cast(features.schema[c].dataType).alias(c) for c, v in zip(columns, t, strict=True)]) for t in tuples])
        rows = (spark.range(1) if "doc_id" in columns else ids).select(*([] if "doc_id" in columns else ["doc_id"]), F.explode(made).alias("r"))
        rows = rows.select(*([] if "doc_id" in columns else ["doc_id"]), "r.*")
    missing = {c: F.lit(None).cast(features.schema[c].dataType) for c in FEATURE_COLUMNS if c not in rows.columns}
    rows = rows.withColumns(missing).withColumn("facet_ord", F.coalesce("facet_ord", F.lit(1_000_000))).withColumn("feat_ord", F.coalesce("feat_ord", F.lit(0)))
    rows = rows.withColumn("data", F.coalesce("data", F.lit("{}")))
    rows = rows.select(*[F.col(c).cast(features.schema[c].dataType).alias(c) for c in FEATURE_COLUMNS])
    return features.unionByName(_sync_name(rows, "name" in columns, "name" not in columns))


def validate_sql(spark: SparkSession, sql: str) -> list[str]:
    """Problems of a text of statements, by parsing and analysis over an empty features table."""
    from ..sources.document import FEATURES

    problems = []
    for s in split_outside(sql, ";"):
        if s.strip():
            try:
                apply_facet_sql(spark.createDataFrame([], FEATURES), s)
            except Exception as e:  # noqa: BLE001  whatever the parser or analyzer says is the answer
                problems.append(str(e).split("\n")[0])
    return problems


def register_functions(spark: SparkSession) -> None:
    """SQL functions over JSON documents and features. All are expressions: nothing runs in Python."""
    make = lambda name, args, returns, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    wire = "from_json(doc, 'text string, facets array<struct<index:struct<byteStart:int,byteEnd:int>,features:array<string>>>', map('mode', 'FAILFAST'))"
    make("text_at", "t STRING, s INT, e INT", "STRING", "decode(substring(encode(t, 'UTF-8'), s + 1, greatest(e - s, 0)), 'UTF-8')")
    make("json_get", "data STRING, k STRING", "STRING", "get_json_object(data, concat('$.', k))")
    make("class_contains", "data STRING, cls STRING", "BOOLEAN", "coalesce(array_contains(coalesce(try_cast(from_json(get_json_object(data, '$.class'), 'array<string>') as array<string>), split(get_json_object(data, '$.class'), '\\\\s+')), cls), false)")
    make("strip_version", "t STRING", "STRING", "regexp_replace(t, '@[^@]*$', '')")
    make("json_array_contains", "data STRING, k STRING, v STRING", "BOOLEAN", "coalesce(array_contains(from_json(get_json_object(data, concat('$.', k)), 'array<string>'), v), false)")
    make("json_set_json", "data STRING, k STRING, v STRING", "STRING", "to_json(to_variant_object(map_concat(map_filter(cast(parse_json(data) as map<string,variant>), (a, b) -> a <> k), map(k, parse_json(v)))))")
    make("rt_text", "doc STRING", "STRING", f"{wire}.text")
    make("rt_char_length", "doc STRING", "INT", f"char_length({wire}.text)")
    make("rt_feature_count", "doc STRING", "INT", f"coalesce(aggregate({wire}.facets, 0, (n, f) -> n + size(f.features)), 0)")
    test = "get_json_object(x, '$.$type')"
    make("rt_has_mark", "doc STRING, type_id STRING, name STRING DEFAULT NULL", "INT", f"int(coalesce(exists(flatten(transform({wire}.facets, f -> f.features)), x -> ({test} = type_id and (name is null or get_json_object(x, '$.name') = name)) or (name is null and instr(type_id, '#') > 0 and concat({test}, '#', get_json_object(x, '$.name')) = type_id)), false))")
    make("rt_version", "", "STRING", "'0.1.0'")
    printed = lambda text, facets: f"""concat('{{"text":', regexp_extract(to_json(named_struct('v', {text})), '(?s)^\\\\{{"v":(.*)\\\\}}$', 1), if({facets} is null, '', concat(',"facets":[', array_join(transform({facets}, f -> concat('{{"index":{{"byteStart":', f.index.byteStart, ',"byteEnd":', f.index.byteEnd, '}},"features":[', array_join(f.features, ','), ']}}')), ','), ']')), '}}')"""
    facet = lambda s, e, features: f"named_struct('index', named_struct('byteStart', int({s}), 'byteEnd', int({e})), 'features', {features})"
    flag = lambda k: f"exists(f.features, x -> coalesce(boolean(get_json_object(x, '$.{k}')), false) and get_json_object(x, '$.parents') is null)"
    parsed = lambda body: f"element_at(transform(array({wire}), w -> {body}), 1)"  # noqa: E731  the document is parsed once, whatever body takes of it
    raw, s, e = "encode(w.text, 'UTF-8')", "f.index.byteStart", "f.index.byteEnd"
    cut = lambda at: f"hex(substring({raw}, {at} + 1, 1)) rlike '^[89AB]'"
    shift = f"(pos < {s} or (pos = {s} and not {flag('expandStart')}))"
    grow = f"(pos < {e} or (pos = {e} and {flag('expandEnd')}))"
    n = "octet_length(ins)"
    moved = f"transform(w.facets, f -> {facet(f'{s} + if({shift}, {n}, 0)', f'{e} + if({shift} or {grow}, {n}, 0)', 'f.features')})"
    spliced = f"decode(concat(substring({raw}, 1, pos), encode(ins, 'UTF-8'), substring({raw}, pos + 1)), 'UTF-8')"
    inserted = f"if(pos < 0 or pos > octet_length(w.text) or {cut('pos')}, raise_error('insert position out of range or within a character'), {printed(spliced, moved)})"
    make("rt_insert_text", "doc STRING, pos INT, ins STRING", "STRING", parsed(inserted))
    place = lambda x: f"case when {x} <= lo then {x} when {x} >= hi then {x} - (hi - lo) else lo end"
    clipped = f"filter(transform(w.facets, f -> {facet(place(s), place(e), 'f.features')}), f -> f.index.byteStart < f.index.byteEnd)"
    rest = f"decode(concat(substring({raw}, 1, lo), substring({raw}, hi + 1)), 'UTF-8')"
    deleted = f"case when not (lo >= 0 and lo < hi and hi <= octet_length(w.text)) then doc when {cut('lo')} or {cut('hi')} then raise_error('delete range cuts a character') else {printed(rest, clipped)} end"
    make("rt_delete_text", "doc STRING, lo INT, hi INT", "STRING", parsed(deleted))
    named = f"{test} = type_key or concat({test}, '#', get_json_object(x, '$.name')) = type_key"
    kept = f"filter(transform(w.facets, f -> if({s} = lo and {e} = hi, {facet(s, e, f'filter(f.features, x -> not coalesce({named}, false))')}, {facet(s, e, 'f.features')})), f -> size(f.features) > 0)"
    make("rt_remove_mark", "doc STRING, lo INT, hi INT, type_key STRING", "STRING", parsed(printed("w.text", kept)))
    raw = f"encode({wire}.text, 'UTF-8')"
    # one generator over an expression: with two the planner would join the rows back on the whole document
    each = f"flatten(transform({wire}.facets, f -> transform(f.features, j -> named_struct('s', f.index.byteStart, 'e', f.index.byteEnd, 'j', j))))"
    rows = f"SELECT x.s AS byte_start, x.e AS byte_end, get_json_object(x.j, '$.$type') AS type_id, get_json_object(x.j, '$.name') AS name, to_json(to_variant_object(map_filter(cast(parse_json(x.j) as map<string,variant>), (k, v) -> k <> '$type'))) AS data FROM (SELECT explode({each}) AS x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rt_facets(doc STRING) RETURNS TABLE(byte_start INT, byte_end INT, type_id STRING, name STRING, data STRING) RETURN {rows}")
    marks = f"array_sort(flatten(transform({wire}.facets, (f, i) -> transform(filter(f.features, x -> get_json_object(x, '$.parents') is not null), (x, j) -> named_struct('s', f.index.byteStart, 'i', i, 'j', j, 'e', f.index.byteEnd, 'x', x)))))"
    rows = f"""SELECT i AS block_index, coalesce(get_json_object(b.x, '$.name'), '') AS name, coalesce(get_json_object(b.x, '$.attrs'), '{{}}') AS attrs, get_json_object(b.x, '$.parents') AS parents,
      decode(substring(raw, b.e + 1, greatest(0, least(coalesce(try_element_at(marks, i + 2).s, octet_length(raw)), octet_length(raw)) - b.e)), 'UTF-8') AS text
      FROM (SELECT {marks} AS marks, {raw} AS raw) LATERAL VIEW posexplode(marks) t AS i, b"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rt_blocks(doc STRING) RETURNS TABLE(block_index INT, name STRING, attrs STRING, parents STRING, text STRING) RETURN {rows}")
    spark.udf.register("rt_apply_lens", _apply_lens_udf())


def _apply_lens_udf() -> object:
    """rt_apply_lens(doc, lens JSON): the lens may differ from row to row, so this one runs in Python, in Arrow batches.
    For one lens over a table, lens.apply_lens is an expression."""
    import pandas as pd

    def rt_apply_lens(doc: pd.Series, spec: pd.Series) -> pd.Series:
        from ..lens.interpret import apply_to_json
        from ..lens.spec import Lens

        lenses: dict[str, Lens] = {}
        out = []
        for d, x in zip(doc, spec, strict=True):
            if d is None or x is None:
                out.append(None)
                continue
            if x not in lenses:
                lenses[x] = Lens.from_json(x)
            out.append(apply_to_json(d, lenses[x]))
        return pd.Series(out, dtype=object)

    rt_apply_lens.__annotations__ = {"doc": pd.Series, "spec": pd.Series, "return": pd.Series}
    return F.pandas_udf(rt_apply_lens, "string")
