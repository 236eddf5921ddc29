import json

import pytest

from tagloom.operators import nested

SCHEMA = "thread_id string, a string, b string, parent_path string"


def paths(spark, *texts):
    df = spark.createDataFrame([("t", x, None, "clash") for x in texts], SCHEMA)
    return {(r.parent_path, r.child_path) for r in nested.shred(df.withColumnRenamed("parent_path", "extra"), ["thread_id"], ["a", "b"]).collect()}


def brute(text):
    """Straight recursion over the definition."""
    out = set()

    def inside(v):
        if isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            return w if isinstance(w, (dict, list)) else v
        return v

    def walk(v, path, owner):
        v = inside(v)
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, owner)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                x, p = inside(x), f"{path}[{i}]"
                if isinstance(x, dict):
                    out.add((owner, p))
                    walk(x, p, p)
                else:
                    walk(x, p, owner)

    try:
        v = json.loads(text)
    except ValueError:
        return out
    walk(v, "", "")
    return out


@pytest.mark.parametrize(
    "text",
    [
        '{"a": {"b": [1, null, {"c": [{"d": 1}]}]}}',
        '{"t": [[1, {"q": {"r": [{"s": 1}]}}], [[{"u": 2}]]]}',
        json.dumps(json.dumps({"x": [{"y": 1}]})),
        json.dumps({"x": json.dumps([{"y": json.dumps({"z": [{"w": []}]})}])}),
        '[{"a": [{"b": 1}]}, "x", {"c": "{not json"}]',
        '{"a": [], "b": {}, "c": null}',
        "  [1, 2, {}]  ",
        '{"dup": [{"a": 1}], "dup": [{"a": 1}, {"b": 2}]}',
    ],
)
def test_paths_equal_plain_recursion(spark, text):
    assert paths(spark, text) == brute(text)


@pytest.mark.parametrize("text", [None, "", "   ", "{'a': [1]}", '{"a": [{"b": 1}', "NaN", '{"a": [{"b": NaN}]}', '"just text"', "17", "null"])
def test_no_rows(spark, text):
    assert paths(spark, text) == set()


def test_very_deep_and_long(spark):
    deep = "[" * 3000 + '{"a": 1}' + "]" * 3000
    long = json.dumps({"a": [{"n": i} for i in range(30_000)]})
    got = paths(spark, deep, long)
    assert ("", "[0]" * 3000) in got and len(got) == 30_001


def test_equal_shapes_share_a_state_and_types_come_back(spark):
    df = spark.createDataFrame([("t", '{"e": [{"tag": "A", "conf": 0.5, "parent_path": 1}, {"conf": 0.25, "tag": "B", "parent_path": 2}, {"tag": null}, {"tag": "C", "kids": [{"k": 1}]}]}', None, "")], SCHEMA)
    o = nested.shred(df.drop("parent_path"), ["thread_id"], ["a"], with_body=True).cache()
    v = {r["shape"]: r for r in nested.variants(o).collect()}
    two = next(r for s, r in v.items() if r["n_objects"] == 2)
    rows = nested.subtype(o, ["thread_id"], two["shape"], two["variant"]).orderBy("child_path").collect()
    assert [(r.tag, r.conf, r.f_parent_path, r.parent_path) for r in rows] == [("A", 0.5, 1, ""), ("B", 0.25, 2, "")]
    kid = next(r for s, r in v.items() if '"kids"' in s)
    assert [r.tag for r in nested.subtype(o, ["thread_id"], kid["shape"], kid["variant"]).collect()] == ["C"]
    assert o.where("parent_path = 'e[3]'").select("child_path").first()[0] == "e[3].kids[0]"


def test_half_surrogates_and_empty_table(spark):
    assert len(paths(spark, '{"a": [{"\\ud800": 1}, {"b": "\\ud800"}], "\\udfff": [{"c": 1}]}')) == 3
    assert paths(spark) == set()


def test_subtypes_are_routed(spark, tmp_path):
    df = spark.createDataFrame([("t", '{"e": [{"x": 1}, {"x": "s"}]}', None, "")], SCHEMA).drop("parent_path")
    o = nested.shred(df, ["thread_id"], ["a"], with_body=True)
    nested.write_subtypes(o, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).select("variant").distinct().count() == 2


def test_optional_and_null_fields_fold_into_one_table(spark, tmp_path):
    """The number of tables follows the schema: what is absent, null or whole among fractions makes variants, not tables."""
    def tables(texts, at):
        df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "thread_id string, a string")
        return nested.write_subtypes(nested.shred(df, ["thread_id"], ["a"], with_body=True), str(tmp_path / at))

    import itertools

    objects = [{k: v for k, v in zip("abcd", vs) if v != "absent"} for vs in itertools.product([1, None, "absent"], [0.5, 2, "absent"], [[], [1], [None]], ["x", None])]
    few, many = tables([json.dumps({"e": objects[:9]})], "few"), tables([json.dumps({"e": [o]}) for o in objects], "many")
    assert len(few) == len(many) == 1
    (name, fields), *_ = many.items()
    assert json.loads(fields) == {"a": "bigint", "b": "double", "c": "array<bigint>", "d": "string"}
    t = nested.read_subtype(spark, str(tmp_path / "many"), name, fields)
    assert t.count() == len(objects) and t.select("variant").distinct().count() > 9
    assert sorted(str((r.a, r.b, r.c, r.d)) for r in t.collect()) == sorted(str((o.get("a"), None if o.get("b") is None else float(o["b"]), o["c"], o["d"])) for o in objects)
    apart = tables(['{"e": [{"x": 1, "y": 1}, {"x": "s"}, {"X": 1}, {"y": null}, {"x": 9007199254740993}, {"x": 0.5}]}'], "apart")
    assert len(apart) == 5  # by x as a whole number, a text, a fraction, by X, and without it


@pytest.mark.parametrize(
    "kinds,want",
    [
        ({"null"}, {"null": "null"}),
        ({"null", "bigint", "double"}, {"null": "double", "bigint": "double", "double": "double"}),
        ({"bigint", "wide", "double"}, {"bigint": "wide", "wide": "wide", "double": "double"}),
        ({"array<null>", "array<array<double>>", "array<array<bigint>>"}, {"array<null>": "array<array<double>>", "array<array<double>>": "array<array<double>>", "array<array<bigint>>": "array<array<double>>"}),
        ({"array<array<null>>", "array<string>"}, {"array<array<null>>": "array<array<null>>", "array<string>": "array<string>"}),
    ],
)
def test_types_of_a_field(kinds, want):
    assert nested._parted(kinds) == want


def leaves(v, path=""):
    """(path, value) of every plain value and every array without elements."""
    if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        try:
            return leaves(json.loads(v), path)
        except ValueError:
            pass
    if isinstance(v, dict):
        return {x for k, w in v.items() for x in leaves(w, f"{path}.{k}" if path else k)}
    if isinstance(v, list):
        return {x for i, w in enumerate(v) for x in leaves(w, f"{path}[{i}]")} if v else {(path, "[]")}
    return {(path, json.dumps(v))}


@pytest.mark.parametrize(
    "text",
    [
        '{"run": 7, "meta": {"who": "x", "at": {"h": 1.5, "ok": true}}, "e": [{"tag": "A", "box": {"x": 1, "y": {"z": null}}, "n": [1, 2], "m": [[0.5, 1], []]}]}',
        '{"e": [1, {"a": 1, "A": 2, "thread_id": 3}, null, [2, {"q": "s"}]], "none": [], "mix": [1, "b", null], "big": 123456789012345678901234567890, "wide": [0.5, 9007199254740993]}',
        '[{"a": {"b": 1}}, 5, "x"]',
        json.dumps({"cfg": json.dumps({"deep": {"v": [1.5, 2]}, "l": [{"k": json.dumps([1, 2])}]}), "variant": "v", "": 4, "nulls": [None, None]}),
    ],
)
def test_subtypes_hold_every_value(spark, tmp_path, text):
    df = spark.createDataFrame([("t", text)], "thread_id string, a string")
    o = nested.shred(df, ["thread_id"], ["a"], with_body=True, with_root=True)
    got = set()
    for name, fields in nested.write_subtypes(o, str(tmp_path / "o")).items():
        t = nested.read_subtype(spark, str(tmp_path / "o"), name, fields)
        assert set(json.loads(fields)) == set(t.columns) - {"thread_id", "json_column", "parent_path", "child_path", "array_path", "variant"}
        for r in t.collect():
            for c, kind in json.loads(fields).items():
                name = c
                while name.startswith("f_"):
                    name = name[2:]
                at = f"{r.child_path}{name if name[:2] == '[]' else '.' + name if r.child_path else name}".replace("[]", "") if name != "" else (r.child_path or "")
                v = r[c]
                if name == "big":
                    v = int(v)
                got |= {(p.replace("\\.", "."), x) for p, x in leaves(v, at)}
    # What the tables write as doubles beside fractions; {} in a mixed array is an object with a row.
    norm = lambda s: {(p, x if x in ("[]", "null", "true", "false") or x[0] == '"' or "." in x else f"{int(x)}") for p, x in s}
    want = {(p, json.loads(x)) if x != "[]" else (p, x) for p, x in norm(leaves(json.loads(text)))}
    assert want == {(p, json.loads(x)) if x != "[]" else (p, x) for p, x in norm(got)}


def test_dotted_keys_and_nested_fields_are_two_columns(spark):
    df = spark.createDataFrame([("t", '{"e": [{"a.b": 1, "a": {"b": 2}}]}')], "thread_id string, a string")
    o = nested.shred(df, ["thread_id"], ["a"], with_body=True).cache()
    r = o.first()
    row = nested.subtype(o, ["thread_id"], r["shape"], r["variant"]).first().asDict()
    assert (row["a\\.b"], row["a.b"]) == (1, 2)


def test_subtypes_over_all_threads(spark, data):
    from tagloom.plans import problems

    rows = problems.p1_subtypes(spark, data).collect()
    objects = problems.table(spark, data, "threads").select("thread_id", "ingested_at", "config_json", "result_json").distinct()
    n = nested.shred(objects, ["thread_id"], ["config_json", "result_json"], with_root=True).count()
    assert sum(r.n_objects for r in rows) == n and any(r.array_path == "" and len(json.loads(r.fields)) for r in rows)
