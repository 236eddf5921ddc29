"""Deeply nested JSON texts into flat, linked tables.

A bottom-up tree automaton runs over each parsed text: a leaf's state is its type, an array's the
set of its elements' states, an object's the sorted list of its (key, state) pairs. Two objects
have the same shape exactly if they end in the same state, so the state names the structural
variant. Every object that is an array element becomes one row of the supertype table (its owner,
path, parent link and variant), on demand also the text's outermost value.

Each variant is routed to a typed subtype table. Variants of one array path share a table as long
as their fields agree in type where both have them: a field that is absent, null or told as a
whole number beside fractions makes a variant of its own but no table of its own, so the tables
follow the schema, not the number of rows. Fields that can't agree part the tables. Together the
subtype tables hold every value of the texts, and their rows point to each other by parent_path.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from json import decoder, scanner

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import drop_path, ship, stage

LINKS = ["json_column", "parent_path", "child_path", "array_path", "variant"]
SUPERTYPE = "json_column string, parent_path string, child_path string, array_path string, variant string, shape string, body string, fields string"


class _Deep(json.JSONDecoder):
    """The pure-Python scanner, for texts nested deeper than the C one allows."""

    def __init__(self) -> None:
        super().__init__(parse_constant=_reject)
        self.parse_object, self.parse_array, self.memo = decoder.JSONObject, decoder.JSONArray, {}
        self.scan_once = scanner.py_make_scanner(self)


def _reject(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_FAST = json.JSONDecoder(parse_constant=_reject)


def parse(text: str):
    """The value of a JSON text; ValueError if it is none. Any depth."""
    try:
        return _FAST.decode(text)
    except RecursionError:
        sys.setrecursionlimit(1_000_000)  # Python frames only: they live on the heap
        return _Deep().decode(text)


def _inside(value):
    """A string that holds a JSON object or array, as that."""
    if isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "["):
        try:
            return parse(value)
        except ValueError:
            pass
    return value


_LEAF = {type(None): "null", bool: "boolean", float: "double", str: "string"}
_LONG, _EXACT = 2**63, 2**53


def _leaf(x) -> str:
    """A plain value's type; whole numbers are `bigint`, `wide` if a double can't hold them, `integer` beyond 64 bits."""
    if type(x) is int:
        return "bigint" if -_EXACT <= x <= _EXACT else "wide" if -_LONG <= x < _LONG else "integer"
    return _LEAF[type(x)]


class Automaton:
    """The determinised bottom-up automaton; it keeps its transitions, so a shape is named once."""

    def __init__(self, keep: int = 100_000) -> None:
        self.states: dict[str, str] = {}
        self.columns: dict[str, tuple[dict[str, str], str]] = {}
        self.keep = keep

    def state(self, transition: str) -> str:
        s = self.states.get(transition)
        if s is None:
            if len(self.states) >= self.keep:
                self.states.clear()  # a state's name is a digest of its transition: it comes back the same
            s = self.states[transition] = hashlib.blake2b(transition.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        return s

    def rows(self, value, with_body: bool, with_root: bool = False, with_fields: bool = False, taken: frozenset[str] = frozenset()) -> Iterator[tuple]:
        """(parent_path, child_path, array_path, variant, shape, body, fields) of each object in an array, children first; with_root, of the outermost value last."""
        # A frame: value, path, pattern, element?, enclosing object's path, parts so far, iterator over children
        out = []
        top: list = [None]
        value = _inside(value)
        if not isinstance(value, (dict, list)):
            return iter(())
        stack = [(value, "", "", False, "", [], _children(value, "", ""), top, None)]
        while stack:
            v, path, pattern, element, owner, parts, kids, up, key = stack[-1]
            for k, child, cpath, cpattern in kids:
                child = _inside(child)
                if isinstance(child, (dict, list)):
                    e = isinstance(v, list) and isinstance(child, dict)
                    stack.append((child, cpath, cpattern, e, path if element else owner, [], _children(child, cpath, cpattern), parts, k))
                    break
                parts.append((k, _leaf(child)))
            else:
                stack.pop()
                if isinstance(v, list):
                    shape = "[" + ",".join(sorted({p for _, p in parts})) + "]"
                else:
                    shape = "{" + ",".join(f"{json.dumps(k)}:{p}" for k, p in sorted(parts)) + "}"
                s = self.state(shape)
                root = with_root and up is top
                if element or root:
                    body, fields = self._content(v, s, taken, with_body) if with_body or with_fields else (None, None)
                    out.append((None if root else owner, path, pattern, s, shape, body, fields))
                up.append((key, s)) if up is not top else None
        return iter(out)

    def _content(self, v, s: str, taken: frozenset[str], with_body: bool) -> tuple[str | None, str]:
        """The body and its fields: column -> type. The columns are the same for all values of a state."""
        known = self.columns.get(s)
        own = _own(v) if with_body or known is None else {}
        if known is None:
            if len(self.columns) >= self.keep:
                self.columns.clear()
            seen, names = set(taken), {}
            for name in sorted(own):
                column = name.encode("utf-8", "replace").decode()
                while not column or column.lower() in seen:
                    column = f"f_{column}"
                seen.add(column.lower())
                names[name] = column
            known = self.columns[s] = names, json.dumps({c: own[n][0] for n, c in names.items()}, ensure_ascii=False)
        names, fields = known
        return json.dumps({c: own[n][1] for n, c in names.items()}, ensure_ascii=False) if with_body else None, fields


def _own(v) -> dict[str, tuple[str, object]]:
    """name -> (type, value) of all that lies in a value but not in an object with a row of its own.

    Objects that are fields are flattened into dotted names; a dot or backslash in a key has a
    backslash before it. An array is a field of its own (`[]` if it is the outermost value) unless
    objects are all it holds: typed if its elements agree, else as JSON text, in which {} stands
    for an object that has a row.
    """
    out: dict[str, tuple[str, object]] = {}
    if isinstance(v, list):
        _add_array(out, "[]", v)
        return out
    todo = [("", v)]
    while todo:
        at, d = todo.pop()
        for k, x in d.items():
            x = _inside(x)
            name = at + (k.replace("\\", "\\\\").replace(".", "\\.") if "." in k or "\\" in k else k)
            if isinstance(x, dict):
                todo.append((f"{name}.", x))
            elif isinstance(x, list):
                _add_array(out, name, x)
            else:
                kind = _leaf(x)
                out[name] = ("string", str(x)) if kind == "integer" else (kind, x)
    return out


def _add_array(out: dict, name: str, v: list) -> None:
    inner = [_inside(x) for x in v]
    if inner and all(isinstance(x, dict) for x in inner):
        return
    kind = _array_type(inner)
    if kind is None:
        out[name] = "string", _text(v)
    else:
        depth, leaf = kind
        out[name] = "array<" * depth + (leaf or "null") + ">" * depth, _read(inner)


def _array_type(v: list, depth: int = 1) -> tuple[int, str | None] | None:
    """(depth, leaf type) of an array whose elements agree; the leaf type is None if there are only nulls. None if they don't agree."""
    if depth > 8:
        return None
    plain: set[str] = set()
    below: set[tuple[int, str | None]] = set()
    for x in v:
        x = _inside(x)
        if isinstance(x, dict) or type(x) is int and not -_LONG <= x < _LONG:
            return None
        if isinstance(x, list):
            t = _array_type(x, depth + 1)
            if t is None:
                return None
            below.add(t)
        elif x is not None:
            plain.add(_leaf(x))
    if below:
        # An empty array, or one of nulls, agrees with every array that is no less deep.
        deepest = max(d for d, _ in below)
        full = {t for t in below if t[1]}
        if plain or len(full) > 1 or full and next(iter(full))[0] < deepest:
            return None
        return deepest + 1 if not full else next(iter(full))[0] + 1, next(iter(full))[1] if full else None
    if len(plain) > 1:
        joint = _agree(plain)
        return (1, joint) if joint else None
    return 1, plain.pop() if plain else None


def _agree(kinds: set[str]) -> str | None:
    """The type that holds the values of all these plain types exactly, null if there is none."""
    kinds = kinds - {"null"}
    if len(kinds) <= 1:
        return next(iter(kinds), "null")
    return {frozenset(("bigint", "wide")): "wide", frozenset(("bigint", "double")): "double"}.get(frozenset(kinds))


def _read(v: list) -> list:
    return [_read(x) if isinstance(x, list) else x for x in map(_inside, v)]


def _text(v: list) -> str:
    """An array of any depth as JSON; {} stands for each object in it."""
    out: list[str] = []
    stack, first = [iter((v,))], [True]
    while stack:
        for x in stack[-1]:
            x = _inside(x)
            if not first[-1]:
                out.append(", ")
            first[-1] = False
            if isinstance(x, list):
                out.append("[")
                stack.append(iter(x))
                first.append(True)
                break
            out.append("{}" if isinstance(x, dict) else json.dumps(x, ensure_ascii=False))
        else:
            stack.pop()
            first.pop()
            if stack:
                out.append("]")
    return "".join(out)


def _strings(c: list) -> pa.Array:
    try:
        return pa.array(c, pa.string())
    except UnicodeEncodeError:  # half a surrogate pair, written as an escape, can't be stored
        return pa.array([x if x is None else x.encode("utf-8", "replace").decode() for x in c], pa.string())


def _children(v, path: str, pattern: str):
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield None, x, f"{path}[{i}]", f"{pattern}[]"
    else:
        for k, x in v.items():
            yield k, x, f"{path}.{k}" if path else k, f"{pattern}.{k}" if pattern else k


def shred(df: DataFrame, keys: list[str], json_columns: list[str], with_body: bool = False, with_root: bool = False, with_fields: bool = False) -> DataFrame:
    """The supertype table: one row per JSON object that is an array element, at any depth.

    Columns: the keys, then json_column, parent_path ('' at the top), child_path, array_path (the
    child path with every position left open), variant (the automaton's state), shape (its
    transition: own keys with their types or states), body (as JSON, all that lies in the object and
    in no object with a row of its own) and fields (the body's columns with their types; both only
    with_body, fields also with_fields, see `subtype`). with_root adds a row for the outermost object or array of each text:
    its child_path is '', its parent_path null, its body what no array element holds.
    Strings that hold an object or array are read as if written in place. Null, empty and invalid
    texts give no rows; of a key told twice in one object the last counts; an empty table gives
    none. Each input row is treated alone: rows of a key that say the same thing give the same rows.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", " + SUPERTYPE

    taken = frozenset(x.lower() for x in (*keys, *LINKS, "subtype"))
    own_names = [c.split(" ")[0] for c in SUPERTYPE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        for batch in batches:
            own: list[int] = []
            cols: list[list] = [[] for _ in own_names]

            def flush() -> pa.RecordBatch:
                idx = pa.array(own, pa.int32())
                arrays = [batch.column(i).take(idx) for i in range(len(keys))]
                arrays += [_strings(c) for c in cols]
                names = [batch.schema.names[i] for i in range(len(keys))] + own_names
                own.clear()
                done = pa.RecordBatch.from_arrays(arrays, names=names)
                for c in cols:
                    c.clear()
                return done

            for j, name in enumerate(json_columns):
                for i, text in enumerate(batch.column(len(keys) + j).to_pylist()):
                    if not text:
                        continue
                    try:
                        value = parse(text)
                    except ValueError:
                        continue
                    for row in auto.rows(value, with_body, with_root, with_fields, taken):
                        own.append(i)
                        cols[0].append(name)
                        for c, x in zip(cols[1:], row):
                            c.append(x)
                        if len(own) >= 20_000:
                            yield flush()
            if own:
                yield flush()

    ship(df.sparkSession)
    return df.select(*keys, *json_columns).mapInArrow(run, schema)


def variants(objects: DataFrame) -> DataFrame:
    """The catalogue: each (array_path, variant) with its shape and number of objects."""
    return objects.groupBy("json_column", "array_path", "variant").agg(F.min("shape").alias("shape"), F.count(F.lit(1)).alias("n_objects"))


def subtype(objects: DataFrame, keys: list[str], shape: str, variant: str, fields: str | None = None) -> DataFrame:
    """The typed table of one variant: the supertype's keys and links, then a column for each own field.

    `objects` must have been made with_body; without `fields` those of the variant's first row are
    looked up. Objects that are fields are flattened into dotted columns (`a.b`; a dot or backslash
    within a key has a backslash before it). Arrays whose elements agree are array columns; others,
    and arrays of plain values beside objects, are JSON texts in which {} stands for each object.
    Whole numbers beyond 64 bits are texts. Objects in arrays are rows of other subtypes and point
    here by parent_path. A column named like one that is there, in whatever case, gets the prefix `f_`.
    """
    at = objects.where((F.col("variant") == variant) & (F.col("shape") == shape))
    if fields is None:
        row = at.select("fields").first()
        fields = row["fields"] if row else "{}"
    return _typed(at, [*keys, "json_column", "parent_path", "child_path"], fields)


def _typed(at: DataFrame, base: list[str], fields: str) -> DataFrame:
    kinds = json.loads(fields)
    if not kinds:
        return at.select(*base)
    struct = T.StructType([T.StructField(c, _type(t)) for c, t in kinds.items()])
    return at.withColumn("__b", F.from_json("body", struct)).select(*base, *[F.col("__b").getField(c).alias(c) for c in kinds])


def _type(t: str) -> T.DataType:
    if t.startswith("array<"):
        return T.ArrayType(_type(t[6:-1]))
    return {"boolean": T.BooleanType(), "bigint": T.LongType(), "wide": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "null": T.StringType()}[t]


def _parted(kinds: set[str]) -> dict[str, str]:
    """Each of a field's types -> the type of its column; types that can't agree get columns in different tables."""
    plain = {k for k in kinds if not k.startswith("array<")}
    out = {k: k for k in plain}
    for pair in ({"bigint", "wide"}, {"bigint", "double"}):
        # Whole numbers join fractions unless one of them is too wide for that.
        if pair <= plain and (pair == {"bigint", "wide"} or "wide" not in plain):
            out |= {k: _agree(pair) for k in pair}
    shapes = {k: (d, k[6 * d : len(k) - d]) for k in kinds - plain for d in (k.count("array<"),)}
    deep: dict[int, set[str]] = {}
    for d, leaf in shapes.values():
        if leaf != "null":
            deep.setdefault(d, set()).add(leaf)
    for k, (d, leaf) in shapes.items():
        if leaf == "null":  # empty, or nulls only: goes with any array no less deep
            full = sorted((e, x) for e, leaves in deep.items() if e >= d for x in leaves)
            e, x = full[0] if full else (max(e for e, _ in shapes.values()), "null")
        else:
            e, x = d, leaf
        x = _parted(deep[e])[x] if e in deep and x in deep[e] else x
        out[k] = "array<" * e + x + ">" * e
    real = [v for k, v in out.items() if k != "null"]
    if "null" in out and real:
        out["null"] = min(real)
    return out


def routes(objects: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """Where each variant goes: json_column, array_path, variant, subtype; and each subtype's columns with types.

    `objects` must have been made with_body or with_fields. Only the fields' names and types by
    array path are gathered at the driver: they follow the schema of the texts.
    """
    spark = objects.sparkSession
    place = ["json_column", "array_path"]
    states = stage(objects.groupBy(*place, "variant").agg(F.min("fields").alias("fields")).withColumn("f", F.map_entries(F.from_json("fields", "map<string,string>"))), "states")
    told = states.select(*place, F.explode_outer("f").alias("e")).select(*place, F.col("e.key").alias("name"), F.col("e.value").alias("kind")).distinct().collect()
    kinds: dict[tuple, dict[str, dict[str, set[str]]]] = {}
    for r in told:
        names = kinds.setdefault((r.json_column, r.array_path), {})
        if r.name is not None:
            names.setdefault(r.name.lower(), {}).setdefault(r.name, set()).add(r.kind)
    classes, columns = [], {}
    for (c, path), names in kinds.items():
        for spelt in names.values():
            parts = {name: _parted(k) for name, k in spelt.items()}
            apart = len({(name, t) for name, p in parts.items() for t in p.values()}) > 1
            classes += [(c, path, name, k, t, apart) for name, p in parts.items() for k, t in p.items()]
    known = spark.createDataFrame(classes, "json_column string, array_path string, name string, kind string, type string, apart boolean")
    each = states.select(*place, "variant", F.explode_outer("f").alias("e")).select(*place, "variant", F.col("e.key").alias("name"), F.col("e.value").alias("kind")).join(known, [*place, "name", "kind"], "left")
    mark = F.concat_ws("\x00", "json_column", "array_path", F.array_join(F.array_sort(F.collect_list(F.when(F.col("apart"), F.concat_ws("\x01", "name", "type")))), "\x02"))
    routed = each.groupBy(*place, "variant").agg(F.concat(F.lit("t"), F.substring(F.sha2(mark, 256), 1, 16)).alias("subtype"))
    routed = stage(routed, "routes")
    for r in each.join(routed, [*place, "variant"]).select("subtype", "name", "type").distinct().collect():
        own = columns.setdefault(r.subtype, {})
        if r.name is not None:
            own[r.name] = r.type
    return routed, {t: dict(sorted(own.items())) for t, own in sorted(columns.items())}


def routed(objects: DataFrame, where: DataFrame) -> DataFrame:
    """The supertype rows with the subtype that their variant is routed to."""
    return objects.join(where, ["json_column", "array_path", "variant"])


def write_subtypes(objects: DataFrame, path: str) -> dict[str, str]:
    """Write the typed tables below path, each to its folder `subtype=...`; gives each one's fields. What was at path goes.

    The column `variant` keeps a row's shape. A write has one schema, so tables whose columns don't
    clash in type or case are written together, at most 400 columns at a time, and each file also
    has the empty columns of its fellows: `read_subtype` gives a table's own.
    """
    spark = objects.sparkSession
    base = [*objects.columns[: objects.columns.index("json_column")], *LINKS]
    objects = stage(objects, "objects")  # parsed once
    where, columns = routes(objects)
    known = {t: json.dumps(own, ensure_ascii=False) for t, own in columns.items()}
    rows = routed(objects, where)
    drop_path(spark, path)
    groups = _fellows(known)
    for columns, tables in groups:
        part = (rows if len(groups) == 1 else rows.where(F.col("subtype").isin(tables))).hint("rebalance", "subtype")
        _typed(part, [*base, "subtype"], json.dumps(columns)).write.mode("append").partitionBy("subtype").parquet(path)
    return known


def _fellows(known: dict[str, str], most: int = 400) -> list[tuple[dict[str, str], list[str]]]:
    """Tables in groups: (columns with types, tables); within a group a column has one type and one spelling."""
    groups: list[tuple[dict[str, str], dict[str, str], list[str]]] = []
    for t, fields in known.items():
        own = json.loads(fields)
        for columns, spelt, tables in groups:
            if all(spelt.get(c.lower(), c) == c and columns.get(c, k) == k for c, k in own.items()) and len(columns.keys() | own.keys()) <= most:
                break
        else:
            columns, spelt, tables = {}, {}, []
            groups.append((columns, spelt, tables))
        columns.update(own)
        spelt.update({c.lower(): c for c in own})
        tables.append(t)
    return [(columns, tables) for columns, _, tables in groups]


def read_subtype(spark: SparkSession, path: str, name: str, fields: str) -> DataFrame:
    """One of the tables of `write_subtypes`: keys, links and its own fields."""
    t = spark.read.parquet(f"{path}/subtype={name}")
    n = t.columns.index(LINKS[-1]) + 1
    return t.select(*[F.col(_quoted(c)) for c in [*t.columns[:n], *json.loads(fields)]])


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"
