"""The queries on nested records, dangling references, hierarchies and quantities, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.tags import tag_key, tag_key_sql
from tagloom.operators import hierarchy, nested, references, units
from tagloom.session import stage, stage_path, table


def p1_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shred(table(spark, sf_dir, "threads"), ["thread_id"], ["config_json", "result_json"], with_fields=True)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per JSON object that is an array element anywhere in a thread's two JSON texts: the rows that are routed to a typed subtype table, by their common keys and parent link."""
    objects = stage(p1_objects(spark, sf_dir), "objects")
    where, _ = nested.routes(objects)
    return nested.routed(objects, where).select("thread_id", "json_column", "parent_path", "child_path").distinct()


def p1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural variants: array path, state of the tree automaton, shape, number of objects over all rows."""
    return nested.variants(p1_objects(spark, sf_dir))


def _typed_tables(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    """The folder of the typed subtype tables of all threads, outermost objects included, and their fields.

    A thread's states are told apart by ingested_at; a row told twice counts once.
    """
    told = table(spark, sf_dir, "threads").select("thread_id", "ingested_at", "config_json", "result_json").distinct()
    path = stage_path(spark, "typed")
    return path, nested.write_subtypes(nested.shred(told, ["thread_id", "ingested_at"], ["config_json", "result_json"], with_body=True, with_root=True), path)


def p1_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed subtype tables over all threads: their fields, rows and the variants routed to each."""
    path, fields = _typed_tables(spark, sf_dir)
    named = spark.createDataFrame(list(fields.items()), "subtype string, fields string")
    tables = spark.read.schema("json_column string, array_path string, variant string, subtype string").parquet(path)
    counts = tables.groupBy("json_column", "array_path", "subtype").agg(F.count(F.lit(1)).alias("n_objects"), F.count_distinct("variant").alias("n_variants"))
    return counts.join(named, "subtype").select("json_column", "array_path", "subtype", "fields", "n_objects", "n_variants")


def p1_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects below each object, over all typed tables: every row finds the row that encloses it by the parent link."""
    path, _ = _typed_tables(spark, sf_dir)
    rows = spark.read.schema("thread_id string, json_column string, parent_path string, child_path string").parquet(path).distinct()
    kids = rows.where("parent_path is not null")
    above = rows.select("thread_id", "json_column", F.col("child_path").alias("parent_path")).distinct()
    return kids.join(above, ["thread_id", "json_column", "parent_path"]).groupBy("thread_id", "json_column", "parent_path").agg(F.count(F.lit(1)).alias("n_children"))


def _key(c: str) -> Column:
    """Never null, so that joins needn't work the key out twice to leave nulls out; '' is no tag that holds a digit."""
    return F.coalesce(tag_key(c), F.lit(""))


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tagged row in the target space of line ends (`node`), lines also in that of valves (`line`)."""
    cols = ["drawing_id", _key("tag").alias("key"), F.col("ingested_at").alias("valid_from"), F.col("deleted_at").alias("valid_to")]
    eq, li, va = (table(spark, sf_dir, t).select(*cols) for t in ("equipment_items", "line_items", "valve_items"))
    both = li.withColumn("space", F.explode(F.array(F.lit("node"), F.lit("line"))))
    return eq.withColumn("space", F.lit("node")).unionByName(va.withColumn("space", F.lit("node"))).unionByName(both)


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["item_id", "drawing_id", F.col("ingested_at").alias("at"), F.date_format("extracted_at", "yyyy-MM").alias("period")]
    li = table(spark, sf_dir, "line_items").select(*base, F.explode(F.array(F.struct(F.lit("from_node").alias("ref_field"), F.col("from_node").alias("text")), F.struct(F.lit("to_node").alias("ref_field"), F.col("to_node").alias("text")))).alias("r"))
    li = li.select("item_id", "drawing_id", "at", "period", F.lit("line_items").alias("ref_table"), F.lit("node").alias("space"), "r.ref_field", "r.text")
    va = table(spark, sf_dir, "valve_items").select(*base, F.lit("valve_items").alias("ref_table"), F.lit("line").alias("space"), F.lit("line_tag").alias("ref_field"), F.col("line_tag").alias("text"))
    return li.unionByName(va).where(references.is_reference(F.col("text"))).withColumn("key", _key("text")).drop("text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dangling end of a line or host line of a valve, with its state and month."""
    return references.dangling(_parents(spark, sf_dir), _children(spark, sf_dir), ["drawing_id"])


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references by table, field, state and month."""
    return references.orphan_report(p2_found(spark, sf_dir))


def panels(items: DataFrame) -> DataFrame:
    """id, pid: each set of panel rows with the same tag is a node; its latest row names the feeder."""
    keyed = items.select("item_id", "drawing_id", tag_key("tag").alias("key"), tag_key("feeder_from").alias("feeder"), "extracted_at").where("key <> ''")
    nodes = keyed.groupBy("drawing_id", "key").agg(F.min("item_id").alias("id"), F.max_by("feeder", F.struct("extracted_at", -F.col("item_id"))).alias("feeder"))
    targets = nodes.select(F.col("drawing_id").alias("t_drawing"), F.col("key").alias("t_key"), F.col("id").alias("pid"))
    return nodes.join(targets, (F.col("drawing_id") == F.col("t_drawing")) & (F.col("feeder") == F.col("t_key")), "left").select("id", "pid")


def p4_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every panel with its nested-set range."""
    return hierarchy.nested_sets(panels(table(spark, sf_dir, "panel_items")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per panel: its root, depth, path, number of panels below and loop state."""
    return p4_sets(spark, sf_dir).select(F.col("id").alias("item_id"), F.col("root_id").alias("root_item_id"), "depth", F.col("path").alias("item_path"), "n_descendants", "cycle_state")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per number of the four quantity fields, in the kind's common unit."""
    return units.normalise(table(spark, sf_dir, "equipment_items"), table(spark, sf_dir, "extraction_sources"))


QUERIES = {f.__name__: f for f in (p1_found, p1_variants, p1_subtypes, p1_children, p2_found, p2_report, p4_found, p6_found)}

_P2 = f"""
WITH parents AS (
  SELECT 'node' sp, drawing_id d, {tag_key_sql("tag")} k, ingested_at f, deleted_at t FROM equipment_items
  UNION ALL SELECT 'node', drawing_id, {tag_key_sql("tag")}, ingested_at, deleted_at FROM valve_items
  UNION ALL SELECT 'node', drawing_id, {tag_key_sql("tag")}, ingested_at, deleted_at FROM line_items
  UNION ALL SELECT 'line', drawing_id, {tag_key_sql("tag")}, ingested_at, deleted_at FROM line_items),
refs AS (
  SELECT 'line_items' ref_table, 'from_node' ref_field, item_id, 'node' sp, drawing_id d, from_node x, ingested_at ts, strftime(extracted_at, '%Y-%m') period FROM line_items
  UNION ALL SELECT 'line_items', 'to_node', item_id, 'node', drawing_id, to_node, ingested_at, strftime(extracted_at, '%Y-%m') FROM line_items
  UNION ALL SELECT 'valve_items', 'line_tag', item_id, 'line', drawing_id, line_tag, ingested_at, strftime(extracted_at, '%Y-%m') FROM valve_items),
keyed AS (SELECT *, {tag_key_sql("x")} k FROM refs WHERE regexp_matches(x, '[0-9]') AND NOT regexp_matches(lower(x), 'off[ _-]*page')),
judged AS (
  SELECT r.ref_table, r.ref_field, r.item_id, any_value(r.period) period, count(p.k) n, coalesce(bool_or(p.f <= r.ts), false) there,
         coalesce(bool_or(p.f <= r.ts AND (p.t IS NULL OR p.t > r.ts)), false) fine
  FROM keyed r LEFT JOIN parents p ON p.sp = r.sp AND p.d = r.d AND p.k = r.k GROUP BY 1, 2, 3),
found AS (SELECT ref_table, ref_field, item_id, CASE WHEN n = 0 THEN 'missing' WHEN NOT there THEN 'late' ELSE 'deleted' END ref_state, period FROM judged WHERE NOT fine)
"""

_P1 = """
WITH RECURSIVE src AS (
  SELECT DISTINCT thread_id, 'config_json' json_column, config_json t FROM threads WHERE json_valid(config_json)
  UNION ALL SELECT DISTINCT thread_id, 'result_json', result_json FROM threads WHERE json_valid(result_json)),
raw0 AS (SELECT thread_id, json_column, '' path, '' owner, false elem, t::JSON v FROM src),
node AS (
  SELECT thread_id, json_column, path, owner, elem,
    CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') AND left(ltrim(v->>'$'), 1) IN ('{', '[') THEN (v->>'$')::JSON ELSE v END v
  FROM raw0
  UNION ALL
  SELECT thread_id, json_column, path, owner, json_type(v) = 'OBJECT' AND arr,
    v
  FROM (
    SELECT thread_id, json_column, arr,
      CASE WHEN arr THEN path || '[' || key || ']' WHEN path = '' THEN key ELSE path || '.' || key END path, owner,
      CASE WHEN json_type(x) = 'VARCHAR' AND json_valid(x->>'$') AND left(ltrim(x->>'$'), 1) IN ('{', '[') THEN (x->>'$')::JSON ELSE x END v
    FROM (
      SELECT n.thread_id, n.json_column, n.path, CASE WHEN n.elem THEN n.path ELSE n.owner END owner, json_type(n.v) = 'ARRAY' arr,
        unnest(CASE WHEN json_type(n.v) = 'ARRAY' THEN list_transform(range(json_array_length(n.v)::BIGINT), lambda i: i::VARCHAR) ELSE json_keys(n.v) END) key,
        unnest(CASE WHEN json_type(n.v) = 'ARRAY' THEN json_extract(n.v, '$[*]') ELSE json_extract(n.v, '$.*') END) x
      FROM node n WHERE json_type(n.v) IN ('ARRAY', 'OBJECT'))))
SELECT DISTINCT thread_id, json_column, owner parent_path, path child_path FROM node WHERE elem"""

ORACLES = {
    "p1_found": _P1,
    "p1_children": f"SELECT thread_id, json_column, parent_path, count(*) n_children FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_report": _P2 + "SELECT ref_table, ref_field, ref_state, period, count(*) n_references FROM found GROUP BY ALL",
    "p4_found": f"""
WITH RECURSIVE rows_ AS (SELECT item_id, drawing_id d, {tag_key_sql("tag")} k, {tag_key_sql("feeder_from")} fk, extracted_at e FROM panel_items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d, k ORDER BY e DESC, item_id) rn, min(item_id) OVER (PARTITION BY d, k) id FROM rows_ WHERE k <> ''),
heads AS (SELECT d, k, id, fk FROM ranked WHERE rn = 1),
nodes AS (SELECT a.id, b.id pid FROM heads a LEFT JOIN heads b ON a.d = b.d AND a.fk = b.k),
down AS (
  SELECT id, id root, 0 depth, id::VARCHAR path FROM nodes WHERE pid IS NULL
  UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.id FROM down t JOIN nodes n ON n.pid = t.id),
anc AS (
  SELECT id, pid a FROM nodes WHERE pid IS NOT NULL
  UNION SELECT t.id, n.pid FROM anc t JOIN nodes n ON n.id = t.a WHERE n.pid IS NOT NULL),
below AS (SELECT a id, count(*) FILTER (WHERE id <> a) n FROM anc GROUP BY 1),
loops AS (SELECT id FROM anc WHERE id = a)
SELECT n.id item_id, coalesce(t.root, -1) root_item_id, coalesce(t.depth, -1)::INTEGER depth, coalesce(t.path, '') item_path, coalesce(b.n, 0) n_descendants,
  CASE WHEN l.id IS NOT NULL THEN 'on' WHEN t.id IS NULL THEN 'under' ELSE 'none' END cycle_state
FROM nodes n LEFT JOIN down t ON t.id = n.id LEFT JOIN below b ON b.id = n.id LEFT JOIN loops l ON l.id = n.id""",
}
