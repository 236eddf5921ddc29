"""Queries build only what they give, and patterns run once for each distinct text."""

import random

from pyspark.sql import functions as F

from tagloom.operators import attributes, classify, dedup, documents, entities, spatial, symbols, texts
from tagloom.operators.neighbours import first_within, nearest, prepared
from tagloom.plans import drawings, views
from tagloom.session import release


def forbid(monkeypatch, *parts):
    def unused(*_, **__):
        raise AssertionError("built for nothing")

    for module, name in parts:
        monkeypatch.setattr(module, name, unused)
    release()


def test_earthing_needs_no_other_table(spark, data, monkeypatch):
    forbid(monkeypatch, (spatial, "relations"), (attributes, "datasheet"), (entities, "loop_texts"), (symbols, "from_tags"))
    assert drawings.earthing_list(spark, data).count() > 0


def test_rules_sheets_and_valves_need_no_boxes_and_no_datasheets(spark, data, monkeypatch):
    forbid(monkeypatch, (attributes, "datasheet"), (attributes, "flanges"), (entities, "loop_texts"), (entities, "lines"), (symbols, "from_tags"))
    for q in (drawings.valve_list, drawings.relationships_resolved, drawings.validation_report, drawings.corpus_summary, drawings.export_sheets):
        assert q(spark, data).count() > 0


def test_rows_are_those_of_the_entity_tables(spark, data):
    """The rows of each table, with their aliases, are the whole table's."""
    release()
    e, t = drawings._entities(spark, data)
    for name in entities.ROWS:
        key = ["drawing_id", F.col("ord").cast("string"), "tag"]
        own = [*key, F.array_join("aliases", ",") if "aliases" in t[name].columns else F.lit("")]
        assert sorted(map(tuple, entities.rows(e, name).select(*key, F.array_join("aliases", ",")).collect())) == sorted(map(tuple, t[name].select(*own).collect())), name


def test_patterns_run_once_for_each_distinct_text(spark, monkeypatch):
    seen = []
    real = texts.stage
    monkeypatch.setattr(texts, "stage", lambda df, name: seen.append(real(df, name)) or seen[-1])
    items = spark.range(500).select(F.lit(1).alias("drawing_id"), F.col("id").alias("item_idx"), F.when(F.col("id") % 5 == 4, None).otherwise(F.concat(F.lit(" 26-KA-90"), (F.col("id") % 5).cast("string"))).alias("text"), F.lit(0.9).alias("confidence"), F.lit(0.5).alias("center_x"), F.lit(0.5).alias("center_y"))
    found = classify.scan(items)
    assert [s.count() for s in seen] == [4]
    assert found.where("rank = 3").groupBy("tag").count().orderBy("tag").collect() == [(f"26-KA-90{i}", 100) for i in range(4)]
    assert classify.normalized(items).count() == 400 and attributes.labelled(items).count() == 0
    assert [s.count() for s in seen] == [4, 4, 4]


def test_a_search_tells_distances_without_a_struct_a_candidate(spark):
    """Ties go to the smallest ord, null places find nothing, the radius is outside, a scope without candidates has no answer."""
    among = spark.createDataFrame([(1, "b", 2, 0.0, 0.3), (1, "a", 1, 0.3, 0.0), (1, "c", 0, 0.9, 0.9), (1, None, 0, 0.0, 0.0), (1, "n", 0, None, 0.0)], "drawing_id int, tag string, ord int, x double, y double")
    asked = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, None, 0.0), (1, 2, 0.9, 0.8), (1, 3, 5.0, 5.0), (2, 4, 0.0, 0.0)], "drawing_id int, k int, x double, y double")
    for square in (False, True):
        near = nearest(asked, among, 0.4, "t", square=square)
        assert [r.t for r in near.orderBy("k").collect()] == ["a", None, "c", None, None]
        assert [r.t for r in nearest(asked, among, 0.3, "t", square=square).orderBy("k").collect()] == [None, None, "c", None, None]
        assert [r.t for r in nearest(asked, among, 0.3, "t", square=square, inclusive=True).orderBy("k").collect()] == ["a", None, "c", None, None]
        assert [r.t for r in first_within(asked, among, 2.0, "t", square=square).orderBy("k").collect()] == ["c", None, "c", None, None]
        assert "zip_with" in near._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_begin_a_keyword_hold_every_hit(spark):
    """Keywords and phrases cut over items at every blank, amid other words: the kinds are those of all rows."""
    rng = random.Random(3)
    parts = "P &|I D|P|&|I|D|PIPING|AND|INSTRUMENTATION|process|FLOW chart|EARTH|LAYOUT|earth grid|ONE|LINE|SINGLE|diagram|CABLE|TRAY|HVAC|AIR|HANDLING|unit|FRAMING|PLAN|ISO|drawing|pipe|mass|BALANCE|flow|rate|TEST|link|26-KA-901| |xP|PSV|to|PANEL".split("|")
    rows = [(d, i, rng.choice(parts), 0.9) for d in range(120) for i in range(rng.randint(1, 9))]
    items = spark.createDataFrame(rows, "drawing_id int, item_idx long, text string, confidence double")
    singles = documents.confident(items)
    key = lambda df: sorted(map(tuple, df.collect()))
    few = documents.chained(items, only=documents.begins())
    assert few.count() < documents.chained(items).count()
    assert key(documents.kinds(few, singles=singles)) == key(documents.kinds(documents.chained(items), singles=singles))


def test_items_texts_are_those_of_the_case(spark):
    """Looked up by kind, every text is what the SQL's CASE says, for odd part and line numbers too."""
    keys = spark.range(-40, 2600).withColumn("n", F.explode(F.array(*[F.lit(x).cast("long") for x in (None, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 1000)]))).withColumnRenamed("id", "p").unionByName(spark.sql("SELECT CAST(null AS bigint) p, 3L n"))
    rows = keys.withColumn("kind", ((F.col("p") + F.col("n")) % views._KINDS).cast("int"))
    assert rows.where(~views.item_text().eqNullSafe(F.expr(views._TEXTS.format(s="string")))).count() == 0
    plan = views.ocr_items(spark, "/root/testdata/sf0.001").select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WHEN") < 34


def test_earthing_reads_only_mentions_of_its_classes(spark, data, monkeypatch):
    want = sorted(map(tuple, entities.earthing(drawings._elements(spark, data)).select("drawing_id", "tag", "component_type", "material", "size", "resistance").collect()))
    forbid(monkeypatch, (classify, "kept_notes"), (classify, "guarded"), (dedup, "fold_aliases"))
    assert sorted(map(tuple, drawings.earthing_list(spark, data).collect())) == want


def test_relationships_need_no_notes(spark, data, monkeypatch):
    forbid(monkeypatch, (classify, "kept_notes"))
    assert drawings.relationships_resolved(spark, data).count() > 0


def test_candidates_are_made_ready_once_for_several_searches(spark):
    """Also where a drawing is crowded; several candidates at one place count as one."""
    among = spark.range(3000).selectExpr("CAST(IF(id < 2900, 1, 2) AS int) drawing_id", "CAST(id AS string) tag", "id ord", "(id % 1450) / 1450 x", "((id * 7919) % 1450) / 1450 y")
    asked = spark.range(60).selectExpr("CAST(1 + id % 3 AS int) drawing_id", "id k", "id / 60 x", "((id * 17) % 60) / 60 y")
    once = prepared(among)
    for f in (nearest, first_within):
        key = lambda df: sorted(map(tuple, df.select("drawing_id", "k", "t").collect()))
        assert key(f(asked, once, 0.05, "t")) == key(f(asked, among, 0.05, "t"))


def test_folding_hands_on_columns_of_the_tag_and_of_the_first(spark):
    e = spark.createDataFrame([(1, 0, "A", "KA-901", "x", None), (1, 1, "A", "26-KA-901", "y", 0.5), (1, 2, "B", "KA-901", "z", 0.1)], "drawing_id int, o int, classification string, tag string, a string, b double")
    got = dedup.fold(e, F.substring("tag", -3, 3), ["A"], "o", keep=("a",), first=("a", "b")).collect()
    assert [(r.tag, r.o, r.first_tag, r.aliases, r.a, r.first_a, r.first_b) for r in got] == [("26-KA-901", 1, "KA-901", ["KA-901"], "y", "x", None)]
