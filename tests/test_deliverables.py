import json
import xml.dom.minidom
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.operators import attributes, corpus, documents, entities, exports, history, pages, symbols, validation

ORD = "struct<class_no:int,item:bigint,rank:int,pos:int>"


def place(i):
    return (0, i, 0, 0)


def tables(spark):
    eq = spark.createDataFrame([(1, place(2), 'A&<"1>', "n", None, "d", None), (1, place(1), "B", "n", "Pump", None, "9 barg"), (2, place(1), "C", None, None, None, None)], f"drawing_id long, ord {ORD}, tag string, name string, type string, description string, design_pressure string")
    li = spark.createDataFrame([(1, place(1), "L1", '2"', "S", None, None, 0.756, "odd")], f"drawing_id long, ord {ORD}, tag string, size string, spec string, service string, from_node string, confidence double, flag_reason string")
    ed = spark.createDataFrame([(1, "A", "L1", "feeds", "far", 0.5, (4, place(1)))], f"drawing_id long, source string, target string, type string, flag_reason string, confidence double, rel_ord struct<part:int,place:{ORD}>")
    return {"equipment": eq, "lines": li, "relationships": ed}


def test_xml_documents_parse_and_hold_every_entity(spark):
    lines = exports.xml_documents(exports.plant_xml(tables(spark))).orderBy("drawing_id", "place").collect()
    docs = {d: xml.dom.minidom.parseString("\n".join(r.line for r in lines if r.drawing_id == d)) for d in (1, 2)}
    assert [x.getAttribute("Tag") for x in docs[1].getElementsByTagName("Equipment")] == ["B", 'A&<"1>']
    assert docs[1].getElementsByTagName("DesignPressure")[0].firstChild.data == "9 barg" and docs[1].getElementsByTagName("From")[0].firstChild is None
    assert len(docs[2].getElementsByTagName("PipingNetwork")) == 0 and len(docs[2].getElementsByTagName("Equipment")) == 1
    assert exports.xml_documents(exports.plant_xml({k: t.limit(0) for k, t in tables(spark).items()})).count() == 0


def test_objects_master_and_queue(spark):
    t = tables(spark)
    o = {r.tag: json.loads(r.attributes) for r in exports.objects(t).collect()}
    assert o["B"] == {"Name": "n", "Type": "Pump", "Description": None, "Material": None} and o["L1"]["ToConnection"] is None
    m = [(r.section, json.loads(r.record)) for r in exports.master(t).where("drawing_id = 1").collect()]
    assert sorted(k for k, _ in m) == ["equipment", "equipment", "lines", "relationships"] and all("ord" not in r for _, r in m)
    q = sorted((r.category, r.tag, r.confidence, r.details) for r in exports.flagged_entities(t).collect())
    assert q == [("Line Tag", "L1", "75%", 'Size: 2", Spec: S'), ("Relationship", "A -> L1", "50%", "Rel Type: feeds")]


def test_sheets_follow_the_kind_of_drawing(spark):
    kinds = spark.createDataFrame([(1, "SLD"), (2, "PID"), (3, "SLD")], "drawing_id long, drawing_type string")
    got = [(r.drawing_id, r.sheet, r.row_no, r.tag) for r in exports.sheets(tables(spark), kinds).collect()]
    assert sorted(got) == [(1, "relationships", 1, "A -> L1"), (2, "equipment", 1, "C")]


def test_writing_all_deliverables(spark, tmp_path):
    exports.write(tables(spark), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"wide_csv", "relationships_csv", "objects_json", "objects_xml", "master_json", "plant_xml", "tables"}
    one = list((tmp_path / "out/plant_xml/drawing_id=1").glob("*.txt"))
    assert len(one) == 1 and len(xml.dom.minidom.parseString(one[0].read_text()).getElementsByTagName("Equipment")) == 2


def test_sheet_rows_without_a_window_over_the_drawing(spark):
    rows = [(1, i, f"t{i}", 0.999 if i else None, [0.0007, 1.0] if i else None) for i in range(9000, -1, -1)]
    s = exports.sheet(spark.createDataFrame(rows, "drawing_id long, ord long, tag string, confidence double, box array<double>"), ["tag", "confidence", "box"])
    assert s.where("tag <> concat('t', row_no - 1)").count() == 0
    assert tuple(s.where("row_no = 1").first())[2:] == ("t0", "-", "-") and tuple(s.where("row_no = 2").first())[2:] == ("t1", "99%", "[0.0007, 1.0]")


def test_positions(spark):
    e = spark.createDataFrame([(1, "A", "PSV_TAG", 330.0, 0.5), (1, "B", "PSV_TAG", None, None)], "drawing_id long, tag string, classification string, x double, y double")
    raw = spark.createDataFrame([(1, "c", 1650.0, 1169.0, None), (1, "b", None, -1.0, [0.2, 0.4, 0.4, 0.8]), (1, None, None, None, [0.1])], "drawing_id long, text string, center_x double, center_y double, box array<double>")
    got = {(r.tag, r.classification): (r.x, r.y) for r in attributes.positions(e, raw).collect()}
    assert got == {("A", "PSV_TAG"): (0.1, 0.5), ("B", "PSV_TAG"): (-1.0, -1.0), ("c", "NOTE"): (0.5, 0.5), ("b", "NOTE"): (pytest.approx(0.6), pytest.approx(0.3)), ("", "NOTE"): (0.5, 0.5)}


def test_metadata_falls_back(spark):
    items = spark.createDataFrame([(1, i, "DWG NO: AB-12345-C" if i == 3 else "REV B", 0.1, 0.1) for i in range(12)] + [(2, 0, "DWG NO: AB-99999-C", 0.9, 0.9), (2, 1, "DWG NO: AB-11111-C", 0.1, 0.1)], "drawing_id long, item_idx long, text string, center_x double, center_y double")
    names = spark.createDataFrame([(1, "x"), (2, "y"), (3, "26-PID-0001_A.pdf"), (4, None)], "drawing_id long, filename string")
    got = {r.drawing_id: (r.drawing_number, r.revision, r.found_in) for r in documents.metadata(items, names).collect()}
    assert got == {1: ("AB-12345-C", "REV B", "texts"), 2: ("AB-99999-C", "0", "crop"), 3: ("26-PID-0001_A", "0", "filename"), 4: ("UNKNOWN", "0", "filename")}


def test_kinds_by_file_name(spark):
    t = spark.createDataFrame([(1, None, "earthing", "x_P&ID_y.pdf"), (2, None, "none", "heat-duty_stream.pdf"), (3, "PFD", None, None)], "doc_id long, title string, text string, filename string")
    assert {r.doc_id: (r.drawing_type, r.score) for r in documents.kinds(t, "doc_id", title="title", filename="filename").collect()} == {1: ("PID", 13), 2: ("PFD", 9), 3: ("PFD", 6)}


def test_what_was_found_again(spark):
    f = spark.createDataFrame([(1, "V", [0.1, 0.2, 0.3, 0.4], "26CB1", "CHECK_VALVE", None, "L1"), (1, "P", None, "PIT-1", "INSTRUMENT", "v", None)], "drawing_id long, target_tag string, coordinates array<double>, tag string, type string, value string, host string")
    t = validation.found_again(f)
    assert sorted((r.tag, r.classification, r.value) for r in t["elements"].collect()) == [("26CB1", "VALVE_TAG", "CHECK_VALVE"), ("PIT-1", "INSTRUMENT_TAG", "v")]
    assert [tuple(r) for r in t["relations"].collect()] == [(1, "26CB1", "L1", "INSTALLED_ON")] and t["symbols"].where("ymin = 0.1 and xmax = 0.4").count() == 1


def test_reader_texts_are_bounded_and_in_order(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", 0.5, 0.25, 1e-4) for i in range(25)], "drawing_id long, item_idx long, text string, confidence double, center_x double, center_y double")
    got = {r.part: r.text.split("\n") for r in pages.reader_texts(df, 10).collect()}
    assert [len(got[p]) for p in (0, 1, 2)] == [10, 10, 5] and got[1][0] == "t10 | conf=0.5 | pos=(0.25,0.0001)"


def test_chat_records_are_bounded(spark):
    df = spark.createDataFrame([(1, i, f"26-KA-{i:04d}", "EQUIPMENT_TAG") for i in range(1000)] + [(2, 1, "x", "NOTE")], "drawing_id long, ord long, tag string, classification string")
    rows = corpus.chat_records(df, most_chars=2000).orderBy("part").collect()
    assert {r.drawing_id for r in rows} == {1} and max(len(r.record) for r in rows) < 8000
    tags = [x["tag"] for r in rows for x in json.loads(json.loads(r.record)["messages"][2]["content"])["items"]]
    assert tags == [f"26-KA-{i:04d}" for i in range(1000)] and [json.loads(rows[0].record)["messages"][i]["role"] for i in range(3)] == ["system", "user", "model"]


def test_split_and_numbers_by_any_order(spark):
    rows = [(f"k{i:03d}", i % 3) for i in range(100)]
    got = {r.k: r.part for r in corpus.split(spark.createDataFrame(rows, "k string, n int").repartition(7), ["k"]).collect()}
    assert got == {f"k{i:03d}": "train" if i < 80 else "val" for i in range(100)}
    assert corpus.split(spark.createDataFrame([], "k string, n int"), ["k"]).count() == 0
    b = spark.createDataFrame([(d, i) for d in (1, 2, 3) for i in range(4)], "drawing_id long, box_idx long")
    img = spark.createDataFrame([(1, "val"), (2, "train"), (3, "train")], "drawing_id long, part string")
    assert [(r.drawing_id, r.box_idx, r.image_id, r.ann_id) for r in corpus.annotation_ids(b, img).orderBy("ann_id").collect()] == [(d, i, n, 4 * n + i) for n, d in enumerate((2, 3, 1)) for i in range(4)]


def test_logs(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "DONE"), ("b", "NEW")], "job string, status string")
    logs = spark.createDataFrame([("a", 2, datetime(2024, 1, 1), "s2", "m2"), ("a", 1, datetime(2024, 1, 1), "s1", "m1")], "job string, id long, at timestamp, step string, msg string")
    history.append(logs, str(tmp_path / "log"))
    history.append(logs.limit(0).withColumn("level", F.lit("INFO")), str(tmp_path / "log"))
    kept = history.read(spark, str(tmp_path / "log"))
    assert kept.count() == 2 and "level" in kept.columns
    got = sorted((r.job, r.log_no or 0, r.step or "") for r in history.with_logs(jobs, kept, "job", ["id"], ["step"]).collect())
    assert got == [("a", 1, "s1"), ("a", 2, "s2"), ("b", 0, "")]
    t = history.timeline(kept, "job", "at", "step", "level", "msg").orderBy("step_name").first()
    assert (t.timestamp, t.step_name, t.log_level, t.message) == ("2024-01-01 00:00:00", "s1", None, "m1")


def test_boxes_of_classes_reach_farther(spark):
    e = spark.createDataFrame([(1, "P-101", "EQUIPMENT_TAG", 0.5, 0.5), (1, "PIT-1", "INSTRUMENT_TAG", 0.5, 0.5)], "drawing_id long, tag string, classification string, x double, y double")
    assert {r.inferred_tag: r.ymin for r in symbols.from_tags(e, wide={"EQUIPMENT_TAG": 0.04}).collect()} == {"P-101": 0.46, "PIT-1": 0.48}
    assert entities.totals({"equipment": e}).first().total_items == 2


@pytest.mark.parametrize("x,text", [(0.0, "0.0"), (1.0, "1.0"), (0.0007, "0.0007"), (-2.5, "-2.5"), (None, None)])
def test_number_text(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(N.number_text(F.col("x"))).first()[0] == text
