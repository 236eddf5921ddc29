import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.operators import attributes, classify, dedup, documents, entities, neighbours, pages, relations, spatial, symbols, validation

ITEM = "drawing_id long, item_idx long, text string, confidence double, center_x double, center_y double, tag string"


def items(spark, texts, drawing=1):
    rows = []
    for i, t in enumerate(texts):
        t = t if isinstance(t, tuple) else (t, 0.9, None, None)
        rows.append((drawing, i, t[0], t[1], t[2] if len(t) > 2 else None, t[3] if len(t) > 3 else None, "clash"))
    return spark.createDataFrame(rows, ITEM)


def classes(spark, texts):
    return {r.tag: (r.classification, r.flag_reason) for r in classify.classify(items(spark, texts)).collect()}


@pytest.mark.parametrize(
    "texts,kind",
    [
        (["26-PIT-9077", "PIT-9062", "26-PDI-9054", "26-TIT-9057", "PDIT-9054"], "INSTRUMENT_TAG"),
        (["26CB9131", "26-GB-9178", "BV-101", "NV-201"], "VALVE_TAG"),
        (["EBM-01", "EB-101", "MAIN EARTH BAR"], "EARTH_BAR_TAG"),
        (["EP-01", "EARTH PIT", "EARTH CHAMBER"], "EARTH_PIT_TAG"),
        (["BC-01", "COPPER TAPE", "70 SQMM"], "BOND_CONDUCTOR_TAG"),
        (["L-01", "TL-101", "FL-01", "FLOODLIGHT-01", "WELLGLASS", "EMERGENCY LIGHT"], "LUMINAIRE_TAG"),
        (["DB-01", "MDB-A"], "PANEL_TAG"),
        (["MCCB-3", "CK-01"], "CIRCUIT_TAG"),
        (["26-KA-901", "P-101"], "EQUIPMENT_TAG"),
        (["26-PSV-9066A", "PSV-9066"], "PSV_TAG"),
        (["8\"-PV-26-9035-FC11S-08", "PV-26-9035-FC11S-08"], "LINE_TAG"),
        (["EL +100.000"], "ELEVATION_TAG"),
    ],
)
def test_one_class_each(spark, texts, kind):
    got = classes(spark, texts)
    assert all(got[t][0] == kind for t in texts), got


def test_specification_codes_are_no_tags(spark):
    got = classes(spark, ["GC11S", "AS20S", "FC11S", "AC21", "GC115", "PV-26", "VA-26"])
    assert {c for c, _ in got.values()} <= {"NOTE", "LINE_TAG"}


@pytest.mark.parametrize("text", ["SD HH: PI-150", "SP= PI-225 bar(g)", "MAWP PI-286 barg", "TRIP AT-225", "PI-150 ALARM", "DESIGN PI-150", "SET PRESSURE TI-100"])
def test_set_points_are_no_instruments(spark, text):
    assert "INSTRUMENT_TAG" not in {c for c, _ in classes(spark, [text]).values()}


def test_set_point_beside(spark):
    near = classes(spark, [("PI-150", 0.9, 0.30, 0.50), ("SD HH: 150 BARG", 0.05, 0.32, 0.52)])
    far = classes(spark, [("PI-150", 0.9, 0.30, 0.50), ("SD HH: 150 BARG", 0.9, 0.32, 0.56)])
    assert near["PI-150"] == ("NOTE", "ambiguous_setpoint_vs_tag") and far["PI-150"][0] == "INSTRUMENT_TAG"
    assert classes(spark, ["SD HH 1", "PIT-9087", "FIT-9031"])["PIT-9087"][0] == "INSTRUMENT_TAG"


def test_line_sizes(spark):
    got = classes(spark, ['262"-VA-26-9110-AS20S-00', "12mm-PV-26-9116-FD70X-00", '3/4"-VA-26-9114-AC21-00NOTE20', "900-VA-26-9110-AS20S-00", "900-VA-26-9110-AS20S-00"])
    assert got['262"-VA-26-9110-AS20S-00'] == ("NOTE", 'size_out_of_range(262")')
    assert got["12MM-PV-26-9116-FD70X-00"][0] == "LINE_TAG"
    assert not any("NOTE20" in t for t, (c, _) in got.items() if c == "LINE_TAG")
    assert got["900-VA-26-9110-AS20S-00"][1]


@pytest.mark.parametrize("size,flag", [('2"', None), ('12"', None), ('3/4"', None), ("5/7", "unrecognized_fraction_size"), ("77", "unverified_size_token"), ("50mm", None), ('61"', 'size_out_of_range(61")'), ("1000", "size_out_of_range(1000)"), ("0", "size_out_of_range(0)"), ("PV", None)])
def test_size_check(spark, size, flag):
    assert spark.createDataFrame([(f"{size}-VA-1",)], "t string").select(classify.size_check(F.col("t"))).first()[0] == flag


def test_notes_low_confidence_blank_and_empty(spark):
    got = classes(spark, ["Some note", "some note", "Some note", ("26-KA-901", 0.05), ("", 0.9), (None, 0.9), ("x", 0.9), ("26-KA-902", None), ("    ", 0.9)])
    assert got == {"Some note": ("NOTE", None), "some note": ("NOTE", None)}
    assert classes(spark, []) == {}


def test_order_of_input_rows_does_not_matter(spark):
    t = ["26-KA-901", "KA-901", "26-PIT-9087", "PIT-9087", '262"-VA-26-9110-AS20S-00', "26CB9131", "PI-150", "TRIP", "note"] * 2
    df = items(spark, t)
    a = sorted(map(tuple, dedup.fold_aliases(classify.classify(df)).collect()))
    b = sorted(map(tuple, dedup.fold_aliases(classify.classify(df.orderBy(F.rand(3)).repartition(5))).collect()))
    assert a == b


def test_folding(spark):
    def fold(*tags):
        return {r.tag: r.aliases for r in dedup.fold_aliases(classify.classify(items(spark, tags))).where("classification <> 'NOTE'").collect()}

    assert fold("26-PIT-9087", "PIT-9087") == fold("PIT-9087", "26-PIT-9087") == {"26-PIT-9087": ["PIT-9087"]}
    assert fold("26-PIT-9087", "26-PIT-9088") == {"26-PIT-9087": ["PIT-9087"], "26-PIT-9088": ["PIT-9088"]}  # the bare form is seen inside the long one
    assert fold("PIT-9087", "26-PIT-9087", "43-PIT-9087") == {"26-PIT-9087": ["PIT-9087", "43-PIT-9087"]}
    e = classify.classify(items(spark, ["26-KA-901", "KA-901", "P-101", "P-101A"]))
    assert {r.tag for r in entities.equipment(e).collect()} == {"26-KA-901", "P-101", "P-101A"}


@pytest.mark.parametrize("tag,canon", [("26-PIT-9087", "PIT-9087"), (" 43-pdi-9015 ", "PDI-9015"), ("PIT-9087", "PIT-9087"), ("26-PSV-9066A", "PSV-9066A"), (None, None)])
def test_canonical(spark, tag, canon):
    df = spark.createDataFrame([(tag,)], "t string")
    once = df.select(N.canonical_tag(F.col("t")).alias("t"))
    assert once.first()[0] == canon and once.select(N.canonical_tag(F.col("t"))).first()[0] == canon


@pytest.mark.parametrize("raw,good", [("FCllS", "FC11S"), ("PlT-9087", "PIT-9087"), ("A0B", "AOB"), ("1O1", "101"), ("plain", "plain"), ("PDlT", "PDIT"), ("P1T", "PIT")])
def test_repairs(spark, raw, good):
    assert spark.createDataFrame([(raw,)], "t string").select(N.repair(F.col("t"))).first()[0] == good


@pytest.mark.parametrize("s,text", [(None, "N/A"), (0.0, "N/A"), (12.34, "12.3s"), (61.0, "01m 01s"), (3725.0, "62m 05s")])
def test_duration(spark, s, text):
    assert spark.createDataFrame([(s,)], "s double").select(N.duration(F.col("s"))).first()[0] == text


def points(rnd, n, drawing, cls):
    return [(drawing, f"{cls}{i}", i, rnd.choice([rnd.random(), 0.25, 0.5]), rnd.choice([rnd.random(), 0.25])) for i in range(n)]


@pytest.mark.parametrize("square", [False, True])
@pytest.mark.parametrize("cell", [4, 2048])
def test_neighbours_equal_brute_force(spark, monkeypatch, square, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)  # few, so that the search goes down a tree, or so many that arrays do
    monkeypatch.setattr(neighbours, "LEAF", 2)
    rnd = random.Random(6)
    asked, cand = [], []
    for d, n in ((1, 300), (2, 3), (3, 40)):
        asked += points(rnd, 60, d, "a")
        cand += points(rnd, n, d, "c") + [(d, f"k{i}", i, 0.5 + rnd.gauss(0, 1e-4), 0.5 + rnd.gauss(0, 1e-4)) for i in range(n)]
    asked += [(9, "lonely", 1, 0.1, 0.1), (1, "nowhere", 2, None, 0.5), (1, "nowhere", 2, None, 0.5)]
    s = "drawing_id long, tag string, ord long, x double, y double"
    a, c = spark.createDataFrame(asked, s), spark.createDataFrame(cand, s)
    d2 = (lambda x, y: max(abs(x), abs(y))) if square else (lambda x, y: (x * x + y * y) ** 0.5)
    reach = lambda d, x, y: [(d2(x - k[3], y - k[4]), k[2], k[1]) for k in cand if k[0] == d and d2(x - k[3], y - k[4]) < 0.3] if x is not None else []
    got = sorted((r.drawing_id, r.tag, r.near or "") for r in neighbours.nearest(a, c, 0.3, "near", square=square).collect())
    assert got == sorted((d, t, min(reach(d, x, y), default=("", "", ""))[2]) for d, t, _, x, y in asked)
    got = sorted((r.drawing_id, r.tag, r.near or "") for r in neighbours.first_within(a, c, 0.3, "near", square=square).collect())
    assert got == sorted((d, t, min((k[1:] for k in reach(d, x, y)), default=("", ""))[1]) for d, t, _, x, y in asked)
    assert neighbours.nearest(a, c.limit(0), 0.3, "near").where("near is not null").count() == 0


def rels(spark, *rows):
    return spark.createDataFrame([(1, s, t, k, i) for i, (s, t, k) in enumerate(rows)], "drawing_id long, source_tag string, target_tag string, rel_type string, rel_ord long")


def test_provenance(spark):
    tok = spark.createDataFrame([(1, "PIT-9087"), (1, "26-KA-901"), (1, "KA-901")], "drawing_id long, token string")
    r = rels(spark, ("99-XX-1", "88-YY-2", "FEEDS"), ("26-PIT-9087", "nowhere", "MONITORS"), ("a", "ka-901", "FEEDS"))
    assert [x.source_tag for x in relations.dropped(r, tok).collect()] == ["99-XX-1"]
    assert relations.clean(r, tok).count() == 2 and relations.clean(r, tok.limit(0)).count() == 3


def test_edges_resolve_without_loops(spark):
    e = spark.createDataFrame([(1, 1, "26-CK-921", ["CK-921"])], "drawing_id long, ord long, tag string, aliases array<string>")
    r = rels(spark, ("CK-921", "26-CK-921", "CONNECTS_TO"), ("LP FLARE", "CK-921", "FEEDS"), ("lp flare", "26-CK-921", "feeds"), ("", "x", "FEEDS"))
    got = relations.resolve(r, relations.alias_map([e])).collect()
    assert [(x.source, x.target, x.type) for x in got] == [("LP FLARE", "26-CK-921", "feeds")]


def test_datasheet_block(spark):
    block = ["26-KA-902", "DUTY kW 1835", "MASS FLOW kg/h 62809", "DESIGN PRESSURE: FV / 286 barg", "DESIGN TEMPERATURE -29 / 160 °C", "MATERIAL: SS316", "QTY 1x100%", "TYPE: CENTRIFUGAL", "VENDOR: MAN ENERGY SOLUTIONS"]
    i = items(spark, [(t, 0.9, 0.5, 0.40 + 0.001 * k) for k, t in enumerate(block)])
    e = classify.classify(i)
    v = {r.field: r.value for r in attributes.datasheet(i, e).where("tag = '26-KA-902'").collect()}
    assert v["duty"] == "1835 kW" and v["flow_rate"] == "62809 kg/h" and v["quantity"] == "1x100%" and v["design_pressure"] == "FV / 286 barg" and v["material"] == "SS316" and v["vendor"] == "MAN ENERGY SOLUTIONS"
    row = entities.equipment(e, attributes.datasheet(i, e)).where("tag = '26-KA-902'").first()
    assert row.confidence == 1.0 and row.type == "CENTRIFUGAL"
    assert entities.equipment(e).where("tag = '26-KA-902'").first().confidence == 0.6


@pytest.mark.parametrize("text,value", [("VENDOR", None), ("* VENDOR SCOPE OF SUPPLY.", None), ("VENDOR: YARD", None), ("VENDOR\nMAN ENERGY SOLUTIONS", "MAN ENERGY SOLUTIONS")])
def test_vendor(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(attributes.vendor(F.col("t"))).first()[0] == value


def test_relief_valves_and_twins(spark):
    i = items(spark, [("26-PSV-9066A", 0.9, 0.5, 0.43), ("26-PSV-9066B", 0.9, 0.9, 0.80), ("SP= 225.4 bar (g)", 0.9, 0.5, 0.45), ('3"x4" 300# 150#', 0.9, 0.5, 0.44)])
    e = classify.classify(i)
    got = {r.tag: r for r in entities.relief_valves(e, attributes.set_pressures(i, e), attributes.flanges(i, e)).collect()}
    assert {r.set_pressure for r in got.values()} == {"225.4 bar(g)"} and len(got) == 2
    assert {(r.inlet_size, r.outlet_size, r.inlet_spec) for r in got.values()} == {('3"', '4"', "300#")}
    none = items(spark, ["SP= 1 barg"])
    assert attributes.set_pressures(none, classify.classify(none)).count() == 0


def test_off_page_callout_takes_the_near_line(spark):
    i = items(spark, [('8"-PV-26-9035-FC11S-08', 0.9, 0.11, 0.11), ('6"-PV-26-9036-FC11S-08', 0.9, 0.85, 0.85), ("FROM 27-PIT-0001B UNIT", 0.9, 0.10, 0.10)])
    e = classify.classify(i).where("tag <> '27-PIT-0001B'")
    e = e.unionByName(e.limit(1).withColumns({"tag": F.lit("FROM 27-PIT-0001B UNIT"), "classification": F.lit("NOTE"), "x": F.lit(0.1), "y": F.lit(0.1)}))
    got = {r.tag: r.from_node for r in entities.lines(e, rels(spark).limit(0)).collect()}
    assert got['8"-PV-26-9035-FC11S-08'].startswith("27-PIT-0001B") and got['6"-PV-26-9036-FC11S-08'] is None


@pytest.mark.parametrize("tag,want", [('8"-PV-26-9035-FC11S-08', ('8"', "PV", "26", "9035", "FC11S", "08")), ("PV-9035-FC11S", ("", "PV", None, "9035", "FC11S", None)), ("PV-9035", ("", "PV", None, "9035", "UNSPEC", None)), ("PV-26-9035-FC11S", ("", "PV", "26", "9035", "FC11S", None)), ("PV-9035-FC11S-08", ("", "PV", None, "9035", "FC11S", "08"))])
def test_parse_line(spark, tag, want):
    assert tuple(spark.createDataFrame([(tag,)], "t string").select(entities.parse_line(F.col("t")).alias("p")).select("p.*").first()) == want


def test_validation_rules(spark):
    eq = spark.createDataFrame([(1, 1, "26-KA-901"), (1, 2, "??"), (1, 3, "V-1")], "drawing_id long, ord long, tag string")
    li = spark.createDataFrame([(1, 1, "L1", '2"')], "drawing_id long, ord long, tag string, size string")
    va = spark.createDataFrame([(1, 1, "V-1", '3"', "L1", None), (1, 2, "V-2", None, None, [0.1, 0.1, 0.2, 0.2]), (1, 3, "V-3", "2", "L1", None)], "drawing_id long, ord long, tag string, size string, line_tag string, coordinates array<double>")
    ins = spark.createDataFrame([(1, 1, "PIT-1", None), (1, 2, "PIT-2", None)], "drawing_id long, ord long, tag string, coordinates array<double>")
    ed = spark.createDataFrame([(1, "PIT-1", "L1")], "drawing_id long, source string, target string")
    t = {"equipment": eq, "lines": li, "valves": va, "instruments": ins, "relationships": ed}
    rep = validation.validate(t)
    assert sorted((r.rule_id, r.target_tag) for r in rep.collect()) == [("VAL-001", "V-1"), ("VAL-002", "V-1"), ("VAL-003", "V-2"), ("VAL-004", "PIT-2"), ("VAL-005", "??")]
    m = {r.target_tag: r for r in validation.missing(rep, va, ins).collect()}
    assert m["V-2"].coordinates == [0.1, 0.1, 0.2, 0.2] and m["PIT-2"].coordinates == validation.FALLBACK
    tried = spark.createDataFrame([(1, "V-2")], "drawing_id long, target_tag string")
    assert [r.target_tag for r in validation.missing(rep, va, ins, tried).collect()] == ["PIT-2"]


def test_loop_ends(spark):
    e0 = spark.createDataFrame([(1, "PIT-2", False)], "drawing_id long, tag string, linked boolean")

    def recompile(e):
        ins = e.groupBy("drawing_id", "tag").agg(F.max("linked").alias("l")).withColumns({"ord": F.lit(1), "coordinates": F.lit(None).cast("array<double>")})
        ed = ins.where("l").select("drawing_id", F.col("tag").alias("source"), F.lit("L1").alias("target"))
        va = ins.limit(0).withColumn("line_tag", F.lit(""))
        return {"reports": validation.orphan_instruments(ins, ed), "valves": va, "instruments": ins}

    _, n = validation.refine({"elements": e0}, lambda m: m.select("drawing_id", F.col("target_tag").alias("tag"), F.lit(True).alias("linked")), recompile)
    assert n == 1
    _, n = validation.refine({"elements": e0}, lambda m: m.select("drawing_id", F.col("target_tag").alias("tag"), F.lit(False).alias("linked")), recompile)
    assert n == 1  # what was tried isn't tried again


def brute_nms(rows, thr):
    def iou(a, b):
        h, w = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        j = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - h * w
        return h * w / j if j > 0 else 0

    kept = []
    for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[1])):
        if not any(k[0] == r[0] and k[2] == r[2] and iou(k, r) > thr for k in kept):
            kept.append(r)
    return sorted(k[1] for k in kept)


@pytest.mark.parametrize("small", [2, 256])
def test_suppression_equals_the_greedy_pass(spark, small):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        y, x, s = rnd.choice([rnd.random(), 0.5]), rnd.choice([rnd.random() * 0.2, 0.1]), rnd.choice([0.05, 0.1])
        rows.append((rnd.randint(1, 2), i, rnd.choice("ab"), rnd.choice([0.5, 0.9, rnd.random(), None]), y, x, y + s, x + s))
    rows += [(1, 400, "a", 0.5, 0.5, 0.5, 0.5, 0.6), (1, 401, "a", 0.9, 0.1, 0.1, 0.1, 0.1)]  # no area
    df = spark.createDataFrame(rows, "drawing_id long, box_idx long, symbol_type string, confidence double, ymin double, xmin double, ymax double, xmax double")
    assert sorted(r.box_idx for r in symbols.suppress(df, 0.3, small=small).collect()) == brute_nms(rows, 0.3)
    assert symbols.suppress(df.limit(0)).count() == 0


def test_class_numbers(spark):
    df = spark.createDataFrame([("PSV",), ("gate_valve ",), ("BIG PUMP HOUSE",), ("VALVE",), ("unknown",)], "t string")
    assert [r[0] for r in df.select(symbols.class_id(F.col("t"))).collect()] == [16, 9, 6, 8, 0]


def test_bubbles(spark):
    w = spark.createDataFrame([(1, 1, 1, 1, "PIT", 0.10, 0.10), (1, 1, 2, 2, "9087", 0.11, 0.12), (1, 1, 3, 3, "9088", 0.13, 0.12), (1, 1, 4, 4, "9089", 0.10, 0.141), (1, 2, 5, 5, "9090", 0.10, 0.12), (1, 1, 6, 6, "XYZ", 0.1, 0.1)], "drawing_id long, page int, word_idx long, line_idx long, text string, center_x double, center_y double")
    assert [r.text for r in pages.assemble_bubbles(w).collect()] == ["PIT-9087"]


def test_kinds(spark):
    d = [(1, 0, "SINGLE", 0.9), (1, 1, "LINE", 0.9), (1, 2, "DIAGRAM", 0.9), (2, 0, "compressor skid", 0.9), (3, 0, "EARTHING", 0.1), (4, 0, "", 0.9)]
    df = spark.createDataFrame(d, "drawing_id long, item_idx long, text string, confidence double")
    got = {r.drawing_id: r.drawing_type for r in documents.kinds(documents.chained(df)).collect()}
    assert got == {1: "SLD", 2: "PID"}
    blanks = spark.createDataFrame([(1, i, t, 0.9) for i, t in enumerate(["PIPING", " ", "\n ", " ", "INSTRUMENTATION"])] + [(2, i, t, 0.9) for i, t in enumerate(["heat", " ", "duty", "stream"])] + [(3, i, t, 0.9) for i, t in enumerate(["heat", "duty", "stream"])], "drawing_id long, item_idx long, text string, confidence double")
    got = {r.drawing_id: (r.drawing_type, r.score) for r in documents.kinds(documents.chained(blanks)).collect()}
    assert got[1][0] == "PID" and (got[2][1], got[3][1]) == (5, 9)  # as in the whole text, where the blanks between stand
    t = spark.createDataFrame([(1, "P&ID of unit 26", "earthing"), (2, None, "hello")], "doc_id long, title string, text string")
    assert {r.doc_id: r.drawing_type for r in documents.kinds(t, "doc_id", title="title").collect()} == {1: "PID", 2: "GENERIC"}
    b = spark.createDataFrame([(1, 0, "DWG NO: AB-12345-C"), (1, 1, "REV B"), (1, 2, "DRAWING DOC-998877")], "drawing_id long, item_idx long, text string")
    assert tuple(documents.title_block(b).first())[1:] == ("DRAWING", "REV B")
    b = spark.createDataFrame([(1, 0, "Drawing no: AB-12345-C")], "drawing_id long, item_idx long, text string")
    assert documents.title_block(b).first().drawing_number == "AB-12345-C"


@pytest.mark.parametrize("seed", range(3))
def test_chained_texts_hold_what_the_whole_text_does(spark, seed):
    rnd = random.Random(seed)
    pool = ["PIPING", "AND", "INSTRUMENTATION", " ", "  ", "P", "&", "I", "D", "SINGLE", "LINE", "DIAGRAM", "heat", "duty", "fault level", "x", "CABLE", "TRAY", "distribution", "board"]
    texts = {d: [rnd.choice(pool) for _ in range(rnd.randint(1, 12))] for d in range(40)}
    df = spark.createDataFrame([(d, i, t, 0.9) for d, ts in texts.items() for i, t in enumerate(ts)], "drawing_id long, item_idx long, text string, confidence double")
    whole = spark.createDataFrame([(d, " ".join(ts)) for d, ts in texts.items() if any(t.strip() for t in ts)], "drawing_id long, text string")
    want = sorted(map(tuple, documents.kinds(whole).collect()))
    assert sorted(map(tuple, documents.kinds(documents.chained(df)).collect())) == want
    assert [r for r in sorted(map(tuple, documents.kinds(documents.chained(df), singles=documents.confident(df)).collect())) if r[0] in {w[0] for w in want}] == want


def test_datasheet_column_of_blocks(spark):
    b = [(1, 1, 0, 100.0, 50.0, "TAG NUMBER\n26-KA-902"), (1, 1, 1, 120.0, 80.0, "DUTY\n1,835 kW"), (1, 1, 2, 100.0, 90.0, "DESIGN PRESSURE\n286 NOTE 3"), (1, 1, 3, 100.0, 95.0, "DESIGN TEMP\n160"), (1, 1, 4, 300.0, 80.0, "MATERIAL\nfar aside"), (1, 1, 5, 100.0, 400.0, "MATERIAL\nfar below"), (1, 1, 6, 100.0, 120.0, "VENDOR\nMAN ENERGY SOLUTIONS"), (1, 1, 7, 100.0, 130.0, " "), (1, 2, 8, 100.0, 60.0, "MATERIAL\nother page"), (1, 1, 9, 110.0, 200.0, "DUTY\n1900")]
    df = spark.createDataFrame(b, "drawing_id long, page int, block_idx long, x0 double, y0 double, text string")
    got = {r.field: r.value for r in attributes.block_sheets(df).collect()}
    assert got == {"duty": "1900 kW", "design_pressure": "286 Barg", "design_temperature": "160 °C", "vendor": "MAN ENERGY SOLUTIONS"}
    assert attributes.block_sheets(df.limit(0)).count() == 0


def test_state(spark):
    from tagloom.operators import state

    a, b = spark.createDataFrame([(1, "x")], "d int, t string"), spark.createDataFrame([(2,)], "d int")
    m = state.merge({"t": a}, {"t": b, "u": b})
    assert sorted(r.d for r in m["t"].collect()) == [1, 2] and m["u"].count() == 1
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"a": "1"})], "l map<string,string>, r map<string,string>")
    assert [r[0] for r in df.select(state.merge_maps(F.col("l"), F.col("r"))).collect()] == [{"a": "1", "b": None, "c": "3"}, {"a": "1"}]
    s = spark.createDataFrame([("compiler",), ("else",)], "s string").select(state.progress(F.col("s")))
    assert [r[0] for r in s.collect()] == [0.78, 0.5]


def test_overlay_fills_only_what_is_empty(spark):
    df = spark.createDataFrame([({"a": "1", "b": ""}, {"a": "9", "b": "2", "c": "3"}), (None, None)], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in df.select(attributes.overlay(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "2", "c": "3"}, {}]


def test_many_matches_in_one_text_keep_their_order(spark):
    """The place of a match has no bound: the first of equals is the first of the text, however long it is."""
    text = " ".join(f"26-KA-{i:04d}" for i in range(150))
    got = classify.classify(items(spark, [text])).where("classification = 'EQUIPMENT_TAG' and seq.rank = 3").orderBy("ord").select("tag").collect()
    assert [r.tag for r in got] == [f"26-KA-{i:04d}" for i in range(150)]
    far = items(spark, ["26-KA-901"]).withColumn("item_idx", F.lit(2**40))
    near = items(spark, ["PIT-9087"])
    assert [r.tag for r in classify.classify(far.unionByName(near)).where("classification <> 'NOTE'").orderBy("ord").collect()] == ["26-KA-901", "PIT-9087"]
