import time

from pyspark.sql import functions as F

from tagloom.operators import classify, corpus, dedup, entities, exports, history
from tagloom.sources import readers
from tagloom.streaming import arrivals

ROWS = [(1, 0, "26-KA-901", 0.9, 0.1, 0.1), (1, 1, "KA-901", 0.1, 0.2, 0.2), (1, 2, " ", 0.9, 0.2, 0.2), (2, 0, "PIT-9087", 0.9, 0.3, 0.3)]


def test_items_and_manifest(spark, tmp_path):
    df = spark.createDataFrame(ROWS, readers.ITEMS)
    df.write.json(str(tmp_path / "j"))
    assert readers.items(spark, str(tmp_path / "j"), "json", "paddle_v2").count() == 2
    (tmp_path / "m.csv").write_text("type,filename,width,height\nfull_page,a.png,10,20\npatch,b_x120_y40.png,5,5\n")
    m = readers.manifest(spark, str(tmp_path / "m.csv"), "patch")
    assert m.select(corpus.patch_offset(F.col("filename")).alias("o")).select("o.x", "o.y").first() == (120, 40)


def test_pages_keep_their_errors(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.png").write_bytes(n.encode())

    def run(path, content):
        if content == b"b":
            raise ValueError("bad page")
        return [{"text": "x", "confidence": 0.5}]

    got = {r.path[-5]: (r.text, r.error) for r in readers.extract(readers.page_files(spark, str(tmp_path)), run).collect()}
    assert got == {"a": ("x", None), "b": (None, "ValueError: bad page")}


def test_first_source_with_enough(spark):
    a = spark.createDataFrame(ROWS, readers.ITEMS)
    b = a.withColumn("text", F.lit("other"))
    got = readers.first_of([a, b], [1, 0])
    assert {(r.drawing_id, r.text) for r in got.where("drawing_id = 2").collect()} == {(2, "other")} and got.count() == 4


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    a = spark.createDataFrame(ROWS, readers.ITEMS)
    for d in (1, 2):
        a.where(F.col("drawing_id") == d).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    q = arrivals.classify_stream(arrivals.item_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(180)
    assert q.exception() is None
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch").select("drawing_id", "tag", "classification").collect()))
    assert got == sorted(map(tuple, dedup.fold_aliases(classify.classify(a)).select("drawing_id", "tag", "classification").collect()))


def test_deliverables(spark, tmp_path):
    e = dedup.fold_aliases(classify.classify(spark.createDataFrame([(1, 0, "26-KA-901", 0.9, 0.1, 0.1), (1, 1, "DB-01", 0.9, 0.2, 0.2), (2, 0, "TL-101", 0.9, 0.1, 0.1)], readers.ITEMS)))
    t = {"equipment": entities.equipment(e), "panels": entities.panels(e), "luminaires": entities.luminaires(e), "relationships": spark.createDataFrame([(1, "a", "b", "feeds")], "drawing_id long, source string, target string, type string")}
    exports.write(t, str(tmp_path / "o"))
    w = spark.read.option("header", True).csv(str(tmp_path / "o/wide_csv"))
    assert {r.entity_type for r in w.collect()} == {"EQUIPMENT", "ELECTRICAL_PANEL", "LUMINAIRE", "RELATIONSHIP"}
    assert spark.read.parquet(str(tmp_path / "o/tables/panels")).count() == 1
    x = spark.read.format("xml").option("rowTag", "Object").load(str(tmp_path / "o/objects_xml"))
    assert x.count() == 3
    s = exports.sheet(t["panels"], ["tag", "coordinates"]).first()
    assert (s.row_no, s.tag, s.coordinates) == (1, "DB-01", "-")


def test_history(spark):
    e = spark.createDataFrame([("j", 1, "QUEUED", None, 1), ("j", 2, None, 0.5, 2), ("j", 2, "RUNNING", None, 3), ("k", 1, None, None, 4)], "job string, ts int, status string, progress double, id int")
    got = {r.job: (r.status, r.progress, r.updated_at) for r in history.current(e, "job", "ts", ["status", "progress"], "id").collect()}
    assert got == {"j": ("RUNNING", 0.5, 2), "k": (None, None, 1)}
    assert history.without(e, spark.createDataFrame([("j",)], "job string"), "job").count() == 1
    j = spark.createDataFrame([('{"a": {"b": 1}}',), ("broken{",), (None,)], "c string")
    assert [r[0] for r in j.select(history.field("c", "$.a.b")).collect()] == ["1", None, None]


def test_split_and_status(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    s = corpus.split(df, ["k"]).groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("lo")).collect()
    assert {r.part: (r.n, r.lo) for r in s} == {"train": (80, 0), "val": (21, 80)}
    o = spark.createDataFrame([("e", False), (None, True), (None, False)], "error string, skipped boolean")
    assert [r.status for r in corpus.outcome(o).collect()] == ["failed", "skipped", "success"]
