from tagloom.llm import queries as Q

COLUMNS = {
    "p3_found": [("first_item_id", "bigint"), ("confidence_item_id", "bigint"), ("loop_item_id", "bigint"), ("box_item_id", "bigint")],
    "p5_found": [("item_table", "string"), ("first_item_id", "bigint"), ("n_copies", "int")],
    "p8_found": [("doc_id", "bigint"), ("eval_item_id", "int")],
    "p9_found": [("doc_id", "bigint")],
}


def test_columns_and_oracles(spark, data):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, want in COLUMNS.items():
        df = Q.QUERIES[name](spark, data)
        assert df.dtypes == want
        if name in Q.ORACLES:
            rel = con.execute(Q.ORACLES[name])
            at = [[d[0] for d in rel.description].index(c) for c, _ in want]
            assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
