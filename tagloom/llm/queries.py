"""The queries on survivors, copies, packing, leaks and spam, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.tags import tag_key, tag_key_sql
from tagloom.llm import consensus, contamination, ledger, packing, spam
from tagloom.session import stage, stage_path, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instrument read more than once: the readings that give the survivor's confidence, loop and box."""
    items = table(spark, sf_dir, "instrument_items").select("item_id", "drawing_id", tag_key("tag").alias("key"), "confidence", "loop_id", "coordinates", "source_id", "extracted_at").where("key <> ''")
    sources = table(spark, sf_dir, "extraction_sources").select(F.col("source_id").alias("s_id"), "trust_rank").dropDuplicates(["s_id"])
    rows = items.join(sources, F.col("source_id") == F.col("s_id"), "left")
    box = F.col("coordinates")
    fields = [
        consensus.Field("confidence", F.col("confidence"), (F.col("confidence") > 0) & (F.col("confidence") <= 1)),
        consensus.Field("loop", F.col("loop_id"), F.col("loop_id").rlike("[1-9]"), text=True),
        consensus.Field("box", box, (F.size(box) == 4) & F.forall(box, lambda x: (x >= 0) & (x <= 1)) & (F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3)))),
    ]
    best = consensus.survivors(rows, ["drawing_id", "key"], "item_id", [-F.col("trust_rank"), F.col("extracted_at")], fields)
    return best.select(F.col("first_id").alias("first_item_id"), F.col("confidence_id").alias("confidence_item_id"), F.col("loop_id").alias("loop_item_id"), F.col("box_id").alias("box_item_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per set of two or more rows with the same tag: a ledger that took the backlog, then the newest year."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("item_table"), "drawing_id", tag_key("tag").alias("key"), "item_id", "ingested_at") for t in ("equipment_items", "valve_items", "instrument_items")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("key <> ''")
    book = ledger.Ledger(spark, stage_path(spark, "ledger"), ["item_table", "drawing_id", "key"])
    for name, batch in zip(("backlog", "newest"), ledger.in_batches(rows, "ingested_at")):
        book.add(batch, "item_id", name)
    return book.read().where("n_copies > 1").select("item_table", F.col("first_id").alias("first_item_id"), F.col("n_copies").cast("int").alias("n_copies"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(packing.token_counts(table(spark, sf_dir, "documents")), "tokens")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_tokens(spark, sf_dir), table(spark, sf_dir, "pack_budgets"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, by piece, in containers of each size."""
    return _packed(spark, sf_dir)


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers opened, and how full, for each size."""
    return packing.usage(_packed(spark, sf_dir), table(spark, sf_dir, "pack_budgets"))


def p7_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the packing, over all documents and budgets; no row is right: containers above their capacity, documents not packed whole, documents cut though they would fit."""
    counts, budgets = _tokens(spark, sf_dir), table(spark, sf_dir, "pack_budgets")
    return packing.broken(packing.pack(counts, budgets), counts, budgets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that share twelve consecutive words or more."""
    found = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", F.explode("items").alias("eval_item_id")).distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's spam rate, before and after its host's."""
    return spam.classify(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of keywords, links and product tags."""
    return p9_rates(spark, sf_dir).where("is_spam").select("doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p7_packed, p7_usage, p7_broken, p8_found, p9_found, p9_rates)}

_USABLE = {
    "confidence": "confidence > 0 AND confidence <= 1",
    "loop": "regexp_matches(loop_id, '[1-9]')",
    "box": "len(coordinates) = 4 AND coalesce(list_bool_and(list_transform(coordinates, lambda x: x >= 0 AND x <= 1)), false) AND coordinates[1] < coordinates[3] AND coordinates[2] < coordinates[4]",
}

ORACLES = {
    "p3_found": f"""
WITH r AS (SELECT i.*, {tag_key_sql("tag")} k, coalesce(trust_rank, 2000000000) tr FROM instrument_items i LEFT JOIN extraction_sources USING (source_id)),
g AS (SELECT drawing_id d, k, min(item_id) first_item_id, count(*) n FROM r WHERE k <> '' GROUP BY 1, 2),
"""
    + ",\n".join(f"b_{f} AS (SELECT drawing_id d, k, item_id FROM r WHERE {u} QUALIFY row_number() OVER (PARTITION BY drawing_id, k ORDER BY tr, extracted_at DESC, item_id) = 1)" for f, u in _USABLE.items())
    + """
SELECT first_item_id, coalesce(c.item_id, 0) confidence_item_id, coalesce(l.item_id, 0) loop_item_id, coalesce(x.item_id, 0) box_item_id
FROM g LEFT JOIN b_confidence c USING (d, k) LEFT JOIN b_loop l USING (d, k) LEFT JOIN b_box x USING (d, k) WHERE n > 1""",
    "p5_found": " UNION ALL ".join(f"SELECT '{t}' item_table, min(item_id) first_item_id, count(*)::INTEGER n_copies FROM {t} WHERE {tag_key_sql('tag')} <> '' GROUP BY drawing_id, {tag_key_sql('tag')} HAVING count(*) > 1" for t in ("equipment_items", "valve_items", "instrument_items")),
    "p7_broken": "SELECT budget_id, '' AS what, 0::BIGINT AS id FROM pack_budgets WHERE false",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents),
e AS (SELECT eval_item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_items),
eg AS (SELECT DISTINCT eval_item_id, array_to_string(w[i:i + 11], ' ') g FROM (SELECT eval_item_id, w, unnest(range(1, len(w) - 10)) i FROM e WHERE len(w) >= 12)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) i FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, eval_item_id FROM dg JOIN eg USING (g)""",
}
