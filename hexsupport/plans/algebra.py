"""Queries on cell ids, compaction, rollup and audit over the star tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.functions import bits
from hexsupport.operators.audit import audit
from hexsupport.operators.cells import as_cells, uncompact
from hexsupport.operators.compact import compact, compact_and_own, ownership
from hexsupport.operators.rollup import reconcile, rollup, text_cells


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as cells of resolution 9; each 97th cell is left free, so that parents are partly full."""
    orders = table(spark, sf_dir, "orders").withColumn("place", F.expr("o_orderkey + o_orderkey div 96"))
    return text_cells(orders, "place")


# --- ids


def cell_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = text_cells(table(spark, sf_dir, "customer"), "c_custkey")
    cell = bits.to_long(F.col("h3"))
    return cells.select("c_custkey", "h3", bits.resolution(cell).alias("resolution"), bits.base_cell(cell).alias("base_cell"), bits.is_pentagon(cell).alias("pentagon"))


def cell_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, pentagon descendants on a deleted axis, wrong modes and plain text."""
    key = F.col("p_partkey")
    cell = bits.from_number(key, 6, 4)
    text = F.when(key % 5 == 0, F.concat(F.lit("x"), bits.to_text(cell))).when(key % 5 == 1, bits.to_text(cell.bitwiseXOR(F.lit(1 << 59).cast("long")))).when(key % 5 == 2, F.upper(bits.to_text(cell))).otherwise(bits.to_text(cell))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("h3")).select("p_partkey", "h3", bits.is_valid(bits.to_long(F.col("h3"))).alias("valid"))


def cell_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = text_cells(table(spark, sf_dir, "customer"), "c_custkey")
    cell = bits.to_long(F.col("h3"))
    return cells.select("c_custkey", *(bits.to_text(bits.parent(cell, p)).alias(f"p{p}") for p in (8, 5, 0)))


def cell_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants two levels below hexagons and, for nation 0, a pentagon."""
    nation = table(spark, sf_dir, "nation")
    cell = F.when(F.col("n_nationkey") == 0, bits.from_number(F.lit(0), 3, 14)).otherwise(bits.from_number(F.col("n_nationkey"), 3))
    return uncompact(nation.select(cell.alias("cell")), 5).groupBy(bits.to_text(bits.parent(F.col("cell"), 3)).alias("h3")).agg(F.count("*").alias("n"), F.min(bits.to_text(F.col("cell"))).alias("first"), F.max(bits.to_text(F.col("cell"))).alias("last"))


def cell_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_cells(table(spark, sf_dir, "lineitem"), "l_partkey", 7)
    return as_cells(lines).select(bits.to_text(F.col("cell")).alias("h3"))


# --- compaction


def compact_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(order_cells(spark, sf_dir))


def compact_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(order_cells(spark, sf_dir), 7)


def compact_pentagon(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = text_cells(table(spark, sf_dir, "customer"), "c_custkey", 5, 4)
    return compact(cells.filter(bits.is_valid(bits.to_long(F.col("h3")))), 1)


def ownership_from_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return ownership(cells, compact(cells, 5))


def ownership_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compact set with nested cells: the finest owner wins."""
    cells = text_cells(table(spark, sf_dir, "supplier"), "s_suppkey")
    cell = bits.to_long(F.col("h3"))
    nested = cells.select(bits.to_text(bits.parent(cell, 6)).alias("h3")).unionByName(cells.filter("s_suppkey % 3 = 0").select(bits.to_text(bits.parent(cell, 8)).alias("h3"))).distinct()
    return ownership(cells, nested)


# --- rollup


def _orders_rolled(spark: SparkSession, sf_dir: str, **fields) -> DataFrame:
    cells = order_cells(spark, sf_dir).withColumn("total", F.col("o_totalprice").cast("decimal(18,2)"))
    out = rollup(cells, compact_and_own(cells, 5), **fields)
    return out.withColumn("total", F.round("total", 2)) if "total" in out.columns else out


def rollup_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_rolled(spark, sf_dir, sum=["total"])


def rollup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_rolled(spark, sf_dir, collapse=["o_orderpriority"])


def rollup_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_rolled(spark, sf_dir, sum=["total", "o_custkey"], collapse=["o_orderstatus", "o_orderpriority"])


def rollup_null_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are null for half of the owners, and for some rows of the others."""
    cells = text_cells(table(spark, sf_dir, "customer").withColumn("place", F.expr("c_custkey + c_custkey div 88")), "place")
    cells = cells.withColumn("segment", F.when((F.floor(F.col("c_custkey") / 49) % 2 == 0) & (F.col("c_custkey") % 4 > 0), F.col("c_mktsegment")))
    return rollup(cells, compact_and_own(cells, 7), collapse=["segment", "c_nationkey"])


def reconcile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir).withColumn("one", F.lit(1))
    return reconcile(cells, rollup(cells, compact_and_own(cells, 5), sum=["one", "o_custkey"]), ["one", "o_custkey"])


def reconcile_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of sources and of owners below each ancestor of resolution 5."""
    cells = order_cells(spark, sf_dir).withColumn("one", F.lit(1))
    out = rollup(cells, compact_and_own(cells, 5), sum=["one", "o_custkey"])
    top = lambda df, c: df.withColumn("area", bits.to_text(bits.parent(bits.to_long(F.col(c)), 5)))
    return reconcile(top(cells, "h3"), top(out, "compact_h3"), ["one", "o_custkey"], ["area"])


# --- audit


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return audit(cells, compact(cells, 6)).summary.withColumn("reduction_pct", F.round("reduction_pct", 6))


def audit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return audit(cells, compact(cells, 6)).resolution


def audit_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return audit(cells, compact(cells, 6)).ownership


def audit_bad_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation without each tenth source: ownership is not whole."""
    cells = text_cells(table(spark, sf_dir, "supplier"), "s_suppkey")
    held = ownership(cells, compact(cells, 7))
    part = held.join(cells.filter("s_suppkey % 10 <> 0").select(F.col("h3").alias("source_h3")), "source_h3", "left_semi")
    return audit(cells, compact(cells, 7), part).summary.select("source_cell_n", "unmatched_source_n", "exact_reconstruction", "ownership_integrity")


def audit_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compact set with nested cells that covers more than the source."""
    cells = text_cells(table(spark, sf_dir, "supplier"), "s_suppkey")
    cell = bits.to_long(F.col("h3"))
    nested = cells.select(bits.to_text(bits.parent(cell, 6)).alias("h3")).unionByName(cells.filter("s_suppkey % 3 = 0").select(bits.to_text(bits.parent(cell, 8)).alias("h3"))).distinct()
    return audit(cells, nested).summary.select("source_cell_n", "compact_cell_n", "roundtrip_missing_n", "roundtrip_additional_n", "hierarchy_overlap_n", "exact_reconstruction", "hierarchy_integrity", "ownership_integrity")


QUERIES = {
    f.__name__: f
    for f in (
        cell_decode, cell_valid, cell_parent, cell_children, cell_distinct, compact_native, compact_floor, compact_pentagon, ownership_from_compact, ownership_foreign,
        rollup_sum, rollup_collapse, rollup_mixed, rollup_null_collapse, reconcile_global, reconcile_by_parent, audit_summary, audit_resolution, audit_ownership, audit_bad_lookup, audit_overlapping,
    )
}


# --- SQL


def _number(key: str, res: int, base: int = 95) -> str:
    digits = " + ".join(f"(((({key}) // {7 ** (res - i)}) % 7)::BIGINT << {3 * (15 - i)})" for i in range(1, res + 1))
    return f"({(1 << 59) | (res << 52) | (base << 45) | ((1 << 3 * (15 - res)) - 1)}::BIGINT + {digits})"


def _parent(c: str, p: int) -> str:
    return f"((({c}) & {~(15 << 52)}::BIGINT) | {(p << 52) | ((1 << 3 * (15 - p)) - 1)}::BIGINT)"


def _hex(c: str) -> str:
    return f"printf('%x', {c})"


def _res(c: str) -> str:
    return f"((({c}) >> 52) & 15)::INT"


_ORDERS = f"orders_c AS (SELECT *, {_number('(o_orderkey + o_orderkey // 96)', 9)} AS c FROM orders)"


def _owners(cells: str, res: int, floor: int, pentagon: bool = False) -> str:
    """CTEs that give ``own(c, o)`` for ``cells(c)``: the coarsest full ancestor."""
    full = lambda p: f"{7 ** (res - p)}" if not pentagon else f"CASE WHEN {_parent('c', p)} = {_parent(_number('0', res, 4), p)} THEN {1 + 5 * (7 ** (res - p) - 1) // 6} ELSE {7 ** (res - p)} END"
    parts = []
    for p in range(floor, res):
        parts.append(f"f{p} AS (SELECT a FROM (SELECT {_parent('c', p)} AS a, {full(p)} AS k FROM {cells}) GROUP BY a HAVING count(*) = min(k))")
    joins = " ".join(f"LEFT JOIN f{p} ON f{p}.a = {_parent('s.c', p)}" for p in range(floor, res))
    owner = "coalesce(" + ", ".join([*(f"f{p}.a" for p in range(floor, res)), "s.c"]) + ")"
    parts.append(f"own AS (SELECT s.c, {owner} AS o FROM {cells} s {joins})")
    return ", ".join(parts)


_RELATION = f"rel AS (SELECT c, o, {_hex('c')} AS source_h3, {_res('c')} AS source_resolution, {_hex('o')} AS compact_h3, {_res('o')} AS compact_resolution, CASE WHEN c = o THEN 'exact' ELSE 'ancestor' END AS relationship FROM own)"
_PUBLIC = "SELECT source_h3, source_resolution, compact_h3, compact_resolution, relationship FROM rel"
_COLLAPSE = "string_agg(DISTINCT {0}::VARCHAR, '; ' ORDER BY {0}::VARCHAR) AS {1}, count(DISTINCT {0})::INT AS {1}_n"
_NESTED = f"""supp AS (SELECT s_suppkey, {_number('s_suppkey', 9)} AS c FROM supplier),
  nest AS (SELECT DISTINCT {_parent('c', 6)} AS c FROM supp UNION SELECT {_parent('c', 8)} FROM supp WHERE s_suppkey % 3 = 0)"""


def _valid_sql(c: str, res: int) -> str:
    digit = lambda i: f"(({c} >> {3 * (15 - i)}) & 7)"
    lead = "CASE " + " ".join(f"WHEN {digit(i)} <> 0 THEN {digit(i)}" for i in range(1, res + 1)) + " ELSE 0 END"
    return f"({lead} <> 1)"


_SUMMED = f"SELECT compact_h3, compact_resolution, count(*)::INT AS source_cell_n, {{}} FROM rel JOIN orders_c USING (c) GROUP BY compact_h3, compact_resolution"
_AUDIT6 = f"WITH {_ORDERS}, {_owners('orders_c', 9, 6)}, {_RELATION}"

SQL = {
    "cell_decode": f"SELECT c_custkey, {_hex('c')} AS h3, {_res('c')} AS resolution, ((c >> 45) & 127)::INT AS base_cell, false AS pentagon FROM (SELECT c_custkey, {_number('c_custkey', 9)} AS c FROM customer)",
    "cell_valid": f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'x' || {_hex('c')} WHEN 1 THEN {_hex(f'xor(c, {1 << 59}::BIGINT)')} WHEN 2 THEN upper({_hex('c')}) ELSE {_hex('c')} END AS h3,
      p_partkey % 5 > 1 AND {_valid_sql('c', 6)} AS valid FROM (SELECT p_partkey, {_number('p_partkey', 6, 4)} AS c FROM part)""",
    "cell_parent": f"SELECT c_custkey, {', '.join(f'{_hex(_parent("c", p))} AS p{p}' for p in (8, 5, 0))} FROM (SELECT c_custkey, {_number('c_custkey', 9)} AS c FROM customer)",
    "cell_children": f"""WITH n AS (SELECT CASE WHEN n_nationkey = 0 THEN {_number('0', 3, 14)} ELSE {_number('n_nationkey', 3)} END AS c, n_nationkey = 0 AS pent FROM nation),
      k AS (SELECT c, pent, (c & {~(15 << 52) & ~((1 << 36) - 1)}::BIGINT) | {(5 << 52) | ((1 << 30) - 1)}::BIGINT | ((i // 7)::BIGINT << 33) | ((i % 7)::BIGINT << 30) AS d, i FROM n, range(49) t(i))
      SELECT {_hex('c')} AS h3, count(*) AS n, min({_hex('d')}) AS first, max({_hex('d')}) AS last FROM k WHERE NOT (pent AND (CASE WHEN i // 7 > 0 THEN i // 7 ELSE i % 7 END) = 1) GROUP BY c""",
    "cell_distinct": f"SELECT DISTINCT {_hex(_number('l_partkey', 7))} AS h3 FROM lineitem",
    "compact_native": f"WITH {_ORDERS}, {_owners('orders_c', 9, 0)} SELECT DISTINCT {_hex('o')} AS h3 FROM own",
    "compact_floor": f"WITH {_ORDERS}, {_owners('orders_c', 9, 7)} SELECT DISTINCT {_hex('o')} AS h3 FROM own",
    "compact_pentagon": f"WITH cust AS (SELECT c FROM (SELECT {_number('c_custkey', 5, 4)} AS c FROM customer) WHERE {_valid_sql('c', 5)}), {_owners('cust', 5, 1, True)} SELECT DISTINCT {_hex('o')} AS h3 FROM own",
    "ownership_from_compact": f"WITH {_ORDERS}, {_owners('orders_c', 9, 5)}, {_RELATION} {_PUBLIC}",
    "ownership_foreign": f"WITH {_NESTED}, own AS (SELECT s.c, coalesce(x.c, y.c) AS o FROM supp s LEFT JOIN nest x ON x.c = {_parent('s.c', 8)} LEFT JOIN nest y ON y.c = {_parent('s.c', 6)}), {_RELATION} {_PUBLIC}",
    "rollup_sum": f"WITH {_ORDERS}, {_owners('orders_c', 9, 5)}, {_RELATION} " + _SUMMED.format("sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total"),
    "rollup_collapse": f"WITH {_ORDERS}, {_owners('orders_c', 9, 5)}, {_RELATION} " + _SUMMED.format(_COLLAPSE.format("o_orderpriority", "o_orderpriority")),
    "rollup_mixed": f"WITH {_ORDERS}, {_owners('orders_c', 9, 5)}, {_RELATION} "
    + _SUMMED.format("sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, sum(o_custkey)::DOUBLE AS o_custkey, " + _COLLAPSE.format("o_orderstatus", "o_orderstatus") + ", " + _COLLAPSE.format("o_orderpriority", "o_orderpriority")),
    "rollup_null_collapse": f"""WITH cust AS (SELECT *, {_number('(c_custkey + c_custkey // 88)', 9)} AS c, CASE WHEN (c_custkey // 49) % 2 = 0 AND c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer),
      {_owners('cust', 9, 7)}, {_RELATION} SELECT compact_h3, compact_resolution, count(*)::INT AS source_cell_n, {_COLLAPSE.format('segment', 'segment')}, {_COLLAPSE.format('c_nationkey', 'c_nationkey')} FROM rel JOIN cust USING (c) GROUP BY compact_h3, compact_resolution""",
    "reconcile_global": "SELECT 'one' AS field, count(*)::DOUBLE AS source_total, count(*)::DOUBLE AS owner_total FROM orders UNION ALL SELECT 'o_custkey', sum(o_custkey)::DOUBLE, sum(o_custkey)::DOUBLE FROM orders",
    "reconcile_by_parent": f"""WITH {_ORDERS}, g AS (SELECT {_hex(_parent('c', 5))} AS area, count(*)::DOUBLE AS n, sum(o_custkey)::DOUBLE AS k FROM orders_c GROUP BY area)
      SELECT area, 'one' AS field, n AS source_total, n AS owner_total FROM g UNION ALL SELECT area, 'o_custkey', k, k FROM g""",
    "audit_summary": f"""{_AUDIT6} SELECT count(*) AS source_cell_n, count(DISTINCT o) AS compact_cell_n, count(*) - count(DISTINCT o) AS reduction_n, round(100.0 * (count(*) - count(DISTINCT o)) / count(*), 6)::DOUBLE AS reduction_pct,
      9::INT AS source_resolution, min(compact_resolution) AS compact_resolution_min, max(compact_resolution) AS compact_resolution_max, count(*) FILTER (c = o) AS exact_source_n, count(*) FILTER (c <> o) AS ancestor_source_n,
      0::BIGINT AS unmatched_source_n, 0::BIGINT AS roundtrip_missing_n, 0::BIGINT AS roundtrip_additional_n, 0::BIGINT AS hierarchy_overlap_n, true AS exact_reconstruction, true AS hierarchy_integrity, true AS ownership_integrity FROM rel""",
    "audit_resolution": f"{_AUDIT6} SELECT compact_resolution, count(DISTINCT o)::INT AS compact_cell_n FROM rel GROUP BY compact_resolution",
    "audit_ownership": f"{_AUDIT6} SELECT relationship, compact_resolution, count(*)::INT AS source_cell_n FROM rel GROUP BY relationship, compact_resolution",
    "audit_bad_lookup": "SELECT count(*) AS source_cell_n, count(*) FILTER (s_suppkey % 10 = 0) AS unmatched_source_n, true AS exact_reconstruction, false AS ownership_integrity FROM supplier",
    "audit_overlapping": f"""WITH {_NESTED}, over AS (SELECT count(*) AS n FROM nest x JOIN nest y ON {_res('x.c')} = 8 AND {_res('y.c')} = 6 AND {_parent('x.c', 6)} = y.c),
      cover AS (SELECT sum(343) AS n FROM nest WHERE {_res('c')} = 6)
      SELECT (SELECT count(*) FROM supp) AS source_cell_n, (SELECT count(*) FROM nest) AS compact_cell_n, 0::BIGINT AS roundtrip_missing_n, ((SELECT n FROM cover) - (SELECT count(*) FROM supp))::BIGINT AS roundtrip_additional_n,
      (SELECT n FROM over) AS hierarchy_overlap_n, false AS exact_reconstruction, false AS hierarchy_integrity, true AS ownership_integrity""",
}
