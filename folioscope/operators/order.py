"""Exact global ranks and order statistics, and digests of whole tables, without a task that holds a group.

Rows are dealt by ranges of (group, order); each range numbers its own rows, and the sizes of earlier ranges of the group are added. Only
groups that cross a range's end have any, so that two rows for each range are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.tables import stored

#: Rows of a leaf of a digest, about.
LEAF_ROWS = 1000


def _ranged(df: DataFrame, by: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """df in ranges (_part; _tie numbers rows of equal order), and (by, _part, _size, _before, _all) of each range's piece of a group."""
    ranged = stored(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*map(F.col, by), *order, "_tie").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*by)  # pieces, not rows
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).withColumn("_all", F.sum("_size").over(group))


def placed(df: DataFrame, by: list[str], *order: Column, name: str = "place") -> DataFrame:
    """df with each row's number from 0 in its group's order; rows of equal order are numbered as they are stored."""
    ranged, pieces = _ranged(df, by, list(order))
    carried = F.broadcast(pieces.where("_before > 0").select(*by, "_part", "_before"))  # a row for each range at most
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order, "_tie")) - 1
    null_safe = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_part")]
    rows = ranged.withColumn(name, own.cast("long")).alias("l").join(carried.alias("r"), null_safe, "left")
    return rows.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{name}") + F.coalesce(F.col("r._before"), F.lit(0))).alias(name))


def running_sum(df: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
    """df with the sum of value up to each row in order; rows of equal order are taken as they are stored."""
    ranged, _ = _ranged(df, [], list(order))
    pieces = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = F.broadcast(pieces.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, own).join(carried, "_part").select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def order_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, float], between: tuple[str, ...] = ()) -> DataFrame:
    """by and, for each name and share, the sorted values' element at floor(share * (n - 1)); those named in between are interpolated with the next one, so
    that a share of a half is the median. Nulls aren't values, and a group without any has no row.

    Only pieces that hold such an element are numbered.
    """
    ranged, pieces = _ranged(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), by, [F.col("_v")])
    at = {n: F.lit(s) * (F.col("_all") - 1) for n, s in shares.items()}
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(side).alias("side"), f(at[n]).cast("long").alias("place")) for n in shares for side, f in ((0, F.floor), (1, F.ceil)) if not side or n in between])
    asked = pieces.withColumn("_w", F.explode(wanted)).where((F.col("_w.place") >= F.col("_before")) & (F.col("_w.place") < F.col("_before") + F.col("_size")))
    asked = stored(asked.select(*by, "_part", "_all", F.col("_w.name").alias("_name"), F.col("_w.side").alias("_side"), (F.col("_w.place") - F.col("_before")).alias("_own")))
    same = lambda *c: [F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")) for x in c]
    held = ranged.alias("l").join(asked.select(*by, "_part").distinct().alias("r"), same(*by, "_part"), "left_semi")
    numbered = held.withColumn("_own", (F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_v", "_tie")) - 1).cast("long"))
    found = numbered.alias("l").join(asked.alias("r"), same(*by, "_part", "_own")).select(*[F.col(f"l.{c}") for c in (*by, "_v")], "_all", "_name", "_side")
    pick = lambda n, side: F.max(F.when((F.col("_name") == n) & (F.col("_side") == side), F.col("_v")))
    low = {n: pick(n, 0) for n in shares}
    part = {n: F.max(at[n] - F.floor(at[n])) for n in between}
    out = [((low[n] + (pick(n, 1) - low[n]) * part[n]) if n in between else low[n]).alias(n) for n in shares]
    return found.groupBy(*by).agg(*out)


def row_text(columns: list[str]) -> Column:
    """A row as text, whatever the order of its columns: name=value in the order of names, with a sign of its own for null."""
    return F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) for c in sorted(columns)])


def table_digest(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(digest, rows) of a table, one row: the root of a tree of SHA-256 over its whole rows. Leaves are ranges of the rows' own digests, of leaf_rows about; a node
    digests its sixteen children in order. Any changed cell, column name or repetition changes it; the order of rows and columns and the partitions don't.

    A leaf has each digest once, with how often it occurs, so that repeated rows make none large. An empty table has the digest of an empty text.
    """
    each = stored(df.select(F.sha2(row_text(df.columns), 256).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_n")))
    distinct, rows = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    depth = 0
    while 16**depth * leaf_rows < distinct:
        depth += 1
    node = each.select(F.substring("_d", 1, depth).alias("_p"), F.concat_ws(":", "_d", "_n").alias("_t"))
    for level in range(depth, -1, -1):
        joined = F.array_join(F.sort_array(F.collect_list("_t")), ",")
        node = node.groupBy(F.substring("_p", 1, level).alias("_p")).agg(F.sha2(joined, 256).alias("_t")).select("_p", F.concat_ws(":", "_p", "_t").alias("_t"))
    root = node.select(F.substring_index("_t", ":", -1).alias("digest")) if rows else df.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("digest"))
    return root.withColumn("rows", F.lit(rows).cast("long"))
