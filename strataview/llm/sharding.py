"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash of id and text within each source, their rank becomes
a fraction of the source, and all rows are ordered by that fraction and cut into equal
runs. So every shard has the mixture of the whole, and counts differ by one at most (law
``rows``).

No window spans a source or the table, and none meets a hot id or text. Rows that are
equal in all that is ranked are counted before the first shuffle and dealt out again, in
runs of at most ``RUN``, once their ranks are known. Ranks come from counts per (source,
hash prefix), summed in two steps of at most ``STEP`` numbers each, and positions from
counts per slice of the fraction, likewise bounded, plus a row number within one such
cell. The texts are read once; what follows works on a small table in the shared folder.

A null source is a source of its own, null ids and texts count as empty, equal rows take
neighbouring places in their source. The result has the named columns only. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

STEP = 256
SLICES = 1 << 14
RUN = 4096
SEED = "shard-1"
_OWN = ["stratum", "h", "doc_id", "text_crc32", "size", "source"]
_TIES = ["h", "doc_id", "text_crc32", "size"]


def _ahead(n: str, order: str, *by: str) -> Column:
    """The sum of ``n`` over the rows before this one."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(before), F.lit(0))


def interleave(
    df: DataFrame,
    n_shards: int = 16,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, text_crc32, fraction, position, shard, slot`` per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    hashed = small.withColumn("h", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    # Equal rows become one row with their number, before anything is shuffled.
    rows = staged(hashed.groupBy(*_OWN).agg(F.count(F.lit(1)).alias("n")).withColumn("prefix", F.shiftright("h", 44).cast("int")))

    # Counts per prefix, then per STEP prefixes: no window holds more than STEP rows.
    cells = rows.groupBy("stratum", "prefix").agg(F.sum("n").alias("n")).withColumn("step", F.expr(f"prefix div {STEP}").cast("int"))
    steps = cells.groupBy("stratum", "step").agg(F.sum("n").alias("n"))
    steps = steps.select("stratum", "step", _ahead("n", "step", "stratum").alias("step_ahead"), F.sum("n").over(Window.partitionBy("stratum")).alias("n_source"))
    cells = cells.select("stratum", "prefix", "step", _ahead("n", "prefix", "stratum", "step").alias("ahead")).join(steps, ["stratum", "step"])
    cells = cells.select("stratum", "prefix", (F.col("ahead") + F.col("step_ahead")).alias("before"), "n_source")

    within = Window.partitionBy("stratum", "prefix").orderBy(*_TIES).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(cells, ["stratum", "prefix"]).withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    # Equal rows are dealt out in two steps, so that no task writes all copies of a hot one.
    runs = ranked.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    hot = runs.where(F.col("n") > RUN).repartition("h", "run")
    dealt = hot.unionByName(runs.where(F.col("n") <= RUN)).withColumn(
        "copy", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n")) - 1))
    )
    fraction = (F.col("first") + F.col("copy") + F.lit(0.5)) / F.col("n_source")
    placed = staged(dealt.select(*_OWN, fraction.alias("fraction")).withColumn("slice", F.floor(F.col("fraction") * SLICES).cast("int")))

    # At most SLICES rows: a broadcast of proven size.
    counts = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.expr(f"slice div {STEP}").cast("int"))
    steps = counts.groupBy("step").agg(F.sum("n").alias("n"))
    steps = steps.select("step", _ahead("n", "step").alias("step_ahead"), F.sum("n").over(Window.partitionBy()).alias("n_all"))
    slices = counts.withColumn("ahead", _ahead("n", "slice", "step")).join(F.broadcast(steps), "step")
    slices = slices.select("slice", (F.col("ahead") + F.col("step_ahead")).alias("ahead"), "n_all")
    place = F.row_number().over(Window.partitionBy("slice").orderBy("fraction", "stratum", *_TIES))
    placed = placed.join(F.broadcast(slices), "slice").withColumn("position", F.col("ahead") + place - 1)
    shard = F.expr(f"position * {n_shards} div n_all")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        "fraction",
        "position",
        "shard",
        (F.col("position") - F.expr(f"(shard * n_all + {n_shards} - 1) div {n_shards}")).alias("slot"),
    )
