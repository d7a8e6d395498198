"""Positions and running aggregates along a total order of a whole table, without a window over one partition.

Rows are range-partitioned by the order and written once; a partition's totals are one row each, and their running values, one row a
partition, are what the driver sees. Each row then adds what came before its partition to its running value within it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

#: monotonically_increasing_id() counts rows of a partition in its lower bits.
ROW_BITS = 33
COMBINED: dict[str, Callable] = {"sum": lambda a, b: a + b, "min": min, "max": max}


def _merged(how: str, a, b):
    """Of two partial values, either of them None where it saw no value."""
    return b if a is None else a if b is None else COMBINED[how](a, b)


def running(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), position: str | None = "position", partitions: int | None = None, **values: tuple[str, str]) -> DataFrame:
    """``df`` with ``position`` (from 1) and running ``values`` (name: (sum, min or max; column)), each row's own included, along ``order``.

    With ``by``, each group of these columns has positions and values of its own; a group may spread over any number of partitions.
    ``order`` must tell rows apart, or rows that tie (and then are of one partition) stand in any order. Running values skip nulls and
    are null until the first value. Sums of doubles are added partition by partition, so their last bits depend on the partitions; sums
    of integers and decimals do not. Rows are written once to the shared folder, so an executor that is lost changes nothing, and
    select only the columns you need. Empty tables give empty results. Columns of ``df`` named like a new one are replaced."""
    fixed = [F.col(c) for c in by]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*([position] if position else []), *values]
    rows = df.drop(*(x for x in names if x not in {c for _, c in values.values()} and x not in by))
    dealt = kept(rows.repartitionByRange(n, *fixed, *order).sortWithinPartitions(*fixed, *order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", ROW_BITS))
    own = [F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last"), *(getattr(F, how)(c).alias(f"_t_{name}") for name, (how, c) in values.items())]
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    totals = dealt.groupBy("_part", *by).agg(*own).withColumn("_group", group)
    # only a partition's last group goes on in the next one: one row a partition
    ends = totals.groupBy("_part").agg(F.max_by(F.struct("_group", "_n", *[f"_t_{v}" for v in values]), "_last").alias("_end"), F.count(F.lit(1)).alias("_groups")).orderBy("_part").collect()
    carried, offsets = None, []
    for r in ends:
        e = r["_end"]
        if carried is not None:
            offsets.append((r["_part"], *carried))
        mine = (e["_group"], e["_n"], *[e[f"_t_{v}"] for v in values])
        if carried is not None and r["_groups"] == 1 and carried[0] == e["_group"]:
            mine = (e["_group"], carried[1] + e["_n"], *[_merged(how, old, new) for (how, _), old, new in zip(values.values(), carried[2:], mine[2:], strict=True)])
        carried = mine
    kinds = {f.name: f.dataType.simpleString() for f in totals.schema}
    schema = f"_p long, _g {kinds['_group']}, _before long" + "".join(f", `_b_{v}` {kinds[f'_t_{v}']}" for v in values)
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    joined = dealt.join(before, (F.col("_part") == F.col("_p")) & group.eqNullSafe(F.col("_g")), "left")
    first = F.min("_at").over(Window.partitionBy("_part", *by)) if by else F.shiftleft("_part", ROW_BITS)
    ahead = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined
    for name, (how, c) in values.items():
        inner = getattr(F, how)(c).over(ahead)
        total = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}[how]
        out = out.withColumn(f"_r_{name}", total(F.col(f"_b_{name}"), inner))
    plain = [c for c in rows.columns if c not in names]
    place = [(F.col("_at") - first + F.coalesce(F.col("_before"), F.lit(0)) + 1).alias(position)] if position else []
    return out.select(*plain, *place, *[F.col(f"_r_{v}").alias(v) for v in values])
