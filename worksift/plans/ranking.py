"""Exact positions and quantiles that never gather a group, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksift.plans.storage import written

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def global_rank(
    df: DataFrame, order: Sequence[Column], name: str, ranges: Sequence[Column] | None = None
) -> DataFrame:
    """Dense 1..N over a total order.

    One range shuffle sorts the rows; each row stores its partition and place; the partitions'
    sizes (one row per partition) turn places into ranks. The sorted rows are written first, so
    the positions are read, never recomputed. ``ranges`` cuts the partitions by something shorter
    that sorts the same way, such as the beginning of a long text.
    """
    placed = written(
        df.repartitionByRange(*(ranges or order))
        .sortWithinPartitions(*order)
        .withColumn("_sorted_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_sorted_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_sorted_part")).agg(F.count("*").alias("_sorted_rows"))
    before = Window.orderBy("_sorted_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_sorted_part", F.coalesce(F.sum("_sorted_rows").over(before), F.lit(0)).alias("_sorted_start"))
    row = F.col("_sorted_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_sorted_part", part)
        .join(F.broadcast(starts), "_sorted_part")  # one row per partition
        .withColumn(name, (F.col("_sorted_start") + row + 1).cast("bigint"))
        .drop("_sorted_part", "_sorted_at", "_sorted_start")
    )


_BLOCK_ROWS = 100_000


def running_totals(df: DataFrame, position: str, totals: dict[str, str]) -> DataFrame:
    """Adds running sums in order of ``position`` (a dense 1..N): ``totals`` maps each new column
    to the column it adds up. Rows are summed in blocks, and only block sums in one line."""
    blocked = df.withColumn("_block", F.floor((F.col(position) - 1) / _BLOCK_ROWS))
    sums = blocked.groupBy("_block").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_block", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in totals]
    )
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(starts, "_block")
    for name, column in totals.items():
        out = out.withColumn(name, F.col(f"_start_{name}") + F.sum(column).over(inside))
    return out.drop("_block", *[f"_start_{n}" for n in totals])


def position_blocks(df: DataFrame, dense: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``block, rows, start``: how the rows of ``df`` spread over blocks of the whole number
    ``dense``, and how many come before each block. Extra ``sums`` are added up per block."""
    block = F.floor((F.col(dense) - 1) / _BLOCK_ROWS).alias("block")
    extra = [c.alias(n) for n, c in (sums or {}).items()]
    counts = df.groupBy(block).agg(F.count("*").alias("rows"), *extra)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def block_ranks(first: int, last: int) -> tuple[int, int]:
    """The lowest and the highest rank of a run of blocks."""
    return first * _BLOCK_ROWS + 1, (last + 1) * _BLOCK_ROWS


def dense_position(df: DataFrame, dense: str, blocks: DataFrame, name: str) -> DataFrame:
    """Place of each row among those of ``df`` in the order of ``dense``, a rank it already has.
    Rows need not be sorted as a whole: a block holds at most as many rows as it has ranks. Only
    rows of the given ``blocks`` are returned."""
    inside = Window.partitionBy("block").orderBy(dense)
    return (
        df.withColumn("block", F.floor((F.col(dense) - 1) / _BLOCK_ROWS))
        .join(blocks.select("block", "start"), "block")
        .withColumn(name, F.col("start") + F.row_number().over(inside))
        .drop("block", "start")
    )


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1..n inside each key, null keys included, however large one key is."""
    ranked = global_rank(df, [*[F.col(k) for k in keys], *order], name)
    starts = ranked.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min(name).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return (
        ranked.join(starts, on=same)
        .withColumn(name, F.col(name) - F.col("_first") + 1)
        .drop("_first", *[f"_key_{k}" for k in keys])
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    names: dict[str, int],
    *,
    accuracy: int = 10_000,
    small: int = 100_000,
) -> DataFrame:
    """Exact quartiles of ``value`` per key, by the exclusive (n+1) method.

    ``names`` maps an output column to 1, 2 or 3 quarters; 2 is the usual median. A mergeable
    sketch brackets each wanted position of a group larger than ``small`` rows, and only the
    distinct values inside a bracket are sorted. A bracket of more than ``small`` rows is sketched
    again, until it is smaller or holds a few values that repeat, so what is sorted does not grow
    with the group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    margin = 4.0 / accuracy
    spots = sorted(set(names.values()))
    edges = [e for q in spots for e in (max(0.0, q / 4 - margin), min(1.0, q / 4 + margin))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx(value, F.array(*[F.lit(e) for e in edges]), accuracy).alias("_edge"),
    )
    # One row per key: written, so that it is broadcast when it is small and the rows of a large
    # group need not be brought together.
    sketch = written(sketch, "sketch")
    if (sketch.agg(F.max("_n")).first()[0] or 0) * 2 * margin > small:
        sketch = _narrowed(rows, sketch, keys, value, spots, accuracy, small)
    if keys:
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        joined = rows.alias("r").join(sketch.alias("s"), on=same).drop(*[F.col(f"s.{k}") for k in keys])
    else:
        joined = rows.crossJoin(F.broadcast(sketch))  # a single row
    v = F.col(value)
    wide = F.col("_n") <= small
    inside, below = {}, {}
    for i, q in enumerate(spots):
        low, high = F.col("_edge")[2 * i], F.col("_edge")[2 * i + 1]
        inside[q] = wide | ((v >= low) & (v <= high))
        below[q] = ~wide & (v < low)
    any_inside = F.lit(False)
    for q in spots:
        any_inside = any_inside | inside[q]

    under = joined.groupBy(*keys).agg(
        F.first("_n").alias("_n"), *[F.count_if(below[q]).alias(f"_below{q}") for q in spots]
    )
    counted = (
        joined.where(any_inside)
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_c"), *[F.first(inside[q]).alias(f"_in{q}") for q in spots])
    )
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = counted.select(
        *keys,
        value,
        *[F.col(f"_in{q}") for q in spots],
        *[F.sum(F.when(F.col(f"_in{q}"), F.col("_c")).otherwise(0)).over(upto).alias(f"_cum{q}") for q in spots],
    )
    if keys:
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
        placed = running.alias("c").join(under.alias("u"), on=same).drop(*[F.col(f"u.{k}") for k in keys])
    else:
        placed = running.crossJoin(F.broadcast(under))  # a single row
    n = F.col("_n")
    aggregates = [F.first("_n").alias("_n")]
    for q in spots:
        at = _position(q, n)
        reached = F.col(f"_below{q}") + F.col(f"_cum{q}")
        for label, rank in (("a", at), ("b", F.least(at + 1, n))):
            hit = F.col(f"_in{q}") & (reached >= rank) & (F.col(f"_below{q}") < rank)
            aggregates.append(F.min(F.when(hit, v)).alias(f"_{label}{q}"))
    picked = placed.groupBy(*keys).agg(*aggregates)
    out = []
    for name, q in names.items():
        at = _position(q, n)
        share = q * (n + 1) - 4 * at
        a, b = F.col(f"_a{q}"), F.col(f"_b{q}")
        exact = F.when(n == 1, a).otherwise((a * (4 - share) + b * share) / 4)
        missing = F.raise_error(F.lit("quantile outside its bracket; raise the accuracy"))
        lost = (n > 0) & (a.isNull() | b.isNull())
        out.append(F.when(lost, missing.cast("double")).otherwise(exact).alias(name))
    return picked.select(*keys, *out)


_GRID = 64  # values that a bracket is cut at


def _narrowed(
    rows: DataFrame, sketch: DataFrame, keys: Sequence[str], value: str, spots: Sequence[int], accuracy: int, small: int
) -> DataFrame:
    """``sketch`` with brackets (``_edge``) of at most ``small`` rows, or as narrow as repeated values let
    them be. Each round counts the rows below and inside every bracket and takes 65 quantiles of the
    inside; the two around the wanted position, and one more on either side, are the next bracket."""
    grid = F.array(*[F.lit(k / _GRID) for k in range(_GRID + 1)])
    v = F.col(value)
    while True:
        if keys:
            same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
            met = rows.alias("r").join(sketch.alias("s"), on=same).drop(*[F.col(f"s.{k}") for k in keys])
        else:
            met = rows.crossJoin(F.broadcast(sketch))  # a single row
        counts = [F.first("_n").alias("_n"), F.first("_edge").alias("_edge")]
        for i, q in enumerate(spots):
            inside = v.between(F.col("_edge")[2 * i], F.col("_edge")[2 * i + 1])
            counts += [
                F.count_if(v < F.col("_edge")[2 * i]).alias(f"_below{q}"),
                F.count_if(inside).alias(f"_inside{q}"),
                F.percentile_approx(F.when(inside, v), grid, max(accuracy, 4 * _GRID)).alias(f"_grid{q}"),
            ]
        counted = met.groupBy(*keys).agg(*counts)
        edges = []
        for i, q in enumerate(spots):
            at = (_position(q, F.col("_n")) - F.col(f"_below{q}")) / F.greatest(F.col(f"_inside{q}"), F.lit(1)) * _GRID
            low = F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")
            high = F.least(F.ceil(at) + 2, F.lit(_GRID)).cast("int")
            wide = F.col(f"_inside{q}") > small
            edges += [
                F.when(wide, F.col(f"_grid{q}")[low]).otherwise(F.col("_edge")[2 * i]),
                F.when(wide, F.col(f"_grid{q}")[high]).otherwise(F.col("_edge")[2 * i + 1]),
            ]
        known = counted.select(*keys, "_n", F.array(*edges).alias("_next"), "_edge")
        known = written(known, "sketch")
        moved = known.where(F.col("_next") != F.col("_edge"))
        sketch = known.select(*keys, "_n", F.col("_next").alias("_edge"))
        if moved.isEmpty():
            return sketch


def _position(quarter: int, n: Column) -> Column:
    at = F.floor(quarter * (n + 1) / 4)
    return F.greatest(F.lit(1), F.least(at, n - 1)).cast("bigint")
