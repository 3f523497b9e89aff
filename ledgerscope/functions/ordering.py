"""Order-dependent aggregates that never put an unbounded group into one task.

A plain window over a hot key (one address in a third of all rows) or over the whole table runs in
one task. Here a key with many rows is cut into buckets of its order column. Bucket totals are small; a window over
the totals gives each bucket its starting value, and the detailed window runs per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import pin

DAY = 86400
#: Rows of one key from which on it is cut into buckets.
CROWD = 100_000


def crowded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with so many rows that a window over one of them would be too long for a task: at most a row per ``CROWD`` rows of ``df``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= CROWD).select(*keys)


def pieces(df: DataFrame, keys: Sequence[str], bucket: Column, crowd: DataFrame) -> DataFrame:
    """``df`` with ``_b``, the bucket of rows whose key is in ``crowd`` and NULL for all others, whose key is one piece. Rows without key or bucket go."""
    known = df.where(bucket.isNotNull() & F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    hot = F.broadcast(crowd.select(*keys, F.lit(True).alias("_hot")))
    return known.join(hot, list(keys), "left").select(*df.columns, F.when(F.col("_hot"), bucket).alias("_b"))


def _wanted(sums: Mapping[str, str] | None, mins: Mapping[str, str] | None, maxs: Mapping[str, str] | None) -> list[tuple]:
    return [(out, src, fn) for group, fn in ((sums, F.sum), (mins, F.min), (maxs, F.max)) for out, src in (group or {}).items()]


def before_in_piece(cut: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str] | None = None,
                    mins: Mapping[str, str] | None = None, maxs: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``_l_<out>``: the aggregate over the earlier rows of the same piece."""
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("*", *[fn(src).over(w).alias(f"_l_{out}") for out, src, fn in _wanted(sums, mins, maxs)])


def piece_starts(cut: DataFrame, keys: Sequence[str], sums: Mapping[str, str] | None = None, mins: Mapping[str, str] | None = None,
                 maxs: Mapping[str, str] | None = None) -> DataFrame:
    """``_s_<out>`` per piece of the crowded keys: the aggregate over their earlier pieces."""
    wanted = _wanted(sums, mins, maxs)
    totals = cut.where("_b IS NOT NULL").groupBy(*keys, "_b").agg(*[fn(src).alias(f"_t_{out}") for out, src, fn in wanted])
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_b", *[fn(f"_t_{out}").over(over).alias(f"_s_{out}") for out, _, fn in wanted])


def from_starts(local: DataFrame, starts: DataFrame, keys: Sequence[str], sums: Mapping[str, str] | None = None,
                mins: Mapping[str, str] | None = None, maxs: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of ``before_in_piece`` with the values over all earlier rows of the key in place of those of the piece."""
    wanted = _wanted(sums, mins, maxs)
    joined = local.join(starts, [*keys, "_b"], "left")
    values = []
    for out, _, fn in wanted:
        start, inside = F.col(f"_s_{out}"), F.col(f"_l_{out}")
        value = (F.coalesce(start, F.lit(0)) + F.coalesce(inside, F.lit(0)) if fn is F.sum
                 else F.least(start, inside) if fn is F.min else F.greatest(start, inside))
        values.append(value.alias(out))
    gone = {"_b", *[f"_l_{out}" for out, _, _ in wanted]}
    return joined.select(*[c for c in local.columns if c not in gone], *values)


def running_before(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                   sums: Mapping[str, str] | None = None, mins: Mapping[str, str] | None = None,
                   maxs: Mapping[str, str] | None = None, crowd: DataFrame | None = None) -> DataFrame:
    """Add, per row, the sum/min/max of a column over all strictly earlier rows of its key.

    ``sums`` etc. map an output name to a source column. ``bucket`` must not decrease along ``order``,
    and ``(keys, order)`` must be unique. Only crowded keys are cut into buckets, so rows are shuffled once;
    ``crowd`` gives these keys where they are known from less than ``df``.
    """
    wanted = {"sums": sums, "mins": mins, "maxs": maxs}
    cut = pieces(df, keys, bucket, crowded(df, keys) if crowd is None else crowd)
    return from_starts(before_in_piece(cut, keys, order, **wanted), piece_starts(cut, keys, **wanted), keys, **wanted)


def prefix_totals(df: DataFrame, coarse: Column, fine: Column, order: Sequence[str], measures: Sequence[str],
                  keys: Sequence[str] = ()) -> DataFrame:
    """Add ``before_<m>`` for each measure: its total over all earlier rows of ``keys`` in ``order``.

    ``coarse`` and ``fine`` refine the order (hour, then second with id prefix). Rows are summed per fine
    group before any shuffle; fine totals are accumulated inside their coarse group, and only the
    coarse totals, of which there are few, are seen as a whole.
    """
    keys = list(keys)
    tagged = df.select("*", coarse.alias("_c"), fine.alias("_f"))
    cells = tagged.groupBy(*keys, "_c", "_f").agg(*[F.sum(m).alias(m) for m in measures])
    blocks = cells.groupBy(*keys, "_c").agg(*[F.sum(m).alias(m) for m in measures])

    def earlier(frame: DataFrame, within: Sequence[str], by: str, prefix: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return frame.select(*within, by, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(prefix + m) for m in measures])

    starts = earlier(cells, [*keys, "_c"], "_f", "_i_").join(earlier(blocks, keys, "_c", "_o_"), [*keys, "_c"])
    w = Window.partitionBy(*keys, "_c", "_f").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"_l_{m}") for m in measures])
    joined = local.join(starts, [*keys, "_c", "_f"])
    return joined.select(*df.columns, *[(F.col(f"_l_{m}") + F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"before_{m}")
                                        for m in measures])


def global_positions(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with the zero-based place of every row in ``order``, as ``name``; ``order`` should tell rows apart.

    Rows are dealt to ranges of the whole order key, whose bounds Spark samples, and sorted there, so neither a second nor an id prefix
    that holds many rows ends in one task. The rows are written once; counts per range then give each range its first place.
    """
    part, line = F.shiftright("_line", 33), F.col("_line").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = pin(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_line", F.monotonically_increasing_id()), "positions")
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: as many as there are partitions
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.select(*df.columns, (F.col("_start") + line).alias(name))


def chronological_index(df: DataFrame, epoch: str, key: str) -> DataFrame:
    """Zero-based position of every row in ``(epoch, key)`` order, as ``position``."""
    return global_positions(df, [epoch, key], "position")


def value_bucket(value: Column, steps: int = 4096) -> Column:
    """A bucket number that never decreases with the value: its power of two and ``steps`` parts of it."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * steps)
    key = (power + 1100) * steps + part
    return F.when(value == 0, F.lit(0)).when(value > 0, key).otherwise(-key).cast("bigint")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles of ``value`` per ``keys``, one column per entry of ``probs``.

    A histogram over ``value_bucket``, combined before its shuffle, finds the few buckets holding the wanted ranks, and only their values
    are shuffled and ordered. No group is ever sorted whole. The buckets, at most two per entry of ``probs`` and key, are sent to all tasks,
    so keys should be few (columns, classes).
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_b", value_bucket(F.col("_v")))
    bins = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_b")
    bins = bins.select("*", F.sum("_bn").over(w).alias("_hi"),
                       F.sum("_bn").over(Window.partitionBy(*keys)).alias("_all"))
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("pos"))
                      for n, p in probs.items()])
    # rank r (0-based) is in the bin with hi-bn <= r < hi; both neighbours of the position are needed
    wanted = bins.withColumn("_r", F.explode(ranks)).select(
        *keys, "_b", (F.col("_hi") - F.col("_bn")).alias("_lo"), F.col("_hi"),
        F.col("_r.name").alias("_name"), F.col("_r.pos").alias("_pos"))
    wanted = wanted.where((F.ceil("_pos") >= F.col("_lo")) & (F.floor("_pos") < F.col("_hi")))
    needed = wanted.groupBy(*keys, "_b").agg(F.collect_list(F.struct("_name", "_pos")).alias("_want"),
                                             F.first("_lo").alias("_lo"))
    counted = rows.join(F.broadcast(needed.select(*keys, "_b")), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = counted.join(needed, [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy("_v")
    inside = inside.select("*", (F.sum("_n").over(w) + F.col("_lo")).alias("_end"))
    inside = inside.select(*keys, "_v", (F.col("_end") - F.col("_n")).alias("_start"), "_end",
                           F.explode("_want").alias("_w"))
    floor, ceil = F.floor("_w._pos"), F.ceil("_w._pos")
    hit = inside.where((floor.between(F.col("_start"), F.col("_end") - 1))
                       | (ceil.between(F.col("_start"), F.col("_end") - 1)))
    per = hit.groupBy(*keys, F.col("_w._name").alias("_name"), F.col("_w._pos").alias("_pos")).agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    frac = F.col("_pos") - F.floor("_pos")
    per = per.withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * frac)
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs])


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide numeric columns to (keys, name, value) rows, values as double."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot([F.col(k) for k in keys], list(columns), name, value)
