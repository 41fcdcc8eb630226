"""Ordered scans: monotonic time, grids, static spans, interval ledgers, ordinals and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import materialised

#: Where an index is missing, its row comes last.
LAST = (1 << 63) - 1


def non_monotonic(df: DataFrame, group: Sequence[str], order: Sequence[str], time: str) -> DataFrame:
    """Rows whose time is not above that of the row before, in their group; rows without group or time are left out first."""
    rows = df.where(F.col(time).isNotNull())
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    w = Window.partitionBy(*group).orderBy(*[F.col(o).asc_nulls_last() for o in order])
    return rows.withColumn("previous", F.lag(time).over(w)).where(F.col(time) <= F.col("previous"))


def off_grid(df: DataFrame, time: str, frame: str, fps: float, tolerance: float = 1e-4) -> DataFrame:
    """Rows whose time in seconds is further than `tolerance` from frame / fps; none without a positive fps."""
    if not fps or fps <= 0:
        return df.limit(0)
    expected = F.col(frame) / F.lit(float(fps))
    return df.withColumn("expected", expected).where(F.col(frame).isNotNull() & (F.abs(F.col(time) - expected) > tolerance))


def static_spans(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, consecutive: str | None = None, least: int = 2) -> DataFrame:
    """Maximal runs of equal values: first, last (of order[0]) and length; where `consecutive` names an index, it must rise by one inside a run."""
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()
    if consecutive:
        same = same & (F.col(consecutive) == F.lag(consecutive).over(w) + 1)
    marked = df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(*group, "_run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length"), F.first(value).alias(value))
    return spans.where(F.col("length") >= least).drop("_run")


def _behind(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Each row with _seen (the largest `value` of the rows before it in its group), _previous (that of the row just before) and _rank (from 0).

    Ranges of (group, order) are scanned in parallel; what a group brings along from the ranges before is one row for each range that continues a group, so
    neither a large group nor a table without groups lands in one task.
    """
    parts = _ranged(df, [*group, *order])
    w = Window.partitionBy("_part", *group).orderBy("_within")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("_m", F.max(value).over(before)).withColumn("_l", F.lag(value).over(w)).withColumn("_r", F.row_number().over(w) - 1)
    edges = parts.groupBy("_part", *group).agg(F.max(value).alias("m"), F.max_by(value, "_within").alias("l"), F.count(F.lit(1)).alias("n"))
    g = Window.partitionBy(*group).orderBy("_part")
    past = g.rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.max("m").over(past).alias("_cm"), F.lag("l").over(g).alias("_cl"), F.sum("n").over(past).alias("_cn")).where("_cn IS NOT NULL")
    same = own["_part"] == F.col("_p")
    for k, c in enumerate(group):
        same = same & own[c].eqNullSafe(F.col(f"_g{k}"))
    # at most one group continues from range to range
    both = own.join(F.broadcast(carry), same, "left")
    out = both.withColumn("_seen", F.greatest("_m", "_cm")).withColumn("_previous", F.when(F.col("_r") > 0, F.col("_l")).otherwise(F.col("_cl"))).withColumn("_rank", (F.col("_r") + F.coalesce("_cn", F.lit(0))).cast("long"))
    return out.drop("_part", "_within", "_m", "_l", "_r", "_p", "_cm", "_cl", "_cn", *[f"_g{k}" for k in range(len(group))])


def ledger(df: DataFrame, group: Sequence[str], start: str, end: str, order: Sequence[str], origin: Column | None = None) -> DataFrame:
    """Valid half-open intervals against the furthest end so far: kind is gap or overlap, with furthest and the interval.

    The furthest end starts at `origin` (default 0), so a late first interval is a gap, but an overlap needs a predecessor.
    """
    valid = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end)))
    seen = _behind(valid, group, [start, end, *order], end)
    furthest = F.coalesce("_seen", origin if origin is not None else F.lit(0))
    kind = F.when(F.col(start) > furthest, "gap").when(F.col("_seen").isNotNull() & (F.col(start) < F.col("_seen")), "overlap")
    return seen.withColumn("furthest", furthest).withColumn("kind", kind).where("kind IS NOT NULL").drop("_seen", "_previous", "_rank")


def segment_overlaps(df: DataFrame, group: Sequence[str], start: str, end: str, order: Sequence[str], slack: float = 1e-9) -> DataFrame:
    """Segments that begin before the furthest end so far of their group, by more than `slack`."""
    seen = _behind(df, group, [start, end, *order], end).withColumnRenamed("_seen", "furthest")
    return seen.where(F.col(start) < F.col("furthest") - F.lit(slack)).drop("_previous", "_rank")


def adjacent_collisions(df: DataFrame, group: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Segments that begin before the end of the segment just before them; unlike `segment_overlaps` it forgets what came earlier."""
    seen = _behind(df, group, [start, end, *order], end).withColumnRenamed("_previous", "previous_end")
    return seen.where(F.col(start) < F.col("previous_end")).drop("_seen", "_rank")


def holes(df: DataFrame, group: Sequence[str], index: str, start: int = 0) -> DataFrame:
    """Missing stretches of an index that should run from `start`, like `keys.gaps`, for groups that are too large for one task, or none at all."""
    present = df.where(F.col(index) >= start).select(*group, index).distinct()
    first = F.coalesce(F.col("_previous") + 1, F.lit(start))
    return _behind(present, group, [index], index).withColumn("first_missing", first).where(F.col(index) > F.col("first_missing")).select(*group, "first_missing", (F.col(index) - 1).alias("last_missing"), (F.col(index) - F.col("first_missing")).alias("n_missing"))


def shard_spans(df: DataFrame, shard: str, start: str, end: str, owner: str, rows: DataFrame | None = None) -> DataFrame:
    """For each shard the covered span and the owner of its furthest end; with `rows` (shard, n_rows) also trailing gap and overrun."""
    out = df.groupBy(shard).agg(F.min(start).alias("low"), F.max(end).alias("high"), F.max(F.struct(F.col(end), F.col(start), F.col(owner)))[owner].alias("last_owner"), F.count(F.lit(1)).alias("n_ranges"))
    if rows is None:
        return out
    span = F.col("high") - F.col("low")
    return out.join(rows, shard).withColumn("trailing_gap", F.greatest(F.col("n_rows") - span, F.lit(0))).withColumn("overrun", F.greatest(span - F.col("n_rows"), F.lit(0)))


def invalid_ranges(df: DataFrame, start: str, end: str, length: str | None = None) -> DataFrame:
    """Ranges with a reason: invalid (missing, negative or not rising) or length (span differs from the declared length)."""
    bad = F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < 0) | (F.col(start) >= F.col(end))
    reason = F.when(bad, "invalid")
    if length:
        reason = reason.when(F.col(length).isNotNull() & (F.col(end) - F.col(start) != F.col(length)), "length")
    return df.withColumn("reason", reason).where("reason IS NOT NULL")


def segment_bounds(df: DataFrame, start: str, end: str) -> DataFrame:
    """Time segments with a reason: missing, non_finite, negative or reversed."""
    a, b = F.col(start), F.col(end)
    odd = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    reason = F.when(a.isNull() | b.isNull(), "missing").when(odd(a) | odd(b), "non_finite").when((a < 0) | (b < 0), "negative").when(a >= b, "reversed")
    return df.withColumn("reason", reason).where("reason IS NOT NULL")


def out_of_range(segments: DataFrame, videos: DataFrame, path: str, end: str, duration: str, fps: str) -> DataFrame:
    """Segments that end more than one frame behind their video."""
    return segments.join(videos.select(path, duration, fps), path).where(F.col(end) > F.col(duration) + F.when(F.col(fps) > 0, 1 / F.col(fps)).otherwise(0))


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows sorted range by range, with _part and the place _within it; written down, as the ranges come from a sample and would differ between two reads."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = materialised(dealt, "ranged")
    return fixed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_within", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def _before(parts: DataFrame, value: Column) -> DataFrame:
    """For each range the sum of `value` over all ranges before it; one row per range."""
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    return sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal", group: Sequence[str] = ()) -> DataFrame:
    """Rank from 0 by `order`, in each group if there are any.

    Ranges are sorted in parallel and each adds the rows of those before it, so no task sees all rows of a table or of a group.
    """
    if group:
        return _behind(df, group, order, order[0]).withColumnRenamed("_rank", name).drop("_seen", "_previous")
    parts = _ranged(df, order)
    return parts.join(F.broadcast(_before(parts, F.lit(1))), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def sample_ends(df: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """First, middle and last row by `order`: places 0, (n-1) div 2 and n-1."""
    ranked = ordinal(df, order, "place", group)
    n = df.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)]).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for k, c in enumerate(group):
        same = same & ranked[c].eqNullSafe(F.col(f"_g{k}"))
    ranked = ranked.join(n, same) if group else ranked.join(F.broadcast(n))
    return ranked.where((F.col("place") == 0) | (F.col("place") == F.floor((F.col("_n") - 1) / 2)) | (F.col("place") == F.col("_n") - 1)).drop("_n", *[f"_g{k}" for k in range(len(group))])


def even_places(n: int, k: int) -> list[int]:
    """k places spread evenly over n rows, each rounded half to even; all of them if k >= n."""
    if n <= 0 or k <= 0:
        return []
    if k >= n:
        return list(range(n))
    return [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def at_even_places(place: Column, n: int, k: int) -> Column:
    """Whether a place is one of `even_places(n, k)`, told from the place alone: no list of places goes to the driver or into a plan."""
    if n <= 0 or k <= 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    if k == 1:
        return place == 0
    # i * (n - 1) / (k - 1) rounds to this place only for the two i beside place * (k - 1) / (n - 1)
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    low, hit = div(place.cast("long") * F.lit(k - 1), n - 1), F.lit(False)
    for i in (low, low + 1):
        whole, rest = div(i * F.lit(n - 1), k - 1), (i * F.lit(n - 1)) % F.lit(k - 1)
        up = (2 * rest > k - 1) | ((2 * rest == k - 1) & (whole % 2 == 1))
        hit = hit | ((i <= k - 1) & (whole + up.cast("long") == place))
    return hit


def sample_even(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """k rows spread evenly by `order`."""
    n = df.count()
    return ordinal(df, order, "place").where(at_even_places(F.col("place"), n, k)) if n > 0 and k > 0 else df.withColumn("place", F.lit(0).cast("long")).limit(0)


def round_robin(df: DataFrame, group: str, order: Sequence[str], limit: int) -> DataFrame:
    """The first of every group, then the second of every group, ... up to `limit` rows; groups in their order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    # no group gives more than `limit` rows; Spark cuts each task's share of a group to that before the shuffle
    ranked = df.withColumn("_place", place).where(F.col("_place") <= limit).withColumn("round", (F.col("_place") - 1).cast("long")).drop("_place")
    return ranked.orderBy("round", group).limit(limit)


def budget_prefix(df: DataFrame, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """The rows by `order` up to the first whose size is unknown or takes the sum over `budget`, with the running sum.

    Range by range the sums and the cut are found like `ordinal` finds ranks.
    """
    amount = F.coalesce(F.col(size), F.lit(budget + 1)).cast("decimal(38,0)")
    parts = _ranged(df, order)
    own = F.sum(amount).over(Window.partitionBy("_part").orderBy("_within").rowsBetween(Window.unboundedPreceding, 0))
    run = parts.withColumn("_own", own).join(F.broadcast(_before(parts, amount)), "_part").withColumn("running", F.col("_own") + F.col("_before"))
    return run.where(F.col("running") <= budget).withColumn("running", F.col("running").cast("long")).drop("_part", "_within", "_own", "_before")


def stride_sample(df: DataFrame, group: Sequence[str], order: Sequence[str], points: int) -> DataFrame:
    """Every s-th row of each group, s = max(1, ceil(n / points)), so at most `points` rows of it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / points))
    return df.withColumn("_n", n).withColumn("place", place.cast("long")).where(F.pmod(F.col("place"), stride) == 0).drop("_n")


def reordered(before: DataFrame, after: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Keys on both sides whose ordinal changed."""
    return before.select(key, F.col(name).alias("before")).join(after.select(key, F.col(name).alias("after")), key).where("before <> after")
