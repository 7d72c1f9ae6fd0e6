"""Scale-safe building blocks used across operators.

* ``group_quantiles`` -- exact, linearly interpolated quantiles per group
  (same definition as Spark ``percentile`` / DuckDB ``quantile_cont``).  When every
  group is small enough to buffer, it is one ``percentile`` aggregate; otherwise a
  distributed selection narrows each requested rank with value histograms, so no
  task ever holds more than ``max_buffer`` values of one group.
* ``top_k_per_group`` -- per-group top-k in two phases (salted sub-groups first),
  so a hot group is never sorted in one task.
* ``with_ordinal`` -- dense 1-based row position by an ordering, from buckets that a
  row's own values decide, plus the buckets' counts (no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MAX_BUFFER = 1 << 20   # values of one group a single task may buffer
DEFAULT_BUCKETS = 4096


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    max_buffer: int = DEFAULT_MAX_BUFFER, buckets: int = DEFAULT_BUCKETS,
                    force_selection: bool = False, wide: DataFrame | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys`` group; nulls and NaN ignored.

    Returns ``keys + list(probs)`` columns (one row per group with >= 1 value).  ``wide``: the
    frame ``df`` was exploded from, of which a row gives a group at most one value; group
    sizes are then read from its rows, without exploding them once more.
    """
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not force_selection:
        rows = base if wide is None else wide
        stats = rows.groupBy(*[k for k in keys if k in rows.columns]).agg(F.count(F.lit(1)).alias("_n"))
        largest = stats.agg(F.max("_n")).first()[0] or 0
        if largest <= max_buffer:
            shares = F.array(*[F.lit(float(p)) for p in probs.values()])              # one buffer a group for all of them
            found = base.groupBy(*keys).agg(F.percentile("_v", shares).alias("_q"))
            return found.select(*keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    return _selection_quantiles(base, keys, probs, max_buffer, buckets)


def _selection_quantiles(base: DataFrame, keys: list[str], probs: dict[str, float],
                         max_buffer: int, buckets: int) -> DataFrame:
    spark = base.sparkSession
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    want = F.explode(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    targets = (stats.select(*keys, "_n", want.alias("t"))
               .select(*keys, F.col("t.q").alias("q"), (F.col("t.p") * (F.col("_n") - 1)).alias("h")))
    ranks = (targets.select(*keys, F.floor("h").cast("long").alias("rank"))
             .unionByName(targets.select(*keys, F.ceil("h").cast("long").alias("rank"))).distinct())
    state = (ranks.join(stats, keys)
             .select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("_n").alias("cnt")))
    for _ in range(64):
        state = state.checkpoint(eager=True)        # small: groups x ranks rows; cuts lineage
        pending = state.where((F.col("cnt") > max_buffer) & (F.col("lo") < F.col("hi")))
        if pending.isEmpty():
            break
        done = state.join(pending.select(*keys, "rank"), [*keys, "rank"], "left_anti")
        cand = (base.join(pending, keys)
                .where(F.col("_v").between(F.col("lo"), F.col("hi")))
                .withColumn("b", F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets),
                                         F.lit(buckets - 1)).cast("int")))
        hist = cand.groupBy(*keys, "rank", "below", "b").agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
        w = Window.partitionBy(*keys, "rank").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        chosen = hist.where((F.col("below") + F.col("before") <= F.col("rank"))
                            & (F.col("rank") < F.col("below") + F.col("before") + F.col("c")))
        nxt = chosen.select(*keys, "rank", F.col("mn").alias("lo"), F.col("mx").alias("hi"),
                            (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("cnt"))
        state = done.unionByName(nxt)
    else:
        raise RuntimeError("a quantile was not narrowed down in 64 passes")
    state = state.checkpoint(eager=True)
    equal = state.where(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("x"))
    small = state.where(F.col("lo") < F.col("hi"))
    picked = (base.join(small, keys).where(F.col("_v").between(F.col("lo"), F.col("hi")))
              .groupBy(*keys, "rank", "below")
              .agg(F.array_sort(F.collect_list("_v")).alias("vals"))
              .select(*keys, "rank", F.element_at("vals", (F.col("rank") - F.col("below") + 1).cast("int")).alias("x")))
    values = equal.unionByName(picked)
    v0 = values.select(*keys, F.col("rank").alias("k0"), F.col("x").alias("x0"))
    v1 = values.select(*keys, F.col("rank").alias("k1"), F.col("x").alias("x1"))
    res = (targets.withColumn("k0", F.floor("h").cast("long")).withColumn("k1", F.ceil("h").cast("long"))
           .join(v0, [*keys, "k0"]).join(v1, [*keys, "k1"])
           .select(*keys, "q", (F.col("x0") + (F.col("h") - F.col("k0")) * (F.col("x1") - F.col("x0"))).alias("x")))
    return res.groupBy(*keys).agg(*[F.first(F.when(F.col("q") == n, F.col("x")), ignorenulls=True).alias(n)
                                    for n in probs])


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    salt_buckets: int = 64, salt_col: str | Column | None = None,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (which must be a total order).

    Phase 1 keeps the top k inside ``salt_buckets`` hash sub-groups of every group, so
    a hot group is split across tasks; phase 2 ranks the <= k*salt_buckets survivors.
    """
    salt = (F.col(salt_col) if isinstance(salt_col, str) else salt_col) if salt_col is not None else \
        F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    staged = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    survivors = staged.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return survivors.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def _order_value(df: DataFrame, col: str) -> Column:
    """A double that grows with ``col``: numbers as they are, hexadecimal digests by
    their first eight digits."""
    if dict(df.dtypes)[col] == "string":
        return F.conv(F.substring(F.col(col), 1, 8), 16, 10).cast("double")
    return F.col(col).cast("double")


def _bucket_of(value: Column, bounds: list[float]) -> Column:
    """Number of ``bounds`` (ascending) at or below ``value``, by binary search."""
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(float(b)) for b in bounds])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda i, s: F.when(
        F.coalesce(F.get(table, i + s - 1) <= value, F.lit(False)), i + s).otherwise(i))


def with_ordinal(df: DataFrame, order_cols: list[str], group: str | None = None,
                 name: str = "_pos", bucket_rows: int = 50_000) -> DataFrame:
    """Add a 1-based position by ``order_cols`` (within ``group`` when given).

    Rows go to buckets by their own values: literal bounds on the first order column
    (fetched once, from approximate percentiles), and a value that fills a bucket on its
    own is split by the second order column.  A row's bucket never depends on where the
    row is processed, so counting the buckets and numbering the rows inside them agree
    whichever columns each side reads.  ``order_cols`` must make the order total; the
    first two are numbers or hexadecimal digests.
    """
    first = _order_value(df, order_cols[0])
    n = df.count()
    buckets = min(4096, -(-n // bucket_rows))
    inner: list[Column] = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        exact = F.lit(10 * buckets)
        probe = [F.percentile_approx(first, shares, exact).alias("b1")]
        if len(order_cols) > 1:
            second = _order_value(df, order_cols[1])
            probe.append(F.percentile_approx(second, shares, exact).alias("b2"))
        found = df.agg(*probe).first()
        marks = found["b1"] or []
        heavy = sorted({a for a, b in zip(marks, marks[1:]) if a == b})
        inner.append(_bucket_of(first, sorted(set(marks))).alias("_b1"))
        if heavy and len(order_cols) > 1 and dict(df.dtypes)[order_cols[0]] != "string":
            # a heavy value has one bucket that starts at it; what follows in that bucket is set apart
            inner.append(F.when(first.isin(heavy), F.lit(0)).otherwise(F.lit(1)).alias("_b2"))
            inner.append(F.when(first.isin(heavy), _bucket_of(second, sorted(set(found["b2"] or [])))).otherwise(F.lit(0)).alias("_b3"))
    names = ["_b1", "_b2", "_b3"][:len(inner)]
    keys = ([group] if group else []) + names
    placed = df.select("*", *inner)
    local = F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(*order_cols))
    if not names:
        return placed.withColumn(name, local.cast("long"))
    before = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
               .select(*(F.col(k).alias(f"_o{k}") for k in keys), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    same = [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys]
    numbered = placed.withColumn("_local", local).join(offsets, same)
    return numbered.select(*df.columns, (F.col("_off") + F.col("_local")).alias(name))
