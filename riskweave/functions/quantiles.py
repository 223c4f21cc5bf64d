"""Exact, linearly interpolated quantiles that stay safe under key skew.

An exact quantile needs each group's values in order.  Groups up to ``hot_rows`` values are ranked with one sorted
window over their distinct values; this and the refinement give the same value, the switch only spares small groups
the extra passes.  Larger ("hot") groups, a NULL key's group included, are narrowed first:

1. one pass sketches each group; the sketch names an interval of values around every wanted rank that holds about
   2 * ``MARGIN`` / ``SKETCH`` of the group's rows;
2. one pass counts the rows by interval, inside an interval also by value (map-side combine), and the ranks are read off
   the counts.  A sketch only says where to look: ranks that do not fall into their interval, or intervals of more than
   ``hot_rows`` distinct values, are left to radix selection.

Radix selection, on rows that nothing narrows:

1. every value has an order-preserving 64-bit key (``ordering.double_key``), so infinities and extremes are no special
   case;
2. a pass counts rows per (group, key prefix) with map-side combine and picks the prefix that holds the wanted rank;
3. the next pass looks at the rows with that prefix and 12 more bits.  There are five passes at most, whatever the data;
   an interval that holds at most ``final_rows`` rows, or one value, is done earlier;
4. the rank is then read off a value-count table of the interval's rows.

Whole columns (``column_quantiles``) of more than ``WIDE_ROWS`` values take two scans: the first counts the rows of all columns by
cells of a logarithmic scale, with map-side combine; the cells that hold a wanted rank are literals of the second, and only the rows
inside them are grouped by value.

The interpolation follows ``percentile``: position p*(n-1) between the floor and ceiling ranks; results equal the
built-in ``percentile`` to the last bit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.exprs import sized_broadcast, with_constant_key
from riskweave.session import ensure_checkpoint_dir

HOT_ROWS = 1_000_000      # groups larger than this avoid the one-task sort
FINAL_ROWS = 100_000      # an interval this small is ranked directly
SKETCH = 10_000           # accuracy of the sketch: its ranks are off by a 10,000th of the group at most
MARGIN = 4                # an interval reaches that many times further to both sides
WIDE_ROWS = 50_000        # columns of more values are sketched; fewer are ranked directly
CELLS = 256               # cells of a whole column for each doubling of a value
SHIFTS = (44, 32, 20, 8, 0)  # key bits still open after each pass: sign, exponent and 8 bits first, then 12 more each


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the key columns of two tables."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; the keys come out once."""
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])
    return a.join(right, cond, how).drop(*[f"_k_{k}" for k in keys])


def hot_groups(x: DataFrame, gkeys: list[str], hot_rows: int) -> tuple[DataFrame | None, int]:
    """The groups of more than ``hot_rows`` rows with their size ``_n`` (at most rows / hot_rows of them), and their number."""
    hot, n, _ = _hot_and_cold(x, gkeys, hot_rows)
    return hot, n


def _hot_and_cold(x: DataFrame, gkeys: list[str], hot_rows: int) -> tuple[DataFrame | None, int, int]:
    """The hot groups, their number and that of the other groups."""
    sizes = x.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, n_hot = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > hot_rows)).first()
        return (materialise(sizes.where(F.col("_n") > hot_rows)) if n_hot else None), n_hot, n - n_hot
    finally:
        sizes.unpersist()


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, approx_accuracy: int | None = None,
              hot_rows: int = HOT_ROWS, final_rows: int = FINAL_ROWS) -> DataFrame:
    """Per group of ``keys``: one column per entry of ``probs`` (name -> p); approximate only if an accuracy is asked for.

    NULL and NaN values are skipped (pandas semantics); a NULL key is a group.  Groups without any
    value are absent from the result; join it back with a left join.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_x"))
    x = x.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    x, gkeys, synthetic = with_constant_key(x, keys)
    if approx_accuracy:
        out = x.groupBy(*gkeys).agg(*[F.percentile_approx("_x", p, approx_accuracy).alias(n) for n, p in probs.items()])
        return out.drop("_all") if synthetic else out
    hot, n_hot, n_cold = _hot_and_cold(x, gkeys, hot_rows)
    if hot is None:
        out = _small_groups(x, gkeys, probs)
    else:
        hot_keys = sized_broadcast(hot.select(*gkeys), n_hot)
        out = refine(join_keys(x, hot_keys, gkeys, "left_semi") if n_cold else x, hot, n_hot, gkeys, probs, final_rows, hot_rows)
        if n_cold:
            out = _small_groups(join_keys(x, hot_keys, gkeys, "left_anti"), gkeys, probs).unionByName(out)
    return out.drop("_all") if synthetic else out


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float], *, wide_rows: int = WIDE_ROWS, hot_rows: int = HOT_ROWS,
                     final_rows: int = FINAL_ROWS) -> DataFrame:
    """``quantiles`` of each of ``cols`` over all rows: ``variable`` and one column per entry of ``probs``.

    NULL and NaN are skipped; a column without any value has no row."""
    spark, ps = df.sparkSession, list(probs.values())
    wide = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    wide = wide.select(*[F.when(~F.isnan(x), F.col(x)).alias(x) for x in wide.columns])
    cells = _rank_cells(wide, ps)
    names, sizes = dict(zip(wide.columns, cols, strict=True)), {x: own[0]["_n"] for x, own in cells.items()}
    few, many = [x for x in names if 0 < sizes.get(x, 0) <= wide_rows], [x for x in names if sizes.get(x, 0) > wide_rows]
    found = _inside_cells(wide, {x: cells[x] for x in many}, ps, hot_rows)
    parts = []
    if found:
        fields = ", ".join(f"_lo{i} double, _hi{i} double" for i in range(len(ps)))
        ranked = spark.createDataFrame([(names[x], sizes[x], *values) for x, values in found.items()], f"variable string, _n long, {fields}")
        parts.append(ranked.select("variable", *[between(p, F.col(f"_lo{i}"), F.col(f"_hi{i}")).alias(name) for i, (name, p) in enumerate(probs.items())]))
    missed = [x for x in many if x not in found]
    for some, rank in ((few, lambda v: _small_groups(v, ["variable"], probs)),
                       (missed, lambda v: _by_radix(v, spark.createDataFrame([(names[x], sizes[x]) for x in missed], "variable string, _n long"), len(missed), ["variable"], probs, final_rows))):
        if some:
            values = wide.select(*[F.col(x).alias(names[x]) for x in some]).unpivot([], [names[x] for x in some], "variable", "_x")
            parts.append(rank(values.where("_x is not null")))
    if not parts:
        return spark.createDataFrame([], ", ".join(["variable string", *[f"`{name}` double" for name in probs]]))
    return reduce(DataFrame.unionByName, parts)


def _interval_ends(ps: list[float], rows: int) -> list[float]:
    """Lower and upper end, as probabilities, of the interval around each wanted rank in groups of more than ``rows`` values."""
    off = MARGIN / SKETCH + 2 / rows
    return [e for p in ps for e in (max(0.0, p - off), min(1.0, p + off))]


def _cell(x: Column) -> Column:
    """A long that does not fall as the value rises: its sign and ``CELLS`` steps for each doubling. One logarithm a value, which
    costs far less than the exact key; that cells are in order is tested on their ends."""
    smallest, lift = 2.0 ** -1074, 1076 * CELLS
    steps = F.floor(F.least(F.log2(F.greatest(F.abs(x), F.lit(smallest))), F.lit(1025.0)) * float(CELLS)) + lift
    return (steps * F.signum(x)).cast("long")


def _rank_cells(wide: DataFrame, ps: list[float]) -> dict[str, list]:
    """Per column the cells that hold its wanted ranks: rows (``_c``) and those up to its end (``_end``), least and largest value
    (``_lo``, ``_hi``), the column's size (``_n``), and whether all its cells are in order (``_sorted``). One scan."""
    cells = wide.unpivot([], wide.columns, "_v", "_x").where("_x is not null").groupBy("_v", _cell(F.col("_x")).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    whole = Window.partitionBy("_v")  # about 2**20 cells a column at most
    ordered = whole.orderBy("_cell")
    cells = cells.withColumns({"_n": F.sum("_c").over(whole), "_end": F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                               "_after": F.coalesce(F.lag("_hi").over(ordered) < F.col("_lo"), F.lit(True))})
    cells = cells.withColumn("_sorted", F.min("_after").over(whole))
    holds = reduce(lambda a, b: a | b, [(F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")) for p in ps for r in ranks_of(p)[1:]])
    out: dict[str, list] = {}
    for r in cells.where(holds).select("_v", "_c", "_end", "_lo", "_hi", "_n", "_sorted").collect():  # two cells at most for each column and probability
        out.setdefault(r["_v"], []).append(r)
    return out


def _inside_cells(wide: DataFrame, cells: dict[str, list], ps: list[float], hot_rows: int) -> dict[str, tuple]:
    """Per column the values at the floor and ceiling ranks of each probability; columns with a cell of more than ``hot_rows`` distinct
    values, or with cells out of order, are left out. Bounds are literals, a cell is put in order by itself, over its distinct values."""
    wanted, at, cells = [], {}, {x: own for x, own in cells.items() if own[0]["_sorted"]}
    for x, own in cells.items():
        n = own[0]["_n"]
        for r in sorted({r for p in ps for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}):
            i = next(i for i, c in enumerate(own) if c["_end"] - c["_c"] <= r < c["_end"])
            if own[i]["_lo"] == own[i]["_hi"]:
                at[x, r] = own[i]["_lo"] + 0.0  # no negative zero
            else:
                wanted.append((x, i, r))
    missed: set[str] = set()
    if wanted:
        mine: dict[str, set] = {}
        for x, i, _ in wanted:
            mine.setdefault(x, set()).add(i)
        within = lambda x, c: x.between(c["_lo"], c["_hi"])
        inside = [F.when(reduce(lambda a, b: a | b, [within(F.col(x), cells[x][i]) for i in some]), F.col(x)).alias(x) for x, some in mine.items()]
        counts = wide.select(*inside).unpivot([], list(mine), "_v", "_x").where("_x is not null").groupBy("_v", "_x").agg(F.count(F.lit(1)).alias("_c"))
        # cells of a column do not overlap: a value has one
        cell = F.coalesce(*[F.when((F.col("_v") == x) & within(F.col("_x"), cells[x][i]), F.lit(i)) for x, some in mine.items() for i in some])
        held = materialise(counts.withColumn("_i", cell))
        many = held.groupBy("_v", "_i").agg(F.count(F.lit(1)).alias("_distinct")).where(F.col("_distinct") > hot_rows)
        missed = {r["_v"] for r in many.collect()}  # one row a cell at most
        wanted = [w for w in wanted if w[0] not in missed]
    if wanted:
        ranks = wide.sparkSession.createDataFrame([(x, i, cells[x][i]["_end"] - cells[x][i]["_c"], r) for x, i, r in wanted], "_v string, _i int, _below long, _r long")
        running = Window.partitionBy("_v", "_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ordered = held.where(~F.col("_v").isin(list(missed))) if missed else held
        ranked = ordered.withColumn("_end", F.sum("_c").over(running)).join(F.broadcast(ranks), ["_v", "_i"])  # one row a rank
        after = F.col("_r") - F.col("_below")
        for r in ranked.where((F.col("_end") - F.col("_c") <= after) & (after < F.col("_end"))).select("_v", "_r", "_x").collect():  # one row a rank
            at[r["_v"], r["_r"]] = r["_x"]
    place = lambda x, p: p * (cells[x][0]["_n"] - 1)
    return {x: tuple(at[x, r] for p in ps for r in (math.floor(place(x, p)), math.ceil(place(x, p)))) for x in cells if x not in missed}


def _small_groups(x: DataFrame, gkeys: list[str], probs: dict[str, float]) -> DataFrame:
    """Groups of at most ``hot_rows`` values: count each distinct value
    (map-side combine), then one sorted window per group gives every value's
    rank range; the wanted ranks are read off in one aggregate.  The sort
    spills to disk if it must (``percentile`` keeps a map in memory and is
    several times slower on high-cardinality columns)."""
    vc = x.groupBy(*gkeys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*gkeys).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vc = vc.withColumn("_end", F.sum("_c").over(running)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*gkeys)))
    holds = lambda r: (F.col("_end") - F.col("_c") <= r) & (r < F.col("_end"))
    aggs = []
    for i, p in enumerate(probs.values()):
        _, lo, hi = ranks_of(p)
        aggs += [F.max(F.when(holds(lo), F.col("_x"))).alias(f"_lo{i}"),
                 F.max(F.when(holds(hi), F.col("_x"))).alias(f"_hi{i}")]
    g = vc.groupBy(*gkeys).agg(F.max("_n").alias("_n"), *aggs)
    return g.select(*gkeys, *[between(p, F.col(f"_lo{i}"), F.col(f"_hi{i}")).alias(name) for i, (name, p) in enumerate(probs.items())])


def ranks_of(p: float):
    """Position, floor and ceiling rank of probability p among ``_n`` values."""
    pos = F.lit(p) * (F.col("_n") - 1)
    return pos, F.floor(pos).cast("long"), F.ceil(pos).cast("long")


def between(p: float, lower: Column, upper: Column) -> Column:
    """Interpolate between the values at the floor and ceiling ranks."""
    pos, lo, hi = ranks_of(p)
    return F.when((lo == hi) | (lower == upper), lower).otherwise((hi - pos) * lower + (pos - lo) * upper)


def select_ranks(x: DataFrame, gkeys: list[str], targets: DataFrame, n_targets: int,
                 final_rows: int = FINAL_ROWS) -> DataFrame:
    """Values at 0-based ranks of ``_x`` within groups, without sorting a group.

    ``x``: gkeys, ``_x`` (any orderable type, no NULL) and ``_k`` (a long that sorts like ``_x``).  ``targets``: gkeys + ``_r``.
    Returns gkeys, ``_r``, ``_v`` (the value at that rank) and ``_lt`` (how many values are smaller).

    Ranks that share a prefix share its counts: a pass reads the rows once per distinct prefix, not per wanted rank.
    """
    state = materialise(targets.select(*gkeys, "_r", F.lit(None).cast("long").alias("_pre"), F.lit(0).cast("long").alias("_below"),
                                       F.lit(None).cast("long").alias("_cnt"), F.lit(True).alias("_open")))
    finished = []
    shift_before = None
    for shift in SHIFTS:
        active = state.where("_open")
        if active.isEmpty():
            break
        ival = [*gkeys, "_pre", "_below"]
        rows = _rows_of(x, active, gkeys, shift_before, n_targets)
        hist = rows.groupBy(*ival, F.shiftright("_k", shift).alias("_next")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        # at most 2**20 (first pass) or 2**12 rows per interval: a bounded window
        w = Window.partitionBy(*ival).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
        chosen = join_keys(active.select(*ival, "_r"), hist, ival).where((F.col("_start") <= F.col("_r")) & (F.col("_r") < F.col("_start") + F.col("_c")))
        one = F.col("_a") == F.col("_b")
        state = materialise(chosen.select(*gkeys, "_r", F.col("_next").alias("_pre"), F.col("_start").alias("_below"), F.col("_c").alias("_cnt"),
                                          (~one & (F.col("_c") > final_rows)).alias("_open"), F.when(one, F.col("_a")).alias("_v")))
        finished.append(state.where("_v is not null").select(*gkeys, "_r", "_v", F.col("_below").alias("_lt")))
        small = state.where("_v is null and not _open")
        if not small.isEmpty():
            finished.append(_read_off(x, small, gkeys, shift, n_targets))
        shift_before = shift
    if not finished:
        return x.limit(0).select(*gkeys, F.lit(0).cast("long").alias("_r"), F.col("_x").alias("_v"), F.lit(0).cast("long").alias("_lt"))
    return materialise(reduce(DataFrame.unionByName, finished))


def _rows_of(x: DataFrame, state: DataFrame, gkeys: list[str], shift: int | None, n_targets: int) -> DataFrame:
    """The rows of ``x`` in the intervals of ``state`` (all of the group before the first pass), with ``_pre`` and ``_below``."""
    intervals = sized_broadcast(state.select(*gkeys, "_pre", "_below").distinct(), n_targets)
    if shift is None:
        return join_keys(x, intervals, gkeys)
    keyed = x.withColumn("_pre", F.shiftright("_k", shift))
    return join_keys(keyed, intervals, [*gkeys, "_pre"])


def _read_off(x: DataFrame, state: DataFrame, gkeys: list[str], shift: int, n_targets: int) -> DataFrame:
    """Ranks in intervals of at most ``final_rows`` rows, from their counted distinct values."""
    ival = [*gkeys, "_pre", "_below"]
    vc = _rows_of(x, state, gkeys, shift, n_targets).groupBy(*ival, "_x").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*ival).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vc = vc.withColumn("_end", F.col("_below") + F.sum("_c").over(w))
    return (join_keys(state.select(*ival, "_r"), vc, ival)
            .where((F.col("_end") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_end")))
            .select(*gkeys, "_r", F.col("_x").alias("_v"), (F.col("_end") - F.col("_c")).alias("_lt")))


def materialise(df: DataFrame) -> DataFrame:
    """Materialise a narrow or small table and cut its lineage.

    Each refinement pass builds on the previous state twice, so an uncut
    plan would double per pass.  The table is cached first so the reliable
    checkpoint (written to the cluster's shared checkpoint folder, which
    survives executor loss) reads it from memory instead of recomputing it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def refine(hot_x: DataFrame, hot: DataFrame, n_hot: int, gkeys, probs, final_rows: int = FINAL_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quantiles of the hot groups (``hot``: gkeys and ``_n``) from their rows (gkeys and ``_x``)."""
    narrowed = _from_intervals(hot_x, hot, n_hot, gkeys, probs, hot_rows)
    missed = narrowed.where("not _found").select(*gkeys, "_n")
    out = narrowed.where("_found").select(*gkeys, *probs)
    n_missed = missed.count()
    if not n_missed:
        return out
    missed_x = join_keys(hot_x, sized_broadcast(missed.select(*gkeys), n_missed), gkeys, "left_semi")
    return out.unionByName(_by_radix(missed_x, missed, n_missed, gkeys, probs, final_rows))


def _from_intervals(hot_x: DataFrame, hot: DataFrame, n_hot: int, gkeys, probs, hot_rows: int) -> DataFrame:
    """One row per hot group: gkeys, ``_n``, a column for each probability and ``_found``, whether they are all sure.

    The bounds of a group's intervals cut its values into stretches in ascending order; a stretch lies within some
    interval, and is counted by value, or within none, and is one count."""
    ends = _interval_ends(list(probs.values()), hot_rows)
    sketch = hot_x.groupBy(*gkeys).agg(F.percentile_approx("_x", ends, SKETCH).alias("_e"))
    low = [F.lit(-float("inf")) if e == 0 else F.col("_e")[2 * i] for i, e in enumerate(ends[::2])]
    high = [F.lit(float("inf")) if e == 1 else F.col("_e")[2 * i + 1] for i, e in enumerate(ends[1::2])]
    bounds = materialise(sketch.select(*gkeys, *[c.alias(f"_l{i}") for i, c in enumerate(low)], *[c.alias(f"_h{i}") for i, c in enumerate(high)]))
    rows = join_keys(hot_x, sized_broadcast(bounds, n_hot), gkeys)
    from_, beyond = [F.col("_x") >= F.col(f"_l{i}") for i in range(len(probs))], [F.col("_x") > F.col(f"_h{i}") for i in range(len(probs))]
    stretch = reduce(lambda a, b: a + b, [c.cast("int") for c in from_ + beyond])
    inside = reduce(lambda a, b: a | b, [a & ~b for a, b in zip(from_, beyond, strict=True)])
    counts = materialise(rows.groupBy(*gkeys, stretch.alias("_s"), F.when(inside, F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_c")))
    before = Window.partitionBy(*gkeys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # two stretches for each probability, and one
    stretches = counts.groupBy(*gkeys, "_s").agg(F.sum("_c").alias("_rows"), F.count("_x").alias("_distinct")).withColumn("_below", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    wanted = hot.select(*gkeys, F.explode(F.array_distinct(F.array(*[r for p in probs.values() for r in ranks_of(p)[1:]]))).alias("_r"))
    at = join_keys(wanted, stretches, gkeys).where((F.col("_below") <= F.col("_r")) & (F.col("_r") < F.col("_below") + F.col("_rows")))
    at = materialise(at.where(F.col("_distinct").between(1, hot_rows)).select(*gkeys, "_s", "_below", "_r"))
    # only stretches with a wanted rank are put in order, each by itself
    held = join_keys(counts, at.select(*gkeys, "_s", "_below").distinct(), [*gkeys, "_s"])
    running = Window.partitionBy(*gkeys, "_s").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("_end", F.col("_below") + F.sum("_c").over(running)).drop("_below")
    found = join_keys(at.select(*gkeys, "_s", "_r"), held, [*gkeys, "_s"]).where((F.col("_end") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_end")))
    out = _interpolated(found.withColumnRenamed("_x", "_v"), hot, gkeys, probs, "left")
    sure = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in probs])
    return materialise(out.withColumn("_found", sure))


def _by_radix(hot_x: DataFrame, hot: DataFrame, n_hot: int, gkeys, probs, final_rows: int) -> DataFrame:
    from riskweave.functions.ordering import double_key
    wanted = [r for p in probs.values() for r in ranks_of(p)[1:]]
    targets = hot.select(*gkeys, F.explode(F.array_distinct(F.array(*wanted))).alias("_r"))
    found = select_ranks(hot_x.withColumn("_k", double_key(F.col("_x"))), gkeys, targets, n_hot * len(probs) * 2, final_rows)
    return _interpolated(found, hot, gkeys, probs, "inner").drop("_n")


def _interpolated(found: DataFrame, hot: DataFrame, gkeys, probs, how: str) -> DataFrame:
    """gkeys, ``_n`` and the quantiles from the values ``_v`` at ranks ``_r``; NULL where a rank is absent."""
    values = found.groupBy(*gkeys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))
    out = join_keys(hot.select(*gkeys, "_n"), values, gkeys, how)
    at = lambda r: F.try_element_at("_m", r)
    return out.select(*gkeys, "_n", *[between(p, at(ranks_of(p)[1]), at(ranks_of(p)[2])).alias(name) for name, p in probs.items()])
