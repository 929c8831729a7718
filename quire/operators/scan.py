"""Running values along an order, cut into bands so that one large group is many tasks.

A window over a whole page, document or conversation is one task, however many rows it has. Here a
band, a column that does not fall along the order, cuts the group: each band is scanned apart, one row
a band carries what the bands before it came to, and that is joined back on (group, band), for which
the rows already lie where they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: What a running value may be, and how a carry and a local value make one.
_JOIN = {
    "sum": lambda carry, own: F.coalesce(carry + own, own, carry),
    "max": F.greatest,
    "xor": lambda carry, own: F.coalesce(carry.bitwiseXOR(own), own, carry),
    "last": lambda carry, own: F.coalesce(own, carry),
}
_LOCAL = {"sum": F.sum, "max": F.max, "xor": F.bit_xor, "last": lambda c: F.last(c, ignorenulls=True)}


#: Rows of a group up to which one task scans it at once: some hundred megabytes, which a window can spill.
MOST_ROWS = 2_000_000
Values = dict[str, tuple[str, Column]]


def scan(rows: DataFrame, keys: list[str], band: Column, order: list[str | Column], running: Values, before: Values | None = None, whole: Values | None = None) -> DataFrame:
    """rows with columns added for each value: `running` includes the row itself, `before` stops at the row
    before it, `whole` is the group's total. A value is ("sum", "max", "xor" or "last", column); "last" passes nulls over.

    band must not fall as `order` rises within a group (null comes first); order ascends (negate a number to go backwards) and must have no ties that matter.
    Null keys are a group like any other. A value of nothing but nulls, or of no row, is null. An empty table gives no rows.
    """
    return scan_in_turn(rows, keys, band, [(order, running, before or {}, whole or {}, {})])


def scan_in_turn(rows: DataFrame, keys: list[str], band: Column, steps: list[tuple[list[str | Column], Values, Values, Values, dict[str, Column]]]) -> DataFrame:
    """Scans of the same groups and bands one after the other: (order, running, before, whole, columns made from them for the next).

    The rows are dealt out once for all steps.
    """
    # Structs are never null, so null keys and bands meet their like in a plain equi-join.
    out = rows.withColumns({"_key": F.struct(*[F.col(k) for k in keys]), "_band": F.struct(band.alias("at"))})
    for order, running, before, whole, then in steps:
        out = _scanned(out, order, running, before, whole).withColumns(then) if then else _scanned(out, order, running, before, whole)
    return out.drop("_key", "_band")


def largest_group(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group, 0 of none."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def scan_groups(rows: DataFrame, keys: list[str], band: Column, steps: list[tuple[list[str | Column], Values, Values, Values, dict[str, Column]]], sized: DataFrame | int | None = None) -> DataFrame:
    """scan_in_turn(), cut into bands only if some group has more than MOST_ROWS rows; else by plain windows, with the same result.

    The rows of the groups are counted first, in `sized` if it is given (rows no fewer in each group, cheaper to make; or that count itself).
    """
    if (sized if isinstance(sized, int) else largest_group(rows if sized is None else sized, keys)) > MOST_ROWS:
        return scan_in_turn(stage(rows, "scanned"), keys, band, steps)
    group = Window.partitionBy(*keys)
    for order, running, before, whole, then in steps:
        inside = group.orderBy(*order)
        upto, strictly = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
        frames = {**dict.fromkeys(running, upto), **dict.fromkeys(before, strictly), **dict.fromkeys(whole, group)}
        rows = rows.withColumns({n: _LOCAL[k](c).over(frames[n]) for n, (k, c) in {**running, **before, **whole}.items()})
        rows = rows.withColumns(then) if then else rows
    return rows


def _scanned(keyed: DataFrame, order: list[str | Column], running: Values, before: Values, whole: Values) -> DataFrame:
    asked = {**running, **before, **whole}
    temp = {name: f"_v_{name}" for name in asked}
    names = keyed.columns
    keyed = keyed.withColumns({temp[n]: c for n, (_, c) in asked.items()})
    place = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)])

    def total(name: str, kind: str) -> Column:
        c = F.col(temp[name])
        return F.max_by(c, F.when(c.isNotNull(), place)) if kind == "last" else _LOCAL[kind](c)

    totals = keyed.groupBy("_key", "_band").agg(*[total(n, k).alias(temp[n]) for n, (k, _) in asked.items()])
    by_band = Window.partitionBy("_key").orderBy("_band")
    ahead, every = by_band.rowsBetween(Window.unboundedPreceding, -1), by_band.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carries = totals.select("_key", "_band", *[_LOCAL[k](F.col(temp[n])).over(every if n in whole else ahead).alias(f"_c_{n}") for n, (k, _) in asked.items()])
    inside = Window.partitionBy("_key", "_band").orderBy(*order)
    upto, strictly = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_l_{n}": _LOCAL[k](F.col(temp[n])).over(upto if n in running else strictly) for n, (k, _) in asked.items() if n not in whole}
    out = keyed.withColumns(local).join(carries, ["_key", "_band"])
    made = {n: F.col(f"_c_{n}") if n in whole else _JOIN[k](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in asked.items()}
    return out.withColumns(made).select(*[F.col(f"`{c}`") for c in names], *[n for n in asked if n not in names])
