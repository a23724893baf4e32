"""A join on near numbers: each item with the sale lines whose price for one piece lies in an absolute or a relative band.

Prices are whole cents, so everything that a pair needs of a line but its identity is one number, and both sides are
summed up by it first: lines to points (u, how many, their checksum), items to prices. A key that holds a third of the
rows is then one row. Points meet prices in two equi-joins. The absolute band deals both into linear buckets a little
wider than it, the relative one into logarithmic buckets a little wider than its ratio; a price looks into its bucket and the
two beside it, and exact checks in whole numbers follow. The relative branch keeps only pairs outside the absolute band, so no
pair comes twice, and only prices at which it can reach further than the absolute one take part.

An item's own lines don't count. They are found by an ordinary join on the item, summed up before it, and subtracted.
For the first lines of an item, points are ranked by gap at each price; an item needs those before which fewer than `k`
lines lie besides its own. Of a point, the first 2 k lines by (sale_id, line_no, item_id) travel, counting the first k of
each item only. So whichever item is left out, k lines are there if the point has as many.

Joins are merge joins throughout: no side is collected or broadcast, whatever its size.

Defined results: lines null in sale_id, item_id, quantity or amount, and items null in price or item_id, never pair, nor do
quantities of 0, numbers that aren't finite, and amounts or prices of 2**53 cents and more, where doubles can't tell cents
apart. A null line_no counts as empty text in checksums and comes first. Negative numbers pair by the absolute band
only. Repeated lines count each time; repeated items each get their rows; items without pairs get one row of rank 0.
Empty tables give no pairs. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cents of the absolute band, and the relative one as a share 1 / RATIO of the smaller number.
NEAR, RATIO = 50, 200
#: Linear buckets hold 2 to this power cents, no fewer than the absolute band.
LINEAR = 6
#: Logarithmic buckets are wider than the relative band by this factor, so that rounding never matters.
SLACK = 1.01
_MOST = float(1 << 53)


def cents(x: Column) -> Column:
    """floor(100 x + 0.5), null where it isn't a number of cents."""
    raw = F.floor(F.lit(100.0) * x + F.lit(0.5))
    value = F.lit(100.0) * x
    return F.when(~F.isnan(x) & (F.abs(value) < _MOST), raw)


def lines_of(sale_lines: DataFrame) -> DataFrame:
    """(u, item, sale_id, line_no, crc) of each line that can pair."""
    raw = sale_lines.select(
        F.col("item_id").cast("bigint").alias("item"), F.col("sale_id").cast("bigint").alias("sale_id"), F.col("line_no").cast("bigint").alias("line_no"), F.col("quantity").cast("bigint").alias("q"), cents(F.col("amount").cast("double")).alias("a")
    ).where("item IS NOT NULL AND sale_id IS NOT NULL AND a IS NOT NULL AND q <> 0")
    # the quotient rounded down, whatever the signs; `div` rounds towards zero
    u = F.expr("(2 * a + q) div (2 * q) - IF((2 * a + q) % (2 * q) <> 0 AND ((2 * a + q) < 0) <> (q < 0), 1, 0)")
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item").cast("string"))
    return raw.select(u.alias("u"), "item", "sale_id", "line_no", F.crc32(text.cast("binary")).alias("crc"))


def _in_band(p: Column, u: Column) -> Column:
    gap = F.abs(u - p)
    return (gap <= NEAR) | (RATIO * gap <= F.least(u, p))


def _within(prices: DataFrame, points: DataFrame) -> DataFrame:
    """Every (price, point) in either band, once: two equi-joins on buckets, then exact checks."""
    near = prices.withColumn("bucket", F.explode(F.array(*(F.shiftright("p", LINEAR) + d for d in (-1, 0, 1)))))
    gap = F.abs(F.col("u") - F.col("p"))
    absolute = near.hint("merge").join(points.withColumn("b", F.shiftright("u", LINEAR)), F.col("bucket") == F.col("b")).where(gap <= NEAR)
    width = math.log1p(1 / RATIO) * SLACK
    logs = lambda x: F.floor(F.log(x.cast("double")) / F.lit(width)).cast("bigint")
    least = RATIO * (NEAR + 1)  # below it the relative band lies inside the absolute one
    far = prices.where(F.col("p") >= least).withColumn("bucket", F.explode(F.array(*(logs(F.col("p")) + d for d in (-1, 0, 1)))))
    relative = far.hint("merge").join(points.where(F.col("u") >= least).withColumn("b", logs(F.col("u"))), F.col("bucket") == F.col("b")).where((gap > NEAR) & (RATIO * gap <= F.least("u", "p")))
    return absolute.unionByName(relative).drop("bucket", "b").withColumn("gap", gap)


def _first_lines(lines: DataFrame, k: int) -> DataFrame:
    """(u, lines): at each point, in order, the first 2 k lines of those that are among the first k of their item there.

    Whichever item is left out, k lines or all of the others stay, since no item has more than k of them. Both limits cut
    what a task has before it is shuffled, so a point or an item that holds a third of the lines is a few rows a task.
    """
    order = [F.col("sale_id"), F.col("line_no").asc_nulls_first()]
    few = lines.withColumn("r", F.row_number().over(Window.partitionBy("u", "item").orderBy(*order))).where(F.col("r") <= k)
    head = few.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(*order, "item"))).where(F.col("r") <= 2 * k)
    return head.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sale_id", "line_no", "item"))).alias("lines"))


def nearest_lines(items: DataFrame, sale_lines: DataFrame, k: int = 10) -> DataFrame:
    """Each item's first `k` pairs by (gap, u, sale_id, line_no, line_item_id), with sums over all its pairs.

    Columns: item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc.
    """
    lines = lines_of(sale_lines)
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), cents(F.col("price").cast("double")).alias("p"))
    kinds = written(lines.groupBy("item", "u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "kinds")
    points = written(kinds.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")), "points")
    # what an item's own lines add to its band
    wanted = known.where("item_id IS NOT NULL AND p IS NOT NULL").distinct()
    gap = F.abs(F.col("u") - F.col("p"))
    own = wanted.hint("merge").join(kinds, F.col("item_id") == F.col("item")).where(_in_band(F.col("p"), F.col("u")))
    own = own.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(gap * F.col("n")).alias("own_gap"), F.sum("crc").alias("own_crc"))
    own = written(wanted.hint("merge").join(own, ["item_id", "p"], "left").na.fill(0), "own")
    # each price: sums over its band, and the points among which the first lines of its items are
    met = _within(own.groupBy("p").agg(F.max("own_n").alias("most")), points)
    earlier = Window.partitionBy("p").orderBy("gap", "u").rowsBetween(Window.unboundedPreceding, -1)
    ranked = met.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    needed = F.when(F.col("before") < F.col("most") + k, F.struct("gap", "u", "before"))
    priced = ranked.groupBy("p").agg(F.sum("n").alias("all_n"), F.sum(F.col("gap") * F.col("n")).alias("all_gap"), F.sum("crc").alias("all_crc"), F.collect_list(needed).alias("near"))
    priced = written(priced, "prices")
    heads = _first_lines(lines, k).select(F.col("u").alias("v"), "lines")
    near = priced.select("p", F.inline("near")).hint("merge").join(heads, F.col("u") == F.col("v"))
    near = near.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("gap", "u", "before", "lines"))).alias("near"))
    priced = written(priced.drop("near").hint("merge").join(near, "p"), "near")
    found = known.hint("merge").join(own, ["item_id", "p"], "left").hint("merge").join(priced, "p", "left")

    def of_point(x: Column) -> Column:
        others = F.filter(x["lines"], lambda s: s["item"] != F.col("item_id"))
        return F.transform(others, lambda s: F.struct(x["gap"].alias("gap"), x["u"].alias("u"), s["sale_id"].alias("sale_id"), s["line_no"].alias("line_no"), s["item"].alias("line_item_id")))

    near = F.filter("near", lambda x: x["before"] < F.col("own_n") + k)
    pairs = F.when(F.col("own_n").isNotNull(), F.slice(F.flatten(F.transform(near, of_point)), 1, k))
    sums = [F.coalesce(F.when(F.col("own_n").isNotNull(), F.col(f"all_{c}") - F.col(f"own_{c}")), F.lit(0)).alias(name) for c, name in (("n", "n_pairs"), ("gap", "gap_sum"), ("crc", "lines_crc"))]
    rows = found.select("item_id", *sums, F.posexplode_outer(pairs).alias("pos", "pair"))
    return rows.select("item_id", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"), *(F.col(f"pair.{c}").alias(c) for c in ("gap", "u", "sale_id", "line_no", "line_item_id")), "n_pairs", "gap_sum", "lines_crc")
