"""Exact interpolated percentiles by refined histograms, on one path for groups of any size.

Values are counted in bins of a fixed monotone scale, with the least and greatest value of each bin. A wanted rank is
known once its bin's values are all equal, or when it is the first or last of its bin; the bins of the other ranks are
cut again between their own extremes, and only their values are counted. Counting combines map-side, a bin is one row a
task, and the bins of a group are ordered, never its values. Each round parts the extremes of an open bin at least, and
usually leaves one row in thousands; two rounds are common, and one does for small groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quintil.session import settle

BINS = 4096
HELD_BRACKETS = 10_000  # open bins that travel with the plan


def order_statistics(long: DataFrame, groups: Sequence[str], wanted: Column, bins: int = BINS) -> DataFrame:
    """(groups, n, place, value): the values at wanted ranks of each group of ``long``, whose column ``v`` is a number.

    ``wanted`` is an array of (place, rank from 0), which may depend on the group's row count ``n``; ranks past the end
    have no row. ``v`` holds neither NULL nor NaN; whole numbers stay exact to the last of 64 bits.
    """
    groups = list(groups)
    kind = long.schema["v"].dataType.simpleString()
    v = F.col("v").cast("double")
    cells = long.groupBy(*groups, F.floor(F.signum(v) * F.log1p(F.abs(v)) * bins).alias("bin")).agg(*_extremes())
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    counted = cells.select(*groups, "c", "lo", "hi", F.sum("c").over(whole).alias("n"), (F.sum("c").over(whole.orderBy("bin")) - F.col("c")).alias("start"))
    hits = settle(_hits(counted.withColumn("wanted", wanted), groups))
    found = hits.where("value IS NOT NULL")
    while True:
        bracket = [*groups, "n", "start", "lo", "hi"]
        brackets = hits.where("value IS NULL").groupBy(*bracket).agg(F.sort_array(F.collect_set(F.struct("place", "rank"))).alias("wanted"))
        few = brackets.limit(HELD_BRACKETS + 1).collect()
        if not few:
            break
        # A few brackets travel with the plan; beyond that number they are joined by a shuffle.
        known = F.broadcast(long.sparkSession.createDataFrame(few, brackets.schema)) if len(few) <= HELD_BRACKETS else settle(brackets)
        renamed = known.toDF(*[f"b_{c}" for c in known.columns])
        same = F.col("v").between(F.col("b_lo"), F.col("b_hi"))
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"b_{g}"))
        cells = long.join(renamed, same).groupBy(*groups, "b_n", "b_start", "b_wanted", _inside(kind, bins).alias("bin")).agg(*_extremes())
        before = F.sum("c").over(W.partitionBy(*groups, "b_start").orderBy("bin")) - F.col("c") + F.col("b_start")
        counted = cells.select(*groups, "c", "lo", "hi", F.col("b_n").alias("n"), before.alias("start"), F.col("b_wanted").alias("wanted"))
        hits = settle(_hits(counted, groups))
        found = found.unionByName(hits.where("value IS NOT NULL"))
    return found.select(*groups, "n", "place", "value")


def _inside(kind: str, bins: int) -> Column:
    """Bin of a value between the extremes of its bracket, the greatest value alone in the last."""
    v, lo, hi = F.col("v"), F.col("b_lo"), F.col("b_hi")
    if kind in ("double", "float"):
        # Halves cannot overflow; neighbouring numbers may have none between them.
        share = (v / 2 - lo / 2) / F.greatest(hi / 2 - lo / 2, F.lit(5e-324))
    else:
        # The values of a bracket have one sign, so that differences fit.
        share = (v - lo).cast("double") / (hi - lo).cast("double")
    return F.when(v == hi, bins).otherwise(F.floor(share * bins))


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), bins: int = BINS
) -> DataFrame:
    """Linear-interpolation percentiles: ``keys``, ``variable``, ``n``, array ``q``; groups without values have no row."""
    groups = [f"k{i}" for i in range(len(keys))] + ["variable"]
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    named = [F.col(f"`{k}`").alias(g) for k, g in zip(keys, groups)]
    long = df.select(*named, F.explode(entries).alias("s")).select(*groups[:-1], "s.*").where("v IS NOT NULL AND NOT isnan(v)")
    wanted = F.array(*[_rank(float(p), i, upper) for i, p in enumerate(probs) for upper in (0, 1)])
    found = order_statistics(long, groups, wanted, bins)

    collected = found.groupBy(*groups, "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    places = F.array(*[F.struct(F.lit(2 * i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])

    def point(x: Column) -> Column:
        position = x["p"] * (F.col("n") - 1)
        share = position - F.floor(position)
        low, high = F.element_at("m", x["i"]), F.element_at("m", x["i"] + 1)
        return F.when(share == 0, low).otherwise(low + share * (high - low))

    return collected.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], "variable", "n", F.transform(places, point).alias("q"))


def _extremes() -> list[Column]:
    return [F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]


def _rank(p: float, number: int, upper: int) -> Column:
    """The rank from 0 below or above a percentile's position, under its place among all."""
    position = F.lit(p) * (F.col("n") - 1)
    rank = F.ceil(position) if upper else F.floor(position)
    return F.struct(F.lit(2 * number + upper).alias("place"), rank.cast("long").alias("rank"))


def _hits(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The ranks that each bin holds, with their value where the bin's extremes tell it."""
    held = F.filter("wanted", lambda t: (t["rank"] >= F.col("start")) & (t["rank"] < F.col("start") + F.col("c")))
    rows = cells.select(*groups, "n", "start", "c", "lo", "hi", F.explode(held).alias("t")).select("*", "t.place", "t.rank")
    last = F.col("start") + F.col("c") - 1
    value = F.when((F.col("lo") == F.col("hi")) | (F.col("rank") == F.col("start")), F.col("lo")).when(F.col("rank") == last, F.col("hi"))
    return rows.select(*groups, "n", "start", "lo", "hi", "place", "rank", value.alias("value"))


def percentile_columns(df: DataFrame, keys: Sequence[str], spec: dict[str, dict[str, float]]) -> DataFrame:
    """Percentiles as named columns, one row per key.

    ``spec`` maps a source column to ``{output name: probability}``.
    """
    probs = sorted({p for outputs in spec.values() for p in outputs.values()})
    long = exact_percentiles(df, list(spec), probs, keys)
    wide: list[Column] = []
    for source, outputs in spec.items():
        for name, p in outputs.items():
            wide.append(F.max(F.when(F.col("variable") == source, F.col("q")[probs.index(p)])).alias(name))
    return long.groupBy(*keys).agg(*wide) if keys else long.agg(*wide)
