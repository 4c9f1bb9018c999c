"""Statistics over experiment results in long form (dataset, method, accuracy).

Everything but the final p-values is a Spark plan; what reaches the driver is a row of
sums for a pair of methods, or a row for each method.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.operators import heads

#: Studentized range quantiles at 0.05 over the root of 2, for 2 to 20 methods.
Q_05 = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544)
TIE = 1e-9


def pair(results: DataFrame, a: str, b: str) -> DataFrame:
    """(dataset, d): accuracy of a minus that of b, where both are known."""
    side = lambda m: F.max(F.when(F.col("method") == m, F.col("accuracy")))
    both = results.where(F.col("method").isin(a, b) & F.col("accuracy").isNotNull()).groupBy("dataset").agg(side(a).alias("a"), side(b).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("dataset", (F.col("a") - F.col("b")).alias("d"))


def win_tie_loss(d: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    return d.agg(count(F.col("d") > TIE).alias("wins"), count(F.abs("d") <= TIE).alias("ties"), count(F.col("d") < -TIE).alias("losses"), F.avg("d").alias("mean_difference"), F.count("*").alias("n"))


def average_rank(order: Column, *partition: str) -> Column:
    """Rank with ties sharing their mean rank."""
    by = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    same = Window.partitionBy(*partition, order) if partition else Window.partitionBy(order)
    return F.rank().over(by.orderBy(order)) + (F.count("*").over(same) - 1) / F.lit(2.0)


def signed_rank(d: DataFrame) -> DataFrame:
    """w_plus, w_minus, n and the normal statistic z of Wilcoxon's test; exact zeros are left out, z is null below five pairs.

    Equal sizes are counted by group first, so ranks come from a running sum over distinct sizes.
    """
    groups = d.where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count(F.when(F.col("d") > 0, 1)).alias("p"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.select("t", "p", (before + (F.col("t") + 1) / F.lit(2.0)).alias("r"))
    t, n = F.col("t"), F.col("n")
    sums = ranked.agg(
        F.coalesce(F.sum(F.col("p") * F.col("r")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((t - F.col("p")) * F.col("r")), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum(t * t * t - t), F.lit(0)).alias("tied")
    )
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / F.lit(24.0) - F.col("tied") / F.lit(48.0))
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / F.lit(4.0)) / spread
    return sums.select("w_plus", "w_minus", "n", F.when((n >= 5) & (spread > 0), z).alias("z"), "tied")


def signed_rank_p(w_plus: float, w_minus: float, n: int, tied: int, z: float | None) -> float:
    """Two-sided p: exact up to 50 untied pairs, else normal; NaN below five."""
    if n < 5:
        return float("nan")
    if n <= 50 and not tied:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(min(w_plus, w_minus)) + 1]) / 2**n)
    return math.erfc(abs(z) / math.sqrt(2)) if z is not None else float("nan")


def wilcoxon(results: DataFrame, a: str, b: str) -> dict:
    d = pair(results, a, b)
    sums, counts = signed_rank(d).first().asDict(), win_tie_loss(d).first().asDict()
    n = sums.pop("n")
    return {"a": a, "b": b, "p": signed_rank_p(n=n, **sums), "w_plus": sums["w_plus"], "w_minus": sums["w_minus"], "nonzero": n} | counts


def pair_table(results: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, mean_difference, wins, ties, losses, n, w_plus, w_minus, z) of many pairs of methods in one plan.

    z is Wilcoxon's normal statistic, null below five pairs that differ. Datasets meet by shuffle, the list of pairs is
    broadcast; equal sizes are counted first, so a pair's ranks are a running sum over its distinct differences.
    """
    known = results.where(F.col("accuracy").isNotNull()).select("dataset", "method", "accuracy")
    names = results.sparkSession.createDataFrame(list(pairs), "a string, b string")
    left = known.join(F.broadcast(names), F.col("method") == F.col("a")).select("dataset", "a", "b", F.col("accuracy").alias("x"))
    d = left.join(known.select("dataset", F.col("method").alias("b"), F.col("accuracy").alias("y")), ["dataset", "b"]).select("a", "b", (F.col("x") - F.col("y")).alias("d"))
    sizes = d.groupBy("a", "b", F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.sum("d").alias("total"))
    differ, t, up, nz = F.col("size") > 0, F.col("t"), F.col("up"), F.col("nz")
    before = F.coalesce(F.sum(F.when(differ, t)).over(Window.partitionBy("a", "b").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("r", before + (t + 1) / F.lit(2.0))
    of = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    sums = ranked.groupBy("a", "b").agg(
        (F.sum("total") / F.sum("t")).alias("mean_difference"), of(F.col("size") > TIE, up).alias("wins"), of(F.col("size") <= TIE, t).alias("ties"), of(F.col("size") > TIE, t - up).alias("losses"), F.sum("t").alias("n"),
        of(differ, up * F.col("r")).cast("double").alias("w_plus"), of(differ, (t - up) * F.col("r")).cast("double").alias("w_minus"), of(differ, t).alias("nz"), of(differ, t * t * t - t).alias("tied"),
    )
    spread = F.sqrt(nz * (nz + 1) * (2 * nz + 1) / F.lit(24.0) - F.col("tied") / F.lit(48.0))
    z = (F.least("w_plus", "w_minus") - nz * (nz + 1) / F.lit(4.0)) / spread
    return sums.withColumn("z", F.when((nz >= 5) & (spread > 0), z)).drop("nz", "tied")


def complete(results: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """Rows of datasets that have an accuracy for all (given) methods. Methods are few, datasets may be many."""
    known = results.where(F.col("accuracy").isNotNull())
    names = list(methods) if methods else [r.method for r in known.select("method").distinct().toLocalIterator()]
    known = known.where(F.col("method").isin(names))
    full = known.groupBy("dataset").agg(F.count_distinct("method").alias("k")).where(F.col("k") == len(names)).select("dataset")
    return known.join(full, "dataset", "left_semi")


def ranks(results: DataFrame) -> DataFrame:
    """results with rank: by accuracy within a dataset, best first, ties averaged, missing left out."""
    known = results.where(F.col("accuracy").isNotNull() & ~F.isnan("accuracy"))
    return known.withColumn("rank", average_rank(-F.col("accuracy"), "dataset"))


def ordinal_ranks(results: DataFrame) -> DataFrame:
    """Ranks without ties: equal accuracies by method name, missing ones last."""
    order = Window.partitionBy("dataset").orderBy(F.coalesce("accuracy", F.lit(-1.0)).desc(), "method")
    return results.withColumn("rank", F.row_number().over(order))


def average_ranks(results: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    return ranks(complete(results, methods)).groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def friedman(results: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """chi2 (corrected for ties), methods and datasets."""
    ranked = ranks(complete(results, methods))
    sums = ranked.groupBy("method").agg(F.sum("rank").alias("r"), F.count("*").alias("n")).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("k"), F.max("n").alias("n"))
    ties = ranked.groupBy("dataset", "accuracy").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    plain = 12 * F.col("rr") / (n * k * (k + 1)) - 3 * n * (k + 1)
    return sums.crossJoin(F.broadcast(ties)).select((plain / (1 - F.col("ties") / (n * (k * k * k - k)))).alias("chi2"), F.col("k").alias("methods"), F.col("n").alias("datasets"))


def chi2_tail(x: float, freedom: int) -> float:
    """P(chi-square > x), by the series or the continued fraction of the incomplete gamma function."""
    a, h = freedom / 2, x / 2
    if h <= 0:
        return 1.0
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= h / k
            total += term
        return 1 - total * scale
    b, c = h + 1 - a, 1e300
    d = f = 1 / b
    for i in range(1, 1000):
        m = -i * (i - a)
        b += 2
        d = 1 / (m * d + b)
        c = b + m / c
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return f * scale


def critical_difference(results: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """cd: the Nemenyi distance of mean ranks at 0.05."""
    size = average_ranks(results, methods).agg(F.count("*").alias("k"), F.max("n").alias("n"))
    q = F.get(F.array(*[F.lit(v) for v in Q_05]), F.col("k").cast("int") - 2)
    return size.select((q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"), F.col("k").alias("methods"), F.col("n").alias("datasets"))


def cliques(results: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """(first_rank, last_rank, members): maximal runs of methods whose mean ranks lie closer than the critical difference."""
    mean = average_ranks(results, methods).crossJoin(F.broadcast(critical_difference(results, methods).select("cd")))
    ordered = mean.select("method", "mean_rank", "cd", F.row_number().over(Window.orderBy("mean_rank", "method")).alias("i"))
    # methods are few: a range self-join over their mean ranks
    left, right = ordered.alias("l"), ordered.select(F.col("i").alias("j"), F.col("mean_rank").alias("other"), F.col("method").alias("name")).alias("r")
    runs = left.join(right, (F.col("j") >= F.col("i")) & (F.col("other") - F.col("mean_rank") < F.col("cd")))
    runs = runs.groupBy("i").agg(F.max("j").alias("last"), F.min("mean_rank").alias("first_rank"), F.max("other").alias("last_rank"), F.array_sort(F.collect_list("name")).alias("members"))
    reach = F.max("last").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("reach", F.coalesce(reach, F.lit(0))).where("last > i AND last > reach")
    return runs.select("first_rank", "last_rank", F.array_join("members", ",").alias("members"))


def mean_accuracy(results: DataFrame) -> DataFrame:
    """method, mean and population std of accuracy, datasets, and wins (ties win for all)."""
    best = F.max("accuracy").over(Window.partitionBy("dataset"))
    marked = results.where(F.col("accuracy").isNotNull()).withColumn("best", F.col("accuracy") == best)
    return marked.groupBy("method").agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.count("*").alias("n"), F.count(F.when(F.col("best"), 1)).alias("wins"))


def pareto(points: DataFrame) -> DataFrame:
    """(method, dims, accuracy) that no point of at most their dims reaches."""
    before = Window.orderBy("dims", F.col("accuracy").desc(), "method").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("top", F.max("accuracy").over(before)).where("top IS NULL OR accuracy > top").drop("top")


def combination_table(results: DataFrame, bases: Sequence[str], additions: Sequence[str]) -> DataFrame:
    """base, addition, mean gain of base+addition over base, and wins, ties, losses."""
    base = results.where(F.col("method").isin(list(bases)) & F.col("accuracy").isNotNull()).select("dataset", F.col("method").alias("base"), F.col("accuracy").alias("b"))
    names = {f"{b}+{a}": (b, a) for b in bases for a in additions}
    with_it = results.where(F.col("method").isin(list(names)) & F.col("accuracy").isNotNull())
    lookup = F.create_map(*[F.lit(x) for k, (b, a) in names.items() for x in (k, f"{b}\t{a}")])
    with_it = with_it.select("dataset", F.split(lookup[F.col("method")], "\t").alias("n"), F.col("accuracy").alias("c")).select("dataset", F.col("n")[0].alias("base"), F.col("n")[1].alias("addition"), "c")
    d = F.col("c") - F.col("b")
    count = lambda c: F.count(F.when(c, 1))
    return with_it.join(base, ["dataset", "base"]).groupBy("base", "addition").agg(F.avg(d).alias("gain"), count(d > TIE).alias("wins"), count(F.abs(d) <= TIE).alias("ties"), count(d < -TIE).alias("losses"))


def effective_rank(rows: DataFrame, column: str = "x") -> DataFrame:
    """Participation ratio of the covariance spectrum, from the Gram matrix of centred columns as partial sums over rows."""
    width = rows.select(F.size(column)).first()[0]
    n, mean = heads.block_sums(rows, (column,), lambda x: x.sum(0), width)
    _, gram = heads.block_sums(rows, (column,), lambda x: (x - mean / n).T @ (x - mean / n), width * width)
    gram = gram.reshape(width, width)
    return rows.sparkSession.createDataFrame([(float(np.trace(gram) ** 2 / (gram * gram).sum()),)], "effective_rank double")


def accuracy_table(results: DataFrame) -> DataFrame:
    """(dataset, method, accuracy, best, shown): what is best in its dataset is marked, in text too."""
    best = F.coalesce(F.col("accuracy") == F.max("accuracy").over(Window.partitionBy("dataset")), F.lit(False))
    shown = F.when(F.col("accuracy").isNotNull(), F.concat(F.format_string("%.4f", "accuracy"), F.when(best, " *").otherwise("")))
    return results.select("dataset", "method", "accuracy", best.alias("best"), shown.alias("shown"))


def rank_summary(results: DataFrame) -> DataFrame:
    """(method, mean_rank, std_rank, wins) of ordinal ranks, best mean rank first; every method counts in every dataset, a missing accuracy as worst."""
    cells = results.select("dataset").distinct().crossJoin(F.broadcast(results.select("method").distinct()))  # methods are few
    full = cells.join(results, ["dataset", "method"], "left")
    marked = ordinal_ranks(full).withColumn("best", F.col("accuracy") == F.max("accuracy").over(Window.partitionBy("dataset")))
    return marked.groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("std_rank"), F.count(F.when(F.col("best"), 1)).alias("wins")).orderBy("mean_rank", "method")


def grouped_ranks(results: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(part, method, mean_rank, datasets, cd): ranks and critical difference within each named group of at least three methods."""
    known = [r.method for r in results.select("method").distinct().toLocalIterator()]
    out = None
    for name, methods in groups.items():
        chosen = [m for m in methods if m in known]
        if len(chosen) < 3:
            continue
        mean = average_ranks(results, chosen).crossJoin(F.broadcast(critical_difference(results, chosen).select("cd")))
        part = mean.select(F.lit(name).alias("part"), "method", "mean_rank", F.col("n").alias("datasets"), "cd")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no group has three methods")
    return out
