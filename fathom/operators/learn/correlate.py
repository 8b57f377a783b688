"""Correlations and dependencies between columns. Pairs of columns are pairs of expressions in one aggregation, never of rows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.learn.fit import normal_cdf
from fathom.operators.relational import average_ranks

LEAST_PAIRS, LEAST_R, MOST_P = 5, 0.3, 0.05


def p_value(r: Column, n: Column) -> Column:
    """Two-sided, from the t statistic through the normal approximation."""
    t = F.abs(r) * F.sqrt((n - 2) / (1 - r * r))
    return F.when(F.abs(r) >= 1, 0.0).when(n > 2, 2 * (1 - normal_cdf(t)))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, n, r, p) of every pair of numeric columns, over rows where both are given."""
    aggs, cells = [], []
    for i, (a, b) in enumerate(combinations(columns, 2)):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.count(F.when(both, 1)).alias(f"n{i}"), F.corr(F.when(both, x), F.when(both, y)).alias(f"r{i}")]
        cells.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")))
    out = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return out.withColumn("p", p_value(F.col("r"), F.col("n").cast("double")))


def notable(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs worth keeping, strongest first: enough rows, a coefficient of at least .3 and p below .05; all, or the first ``most`` of a report."""
    out = pairs.where((F.col("n") >= LEAST_PAIRS) & (F.abs("r") >= LEAST_R) & (F.col("p") < MOST_P)).orderBy(F.desc(F.abs("r")), "left", "right")
    return out if most is None else out.limit(most)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(left, right, n, r): Pearson's r of average ranks. Ranks are made per distinct value and joined back."""
    both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("k"))
    ranked = pairs.join(average_ranks(both, a, "ra"), a).join(average_ranks(both, b, "rb"), b)
    k, x, y = F.col("k").cast("double"), F.col("ra"), F.col("rb")
    s = ranked.agg(F.sum(k).alias("n"), F.sum(k * x).alias("sx"), F.sum(k * y).alias("sy"), F.sum(k * x * x).alias("sxx"), F.sum(k * y * y).alias("syy"), F.sum(k * x * y).alias("sxy"))
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col("n").cast("long").alias("n"), F.try_divide(top, bottom).alias("r"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(left, right, n, v) without bias correction. Chi-squared over the full table of categories is n*(sum o^2/(r*c) - 1), which
    the observed cells alone give, so empty cells need no cross join."""
    both = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("r")), cells.groupBy("b").agg(F.sum("o").alias("c"))
    s = cells.join(rows, "a").join(cols, "b").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("q"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    least = F.least("ka", "kb") - 1
    return s.select(F.lit(a).alias("left"), F.lit(b).alias("right"), "n", F.when(least > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("q") - 1) / least)).alias("v"))


def dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(determinant, dependent, groups, ratio): share of values of a that go with a single value of b."""
    groups = df.where(F.col(a).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("lo").eqNullSafe(F.col("hi")).cast("double")).alias("ratio")).select(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), "groups", "ratio")


def dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """dependency() of all ordered pairs from one pass: a row gives one cell per determinant, with the other columns' values, and the extremes of each
    value of a determinant tell all its dependents at once."""
    texts = {c: F.col(f"`{c}`").cast("string") for c in columns}
    cells = [F.struct(F.lit(a).alias("a"), texts[a].alias("v"), *[texts[b].alias(f"b{i}") for i, b in enumerate(columns)]) for a in columns]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v is not null")
    groups = long.groupBy("a", "v").agg(*[f(f"b{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))])
    rates = groups.groupBy("a").agg(F.count(F.lit(1)).alias("groups"), *[F.avg(F.col(f"lo{i}").eqNullSafe(F.col(f"hi{i}")).cast("double")).alias(f"r{i}") for i in range(len(columns))])
    rows = F.array(*[F.struct(F.lit(b).alias("dependent"), F.col(f"r{i}").alias("ratio")) for i, b in enumerate(columns)])
    return rates.select(F.col("a").alias("determinant"), "groups", F.explode(rows).alias("x")).select("determinant", "x.dependent", "groups", "x.ratio").where("determinant <> dependent")


def tuple_groups(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Columns joined by dependency pairs, as groups; at most the square of the number of columns of pairs."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups: dict[str, list[str]] = {}
    for x in sorted(parent):
        groups.setdefault(root(x), []).append(x)
    return sorted(groups.values())


def derived_text(df: DataFrame, target: str, parts: list[str], separators: list[str] = ["", " ", "-", "_", ".", "@", ", "]) -> DataFrame:  # noqa: B006
    """(target, left, separator, right, share): how much of a text column is left + separator + right, for all parts at once."""
    t = F.col(f"`{target}`")
    tries = [(a, s, b) for a, b in permutations(parts, 2) for s in separators]
    aggs = [F.avg((t == F.concat(F.col(f"`{a}`").cast("string"), F.lit(s), F.col(f"`{b}`").cast("string"))).cast("double")).alias(f"s{i}") for i, (a, s, b) in enumerate(tries)]
    cells = [F.struct(F.lit(target).alias("target"), F.lit(a).alias("left"), F.lit(s).alias("separator"), F.lit(b).alias("right"), F.col(f"s{i}").alias("share")) for i, (a, s, b) in enumerate(tries)]
    return df.where(t.isNotNull()).agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("share is not null")


def grid(df: DataFrame, a: str, b: str) -> DataFrame:
    """(left, right, left_values, right_values, pairs, completeness): whether two columns span a full panel."""
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count_distinct(a).alias("left_values"), F.count_distinct(b).alias("right_values"), F.count_distinct(a, b).alias("pairs"))
    return s.select(F.lit(a).alias("left"), F.lit(b).alias("right"), "*", F.try_divide(F.col("pairs"), F.col("left_values") * F.col("right_values")).alias("completeness"))


def grids(df: DataFrame, columns: list[str], most_values: int = 200, least: float = 0.9) -> DataFrame:
    """grid() of all pairs of columns with 2 to ``most_values`` values each that span at least ``least`` of their panel. Which columns have so few is one
    row, from which the pairs are chosen."""
    sizes = df.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in columns]).first()
    few = [c for c in columns if 2 <= sizes[c] <= most_values]
    parts = [grid(df, a, b) for a, b in combinations(few, 2)]
    if not parts:
        return grid(df, columns[0], columns[0]).where("1 = 0")
    return reduce(DataFrame.unionByName, parts).where(F.col("completeness") >= least)


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, low, high): what the values of a column lie between; the least is 0 where no value is negative."""
    aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max))]
    cells = [F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"a{i}") >= 0, 0.0).otherwise(F.col(f"a{i}")).alias("low"), F.col(f"z{i}").alias("high")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("high is not null")


def conditional(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, n, mean, std) per category with at least five values."""
    x = F.col(f"`{value}`").cast("double")
    return df.where(F.col(category).isNotNull() & x.isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).where("n >= 5")


def conditional_strength(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, value, categories, cv, depends): the coefficient of variation of group means; a column depends on a category of 2 to
    50 values if it is at least .15."""
    s = conditional(df, category, value).agg(F.count(F.lit(1)).alias("categories"), F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"))
    cv = F.when(F.abs("m") > 0, F.col("s") / F.abs("m"))
    return s.select(F.lit(category).alias("category"), F.lit(value).alias("value"), "categories", cv.alias("cv"), (F.col("categories").between(2, 50) & F.coalesce(cv >= 0.15, F.lit(False))).alias("depends"))


def arithmetic(df: DataFrame, columns: list[str], tolerance: float = 0.01, least: float = 0.95) -> DataFrame:
    """(target, left, op, right, share) of relations target = left op right that hold for at least ``least`` of rows. All c*(c-1)^2
    candidates are conditional averages of one aggregation."""
    tries = []
    for t in columns:
        for a, b in permutations([c for c in columns if c != t], 2):
            tries += [(t, a, op, b) for op in ("-", "/")] + ([(t, a, op, b) for op in ("+", "*")] if a < b else [])
    col = {c: F.col(f"`{c}`").cast("double") for c in columns}
    made = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y)}
    aggs, cells = [], []
    for i, (t, a, op, b) in enumerate(tries):
        v = made[op](col[a], col[b])
        aggs.append(F.avg((F.abs(col[t] - v) <= tolerance * F.greatest(F.lit(1.0), F.abs(col[t]))).cast("double")).alias(f"s{i}"))
        cells.append(F.struct(F.lit(t).alias("target"), F.lit(a).alias("left"), F.lit(op).alias("op"), F.lit(b).alias("right"), F.col(f"s{i}").alias("share")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*").where(F.col("share") >= least)


def orderings(df: DataFrame, columns: list[str]) -> DataFrame:
    """(low, high): pairs of columns where low <= high holds on every row that has both."""
    tries = list(permutations(columns, 2))
    aggs = [F.bool_and(F.col(f"`{a}`") <= F.col(f"`{b}`")).alias(f"s{i}") for i, (a, b) in enumerate(tries)]
    cells = [F.when(F.col(f"s{i}"), F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))) for i, (a, b) in enumerate(tries)]
    return df.agg(*aggs).select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")


__all__ = ["arithmetic", "conditional", "conditional_strength", "cramers_v", "dependencies", "dependency", "derived_text", "grid", "notable", "orderings", "p_value", "pearson", "spearman", "tuple_groups"]
