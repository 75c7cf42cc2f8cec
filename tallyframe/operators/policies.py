"""Search over all subsets of accepted policies, one pass over the lines.

A reference line belongs to one policy at most, so a subset moves it or leaves it, whatever else is in the subset. Each
line is compared once as it lies and, if a policy can move it, once as moved. Sums by policy then give every subset's count
of differences, and the best subset takes exactly the policies that lower it: no subset is listed and no line is joined
with subsets. Subsets are numbered as ``grading.policy_subsets`` does: none first, by size, then by the places they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _moved(category: str) -> Column:
    return F.when(F.array_contains("alternatives", F.lit(category)), F.lit(category)).otherwise(F.get("alternatives", F.lit(0)))


def touching(reference: DataFrame, category: str, period: str) -> DataFrame:
    """name and place (from 0, by first line) of the accepted policies that touch a bucket."""
    rows = reference.filter(F.col("is_counted") & (F.col("period") == period) & F.col("policy_name").isNotNull())
    rows = rows.filter((F.col("category") == category) | F.array_contains("alternatives", F.lit(category)))
    names = rows.groupBy(F.col("policy_name").alias("name")).agg(F.min("line_number").alias("line"))
    return names.select("name", (F.row_number().over(Window.orderBy("line", "name")) - 1).alias("place"))  # a row a policy


def separable_differences(reference: DataFrame, lines: DataFrame, bucket_lines: DataFrame, category: str, period: str) -> DataFrame:
    """name, applied, line_number, kind and effect of each line that differs: missing, misread or extra.

    ``name`` is the policy whose application decides (null: the line differs under every subset); ``applied`` says with or
    without it. reference: line_number, amount, category, period, is_counted, policy_name, alternatives, one row a line.
    bucket_lines: lines that the run counted in the bucket; lines: line_number, amount of the run.
    """
    rows = reference.filter(F.col("is_counted") & (F.col("period") == period))
    own = F.coalesce(F.col("category") == category, F.lit(False))
    touched = F.col("policy_name").isNotNull() & (own | F.coalesce(F.array_contains("alternatives", F.lit(category)), F.lit(False)))
    moved = F.when(touched, F.coalesce(_moved(category), F.col("category")) == category)
    ref = rows.select("line_number", F.col("amount").alias("reference"), F.when(touched, F.col("policy_name")).alias("name"), own.alias("own"), F.coalesce(moved, own).alias("moved"))
    ref = ref.filter("own or moved")
    counted = bucket_lines.select("line_number").distinct().join(lines.select("line_number", F.col("amount").alias("read")), "line_number", "left").withColumn("_in", F.lit(True))
    both = ref.withColumn("_ref", F.lit(True)).join(counted, "line_number", "full")
    # a line that belongs to no policy, or lies in the bucket either way, has one state; others two
    constant = F.col("_ref").isNull() | F.col("name").isNull() | (F.col("own") == F.col("moved"))
    state = lambda applied, here: F.struct(applied.cast("boolean").alias("applied"), F.coalesce(here, F.lit(False)).alias("here"))
    states = F.when(constant, F.array(state(F.lit(None), F.col("own")))).otherwise(F.array(state(F.lit(False), F.col("own")), state(F.lit(True), F.col("moved"))))
    both = both.select("line_number", "reference", "read", "_in", F.when(~constant, F.col("name")).alias("name"), F.inline(states))
    zero = F.lit(0).cast(MONEY)
    kind = F.when(F.col("here") & F.col("_in").isNull(), "missing").when(~F.col("here") & F.col("_in").isNotNull(), "extra").when(F.col("here") & ~F.col("read").eqNullSafe(F.col("reference")), "misread")
    effect = F.when(kind == "missing", -F.col("reference")).when(kind == "extra", F.coalesce("read", zero)).otherwise(F.coalesce("read", zero) - F.col("reference"))
    return both.select("name", "applied", "line_number", kind.alias("kind"), effect.cast(MONEY).alias("effect")).filter("kind is not null")


def scores(differences: DataFrame, policies: DataFrame) -> DataFrame:
    """name, place, and with and without each policy the number of differences and their effect; null name: of all subsets."""
    n = lambda c, name: F.count_if(c).alias(name)
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("effect"))), F.lit(0)).alias(name)
    on, off = F.coalesce("applied", F.lit(True)), ~F.coalesce("applied", F.lit(False))
    sums = differences.groupBy(F.col("name").alias("_name")).agg(n(on, "n_on"), n(off, "n_off"), total(on, "effect_on"), total(off, "effect_off"))
    base = policies.select("name", "place").unionByName(differences.sparkSession.createDataFrame([(None, None)], "name string, place int"))
    out = base.join(sums, F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name")
    return out.fillna(0, ["n_on", "n_off"]).withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(28,2)") for c in ("effect_on", "effect_off")})


def _ordinal(places: Column, count: Column) -> Column:
    """Number of the subset that holds the ascending ``places`` of ``count`` policies (62 at most)."""
    size = F.size(places).cast("long")
    n = count.cast("long")

    def choose(total: Column, k: Column) -> Column:
        """Binomial coefficients by a running product; whole at each step, in decimals."""
        steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
        product = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda a, i: F.call_function("div", a * (total - k + i).cast("decimal(18,0)"), i.cast("decimal(18,0)")).cast("decimal(38,0)"))
        return F.when((k < 0) | (total < k), F.lit(0).cast("decimal(38,0)")).otherwise(product)

    zero = F.lit(0).cast("decimal(38,0)")
    smaller = F.when(size > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), size - 1), zero, lambda a, k: (a + choose(n, k)).cast("decimal(38,0)"))).otherwise(zero)
    # of equal sizes those come first that hold the lower places: at each place that is left out, all that hold it are before
    start = F.struct(F.lit(0).cast("long").alias("held"), zero.alias("rank"))

    def walk(s: Column, p: Column) -> Column:
        inside = F.array_contains(places, p.cast("int"))
        left = size - s["held"] - 1
        more = F.when(inside | (s["held"] >= size), zero).otherwise(choose(n - p - 1, left))
        return F.struct((s["held"] + F.when(inside, 1).otherwise(0)).alias("held"), (s["rank"] + more).cast("decimal(38,0)").alias("rank"))

    rank = F.when(n > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), start, walk, lambda s: s["rank"])).otherwise(zero)
    return (smaller + rank).cast("long")


def best_subset(scored: DataFrame) -> DataFrame:
    """applied (names by place), ordinal, n and effect of the subset with the fewest differences, the first of equals."""
    taken = F.col("name").isNotNull() & (F.col("n_on") < F.col("n_off"))
    held = F.array_sort(F.collect_list(F.when(taken, F.struct("place", "name"))))  # a row a policy
    out = scored.agg(held.alias("held"), F.count("name").alias("of"), F.sum(F.when(taken, F.col("n_on")).otherwise(F.col("n_off"))).alias("n"), F.sum(F.when(taken, F.col("effect_on")).otherwise(F.col("effect_off"))).alias("effect"))
    places = F.transform("held", lambda x: x["place"].cast("int"))
    return out.select(F.transform("held", lambda x: x["name"]).alias("applied"), _ordinal(places, F.col("of")).alias("ordinal"), "n", F.col("effect").cast("decimal(28,2)").alias("effect"))


def differences_under(differences: DataFrame, subset: DataFrame) -> DataFrame:
    """The differences that one subset (a row with ``applied``) leaves."""
    applied = subset.select("applied").scalar()
    return differences.filter(F.col("applied").isNull() | (F.col("applied") == F.array_contains(applied, F.col("name"))))


def differences_by_subset(differences: DataFrame, subsets: DataFrame, limit: int = 1024) -> DataFrame:
    """The differences of every subset (ordinal, applied): as many rows as that has, so for ``limit`` subsets at most."""
    listed = subsets.select(F.struct("ordinal", "applied").alias("s")).agg(F.collect_list("s").alias("all"))
    listed = listed.select(F.when(F.size("all") <= limit, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {limit} subsets to list")).cast(listed.schema["all"].dataType)))
    fitting = F.filter("_all", lambda s: F.col("applied").isNull() | (F.col("applied") == F.array_contains(s["applied"], F.col("name"))))
    rows = differences.withColumn("_all", listed.scalar()).select(F.explode(fitting).alias("s"), "line_number", "kind", "effect")
    return rows.select("s.ordinal", "line_number", "kind", "effect")
