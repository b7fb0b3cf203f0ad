"""Relational operators of the engine, each on columns named by the caller.

All are DataFrame plans: two-phase aggregates, equi joins and windows over keys.  Policy
sides are dimensions of a few hundred rows; `dimension` checks that before a broadcast
hint is given and leaves the choice to Spark beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T

#: Rows up to which a policy side is broadcast by hint.
DIMENSION_ROWS = 100_000
#: Rows that one task sorts, about, where a size follows from the input and not from Spark's
#: number of shuffle partitions.
TASK_ROWS = 250_000


def dimension(df: DataFrame) -> DataFrame:
    """A broadcast hint for a side whose size is checked."""
    return F.broadcast(df) if df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else df


# -- joins -------------------------------------------------------------------------


def prefix_join(df: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows with every prefix that their name starts with (J7): one equi join over the
    beginnings of the name that have a length some prefix has, in place of a nested loop."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).distinct().collect())
    start = F.array_distinct(F.filter(F.array(*[F.substring(name, 1, n) for n in lengths]), lambda x: F.length(x) > 0))
    return df.withColumn("_start", F.explode(start)).join(dimension(prefixes), F.col("_start") == F.col(prefix)).drop("_start")


def contains_groups(df: DataFrame, column: str, groups: dict[str, list[str]], out: str = "group") -> DataFrame:
    """Rows with every group of which a literal occurs in the text."""
    found = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(x)) for x in lits]), F.lit(g)) for g, lits in groups.items()]))
    return df.withColumn(out, F.explode(found))


def dotted_prefix_join(df: DataFrame, name: str, modules: DataFrame, module: str, keys: list[str]) -> DataFrame:
    """Rows with the smallest module that is a dotted prefix of their name."""
    own = df.withColumn("_prefix", F.explode(T.dotted_prefixes(name))).join(dimension(modules), F.col("_prefix") == F.col(module))
    return own.groupBy(*keys).agg(F.min(module).alias(module))


def first_of_tables(df: DataFrame, key: str, tables: list[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """The value of the first table, in order, that has the key; with the table's name."""
    out, values, names = df, [], []
    for i, (table, dim, dim_key) in enumerate(tables):
        side = dim.select(F.col(dim_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(dimension(side), F.col(key) == F.col(f"_k{i}"), "left")
        values.append(F.col(f"_v{i}"))
        names.append(F.when(F.col(f"_k{i}").isNotNull(), F.lit(table)))
    return out.withColumn(value, F.coalesce(*values)).withColumn("resolved_table", F.coalesce(*names)).drop(*[f"_{x}{i}" for i in range(len(tables)) for x in "kv"])


def sibling_counts(df: DataFrame, group: str, stem: str, own: str) -> DataFrame:
    """Whether another row of the group has the wanted stem (J10, A4): the count of the stem
    in the group, less the row itself where it has that stem."""
    counts = df.groupBy(group, F.col(own).alias("_stem")).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_g")
    out = df.join(counts, (F.col(group) == F.col("_g")) & (F.col(stem) == F.col("_stem")), "left")
    return out.withColumn("resolves", F.coalesce(F.col("_n"), F.lit(0)) > F.when(F.col(stem) == F.col(own), 1).otherwise(0)).drop("_g", "_stem", "_n")


def suppress(hits: DataFrame, suppressors: DataFrame, scope: list[str], rule: str, subject: str | None = None) -> DataFrame:
    """Hits whose suppressors did not fire in the same scope (J11).  Suppressors are looked
    up among all hits, so suppression does not cascade.  suppressors: (rule, by) or, with a
    subject, hits are held against (scope, by, subject) with nulls equal."""
    fired = hits.select(*scope, F.col(rule).alias("by"), *([F.col(subject).alias("_s")] if subject else [])).distinct()
    silent = fired.join(dimension(suppressors.select(F.col(rule).alias("_rule"), "by")), "by").select(*scope, F.col("_rule").alias(rule), *(["_s"] if subject else [])).distinct()
    same = reduce(lambda a, b: a & b, [hits[c].eqNullSafe(silent[c]) for c in [*scope, rule]] + ([hits[subject].eqNullSafe(silent["_s"])] if subject else []))
    return hits.join(silent, same, "left_anti")


def as_of(df: DataFrame, key: str, order: list[str], is_mark: Column, value: str, out: str) -> DataFrame:
    """The value of the latest marked row before each row (J13), by one window a key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(is_mark, F.col(value)), ignorenulls=True).over(w))


def resume_merge(wanted: DataFrame, kept: DataFrame, key: str, value: str, fresh: Column) -> DataFrame:
    """Every wanted row with its kept value or else a fresh one."""
    side = kept.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return wanted.join(side, F.col(key) == F.col("_k"), "left").withColumn(value, F.coalesce("_v", fresh)).drop("_k", "_v")


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows without a cached answer."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


# -- aggregations ------------------------------------------------------------------


def group_findings(hits: DataFrame, keys: list[str], attributes: list[str], order: list[str], location: list[str], limit: int = 10) -> DataFrame:
    """Hits to findings (A1-A3): attributes of the first hit in emission order, the number of
    distinct locations, the first `limit` of them and whether there are more."""
    first = F.min_by(F.struct(*attributes), F.struct(*order)).alias("_first")
    places = F.array_sort(F.collect_set(F.struct(*location))).alias("_places")
    out = hits.groupBy(*keys).agg(first, places)
    return out.select(*keys, *[F.col(f"_first.{a}").alias(a) for a in attributes], F.size("_places").cast("long").alias("occurrences"), (F.size("_places") > limit).alias("truncated"), F.slice("_places", 1, limit).alias("locations"))


def posture_of(found: Column) -> Column:
    """The value of a set of postures (A5): mixed if any is, or for two definite ones."""
    definite = [F.array_contains(found, p).cast("int") for p in ("system", "bundled", "static")]
    n = reduce(lambda a, b: a + b, definite)
    one = F.when(F.array_contains(found, "system"), "system").when(F.array_contains(found, "bundled"), "bundled").otherwise("static")
    return F.when(F.array_contains(found, "mixed") | (n >= 2), "mixed").when(n == 1, one).when(F.array_contains(found, "unknown"), "unknown").otherwise("none")


def resolve_postures(df: DataFrame, keys: list[str], posture: str, out: str = "value") -> DataFrame:
    """One value a key from the postures of its rows."""
    return df.groupBy(*keys).agg(F.collect_set(posture).alias("_p")).select(*keys, posture_of(F.col("_p")).alias(out))


def by_precedence(df: DataFrame, keys: list[str], verdict: str, precedence: list[str]) -> DataFrame:
    """Distinct verdicts in order of precedence, and the first as the class."""
    rank = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col(verdict))
    seen = F.array_sort(F.collect_set(F.when(F.col(verdict).isNotNull(), F.struct(rank.alias("rank"), F.col(verdict).alias("name")))))
    out = df.groupBy(*keys).agg(F.transform(seen, lambda s: s["name"]).alias("classes"))
    return out.withColumn("class", F.coalesce(F.try_element_at("classes", F.lit(1)), F.lit(precedence[-1])))


def conditions_map(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """`<name>_linkage` -> value, in order of name (A10)."""
    pair = F.struct(F.concat(F.col(name), F.lit("_linkage")).alias("key"), F.col(value).alias("value"))
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("conditions"))


def merge_slices(df: DataFrame, keys: list[str], order: list[str], union: str, total: str, first: str, every: Column) -> DataFrame:
    """One row from the slices of a universal object (A13): union of names, sum of counts,
    the first known name, and a flag that all share."""
    known = F.when(F.col(first).isNotNull(), F.struct(*order))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(union)).alias("names"), F.sum(total).cast("long").alias("total"), F.min_by(first, known).alias("first_known"), F.bool_and(every).alias("all"))


# -- caps and windows --------------------------------------------------------------


def representative_cap(df: DataFrame, group: list[str], cap_key: list[str], pin: Column, order: list[str], limit: int) -> DataFrame:
    """At most `limit` rows a group that stand for all of it (W1): one for every key among the
    pinned, one for every other key, the other pinned, then the rest."""
    w = Window.partitionBy(*group, *cap_key).orderBy(F.when(pin, 0).otherwise(1), *order)
    turn = F.when((F.col("_rn") == 1) & pin, 1).when(F.col("_rn") == 1, 2).when(pin, 3).otherwise(4)
    out = df.withColumn("_rn", F.row_number().over(w)).withColumn("_turn", turn)
    out = out.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy("_turn", *order)))
    return out.where(F.col("_at") <= limit).drop("_rn", "_turn", "_at")


def finding_cap(objects: DataFrame, references: DataFrame, group: str, path: str, finding: list[str], limit: int) -> DataFrame:
    """At most `limit` objects a group, those first that findings need (W3): the first path of
    each finding, other paths that findings name, then the rest.

    Of the others and of the rest no more than the `limit` first ones can stay: where some of the
    rest do, all that come before them do too.  So both are cut while they lie dealt out by
    group and path, a bounded number of rows a task, and only what is left meets by group."""
    n = max(1, -(-objects.count() // TASK_ROWS))
    every = objects.select(group, path).repartition(n, group, path).distinct()
    named = references.select(group, path, *finding).repartition(n, group, path).distinct().join(every, [group, path], "left_semi")
    text = F.col(path).cast("string").alias("_o")

    def leading(df: DataFrame, turn: int) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(group).orderBy("_o", path))
        return df.select(group, path, F.lit(turn).alias("_c"), text).withColumn("_at", at).where(F.col("_at") <= limit).drop("_at")

    key = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in finding])
    first = named.groupBy(group, *finding).agg(F.min(path).alias(path)).select(group, path, F.lit(1).alias("_c"), key.alias("_o"))
    best = first.unionByName(leading(named.select(group, path).distinct(), 2)).unionByName(leading(every, 3)).groupBy(group, path).agg(F.min(F.struct("_c", "_o")).alias("_s"))
    at = F.row_number().over(Window.partitionBy(group).orderBy("_s", path))
    return best.withColumn("_at", at).where(F.col("_at") <= limit).select(group, path)


def numbered_duplicates(df: DataFrame, group: str, name: str, order: list[str], out: str) -> DataFrame:
    """The n-th row of a name gets #n."""
    n = F.row_number().over(Window.partitionBy(group, name).orderBy(*order))
    return df.withColumn("_n", n).withColumn(out, F.when(F.col("_n") > 1, F.concat(F.col(name).cast("string"), F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(name).cast("string"))).drop("_n")


def running_budget(df: DataFrame, group: str, order: list[str], size: str, budget: int, out: str) -> DataFrame:
    """How much of each row a running budget still pays for."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(out, F.greatest(F.lit(0), F.least(F.col(size), F.lit(budget) - before)).cast("long"))


def merge_intervals(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals as one (W8): gaps and islands."""
    w = Window.partitionBy(group).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (F.col(start) > top), 1).otherwise(0)
    out = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


# -- sets --------------------------------------------------------------------------


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side alone, with the side; nulls are equal."""
    a, b = a.distinct(), b.distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
