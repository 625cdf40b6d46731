"""Counts, tables, percentiles and other groupings for reports and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import checkpointed


def tally(df: DataFrame, *keys: str) -> DataFrame:
    """E1, E23."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def inventory(df: DataFrame, value: str, n: int | None = None) -> DataFrame:
    """Values by falling count, then value; the first n if given."""
    t = tally(df, value).orderBy(F.desc("n"), value)
    return t.limit(n) if n else t


def zero_filled(df: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every combination of the (closed) vocabulary, 0 where nothing is."""
    return vocabulary.join(tally(df, *keys), keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def matrix(df: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts of both closed vocabularies against each other, zeros included."""
    return zero_filled(df, rows.select(row).crossJoin(F.broadcast(columns.select(column))), [row, column])  # two closed word lists


def scalar_counts(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(name, n) of many conditional counts, in one pass."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in measures.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, measures)), F.array(*measures))).alias("name", "n"))


def shared_values(df: DataFrame, value: str, also: dict[str, Column] | None = None) -> DataFrame:
    """Values of more than one row, with conditional counts."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in (also or {}).items()]).where("n > 1")


def duplicate_stats(df: DataFrame, value: str) -> DataFrame:
    """Groups of like values and rows in them, empties aside."""
    s = shared_values(df.where(F.col(value).cast("string") != ""), value)
    return s.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def nearest_rank(df: DataFrame, value: str, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, least, largest and number of the non-null values.

    Values are counted, the counts put in order by ranges of (keys, value), and ranks are summed within a range and
    then over the ranges before it, so a group of any size is spread over tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # written out, as a second look at the ranges could cut them elsewhere
    ranged = checkpointed(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    per = ranged.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p")).agg(F.sum("_n").alias("_m"))
    own, rows = Window.partitionBy(*[f"_k_{k}" for k in keys]), Window.partitionBy(*keys, "_part").orderBy(value)
    per = per.withColumns({"_before": F.sum("_m").over(own.orderBy("_p")) - F.col("_m"), "_all": F.sum("_m").over(own)}).drop("_m")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    ranked = ranged.join(per, same).select(*keys, value, "_n", "_part", "_before", "_all")
    ranked = ranked.withColumn("_upto", F.col("_before") + F.sum("_n").over(rows))
    wanted = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all")))
    one = lambda p: F.max(F.when((F.col("_upto") >= wanted(p)) & (F.col("_upto") - F.col("_n") < wanted(p)), F.col(value)))
    return ranked.groupBy(*keys).agg(F.max("_all").alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), *[one(p).alias(k) for k, p in at.items()])


def with_examples(df: DataFrame, group: str, example: str, order: str, n: int = 3) -> DataFrame:
    """Count and the first n distinct examples (by least row id).

    Examples are ranked apart from the counts, under a limit that holds before the shuffle, so no task sees all the
    distinct values of a large group.
    """
    firsts = checkpointed(df.groupBy(group, example).agg(F.min(order).alias("_o"), F.count("*").alias("_c")))
    w = Window.partitionBy(group).orderBy("_o", example)
    few = firsts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(example).alias("e")))).alias("_few"))
    total = firsts.groupBy(group).agg(F.sum("_c").alias("n"))
    return total.join(few, F.col(group).eqNullSafe(F.col("_g"))).select(group, "n", F.transform("_few", lambda x: x["e"]).alias("examples"))


def crosstab(df: DataFrame, row: str, column: str, total: str = "total") -> DataFrame:
    """(row, column, n) with totals of both sides."""
    c = df.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    side = lambda k, g: F.when(F.col(g) == 1, F.lit(total)).otherwise(F.col(k).cast("string")).alias(k)
    return c.select(side(row, "gr"), side(column, "gc"), "n")


def folding(df: DataFrame, raw: str, folded: Column) -> DataFrame:
    """Folded values with more than one raw spelling."""
    return df.groupBy(folded.alias("folded")).agg(F.countDistinct(raw).alias("spellings"), F.count("*").alias("n")).where("spellings > 1")


MAX_VOCABULARY = 10_000


def variation(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value) pairs that never occur, of all groups and values. Both are closed word lists: more than
    MAX_VOCABULARY of either stops the job."""
    pairs = df.select(group, value).distinct()
    g, v = pairs.select(group).distinct(), pairs.select(value).distinct()
    if max(x.limit(MAX_VOCABULARY + 1).count() for x in (g, v)) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} values: not a closed vocabulary")
    return g.crossJoin(F.broadcast(v)).join(pairs, [group, value], "left_anti")  # at most MAX_VOCABULARY a side


def term_counts(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(term, rows) that contain each term anywhere, in one pass."""
    one = df.agg(*[F.count_if(F.contains(F.lower(F.col(text)), F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("n")) for i, t in enumerate(terms)])).alias("x")).select("x.*")


def lengths(df: DataFrame, value: str) -> DataFrame:
    """Length distribution."""
    return tally(df.select(F.length(value).alias("chars")), "chars")


def domains(df: DataFrame, email: str) -> DataFrame:
    """E-mail domains and their local parts."""
    e = df.where(F.contains(email, F.lit("@"))).select(F.substring_index(email, "@", -1).alias("domain"), F.substring_index(email, "@", 1).alias("local"))
    return e.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("local").alias("locals"))


def count_distribution(df: DataFrame, key: str) -> DataFrame:
    """How many keys have one row, two, ..."""
    return tally(df, key).groupBy(F.col("n").alias("rows")).agg(F.count("*").alias("keys"))


def queue(items: list[DataFrame], kinds: list[str], n: int, states: list[str] | None = None) -> DataFrame:
    """One work list: kinds in their order, oldest first (unknown age last), then id; n + 1 rows,
    so that the caller sees whether there are more. An empty list of states selects nothing."""
    rows = items[0]
    for i in items[1:]:
        rows = rows.unionByName(i)
    if states is not None:
        rows = rows.where(F.col("state").isin(states) if states else F.lit(False))
    rank = F.lit(len(kinds))
    for i, k in enumerate(kinds):
        rank = F.when(F.col("kind") == k, i).otherwise(rank)
    return rows.orderBy(rank, F.col("age").asc_nulls_last(), "id").limit(n + 1)


def age_window(at: Column, as_of: str, window: str, zone: str = "Europe/Amsterdam") -> Column:
    """Today, week or older, by clinic midnights; a null time is in none. at: UTC clock readings (timestamp_ntz);
    the session's zone plays no part."""
    midnight = lambda back: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_sub(F.to_date(F.lit(as_of)), back).cast("timestamp_ntz"))
    t = at.cast("timestamp_ntz")
    return {"today": t >= midnight(0), "week": (t >= midnight(6)) & (t < midnight(0)), "older": t < midnight(6)}[window]


def search(df: DataFrame, q: str, columns: list[str], key: str, order: str, n: int = 10) -> DataFrame:
    """Rows whose text holds q (any case) or whose key is q; distinct, by lower-cased order, first n. Queries
    under two characters find nothing; % and _ are wildcards."""
    if len(q.strip()) < 2:
        return df.limit(0)
    hit = F.col(key).cast("string") == q
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{q}%")
    return df.where(hit).dropDuplicates([key]).orderBy(F.lower(order), key).limit(n)


def either_match(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, str]) -> DataFrame:
    """For each row of `a` that agrees with rows of `b` in any of the columns: their number by column and the least
    of them. One equi join with b's holders per value each (no OR join, never all pairs of a common value)."""
    out = None
    for n, (x, y) in enumerate(pairs):
        held = b.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("_v")).agg(F.count("*").alias("_n"), F.min(keys[1]).alias("_least"))
        one = a.select(F.col(keys[0]), F.col(x).alias("_v")).join(held, "_v").select(keys[0], F.lit(n).alias("_pair"), "_n", "_least")
        out = one if out is None else out.unionByName(one)
    count = [F.coalesce(F.sum(F.when(F.col("_pair") == n, F.col("_n"))), F.lit(0)).alias(f"by_{x}") for n, (x, _) in enumerate(pairs)]
    return out.groupBy(keys[0]).agg(F.min("_least").alias(keys[1]), *count)
