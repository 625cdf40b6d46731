"""Entity resolution by exact keys: keys, groups, tiers, survivors, merges, memberships."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that the session names; a folder of our own only in local mode where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    if named := spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(named)
        return
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "ledgermill-checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_PER_TASK = 50_000
HEAVY = 100_000  # rows of one value that don't go to one task


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Dealt out by keys into tasks of some 50,000 of n rows. Spark merges partitions by their compressed size, and rows that are
    much alike take a hundred times that in a task; a stated number of partitions stays."""
    return df.repartition(1 + n // ROWS_PER_TASK, *keys)


def held_values(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """rows whose `key` is a value of `known` (a column of that name); `rows` is read three times. Values that more than HEAVY rows have, which are few,
    are broadcast, so no value brings all of its rows to one task."""
    held = checkpointed(rows.groupBy(key).agg(F.count("*").alias("_n")).join(known.select(key), key, "left_semi"))
    heavy = F.broadcast(held.where(F.col("_n") > HEAVY).select(key))
    return rows.join(heavy, key, "left_semi").unionByName(rows.join(heavy, key, "left_anti").join(held.where(F.col("_n") <= HEAVY), key, "left_semi"))


def keys_of(rows: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """K1: (key, kind, value), a row per key that the record has; null and empty are never keys."""
    some = [F.when(v.isNotNull() & (v != ""), F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value"))) for k, v in parts.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*some))).alias("k")).select(key, "k.kind", "k.value")


def person_keys(name: Column, born: Column, email: Column, number: Column, phone: Column) -> dict[str, Column]:
    """K1: e-mail, number, phone, folded name with birth date."""
    return {"email": email, "number": number, "phone": phone, "name_born": F.when(born.isNotNull() & (fold(name) != ""), F.concat(fold(name), F.lit("|"), born.cast("string")))}


def shared_keys(a: Column, b: Column) -> Column:
    """J14."""
    return F.array_intersect(a, b)


def key_edges(keys: DataFrame, key: str) -> DataFrame:
    """Each holder of a key linked to the key's least holder: a star, never all pairs."""
    least = keys.groupBy("kind", "value").agg(F.min(key).alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    return keys.join(least, ["kind", "value"]).where(F.col(key) != F.col("_least")).select(F.col(key).alias("a"), F.col("_least").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """K2: (node, root) of undirected edges (a, b), root the least node.

    Each round takes the least label among neighbours, then the label's label (pointer jumping), so that
    chains need a logarithmic number of rounds. Labels are checkpointed; a count of changes ends the loop.
    """
    both = checkpointed(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("m"))
        stepped = label.join(near, label.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = stepped.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = checkpointed(stepped.join(up, stepped.root == up._n, "left").select("node", "old", F.least("root", F.coalesce("_r", "root")).alias("root")))
        changed = jumped.where("old <> root").limit(1).count()
        label = jumped.select("node", "root")
        if not changed:
            return label
    raise RuntimeError("labels did not settle")


def groups(keys: DataFrame, key: str) -> DataFrame:
    """K2: (key, root) of records in groups of two or more. The keys are written out first: they are read twice, and
    may be digests of long texts."""
    return components(key_edges(checkpointed(keys), key)).withColumnRenamed("node", key)


def matched_keys(keys: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """K3: (root, kind, value, holders) of keys that more than one record holds."""
    held = keys.groupBy("kind", "value").agg(F.countDistinct(key).alias("holders"), F.min(key).alias("_one")).where("holders > 1")
    p = placed.select(F.col(key).alias("_one"), "root")
    return held.join(p, "_one").select("root", "kind", "value", "holders")


def classify(members: DataFrame, fields: dict[str, Column], contradicting: list[str], identifying: list[str]) -> DataFrame:
    """Per root: size, contradictions, differences, tier.

    fields: comparable values (null for empty and for `unknown`). A contradiction: two values in a field of
    `contradicting` (tier 3). Tier 1: one and the same value in all of `identifying`, and nowhere two values.
    `differences` counts null as a value.
    """
    values = members.select("root", *[v.cast("string").alias(f"_{k}") for k, v in fields.items()])
    agg = values.groupBy("root").agg(
        F.count("*").alias("size"), *[F.countDistinct(f"_{k}").alias(f"d_{k}") for k in fields], *[F.count_if(F.col(f"_{k}").isNull()).alias(f"n_{k}") for k in fields])
    pick = lambda names, cond: F.array_compact(F.array(*[F.when(cond(k), F.lit(k)) for k in names])).cast("array<string>")
    several = lambda k: F.col(f"d_{k}") > 1
    differ = lambda k: F.col(f"d_{k}") + (F.col(f"n_{k}") > 0).cast("int") > 1
    same = F.lit(True)
    for k in identifying:
        same = same & (F.col(f"d_{k}") == 1) & (F.col(f"n_{k}") == 0)
    calm = F.lit(True)
    for k in fields:
        calm = calm & (F.col(f"d_{k}") <= 1)
    con = pick(contradicting, several)
    tier = F.when(F.size(con) > 0, 3).when(same & calm, 1).otherwise(2)
    return agg.select("root", "size", con.alias("contradictions"), pick(list(fields), differ).alias("differences"), tier.alias("tier"))


def survivors(members: DataFrame, key: str, busy: Column, signup: Column) -> DataFrame:
    """K5: per root the survivor and the clause that decided.

    Members with intakes first, then the later sign-up (null earliest), then the lower id. The clause comes from
    the runner-up among the narrowed set: busy members if there are any, else all.
    """
    m = members.select("root", F.col(key).alias("id"), busy.alias("busy"), F.coalesce(signup.cast("string"), F.lit("")).alias("signup"))
    w = Window.partitionBy("root").orderBy(F.desc("busy"), F.desc("signup"), "id")
    two = m.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    s = two.groupBy("root").agg(at(1, "id").alias("survivor"), at(1, "busy").alias("b1"), at(2, "busy").alias("b2"), at(1, "signup").alias("s1"), at(2, "signup").alias("s2"))
    alone = F.col("b2").isNull() | (F.col("b1") & ~F.col("b2"))
    # fixed values: the three clauses
    rule = F.when(alone, "survivor is the only row with intakes").when(F.col("s1") != F.col("s2"), "survivor signed up later").otherwise("survivor has the lower legacy id")
    return s.select("root", "survivor", rule.alias("rule"))


def merge_fields(pairs: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """K7: (survivor, loser, field, from_value, to_value): empty fields of a survivor that its loser fills.

    With several losers the lowest loser that has a value fills the field.
    """
    s = rows.select(F.col(key).alias("survivor"), *[F.col(f).cast("string").alias(f"s_{f}") for f in fields])
    lo = rows.select(F.col(key).alias("loser"), *[F.col(f).cast("string").alias(f"l_{f}") for f in fields])
    both = pairs.join(s, "survivor").join(lo, "loser")
    change = lambda f: F.when(
        (F.coalesce(f"s_{f}", F.lit("")) == "") & (F.coalesce(f"l_{f}", F.lit("")) != ""),
        F.struct(F.lit(f).alias("field"), F.col(f"s_{f}").alias("from_value"), F.col(f"l_{f}").alias("to_value")))
    out = both.select("survivor", "loser", F.explode(F.array_compact(F.array(*map(change, fields)))).alias("c")).select("survivor", "loser", "c.*")
    w = Window.partitionBy("survivor", "field").orderBy("loser")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_changes(rows: DataFrame, changes: DataFrame, key: str, fields: list[str], undo: bool = False) -> DataFrame:
    """Rows with the changes (survivor, field, from_value, to_value) applied, or taken back: the exact inverse."""
    side = "from_value" if undo else "to_value"
    per = changes.groupBy(F.col("survivor").alias("_k")).agg(*[F.max(F.when(F.col("field") == f, F.struct(F.col(side).alias("v")))).alias(f"_{f}") for f in fields])
    j = rows.join(per, rows[key] == per["_k"], "left")
    new = lambda f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v").cast(rows.schema[f].dataType)).otherwise(rows[f]).alias(f)
    return j.select(*[new(c) if c in fields else rows[c] for c in rows.columns])


def tier_one_merges(tiers: DataFrame, placed: DataFrame, chosen: DataFrame, key: str, decided: DataFrame | None = None) -> DataFrame:
    """K6: (survivor, loser) of tier 1 groups; losers that a person decided on are left alone."""
    ok = tiers.where("tier = 1").select("root").join(chosen, "root").join(placed, "root")
    pairs = ok.where(F.col(key) != F.col("survivor")).select("survivor", F.col(key).alias("loser"))
    return pairs if decided is None else pairs.join(decided.select(F.col(key).alias("loser")), "loser", "left_anti")


def survivor_of(parents: DataFrame) -> DataFrame:
    """K8: (id, survivor) from (id, parent); a null parent ends a chain. Pointer jumping doubles the step each
    round, so depth 100 takes seven. No chain is longer than the number of nodes: who still points on after that
    many steps is in a cycle, which stops the job."""
    hop = checkpointed(parents.select("id", F.coalesce("parent", "id").alias("up")))
    for _ in range(hop.count().bit_length() + 2):
        far = hop.select(F.col("id").alias("_i"), F.col("up").alias("_u"))
        nxt = checkpointed(hop.join(far, hop.up == far._i, "left").select("id", F.col("up").alias("old"), F.coalesce("_u", "up").alias("up")))
        moved = nxt.where("old <> up").limit(1).count()
        hop = nxt.select("id", "up")
        if not moved:
            bad = parents.where("parent is not null").join(hop.where("id = up"), "id", "left_semi").limit(1).count()
            if bad:
                raise ValueError("cycle in the parents")
            return hop.select("id", F.col("up").alias("survivor"))
    raise ValueError("cycle in the parents")


def members_of(chains: DataFrame, survivor) -> DataFrame:
    """K8, K9: the ids that a survivor stands for; join rows of any table to it."""
    return chains.where(F.col("survivor") == survivor).select("id")


def side_by_side(members: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every candidate as a row (root, key, fields) with the fields in which its group differs; null is a value."""
    value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("\0"))
    differ = members.groupBy("root").agg(*[(F.min(value(f)) != F.max(value(f))).alias(f"d_{f}") for f in fields])
    said = differ.select("root", F.array_compact(F.array(*[F.when(F.col(f"d_{f}"), F.lit(f)) for f in fields])).alias("differing"))
    return members.select("root", key, *fields).join(said, "root")


def overlap(groupings: dict[str, DataFrame], key: str) -> DataFrame:
    """How many records are in each pair of groupings (each a DataFrame of `key`)."""
    names = list(groupings)
    flags = None
    for n in names:
        one = groupings[n].select(key).distinct().withColumn(n, F.lit(1))
        flags = one if flags is None else flags.join(one, key, "full")
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) * F.col(b)).alias("n")) for i, a in enumerate(names) for b in names[i:]]
    return flags.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.coalesce(F.sum("p.n"), F.lit(0)).alias("n"))


def resolve_aliases(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """The current owner of each row's legacy key, and whether the row created it."""
    a = aliases.select(F.col("legacy_id").alias("_l"), F.col("patient_id"))
    return rows.join(a, rows[key] == a._l, "left").drop("_l")
