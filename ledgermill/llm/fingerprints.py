"""Document fingerprints (SimHash) and their neighbours, in DataFrame functions alone.

A term is a word; its weight grows with its length (short words are common ones), its hash votes with
that weight on each of 64 bits; a bit is set where the votes for it exceed half. Two counters of 32 bits
share a long, so 32 sums count all 64 bits.

Neighbours: the 64 bits are cut into six blocks; in each of 20 tables three of them are the key. Two
fingerprints that differ in up to three bits agree on three blocks at least, hence on the key of some
table. The pair is taken from the first table that it agrees in, so none is found twice. Equal
fingerprints are one row there.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_classes

RADIUS = 3
BITS = 64
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (shift, bits)
TABLES = tuple(itertools.combinations(range(len(BLOCKS)), 3))
LANES = 0x0000000100000001
ROWS_PER_BUCKET = 4_000
MAX_QUANTILES = 64
MAX_BROADCAST_BUCKETS = 100_000


def _terms(text: Column) -> Column:
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _votes(text: str, out: str, keys: list[str], df: DataFrame) -> DataFrame:
    """Adds `out`: the fingerprint of column `text` for each row of keys; the rest of df goes."""
    words = df.select(*keys, F.explode(_terms(F.col(text))).alias("_w"))
    n = F.length("_w")
    weighed = words.select(
        *keys,
        F.xxhash64("_w").alias("_h"),
        F.when(n == 0, 0).when(n <= 3, 1).otherwise(F.least(n, F.lit(12))).cast("long").alias("_v"),
    )
    lane = lambda i: F.sum(F.shiftright("_h", i).bitwiseAND(F.lit(LANES)) * F.col("_v")).alias(f"_b{i}")
    summed = weighed.groupBy(*keys).agg(F.sum("_v").alias("_all"), *map(lane, range(32)))
    total = F.lit(0).cast("long")
    for i in range(32):
        low = F.col(f"_b{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"_b{i}", 32)
        total = total.bitwiseOR(F.when(low * 2 > F.col("_all"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        top = (1 << i + 32) - (1 << 64 if i == 31 else 0)
        total = total.bitwiseOR(F.when(high * 2 > F.col("_all"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, total.alias(out))


def likeness(a: Column, b: Column) -> Column:
    """1 - differing bits / 64."""
    return (F.lit(BITS) - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def neighbours(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of column fp that differ in at most `radius` bits."""
    if not 0 <= radius <= 3:
        raise ValueError("three common blocks of six are sure up to three bits")
    part = lambda i: F.shiftrightunsigned("fp", BLOCKS[i][0]).bitwiseAND(F.lit((1 << BLOCKS[i][1]) - 1))
    keys = [
        F.shiftleft(part(i), 22).bitwiseOR(F.shiftleft(part(j), 11)).bitwiseOR(part(k)).bitwiseOR(F.lit(t << 34))
        for t, (i, j, k) in enumerate(TABLES)
    ]
    rows = fingerprints.select("fp").where("fp is not null").distinct().select("fp", F.explode(F.array(*keys)).alias("key"))
    a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    equal = [F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << n) - 1)) == 0 for s, n in BLOCKS]
    mask = sum((F.when(e, 1 << i).otherwise(0) for i, e in enumerate(equal)), F.lit(0))
    first = [next((t for t, c in enumerate(TABLES) if all(m >> i & 1 for i in c)), -1) for m in range(64)]
    first_table = F.element_at(F.array(*map(F.lit, first)), mask + 1)
    table = F.shiftrightunsigned("key", 34)
    near = (F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & (first_table == table)
    return a.join(b, "key").where(near).select("a", "b")


def _cuts(n: int, accuracy: int) -> Column:
    return F.percentile_approx("doc_id", [i / n for i in range(1, n)], accuracy)


def _place(c: Column, cuts: Column) -> Column:
    """How many cuts lie at or below c: all cuts of a level are looked at, MAX_QUANTILES - 1 at most."""
    return F.size(F.filter(cuts, lambda x: x <= c)).cast("long")


def _bucketed(src: DataFrame) -> tuple[DataFrame, int]:
    """(src with `bucket`, buckets in a quantile): ids cut into ordered ranges of about ROWS_PER_BUCKET rows; null ids get -1.

    Quantiles first, then those of each quantile's own ids, and so once more where rows ask for it: a range's size doesn't
    depend on how ids are spread, and only equal ids can make one large. Beyond MAX_QUANTILES ** 3 ranges they grow.
    Level by level a table of cuts is broadcast: 64 or 4,096 rows of 63 ids at most.
    """
    ids = src.select("doc_id").where("doc_id is not null")
    parts = max(1, -(-ids.count() // ROWS_PER_BUCKET))
    if parts == 1:
        return src.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long")), 1
    depth = next((d for d in (1, 2) if parts <= MAX_QUANTILES**d), 3)
    fan = max(2, min(MAX_QUANTILES, next(k for k in range(2, parts + 1) if k**depth >= parts)))
    first = ids.agg(_cuts(fan, 10_000).alias("q")).first()["q"]
    in_first = _place(F.col("doc_id"), F.array(*[F.lit(x).cast("long") for x in first]))
    known, placed = ids.withColumn("bucket", in_first), src.withColumn("bucket", in_first)
    for _ in range(1, depth):
        cuts = F.broadcast(cut(known.groupBy("bucket").agg(_cuts(fan, 2_000).alias("_cuts"))))
        deeper = (F.col("bucket") * fan + _place(F.col("doc_id"), F.col("_cuts"))).alias("bucket")
        known = known.join(cuts, "bucket").select("doc_id", deeper)
        placed = placed.join(cuts, "bucket", "left").select(*src.columns, deeper)
    return placed.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("bucket")).cast("long")), fan ** (depth - 1)


def _beside(heads: DataFrame, steps: int, value: str, up: bool) -> DataFrame:
    """heads (bucket, value, ...) and `beside`: the value of the next higher bucket that has rows (up) or of the next lower
    one; beyond the end the other end's. Buckets are looked at quantile by quantile; only a quantile's two ends meet
    on the driver, at most MAX_QUANTILES + 1 rows."""
    heads = heads.withColumn("group", F.floor(F.col("bucket") / steps))
    order = Window.partitionBy("group").orderBy(F.col("bucket") if up else F.desc("bucket"))
    first = F.min_by(value, "bucket") if up else F.max_by(value, "bucket")
    ends = [(r["group"], r["v"]) for r in heads.groupBy("group").agg(first.alias("v")).orderBy("group" if up else F.desc("group")).collect()]
    over = [(g, ends[(i + 1) % len(ends)][1]) for i, (g, _) in enumerate(ends)]
    across = heads.sparkSession.createDataFrame(over, f"group long, over {heads.schema[value].dataType.simpleString()}")
    placed = heads.withColumn("by", F.lead(value).over(order)).join(F.broadcast(across), "group")
    return placed.withColumn("beside", F.coalesce("by", "over")).drop("group", "by", "over")


def _small(rows: DataFrame) -> DataFrame:
    """A table of a row a bucket: broadcast while it is small, else joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST_BUCKETS + 1).count() <= MAX_BROADCAST_BUCKETS else rows


def edited(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, next_text, edited, bucket, rn for each row; buckets in a quantile).

    `next` goes down by doc_id (nulls last; rows of one id by text), after the last comes the first.
    Ids are cut into ranges of like size; a range is sorted by itself and gets the first row of the one
    below as a guest, so texts are moved once and no task sees the whole order.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src, steps = _bucketed(src)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    heads = cut(src.groupBy("bucket").agg(F.max("doc_id").alias("top")))  # a row a bucket
    if heads.isEmpty():
        return src.select("doc_id", "text", F.col("text").alias("next_text"), F.col("text").alias("edited"), "bucket", F.lit(1).alias("rn")), steps
    guests = cut(_beside(heads.withColumn("own", F.col("bucket")), steps, "own", up=True).select(F.col("bucket").alias("gb"), "top", F.col("beside").alias("into")))
    guest = src.join(_small(guests), F.expr("bucket = gb and doc_id <=> top"))
    w1 = Window.partitionBy("gb").orderBy(*order)
    guest = guest.withColumn("_n", F.row_number().over(w1)).where("_n = 1")
    guest = guest.select("doc_id", "text", F.col("into").alias("bucket"), F.lit(1).alias("guest"))
    both = src.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(guest)
    w = Window.partitionBy("bucket").orderBy("guest", *order)
    nxt = both.withColumn("next_text", F.lead("text").over(w)).withColumn("rn", F.row_number().over(w)).where("guest = 0")
    keep = F.length("text") - F.floor(F.length("text") / 3)
    changed = F.concat(F.substring(F.col("text"), F.lit(1), keep.cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(F.length("text") / 3).cast("int")))
    return nxt.select("doc_id", "text", "next_text", changed.alias("edited"), "bucket", "rn"), steps


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_near (other distinct fingerprints within the radius).

    Null texts are empty; a text without words has fingerprint 0. Equal texts have equal fingerprints.
    A single document is its own next. An empty table gives no rows. Other columns are ignored.
    """
    base, steps = edited(docs)
    # original and edited text as rows 0 and 1 of each document; `next` is read off the neighbour's row
    keys = ["bucket", "rn", "which", "doc_id", "n_chars", "sha"]
    pair = F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"))))
    rows = base.select("bucket", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), pair.alias("p"))
    rows = rows.select("bucket", "rn", "doc_id", "n_chars", "sha", F.col("p.which").alias("which"), F.col("p.t").alias("t"))
    voted = _votes("t", "fp", keys, rows)
    own = voted.groupBy("bucket", "rn", "doc_id", "n_chars", "sha").agg(
        F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("fe"))
    own = cut(own)
    last = cut(own.groupBy("bucket").agg(F.max("rn").alias("rn"), F.max(F.when(F.col("rn") == 1, F.col("fp"))).alias("head")))
    after = cut(_beside(last, steps, "head", up=False).select("bucket", "rn", F.col("beside").alias("over")))
    w = Window.partitionBy("bucket").orderBy("rn")
    own = own.withColumn("_lead", F.lead("fp").over(w)).join(_small(after), ["bucket", "rn"], "left")
    own = own.withColumn("fn", F.coalesce("_lead", "over"))
    pairs = neighbours(own.select("fp"), radius)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("_fp")).groupBy("_fp").agg(F.count("*").alias("n_near"))
    return join_classes(own, degree.withColumnRenamed("_fp", "fp"), "fp", "left").select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fe")).alias("near_edited"),
        likeness(F.col("fp"), F.col("fn")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
