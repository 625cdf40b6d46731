"""Mixing by iterative proportional fitting (raking).

Documents are added up to cells (source, language, topic); the cells' token weights are scaled to the
target shares of each margin in turn, none above what its cell can give, ROUNDS times over all three. A document is then
kept with its cell's calibrated probability: the share of the token budget that the cell should have over what it
has. Because the limit is inside the fit, what a full cell can't give goes to the other cells of its margins. Where
all cells of a value are full, its target is out of reach and the sample falls short there; `achieved` tells by how much.

A document's topic is the form of its text (`form`) unless another expression or column is given.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MARGINS = ("source", "lang", "topic")
ROUNDS = 40
TEMPERATURE = 0.5
BUDGET = 0.5  # share of all tokens
MAX_DRIVER_CELLS = 50_000
NONE = "(none)"


def form(text: Column, n: Column) -> Column:
    """The form of a text of n characters: table (bars or tabs, one in fifty characters or more), shout (Latin vowels, none
    of them lower case), other (no Latin vowel; empty texts are so), short (under 200 characters), long (5,000 or
    more), prose for the rest. Looks for single characters only, so no text is copied but those with bars."""
    some = lambda letters: reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in letters])
    bars = 2 * n - F.length(F.replace(text, F.lit("|"), F.lit(""))) - F.length(F.replace(text, F.lit("\t"), F.lit("")))
    return (
        F.when(F.when(some("|\t"), bars * 50 >= n).otherwise(False), "table").when(~some("aeiou"), F.when(some("AEIOU"), "shout").otherwise("other"))
        .when(n < 200, "short").when(n >= 5000, "long").otherwise("prose")
    )


def _placed(docs: DataFrame, topic: Column | None) -> DataFrame:
    """row (all of a document's columns), id, source, lang, topic, n (characters); nulls as values of their own."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [F.struct("*").alias("row"), F.col("doc_id").alias("id"), word(F.col("source")).alias("source"), word(F.col("lang")).alias("lang")]
    n = F.length(text)
    return docs.select(*own, (form(text, n) if topic is None else word(topic)).alias("topic"), n.alias("n"))


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens (a quarter of the characters, 1 at least); nulls as values of their own."""
    return _placed(docs, topic).select(F.col("id").cast("long").alias("doc_id"), *MARGINS, F.greatest(F.lit(1), F.ceil(F.col("n") / 4)).cast("long").alias("tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))


def _share(own: DataFrame, margin: str, wanted: dict[str, float] | None, temperature: float) -> DataFrame:
    """(margin, target): given shares, else the tokens' share to the power `temperature`, normalised.
    Values without a given share keep none."""
    total = own.groupBy(margin).agg(F.sum("tokens").alias("t"))
    if wanted is not None:
        share = F.lit(0.0)
        for k, v in wanted.items():
            share = F.when(F.col(margin) == k, F.lit(float(v))).otherwise(share)
        total = total.withColumn("r", share)
    else:
        total = total.withColumn("r", F.pow(F.col("t").cast("double"), F.lit(temperature)))
    whole = total.agg(F.sum("r").alias("whole"))
    return total.crossJoin(F.broadcast(whole)).select(margin, (F.col("r") / F.col("whole")).alias("target"))  # one row joined


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE,
         budget: float | None = None, max_driver_cells: int = MAX_DRIVER_CELLS) -> DataFrame:
    """cells and `weight`, whose sums over each margin come to the targets (sum 1).

    Margins are taken in the order source, language, topic, `rounds` times. With a `budget` (a share of all
    tokens) no weight exceeds its cell's tokens over the budget's. Up to `max_driver_cells` cells (counted
    first) are fitted on the driver; more are fitted by Spark joins in the same order.
    """
    targets = targets or {}
    few = cells.limit(max_driver_cells + 1).count() <= max_driver_cells
    if few:
        t = cells.toPandas().sort_values(list(MARGINS), ignore_index=True)
        w = t["tokens"].to_numpy(np.float64)
        w = w / w.sum() if len(w) else w
        most = np.inf if budget is None else w / budget
        codes, goals = {}, {}
        for m in MARGINS:
            codes[m], names = t[m].factorize(sort=True)
            if m in targets:
                g = np.array([float(targets[m].get(x, 0.0)) for x in names])
            else:
                g = np.bincount(codes[m], weights=t["tokens"].to_numpy(np.float64)) ** temperature if len(t) else np.zeros(0)
            goals[m] = g / g.sum() if len(g) and g.sum() > 0 else g
        for _ in range(rounds):
            for m in MARGINS:
                now = np.bincount(codes[m], weights=w, minlength=len(goals[m])).astype(np.float64)
                w = np.minimum(w * np.divide(goals[m], now, out=np.zeros_like(now), where=now > 0)[codes[m]], most)
        t["weight"] = w
        return cells.sparkSession.createDataFrame(t, "source string, lang string, topic string, tokens long, weight double")
    whole = cells.agg(F.sum("tokens").alias("whole"))
    state = cells.crossJoin(F.broadcast(whole)).select(*cells.columns, (F.col("tokens") / F.col("whole")).alias("weight"))  # one row joined
    most = F.lit(float("inf")) if budget is None else F.col("weight") / F.lit(float(budget))
    state = state.withColumn("most", most)
    goals = {m: cut(_share(cells, m, targets.get(m), temperature)) for m in MARGINS}
    for _ in range(rounds):
        for m in MARGINS:
            now = state.groupBy(m).agg(F.sum("weight").alias("now")).join(goals[m], m)
            factor = now.select(m, F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias("factor"))
            state = state.join(factor, m).select(*cells.columns, F.least(F.col("weight") * F.col("factor"), F.col("most")).alias("weight"), "most")
        state = cut(state)
    return state.drop("most")


def calibrated(docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS,
               temperature: float = TEMPERATURE, topic: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(measured rows, cells with probability). probability = budget x all tokens x weight / the cell's tokens, 1 at most."""
    rows = measured(docs, topic)
    cells = cut(cells_of(rows))
    raked = rake(cells, targets, rounds, temperature, budget)
    whole = cells.agg(F.sum("tokens").alias("whole"))
    p = F.least(F.lit(1.0), F.lit(float(budget)) * F.col("whole") * F.col("weight") / F.col("tokens"))
    raked = raked.crossJoin(F.broadcast(whole)).select(*MARGINS, "weight", p.alias("probability"))  # one row joined
    return rows, raked


def achieved(docs: DataFrame, **how) -> DataFrame:
    """margin, value, target, kept_share (expected share of the sample's tokens) and budget_share
    (expected tokens over the whole budget; its sum over a margin is the part of the budget that is drawn)."""
    rows, raked = calibrated(docs, **how)
    wanted, temperature = how.get("targets") or {}, how.get("temperature", TEMPERATURE)
    cells = cut(cells_of(rows).join(raked, list(MARGINS)).withColumn("drawn", F.col("tokens") * F.col("probability")))
    whole = cells.agg(F.sum("tokens").alias("_all"), F.sum("drawn").alias("_drawn"))
    sums = [
        cells.groupBy(m).agg(F.sum("drawn").alias("drawn")).join(_share(cells, m, wanted.get(m), temperature), m).select(F.lit(m).alias("margin"), F.col(m).alias("value"), "target", "drawn")
        for m in MARGINS
    ]
    budget = F.lit(float(how.get("budget", BUDGET)))
    return reduce(DataFrame.unionByName, sums).crossJoin(F.broadcast(whole)).select(  # one row joined
        "margin", "value", "target", (F.col("drawn") / F.col("_drawn")).alias("kept_share"), (F.col("drawn") / (budget * F.col("_all"))).alias("budget_share"))


def draw(doc_id: Column) -> Column:
    """Uniform in [0, 1): the first 32 bits of the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(docs: DataFrame, **how) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, tokens, probability, kept.

    Null source or lang is a value of its own; a null text is empty (1 token). Rows with one doc_id
    share their draw. An empty table gives no rows. The cell table is joined, never one row per document.
    """
    rows, cells = calibrated(docs, **how)
    joined = rows.join(cells, list(MARGINS))
    return joined.select("doc_id", *MARGINS, "tokens", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def keep_sampled(docs: DataFrame, **how) -> DataFrame:
    """The sampled rows of `docs`, all columns as they are (whatever their names). Nulls and ties as in `sample`."""
    _, cells = calibrated(docs, **how)
    placed = _placed(docs, how.get("topic")).join(cells, list(MARGINS))
    return placed.where(draw(F.col("id")) < F.col("probability")).select("row.*")
