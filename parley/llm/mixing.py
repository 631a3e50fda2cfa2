"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found
by sections that are halved many times at once, to meet a target entropy of the weights or a limit
on how often a source's tokens repeat; each step is one aggregate over the sources, which stay a table.
A source's budget is whole epochs and a remainder. Its documents are dealt into blocks by a seeded
hash, and in every epoch the blocks are permuted by another; whole blocks go into the remainder
while they fit, and of the next block documents in hash order while they fit. So each document's
copies, and the places of each in its source's order (epoch, block, place), follow from its own
hashes and four numbers of its source, texts are not shuffled, and a source with a third of all rows
is as many blocks as it needs.

Cases: null sources are one source; a null text has no tokens; a source without tokens keeps each
document once; rows with one id and source are taken alike, rows without id by their texts; an empty table gives no rows; all other
columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import fresh, settle

MOST_BROADCAST = 100_000  # sources; more are joined by a shuffle
SECTIONS = 64


def token_count(text: Column) -> Column:
    """Words of a text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def exponent_for(totals: DataFrame, budget: float, target_entropy: float | None = None, most_repeats: float | None = None) -> tuple[float, float]:
    """The exponent that meets the target, and the log of the sum of the tempered shares.

    The target is the entropy in nats (exponents 0 to 64), or the smallest exponent within the
    repetition limit (at most 1); 1 without a target. ``totals`` has a row (source, rows, tokens) per source.
    """
    has = totals.filter("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    whole, most, least = has.agg(F.sum("t"), F.max("t"), F.min("t")).first()
    log = F.log(F.col("t") / F.lit(most))  # relative to the largest, so that no power overflows

    def sums(exponents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = has.select(log.alias("log"), F.posexplode(F.lit(exponents.tolist())).alias("k", "e")).withColumn("s", F.exp(F.col("e") * F.col("log")))
        rows = each.groupBy("k").agg(F.sum("s").alias("z"), F.sum(F.col("s") * F.col("log")).alias("l")).collect()  # one row per exponent
        rows.sort(key=lambda r: r.k)
        return np.array([r.z for r in rows]), np.array([r.l for r in rows])

    def holds(exponents: np.ndarray) -> np.ndarray:
        z, logs = sums(exponents)
        if target_entropy is not None:
            return np.log(z) - exponents * logs / z <= target_entropy
        # a power of at most one repeats the smallest source most
        return (least / most) ** (exponents - 1) / z * budget / most <= most_repeats * (1 + 1e-12)

    exponent = 1.0
    if target_entropy is not None or most_repeats is not None:
        low, high = 0.0, 64.0 if target_entropy is not None else 1.0
        if holds(np.array([low]))[0]:
            exponent = low
        else:
            for _ in range(9):  # 64 sections each time: to the last bits of a double
                steps = low + (high - low) * np.arange(1, SECTIONS) / SECTIONS
                first = int(np.argmax(np.append(holds(steps), True)))
                edges = [low, *steps.tolist(), high]
                low, high = edges[first], edges[first + 1]
            exponent = high
    return exponent, float(np.log(sums(np.array([exponent]))[0][0]) + exponent * np.log(most / whole))


@dataclass
class Plan:
    """Per source: rows, weight, epochs, and where the remainder ends; see ``with_copies``."""

    exponent: float
    sources: DataFrame
    number: int

    def beside(self, docs: DataFrame, source_col: str) -> tuple[DataFrame, dict[str, str]]:
        """``docs`` with its sources' columns, and the names that these have there."""
        names = {c: fresh(docs, f"mixture {c}") for c in self.sources.columns}
        sources = self.sources.select(*(F.col(c).alias(n) for c, n in names.items()))
        sources = F.broadcast(sources) if self.number <= MOST_BROADCAST else sources
        return docs.join(sources, F.col(source_col).eqNullSafe(F.col(names["source"]))), names


def _mark(id_col: str, text_col: str) -> Column:
    """What tells documents without id apart."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col))


def _hashes(id_col: str, mark: Column, source_col: str, seed: int, rows: Column, epoch: Column) -> tuple[Column, Column]:
    """A document's block, as the block's place in the epoch's permutation, and the document's place in its block."""
    blocks = F.ceil(F.sqrt(rows.cast("double"))).cast("long")  # as many blocks as a block has documents, about
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), mark), blocks)
    return F.xxhash64(F.lit(seed + 1), epoch, F.col(source_col), block), F.xxhash64(F.lit(seed + 2), F.col(id_col), mark)


def plan(docs: DataFrame, target_entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Plan:
    """What each source contributes to ``budget`` tokens (default: as many as there are)."""
    rows = settle(docs.select(F.col(id_col).alias("id"), _mark(id_col, text_col).alias("mark"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("tokens")))
    totals = settle(rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens")))
    number, whole = totals.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    exponent, weight, goal = 1.0, F.lit(0.0), F.lit(0)
    if whole:
        budget = float(whole) if budget is None else budget
        exponent, log_sum = exponent_for(totals, budget, target_entropy, most_repeats)
        weight = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(whole))) - F.lit(log_sum))).otherwise(0.0)
        goal = F.floor(weight * F.lit(budget) + F.lit(1e-6)).cast("long")
    some = F.greatest("tokens", F.lit(1))
    has = F.col("tokens") > 0
    epochs, left = F.when(has, F.floor(goal / some)).otherwise(1).cast("long"), F.when(has, goal % some).otherwise(0).cast("long")
    sources = settle(totals.select("source", "rows", weight.alias("weight"), epochs.alias("epochs"), left.alias("left")))
    dealt, names = Plan(exponent, sources, number).beside(rows, "source")
    block, place = _hashes("id", F.col("mark"), "source", seed, F.col(names["rows"]), F.col(names["epochs"]))
    dealt = dealt.select("source", F.col(names["left"]).alias("left"), "tokens", "id", block.alias("block"), place.alias("place"))
    blocks = dealt.groupBy("source", "left", "block").agg(F.sum("tokens").alias("tokens"))
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("block"))
    passing = blocks.withColumn("all", so_far).filter(F.col("all") > F.col("left"))  # the first of these does not fit whole
    edge = settle(passing.groupBy("source").agg(F.min_by(F.struct("block", (F.col("left") - F.col("all") + F.col("tokens")).alias("room")), "block").alias("e")).select(F.col("source").alias("s"), "e.block", "e.room"))
    few = F.broadcast(edge) if number <= MOST_BROADCAST else edge
    at_edge = dealt.alias("d").join(few.alias("e"), F.expr("d.source <=> e.s and d.block = e.block")).select("s", "room", "tokens", "place", "id")
    within = F.sum("tokens").over(Window.partitionBy("s").orderBy("place", "id"))
    last = at_edge.withColumn("all", within).filter("all <= room").groupBy("s").agg(F.max(F.struct("place", "id")).alias("last"))
    ends = edge.join(last.withColumnRenamed("s", "l"), F.expr("s <=> l"), "left").select("s", F.col("block").alias("edge"), "last")
    return Plan(exponent, settle(sources.join(ends, F.expr("source <=> s"), "left").drop("s", "left")), number)


def with_copies(docs: DataFrame, plan: Plan, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", name: str = "copies", with_places: bool = False, text_col: str = "text") -> DataFrame:
    """``docs`` with the number of copies of each row in the mixture, and its source's weight (name_weight).

    With places also its order in its source: name_blocks, of each copy (one an epoch) its block's
    place in that epoch's permutation, and name_place in the block. Columns of ``docs`` with one of
    these names are replaced.
    """
    joined, names = plan.beside(docs, source_col)
    c = {k: F.col(v) for k, v in names.items()}
    mark = _mark(id_col, text_col)
    block, place = _hashes(id_col, mark, source_col, seed, c["rows"], c["epochs"])
    fits = F.coalesce(F.struct(place.alias("place"), F.col(id_col).alias("id")) <= c["last"], F.lit(False))
    more = F.when(c["edge"].isNull() | (block > c["edge"]), 0).when(block < c["edge"], 1).otherwise(fits.cast("int"))  # without an edge nothing is left over
    copies = (c["epochs"] + more).cast("long")
    out = {name: copies, f"{name}_weight": c["weight"]}
    if with_places:
        epochs = F.filter(F.sequence(F.lit(0).cast("long"), copies), lambda k: k < copies)
        out |= {f"{name}_blocks": F.transform(epochs, lambda k: _hashes(id_col, mark, source_col, seed, c["rows"], k)[0]), f"{name}_place": place}
    return joined.withColumns(out).drop(*names.values())


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", with_places: bool = False, **wanted) -> DataFrame:
    """``docs`` with the same columns, each row as often as the mixture has it.

    With places each copy has its source's order besides: epoch (from 0), block (its place in that
    epoch's permutation of blocks) and place (in the block); they must not be names of ``docs``.
    """
    planned = plan(docs, seed=seed, id_col=id_col, source_col=source_col, **wanted)
    name = fresh(docs, "copies")
    while any(f"{name}_{k}" in docs.columns for k in ("weight", "blocks", "place")):
        name += "_"
    counted = with_copies(docs, planned, seed, id_col, source_col, name, with_places, wanted.get("text_col", "text"))
    if with_places:
        return counted.select("*", F.posexplode(f"{name}_blocks").alias("epoch", "block")).select(*docs.columns, "epoch", "block", F.col(f"{name}_place").alias("place"))
    epochs = F.filter(F.sequence(F.lit(0).cast("long"), F.col(name)), lambda k: k < F.col(name))
    return counted.withColumn(fresh(counted, "epoch"), F.explode(epochs)).select(*docs.columns)
