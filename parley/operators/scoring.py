"""Evaluation metrics as grouped aggregates; ratios are taken of sums, so partial sums may be merged."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.distances import split_errors, word_and_letter_distances
from parley.operators import ranks


def ratio(a: Column, b: Column) -> Column:
    """a / b with a denominator of one at least."""
    return a / F.greatest(b, F.lit(1))


def error_rates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Word and character error rates of arrays of words ref and hyp (null counts as empty)."""
    hyp = F.coalesce("hyp", F.array().cast("array<string>"))
    scored = pairs.select(*keys, F.size("ref").alias("_rw"), F.length(F.array_join("ref", " ")).alias("_rc"), word_and_letter_distances(hyp, F.col("ref")).alias("_e"))
    scored = scored.select(*keys, "_rw", "_rc", F.col("_e.words").alias("_we"), F.col("_e.letters").alias("_ce"))
    total = lambda c: F.sum(c).cast("long")
    return scored.groupBy(*keys).agg(
        total("_rw").alias("ref_words"),
        total("_we").alias("word_errors"),
        total("_ce").alias("char_errors"),
        F.round(F.try_divide(F.sum("_we"), F.sum("_rw")), 9).alias("wer"),
        F.round(F.try_divide(F.sum("_ce"), F.sum("_rc")), 9).alias("cer"),
    )


def text_fractions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Shares of texts with punctuation, capitals and digits; the number of blank ones."""
    share = lambda pattern: F.round(F.avg(F.col(text).rlike(pattern).cast("int")), 9)
    return df.groupBy(*keys).agg(share("[.,!?;:]").alias("punctuation"), share(r"\p{Lu}").alias("capitals"), share(r"\d").alias("digits"), F.count_if(~F.col(text).rlike(r"(?U)\S")).alias("empty"))


def real_time_factor(items: DataFrame, keys: list[str]) -> DataFrame:
    """Processing and CPU seconds per second of audio; null without audio."""
    over = lambda c: F.try_divide(F.sum(c), F.nullif(F.sum("duration"), F.lit(0.0)))
    return items.groupBy(*keys).agg(over("proc_s").alias("rtf"), over("cpu_s").alias("cpu_rtf"))


def best_run(runs: DataFrame, keys: list[str], time: str = "proc_s", cpu: str = "cpu_s") -> DataFrame:
    """The fastest run of each item, with that run's CPU time."""
    return runs.groupBy(*keys).agg(F.min(F.struct(time, cpu)).alias("_b")).select(*keys, "_b.*")


def matched_subset(items: DataFrame, model: str, dataset: str, order: str) -> DataFrame:
    """The first items of each model and data set, as many as the model with the fewest has."""
    least = items.groupBy(model, dataset).agg(F.count(F.lit(1)).alias("_n")).groupBy(F.col(dataset).alias("_d")).agg(F.min("_n").alias("_least"))
    numbered = ranks.placed(items, [model, dataset], [order], "_place")
    return numbered.join(least, numbered[dataset] == F.col("_d")).filter("_place <= _least").drop("_place", "_least", "_d")


def restricted(items: DataFrame, allowed: DataFrame, model: str, dataset: str, order: str, limit: int | None = None) -> DataFrame:
    """Items of the models and data sets that ``allowed`` pairs, of each pair the first ``limit``; a model that it lacks keeps all its sets."""
    pairs = allowed.select(F.col(model).alias("_m"), F.col(dataset).alias("_s")).distinct()
    listed = pairs.select("_m").distinct().withColumn("_listed", F.lit(True))
    met = items.join(listed, items[model] == F.col("_m"), "left").drop("_m")
    met = met.join(pairs.withColumn("_paired", F.lit(True)), (met[model] == F.col("_m")) & (met[dataset] == F.col("_s")), "left").drop("_m", "_s")
    kept = met.filter("_listed IS NULL OR _paired").drop("_listed", "_paired")
    return kept if limit is None else ranks.placed(kept, [model, dataset], [order], "_place").filter(F.col("_place") <= limit).drop("_place")


def set_totals(items: DataFrame, dataset: str, seconds: str) -> DataFrame:
    """Per data set its items (n) and minutes of audio."""
    return items.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)) / 60, 6).alias("minutes"))


def confusion(items: DataFrame, keys: list[str], label: str, speaker: str, weight: Column) -> DataFrame:
    """Weight of each label and speaker of a key; label null is unlabelled."""
    return items.groupBy(*keys, label, speaker).agg(F.sum(weight).cast("long").alias("weight"))


def majority(items: DataFrame, keys: list[str], label: str, cluster: str, weight: Column) -> DataFrame:
    """The cluster with most weight of each label, ties to the smaller cluster."""
    sums = items.groupBy(*keys, label, cluster).agg(F.sum(F.greatest(weight, F.lit(1))).alias("_w"))
    return sums.groupBy(*keys, label).agg(F.max(F.struct("_w", (-F.col(cluster)).alias("_c"))).alias("_m")).select(*keys, label, (-F.col("_m._c")).alias(cluster))


def equal_error_rate(pairs: DataFrame, keys: list[str], score: str, same: str, low: float = -0.2, step: float = 0.006, steps: int = 201) -> DataFrame:
    """threshold and eer where false rejections and acceptances differ least, the first such on a grid.

    Scores are counted into the grid's cells first, so the grid is joined with its own size of rows.
    """
    cell = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((F.col(score) - F.lit(low)) / F.lit(step)).cast("int") + 1))
    counted = pairs.groupBy(*keys, cell.alias("_c")).agg(F.count_if(F.col(same)).alias("_s"), F.count_if(~F.col(same)).alias("_d"))
    return error_rate_of_cells(counted, keys, low, step, steps)


def error_rate_of_cells(counted: DataFrame, keys: list[str], low: float = -0.2, step: float = 0.006, steps: int = 201) -> DataFrame:
    """The same from the numbers of same (_s) and different (_d) pairs in each of the grid's cells (_c)."""
    grid = counted.select(*keys).distinct().withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*keys).orderBy("_c")
    full = grid.join(counted, [*keys, "_c"], "left").fillna(0, ["_s", "_d"])
    sums = full.select(*keys, "_c", F.sum("_s").over(w).alias("_below_s"), F.sum("_d").over(w).alias("_below_d"), F.sum("_s").over(Window.partitionBy(*keys)).alias("_all_s"), F.sum("_d").over(Window.partitionBy(*keys)).alias("_all_d"))
    frr, far = ratio(F.col("_below_s"), F.col("_all_s")), 1 - ratio(F.col("_below_d"), F.col("_all_d"))
    best = F.min(F.struct(F.round(F.abs(frr - far), 12).alias("gap"), F.col("_c").alias("c"), ((frr + far) / 2).alias("eer"))).alias("_b")
    return sums.filter(F.col("_c") < steps).groupBy(*keys).agg(best).select(*keys, F.round(F.lit(low) + F.lit(step) * F.col("_b.c"), 9).alias("threshold"), F.round("_b.eer", 9).alias("eer"))


PAIR_BLOCK = 8192  # vectors
TILE_ROWS, TILE_COLUMNS = 128, 1024  # whose scores are held at once


def units(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each length, the places of its vectors and these at length one; others (score 0) are left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null number is nan
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts, found = np.cumsum(lengths) - lengths, []
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        x = values[starts[at, None] + np.arange(n)]
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        fine = (size > 0) & (size < np.inf)
        if fine.any():
            found.append((at[fine], x[fine] / size[fine, None]))
    return found


def _cells_of(scores: np.ndarray, low: float, step: float, steps: int) -> np.ndarray:
    """The grid's cells of scores in double precision."""
    return np.clip(np.floor((np.round(scores, 6) - low) / step).astype(np.int64) + 1, 0, steps)


def _by_label(ids: np.ndarray, labels: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """ids, labels and units, which are in the labels' order."""
    order = [np.argsort(labels[at], kind="stable") for at, _ in parts]
    return ids, labels, {x.shape[1]: (at[o], x[o]) for (at, x), o in zip(parts, order)}


def _couples(*columns: np.ndarray) -> int:
    """Pairs of rows that agree in all columns."""
    n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
    return int((n * (n - 1) // 2).sum())


def tile_cells(a: tuple, b: tuple, one: bool, low: float, step: float, steps: int) -> np.ndarray:
    """Numbers of same and of different pairs in each cell, of two blocks of (ids, labels, units); with ``one`` of a block with itself.

    Products in single precision tell the cells of all scores but those so near a border that their errors or the
    rounding might cross it; these are computed in double precision.
    """
    (ids, of_a, full_a), (others, of_b, full_b) = _by_label(*a), _by_label(*b)
    met = np.zeros((2, steps + 1), np.int64)  # same, all
    for width in full_a.keys() & full_b.keys():
        (i, x), (j, y) = full_a[width], full_b[width]
        near = (6.5e-8 * (width + 4) + 6e-7) / step + 4e-7 * steps  # in steps; the products' sizes add up to 1 at most
        xs, ys = (x / step).astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
        for r in range(0, len(i), TILE_ROWS):
            p, own = slice(r, r + TILE_ROWS), of_a[i[r : r + TILE_ROWS]]
            for c in range(0, len(j), TILE_COLUMNS):
                q, other = slice(c, c + TILE_COLUMNS), of_b[j[c : c + TILE_COLUMNS]]
                g = xs[p] @ ys[:, q]
                g += np.float32(1 - low / step)
                floor = np.floor(g)
                g -= floor
                g -= np.float32(0.5)
                cell = np.clip(floor, 0, steps, out=floor).astype(np.int64)
                close = np.flatnonzero(np.abs(g, out=g).ravel() > 0.5 - near)
                k, m = np.divmod(close, len(other))
                cell.ravel()[close] = _cells_of(np.einsum("ij,ij->i", x[p][k], y[q][m]), low, step, steps)
                use = ids[i[p], None] < others[j[q]] if one else None
                met[1] += np.bincount(cell.ravel() if use is None else cell[use], minlength=steps + 1)
                if other[0] <= own[-1] and own[0] <= other[-1]:
                    same = own[:, None] == other
                    met[0] += np.bincount(cell[same if use is None else same & use], minlength=steps + 1)
    if one:
        want = [_couples(of_a) - _couples(of_a, ids), len(ids) * (len(ids) - 1) // 2 - _couples(ids)]
    else:
        n = max(of_a.max(), of_b.max()) + 1
        want = [int(np.bincount(of_a, minlength=n) @ np.bincount(of_b, minlength=n)), len(ids) * len(others)]
    met[:, _cells_of(np.zeros(1), low, step, steps)[0]] += want - met.sum(1)  # pairs without two vectors of one length
    return np.stack([met[0], met[1] - met[0]])


def pair_cells(vectors: DataFrame, id_col: str, label: str, vector: str, low: float = -0.2, step: float = 0.006, steps: int = 201) -> DataFrame:
    """_c, _s, _d over all pairs of rows with different ids, each pair once, by cosines rounded to six places.

    Rows are dealt into blocks of bounded size; each pair of blocks is one task's tile, which sends its cells' counts
    only. Rows without id or label are in no pair; cosines of null, empty, zero or not finite vectors are 0.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("l"), F.col(vector).alias("v"))
    blocks = max(1, math.ceil(rows.count() / PAIR_BLOCK))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    side = lambda own, other, to: rows.select(*[F.col(c).alias(f"{c}_{own}") for c in ("id", "l", "v", "b")], F.col("b").alias(own), F.explode(to).alias(other))
    left, right = side("x", "y", F.sequence("b", F.lit(blocks - 1))), side("y", "x", F.sequence(F.lit(0), "b"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        counts = np.zeros((2, steps + 1), np.int64)
        if a.num_rows and b.num_rows:
            one = a["b_x"][0].as_py() == b["b_y"][0].as_py()
            labels = pa.chunked_array([*a["l_x"].chunks, *b["l_y"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            ids, others = a["id_x"].to_numpy(), b["id_y"].to_numpy()
            counts = tile_cells((ids, labels[: len(ids)], units(a["v_x"])), (others, labels[len(ids) :], units(b["v_y"])), one, low, step, steps)
        return pa.table({"_c": pa.array(np.arange(steps + 1, dtype=np.int32)), "_s": pa.array(counts[0]), "_d": pa.array(counts[1])})

    tiles = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(run, "_c int, _s long, _d long")
    return tiles.groupBy("_c").agg(F.sum("_s").alias("_s"), F.sum("_d").alias("_d"))


def by_duration(items: DataFrame, keys: list[str], duration_ms: str, wrong: str) -> DataFrame:
    """Wrong and all milliseconds by length: under 1 s, under 2 s, under 7 s, longer; with the share of speech."""
    ms = F.col(duration_ms)
    bucket = F.when(ms < 1000, 0).when(ms < 2000, 1).when(ms < 7000, 2).otherwise(3)
    sums = items.groupBy(*keys, bucket.alias("bucket")).agg(F.sum(ms).alias("total_ms"), F.sum(F.when(F.col(wrong), ms).otherwise(0)).alias("wrong_ms"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return sums.withColumn("share", F.round(F.col("total_ms") / F.sum("total_ms").over(w), 9))


def difference_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the largest, mean and 99.9th percentile (between neighbours in proportion) of two arrays' absolute differences."""
    d = F.sort_array(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))
    at = (F.size(d) - 1) * F.lit(0.999)
    low = F.floor(at).cast("int")
    under, over = F.get(d, low), F.get(d, F.least(low + 1, F.size(d) - 1))
    mean = F.try_divide(F.aggregate(d, F.lit(0.0), lambda s, x: s + x), F.nullif(F.size(d), F.lit(0)))
    return df.withColumn("max_abs", F.array_max(d)).withColumn("mean_abs", mean).withColumn("p999_abs", under + (over - under) * (at - low))


def latencies(segments: DataFrame, keys: list[str], fed: str, arrived: str) -> DataFrame:
    """Per key the median and the 90th percentile, by nearest rank, of arrival after the end was fed."""
    late = segments.select(*keys, (F.col(arrived) - F.col(fed)).alias("late"))
    return ranks.percentiles(late, keys, "late", {"median": 0.5, "p90": 0.9})


MOST_CONFIGS = 10_000


def _best(scored: DataFrame, keys: list[str], config: Column, value: Column, better: str) -> DataFrame:
    """keys, config and mean of the best mean ``value``, ties to the smaller configuration."""
    means = scored.groupBy(*keys, config.alias("config")).agg(F.avg(value).alias("mean"))
    order = -F.col("mean") if better == "max" else F.col("mean")
    return means.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), "config", "mean")).alias("b")).select(*keys, "b.config", "b.mean")


def grid_search(items: DataFrame, grid: DataFrame, keys: list[str], value: Column, better: str = "max") -> DataFrame:
    """keys and the configuration (row of ``grid``, ``MOST_CONFIGS`` at most) of the best mean value, ties to the smaller configuration.

    ``value`` is computed of an item and a configuration.
    """
    configs = grid.limit(MOST_CONFIGS + 1).collect()
    if len(configs) > MOST_CONFIGS:
        raise ValueError(f"a grid has {MOST_CONFIGS} configurations at most")
    kinds = dict(grid.dtypes)
    listed = [F.struct(*[F.lit(c[n]).cast(kinds[n]).alias(n) for n in grid.columns]) for c in configs]
    each = items.select("*", F.inline(F.array(*listed))) if listed else items.limit(0).select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in grid.columns])
    return _best(each, keys, F.struct(*grid.columns), value, better).select(*keys, "config.*", "mean")


def staged_search(items: DataFrame, keys: list[str], name: str, coarse: list[float], finer: int, value: Column, better: str = "max") -> DataFrame:
    """keys, ``name`` and mean: the best of a parameter's ``coarse`` values (evenly apart), then of ``finer`` steps to either side of it.

    The finer steps end next to the neighbouring coarse values; ``value`` is computed of an item and the parameter. Both stages are
    aggregates of one plan. Means of the finer stage include the coarse best.
    """
    step = (coarse[1] - coarse[0]) / (finer + 1) if len(coarse) > 1 else 0.0
    first = _best(items.withColumn(name, F.explode(F.array(*map(F.lit, map(float, coarse))))), keys, F.col(name), value, better)
    around = F.transform(F.sequence(F.lit(-finer), F.lit(finer)), lambda k: F.round(F.col("_best") + k * F.lit(step), 9))
    best = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("config").alias("_best"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    fine = items.join(best, on).withColumn(name, F.explode(F.array_distinct(around)))
    return _best(fine, keys, F.col(name), value, better).select(*keys, F.col("config").alias(name), "mean")


def frames(spans: DataFrame, keys: list[str], name: str, frame_ms: int = 10) -> DataFrame:
    """keys, frame, name: the set of a column's values in each frame that their spans fill."""
    first, last = F.floor(F.col("start_ms") / frame_ms), F.floor(F.col("end_ms") / frame_ms) - 1
    filled = spans.filter(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    return filled.groupBy(*keys, "frame").agg(F.collect_set(name).alias(name))


def frame_scores(reference: DataFrame, hypothesis: DataFrame, keys: list[str], own: str = "me") -> DataFrame:
    """Per key: frames spoken, found, missed, false, with two speakers or more in the reference, and the user's own.

    own_hits, own_false and own_missed count frames that both, only the hypothesis, or only the reference give the user.
    """
    a, b = frames(reference, keys, "speaker"), frames(hypothesis, keys, "label")
    both = a.join(b, [*keys, "frame"], "full_outer")
    has = lambda c: F.col(c).isNotNull()
    mine = lambda c: F.coalesce(F.array_contains(c, own), F.lit(False))
    return both.groupBy(*keys).agg(
        F.count_if(has("speaker")).alias("spoken"),
        F.count_if(has("label")).alias("labelled"),
        F.count_if(has("speaker") & has("label")).alias("found"),
        F.count_if(has("speaker") & ~has("label")).alias("missed"),
        F.count_if(has("label") & ~has("speaker")).alias("false"),
        F.count_if(F.size("speaker") > 1).alias("overlapped"),
        F.count_if(mine("speaker") & mine("label")).alias("own_hits"),
        F.count_if(~mine("speaker") & mine("label")).alias("own_false"),
        F.count_if(mine("speaker") & ~mine("label")).alias("own_missed"),
    )


def purity(reference: DataFrame, hypothesis: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the share of labelled frames with one speaker that are of their label's commonest speaker."""
    one = frames(reference, keys, "speaker").filter(F.size("speaker") == 1).select(*keys, "frame", F.col("speaker")[0].alias("speaker"))
    labelled = frames(hypothesis, keys, "label").select(*keys, "frame", F.explode("label").alias("label"))
    counted = one.join(labelled, [*keys, "frame"]).groupBy(*keys, "label", "speaker").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*keys, "label").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.groupBy(*keys).agg(F.round(F.sum("most") / F.sum("all"), 9).alias("purity"))


def threshold_sweep(pairs: DataFrame, keys: list[str], score: str, same: str, low: float, step: float, steps: int) -> DataFrame:
    """keys, threshold, precision, recall of calling pairs the same from each threshold of a grid on."""
    cell = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), F.floor((F.col(score) - F.lit(low)) / F.lit(step)).cast("int")))
    counted = pairs.groupBy(*keys, cell.alias("_c")).agg(F.count_if(F.col(same)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    grid = counted.select(*keys).distinct().withColumn("_c", F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"))
    full = grid.join(counted, [*keys, "_c"], "left").fillna(0, ["_s", "_n"])
    sums = full.select(*keys, "_c", F.sum("_s").over(w).alias("_right"), F.sum("_n").over(w).alias("_called"), F.sum("_s").over(Window.partitionBy(*keys)).alias("_all"))
    return sums.filter("_c >= 0").select(*keys, F.round(F.lit(low) + F.lit(step) * F.col("_c"), 9).alias("threshold"), F.round(ratio(F.col("_right"), F.col("_called")), 9).alias("precision"), F.round(ratio(F.col("_right"), F.col("_all")), 9).alias("recall"))


def leakage(items: DataFrame, keys: list[str]) -> DataFrame:
    """Leaked words over far words and errors over reference words, as percentages of sums."""
    percent = lambda a, b: F.round(100 * F.try_divide(F.sum(a), F.nullif(F.sum(b), F.lit(0))), 6)
    return items.groupBy(*keys).agg(percent("leaked", "far_words").alias("leaked_pct"), percent("errors", "ref_words").alias("error_pct"))


def part_error_rates(items: DataFrame) -> DataFrame:
    """lang, position, words, errors, wer of two-part items (columns ref, hyp, boundary, langs)."""

    @F.pandas_udf("array<int>")
    def both(refs: pd.Series, hyps: pd.Series, boundaries: pd.Series) -> pd.Series:  # the alignment has no built-in form
        empty: list[str] = []
        return pd.Series([list(split_errors(list(r), empty if h is None else list(h), int(b))) for r, h, b in zip(refs, hyps, boundaries)])

    scored = items.withColumn("_e", both("ref", "hyp", "boundary"))
    part = lambda k, words: F.struct(F.get("langs", F.lit(k)).alias("lang"), F.lit(k).alias("position"), words.alias("words"), F.get("_e", F.lit(k)).alias("errors"))
    parts = scored.select(F.inline(F.array(part(0, F.col("boundary").cast("int")), part(1, (F.size("ref") - F.col("boundary")).cast("int")))))
    return parts.groupBy("lang", "position").agg(F.sum("words").alias("words"), F.sum("errors").alias("errors"), F.round(F.try_divide(F.sum("errors"), F.sum("words")), 9).alias("wer"))
