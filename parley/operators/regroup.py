"""Labels of finished streams anew, as rounds of joins between segments and cluster centres.

The seven steps are those of ``clustering.recluster``, on whole tables: sums of a cluster are partial
aggregates, segments meet centres in buckets of bounded size, and only what is as small as the labels (the
matrix of groups, small clusters, overlaps) is a kernel. A stream with a third of all segments is many
buckets; what is kept of one group at once is bounded by ``Knobs.most_items``.

Cases: a segment without a usable embedding, or with one of another length than most of its stream, follows the
majority of its label; a stream without any keeps its labels; ties go to the earlier segment, and
positions within a stream must differ; nulls in meeting or prefix are a stream of their own; an empty table gives no
rows; further columns are not read. Sums of vectors do not depend on the order but for rounding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import vectors
from parley.operators.clustering import Knobs, agglomerate, assign_best
from parley.session import settled

BUCKET = 4096  # segments that meet centres at once
SEP = "\x1f"


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def prepared(items: DataFrame, knobs: Knobs) -> DataFrame:
    """sid, pos, label, d, w, anchor, e (unit vector, null where it takes no part) and ``bucket`` of every row."""
    sid = F.concat_ws(SEP, F.coalesce(F.col("meeting_id").cast("string"), F.lit("\x00")), F.coalesce("prefix", F.lit("\x00")))
    ms = F.greatest(F.coalesce(F.col("duration_ms").cast("long"), F.lit(0)), F.lit(0))
    rows = items.select(
        sid.alias("sid"), "meeting_id", "prefix", "segment_id", F.col("pos").cast("long").alias("pos"), F.col("online_label").alias("label"), ms.alias("d"),
        vectors.duration_weight(ms).alias("w"), (ms >= max(knobs.short_ms, knobs.least_new_ms)).alias("anchor"), vectors.unit(F.col("embedding")).alias("e"),
    )
    lengths = rows.filter("e IS NOT NULL").groupBy("sid", F.size("e").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.groupBy("sid").agg(F.max(F.struct("n", (-F.col("size")).alias("size"))).alias("m"))
    common = common.select("sid", (-F.col("m.size")).alias("size"), F.ceil(F.col("m.n") / BUCKET).cast("int").alias("buckets"))
    met = rows.join(common, "sid", "left")
    fits = F.size("e") == F.col("size")
    return met.withColumn("e", F.when(fits, F.col("e"))).withColumn("bucket", F.pmod(F.xxhash64("pos"), F.coalesce("buckets", F.lit(1))).cast("int")).drop("size")


def _top(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each key the ``most`` longest rows, first those of every bucket."""
    order = [F.desc("d"), F.asc("pos")]
    for part in ([*keys, "bucket"], keys):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")
    return rows


def weighted_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: total (sum of w * e), mass, ms, n and first (position)."""
    key = F.concat_ws(SEP, *[F.col(k).cast("string") for k in keys])
    scaled = rows.select(key.alias("key"), F.transform("e", lambda x: x * F.col("w")).alias("v"))
    totals = vectors.sums(scaled, "key", "v").select("key", F.col("sum").alias("total"))
    plain = rows.groupBy(*keys).agg(F.sum("w").alias("mass"), F.sum("d").alias("ms"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).withColumn("key", key)
    return plain.join(totals, "key").drop("key")


def _grouped(rows: DataFrame, knobs: Knobs) -> DataFrame:
    """Rows with ``cluster``: labels, and unlabelled anchors by themselves, joined while they are similar; null where loose."""
    some = rows.filter("e IS NOT NULL").groupBy("sid").agg(F.bool_or(F.col("label").isNotNull()).alias("labelled"))
    alone = rows.join(some, "sid").filter(F.col("label").isNull() & F.col("e").isNotNull() & (F.col("anchor") | ~F.col("labelled")))
    kept = _top(alone, ["sid"], knobs.most_items)
    single = F.concat(F.lit("row "), F.col("pos").cast("string"))
    named = rows.filter("e IS NOT NULL AND label IS NOT NULL").withColumn("grp", F.concat(F.lit("label "), F.col("label")))
    grouped = named.unionByName(kept.select(*rows.columns, single.alias("grp")))
    sums = weighted_sums(grouped, ["sid", "grp"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first", kind="stable")
        means = _stack(group.total) / group.mass.to_numpy()[:, None]
        return group[["sid", "grp"]].assign(cluster=agglomerate(means @ means.T, group.mass.to_numpy(), knobs.group, knobs.most_speakers))

    found = sums.groupBy("sid").applyInPandas(join, "sid string, grp string, cluster long")
    key = F.coalesce(F.concat(F.lit("label "), F.col("label")), single)
    return rows.withColumn("grp", F.when(F.col("e").isNotNull(), key)).join(found, ["sid", "grp"], "left").drop("grp")


def best_centres(rows: DataFrame, centres: DataFrame, keys: list[str], out: str, choose) -> DataFrame:
    """``choose(rows, centres)`` in pandas for each key's rows, a bucket at a time, against all of its centres."""
    buckets = rows.select(*keys, "bucket").distinct()
    dealt = centres.join(buckets, keys)
    dealt = dealt.select(*[F.col(k).alias(f"at_{k}") for k in [*keys, "bucket"]], *[F.col(c).alias(c) for c in centres.columns if c not in keys])
    return rows.groupBy(*keys, "bucket").cogroup(dealt.groupBy(*[f"at_{k}" for k in [*keys, "bucket"]])).applyInPandas(choose, out)


def _split(rows: DataFrame, knobs: Knobs) -> DataFrame:
    """Clusters whose anchors fall into two long parts or more get a cluster for each part but the longest."""
    anchors = _top(rows.filter(F.col("anchor") & F.col("cluster").isNotNull()).select("sid", "cluster", "bucket", "pos", "d", "w", "e"), ["sid", "cluster"], knobs.most_items)
    enough = anchors.groupBy("sid", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("ms")).filter((F.col("n") > 1) & (F.col("ms") >= 2 * knobs.split_least_ms))

    def parts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        e, w, d = _stack(group.e), group.w.to_numpy(), group.d.to_numpy()
        part = agglomerate(e @ e.T, w, knobs.split)
        length = np.bincount(part, d)
        kept = np.flatnonzero(length >= knobs.split_least_ms)
        if len(kept) < 2:
            return pd.DataFrame(columns=["sid", "cluster", "part", "largest", "centre"])
        sums = np.stack([(w[part == k, None] * e[part == k]).sum(0) for k in kept])
        first = group[["sid", "cluster"]].iloc[[0] * len(kept)].reset_index(drop=True)
        return first.assign(part=range(len(kept)), largest=np.arange(len(kept)) == length[kept].argmax(), centre=list(sums / _lengths(sums)))

    found = anchors.join(enough.select("sid", "cluster"), ["sid", "cluster"]).groupBy("sid", "cluster").applyInPandas(parts, "sid string, cluster long, part int, largest boolean, centre array<double>")
    found = settled(found)
    if found.isEmpty():
        return rows
    last = rows.groupBy("sid").agg(F.max("cluster").alias("last"))
    number = F.row_number().over(Window.partitionBy("sid").orderBy("largest", "cluster", "part"))
    fresh = found.join(last, "sid").withColumn("id", F.when(F.col("largest"), F.col("cluster")).otherwise(F.col("last") + number)).select("sid", "cluster", "part", "id", "centre")
    changed = rows.join(found.select("sid", "cluster").distinct(), ["sid", "cluster"]).select("sid", "cluster", "bucket", "pos", "e")

    def nearest(own: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(centres):
            return pd.DataFrame(columns=["sid", "pos", "id"])
        centres = centres.sort_values("part")
        at = (_stack(own.e) @ _stack(centres.centre).T).argmax(1)
        return own[["sid", "pos"]].assign(id=centres.id.to_numpy()[at])

    to = best_centres(changed, fresh, ["sid", "cluster"], "sid string, pos long, id long", nearest)
    return rows.join(to, ["sid", "pos"], "left").withColumn("cluster", F.coalesce("id", "cluster")).drop("id")


def moved(rows: DataFrame, margin: float, alone: float) -> DataFrame:
    """sid, pos, to: rows (sid, bucket, pos, e, w, d, cluster) nearer by ``margin`` to another centre than to the rest of their own cluster.

    A row that is a cluster by itself counts as ``alone`` near to it.
    """
    placed = rows.filter("cluster IS NOT NULL")
    centres = weighted_sums(placed, ["sid", "cluster"]).select("sid", F.col("cluster").alias("name"), "total", "n")

    def run(own: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["sid", "pos", "to"])
        if not len(own) or len(all_) < 2:
            return none
        all_ = all_.sort_values("name")
        names, total, n = all_.name.to_numpy(), _stack(all_.total), all_.n.to_numpy()
        e, w = _stack(own.e), own.w.to_numpy()
        at = np.searchsorted(names, own.cluster.to_numpy())
        rest = total[at] - w[:, None] * e
        lengths = np.linalg.norm(rest, axis=1)
        mine = np.where((n[at] > 1) & (lengths > 1e-12), (rest * e).sum(1) / np.maximum(lengths, 1e-12), alone)
        scores = e @ (total / _lengths(total)).T
        scores[np.arange(len(e)), at] = -np.inf
        best = scores.argmax(1)
        goes = scores[np.arange(len(e)), best] - mine >= margin
        return own[["sid", "pos"]].assign(to=names[best])[goes]

    return best_centres(placed.select("sid", "bucket", "pos", "e", "w", "cluster"), centres, ["sid"], "sid string, pos long, to long", run)


def _absorbed(rows: DataFrame, knobs: Knobs) -> DataFrame:
    """Rows with the clusters that small ones joined."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cluster")
        names, total, length = group.cluster.tolist(), _stack(group.total), group.ms.to_numpy(np.float64)
        of = {c: c for c in names}
        while len(names) > 1:
            centres = total / _lengths(total)
            near = centres @ centres.T
            np.fill_diagonal(near, -np.inf)
            small = [k for k in np.argsort(length, kind="stable") if length[k] < knobs.absorb_below_ms and near[k].max() >= knobs.absorb]
            if not small:
                break
            k, to = int(small[0]), int(near[small[0]].argmax())
            total[to] += total[k]
            length[to] += length[k]
            of = {c: names[to] if x == names[k] else x for c, x in of.items()}
            total, length = np.delete(total, k, 0), np.delete(length, k)
            del names[k]
        return group[["sid", "cluster"]].assign(to=[of[c] for c in group.cluster])

    found = weighted_sums(rows.filter("cluster IS NOT NULL"), ["sid", "cluster"]).groupBy("sid").applyInPandas(run, "sid string, cluster long, to long")
    return rows.join(found, ["sid", "cluster"], "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with loose ones in their nearest cluster."""
    centres = weighted_sums(rows.filter("cluster IS NOT NULL"), ["sid", "cluster"]).select("sid", F.col("cluster").alias("id"), "total")
    loose = rows.filter("cluster IS NULL AND e IS NOT NULL").select("sid", "bucket", "pos", "e")

    def nearest(own: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(all_):
            return pd.DataFrame(columns=["sid", "pos", "to"])
        all_ = all_.sort_values("id")
        total = _stack(all_.total)
        return own[["sid", "pos"]].assign(to=all_.id.to_numpy()[(_stack(own.e) @ (total / _lengths(total)).T).argmax(1)])

    to = best_centres(loose, centres, ["sid"], "sid string, pos long, to long", nearest)
    return rows.join(to, ["sid", "pos"], "left").withColumn("cluster", F.coalesce("cluster", "to")).drop("to")


def _named(rows: DataFrame, knobs: Knobs, voiceprints: DataFrame | None) -> DataFrame:
    """sid, cluster, name, and order: the user's, those carried over by overlap, then fresh numbers by first appearance."""
    placed = rows.filter("cluster IS NOT NULL")
    sums = weighted_sums(placed, ["sid", "cluster"])
    shared = placed.filter("label IS NOT NULL").groupBy("sid", "cluster", "label").agg(F.sum("d").alias("shared"), F.min("pos").alias("seen"))
    shared = shared.groupBy("sid", "cluster").agg(F.collect_list(F.struct("label", "shared", "seen")).alias("labels"))
    number = F.regexp_extract("label", r"^[^:]*:(\d+)$", 1).try_cast("long")
    own = F.substring_index("label", ":", 1) == F.col("prefix")
    last = rows.groupBy("sid").agg(F.coalesce(F.max(F.when(own, number)), F.lit(0)).alias("last"), F.first("prefix").alias("prefix"))
    joined = sums.join(shared, ["sid", "cluster"], "left").join(last, "sid")
    if voiceprints is not None:
        sid = F.concat_ws(SEP, F.coalesce(F.col("meeting_id").cast("string"), F.lit("\x00")), F.coalesce("prefix", F.lit("\x00")))
        joined = joined.join(voiceprints.select(sid.alias("sid"), vectors.unit(F.col("voiceprint")).alias("voice")), "sid", "left")
    else:
        joined = joined.withColumn("voice", F.lit(None).cast("array<double>"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        total = _stack(group.total)
        centres = total / _lengths(total)
        out: list[str | None] = [None] * len(group)
        voice = group.voice.iloc[0]
        if voice is not None and len(voice) == centres.shape[1]:
            s = centres @ np.asarray(voice, np.float64)
            if s.max() >= knobs.user:
                out[int(s.argmax())] = "me"
        told = [(c, r["label"], r["shared"], r["seen"]) for c, rs in enumerate(group.labels) if rs is not None for r in rs]
        seen: dict[str, int] = {}
        for _, label, _, at in told:
            seen[label] = min(at, seen.get(label, at))
        known = [x for x in sorted(seen, key=seen.get) if not (x == "me" and "me" in out)]
        overlap = np.zeros((len(group), max(len(known), 1)))
        for c, label, ms, _ in told:
            if out[c] is None and label in known:
                overlap[c, known.index(label)] += ms
        bonus = 0.5 * (len(known) - np.arange(overlap.shape[1])) / max(len(known), 1) ** 2
        gain = np.where(overlap > 0, overlap + bonus, 0)
        for c, k in enumerate(assign_best(gain)):
            if k is not None and gain[c, k] > 0:
                out[c] = known[k]
        fresh = int(group["last"].iloc[0])
        for c, name in enumerate(out):
            if name is None:
                fresh += 1
                out[c] = f"{group.prefix.iloc[0]}:{fresh}"
        return group[["sid", "cluster"]].assign(name=out, place=range(len(out)))

    return joined.groupBy("sid").applyInPandas(run, "sid string, cluster long, name string, place long")


def regrouped(items: DataFrame, knobs: Knobs = Knobs(), voiceprints: DataFrame | None = None) -> DataFrame:
    """meeting_id, prefix, segment_id, speaker of all rows (columns also pos, embedding, duration_ms, online_label).

    ``voiceprints`` has meeting_id, prefix, voiceprint.
    """
    rows = settled(_split(settled(_grouped(settled(prepared(items, knobs)), knobs)), knobs))
    for _ in range(knobs.move_rounds):
        to = settled(moved(rows, knobs.move, knobs.group))
        if to.isEmpty():
            break
        rows = settled(rows.join(to, ["sid", "pos"], "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to"))
    rows = settled(_placed(settled(_absorbed(rows, knobs))))
    names = settled(_named(rows, knobs, voiceprints))
    votes = rows.filter("cluster IS NOT NULL AND label IS NOT NULL").groupBy("sid", "label", "cluster").agg(F.sum(F.greatest("d", F.lit(1))).alias("ms"))
    followed = votes.join(names, ["sid", "cluster"]).groupBy("sid", "label").agg(F.max(F.struct("ms", (-F.col("place")).alias("p"), "name")).alias("v")).select("sid", "label", F.col("v.name").alias("followed"))
    found = rows.join(names.drop("place"), ["sid", "cluster"], "left").join(followed, ["sid", "label"], "left")
    return found.select("meeting_id", "prefix", "segment_id", F.when(F.col("cluster").isNotNull(), F.col("name")).otherwise(F.coalesce("followed", "label")).alias("speaker"), F.col("label").alias("online_label"))


def relabelled(items: DataFrame, knobs: Knobs = Knobs(), voiceprints: DataFrame | None = None) -> DataFrame:
    """meeting_id, segment_id, speaker of the rows whose label changes."""
    found = regrouped(items, knobs, voiceprints)
    return found.filter(~F.col("speaker").eqNullSafe(F.col("online_label"))).select("meeting_id", "segment_id", "speaker")


def one_stream(rows: DataFrame) -> DataFrame:
    """Rows for ``moved`` of a table of vectors (pos, e, w, d, cluster) as one stream, in buckets of bounded size."""
    buckets = max(1, -(-rows.count() // BUCKET))
    return rows.withColumns({"sid": F.lit("all"), "bucket": F.pmod(F.xxhash64("pos"), F.lit(buckets)).cast("int")})


MOST_CENTRES = 4096  # held by every task; more are dealt


def nearest_centres(rows: DataFrame, id_col: str, vector: str, centres: DataFrame) -> DataFrame:
    """id, nearest, similarity: of ``centres`` (label, a number; u, at length one) the nearest by cosine to nine places, ties to the smaller label.

    Up to ``MOST_CENTRES`` centres are one array that every task has; more of them meet the rows in blocks.
    Vectors that are null or have no length are near to nothing (similarity null); ids must differ.
    """
    named = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    if centres.limit(MOST_CENTRES + 1).count() <= MOST_CENTRES:
        norm = vectors.norm(F.col("v"))
        held = named.withColumns({"norm": F.nullif(norm, F.lit(0.0)), "centres": centres.agg(F.collect_list(F.struct("label", "u"))).scalar()})
        near = F.array_max(F.transform("centres", lambda c: F.struct(F.round(vectors.dot(F.col("v"), c["u"]) / F.col("norm"), 9).alias("s"), (-c["label"]).alias("n"))))
        return held.select("id", near.alias("b")).select(F.col("id").alias(id_col), (-F.col("b.n")).alias("nearest"), F.col("b.s").alias("similarity"))
    blocks, buckets = -(-centres.count() // MOST_CENTRES), max(1, -(-rows.count() // BUCKET))
    kind, label = dict(named.dtypes)["id"], dict(centres.dtypes)["label"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = named.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).withColumn("block", every(blocks))
    right = centres.select("label", "u").withColumn("at_block", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")).withColumn("at_bucket", every(buckets))

    def best(own: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        own = own[[v is not None for v in own.v]]
        if not len(own) or not len(those):
            return pd.DataFrame(columns=["id", "s", "n"])
        those = those.sort_values("label")
        v = _stack(own.v)
        lengths = np.linalg.norm(v, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.round(v @ _stack(those.u).T / lengths[:, None], 9)
        at = scores.argmax(1)
        found = pd.DataFrame({"id": own.id.to_numpy(), "s": scores[np.arange(len(at)), at], "n": those.label.to_numpy()[at]})
        return found[lengths > 0]

    tiles = left.groupBy("bucket", "block").cogroup(right.groupBy("at_bucket", "at_block")).applyInPandas(best, f"id {kind}, s double, n {label}")
    top = tiles.groupBy("id").agg(F.max(F.struct("s", (-F.col("n")).alias("n"))).alias("b"))
    return named.select("id").join(top, "id", "left").select(F.col("id").alias(id_col), (-F.col("b.n")).alias("nearest"), F.col("b.s").alias("similarity"))
