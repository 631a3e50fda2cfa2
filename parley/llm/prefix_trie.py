"""The trie of conversation prefixes with subtree totals, by leaf-peeling message passing.

A node is a distinct sequence of first turns; its name is (smallest conversation in it, depth). The
sequence is known by two 64-bit rolling hashes over the turns' hashes; a node whose members differ in
their last turn or their parent raises an error, so by induction no node joins two sequences unseen.

Totals of subtrees come from leaves to the root: a node holds a counter of the children that have not
reported; a node whose counter is zero is complete and sends its totals to its parent. So that long
conversations need few rounds, a node and its child with most members are one stretch: what passes
messages are stretches, each complete once all children off it have reported. A child off a stretch
has at most half of its parent's members, so rounds grow with the logarithm of the conversations, not
with the depth. Within a stretch, totals run from its end to its start.

No group is held by one task: members of a node are aggregated before they are shuffled; values that
run along a conversation or a stretch carry over partitions (``common.runs_within``); nodes with more
than their share of the rows, of which there are few, reach them by broadcast; ids of conversations
that end at a node are digested block by block.

Cases: turns without a conversation take no part; null roles and texts count as empty; turns are
ordered by number, null first, ties by a hash of role and text; repeated turns stay repeated; a
conversation without turns is a member of the root; an empty table gives no nodes; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import meet, runs_within, scaled_partitions, small_batches, stored, tidy

KEY = ["depth", "x", "y"]
STRETCH = ["top_depth", "top_x", "top_y"]


def memberships(turns: DataFrame, conversations: DataFrame | None, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row per conversation and depth, 0 included: its node's key, its parent's (px, py), the last turn's hashes and bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.lit(1).alias("kind"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    named = rows.select("conv")
    if conversations is not None:
        named = named.unionByName(conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv")))
    zero = F.lit(0).cast("long")
    starts = named.distinct().select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"))
    walked = runs_within(starts.unionByName(rows), ["conv"], ["kind", F.col("turn").asc_nulls_first(), "a", "b"], {"x": ("poly", "a"), "y": ("poly", "b")}, {"px": "x", "py": "y"})
    return walked.select("conv", (F.col("count_") - 1).alias("depth"), "x", "y", "px", "py", "a", "b", "bytes")


def nodes_of(members: DataFrame) -> DataFrame:
    """A row per node: its key, parent's key, smallest member, members, children; ``light`` unless it is its parent's largest child."""
    same = F.struct("px", "py", "a", "b", "bytes")
    grouped = members.groupBy(*KEY).agg(F.min("conv").alias("node_conv"), F.count(F.lit(1)).alias("n_convs"), F.min(same).alias("low"), F.max(same).alias("high"))
    checked = grouped.withColumn("low", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("two sequences of turns have the same hashes"))))
    nodes = stored(checked.select(*KEY, "node_conv", "n_convs", F.col("low.px").alias("px"), F.col("low.py").alias("py"), ((F.col("n_convs") - 1) * F.col("low.bytes")).alias("saved")), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", F.col("x").alias("cx"), F.col("y").alias("cy"))).alias("largest")
    )
    children = stored(children, "trie-children")
    heavy = children.select((F.col("depth") + 1).alias("depth"), F.col("largest.cx").alias("x"), F.col("largest.cy").alias("y"), F.lit(False).alias("light"))
    joined = nodes.join(children.drop("largest"), KEY, "left").join(heavy, KEY, "left")
    return stored(joined.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "light": F.coalesce("light", F.lit(True))}), "trie-joined")


def along_stretches(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Memberships with their node's values, the top of its stretch, and above it the parent's name and stretch (``p`` before)."""
    light = {f"light_{c}": F.when(F.col("light"), F.col(c)) for c in KEY}
    rows = meet(members.select("conv", *KEY), nodes.drop("px", "py"), KEY, "n_convs").withColumns(light)
    tops = {f"top_{c}": ("last", f"light_{c}") for c in KEY}
    walked = runs_within(rows, ["conv"], ["depth"], {**tops, "own": ("last", "node_conv")}, {**{f"ptop_{c}": f"top_{c}" for c in KEY}, "parent_conv": "own"})
    return walked.drop(*light, "own", "count_")


def peeled(paths: DataFrame) -> DataFrame:
    """Totals of whole stretches: those without open children report, round by round, until the root's has.

    ``paths``: ``STRETCH``, the parent's (p...), leaves and saved of their own nodes.
    """
    parent = [f"p{c}" for c in STRETCH]
    counters = paths.filter(F.col(parent[0]).isNotNull()).groupBy(*[F.col(p).alias(c) for p, c in zip(parent, STRETCH)]).agg(F.count(F.lit(1)).alias("remaining"))
    state = stored(paths.join(counters, STRETCH, "left").withColumn("remaining", F.coalesce("remaining", F.lit(0).cast("long"))), "trie-open")
    complete: DataFrame | None = None
    while True:
        done = state.filter("remaining = 0").drop("remaining")
        complete = done if complete is None else complete.unionByName(done)
        left = state.filter("remaining > 0")
        if left.isEmpty():
            return complete
        messages = done.groupBy(*[F.col(p).alias(c) for p, c in zip(parent, STRETCH)]).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        told = left.join(messages, STRETCH, "left").na.fill(0, ["n", "l", "s"])
        state = stored(told.withColumns({"remaining": F.col("remaining") - F.col("n"), "leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")}).drop("n", "l", "s"), "trie-open")


def digests_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """SHA-256 (lower-case hex) of each key's values (longs) in ascending order, as decimals joined by commas.

    Keys and values are longs. Sorted values become blocks of text, at most one batch long, and one
    task reads a key's blocks one by one.
    """
    spark = rows.sparkSession
    small_batches(spark)
    parts = scaled_partitions(spark)
    named = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v"))
    width = len(keys)
    ks = [f"k{i}" for i in range(width)]
    fields = ", ".join(f"{k} long" for k in ks)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c) for c in batch.columns]
            edge = np.zeros(batch.num_rows - 1, bool)
            for c in columns[:width]:
                edge |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
            first = np.array(cuts[:-1])
            values = columns[width].tolist()
            texts = [",".join(map(str, values[a:b])) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in columns), pa.array(texts)], names=[*ks, "v", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            *columns, texts = (c.to_pylist() for c in batch.columns)
            for *now, _, text in zip(*columns, texts):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append([*key, state.hexdigest()])
                    key, state = now, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == width else pa.int64()) for i in range(width + 1)], names=[*ks, "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([state.hexdigest()])], names=[*ks, "digest"])

    blocks = named.repartitionByRange(parts, *ks, "v").sortWithinPartitions(*ks, "v").mapInArrow(tidy(block), f"{fields}, v long, text string")
    found = blocks.repartition(parts, *ks).sortWithinPartitions(*ks, "v").mapInArrow(tidy(digest), f"{fields}, digest string")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "digest")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` (``conv_col``) names conversations that may have no turns.
    """
    members = stored(memberships(turns, conversations, conv_col, turn_col, role_col, text_col), "trie-members")
    nodes = nodes_of(members)
    walked = stored(along_stretches(members, nodes), "trie-walked")
    own = walked.filter("conv = node_conv").withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    at_top = F.col("light") & (F.col("depth") > 0)
    above = F.max(F.when(at_top, F.struct("parent_conv", (F.col("depth") - 1).alias("parent_depth"), *[f"p{c}" for c in STRETCH])))
    paths = own.groupBy(*STRETCH).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), above.alias("above"))
    totals = peeled(paths.select(*STRETCH, "leaves", "saved", "above.*"))
    reported = totals.filter(F.col("parent_conv").isNotNull()).groupBy(F.col("parent_conv").alias("node_conv"), F.col("parent_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    loaded = own.select("node_conv", "depth", "parent_conv", "n_convs", "n_children", *STRETCH, "leaf", "saved").join(reported, ["node_conv", "depth"], "left").na.fill(0, ["l", "s"])
    loaded = loaded.withColumns({"l": F.col("l") + F.col("leaf"), "s": F.col("s") + F.col("saved")})
    summed = runs_within(loaded, STRETCH, [F.col("depth").desc()], {"n_leaves": ("sum", "l"), "saved_tokens": ("sum", "s")})
    last = walked.groupBy("conv").agg(F.max(F.struct("depth", "node_conv")).alias("end")).select(F.col("end.node_conv").alias("node_conv"), F.col("end.depth").alias("depth"), "conv")
    ends = digests_of(last, ["node_conv", "depth"], "conv")
    return summed.join(ends, ["node_conv", "depth"], "left").select(
        F.col("node_conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations that begin with turns of the one whose id is theirs less its remainder by five (see ``op12_trie``).

    Turns are numbered anew, with gaps; ties of turn go by role and text.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("one")
    )
    placed = runs_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"], {"place": ("sum", "one")}).select("conv_id", "place", "role", "text")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = placed.filter(F.col("place") > taken).withColumn("place", F.col("place") + 8)
    lent = placed.filter("place <= 8").withColumnRenamed("conv_id", "lender")
    ids = placed.select("conv_id").distinct().withColumns({"lender": F.col("conv_id") - F.col("conv_id") % 5, "taken": taken})
    borrowed = ids.join(lent, "lender").filter("place <= taken")
    return own.unionByName(borrowed.select(*own.columns))
