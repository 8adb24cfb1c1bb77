"""Forests and chains: parent pointers, cycles, subtree roll-ups, linked lists.

All walks use pointer doubling: ``log2(depth)`` joins instead of one join per level.  Only rows that
have not reached their root take part in the next join, and each round is checkpointed.  A hot join key
(a parent shared by very many nodes) is on the side AQE can split, because the other side is unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.session import cut_lineage


def valid_parents(nodes: DataFrame, id: str = "id", parent: str = "parent", by: Sequence[str] = ()) -> DataFrame:
    """Null the parent links that are dangling or point at the node itself."""
    keys = list(by)
    known = nodes.select(*keys, F.col(id).alias("__pid")).distinct()
    left = nodes.withColumn("__pid", F.when(F.col(parent) != F.col(id), F.col(parent)))
    joined = left.join(known.withColumn("__known", F.lit(True)), [*keys, "__pid"], "left")
    return joined.withColumn(parent, F.when(F.col("__known"), F.col("__pid"))).select(*nodes.columns)


def cycle_breakers(nodes: DataFrame, id: str = "id", parent: str = "parent", by: Sequence[str] = ()) -> DataFrame:
    """One node per cycle, its smallest id (``by``, ``id``).  Parents must be valid.

    After enough doublings every pointer that has not run off a root lies on a cycle, and the smallest
    id met on the way from a cycle node is the smallest of its cycle.
    """
    keys = list(by)
    cur = nodes.where(F.col(parent).isNotNull()).select(
        *keys, F.col(id).alias("id"), F.col(parent).alias("anc"), F.col(id).alias("low")
    )
    cur = cut_lineage(cur)
    left, reach = cur.count(), 1
    while left and reach < left:
        before = left
        nxt = cur.select(*keys, F.col("id").alias("anc"), F.col("anc").alias("__anc"), F.col("low").alias("__low"))
        cur = cut_lineage(
            cur.join(nxt, [*keys, "anc"]).select(
                *keys, "id", F.col("__anc").alias("anc"), F.least("low", "__low").alias("low"), (F.col("__low") < F.col("low")).alias("lower")
            )
        )
        state = cur.agg(F.count(F.lit(1)).alias("n"), F.count_if("lower").alias("lower")).first()
        cur = cur.drop("lower")
        left, reach = state["n"], reach * 2
        # no pointer ran off a root and no minimum fell while the reach doubled: neither will
        if left == before and not state["lower"]:
            break
    on_cycle = cur.select(*keys, F.col("anc").alias("id")).distinct()
    return cur.join(on_cycle, [*keys, "id"], "left_semi").where(F.col("id") == F.col("low")).select(*keys, "id")


def cut_cycles(
    nodes: DataFrame,
    id: str = "id",
    parent: str = "parent",
    by: Sequence[str] = (),
    mode: str = "detach",
    main: str = "main",
) -> DataFrame:
    """Break every cycle at its smallest id: ``detach`` it, or hang it under ``main``.

    Dangling and self links are nulled first.  The rule is deterministic; the order rows arrive in
    plays no part.
    """
    keys = list(by)
    fixed = valid_parents(nodes, id, parent, by)
    breakers = cycle_breakers(fixed, id, parent, by).withColumnRenamed("id", id)
    flagged = fixed.join(breakers.withColumn("__break", F.lit(True)), [*keys, id], "left")
    new = F.lit(None).cast(nodes.schema[parent].dataType) if mode == "detach" else F.lit(main)
    return flagged.withColumn(parent, F.when(F.col("__break"), new).otherwise(F.col(parent))).select(*nodes.columns)


def resolve_tree(
    nodes: DataFrame,
    id: str = "id",
    parent: str = "parent",
    by: Sequence[str] = (),
    order: Sequence[Column] = (),
    max_depth: int = 64,
) -> DataFrame:
    """Add ``root``, ``depth`` and ``path`` (root first, the node last) to a forest.

    Unknown parents make a root.  ``order`` columns yield ``order_path``, an array of structs whose sort
    order is the pre-order of the tree with siblings in that order.  Nodes that ``max_depth`` levels do
    not explain are checked for cycles, which are cut at their smallest id.
    """
    keys = list(by)
    fixed = valid_parents(nodes, id, parent, by)
    step = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(id).alias("id"))
    base = fixed.select(
        *keys, F.col(id).alias("id"), F.col(parent).alias("anc"), F.array(F.col(id)).alias("up"), F.array(step).alias("steps")
    )
    cur, open_ = _climb(cut_lineage(base), keys, max_depth)
    if open_:
        stuck = cur.where(F.col("anc").isNotNull()).select(*keys, "id")
        rows = base.join(stuck, [*keys, "id"], "left_semi")
        loose = cut_lineage(cut_cycles(rows.select(*keys, "id", "anc"), "id", "anc", by))
        again = rows.drop("anc").join(loose, [*keys, "id"]).select(*cur.columns)
        # a stuck node only hangs under stuck nodes or, beyond the depth limit, under finished ones
        done = cur.where(F.col("anc").isNull())
        tails = base.join(stuck, [*keys, "id"], "left_semi").select(*keys, "id", F.col("anc").alias("__old"))
        back = again.join(tails, [*keys, "id"]).join(
            done.select(*keys, F.col("id").alias("__old"), F.lit(True).alias("__done")), [*keys, "__old"], "left"
        )
        again = back.withColumn("anc", F.when(F.col("__done"), F.col("__old")).otherwise(F.col("anc"))).select(*cur.columns)
        cur, _ = _climb(cut_lineage(done.unionByName(again)), keys, None)
    out = cur.select(
        *keys,
        F.col("id").alias(id),
        F.element_at("up", -1).alias("root"),
        (F.size("up") - 1).alias("depth"),
        F.reverse("up").alias("path"),
        *([F.reverse("steps").alias("order_path")] if order else []),
    )
    return nodes.drop(parent).join(out.withColumn(parent, F.try_element_at("path", F.lit(-2))), [*keys, id])


def _climb(cur: DataFrame, keys: list[str], max_depth: int | None) -> tuple[DataFrame, int]:
    reach = 1
    open_ = cur.where(F.col("anc").isNotNull()).count()
    while open_ and (max_depth is None or reach < 2 * max_depth):
        target = cur.select(
            *keys, F.col("id").alias("anc"), F.col("anc").alias("__anc"), F.col("up").alias("__up"), F.col("steps").alias("__st")
        )
        moved = (
            cur.where(F.col("anc").isNotNull())
            .join(target, [*keys, "anc"])
            .select(
                *keys,
                "id",
                F.col("__anc").alias("anc"),
                F.concat("up", "__up").alias("up"),
                F.concat("steps", "__st").alias("steps"),
            )
        )
        cur = cut_lineage(cur.where(F.col("anc").isNull()).unionByName(moved))
        open_, reach = cur.where(F.col("anc").isNotNull()).count(), reach * 2
    return cur, open_


def subtree_rollup(tree: DataFrame, aggs: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over every node and its descendants, one row per ``ancestor``."""
    return tree.withColumn("ancestor", F.explode("path")).groupBy(*by, "ancestor").agg(*aggs)


def keep_ancestors(tree: DataFrame, predicate: Column, id: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The matching nodes and all their ancestors."""
    keep = tree.where(predicate).select(*by, F.explode("path").alias(id)).distinct()
    return tree.join(keep, [*by, id], "left_semi")


def collapse_finished(
    tree: DataFrame, finished: Column, id: str = "id", by: Sequence[str] = (), main: Column | None = None
) -> DataFrame:
    """Hide finished nodes below which everything is finished; the main node always stays."""
    open_paths = tree.where(~finished).select(*by, F.explode("path").alias(id)).distinct()
    root = F.col("depth") == 0 if main is None else main
    kept = tree.join(open_paths.withColumn("__open", F.lit(True)), [*by, id], "left")
    shown = kept.where(root | F.col("__open").isNotNull()).select(*by, F.explode("path").alias(id)).distinct()
    return tree.join(shown, [*by, id], "left_semi")


def accept_links(links: DataFrame, child: str = "child", target: str = "target", order: str = "order") -> DataFrame:
    """The links that are taken when they come in the order of the unique ``order``: each child takes the first that closes no cycle.

    child is a root that may be hung below another root (target).  Every child first picks its earliest link, which makes a
    functional graph.  The latest link of each of its cycles is one that comes when all others of the cycle are there, so it is
    refused and its child picks its next one; without cycles all picks stand.  Cycles are found by pointer doubling, in which
    children whose way ends at a root drop out.
    """
    left = cut_lineage(links.select(child, target, order))
    while True:
        picked = cut_lineage(left.groupBy(child).agg(F.min_by(F.struct(target, order), order).alias("l")).select(child, f"l.{target}", f"l.{order}"))
        walk = picked.select(F.col(child).alias("c"), F.col(target).alias("at"), F.col(order).alias("most"))
        open_, reach = walk.count(), 1
        while open_ and reach < open_:
            ahead = walk.select(F.col("c").alias("k"), F.col("at").alias("next"), F.col("most").alias("later"))
            walk = cut_lineage(walk.join(ahead, F.col("at") == F.col("k")).select("c", F.col("next").alias("at"), F.greatest("most", "later").alias("most")))
            open_, reach = walk.count(), reach * 2
        if open_ == 1:  # one left: does it point at itself?
            open_ = walk.where(F.col("c") == F.col("at")).count()
        if not open_:
            return picked
        on_cycle = walk.select(F.col("at").alias("c")).distinct().join(walk, "c").select(F.col("most").alias(order)).distinct()
        left = cut_lineage(left.join(on_cycle, order, "left_anti").select(child, target, order))


def pick_collapsed(
    tree: DataFrame, finished: Column, room: int, end: str = "ended_at", id: str = "id", by: Sequence[str] = (), main: Column | None = None
) -> DataFrame:
    """Like :func:`collapse_finished`, with room for ``room`` more rows per tree, and the column ``hidden`` (rows that found none).

    All collapsed nodes show if they fit.  Otherwise one row is left for the note that more are hidden, and the others go to
    those that ended last (then by id); what shows keeps its ancestors.  The rank limit comes before any other sort.
    """
    shown = collapse_finished(tree, finished, id, by, main).select(*by, id)
    hidden = tree.join(shown, [*by, id], "left_anti")
    sizes = hidden.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")) if by else hidden.agg(F.count(F.lit(1)).alias("__n"))
    newest = Window.partitionBy(*by).orderBy(F.col(end).desc_nulls_last(), F.col(id))
    near = hidden.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= max(room, 0))
    near = near.join(sizes, list(by)) if by else near.crossJoin(sizes)
    picked = near.where((F.col("__n") <= room) | (F.lit(room > 1) & (F.col("__r") < room)))
    left = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("__p"))
    keep = shown.unionByName(picked.select(*by, F.explode("path").alias(id))).distinct()
    out = tree.join(keep, [*by, id], "left_semi")
    if by:
        out = out.join(sizes, list(by), "left").join(left, list(by), "left")
    else:
        out = out.crossJoin(sizes).crossJoin(left)
    return out.withColumn("hidden", F.coalesce("__n", F.lit(0)) - F.coalesce("__p", F.lit(0))).drop("__n", "__p")


def add_missing_ancestors(
    selected: DataFrame, all_rows: DataFrame, id: str = "id", parent: str = "parent", passes: int | None = None
) -> DataFrame:
    """The selected rows plus all ancestors they lack (at most ``passes`` levels up, if given).

    Each round goes one level up and stops where a row is known already, so cycles end too.
    """
    ids = cut_lineage(selected.select(id).distinct())
    edges = all_rows.select(F.col(id).alias("__c"), F.col(parent).alias("__p")).where(F.col(parent).isNotNull())
    frontier = ids
    for _ in range(passes) if passes is not None else count():
        up = frontier.join(edges, frontier[id] == F.col("__c")).select(F.col("__p").alias(id)).distinct()
        frontier = cut_lineage(up.join(ids, id, "left_anti").join(all_rows.select(id).distinct(), id, "left_semi"))
        if frontier.isEmpty():
            break
        ids = cut_lineage(ids.unionByName(frontier))
    return all_rows.join(ids, id, "left_semi")


def walk_chain(
    entries: DataFrame,
    heads: DataFrame,
    id: str = "id",
    prev: str = "previous_id",
    head: str = "head",
    by: Sequence[str] = (),
    max_hops: int | None = None,
) -> DataFrame:
    """The entries reached from each head through ``prev``: (``by``, ``head``, ``id``, ``hops``), head at 0.

    List ranking by doubling: after round k all entries within 2**k hops are known and the jump table
    spans 2**k hops.  A cycle is cut behind its smallest id first, so a chain that runs into one ends there.
    """
    keys = list(by)
    entries = entries.select(*keys, id, F.when(F.col(prev) != F.col(id), F.col(prev)).alias(prev))
    breakers = cycle_breakers(valid_parents(entries, id, prev, keys), id, prev, keys)
    cut = breakers.withColumnRenamed("id", id).withColumn("__cut", F.lit(True)) if id != "id" else breakers.withColumn("__cut", F.lit(True))
    entries = entries.join(cut, [*keys, id], "left")
    entries = entries.withColumn(prev, F.when(F.col("__cut").isNull(), F.col(prev))).drop("__cut")
    one = entries.select(*keys, F.col(id).alias("__at"), F.col(prev).alias("__to"))
    known_ids = entries.select(*keys, F.col(id).alias("__to")).distinct()
    jump = cut_lineage(one.join(known_ids, [*keys, "__to"], "left_semi").select(*keys, "__at", "__to"))
    start = heads.select(*keys, F.col(head)).distinct()
    exist = entries.select(*keys, F.col(id).alias(head)).distinct()
    found = cut_lineage(
        start.join(exist, [*keys, head], "left_semi").select(
            *keys, head, F.col(head).alias("__at"), F.lit(0).cast("bigint").alias("hops")
        )
    )
    reach = 1
    while max_hops is None or reach <= max_hops:
        more = found.join(jump, [*keys, "__at"]).select(
            *keys, head, F.col("__to").alias("__at"), (F.col("hops") + reach).alias("hops")
        )
        more = cut_lineage(more if max_hops is None else more.where(F.col("hops") <= max_hops))
        if more.isEmpty():
            break
        found = cut_lineage(found.unionByName(more))
        reach *= 2
        if max_hops is None or reach <= max_hops:
            nxt = jump.select(*keys, F.col("__at").alias("__to"), F.col("__to").alias("__far"))
            jump = cut_lineage(jump.join(nxt, [*keys, "__to"]).select(*keys, "__at", F.col("__far").alias("__to")))
    return found.select(*keys, head, F.col("__at").alias(id), "hops")
