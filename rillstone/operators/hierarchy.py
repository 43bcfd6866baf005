"""Parent-child links as full hierarchies: root, depth, path, descendants, cycles.

Method: find the connected components, put each component in one task, walk it
depth first without recursion with node colouring (white, grey, black).

Components of links with one parent per node are found by pointer jumping: after
round k every node points 2**k steps up, so a history of depth d takes log2(d)
rounds, each one join. The same jumps carry the number of steps, and with
``path`` the ids passed; that is how a component of more than ``max_component``
nodes gets its result: exactly, and without being put into one task.

Defined results
    * null node: the link is ignored. Null parent: no parent. A node that occurs
      only as a parent is a root. Repeated links count once; of several parents
      of a node the smallest is used (choose beforehand with ``main_parents``).
    * circular histories: depth -1, root is the smallest id on the circle,
      path is null, and ``on_cycle`` tells circle from what hangs on it.
      ``whole_paths`` and ``whole_closure`` have these nodes too.
    * a node that is its own parent is a circle of one.
    * empty tables: no rows, same schema. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.skew import hot_keys, lookup, salted
from rillstone.scratch import Cut, cut

#: Nodes of a component that one task may walk; some 200 bytes each.
MAX_COMPONENT = 1_000_000
#: Nodes a task takes on, components kept whole.
NODES_PER_TASK = 100_000
#: Ids of paths in a batch; one path may go beyond it.
PATH_IDS = 4_000_000


def main_parents(links: DataFrame, levels: DataFrame) -> DataFrame:
    """``node, parent``: of each ``revision_id`` the non-null parent with the highest level.

    An unknown level is lowest; among equals the smallest id. ``levels`` is
    ``id, level`` with one row an id. Null revision_ids are ignored.
    """
    links = links.where(F.col("revision_id").isNotNull()).select("revision_id", "parent_id")
    known = lookup(links, levels.withColumnRenamed("id", "parent_id"), "parent_id", ["revision_id"])
    rank = F.when(F.col("parent_id").isNotNull(), F.struct(F.col("level").isNotNull().alias("known"), F.coalesce("level", F.lit(0)).alias("level"), (-F.col("parent_id")).alias("minus")))
    return known.groupBy(F.col("revision_id").alias("node")).agg((-F.max(rank)["minus"]).alias("parent"))


#: Rows of a round from which hot pointers are looked for; fewer fit one task even if all meet in it.
SKEW_FROM = 1_000_000


def jump(edges: DataFrame, path: bool = False) -> tuple[Cut, int]:
    """Pointer jumping over ``node, parent`` (one non-null parent a node).

    Gives ``node, ptr, steps, done`` (and ``path``, the ids from ``ptr`` down to
    the parent) and the number of nodes never done: those whose way ends in a circle.
    A round in which no node gets done is the last: if one were deeper, its
    ancestors would have got done in this round.
    """
    start = [F.array("parent").alias("path")] if path else []
    now = cut(edges.select("node", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("steps"), F.lit(False).alias("done"), *start), "jump")
    total = now.df.count()
    finished = 0
    while True:
        active = now.df.where(~F.col("done"))
        hot = hot_keys(active, "ptr") if total - finished >= SKEW_FROM else []
        above = now.df.select(F.col("node").alias("ptr"), F.struct("ptr", "steps", "done", *(["path"] if path else [])).alias("up"))
        # With paths a row has no bound on its size, so hot ones are dealt out by salt instead of broadcast.
        moved = salted(active, above, "ptr", ["node"], hot) if path else lookup(active, above, "ptr", ["node"], hot)
        up = F.col("up")
        more = [F.concat(F.coalesce(up["path"], F.expr("cast(array() as array<bigint>)")), F.col("path")).alias("path")] if path else []
        moved = moved.select("node", F.coalesce(up["ptr"], "ptr").alias("ptr"), (F.col("steps") + F.coalesce(up["steps"], F.lit(0))).alias("steps"), F.coalesce(up["done"], F.lit(True)).alias("done"), *more)
        after = cut(now.df.where("done").unionByName(moved), "jump")
        now.drop()
        now = after
        then, finished = finished, now.df.where("done").count()
        if finished in (then, total):
            return now, total - finished


def _walk(node: np.ndarray, parent: np.ndarray, has: np.ndarray, want: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Depth-first walk of whole components: rows of the nodes given, parents that aren't nodes being roots.

    Paths come in batches of some PATH_IDS ids, however many there are in all.
    """
    ids = np.unique(np.concatenate([node, parent[has]]))
    n = len(ids)
    up = np.full(n, -1, np.int64)
    here = np.searchsorted(ids, node)
    up[here[has]] = np.searchsorted(ids, parent[has])
    order = np.argsort(up, kind="stable")
    first = np.searchsorted(up[order], np.arange(n + 1))
    starts, kids, ups = first.tolist(), order.tolist(), up.tolist()
    WHITE, GREY, BLACK = 0, 1, 2
    colour, depth, root, on_cycle = [WHITE] * n, [-1] * n, [-1] * n, [False] * n
    size, walked = [0] * n, []

    def descend(top: int, level: int, of: int) -> None:
        """Colours all below ``top`` black; a grey child is a back edge and is left to its circle."""
        stack = [top]
        colour[top] = GREY
        while stack:
            v = stack.pop()
            walked.append(v)
            depth[v] = level if v == top or level < 0 else depth[ups[v]] + 1
            root[v] = of
            for w in kids[starts[v] : starts[v + 1]]:
                if colour[w] == WHITE:
                    colour[w] = GREY
                    stack.append(w)
            colour[v] = BLACK

    for r in np.flatnonzero(up < 0).tolist():
        descend(r, 0, r)
    for v in range(n):
        if colour[v] != WHITE:
            continue
        trail, w = [], v
        while colour[w] == WHITE:  # up until a back edge closes the circle
            colour[w] = GREY
            trail.append(w)
            w = ups[w]
        circle = trail[trail.index(w) :]
        for w in trail:
            colour[w] = WHITE
        low = min(circle)  # ids are sorted: the least index is the least id
        for w in circle:
            on_cycle[w], colour[w] = True, GREY
        for w in circle:
            descend(w, -1, low)
    d, of, ring, order = (np.asarray(x, t) for x, t in ((depth, np.int64), (root, np.int64), (on_cycle, bool), (walked, np.int64)))
    is_node = np.zeros(n, bool)
    is_node[here] = True
    if "descendants" in want:
        for v in reversed(walked):
            p = ups[v]
            if p >= 0 and depth[v] >= 0:
                size[p] += size[v] + 1
    sizes = np.asarray(size, np.int64)
    shown = is_node[order]
    lens = np.where(shown & (d[order] >= 0), d[order] + 1, 0) if "path" in want else np.zeros(n, np.int64)
    block = np.cumsum(lens) // PATH_IDS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    way = np.empty(int(d.max(initial=0)) + 1, np.int64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = order[a:b][shown[a:b]]
        out = {"node": pa.array(ids[own]), "root": pa.array(ids[of[own]]), "depth": pa.array(d[own]), "on_cycle": pa.array(ring[own])}
        if "descendants" in want:
            out["descendants"] = pa.array(np.where(d[own] < 0, -1, sizes[own]), mask=d[own] < 0)
        if "path" in want:
            # In the order of the walk the way down to a node is that of the node before, cut to the parent's depth, and itself.
            flat, at = np.empty(int(lens[a:b].sum()), np.int64), 0
            for v, k, name in zip(order[a:b].tolist(), lens[a:b].tolist(), ids[order[a:b]].tolist(), strict=True):
                if depth[v] >= 0:
                    way[depth[v]] = name
                    flat[at : at + k] = way[:k]
                    at += k
            ends = np.concatenate([[0], np.cumsum(lens[a:b][shown[a:b]])]).astype(np.int32)
            out["path"] = pa.ListArray.from_arrays(pa.array(ends, mask=np.concatenate([d[own] < 0, [False]])), pa.array(flat))
        if len(own):
            yield pa.RecordBatch.from_pydict(out)


def _walker(want: frozenset[str], at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(upto: pa.Table) -> Iterator[pa.RecordBatch]:
            p = upto["parent"].combine_chunks()
            return _walk(upto["node"].to_numpy(), p.fill_null(0).to_numpy(), p.is_valid().to_numpy(zero_copy_only=False), want)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= at_once:  # rows come sorted by component: all but the last component are whole
                t = pa.Table.from_batches(held)
                comp = t["comp"].to_numpy()
                k = int(np.searchsorted(comp, comp[-1]))
                if k:
                    yield from flush(t.slice(0, k))
                    held, rows = t.slice(k).to_batches(), t.num_rows - k
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def hierarchies(edges: DataFrame, want: tuple[str, ...] = (), max_component: int = MAX_COMPONENT) -> DataFrame:
    """Of each node of ``edges`` (``node, parent``): ``node, root, depth, on_cycle``.

    ``want`` adds ``path`` (ids from the root to the node) and ``descendants``
    (their number; ``closure`` gives them as rows). Defined results: see the module.
    """
    spark = edges.sparkSession
    wanted = frozenset(want)
    one = cut(edges.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent")), "forest")
    linked = one.df.where(F.col("parent").isNotNull())
    jumps, endless = jump(linked)
    total = one.df.count()
    # Every node under a root is in the root's component. Ways into circles share one while they are few; else their circle is found by jumping on.
    comp = F.when(F.col("done"), F.col("ptr"))
    if endless > min(max_component, NODES_PER_TASK):
        rest = _circles(linked.join(jumps.df.where(~F.col("done")).select("node"), "node", "left_semi"), endless)
        with_comp = jumps.df.where("done").select("node", "ptr", "steps", "done", F.col("ptr").alias("comp")).unionByName(rest)
    else:
        with_comp = jumps.df.select("node", "ptr", "steps", "done", F.coalesce(comp, F.lit(-1)).alias("comp"))
    base = one.df.join(with_comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    giant = None
    if total > max_component:
        sizes = base.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_component).select("comp", F.lit(True).alias("giant"))
        base = lookup(base, sizes, "comp", ["node"])
        giant, base = base.where(F.col("giant")), base.where(F.col("giant").isNull())
    schema = "node bigint, root bigint, depth bigint, on_cycle boolean" + ", descendants bigint" * ("descendants" in wanted) + ", path array<bigint>" * ("path" in wanted)
    tasks = max(math.ceil(total / NODES_PER_TASK), min(spark.sparkContext.defaultParallelism, math.ceil(total / 2000)), 1)
    near = base.select("node", "parent", "comp").repartition(tasks, "comp").sortWithinPartitions("comp")
    out = near.mapInArrow(_walker(wanted, 4 * NODES_PER_TASK), schema)
    if giant is not None:
        out = out.unionByName(_far(giant, linked, wanted))
    return out


def _circles(linked: DataFrame, count: int) -> DataFrame:
    """Nodes whose way never ends, with the least id of their circle as component."""
    now = cut(linked.select("node", F.col("parent").alias("ptr"), F.col("parent").alias("low")), "circle")
    for _ in range(math.ceil(math.log2(max(count, 2))) + 1):
        above = now.df.select(F.col("node").alias("ptr"), F.struct("ptr", "low").alias("up"))
        moved = lookup(now.df, above, "ptr", ["node"])
        after = cut(moved.select("node", F.col("up.ptr").alias("ptr"), F.least("low", "up.low").alias("low")), "circle")
        now.drop()
        now = after
    ends = now.df.select(F.col("node").alias("ptr"), F.col("low").alias("comp"))
    return lookup(now.df.select("node", "ptr"), ends, "ptr", ["node"]).select("node", "ptr", F.lit(None).cast("bigint").alias("steps"), F.lit(False).alias("done"), "comp")


def _far(giant: DataFrame, linked: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """Components too large for one task, from the jumps alone."""
    acyclic = F.coalesce("done", F.lit(True))
    circle = giant.where(~acyclic)
    out = giant.select("node", F.when(acyclic, F.coalesce("ptr", "node")).otherwise(F.col("comp")).alias("root"), F.when(acyclic, F.coalesce("steps", F.lit(0))).otherwise(F.lit(-1)).cast("bigint").alias("depth"))
    # On a circle is what some node of the component reaches after as many steps as there are nodes.
    out = lookup(out, circle.select(F.col("ptr").alias("node")).distinct().withColumn("on_cycle", F.lit(True)), "node", ["root"]).withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))
    if not wanted:
        return out
    own = linked.join(giant.where(acyclic).select("node"), "node", "left_semi")
    paths = jump(own, path=True)[0].df
    if "descendants" in wanted:
        below = paths.select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("descendants"))
        out = out.join(below, "node", "left").withColumn("descendants", F.when(F.col("depth") >= 0, F.coalesce("descendants", F.lit(0))))
    if "path" in wanted:
        out = out.join(paths.select("node", "path"), "node", "left").withColumn("path", F.when(F.col("depth") >= 0, F.concat(F.coalesce("path", F.expr("cast(array() as array<bigint>)")), F.array("node"))))
    return out


def closure(tree: DataFrame) -> DataFrame:
    """``ancestor, node, distance``: all descendants as rows, from ``hierarchies(want=("path",))``.

    Rows are as many as the depths summed up, and no task holds all descendants of a node.
    """
    pairs = tree.where(F.col("depth") > 0).select("node", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("i", "ancestor"), "depth")
    return pairs.select("ancestor", "node", (F.col("depth") - F.col("i")).alias("distance"))


def _around(edges: DataFrame, tree: DataFrame, want: tuple[str, ...], max_component: int) -> tuple[DataFrame, DataFrame]:
    """Below circles, where ``tree`` has depth -1: the trees that hang on each circle's nodes, and the circles' nodes.

    The first are ``hierarchies`` with the circles' links cut, so their roots are
    the circles' nodes. The second have ``top, circle, turn, length``: the
    circle's smallest id, the steps up to it, and the circle's number of links.
    """
    one = edges.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    stuck = cut(tree.where(F.col("depth") < 0).select("node", "on_cycle", F.col("root").alias("circle")).join(one, "node"), "stuck").df
    ring = stuck.where("on_cycle")
    turns = hierarchies(ring.select("node", F.when(F.col("node") != F.col("circle"), F.col("parent")).alias("parent")), max_component=max_component)
    turns = cut(turns.select(F.col("node").alias("top"), F.col("root").alias("circle"), F.col("depth").alias("turn")), "turns").df
    lengths = turns.groupBy("circle").agg(F.count(F.lit(1)).alias("length"))
    hanging = hierarchies(stuck.select("node", F.when(~F.col("on_cycle"), F.col("parent")).alias("parent")), want, max_component)
    return cut(hanging, "hanging").df, turns.join(lengths, "circle")


def whole_paths(edges: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """``node, path, descendants, circle`` of every node, also where its way ends in a circle.

    There ``circle`` is the circle's smallest id, and the path begins where the
    way leaves the circle, so that of a node on it is the node alone. The
    descendants of a node on a circle are the circle's other nodes and all that hangs on any of them.
    """
    tree = cut(hierarchies(edges, ("path", "descendants"), max_component), "tree").df
    hanging, ring = _around(edges, tree, ("path", "descendants"), max_component)
    free = tree.where(F.col("depth") >= 0).select("node", "path", "descendants", F.lit(None).cast("bigint").alias("circle"))
    sums = hanging.where(F.col("depth") == 0).join(ring.withColumnRenamed("top", "node"), "node").groupBy("circle").agg(F.sum(F.col("descendants") + 1).alias("all"))
    on = ring.select("top", "circle").join(sums, "circle")
    placed = lookup(hanging, on.select(F.col("top").alias("root"), "circle", "all"), "root", ["node"])
    return free.unionByName(placed.select("node", "path", F.when(F.col("depth") > 0, F.col("descendants")).otherwise(F.col("all") - 1).alias("descendants"), "circle"))


def whole_closure(edges: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """``ancestor, node, distance``: all descendants of every node, also on and below circles.

    A node on a circle isn't its own descendant; ``distance`` is that of the
    shortest way. Rows of a circle are as many as its links times the nodes whose
    way ends in it, which is the result's own size.
    """
    tree = cut(hierarchies(edges, ("path",), max_component), "tree").df
    hanging, ring = _around(edges, tree, ("path",), max_component)
    below = lookup(hanging.select("node", "root", "depth"), ring.withColumnRenamed("top", "root"), "root", ["node"])
    members = ring.select(F.col("top").alias("ancestor"), "circle", F.col("turn").alias("from"))
    pairs = below.join(members, "circle").where(F.col("ancestor") != F.col("root"))  # closure has a circle's node and what hangs on it
    round_ = pairs.select("ancestor", "node", (F.col("depth") + F.pmod(F.col("turn") - F.col("from"), "length")).alias("distance"))
    return closure(tree).unionByName(closure(hanging)).unionByName(round_)


def circles(edges: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """``node, parent, circle``: the links that lie on a circle, ``circle`` being its smallest id. ``parent`` closes it for one of them."""
    tree = hierarchies(edges, max_component=max_component).where("on_cycle").select("node", F.col("root").alias("circle"))
    one = edges.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    return one.join(tree, "node").select("node", "parent", "circle")
