"""Graph operators over dependency edges (up, down), for one graph or, with a key, for many at once.

Closures are semi-naive joins: a round extends only what the last one found, and cyclic input ends when nothing new
turns up. Each round is written to the shared folder. Declaration order is a column pos of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.faults import DependencyCycle
from tidemark.functions.schema import TERMINAL_STATES
from tidemark.session import materialize


def clean(nodes: DataFrame, edges: DataFrame, key: list[str] = ()) -> DataFrame:
    """Distinct edges both of whose ends are nodes."""
    names = nodes.select(*key, F.col("node")).distinct()
    known = edges.join(names.withColumnRenamed("node", "up"), [*key, "up"], "left_semi")
    return known.join(names.withColumnRenamed("node", "down"), [*key, "down"], "left_semi").select(*key, "up", "down").distinct()


def closure(edges: DataFrame, key: list[str] = ()) -> DataFrame:
    """up, down for every pair that a path joins; a node on a cycle is its own ancestor."""
    step = edges.select(*key, F.col("up").alias("mid"), F.col("down").alias("next"))
    new = materialize(edges.select(*key, "up", "down").distinct(), "closure")
    known = new
    while not new.isEmpty():
        more = new.withColumnRenamed("down", "mid").join(step, [*key, "mid"]).select(*key, "up", F.col("next").alias("down")).distinct()
        new = materialize(more.join(known, [*key, "up", "down"], "left_anti"), "closure")
        known = known.unionByName(new)
    return known


def ancestors(closed: DataFrame, node: str) -> DataFrame:
    return closed.where(F.col("down") == node).select(F.col("up").alias("node")).where(F.col("node") != node)


def descendants(closed: DataFrame, node: str) -> DataFrame:
    return closed.where(F.col("up") == node).select(F.col("down").alias("node")).where(F.col("node") != node)


def reachable_from(closed: DataFrame, nodes: DataFrame, starts: list[str]) -> DataFrame:
    """The starts that are nodes, and all that depends on them."""
    own = nodes.where(F.col("node").isin(*starts)).select("node")
    return own.unionByName(closed.where(F.col("up").isin(*starts)).select(F.col("down").alias("node"))).distinct()


def roots(nodes: DataFrame, edges: DataFrame, key: list[str] = ()) -> DataFrame:
    return nodes.join(edges.select(*key, F.col("down").alias("node")), [*key, "node"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame, key: list[str] = ()) -> DataFrame:
    return nodes.join(edges.select(*key, F.col("up").alias("node")), [*key, "node"], "left_anti")


def levels(nodes: DataFrame, edges: DataFrame, key: list[str] = ()) -> DataFrame:
    """node, level: the longest way from a root. A round peels off the nodes whose parents all have levels; a cycle is an error."""
    left = materialize(nodes.select(*key, "node").distinct(), "levels")
    open_edges, done, level = edges.select(*key, "up", "down").distinct(), None, 0
    while True:
        ready = materialize(roots(left, open_edges, key).withColumn("level", F.lit(level)), "levels")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = materialize(left.join(ready, [*key, "node"], "left_anti"), "levels")
        open_edges = materialize(open_edges.join(ready.select(*key, F.col("node").alias("up")), [*key, "up"], "left_anti"), "levels")
        level += 1
    if not left.isEmpty():
        raise DependencyCycle("the graph has a cycle")
    return done if done is not None else left.withColumn("level", F.lit(0))


def longest_path(leveled: DataFrame) -> DataFrame:
    return leveled.agg(F.coalesce(F.max("level"), F.lit(0)).alias("length"))


def reduction(edges: DataFrame, closed: DataFrame, key: list[str] = ()) -> DataFrame:
    """Edges that no longer way implies: up -> down goes if another parent of down depends on up."""
    other = edges.select(*key, F.col("up").alias("down_of"), F.col("down"))
    implied = closed.select(*key, "up", F.col("down").alias("down_of")).where("up <> down_of").join(other, [*key, "down_of"]).select(*key, "up", "down")
    return edges.join(implied, [*key, "up", "down"], "left_anti")


def waves(nodes: DataFrame, leveled: DataFrame, key: list[str] = ()) -> DataFrame:
    """level, tasks in order of declaration."""
    rows = leveled.join(nodes.select(*key, "node", "pos"), [*key, "node"])
    tasks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])
    return rows.groupBy(*key, "level").agg(tasks.alias("tasks"))


def affected(edges: DataFrame, states: DataFrame, key: list[str] = ()) -> DataFrame:
    """Nodes that aren't at an end and that a way over such nodes joins to a failed one."""
    open_ = states.where(~F.col("state").isin(*TERMINAL_STATES)).select(*key, F.col("node").alias("down"))
    usable = edges.join(open_, [*key, "down"], "left_semi")
    new = states.where("state = 'failed'").select(*key, "node")
    known = None
    while True:
        found = new.withColumnRenamed("node", "up").join(usable, [*key, "up"]).select(*key, F.col("down").alias("node")).distinct()
        if known is not None:
            found = found.join(known, [*key, "node"], "left_anti")
        new = materialize(found, "affected")
        if new.isEmpty():
            return known if known is not None else new
        known = new if known is None else known.unionByName(new)


def adjacency(edges: DataFrame, into: bool = True, key: list[str] = ()) -> DataFrame:
    """node and its upstreams (into) or downstreams, in order of the edges' pos."""
    own, other = ("down", "up") if into else ("up", "down")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(other).alias("n")))), lambda x: x["n"])
    return edges.groupBy(*key, F.col(own).alias("node")).agg(names.alias("neighbours"))


def subgraph(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes among names and the edges between them."""
    kept = names.select("node").distinct()
    inner = edges.join(kept.withColumnRenamed("node", "up"), "up", "left_semi").join(kept.withColumnRenamed("node", "down"), "down", "left_semi")
    return nodes.join(kept, "node", "left_semi"), inner


def prefixed(nodes: DataFrame, edges: DataFrame, workflow: str) -> tuple[DataFrame, DataFrame]:
    """Names made unique by their workflow's, for a merge of workflows."""
    own = lambda c: F.concat(F.lit(workflow + "."), c)
    return nodes.withColumn("node", own("node")), edges.withColumns({"up": own("up"), "down": own("down")})


def critical_path(tasks: DataFrame, edges: DataFrame, key: str = "run_id") -> DataFrame:
    """key, pos, task: from the task that finished last, step by step the upstream that finished latest; ties by the later name.

    One aggregation by run, whose row holds the run's steps, no more than its definition has edges; the walk is an
    expression over that row. Tasks meet edges by workflow as well where both name it.
    """
    on = [c for c in ("workflow",) if c in tasks.columns and c in edges.columns]
    ran = tasks.where("started_at is not null and finished_at is not null").select(key, *on, "task", "finished_at")
    step = F.when(F.col("down").isNotNull(), F.struct("down", "finished_at", F.col("task").alias("up")))
    met = ran.join(edges.select(*on, F.col("up").alias("task"), "down").distinct(), [*on, "task"], "left")
    runs = met.groupBy(key).agg(F.collect_list(step).alias("steps"), F.max(F.struct("finished_at", "task"))["task"].alias("last"))
    best = lambda task: F.array_max(F.filter("steps", lambda s: s["down"] == task))["up"]
    ways = F.map_from_entries(F.transform(F.array_distinct("steps.down"), lambda d: F.struct(d, best(d))))
    runs = runs.select(key, "last", ways.alias("ways"))
    on_from = lambda path: F.element_at("ways", F.element_at(path, -1))
    path = F.aggregate(F.map_keys("ways"), F.array("last"), lambda path, _: F.when(on_from(path).isNull(), path).otherwise(F.array_append(path, on_from(path))))
    return runs.select(key, F.posexplode(F.reverse(path)).alias("pos", "task"))


# One definition's graph, on the driver -------------------------------------------------------------------------------


def topological(nodes: list[str], upstreams: dict[str, list[str]]) -> list[str]:
    """Every node after its upstreams; of the nodes that could come next, the one declared first. A cycle is an error."""
    import heapq

    place = {n: i for i, n in enumerate(nodes)}
    needs = {n: {u for u in upstreams.get(n, ()) if u in place} for n in nodes}
    children: dict[str, list[str]] = {}
    for n, ups in needs.items():
        for u in ups:
            children.setdefault(u, []).append(n)
    ready, out = [place[n] for n in nodes if not needs[n]], []
    heapq.heapify(ready)
    while ready:
        n = nodes[heapq.heappop(ready)]
        out.append(n)
        for c in children.get(n, ()):
            needs[c].discard(n)
            if not needs[c]:
                heapq.heappush(ready, place[c])
    if len(out) < len(nodes):
        raise DependencyCycle("the graph has a cycle")
    return out


def find_cycle(nodes: list[str], upstreams: dict[str, list[str]]) -> list[str] | None:
    """One cycle, its first node again at its end, or None: that which a walk up from the first declared node meets."""
    known, finished = set(nodes), set()
    for start in nodes:
        path: list[str] = []
        trail = [iter([start])]
        while trail and start not in finished:
            node = next(trail[-1], None)
            if node is None:
                trail.pop()
                if path:
                    finished.add(path.pop())
            elif node in path:
                return path[path.index(node) :] + [node]
            elif node not in finished and node in known:
                path.append(node)
                trail.append(iter(dict.fromkeys(upstreams.get(node, ()))))
    return None


__all__ = [
    "adjacency", "affected", "ancestors", "clean", "closure", "critical_path", "descendants", "find_cycle", "leaves", "levels", "longest_path",
    "prefixed", "reachable_from", "reduction", "roots", "subgraph", "topological", "waves",
]
