"""Import graphs as edge tables (src, dst): resolution, degrees, strongly connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from corvane.functions.scalars import dirname, extname
from corvane.operators.session import checkpointing

#: Edges that one task takes for strongly connected components.
CORE = 500_000


def resolve(imports: DataFrame, nodes: DataFrame, dotted: bool = False) -> DataFrame:
    """Distinct edges (src, dst) of `resolved`."""
    return resolved(imports, nodes, dotted).select("src", "dst").distinct()


def resolved(imports: DataFrame, nodes: DataFrame, dotted: bool = False) -> DataFrame:
    """src, spec, dst of relative import specifiers (file_path, spec) to known files, first candidate that exists.

    A specifier with an extension is tried as it is, and .js as .ts; one without as .ts, then as /index.ts.  dotted=True also
    tries .ts after an extension that is part of a name."""
    spec = F.col("spec")
    rel = imports.where(spec.startswith(".") & ~spec.contains("?") & ~spec.contains("#"))
    parts = F.split(F.concat_ws("/", dirname(F.col("file_path")), spec), "/")
    # . and empty parts go, .. takes the part before it; a path that leaves the root is dropped
    step = lambda a, p: F.when(p.isin("", "."), a).when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    base = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    rel = rel.withColumn("base", base).where(~F.col("base").startswith(".."))
    ext = extname(F.col("base"))
    with_ext = [F.col("base"), F.when(ext == ".js", F.regexp_replace("base", r"\.js$", ".ts"))] + ([F.concat("base", F.lit(".ts"))] if dotted else [])
    without = [F.concat("base", F.lit(".ts")), F.concat("base", F.lit("/index.ts"))]
    cands = F.when(ext != "", F.array(*with_ext)).otherwise(F.array(*without))
    tried = rel.select("file_path", "spec", F.posexplode(cands).alias("nth", "dst")).where("dst is not null")
    hit = tried.join(nodes.select(F.col("file_path").alias("dst")).distinct(), "dst", "left_semi")
    first = hit.groupBy("file_path", "spec").agg(F.min_by("dst", "nth").alias("dst"))
    return first.select(F.col("file_path").alias("src"), "spec", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fan_in and fan_out of every node (distinct edges), 0 for isolated ones; one pre-aggregated shuffle of both directions."""
    both = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("dst"), F.lit(1), F.lit(0)))
    both = both.union(nodes.select("node", F.lit(0), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").cast("long").alias("fan_in"), F.sum("o").cast("long").alias("fan_out"))


def trimmed(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Edges between nodes that have both predecessors and successors, again and again: what may lie on a cycle."""
    checkpointing(edges.sparkSession)
    left = edges.distinct().checkpoint()
    n = left.count()
    for _ in range(rounds):
        ends = left.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        both = ends.groupBy("v").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 and i = 1").select("v")
        left = left.join(both.withColumnRenamed("v", "src"), "src", "left_semi").join(both.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst").checkpoint()
        was, n = n, left.count()
        if n in (0, was):
            break
    return left


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(v, c): the greatest colour that reaches each node along edges (src -> dst)."""
    while True:
        into = edges.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("m"))
        nxt = colour.join(into, "v", "left").select("v", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was")).checkpoint()
        moved = nxt.where("c <> was").limit(1).count()
        colour = nxt.select("v", "c")
        if not moved:
            return colour


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one predecessor and one successor, by pointer doubling: (v, low, last, tail) of each, where tail is the first
    other node after its chain (null: the chain is a whole cycle), last the chain's last node, and low the cycle's smallest."""
    one = F.when(F.col("src") == F.col("dst"), 2).otherwise(1)  # a node that points to itself is no chain's
    ends = edges.select(F.col("src").alias("v"), one.alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), one))
    thin = ends.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 and i = 1").select("v")
    step = edges.where("src <> dst").join(thin.withColumnRenamed("v", "src"), "src").select(F.col("src").alias("v"), F.col("dst").alias("to"))
    inside = thin.select(F.col("v").alias("to"), F.lit(True).alias("going"))
    ptr = step.join(inside, "to", "left").select("v", "to", F.least("v", "to").alias("low"), F.col("v").alias("last"), F.coalesce("going", F.lit(False)).alias("going")).checkpoint()
    for _ in range(max(1, ptr.count()).bit_length() + 1):
        nxt = ptr.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("last").alias("last2"), F.col("going").alias("going2"))
        ptr = ptr.where("not going").select("v", "to", "low", "last", "going").union(ptr.where("going").join(nxt, "to").select("v", "to2", F.least("low", "low2"), "last2", "going2")).checkpoint()
        if not ptr.where("going").limit(1).count():
            break
    return ptr.select("v", "low", "last", F.when(~F.col("going"), F.col("to")).alias("tail")), thin


def _tarjan(src: list, dst: list) -> list[tuple]:
    """(node, smallest node of its component) of components of two nodes or more."""
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    order: dict = {}
    low: dict = {}
    held: list = []
    on: set = set()
    found = []
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        held.append(root)
        on.add(root)
        work = [(root, iter(out[root]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    held.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(held.pop())
                    on.difference_update(part)
                    if len(part) > 1:
                        least = min(part)
                        found += [(x, least) for x in part]
    return found


def _local(edges: DataFrame, part: Column) -> DataFrame:
    """(node, scc): components of the edges of each part, one task a part."""
    kind = edges.schema["src"].dataType
    arrow = to_arrow_type(kind)

    def run(t: pa.Table) -> pa.Table:
        found = _tarjan(t.column("src").to_pylist(), t.column("dst").to_pylist())
        return pa.table({"node": pa.array([x for x, _ in found], arrow), "scc": pa.array([x for _, x in found], arrow)})

    schema = f"node {kind.simpleString()}, scc {kind.simpleString()}"
    return edges.select("src", "dst", part.alias("part")).groupBy("part").applyInArrow(lambda t: run(t.drop_columns(["part"])), schema)


def cyclic_components(edges: DataFrame, core: int = CORE) -> DataFrame:
    """(node, scc): nodes on cycles with the smallest node of their strongly connected component (self-loops included).

    Up to `core` edges are one task's work, whatever the shape of the graph: the count decides, and no graph that is larger gets
    there.  A larger graph first loses what can't lie on a cycle, then shrinks in rounds: nodes are dealt out, by neighbourhood of
    their names and by hash in turn, so that a part has about `core` edges between its own nodes, the components that a part sees
    become one node each, and what is left is trimmed again.  What won't shrink to one task's size goes on with chains and colours
    (`_spread_out`)."""
    checkpointing(edges.sparkSession)
    kind = edges.schema["src"].dataType
    left = edges.where("src <> dst").distinct().checkpoint()
    loops = edges.where("src = dst").select(F.col("src").cast(kind).alias("node"), F.col("src").alias("scc")).distinct()
    maps, n, idle = [], left.count(), 0
    if n > core:
        left = trimmed(left)
        n = left.count()
    while n > core and idle < 2:
        parts = -(-n // max(1, core))
        if len(maps) % 2 == idle % 2:  # neighbours by name: cuts of equal numbers of edges
            cuts = left.stat.approxQuantile("src", [k / parts for k in range(1, parts)], 0.01) if isinstance(kind, NumericType) else None
            place = (lambda c: F.lit(0) if not cuts else sum(((F.col(c) > x).cast("int") for x in cuts), F.lit(0))) if cuts and len(cuts) <= 200 else lambda c: F.crc32(F.substring_index(F.col(c).cast("string"), "/", -1 - len(maps)).cast("binary")) % parts
        else:
            place = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(len(maps))), F.lit(parts))
        near = left.withColumn("p", place("src")).where(F.col("p") == place("dst"))
        m = _local(near.select("src", "dst", "p"), F.col("p")).checkpoint()
        idle = 0 if m.limit(1).count() else idle + 1
        maps.append(m)
        a, b = m.select(F.col("node").alias("src"), F.col("scc").alias("s1")), m.select(F.col("node").alias("dst"), F.col("scc").alias("s2"))
        left = left.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("s1", "src").alias("src"), F.coalesce("s2", "dst").alias("dst")).where("src <> dst").distinct()
        left = trimmed(left)
        n = left.count()
    found = _local(left, F.lit(0)) if n <= core else _spread_out(left)
    for m in reversed(maps):
        up = found.select(F.col("node").alias("scc"), F.col("scc").alias("top"))
        inner = m.join(up, "scc", "left").select("node", F.coalesce("top", "scc").alias("scc"))
        found = inner.unionByName(found.join(m.select("node"), "node", "left_anti"))
    if maps:
        found = found.checkpoint()
        low = found.groupBy("scc").agg(F.min("node").alias("low"))
        found = found.join(low, "scc").select("node", F.col("low").alias("scc"))
    found = found.checkpoint()
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def _spread_out(left: DataFrame) -> DataFrame:
    """(node, scc) of a graph that is too large for a task.

    Chains of nodes with one predecessor and one successor become one edge each, by pointer doubling.  The rest is coloured
    forward: the greatest node that reaches v is v's colour; the nodes of a colour that reach its root back are that root's
    component.  They are taken out and the rest goes on.  Every round is checkpointed; rounds follow the graph's diameter."""
    ptr, thin = _chains(left)
    a, b = thin.withColumnRenamed("v", "src"), thin.withColumnRenamed("v", "dst")
    enter = left.join(a, "src", "left_anti").join(ptr.select(F.col("v").alias("dst"), "last", "tail"), "dst").select("src", "last", "tail").checkpoint()
    core = left.join(a, "src", "left_anti").join(b, "dst", "left_anti").select("src", "dst").union(enter.select("src", "tail")).distinct()
    found = _coloured(trimmed(core))
    whole = ptr.where("tail is null").select(F.col("v").alias("node"), F.col("low").alias("scc"))
    if found is None:
        return whole
    # a chain belongs to the component that both its ends are in
    head = enter.join(found.select(F.col("node").alias("src"), F.col("scc").alias("c1")), "src").join(found.select(F.col("node").alias("tail"), F.col("scc").alias("c2")), "tail").where("c1 = c2").select("last", F.col("c1").alias("scc"))
    all_ = found.union(ptr.where("tail is not null").join(head, "last").select(F.col("v").alias("node"), "scc")).checkpoint()
    low = all_.groupBy("scc").agg(F.min("node").alias("low"))
    return all_.join(low, "scc").select("node", F.col("low").alias("scc")).union(whole)


def _coloured(left: DataFrame) -> DataFrame | None:
    done = None
    while left.limit(1).count():
        nodes = left.select(F.col("src").alias("v")).union(left.select("dst")).distinct()
        colour = _spread(left, nodes.select("v", F.col("v").alias("c")))
        a, b = colour.select(F.col("v").alias("src"), F.col("c").alias("cs")), colour.select(F.col("v").alias("dst"), F.col("c").alias("cd"))
        inner = left.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")).checkpoint()
        back = colour.where("v = c").select("v", "c")
        seen = back
        while True:
            nxt = inner.join(back.select(F.col("v").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("v"), "c").distinct().join(seen, ["v", "c"], "left_anti").checkpoint()
            if not nxt.limit(1).count():
                break
            seen, back = seen.union(nxt).checkpoint(), nxt
        loops = left.where("src = dst").select(F.col("src").alias("v"))
        size = seen.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("scc"))
        part = seen.join(size, "c").join(loops.withColumn("loop", F.lit(1)), "v", "left").where("n > 1 or loop = 1").select(F.col("v").alias("node"), "scc")
        done = part if done is None else done.union(part)
        gone = seen.select("v")
        left = trimmed(left.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))
    return done


def cycle_table(components: DataFrame) -> DataFrame:
    """One row a component: its smallest node, its size, its nodes in order."""
    return components.groupBy("scc").agg(F.count("*").cast("long").alias("node_count"), F.array_sort(F.collect_set("node")).alias("nodes"))


def summary(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").cast("long").alias("nodes"))
    e = edges.distinct().agg(F.count("*").cast("long").alias("edges"))
    c = components.agg(F.count_distinct("scc").cast("long").alias("cycles"))
    return n.join(F.broadcast(e)).join(F.broadcast(c))  # three rows of one line each


def chain_edges(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Edges from each value to the next one of its group."""
    nxt = F.lead(value).over(Window.partitionBy(group).orderBy(order))
    gap = F.lead(order).over(Window.partitionBy(group).orderBy(order)) - F.col(order)
    return rows.select(F.col(value).alias("src"), nxt.alias("dst"), gap.alias("gap")).where("gap = 1").select("src", "dst").distinct()
