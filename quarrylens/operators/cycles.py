"""Cycles of a dependency graph: strong components, elementary cycles, a greedy set of edges that breaks them all.

bean_edges(src, dst[, injection_type, field_name, method_count]). Self-loops are cycles of one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.lineage import cut

#: Cost of cutting an injection; a bean method's is not given anywhere and is taken as a constructor's.
INJECTION_WEIGHT = {"FIELD": 1.0, "SETTER": 2.0, "CONSTRUCTOR": 3.0, "BEAN_METHOD": 3.0}
FIXES = {"FIELD": "Add @Lazy to the field", "SETTER": "Add @Lazy to the setter parameter", "CONSTRUCTOR": "Use setter injection with @Lazy, or extract an interface", "BEAN_METHOD": "Extract the method's dependencies"}


def dependency_sets(edges: DataFrame) -> DataFrame:
    """(src, dependencies): what each bean depends on, sorted."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))


#: Graphs and components of more edges are walked step by step over the cluster, smaller ones whole in a task.
WHOLE_EDGES = 100_000


def _components_of(edges: list[tuple]) -> dict:
    """Node to the least node of its strong component: depth-first numbers and the least that each reaches, without recursion."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number, low, held, on, root = {}, {}, [], set(), {}
    for start in out:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        held.append(start)
        on.add(start)
        ways = [(start, iter(out[start]))]
        while ways:
            at, further = ways[-1]
            for x in further:
                if x not in number:
                    number[x] = low[x] = len(number)
                    held.append(x)
                    on.add(x)
                    ways.append((x, iter(out[x])))
                    break
                if x in on:
                    low[at] = min(low[at], number[x])
            else:
                ways.pop()
                if ways:
                    low[ways[-1][0]] = min(low[ways[-1][0]], low[at])
                if low[at] == number[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(held.pop())
                    on.difference_update(members)
                    root.update(dict.fromkeys(members, min(members)))
    return root


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node of the strong component. Only nodes on an edge.

    Up to ``WHOLE_EDGES`` edges, which are counted, one task does it. Beyond: rounds of colouring: each node takes the least node that reaches
    it; a colour's own node and what reaches it within the colour are one component, and leave. No reachability pairs are made.
    """
    few = cut(edges.select("src", "dst").distinct())
    if few.count() <= WHOLE_EDGES:
        kind = few.schema["src"].dataType.simpleString()

        def whole(part: pd.DataFrame) -> pd.DataFrame:
            found = _components_of(list(zip(part["src"].tolist(), part["dst"].tolist(), strict=True)))
            return pd.DataFrame({"node": list(found), "component": list(found.values())})

        return few.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(whole, f"node {kind}, component {kind}")
    return _coloured(few)


def _coloured(edges: DataFrame) -> DataFrame:
    """The same by rounds of colouring over the cluster."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    done = None
    while not nodes.isEmpty():
        colour = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            pushed = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("c"))
            after = cut(colour.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.col("colour").alias("old"), F.least("colour", "c").alias("colour")))
            changed = not after.filter("old <> colour").isEmpty()
            colour = after.select("node", "colour")
            if not changed:
                break
        tail, head = colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2"))
        inside = cut(left.join(tail, "src").join(head, "dst").filter("c1 = c2").select("src", "dst"))
        found = front = cut(colour.filter("node = colour"))
        while not front.isEmpty():
            back = inside.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "colour").distinct()
            front = cut(back.join(found, "node", "left_anti"))
            found = found.union(front)
        found = cut(found.withColumnRenamed("colour", "component"))
        done = found if done is None else done.union(found)
        nodes = cut(nodes.join(found, "node", "left_anti"))
        left = cut(inside.join(nodes, F.col("src") == F.col("node"), "left_semi").join(nodes, F.col("dst") == F.col("node"), "left_semi"))
    return done if done is not None else nodes.withColumn("component", F.col("node"))


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(node, component) of components that hold a cycle: two nodes or more, or a self-loop."""
    all_ = cut(strong_components(edges))
    large = all_.groupBy("component").count().filter("count > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("component"))
    return all_.join(large.union(loops).distinct(), "component", "left_semi").select("node", "component")


def _cycles_of(edges: list[tuple]) -> Iterator[list]:
    """Elementary cycles, closed at their least node: walks from each node over greater ones that lead back to it."""
    out, into = {}, {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    for start in sorted(out):
        back, todo = {start}, [start]  # nodes from which the start is reached over none less than it
        while todo:
            for x in into.get(todo.pop(), ()):
                if x >= start and x not in back:
                    back.add(x)
                    todo.append(x)
        path, on, ways = [start], {start}, [iter(out[start])]
        while ways:
            for x in ways[-1]:
                if x == start:
                    yield [*path, start]
                elif x in back and x not in on:
                    path.append(x)
                    on.add(x)
                    ways.append(iter(out.get(x, ())))
                    break
            else:
                ways.pop()
                on.discard(path.pop())


def elementary_cycles(edges: DataFrame) -> DataFrame:
    """(cycle array, closed at its least node): every elementary cycle once. Paths start at their least node, within one component."""
    parts = cyclic_components(edges)
    tail, head = parts.select(F.col("node").alias("src"), F.col("component").alias("c1")), parts.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    inside = cut(edges.select("src", "dst").distinct().join(tail, "src").join(head, "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("component")))
    large = cut(inside.groupBy("component").count().filter(F.col("count") > WHOLE_EDGES).select("component"))
    kind = inside.schema["src"].dataType.simpleString()

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cycle": list(_cycles_of(list(zip(part["src"].tolist(), part["dst"].tolist(), strict=True))))}, dtype=object)

    out = inside.join(large, "component", "left_anti").groupBy("component").applyInPandas(walk, f"cycle array<{kind}>")
    return out if large.isEmpty() else out.union(_walked(inside.join(large, "component", "left_semi")))


def _walked(inside: DataFrame) -> DataFrame:
    """The same, one edge further each round, however long the paths are."""
    steps = inside.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    front = cut(inside.filter("dst >= src").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path")))
    found = None
    while not front.isEmpty():
        closed = front.filter("at = start").select(F.col("path").alias("cycle"))
        found = closed if found is None else found.union(closed)
        more = front.filter("at <> start").join(steps, "at").filter((F.col("to") == F.col("start")) | ((F.col("to") > F.col("start")) & ~F.array_contains("path", F.col("to"))))
        front = cut(more.select("start", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path")))
    return found


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """(cycle, src, dst): the edges of each cycle."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("cycle") - 1), lambda i: F.struct(F.element_at("cycle", i).alias("src"), F.element_at("cycle", i + 1).alias("dst")))
    return cycles.select("cycle", F.explode(pairs).alias("e")).select("cycle", "e.*")


def edge_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): by injection type, 0.1 a method and 0.5 for each edge into the target."""
    table = F.create_map(*[F.lit(x) for kv in INJECTION_WEIGHT.items() for x in kv])
    into = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("incoming"))
    own = table[F.col("injection_type")] + 0.1 * F.coalesce("method_count", F.lit(0)) + 0.5 * F.col("incoming")
    return edges.join(into, "dst").groupBy("src", "dst").agg(F.min(own).alias("weight"))


def greedy_cut(cycles: DataFrame, weights: DataFrame) -> DataFrame:
    """(step, src, dst): while cycles remain, the edge with most cycles for its weight, least names first, and its cycles go.

    Components don't touch each other, so each takes its own next edge in a round. Within one the ratio never rises, so sorting all
    that were taken by ratio and name gives the order in which one at a time would have been.
    """
    edges = cut(cycle_edges(cycles))
    left = cut(edges.join(strong_components(edges.select("src", "dst").distinct()), F.col("src") == F.col("node")).select("cycle", "src", "dst", "component"))
    chosen = None
    while not left.isEmpty():
        score = left.groupBy("component", "src", "dst").agg(F.count("*").alias("n")).join(weights, ["src", "dst"])
        best = cut(score.groupBy("component").agg(F.min(F.struct((-F.col("n") / F.col("weight")).alias("ratio"), "src", "dst")).alias("b")).select("b.*"))
        chosen = best if chosen is None else chosen.union(best)
        left = cut(left.join(left.join(best, ["src", "dst"], "left_semi").select("cycle").distinct(), "cycle", "left_anti"))
    if chosen is None:
        return edges.select(F.lit(0).alias("step"), "src", "dst").limit(0)
    # places by sorted ranges: a range's rows in order, after the rows of the ranges before
    ranged = cut(chosen.orderBy("ratio", "src", "dst").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("ratio", "src", "dst"))
    return ranged.join(F.broadcast(before), "part").select((place + F.col("before")).cast("int").alias("step"), "src", "dst")


def with_reverse(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """``selected`` edges and, where there is one, the edge the other way of each."""
    swapped = selected.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return selected.select("src", "dst").union(edges.select("src", "dst").join(swapped, ["src", "dst"], "left_semi")).distinct()


def without(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """The edges that stay: what a check after the fixes looks at again."""
    return edges.join(selected.select("src", "dst"), ["src", "dst"], "left_anti")


def fixes(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, injection_type, fix)."""
    table = F.create_map(*[F.lit(x) for kv in FIXES.items() for x in kv])
    return edges.join(selected.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select("src", "dst", "injection_type", table[F.col("injection_type")].alias("fix"))


def cycles_through(cycles: DataFrame, beans: DataFrame) -> DataFrame:
    """Cycles with at least one of ``beans`` (column bean)."""
    hit = cycles.select("cycle", F.explode("cycle").alias("bean")).join(beans, "bean", "left_semi").select("cycle").distinct()
    return cycles.join(hit, "cycle", "left_semi")


def formatted(cycles: DataFrame) -> DataFrame:
    """(text): short names, closed, joined by arrows."""
    return cycles.select(F.array_join(F.transform("cycle", lambda x: F.element_at(F.split(x.cast("string"), r"\."), -1)), " -> ").alias("text"))
