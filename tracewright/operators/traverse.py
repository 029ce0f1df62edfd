"""Bounded breadth-first traversals and cycles."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.storage import cut, stored_table

# The edge kinds along which data flows.
DATA_KINDS = ("reads", "writes", "produces", "consumes", "transforms", "communicates_with")


def lineage(edges: DataFrame, start: str, downstream: bool = True, depth: int = 12, at_rest: bool = False) -> tuple[DataFrame, bool]:
    """(hops, truncated) from ``start``: every edge out of a frontier node is a hop, also to a node seen before.

    hops: id, kind, src, dst, depth; without id where edges have none. Each round joins the frontier
    with the edges and is written, compressed, once; only emptiness comes back to the driver. Edges
    that are read from a store (``at_rest``) aren't written again.
    """
    near, far = ("src", "dst") if downstream else ("dst", "src")
    columns = [c for c in ("id", "kind", "src", "dst") if c in edges.columns]
    flow = edges.where(F.col("kind").isin(*DATA_KINDS)).select(*columns)
    flow = flow if at_rest else stored_table(flow, "flow")
    frontier = edges.sparkSession.createDataFrame([(start,)], "node string")
    seen, rounds, more = frontier, [], True
    for k in range(1, depth + 1):
        met = seen.select(F.col("node").alias(far), F.lit(True).alias("known"))
        hop = flow.join(frontier, F.col(near) == F.col("node"), "left_semi").join(met, far, "left")
        hop = stored_table(hop.select(*columns, F.lit(k).alias("depth"), F.col("known").isNull().alias("fresh")), "hop")
        rounds.append(hop.drop("fresh"))
        frontier = hop.where("fresh").select(F.col(far).alias("node")).distinct()
        more = not frontier.isEmpty()
        if not more:
            break
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, rounds), more


def usage(edges: DataFrame, node: str) -> DataFrame:
    """(read, write, unclassified): the data edges at a node by what they do."""
    at = edges.where(F.col("kind").isin(*DATA_KINDS) & ((F.col("src") == node) | (F.col("dst") == node)))
    done = F.coalesce(F.col("attributes")["operation"], F.lit(""))
    return at.agg(F.count_if(done == "read").alias("read"), F.count_if(done == "write").alias("write"), F.count_if(~done.isin("read", "write")).alias("unclassified"))


def message_totals(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, calls, returns, responses, errors) of the messages of ``sequence``: a return over HTTP is a response, a throw an error."""
    http = edges.where("kind = 'returns'").where(F.coalesce(F.col("attributes")["httpResponse"], F.lit("")) == "true").select("id", F.lit(True).alias("http"))
    rows = messages.join(http, "id", "left")
    return rows.groupBy("entry").agg(F.count_if(F.col("kind") == "calls").alias("calls"), F.count_if((F.col("kind") == "returns") & F.col("http").isNull()).alias("returns"), F.count_if(F.col("http")).alias("responses"), F.count_if(F.col("kind") == "throws").alias("errors"))


def cycles(edges: DataFrame, longest: int = 64, most: int = 20) -> tuple[DataFrame, bool]:
    """(the first ``most`` simple cycles by length and key, whether there may be more): length, key.

    A path only grows over nodes larger than its first, so each cycle is found
    in one rotation only; nodes that no cycle can pass are trimmed first, until
    none is left. Lengths come one after the other, each checkpointed, and the search
    ends with the length that fills ``most``: shorter cycles are all known by then.
    """
    edges = cut(edges.select("src", "dst").distinct())
    before, left = None, edges.count()
    while left != before:
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        before, left = left, edges.count()
    step = edges.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = edges.select(F.array("src").alias("path"), F.col("dst").alias("next"))
    found, n, more = [], 0, False
    for k in range(1, longest + 1):
        closed = cut(paths.where(F.col("next") == F.col("path")[0]).select(F.lit(k).alias("length"), F.array_join("path", ">").alias("key")))
        found.append(closed)
        n += closed.count()
        grown = paths.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
        paths = cut(grown.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last")).join(step, "last").select("path", "next"))
        more = not paths.isEmpty()
        if not more or n > most:
            break
    return reduce(DataFrame.unionByName, found).orderBy("length", "key").limit(most), more or n > most


def steps(edges: DataFrame, entries: DataFrame, depth: int = 6, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """What each entry (a row ``entry``) leads to along the edges (id, src, dst), breadth first.

    (steps: entry, place, id, src, dst, depth; cuts: entry, n_cut). Each edge out of a node met
    for the first time is a step, in the order in which nodes were met, then of edge ids.
    All entries walk at once; the first ``most`` steps are given, the rest counted.
    """
    calls = cut(edges.select("id", "src", "dst"))
    seen = frontier = cut(entries.select("entry", F.col("entry").alias("node"), F.lit(0).cast("long").alias("met")))
    rounds, before = [], None
    for k in range(1, depth + 1):
        hop = calls.join(frontier, F.col("src") == F.col("node"))
        place = F.row_number().over(Window.partitionBy("entry").orderBy("met", "id")).cast("long")
        hop = hop.select("entry", "id", "src", "dst", F.lit(k).alias("depth"), place.alias("within"))
        if before is not None:
            hop = hop.join(before, "entry", "left").withColumn("place", F.col("within") + F.coalesce("n", F.lit(0))).drop("n")
        else:
            hop = hop.withColumn("place", F.col("within"))
        hop = cut(hop)
        rounds.append(hop)
        counted = hop.groupBy("entry").agg(F.max("place").alias("n"))
        before = counted if before is None else before.withColumnRenamed("n", "old").join(counted, "entry", "full_outer").select("entry", F.coalesce("n", "old").alias("n"))
        met = hop.groupBy("entry", F.col("dst").alias("node")).agg(F.min("within").alias("met"))
        frontier = cut(met.join(seen.select("entry", "node"), ["entry", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    every = reduce(DataFrame.unionByName, rounds).drop("within")
    cuts = every.where(F.col("place") > most).groupBy("entry").agg(F.count(F.lit(1)).alias("n_cut"))
    return every.where(F.col("place") <= most), cuts


def first_steps(edges: DataFrame, entries: DataFrame, depth: int = 6, most: int = 40) -> DataFrame:
    """The steps of ``steps``, for who doesn't ask how many are cut: an entry walks no further than to its last step.

    Steps of a round come after those of the rounds before, and in the order in which their nodes were met. So
    only the first ``most`` edges out of a node can be steps, and nothing that is met beyond an entry's last step leads to one.
    """
    nth = F.row_number().over(Window.partitionBy("src").orderBy("id"))
    calls = stored_table(edges.select("id", "src", "dst").withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), "calls")
    frontier = entries.select("entry", F.col("entry").alias("node"), F.lit(0).cast("long").alias("met"), F.lit(0).cast("long").alias("n"))
    seen, rounds = frontier.select("entry", "node"), []
    for k in range(1, depth + 1):
        hop = calls.join(frontier, F.col("src") == F.col("node"))
        hop = hop.withColumn("within", F.row_number().over(Window.partitionBy("entry").orderBy("met", "id"))).where(F.col("within") <= most)
        hop = hop.select("entry", (F.col("n") + F.col("within")).alias("place"), "id", "src", "dst", F.lit(k).alias("depth")).where(F.col("place") <= most)
        rounds.append(stored_table(hop, "hop"))
        if k == depth:
            break
        left = rounds[-1].groupBy("entry").agg(F.max("place").alias("n")).where(F.col("n") < most)
        met = rounds[-1].groupBy("entry", F.col("dst").alias("node")).agg(F.min("place").alias("met")).join(left, "entry")
        frontier = stored_table(met.join(seen, ["entry", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("entry", "node"))
    return reduce(DataFrame.unionByName, rounds)


_MESSAGE = "entry string, place int, kind string, src string, dst string, id string"


def sequence(nodes: DataFrame, edges: DataFrame, entries: DataFrame, depth: int = 8, most: int = 60) -> DataFrame:
    """The messages of each entry in order: entry, place, kind, src, dst, id.

    Depth first over calls in the order of their ids; a call is followed by what its
    callee does, if that wasn't met yet, and then by what comes back from it (returns,
    then throws). Packages take no part. At most ``most`` calls are drawn, and the
    calls drawn are all closed. Out of a node only its first ``most`` calls can be
    drawn, so an entry's part of the graph is bounded before one task walks it.
    """
    known = nodes.where("kind <> 'package'").select(F.col("id").alias("dst"))
    calls = edges.where("kind = 'calls'").select("id", "src", "dst").join(known, "dst", "left_semi")
    first = F.row_number().over(Window.partitionBy("src").orderBy("id"))
    calls = cut(calls.withColumn("k", first).where(F.col("k") <= most).drop("k"))
    reached, frontier = entries.select("entry", F.col("entry").alias("node")), entries.select("entry", F.col("entry").alias("node"))
    parts = []
    for _ in range(depth + 1):
        hop = cut(calls.join(frontier, F.col("src") == F.col("node"), "inner").select("entry", "id", "src", "dst"))
        parts.append(hop)
        frontier = cut(hop.select("entry", F.col("dst").alias("node")).distinct().join(reached, ["entry", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    mine = reduce(DataFrame.unionByName, parts).withColumn("kind", F.lit("calls"))
    back = edges.where("kind in ('returns', 'throws')").select("kind", F.col("id").alias("back_id"), F.col("src").alias("dst"), F.col("dst").alias("src"))
    backs = mine.drop("kind").join(back, ["src", "dst"]).select("entry", F.col("back_id").alias("id"), "src", "dst", "kind")

    def walk(key, rows):
        import pandas as pd

        out, drawn, met = [], 0, {key[0]}
        calls_of, closing = {}, {}
        for r in rows.sort_values(["kind", "id"]).itertuples():
            if r.kind == "calls":
                calls_of.setdefault(r.src, []).append((r.id, r.dst))
            else:
                closing.setdefault((r.src, r.dst), []).append((r.kind, r.id))
        stack = [(key[0], iter(calls_of.get(key[0], ())), None)]
        while stack:
            at, left, opened = stack[-1]
            call = next(left, None) if drawn < most else None
            if call is None:
                stack.pop()
                if opened:
                    out += [(kind, opened[1], opened[0], i) for kind, i in closing.get(opened, ())]
                continue
            drawn += 1
            out.append(("calls", at, call[1], call[0]))
            if call[1] not in met and len(stack) <= depth:
                met.add(call[1])
                stack.append((call[1], iter(calls_of.get(call[1], ())), (at, call[1])))
            else:
                out += [(kind, call[1], at, i) for kind, i in closing.get((at, call[1]), ())]
        return pd.DataFrame([(key[0], k + 1, kind, a, b, i) for k, (kind, a, b, i) in enumerate(out)], columns=["entry", "place", "kind", "src", "dst", "id"])

    return mine.unionByName(backs).distinct().groupBy("entry").applyInPandas(walk, _MESSAGE)


def attribution(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, container): the component that deploys each module; of several the last id, and not the file that declares it."""
    rows = edges.where("kind = 'deploys'").join(nodes.where("kind = 'deployment_component'").select(F.col("id").alias("dst"), F.col("path").alias("declared")), "dst")
    rows = rows.join(nodes.where("kind = 'module'").select(F.col("id").alias("src"), F.col("path").alias("own")), "src").where("not (own <=> declared)")
    return rows.groupBy(F.col("src").alias("module")).agg(F.max("dst").alias("container"))
