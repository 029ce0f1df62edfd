"""What changed between two snapshots."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_drift(base: DataFrame, target: DataFrame, fields: list[str], truncated: bool = False) -> DataFrame:
    """Changes (category, id, detail) of nodes (id, rank, fields).

    One full outer join. A removal can't be told where the target is truncated:
    its detail is INDETERMINATE. A node may change fields and confidence at once.
    """
    a = base.select("id", F.struct("rank", *fields).alias("a"))
    b = target.select("id", F.struct("rank", *fields).alias("b"))
    both = a.join(b, "id", "full_outer")
    changed = F.concat_ws(",", *[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields])
    here = F.col("a").isNotNull() & F.col("b").isNotNull()

    def change(when, category, detail):
        return F.when(when, F.struct(F.lit(category).alias("category"), detail.alias("detail")))

    ranks = F.concat(F.col("a.rank").cast("string"), F.lit(">"), F.col("b.rank").cast("string"))
    every = F.array(
        change(F.col("a").isNull(), "NODE_ADDED", F.lit("")),
        change(F.col("b").isNull(), "NODE_REMOVED", F.lit("INDETERMINATE" if truncated else "")),
        change(here & (changed != ""), "NODE_MODIFIED", changed),
        change(here & (F.col("a.rank") != F.col("b.rank")), "CONFIDENCE_CHANGED", ranks),
    )
    return both.select("id", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("c")).select("c.category", "id", "c.detail")


def renames(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(old_id, new_id, digest) for nodes (id, digest, keys) whose digest is unique among the removed and among the added."""

    def only(rows, others, name):
        left = rows.where(F.col("digest").isNotNull()).join(others.select("id"), "id", "left_anti")
        one = left.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", *keys)).alias(name)).where("n = 1")
        return one.select("digest", name)

    pairs = only(base, target, "a").join(only(target, base, "b"), "digest")
    for k in keys:
        pairs = pairs.where(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")))
    return pairs.select(F.col("a.id").alias("old_id"), F.col("b.id").alias("new_id"), "digest")


# The categories of changes, and the node fields whose difference is a modification.
CATEGORIES = ("NODE_ADDED", "NODE_REMOVED", "NODE_MODIFIED", "NODE_RENAMED", "EDGE_ADDED", "EDGE_REMOVED", "EDGE_MODIFIED", "EVIDENCE_ADDED", "EVIDENCE_REMOVED", "EVIDENCE_CHANGED", "CONFIDENCE_CHANGED")
NODE_FIELDS = ("name", "qualified_name", "path", "start_line", "end_line", "language", "digest")
EDGE_FIELDS = ("kind", "rank", "label")
MOST = 5000


def citations(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, cited): the order-free fingerprint of what each entity cites, by path, line and kind."""
    rows = refs.join(evidence.select(F.col("id").alias("evidence"), F.concat_ws(":", "path", F.col("line").cast("string"), "kind").alias("at")), "evidence")
    # hashed row by row and summed, so that an entity cited everywhere needs no array
    lanes = [F.sum(F.xxhash64(F.lit(k), "at").cast("decimal(20,0)")) for k in (1, 2)]
    return rows.groupBy("id").agg(F.concat_ws(":", F.count(F.lit(1)), *lanes).alias("cited"))


def _paired(base: DataFrame, target: DataFrame, fields, kind: str) -> DataFrame:
    """id, a and b: each entity's fields (with attributes and citations) in either snapshot; null where it isn't in it."""
    keep = [f for f in fields if f in base.columns]
    side = lambda rows, name: rows.select("id", F.struct(*keep, F.map_entries("attributes").alias("attributes"), "rank_", "cited", "label_").alias(name))
    return side(base, "a").join(side(target, "b"), "id", "full_outer").withColumn("entity", F.lit(kind))


def _named(rows: DataFrame, refs: DataFrame, evidence: DataFrame, label) -> DataFrame:
    rows = rows.withColumn("rank_", F.col("rank")).withColumn("label_", label).join(citations(refs, evidence), "id", "left")
    return rows.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))).withColumn("cited", F.coalesce("cited", F.lit("")))


def compare(base, target, truncated: bool = False, rename_kind: str = "module") -> DataFrame:
    """All changes between two graphs: category, entity, id, previous_id, label, fields, claim, indeterminate.

    Renames are settled before additions and removals: a pair of nodes of one kind
    and language whose digest is unique among what went and among what came. An edge
    whose confidence changes is modified and has its confidence changed; a node only
    the latter. What is missing from a truncated target may be there: its claim is
    INDETERMINATE and it is marked so.
    """
    node_label = F.coalesce("qualified_name", "name")
    edge_label = F.concat(F.col("kind"), F.lit(" "), F.col("src"), F.lit(" → "), F.col("dst"))
    a_nodes, b_nodes = (_named(g.nodes, g.node_refs, g.evidence, node_label) for g in (base, target))
    a_edges, b_edges = (_named(g.edges, g.edge_refs, g.evidence, edge_label) for g in (base, target))
    nodes = _paired(a_nodes, b_nodes, (*NODE_FIELDS, "kind"), "node")
    edges = _paired(a_edges, b_edges, EDGE_FIELDS, "edge")
    alone = nodes.where("a is null or b is null")
    pairs = _renamed(alone.where("b is null").select("id", "a.*"), alone.where("a is null").select("id", "b.*"))
    gone, none, here = F.lit("INDETERMINATE" if truncated else "EXPLICIT"), F.lit(None).cast("string"), F.col("a").isNotNull() & F.col("b").isNotNull()

    def change(when, category, label, fields=None, claim=None, unsure=False):
        parts = {"category": F.lit(category), "label": label, "fields": F.lit("") if fields is None else fields, "claim": F.lit("EXPLICIT") if claim is None else claim, "indeterminate": F.lit(unsure)}
        return F.when(when, F.struct(*(v.alias(k) for k, v in parts.items())))

    def differing(names):
        return F.concat_ws(",", *[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit({"rank": "confidence"}.get(f, f))) for f in names])

    def changed(rows, name, names=()):
        """All changes of an entity in one pass over the pairs."""
        label = F.coalesce("b.label_", "a.label_") if names else F.coalesce("b.label", "a.label")
        every = [change(F.col("b").isNull(), f"{name}_REMOVED", label, claim=gone, unsure=truncated), change(F.col("a").isNull(), f"{name}_ADDED", label)]
        if names:
            every += [
                change(here & (differing(names) != ""), f"{name}_MODIFIED", label, differing(names)),
                change(here & (F.col("a.cited") != F.col("b.cited")), "EVIDENCE_CHANGED", label, F.lit("evidence")),
                change(here & (F.col("a.rank_") != F.col("b.rank_")), "CONFIDENCE_CHANGED", label, F.lit("confidence")),
            ]
        rows = rows.select("entity", "id", F.explode(F.filter(F.array(*every), lambda c: c.isNotNull())).alias("c"))
        return rows.select("c.category", "entity", "id", none.alias("previous_id"), "c.label", "c.fields", "c.claim", "c.indeterminate")

    at = F.struct(F.concat_ws(":", "path", F.col("line").cast("string")).alias("label"))
    cited = base.evidence.select("id", at.alias("a")).join(target.evidence.select("id", at.alias("b")), "id", "full_outer").withColumn("entity", F.lit("evidence"))
    moved = pairs.select(F.lit("NODE_RENAMED").alias("category"), F.lit("node").alias("entity"), "id", F.col("previous").alias("previous_id"), F.concat("old_label", F.lit(" → "), "new_label").alias("label"), F.lit("path,qualified_name").alias("fields"), F.lit("STRONGLY_INFERRED").alias("claim"), F.lit(False).alias("indeterminate"))
    settled = pairs.select("id", F.lit("NODE_ADDED").alias("category")).unionByName(pairs.select(F.col("previous").alias("id"), F.lit("NODE_REMOVED").alias("category")))
    of_nodes = changed(nodes, "NODE", (*NODE_FIELDS, "attributes")).join(settled, ["id", "category"], "left_anti").select(moved.columns)
    return reduce(DataFrame.unionByName, [moved, of_nodes, changed(edges, "EDGE", (*EDGE_FIELDS, "attributes")), changed(cited, "EVIDENCE")])


def incomparable(base: dict, target: dict) -> str | None:
    """Why two snapshots (extractor_version, schema_version) can't be compared; None where they can."""
    for field, what in (("extractor_version", "extractor"), ("schema_version", "graph schema")):
        if base.get(field) != target.get(field):
            return f"the {what} versions differ: {base.get(field)} and {target.get(field)}"
    return None


def snapshots(base, target, base_of: dict, target_of: dict, truncated: bool = False) -> tuple[dict, DataFrame | None]:
    """(what is said before any change: comparable, reason, identical; the changes).

    There are no changes to look for, and none are computed, where the snapshots can't be compared or have one digest.
    """
    reason = incomparable(base_of, target_of)
    identical = reason is None and base_of.get("digest") is not None and base_of.get("digest") == target_of.get("digest")
    head = {"comparable": reason is None, "reason": reason, "identical": identical, "target_incomplete": truncated, "removal_confidence": "INDETERMINATE" if truncated else "EXPLICIT"}
    return head, None if reason or identical else compare(base, target, truncated)


def _renamed(went: DataFrame, came: DataFrame) -> DataFrame:
    """(id, previous, old_label, new_label) of nodes that moved: equal kind, language and a digest unique on both sides."""

    def only(rows, name):
        one = rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "kind", "language", "label_")).alias(name))
        return one.where("n = 1").select("digest", name)

    pairs = only(went, "a").join(only(came, "b"), "digest").where("a.kind = b.kind and a.language <=> b.language")
    return pairs.select("b.id", F.col("a.id").alias("previous"), F.col("a.label_").alias("old_label"), F.col("b.label_").alias("new_label"))


def counts(changes: DataFrame) -> DataFrame:
    """(category, n) for all categories, those without a change too; complete however many rows are shown."""
    every = changes.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    found = changes.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def report(changes: DataFrame, most: int = MOST) -> DataFrame:
    """The first changes by category and id."""
    return changes.orderBy("category", "id", "entity").limit(most)
