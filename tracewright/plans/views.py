"""Views of a graph: what is drawn, and a log of what isn't.

Each view takes nodes (id, kind, name, qualified_name, path, rank, attributes) and
edges (id, src, kind, dst, rank, label, attributes) and gives a ``View``: nodes
(id, label, detail, rank), edges (id, src, dst, kind, rank, label) and omissions
(reason, n, examples). An edge is drawn only if both ends are; what the gate drops
is logged. ``most`` keeps the first elements by id and logs the rest.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.identity import level
from tracewright.functions.paths import posix
from tracewright.operators import traverse
from tracewright.operators.graph import guard

MOST = 5000
# Images of data stores and brokers, in the order in which they are tried.
FAMILIES = {
    "postgres": "postgres", "mysql": "mysql", "mariadb": "mariadb", "mongodb": "mongo(db)?", "redis": "redis", "valkey": "valkey", "rabbitmq": "rabbitmq",
    "kafka": "kafka", "nats": "nats", "elasticsearch": "elastic(search)?", "minio": "minio", "memcached": "memcached",
}
TYPES = ("class", "interface", "type")
NOISE = ("commit", "contributor", "evidence")


@dataclass
class View:
    nodes: DataFrame
    edges: DataFrame
    omitted: DataFrame


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def _drawn(nodes: DataFrame, detail: Column | None = None, rank: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return nodes.select("id", F.coalesce("name", "id").alias("label"), (none if detail is None else detail).alias("detail"), (F.col("rank") if rank is None else rank).cast("int").alias("rank"))


def _lines(edges: DataFrame, label: Column | None = None) -> DataFrame:
    return edges.select("id", "src", "dst", "kind", F.col("rank").cast("int").alias("rank"), (F.col("label") if label is None else label).alias("label"))


def omission(rows: DataFrame, reason: str, shown: int = 5) -> DataFrame:
    """(reason, n, examples): how many ids, and the first of them; no row for none."""
    first = rows.select("id").distinct().orderBy("id").limit(shown).select("id", F.lit(0).cast("long").alias("n"))
    counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("id"), "n")
    both = first.unionByName(counted).agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return both.where("n > 0").select(F.lit(reason).alias("reason"), "n", "examples")


def finish(nodes: DataFrame, edges: DataFrame, omitted: list[DataFrame], most: int | None = MOST) -> View:
    """The view after the gate and the limit; no limit where ``most`` is None."""
    kept = nodes if most is None else nodes.orderBy("id").limit(most)
    inside = guard(edges, kept)
    out = [*omitted, omission(edges.join(inside.select("id"), "id", "left_anti"), "an end isn't drawn")]
    if most is None:
        return View(kept, inside, reduce(DataFrame.unionByName, out))
    drawn = inside.orderBy("id").limit(most)
    beyond = nodes.select("id").join(kept.select("id"), "id", "left_anti").unionByName(inside.select("id").join(drawn.select("id"), "id", "left_anti"))
    return View(kept, drawn, reduce(DataFrame.unionByName, [*out, omission(beyond, "beyond the limit of the view")]))


def dependencies(nodes: DataFrame, edges: DataFrame, most: int | None = MOST, longest: int = 0) -> View:
    """Modules, the packages they need, and what imports what; with ``longest`` cycles of modules up to that length are reported with the omissions, the first three as examples."""
    ends = nodes.where(F.col("kind").isin("module", "package"))
    wanted = edges.where(F.col("kind").isin("imports", "re_exports", "depends_on"))
    from_modules = wanted.join(nodes.where("kind = 'module'").select(F.col("id").alias("src")), "src", "left_semi")
    used = from_modules.select(F.col("src").alias("id")).unionByName(from_modules.select(F.col("dst").alias("id"))).distinct()
    alone = ends.where("kind = 'module'").join(used, "id", "left_anti")
    view = finish(_drawn(ends.where("kind = 'module'").unionByName(ends.where("kind = 'package'").join(used, "id", "left_semi"))), _lines(from_modules), [omission(alone, "modules without a dependency in either direction")], most)
    if not longest:
        return view
    found, _ = traverse.cycles(from_modules.where("kind <> 'depends_on'").join(nodes.where("kind = 'module'").select(F.col("id").alias("dst")), "dst", "left_semi"), longest=longest)
    first = F.slice(F.array_sort(F.collect_list(F.struct("length", "key"))), 1, 3)  # there are twenty at most
    counted = found.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(first, lambda c: F.replace(c["key"], F.lit(">"), F.lit(" → "))), ",").alias("examples")).where("n > 0")
    return View(view.nodes, view.edges, view.omitted.unionByName(counted.select(F.lit("modules that import each other in a circle").alias("reason"), "n", "examples")))


def modules(nodes: DataFrame, edges: DataFrame, most: int | None = MOST) -> View:
    """Modules and what they hold."""
    wanted = edges.where(F.col("kind").isin("contains", "declared_in")).join(nodes.where("kind = 'module'").select(F.col("id").alias("src")), "src", "left_semi")
    drawn = nodes.where(~F.col("kind").isin(*NOISE))
    held = wanted.select(F.col("dst").alias("id")).distinct()
    drawn = drawn.where("kind = 'module'").unionByName(drawn.where("kind <> 'module'").join(held, "id", "left_semi"))
    return finish(_drawn(drawn, F.col("kind")), _lines(wanted), [], most)


def owners(members: DataFrame, types: DataFrame) -> DataFrame:
    """(id, owner): the type whose qualified name is the longest dotted prefix of the member's."""
    parts = F.split("qualified_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("prefix"), k.alias("taken")))
    each = members.where(F.col("qualified_name").contains(".")).select("id", F.explode(prefixes).alias("p")).select("id", "p.*")
    first = types.where("qualified_name is not null").groupBy(F.col("qualified_name").alias("prefix")).agg(F.min("id").alias("owner"))
    return each.join(first, "prefix").groupBy("id").agg(F.max_by("owner", "taken").alias("owner"))


def classes(nodes: DataFrame, edges: DataFrame, most: int | None = MOST) -> View:
    """Types with their members, and what they extend and implement inside the repository."""
    types = nodes.where(F.col("kind").isin(*TYPES))
    members = nodes.where(F.col("kind").isin("function", "constant"))
    named = owners(members, types).join(members.select("id", "name", attribute("signature").alias("signature")), "id")
    listed = named.groupBy(F.col("owner").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.coalesce("signature", F.lit("()"))))), "\n+ ").alias("members"))
    detail = F.concat_ws("\n", F.col("path"), F.concat(F.lit("+ "), F.col("members")))
    heritage = edges.where(F.col("kind").isin("extends", "implements"))
    related = heritage.select(F.col("src").alias("id")).unionByName(heritage.select(F.col("dst").alias("id"))).distinct()
    alone = omission(types.join(related, "id", "left_anti"), "types that neither extend nor implement another one here", 3)
    return finish(_drawn(types.join(listed, "id", "left"), detail), _lines(heritage), [alone], most)


def tables(nodes: DataFrame, edges: DataFrame, most: int | None = MOST) -> View:
    """Tables with their columns, and the foreign keys between them."""
    stores = nodes.where("kind = 'table'")
    line = F.concat_ws(": ", "name", F.concat_ws(" ", attribute("dataType"), F.when(attribute("primaryKey") == "true", "pk"), F.when(attribute("notNull") == "true", "not null"), F.when(attribute("unique") == "true", "unique")))
    columns = edges.where("kind = 'contains'").select(F.col("src").alias("id"), F.col("dst").alias("column")).join(nodes.where("kind = 'column'").select(F.col("id").alias("column"), line.alias("line")), "column")
    listed = columns.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    drawn = stores.join(listed, "id", "left")
    keys = guard(edges, stores)
    label = F.when(F.col("kind") == "references", F.trim(F.concat(F.lit("references "), F.coalesce(attribute("column"), F.lit(""))))).otherwise(F.col("label"))
    omitted = [
        omission(stores.where(attribute("declaredInDdl") == "false"), "tables that statements use and no schema here declares; what columns they have is not known", 3),
        omission(drawn.where("lines is null"), "tables whose columns were not read", 3),
    ]
    return finish(_drawn(drawn, F.coalesce("lines", F.lit("(no columns detected)"))), _lines(keys, label), omitted, most)


def family(image: Column) -> Column:
    """The known family of a data store's or broker's image; null is unknown."""
    return F.coalesce(*(F.when(image.rlike(rf"(?i)(^|[/:-]){shape}([:/@.-]|$)"), name) for name, shape in FAMILIES.items()))


def runs(nodes: DataFrame) -> DataFrame:
    """Components that run: declared ones other than base images."""
    return nodes.where("kind = 'deployment_component'").where(~attribute("declaredAs").eqNullSafe("base_image"))


def _base_images(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'deployment_component'").where(attribute("declaredAs") == "base_image")


def _edge_rows(rows: DataFrame, level_: str, src: Column, dst: Column, kind: str, rank: Column, label: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.concat(F.lit(f"c4:{level_}:"), src, F.lit("->"), dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), (none if label is None else label).alias("label"))


def _system(nodes: DataFrame) -> Column:
    """The id of the repository: one value."""
    row = nodes.where("kind = 'repository'").agg(F.min("id")).first()
    return F.lit(row[0]).cast("string")


def context(nodes: DataFrame, edges: DataFrame, most: int | None = MOST) -> View:
    """The system and the stores and brokers that its declared services are known to be."""
    system = nodes.where("kind = 'repository'")
    named = runs(nodes).withColumn("family", family(F.coalesce(attribute("image"), attribute("name"))))
    outside = named.where("family is not null")
    lines = _edge_rows(outside, "context", _system(nodes), F.col("id"), "communicates_with", F.lit(1))
    drawn = _drawn(system, F.lit("software_system")).unionByName(_drawn(outside, F.coalesce(attribute("image"), F.col("family")), F.lit(1)))
    omitted = [omission(named.where("family is null"), "services whose image is of no known store or broker", 3), omission(_base_images(nodes), "images that others are only built from", 3)]
    return finish(drawn, lines, omitted, most)


def coupled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, n, rank): containers whose code imports or calls that of another, with the number of edges that say so and the weakest."""
    where = traverse.attribution(edges, nodes)
    rows = edges.where(F.col("kind").isin("imports", "calls"))
    rows = rows.join(where.select(F.col("module").alias("src"), F.col("container").alias("a")), "src").join(where.select(F.col("module").alias("dst"), F.col("container").alias("b")), "dst")
    return rows.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))


def containers(nodes: DataFrame, edges: DataFrame, most: int | None = MOST) -> View:
    """Units that run, the system that owns them, and what couples them."""
    system, units = nodes.where("kind = 'repository'"), runs(nodes)
    owns = _edge_rows(units, "container", _system(nodes), F.col("id"), "contains", F.lit(3))
    across = coupled(nodes, edges)
    lines = owns.unionByName(_edge_rows(across, "container", F.col("src"), F.col("dst"), "depends_on", F.col("rank"), F.concat(F.col("n").cast("string"), F.lit(" code references"))))
    told = edges.where("kind = 'communicates_with'").join(units.select(F.col("id").alias("src")), "src", "left_semi")
    lines = lines.unionByName(_edge_rows(told.join(lines.select("src", "dst"), ["src", "dst"], "left_anti"), "container", F.col("src"), F.col("dst"), "communicates_with", F.col("rank")))
    bare = units.join(traverse.attribution(edges, nodes).select(F.col("container").alias("id")).distinct(), "id", "left_anti")
    omitted = [omission(bare, "containers without code attributed to them", 3), omission(_base_images(nodes), "only built from, not run", 3)]
    drawn = _drawn(system, F.lit("software_system")).unionByName(_drawn(units, F.coalesce(attribute("image"), attribute("build"))))
    return finish(drawn, lines, omitted, most)


def components(nodes: DataFrame, edges: DataFrame, most: int | None = MOST) -> View:
    """Modules attributed to a container, and their imports and calls."""
    where = traverse.attribution(edges, nodes)
    inside = nodes.where("kind = 'module'").join(where.withColumnRenamed("module", "id"), "id")
    lines = _lines(edges.where(F.col("kind").isin("imports", "calls")))
    apart = nodes.where("kind = 'module'").join(inside.select("id"), "id", "left_anti")
    return finish(_drawn(inside, F.col("container")), lines.join(inside.select(F.col("id").alias("src")), "src", "left_semi").select(*lines.columns), [omission(apart, "modules that no container is known to run", 3)], most)


def deployment(nodes: DataFrame, edges: DataFrame, most: int | None = MOST) -> View:
    """Components and networks; secrets are counted, not drawn."""
    drawn = nodes.where(F.col("kind").isin("deployment_component", "network"))
    lines = edges.where((F.col("kind") == "joins_network") | ((F.col("kind") == "depends_on") & (attribute("scope") == "deployment")))
    secrets = edges.where("kind = 'references_secret'").select(F.col("dst").alias("id")).distinct()
    return finish(_drawn(drawn, F.coalesce(attribute("image"), attribute("build"))), _lines(lines), [omission(secrets, "secrets are counted, never drawn", 3)], most)


def data_flow(nodes: DataFrame, edges: DataFrame, most: int = 200) -> View:
    """The first flows of data by id, and how many more there are."""
    flows = guard(edges.where(F.col("kind").isin(*traverse.DATA_KINDS)), nodes)
    shown = flows.orderBy("id").limit(most)
    rest = flows.join(shown.select("id"), "id", "left_anti")
    ends = shown.select(F.col("src").alias("id")).unionByName(shown.select(F.col("dst").alias("id"))).distinct()
    return View(_drawn(nodes.join(ends, "id", "left_semi"), F.col("kind")), _lines(shown), omission(rest, f"more than {most} data flows", 3))


def activity(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> View:
    """The conditions of each function in the order of their lines, each linked to the next."""
    flows = edges.where(F.col("kind").isin("branches", "loops")).select(F.col("src").alias("unit"), F.col("dst").alias("id"), F.col("kind").alias("flow"))
    units = flows.select("unit").distinct().orderBy("unit").limit(most)
    conditions = nodes.where("kind = 'condition'").join(flows, "id").join(units, "unit", "left_semi")
    order = Window.partitionBy("unit").orderBy("start_line", "id")
    chained = conditions.select("id", "unit", "rank", F.lag("id", 1).over(order).alias("before"), "flow", "name")
    entry = F.coalesce("before", "unit")
    none = F.lit(None).cast("string")
    lines = chained.select(F.concat(F.lit("act:"), entry, F.lit("->"), F.col("id")).alias("id"), entry.alias("src"), F.col("id").alias("dst"), F.lit("activity").alias("kind"), F.col("rank").cast("int").alias("rank"), none.alias("label"))
    drawn = _drawn(nodes.join(units.withColumnRenamed("unit", "id"), "id", "left_semi"), F.col("kind")).unionByName(_drawn(conditions, F.col("flow")))
    over = flows.join(units, "unit", "left_anti").select(F.col("unit").alias("id")).distinct()
    return View(drawn.distinct(), lines, omission(over, f"more than {most} units with control flow", 3))


def sequences(nodes: DataFrame, edges: DataFrame, most: int = 40) -> View:
    """What each of the first entry points leads to, message by message."""
    entries = nodes.where((F.col("kind") == "api_endpoint") | ((F.col("kind") == "configuration") & attribute("marker").startswith("async.")))
    shown = entries.orderBy("id").limit(most)
    sent = traverse.sequence(nodes, edges, shown.select(F.col("id").alias("entry")))
    ranks = edges.select("id", "rank", "label")
    lines = sent.join(ranks, "id").select(F.concat(F.lit("seq:"), "entry", F.lit(":"), F.col("place").cast("string"), F.lit(":"), "src", F.lit("->"), "dst").alias("id"), "src", "dst", "kind", F.col("rank").cast("int").alias("rank"), "label")
    ends = lines.select(F.col("src").alias("id")).unionByName(lines.select(F.col("dst").alias("id"))).distinct()
    silent = shown.join(sent.select(F.col("entry").alias("id")).distinct(), "id", "left_anti")
    omitted = omission(entries.join(shown.select("id"), "id", "left_anti"), f"more than {most} entry points", 3).unionByName(omission(silent, "entry points that call nothing known", 3))
    return View(_drawn(nodes.join(ends, "id", "left_semi"), F.col("kind")), lines, omitted)


def pinned(image: Column) -> Column:
    """Whether an image names a digest or a tag other than latest."""
    tag = F.when(image.contains(":"), F.substring_index(image, ":", -1)).otherwise(F.lit(""))
    return image.contains("@sha256:") | ((tag != "") & (tag != "latest"))


def security(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Secrets (name, n_references, covered), base images (name, pinned), workflows (path, n_jobs, n_steps, n_deploying): what is there, without a verdict."""
    names = nodes.select("id", "name", "path")
    uses = edges.where("kind = 'references_secret'").select("src", F.col("dst").alias("id")).join(names.select("id", "name"), "id", "left")
    uses = uses.withColumn("name", F.coalesce("name", F.expr("substring(id, 8)"))).groupBy("name").agg(F.count(F.lit(1)).alias("n_references"))
    # a name that stands anywhere in a test's text meets it by its first three letters
    text = nodes.where("kind = 'test'").select(F.concat_ws("\n", "name", "qualified_name").alias("text")).distinct()
    starts = text.select("text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))).alias("at"))
    met = starts.select("text", F.explode(F.array_distinct(F.array(*(F.substring("text", F.col("at"), F.lit(k)) for k in (1, 2, 3))))).alias("head")).distinct()
    covered = met.join(uses.select("name", F.substring("name", 1, 3).alias("head")), "head").where(F.col("text").contains(F.col("name"))).select("name").distinct()
    secrets = uses.join(covered.withColumn("covered", F.lit(True)), "name", "left").select("name", "n_references", F.coalesce("covered", F.lit(False)).alias("covered"))
    images = _base_images(nodes).select("name", pinned(F.col("name")).alias("pinned"))
    flows = nodes.where(F.col("path").startswith(".github/workflows/")).groupBy("path")
    marker = attribute("marker")
    workflows = flows.agg(F.count_if(marker == "workflow.job").alias("n_jobs"), F.count_if(marker == "workflow.step").alias("n_steps"), F.count_if((marker == "workflow.step") & (attribute("namesDeployment") == "true")).alias("n_deploying"))
    return {"secrets": secrets, "images": images, "workflows": workflows}


def mermaid_id(id_: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(id_, "[^A-Za-z0-9_]", "_"))


def mermaid_label(label: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(label, '"', "'"), "[\r\n]+", " "), 1, 80)


def mermaid(view: View, kind: str = "flowchart") -> DataFrame:
    """(place, line): the view as Mermaid text, a row a line; what isn't explicit has a dotted arrow."""
    head = "classDiagram" if kind == "class-diagram" else "flowchart LR"
    sizes = view.edges.agg(F.count(F.lit(1)).alias("e")).join(view.nodes.agg(F.count(F.lit(1)).alias("n")))
    first = sizes.select(F.lit(0).alias("part"), F.lit("").alias("id"), F.concat(F.lit(f"{head} "), F.when(F.col("e") > F.col("n"), "LR").otherwise("TD")).alias("line"))
    nodes = view.nodes.select(F.lit(1).alias("part"), "id", F.concat(F.lit("  "), mermaid_id(F.col("id")), F.lit('["'), mermaid_label(F.col("label")), F.lit('"]')).alias("line"))
    a, b = mermaid_id(F.col("src")), mermaid_id(F.col("dst"))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit("|"), mermaid_label(F.col("label")), F.lit("|"))).otherwise(F.lit(""))
    plain = F.concat(F.lit("  "), a, F.lit(" -->"), label, F.lit(" "), b)
    dotted = F.concat(F.lit("  "), a, F.lit(' -. "'), level(F.col("rank")), F.lit('" .-> '), b)
    edges = view.edges.select(F.lit(2).alias("part"), "id", F.when(F.col("rank") == 3, plain).otherwise(dotted).alias("line"))
    return first.unionByName(nodes).unionByName(edges).orderBy("part", "id").select("part", "id", "line")


def evidence_at(evidence: DataFrame, path: str) -> DataFrame:
    """The evidence of a path, however its slashes lean."""
    return evidence.where(posix(F.col("path")) == posix(F.lit(path))).orderBy("path", "line", "id")


#: kind -> (title, the view, the kinds of edges that it needs); what projects a graph goes by this list.
REGISTERED = {
    "dependency-graph": ("Dependencies", dependencies, ("imports", "re_exports", "depends_on")), "module-graph": ("Modules", modules, ("contains", "declared_in")), "class-diagram": ("Classes", classes, ("extends", "implements")),
    "er-diagram": ("Tables", tables, ("references",)), "c4-context": ("Context", context, ()), "c4-container": ("Containers", containers, ()), "c4-component": ("Components", components, ()), "sequence": ("Sequences", sequences, ("calls",)),
    "activity": ("Activity", activity, ("branches", "loops")), "data-flow": ("Data flow", data_flow, ("reads", "writes")), "deployment": ("Deployment", deployment, ("depends_on", "joins_network")),
}


def supported(edges: DataFrame) -> DataFrame:
    """(kind, title, n_edges, sufficient): for each registered view how many edges of its kinds the graph has, and whether that is enough to draw any."""
    counts = {r["kind"]: r["n"] for r in edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each kind of edge
    rows = [(kind, title, n := sum(counts.get(k, 0) for k in kinds), not kinds or n > 0) for kind, (title, _, kinds) in REGISTERED.items()]
    return edges.sparkSession.createDataFrame(rows, "kind string, title string, n_edges long, sufficient boolean")


def project(kind: str, nodes: DataFrame, edges: DataFrame) -> View:
    """The registered view of this kind."""
    if kind not in REGISTERED:
        raise ValueError(f"no view {kind!r} is registered: {', '.join(REGISTERED)}")
    return REGISTERED[kind][1](nodes, edges)
