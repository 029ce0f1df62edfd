"""Deployment facts: components, what they need, publish, join, mount and are told, and how they meet the code.

Markers of compose files, Dockerfiles and workflows become nodes and edges by one table of shapes
(``SHAPES``); what has no shape becomes a configuration node of its file and line. Four rules
then link services with code: by build context, by the command that they start, by port, and
by health check. What can't be linked is a row of ``unresolved`` with a reason.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.identity import slug
from tracewright.functions.paths import ancestors, folder, normalised
from tracewright.plans.shapes import EXPLICIT, STRONG, WEAK, attributes, edges_of, first_non_null, merged_values, module_id, nodes_of
from tracewright.storage import stored_table

# Markers that other rules read, those that can be secrets, and those whose evidence is of the infrastructure.
HANDLED = ("http.route", "schema.table", "schema.column", "schema.foreign_key", "sql.query", "sql.cte", "sql.statement", "control.branch", "control.loop", "control.handler", "manifest.dependency", "doc.requirement", "test.suite", "test.case")
COMPONENTS = ("compose.service", "docker.base_image")
VARIABLES = ("compose.environment", "docker.env", "workflow.secret")
INFRASTRUCTURE = ("compose.command", "compose.healthcheck", "compose.restart_policy", "docker.expose", "docker.workdir", "docker.user", "docker.entrypoint", "docker.cmd", "docker.volume", "docker.healthcheck", "docker.copy", "docker.run", "docker.build_stage", "workflow.step")
SECRET_NAME = r"(?i)(?:^|_)(?:SECRET|TOKEN|PASSWORD|PASSWD|APIKEY|API_KEY|PRIVATE_KEY|CREDENTIAL|CREDENTIALS|ACCESS_KEY|CLIENT_SECRET|AUTH_KEY)(?:$|_)"


def component(name: Column) -> Column:
    return F.concat(F.lit("deployment_component:"), slug(name))


def of_kind(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), slug(name))


def without_nulls(given: Column) -> Column:
    return F.map_filter(given, lambda _, v: v.isNotNull())


def merged_maps(first: Column, then: Column) -> Column:
    """Both maps; of a key in both the first one's value."""
    return F.map_concat(first, F.map_filter(then, lambda k, _: ~F.array_contains(F.map_keys(first), k)))


def is_secret(variable: Column) -> Column:
    return variable.rlike(SECRET_NAME)


#: marker -> the attributes that it needs, the node that it states, the edge and its ends, and both ones' attributes.
#: ``a`` is the marker's attributes; ends are (kind of node, name).
SHAPES = {
    "compose.depends_on": {"needs": ("service", "dependsOn"), "edge": ("depends_on", ("deployment_component", lambda a: a["dependsOn"])), "linked": lambda a: {"declared": F.lit(True), "scope": F.lit("deployment")}},
    "compose.network": {"needs": ("service", "network"), "node": ("network", lambda a: a["network"], lambda a: a["network"], lambda a: {}), "edge": ("joins_network", ("network", lambda a: a["network"])), "linked": lambda a: {}},
    "compose.network_declared": {"needs": ("network",), "node": ("network", lambda a: a["network"], lambda a: a["network"], lambda a: {"referencedByService": F.lit(False)})},
    "compose.volume_declared": {"needs": ("volume",), "node": ("volume", lambda a: a["volume"], lambda a: a["volume"], lambda a: {"declared": F.lit(True)})},
    "compose.volume_mount": {
        "needs": ("service", "volume"), "node": ("volume", lambda a: a["volume"], lambda a: a["volume"], lambda a: {"declared": F.lit(False)}), "edge": ("contains", ("volume", lambda a: a["volume"])),
        "linked": lambda a: {"scope": F.lit("volume_mount"), "target": a["target"], "readOnly": F.when(a["readOnly"] == "true", True), "source": a["source"]},
    },
    "compose.port_publish": {
        "needs": ("service", "containerPort"), "node": ("port", lambda a: F.concat(a["service"], F.lit(":"), a["containerPort"]), lambda a: a["containerPort"], lambda a: {**_published(a), "protocol": a["protocol"]}),
        "edge": ("exposes", ("port", lambda a: F.concat(a["service"], F.lit(":"), a["containerPort"]))), "linked": lambda a: {"scope": F.lit("deployment"), **_published(a)},
    },
    "compose.service_address": {"needs": ("service", "target"), "edge": ("communicates_with", ("deployment_component", lambda a: a["target"])), "linked": lambda a: {"via": F.lit("configured_address"), "variable": a["variable"], "port": F.nullif(a["port"], F.lit(""))}},
}


def _published(a: Column) -> dict[str, Column]:
    return {"containerPort": a["containerPort"], "hostPort": a["hostPort"], "hostIp": a["hostIp"], "allInterfaces": a["hostIp"].isNull(), "observed": F.lit(False)}


def context_folder(path: Column, context: Column) -> Column:
    """The folder that a build context means, the root as empty; null for none, an absolute one, or one that climbs."""
    said = F.trim(context)
    whole = F.concat_ws("/", F.nullif(folder(path), F.lit("")), said)
    return F.when((said != "") & ~said.startswith("/") & ~said.rlike(r"^[A-Za-z]+:") & ~F.array_contains(F.split(said, "/"), ".."), normalised(whole))


def _above(modules: DataFrame) -> DataFrame:
    """(module, path, folder): each module (module, path) with the folders above its path and with the path."""
    return modules.select("module", "path", F.explode(F.array_distinct(F.concat(ancestors(F.col("path")), F.array("path")))).alias("folder"))


def leaves(modules: DataFrame) -> DataFrame:
    """The modules whose path isn't a folder of another one's."""
    folders = modules.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return modules.join(folders, "path", "left_anti")


def built(services: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services (service, folder) to the innermost modules in their build context, all services whose context holds one.

    (links: service, module; unresolved: subject, reason). Pairs are many where many contexts are wide, so they are
    made distinct only for services with several folders; which services stay open is asked by folder, without pairs.
    """
    services = services.distinct()
    asked = services.where("folder is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("service")))
    # folders that no service asks for go before anything is made distinct
    inside = _above(modules.join(leaves(modules).select("module"), "module", "left_semi")).select("module", "folder")
    above = inside.join(services.select("folder"), "folder", "left_semi").distinct()
    once = above.join(asked.where("n = 1"), "folder").select("service", "module")
    often = above.join(asked.where("n > 1"), "folder").select("service", "module").distinct()
    held = services.join(_above(modules).select("folder").distinct(), "folder", "left_semi").select("service").distinct()
    lost = services.join(held, "service", "left_anti")
    reason = F.when(F.col("folder").isNull(), "no build context in the repository is declared, so no code is placed in this service").otherwise(F.concat(F.lit("the build context "), F.when(F.col("folder") == "", F.lit(".")).otherwise(F.col("folder")), F.lit(" holds no file of this analysis")))
    return once.unionByName(often), lost.select(F.col("service").alias("subject"), reason.alias("reason"))


def command_words(command: Column) -> Column:
    """The words of a command that may be paths of files, with their places; its first word is the program."""
    bare = F.regexp_replace(F.regexp_replace(command, r"^\[|\]$", ""), "[\"']", "")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: w != "")
    later = F.when(F.size(words) > 1, F.slice(words, 2, 1 << 30)).otherwise(F.array().cast("array<string>"))
    return F.filter(later, lambda w: ~w.startswith("-") & w.rlike(r"^[./\w@-]+\.\w+$"))


def started(services: DataFrame, commands: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services (service, folder) with commands (service, command, workdir) to the module file that the command names.

    Words are tried in order, each from the working folder, the build context and the root, as it stands and without its
    ending; the first that is the path of a module (module, path) counts. (links: service, module, command; unresolved: subject, reason).
    """
    rows = services.join(commands.where("command <> ''"), "service", "left")
    base = F.coalesce("folder", F.lit(""))
    workdir = F.when(F.col("workdir").isNotNull(), normalised(F.concat_ws("/", base, F.regexp_replace("workdir", r"^/+", ""))))
    roots = F.array_distinct(F.filter(F.array(workdir, base, F.lit("")), lambda r: r.isNotNull()))

    def spellings(word, root):
        whole = F.when(word.startswith("/"), F.substring(word, 2, 1 << 30)).otherwise(F.concat_ws("/", F.nullif(root, F.lit("")), word))
        plain = F.when(~F.array_contains(F.split(whole, "/"), ".."), normalised(whole))
        return F.array(plain, F.regexp_replace(plain, r"\.[cm]?[jt]sx?$", ""), F.regexp_replace(plain, r"\.py$", ""))

    tried = F.flatten(F.transform(command_words(F.col("command")), lambda w: F.flatten(F.transform(roots, lambda r: spellings(w, r)))))
    asked = rows.where("command is not null").select("service", "command", F.posexplode(tried).alias("place", "path")).where("path is not null and path <> ''")
    links = asked.join(modules, "path").groupBy("service").agg(F.min_by(F.struct("module", "command"), "place").alias("hit")).select("service", "hit.*")
    lost = rows.join(links.select("service"), "service", "left_anti")
    reason = F.when(F.col("command").isNull(), "neither the service nor its Dockerfile declares a command").otherwise(F.concat(F.lit("the command "), F.substring("command", 1, 60), F.lit(" names no file of this analysis")))
    return links, lost.select(F.col("service").alias("subject"), reason.alias("reason"))


def listening(ports: DataFrame, listeners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ports (port, number) and listeners (module, number): (links: module, port; unresolved: subject, reason), by equal numbers."""
    links = listeners.join(ports, "number").select("module", "port").distinct()
    lost = ports.join(listeners.select("number").distinct(), "number", "left_anti")
    return links, lost.select(F.col("port").alias("subject"), F.concat(F.lit("no listener on "), F.col("number").cast("string"), F.lit(" was seen in this analysis")).alias("reason"))


def checked(health: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Health checks (service, path) and endpoints (endpoint, route): (links: service, endpoint; unresolved: subject, reason), by equal paths."""
    links = health.join(endpoints, health["path"] == endpoints["route"]).groupBy("service", "path").agg(F.min("endpoint").alias("endpoint")).select("service", "endpoint")
    lost = health.join(endpoints.select(F.col("route").alias("path")).distinct(), "path", "left_anti")
    reason = F.when(F.coalesce("path", F.lit("")) == "", "the health check names no path").otherwise(F.concat(F.lit("no route of this analysis has the path "), F.col("path")))
    return links, lost.select(F.col("service").alias("subject"), reason.alias("reason"))


class Deployment:
    """The builder's rules for deployment. Needs ``facts``, ``cited`` and ``marked``."""

    def _components(self) -> DataFrame:
        if "components" in self.known:
            return self.known["components"]
        a = F.col("attributes")
        rows = self.marked(*COMPONENTS).withColumn("component", F.coalesce(a["service"], a["image"], F.lit("unknown")))
        self.known["components"] = self.cited(rows, "INFRASTRUCTURE_FILE")
        return self.known["components"]

    def components(self):
        """Services and base images; what a service's build context holds is deployed by it."""
        rows, a = self._components(), F.col("attributes")
        role = F.when(F.col("name") == "compose.service", "service").otherwise("base_image")
        name = F.col("component")
        nodes = nodes_of(rows, "deployment_component", name, qualified_name=name, path=F.col("path"), start_line=F.col("line"), attributes=merged_maps(attributes(declaredAs=role), without_nulls(a)))
        declared = edges_of(rows, module_id(F.col("path")), "deploys", component(name))
        services = rows.where("name = 'compose.service'").withColumn("folder", normalised(F.concat_ws("/", F.nullif(folder(F.col("path")), F.lit("")), F.when((F.trim(a["build"]) != "") & ~a["build"].startswith("/") & ~a["build"].rlike(r"(?i)^[a-z]+:"), F.trim(a["build"])))))
        services = services.where(F.trim(a["build"]) != "").select("evidence", "seq", F.col("path").alias("declared_in"), component(name).alias("service"), "folder").where("folder is not null")
        inside = _above(self._modules()).join(services, "folder").where("path <> declared_in")
        given = attributes(derivedFrom="compose.build_context", buildContext=F.col("folder"), caveat="a build context is what the builder is sent, not what the image holds")
        return nodes, declared.unionByName(edges_of(inside, F.col("module"), "deploys", F.col("service"), STRONG, attributes=given))

    def deployed(self):
        """The nodes and edges that ``SHAPES`` gives the other compose markers; of nodes that several state the first alone counts."""
        a, marker = F.col("attributes"), F.col("name")
        known = self._components().select(component(F.col("component")).alias("from")).distinct()
        # one scan for all shapes: what a marker states is chosen by its name
        complete = reduce(Column.__or__, [(marker == m) & reduce(Column.__and__, [F.coalesce(a[need], F.lit("")) != "" for need in shape["needs"]]) for m, shape in SHAPES.items()])
        rows = self.cited(self.marked(*SHAPES).where(complete), "INFRASTRUCTURE_FILE")
        free = [m for m, shape in SHAPES.items() if m == "compose.network" or "service" not in shape["needs"]]
        owned = rows.withColumn("from", component(a["service"])).where(~marker.isin(*free)).join(known, "from", "left_semi")
        rows = owned.unionByName(rows.where(marker.isin(*free)).withColumn("from", component(a["service"])))
        where = {"declaredIn": F.col("path")}

        def chosen(part: str, of) -> Column:
            """What ``of`` makes of the shape's ``part``, by the marker's name."""
            return F.coalesce(*[F.when(marker == m, of(shape[part], shape)) for m, shape in SHAPES.items() if part in shape])

        def having(part: str) -> DataFrame:
            return rows.where(marker.isin(*[m for m, shape in SHAPES.items() if part in shape]))

        node = having("node").withColumn("kind", chosen("node", lambda n, _: F.lit(n[0]))).withColumn("key", chosen("node", lambda n, _: n[1](a))).withColumn("called", chosen("node", lambda n, _: n[2](a))).withColumn("given", chosen("node", lambda n, _: attributes(**where, **n[3](a))))
        stated = nodes_of(node, F.col("kind"), F.col("called"), key=F.col("key"), qualified_name=F.col("key"), path=F.col("path"), start_line=F.col("line"), attributes=F.col("given"))
        edge = having("edge").withColumn("kind", chosen("edge", lambda e, _: F.lit(e[0]))).withColumn("to", chosen("edge", lambda e, _: of_kind(e[1][0], e[1][1](a)))).withColumn("given", chosen("edge", lambda _, shape: attributes(**where, **shape["linked"](a))))
        edges = edges_of(edge, F.col("from"), F.col("kind"), F.col("to"), attributes=F.col("given"))
        first = stated.groupBy("id").agg(F.min_by(F.struct(*[c for c in stated.columns if c != "id"]), "seq").alias("n")).select("id", "n.*").select(stated.columns)
        return first, edges

    def _variables(self) -> DataFrame:
        a = F.col("attributes")
        rows = self.cited(self.marked(*VARIABLES).where(F.coalesce(a["variable"], F.lit("")) != ""), "INFRASTRUCTURE_FILE")
        rows = rows.withColumn("from", F.when(a["service"].isNotNull(), component(a["service"])).otherwise(module_id(F.col("path"))))
        known = self._components().select(component(F.col("component")).alias("from")).distinct().withColumn("there", F.lit(True))
        rows = rows.join(known, "from", "left").where(a["service"].isNull() | F.col("there")).drop("there")
        return rows.withColumn("secret", F.coalesce((a["secretLike"] == "true"), F.lit(False)) | is_secret(a["variable"]))

    def secrets(self):
        """Variables that are named like credentials: a node with the name alone, and who refers to it."""
        rows = self._variables().where("secret").withColumn("variable", F.col("attributes")["variable"])
        given = attributes(referenceOnly=True, declaredIn=F.col("path"))
        nodes = nodes_of(rows, "secret", F.col("variable"), qualified_name=F.col("variable"), path=F.col("path"), start_line=F.col("line"), attributes=given)
        first = nodes.groupBy("id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "id"]), "seq").alias("n")).select("id", "n.*").select(nodes.columns)
        return first, edges_of(rows, F.col("from"), "references_secret", of_kind("secret", F.col("variable")), attributes=given)

    def configuration(self):
        """A node for each file and line that states anything else, other variables included."""
        a = F.col("attributes")
        plain = self._variables().where("not secret").drop("secret", "from")
        stated = self.cited(self.marked(*INFRASTRUCTURE), "INFRASTRUCTURE_FILE")
        other = self.facts["markers"].where(~F.col("name").isin(*HANDLED, *COMPONENTS, *VARIABLES, *INFRASTRUCTURE, *SHAPES))
        rows = plain.unionByName(stated).unionByName(self.cited(other, "CONFIG_KEY"))
        key = F.concat(F.col("path"), F.lit("#"), F.col("line").cast("string"))
        nodes = nodes_of(rows, "configuration", F.coalesce(a["key"], F.col("name")), key=key, qualified_name=key, path=F.col("path"), start_line=F.col("line"), attributes=merged_maps(attributes(marker=F.col("name")), without_nulls(a)))
        return nodes, edges_of(rows, module_id(F.col("path")), "configures", of_kind("configuration", key))

    # -- deployment and code

    def _modules(self) -> DataFrame:
        return self.facts["files"].where("analyzable").select(module_id(F.col("path")).alias("module"), "path").distinct()

    def services(self) -> DataFrame:
        """(service, name, path, seq, evidence, folder, build_file): the services as merged, stored as all four rules read them."""
        if "services" in self.known:
            return self.known["services"]
        rows, a = self._components(), F.col("attributes")
        role = F.when(F.col("name") == "compose.service", "service").otherwise("base_image")
        seen = nodes_of(rows, "deployment_component", F.col("component"), path=F.col("path"), attributes=merged_maps(attributes(declaredAs=role), without_nulls(a)))
        by = F.col("seq")
        merged = merged_values(seen, "declaredAs", "build", "buildFile", name=first_non_null("name", by), path=first_non_null("path", by), seq=F.min("seq"), evidence=F.min_by("evidence", "seq")).where("declaredAs = 'service'")
        found = merged.select(F.col("id").alias("service"), "name", "path", "seq", "evidence", context_folder(F.col("path"), F.col("build")).alias("folder"), F.col("buildFile").alias("build_file"))
        self.known["services"] = stored_table(found, "services")
        return self.known["services"]

    def commands(self, services: DataFrame) -> DataFrame:
        """(service, command, workdir): a compose command, or else that of the Dockerfile which the service is built from."""
        a = F.col("attributes")
        own = self.marked("compose.command").where((a["service"] != "") & (a["value"] != "")).groupBy(component(a["service"]).alias("service")).agg(F.max_by(a["value"], "seq").alias("own"))
        last = lambda name, value: F.max_by(value, F.when(F.col("name") == name, F.col("seq")))
        docker = self.marked("docker.cmd", "docker.entrypoint", "docker.workdir").where(F.substring_index("path", "/", -1).rlike(r"^Dockerfile(\.|$)"))
        docker = docker.groupBy(F.col("path").alias("dockerfile")).agg(F.coalesce(last("docker.cmd", a["value"]), last("docker.entrypoint", a["value"])).alias("cmd"), last("docker.workdir", a["path"]).alias("workdir"))
        file = F.coalesce(F.nullif("build_file", F.lit("")), F.lit("Dockerfile"))
        whole = F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), file)
        place = F.when(F.col("folder").isNotNull() & ~file.startswith("/") & ~F.array_contains(F.split(file, "/"), ".."), normalised(whole))
        rows = services.select("service", place.alias("dockerfile")).join(own, "service", "left").join(docker, "dockerfile", "left")
        return rows.select("service", F.coalesce("own", "cmd").alias("command"), F.when(F.col("own").isNull(), F.col("workdir")).alias("workdir")).where("command is not null")

    def _reconciled(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Links and what stays open, by rule."""
        a, services, modules = F.col("attributes"), self.services(), self._modules()
        links, lost = built(services, modules)
        stated = self._components().select(module_id(F.col("path")).alias("module"), component(F.col("component")).alias("service")).distinct()
        links = links.join(stated, ["module", "service"], "left_anti")  # the file that declares a service deploys it explicitly
        published = self.marked("compose.port_publish").where((a["service"] != "") & (a["containerPort"] != ""))
        ports = published.select(of_kind("port", F.concat(a["service"], F.lit(":"), a["containerPort"])).alias("port"), component(a["service"]).alias("service"), a["containerPort"].alias("number")).distinct()
        ports = ports.join(services.select("service"), "service", "left_semi").drop("service")
        number = F.coalesce(F.nullif(F.regexp_extract(a["value"], r"listen\s*\(\s*(\d{2,5})\s*[,)]", 1), F.lit("")), F.nullif(F.regexp_extract(a["value"], r"listen\s*\(\s*\{[^}]*port\s*:\s*(\d{2,5})", 1), F.lit("")))
        configured = self.facts["markers"].where(~F.col("name").isin(*HANDLED, *COMPONENTS, *SHAPES))
        listeners = configured.select(module_id(F.col("path")).alias("module"), number.alias("number")).where("number is not null").distinct()
        health = self.marked("compose.healthcheck").select(component(a["service"]).alias("service"), a["endpoint"].alias("path")).join(services.select("service"), "service", "left_semi").distinct()
        endpoints = self._routes().select(F.col("endpoint_id").alias("endpoint"), F.coalesce(a["path"], F.lit("/")).alias("route")).distinct()
        return {
            "service_to_module": (links, lost), "service_to_entrypoint": started(services, self.commands(services), modules),
            "service_to_port": listening(ports, listeners), "service_to_endpoint": checked(health, endpoints),
        }

    def reconciled(self):
        """Services and the modules in their build context, the file that they start, listeners on their ports, and what their health checks ask."""
        found, services = self._reconciled(), self.services()
        own = services.select("service", "evidence", "seq")
        parts = []
        rows = found["service_to_module"][0].join(own, "service")
        parts.append(edges_of(rows, F.col("module"), "deploys", F.col("service"), STRONG, attributes=attributes(derivedFrom="compose.build_context", scope="application_to_service")))
        rows = found["service_to_entrypoint"][0].join(services.select("service", F.col("path"), "seq"), "service").withColumn("line", F.lit(1)).withColumn("producer", F.lit("deployment-reconciliation"))
        rows = self.cited(rows, "INFRASTRUCTURE_FILE")
        parts.append(edges_of(rows, F.col("service"), "runs", F.col("module"), WEAK, attributes=attributes(derivedFrom="dockerfile.entrypoint_or_cmd", declared=True, observed=False)))
        published = self.cited(self.marked("compose.port_publish"), "INFRASTRUCTURE_FILE")
        a = F.col("attributes")
        published = published.groupBy(of_kind("port", F.concat(a["service"], F.lit(":"), a["containerPort"])).alias("port")).agg(F.min_by("evidence", "seq").alias("evidence"), F.min("seq").alias("seq"))
        rows = found["service_to_port"][0].join(published, "port")
        parts.append(edges_of(rows, F.col("module"), "listens_on", F.col("port"), STRONG, attributes=attributes(derivedFrom="container_port_equals_listen_argument", scope="application_to_deployment", observed=False)))
        rows = found["service_to_endpoint"][0].join(own, "service")
        parts.append(edges_of(rows, F.col("service"), "exposes", F.col("endpoint"), EXPLICIT, attributes=attributes(derivedFrom="compose.healthcheck_target", scope="deployment_to_application", declared=True, observed=False, outcome="unknown")))
        return reduce(DataFrame.unionByName, parts)

    def unresolved(self) -> DataFrame:
        """(rule, subject, reason) of services, ports and checks that no code could be found for."""
        parts = [lost.select(F.lit(rule).alias("rule"), "subject", "reason") for rule, (_, lost) in self._reconciled().items()]
        return reduce(DataFrame.unionByName, parts)
