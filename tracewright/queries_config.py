"""Queries of the readers of configuration, documents, schemas and statements: files made of tables' rows, each with SQL of what is in them."""

from pyspark.sql import functions as F

from tracewright.extract import config
from tracewright.extract.sql_access import accesses
from tracewright.plans import estate
from tracewright.plans.build import Builder
from tracewright.plans.shapes import SCHEMAS, merged_edges, merged_ranks, merged_values
from tracewright.registry import register
from tracewright.storage import stored_table

# @k@ is a customer's number, @a@ its nation's.
_MARKDOWN = """# Must not count
REQ-@k@: The list @k@ must be sorted. `handle@k@`
- The API should answer in time src/n@a@.ts
Plain prose of @k@.
| must | not |
```
You must not read this
```
2. Each user shall log in
ADR-@k@ — Use one store
"""
_DOCKERFILE = """FROM node:@a@ AS build
WORKDIR /app@k@
ENV API_KEY=abc PORT=@k@
COPY --from=build package.json src ./
RUN npm ci
FROM nginx
EXPOSE 80 @k@
USER node
HEALTHCHECK CMD curl localhost
CMD ["node", "dist/main@k@.js"]
"""
_DDL = """CREATE TABLE users@k@ (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, email TEXT UNIQUE);
CREATE TABLE IF NOT EXISTS orders@k@ (
  id INT, user_id INT REFERENCES users@k@(id), amount DECIMAL(10, 2) DEFAULT 0,
  PRIMARY KEY (id, user_id), CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users@k@ (id)
);
ALTER TABLE orders@k@ ADD CONSTRAINT x FOREIGN KEY (item_id) REFERENCES items(id);
"""
_COMPOSE = """services:
  web@k@:
    build:
      context: ./web@k@
      dockerfile: docker/Dockerfile
    ports:
      - "80@a@:80"
      - 127.0.0.1:9000:9000/udp
    depends_on:
      api@k@:
        condition: service_healthy
    environment:
      - API_URL=http://api@k@:3000/x
      - SECRET_TOKEN=abc
    networks: [front, hidden]
    command: ["node", "main@k@.js"]
    healthcheck:
      test: ["CMD", "curl", "-f", "http://localhost:80/health/@k@?x=1"]
  api@k@:
    image: acme/api:@a@
    restart: always
    volumes:
      - data@k@:/var/lib:ro
      - ./conf:/etc/conf
networks:
  front:
volumes:
  data@k@:
"""
_WORKFLOW = """on: push
jobs:
  build@k@:
    runs-on: ubuntu
    steps:
      - uses: actions/checkout@v4
      - name: Run tests @k@
        run: npm test
  ship:
    steps:
      - run: |
          ./deploy.sh @k@
        env:
          KEY: ${{ secrets.DEPLOY_KEY_@a@ }}
"""
_MANIFEST = """{ // comment
  "name": "shop@k@", "version": "1.0.@a@",
  "dependencies": {"express": "^4"},
  "devDependencies": {"vitest@k@": "1"},
  "scripts": {"start": "node main.js"},
  "main": "main@k@.js", "workspaces": ["a", "b"]
}
"""


def _files(spark, sf, text, path="f@k@", table="customer"):
    """A file for each customer."""
    rows = estate.dealt(estate.table(spark, sf, table).select(F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("a")))
    put = lambda of: F.replace(F.replace(F.lit(of), F.lit("@k@"), F.col("k")), F.lit("@a@"), F.col("a"))
    return rows.select(put(path).alias("path"), put(text).alias("text"))


def _flat(markers):
    """path, name, line and attributes as one text."""
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return markers.select("path", "name", "line", F.array_join(pairs, ";").alias("said"))


def _stated(*rows):
    """SQL of the markers that each customer's file has."""
    put = lambda said: "replace(replace('{}', '@k@', c_custkey::VARCHAR), '@a@', c_nationkey::VARCHAR)".format(said.replace("'", "''"))
    values = ", ".join(f"('{n}', {k}, {put(s)})" for n, k, s in rows)
    return f"SELECT 'f' || c_custkey AS path, name, line, said FROM customer, LATERAL (VALUES {values}) v(name, line, said)"


_R = "doc.requirement"


@register(_stated((_R, 2, "identifier=REQ-@k@;implementsRef=handle@k@;statement=The list @k@ must be sorted."), (_R, 3, "implementsRef=src/n@a@.ts;statement=The API should answer in time"), (_R, 9, "statement=Each user shall log in"), (_R, 10, "identifier=ADR-@k@;statement=Use one store")))
def markdown_requirements(spark, sf):
    return _flat(config.markdown(_files(spark, sf, _MARKDOWN)))


@register(
    _stated(
        ("docker.base_image", 1, "image=node:@a@;stage=build"), ("docker.workdir", 2, "path=/app@k@"), ("docker.env", 3, "secretLike=true;variable=API_KEY"), ("docker.env", 3, "secretLike=false;variable=PORT"), ("docker.copy", 4, "instruction=COPY;sources=package.json,src"), ("docker.run", 5, "present=true"),
        ("docker.base_image", 6, "image=nginx;stage=default"), ("docker.expose", 7, "ports=80 @k@"), ("docker.user", 8, "configured=true;user=node"), ("docker.healthcheck", 9, "configured=true"), ("docker.cmd", 10, "value=node, dist/main@k@.js"), ("docker.build_stage", 1, "stageCount=2;stages=build,default"),
    )
)
def dockerfile_markers(spark, sf):
    return _flat(config.dockerfile(_files(spark, sf, _DOCKERFILE)))


@register(
    _stated(
        ("schema.table", 1, "columnCount=3;primaryKey=id;table=users@k@"), ("schema.column", 1, "column=id;dataType=INT;notNull=true;primaryKey=true;table=users@k@;unique=false"), ("schema.column", 1, "column=name;dataType=VARCHAR;notNull=true;primaryKey=false;table=users@k@;unique=false"), ("schema.column", 1, "column=email;dataType=TEXT;notNull=false;primaryKey=false;table=users@k@;unique=true"),
        ("schema.foreign_key", 2, "column=user_id;referencesColumn=id;referencesTable=users@k@;table=orders@k@"), ("schema.foreign_key", 2, "column=user_id;referencesColumn=id;referencesTable=users@k@;table=orders@k@"), ("schema.table", 2, "columnCount=3;primaryKey=id,user_id;table=orders@k@"),
        ("schema.column", 2, "column=id;dataType=INT;notNull=true;primaryKey=true;table=orders@k@;unique=false"), ("schema.column", 2, "column=user_id;dataType=INT;notNull=true;primaryKey=true;referencesTable=users@k@;table=orders@k@;unique=false"), ("schema.column", 2, "column=amount;dataType=DECIMAL;notNull=false;primaryKey=false;table=orders@k@;unique=false"),
        ("schema.foreign_key", 6, "column=item_id;referencesColumn=id;referencesTable=items;table=orders@k@"),
    )
)
def ddl_markers(spark, sf):
    return _flat(config.ddl(_files(spark, sf, _DDL)))


@register(
    _stated(
        ("compose.service", 2, "build=./web@k@;buildFile=docker/Dockerfile;publishedPorts=80,9000;service=web@k@"), ("compose.port_publish", 7, "containerPort=80;hostPort=80@a@;service=web@k@"), ("compose.port_publish", 8, "containerPort=9000;hostIp=127.0.0.1;hostPort=9000;protocol=udp;service=web@k@"),
        ("compose.depends_on", 10, "dependsOn=api@k@;service=web@k@"), ("compose.environment", 13, "service=web@k@;variable=API_URL"), ("compose.service_address", 13, "port=3000;service=web@k@;target=api@k@;variable=API_URL"), ("compose.environment", 14, "service=web@k@;variable=SECRET_TOKEN"),
        ("compose.network", 15, "network=front;service=web@k@"), ("compose.command", 16, "service=web@k@;value=node main@k@.js"), ("compose.healthcheck", 2, "command=curl -f http://localhost:80/health/@k@?x=1;endpoint=/health/@k@;kind=CMD;service=web@k@"),
        ("compose.service", 19, "image=acme/api:@a@;publishedPorts=;service=api@k@"), ("compose.restart_policy", 21, "restart=always;service=api@k@"), ("compose.volume_mount", 23, "readOnly=true;service=api@k@;target=/var/lib;volume=data@k@"), ("compose.volume_mount", 24, "service=api@k@;source=./conf;target=/etc/conf;volume=(bind) ./conf"),
        ("compose.network_declared", 26, "network=front"), ("compose.volume_declared", 28, "volume=data@k@"),
    )
)
def compose_markers(spark, sf):
    return _flat(config.compose(_files(spark, sf, _COMPOSE)))


_NO = "namesBuild=false;namesDeployment=false;namesTest={0}"


@register(
    _stated(
        ("workflow.job", 3, "job=build@k@;runsOn=ubuntu;stepCount=2"), ("workflow.step", 6, "job=build@k@;" + _NO.format("false") + ";uses=actions/checkout@v4"), ("workflow.step", 7, "job=build@k@;" + _NO.format("true") + ";run=npm test;step=Run tests @k@"),
        ("workflow.job", 9, "job=ship;stepCount=1"), ("workflow.step", 11, "job=ship;namesBuild=false;namesDeployment=true;namesTest=false;run=./deploy.sh @k@"), ("workflow.secret", 14, "job=ship;variable=DEPLOY_KEY_@a@"),
    )
)
def workflow_markers(spark, sf):
    return _flat(config.workflow(_files(spark, sf, _WORKFLOW)))


@register(
    _stated(
        ("manifest.name", 2, "name=shop@k@;version=1.0.@a@"), ("manifest.dependency", 3, "dependency=express;range=^4;section=dependencies"), ("manifest.dependency", 4, "dependency=vitest@k@;range=1;section=devDependencies"), ("manifest.script", 5, "command=node main.js;script=start"),
        ("manifest.entrypoint", 6, "field=main;value=main@k@.js"), ("manifest.workspaces", 6, "patterns=a,b"),
    )
)
def manifest_markers(spark, sf):
    return _flat(config.manifest(_files(spark, sf, _MANIFEST)))


@register("SELECT 'f' || c_custkey AS path, 'config.key' AS name, line, said FROM customer, LATERAL (VALUES (1, 'hasValue=false;key=services'), (2, 'hasValue=false;key=services.web' || c_custkey), (19, 'hasValue=false;key=services.api' || c_custkey), (25, 'hasValue=false;key=networks'), (26, 'hasValue=false;key=networks.front'), (27, 'hasValue=false;key=volumes'), (28, 'hasValue=false;key=volumes.data' || c_custkey)) v(line, said)")
def config_keys(spark, sf):
    return _flat(config.config_keys(_files(spark, sf, _COMPOSE)))


#: A statement, and the tables that it accesses: table, access, role.
_STATEMENTS = (
    ("SELECT name FROM a@k@ WHERE x = 'FROM q'", "a@k@:read:from"),
    ("SELECT 1 FROM main.a@k@ x, b@k@ AS y", "a@k@:read:from b@k@:read:from"),
    ("SELECT * FROM a@k@ LEFT OUTER JOIN b@k@ USING (i) CROSS JOIN \"c@k@\"", "a@k@:read:from b@k@:read:join c@k@:read:join"),
    ("WITH r AS (SELECT i FROM a@k@), s AS (SELECT * FROM r JOIN b@k@ USING (i)) SELECT * FROM s", "a@k@:read:from b@k@:read:join"),
    ("INSERT INTO a@k@ (i) SELECT i FROM b@k@", "a@k@:write:insert_into b@k@:read:from"),
    ("UPDATE a@k@ SET i = 1 FROM b@k@ WHERE b@k@.i = a@k@.i", "a@k@:write:update_target b@k@:read:from"),
    ("DELETE FROM a@k@ USING b@k@ WHERE i IN (SELECT i FROM c@k@)", "a@k@:write:delete_target b@k@:read:delete_using c@k@:read:from"),
    ("SELECT t.i FROM (SELECT i FROM a@k@ -- FROM b@k@\n) t; DELETE FROM d@k@", "a@k@:read:from d@k@:write:delete_target"),
    ("Update the colours of @k@ and ship", ""),
    ("nothing here @k@", ""),
)


@register("SELECT c_custkey AS id, s AS place, replace(t, '@k@', c_custkey::VARCHAR) AS \"table\", access, role FROM customer, LATERAL (VALUES " + ", ".join("({}, '{}', '{}', '{}')".format(k, *x.split(":")) for k, (_, found) in enumerate(_STATEMENTS) for x in found.split()) + ") v(s, t, access, role)")
def sql_access(spark, sf):
    """Ten statements for each customer."""
    given = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(sql).alias("sql")) for k, (sql, _) in enumerate(_STATEMENTS)])).alias("s")
    rows = estate.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), given).select("id", "s.place", F.replace("s.sql", F.lit("@k@"), F.col("id").cast("string")).alias("sql"))
    return accesses(rows).select("id", "place", "table", "access", "role")


@register("SELECT doc_id, 'doc' || doc_id % 10 AS \"table\" FROM documents WHERE text IS NOT NULL")
def sql_access_at_scale(spark, sf):
    """A statement around every whole text, which stands in it as a string."""
    quoted = F.concat(F.lit("SELECT '"), F.regexp_replace("text", "'", "''"), F.lit("' AS x FROM doc"), F.col("doc_id") % 10, F.lit(" -- FROM other"))
    rows = estate.table(spark, sf, "documents").where("text is not null").select("doc_id", quoted.alias("sql"))
    return accesses(rows).select("doc_id", "table")


# -- deployment in the graph: a compose file and a Dockerfile for each customer


_READ: dict[tuple[str, str], dict] = {}


def _deployment(spark, sf):
    """The rules over files and markers that are read and written once a session and set of tables: each rule scans markers several times, and their true sizes decide how they are joined."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _READ:
        return Builder(spark, dict(_READ[key]))
    composed = config.compose(_files(spark, sf, _COMPOSE, "d@k@/compose.yml"))
    docker = config.dockerfile(_files(spark, sf, _DOCKERFILE, "d@k@/web@k@/docker/Dockerfile"))
    markers = composed.unionByName(docker).unionByName(config.workflow(_files(spark, sf, _WORKFLOW, ".github/workflows/w@k@.yml")))
    seq = F.conv(F.substring(F.sha2("path", 256), 1, 9), 16, 10).cast("long") * (1 << 20) + F.col("line") * 64 + F.length("name")
    markers = markers.select("path", F.lit("config").alias("producer"), seq.alias("seq"), "name", "line", "attributes")
    rows = estate.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    paths = F.array(*[F.concat(F.lit(a), F.col("k"), F.lit(b), *( [F.col("k"), F.lit(c)] if c else [])) for a, b, c in (("d", "/compose.yml", ""), ("d", "/web", "/docker/Dockerfile"), ("d", "/web", "/src/a.ts"), ("d", "/web", "/main"), ("d", "/other.ts", ""), (".github/workflows/w", ".yml", ""))])
    own = F.when(F.col("path").endswith("/main"), F.concat("path", "k", F.lit(".js"))).otherwise(F.col("path"))
    files = rows.select("k", F.explode(paths).alias("path")).select(own.alias("path"), F.lit("any").alias("language"), F.lit(None).cast("string").alias("digest"), F.lit(True).alias("analyzable"), F.lit(0).cast("long").alias("seq"))
    markers = markers.select(*(x.split(" ")[0] for x in SCHEMAS["markers"].split(", ")))
    _READ[key] = {"files": stored_table(files, "deployment-files"), "markers": stored_table(markers, "deployment-markers")}
    return Builder(spark, dict(_READ[key]))


_K = "FROM customer"
_WEB, _API = "'deployment_component:web' || c_custkey", "'deployment_component:api' || c_custkey"
_COMPOSE_MODULE = "'module:d' || c_custkey || '/compose'"


@register(
    f"""SELECT {_WEB} || '|depends_on|' || {_API} AS id, 3 AS rank {_K} UNION ALL SELECT {_WEB} || '|joins_network|network:front', 3 {_K} UNION ALL SELECT {_API} || '|contains|volume:data' || c_custkey, 3 {_K} UNION ALL SELECT {_API} || '|contains|volume:bind-./conf', 3 {_K}
UNION ALL SELECT {_WEB} || '|exposes|port:web' || c_custkey || '-' || p, 3 FROM customer, (VALUES ('80'), ('9000')) v(p) UNION ALL SELECT {_WEB} || '|communicates_with|' || {_API}, 3 {_K}"""
)
def deployment_links(spark, sf):
    """What services need, join, mount, publish and address."""
    return merged_ranks(_deployment(spark, sf).deployed()[1])


@register(f"""SELECT {_WEB} || '|references_secret|secret:secret_token' AS id, true AS name_only {_K} UNION ALL SELECT 'module:d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile|references_secret|secret:api_key', true {_K}""")
def deployment_secrets(spark, sf):
    """Variables that are named like credentials, by name alone; a workflow's are referred to under names that aren't."""
    edges = merged_edges(_deployment(spark, sf).secrets()[1])
    return edges.select("id", (F.col("attributes")["referenceOnly"] == "true").alias("name_only"))


@register(f"""SELECT {_COMPOSE_MODULE} || '|deploys|' || {_WEB} AS id, 3 AS rank {_K} UNION ALL SELECT {_COMPOSE_MODULE} || '|deploys|' || {_API}, 3 {_K} UNION ALL SELECT DISTINCT 'module:d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile|deploys|deployment_component:' || i, 3 FROM customer, LATERAL (VALUES ('node-' || c_nationkey), ('nginx')) v(i)
UNION ALL SELECT 'module:d' || c_custkey || '/web' || c_custkey || m || '|deploys|' || {_WEB}, 2 FROM customer, LATERAL (VALUES ('/docker/dockerfile'), ('/src/a'), ('/main' || c_custkey)) v(m)""")
def deployment_components(spark, sf):
    """Components by the files that declare them, services by what their build context holds."""
    return merged_edges(_deployment(spark, sf).components()[1]).select("id", "rank")


@register(f"""SELECT 'module:d' || c_custkey || '/web' || c_custkey || m || '|deploys|' || {_WEB} AS id, 2 AS rank FROM customer, LATERAL (VALUES ('/docker/dockerfile'), ('/src/a'), ('/main' || c_custkey)) v(m) UNION ALL SELECT {_WEB} || '|runs|module:d' || c_custkey || '/web' || c_custkey || '/main' || c_custkey, 1 {_K}""")
def deployment_reconciled(spark, sf):
    """Services linked with the code of their build context and with the file that their command names."""
    return merged_ranks(_deployment(spark, sf).reconciled())


@register(f"""SELECT rule, subject FROM customer, LATERAL (VALUES ('service_to_module', {_API}), ('service_to_entrypoint', {_API}), ('service_to_port', 'port:web' || c_custkey || '-80'), ('service_to_port', 'port:web' || c_custkey || '-9000'), ('service_to_endpoint', {_WEB})) v(rule, subject)""")
def deployment_unresolved(spark, sf):
    return _deployment(spark, sf).unresolved().select("rule", "subject")


@register("""SELECT 'configuration:' || p || '-' || line AS id, marker FROM customer, LATERAL (VALUES ('d' || c_custkey || '/compose.yml', 13, 'compose.environment'), ('d' || c_custkey || '/compose.yml', 16, 'compose.command'), ('d' || c_custkey || '/compose.yml', 2, 'compose.healthcheck'), ('d' || c_custkey || '/compose.yml', 21, 'compose.restart_policy'),
('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 2, 'docker.workdir'), ('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 3, 'docker.env'), ('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 4, 'docker.copy'), ('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 5, 'docker.run'),
('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 7, 'docker.expose'), ('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 8, 'docker.user'), ('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 9, 'docker.healthcheck'), ('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 10, 'docker.cmd'),
('d' || c_custkey || '/web' || c_custkey || '/docker/dockerfile', 1, 'docker.build_stage'), ('github/workflows/w' || c_custkey || '.yml', 3, 'workflow.job'), ('github/workflows/w' || c_custkey || '.yml', 6, 'workflow.step'), ('github/workflows/w' || c_custkey || '.yml', 7, 'workflow.step'), ('github/workflows/w' || c_custkey || '.yml', 9, 'workflow.job'), ('github/workflows/w' || c_custkey || '.yml', 11, 'workflow.step'),
('github/workflows/w' || c_custkey || '.yml', 14, 'workflow.secret')) v(p, line, marker)""")
def deployment_configuration(spark, sf):
    """What has no shape of its own becomes configuration of its file and line."""
    return merged_values(_deployment(spark, sf).configuration()[0], "marker")
