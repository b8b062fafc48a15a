"""The driver's queries over the synthetic tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import encodings as E
from .functions import paths as P
from .functions import text as T
from .operators import budget as BU
from .operators import claims as C
from .operators import delta as D
from .operators import duplicates as DU
from .operators import fences as N
from .operators import graph as G
from .operators import matching as M
from .operators import obligations as B
from .operators import ownership as O
from .operators import resolve as R
from .operators import select as S
from .operators import status as ST
from .sources import advisory as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_OWNED = "owned AS (SELECT path, arg_max(id, length(prefix)) AS unit_id FROM artifact JOIN unit ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path)"


@query(f"WITH {E.UNIT_SQL}, {_OWNED} SELECT path, unit_id FROM artifact LEFT JOIN owned USING (path)")
def owner_of_artifact(s, d):
    return O.owner(E.artifacts(s, d), E.units(s, d)).select("path", "unit_id")


GLOBS = [("ends in 7", "*7"), ("mobile", "m.*/*"), ("nothing", "nothing/[a-c]?")]
_GLOBBED = """g(id, specificity, ord, pat) AS (VALUES ('ends in 7', 0, 0, '^.*7$'), ('mobile', 2, 1, '^m[.].*/.*$'), ('nothing', 8, 2, '^nothing/[a-c].$'))"""


@query(
    f"""WITH {E.UNIT_SQL}, owned AS (SELECT path, arg_max(id, length(prefix)) AS u, max(length(prefix)) AS n FROM artifact JOIN unit ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path), {_GLOBBED},
hit AS (SELECT path, arg_max(id, specificity * 10 - ord) AS gid, max(specificity) AS m FROM artifact JOIN g ON regexp_matches(path, pat) GROUP BY path)
SELECT path, CASE WHEN m > coalesce(n, -1) THEN gid ELSE u END AS unit_id FROM artifact LEFT JOIN owned USING (path) LEFT JOIN hit USING (path)"""
)
def owner_with_globs(s, d):
    return O.owner_with_globs(E.artifacts(s, d), E.units(s, d), GLOBS).select("path", "unit_id")


@query(f"WITH {E.UNIT_SQL}, {_GLOBBED} SELECT g.id, count(DISTINCT path) AS n FROM g LEFT JOIN artifact ON regexp_matches(path, pat) GROUP BY g.id")
def glob_artifact_counts(s, d):
    return O.glob_counts(E.artifacts(s, d), GLOBS)


@query(f"WITH {E.UNIT_SQL}, {_OWNED} SELECT path FROM artifact LEFT JOIN owned USING (path) WHERE unit_id IS NULL")
def unowned_artifacts(s, d):
    return owner_of_artifact(s, d).where("unit_id is null").select("path")


@query(
    f"""WITH {E.UNIT_SQL}, {_OWNED}, un AS (SELECT path FROM artifact LEFT JOIN owned USING (path) WHERE unit_id IS NULL),
scored AS (SELECT path, id, CASE WHEN split_part(path, '/', 1) = split_part(id, '/', 1) THEN 1 ELSE 0 END AS shared FROM un, unit)
SELECT path, CAST(r AS BIGINT) AS rank, id AS unit_id FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY shared DESC, id) AS r FROM scored) WHERE r <= 3"""
)
def nearest_units(s, d):
    return O.nearest(unowned_artifacts(s, d), E.units(s, d)).select("path", F.col("rank").cast("long").alias("rank"), "unit_id")


@query(f"WITH {E.UNIT_SQL} SELECT id AS unit_id, count(path) AS n FROM unit LEFT JOIN artifact ON path = prefix OR starts_with(path, prefix || '/') GROUP BY id")
def unit_artifact_counts(s, d):
    return O.artifact_counts(E.artifacts(s, d), E.units(s, d)).withColumnRenamed("id", "unit_id")


@query(f"WITH {E.DEPRECATED_SQL} SELECT path, arg_max(id, (length(prefix), id)) AS dep_id FROM artifact JOIN dep ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path")
def deprecated_path_used(s, d):
    return O.deepest_prefix(E.artifacts(s, d), E.deprecated(s, d)).withColumnRenamed("id", "dep_id")


@query(
    f"""WITH {E.UNIT_SQL}, every AS (SELECT * FROM unit UNION ALL VALUES ('gone-a', 'gone.example.com'), ('gone-b', 'gone.example.com/en'))
SELECT id AS unit_id FROM every WHERE NOT EXISTS (SELECT 1 FROM artifact WHERE path = prefix OR starts_with(path, prefix || '/'))"""
)
def structure_drift(s, d):
    gone = s.createDataFrame([("gone-a", "gone.example.com"), ("gone-b", "gone.example.com/en")], "id string, prefix string")
    return O.drifted(E.units(s, d).unionByName(gone), E.artifacts(s, d)).select(F.col("id").alias("unit_id"))


_DUP = "dup AS (SELECT p_name AS name, count(DISTINCT p_brand) AS n_modules, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS modules FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2)"


@query(f"WITH {_DUP} SELECT name, n_modules, modules FROM dup")
def duplicate_symbol(s, d):
    return DU.duplicate_names(E.symbols(s, d), public_only=True).select("name", "n_modules", F.array_join("modules", ",").alias("modules"))


@query(
    f"""WITH {_DUP}, claim AS (SELECT p_name AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS modules FROM part WHERE p_size <= 40 GROUP BY p_name)
SELECT name, modules FROM dup ANTI JOIN claim USING (name, modules)"""
)
def duplicate_unclaimed(s, d):
    small = E.table(s, d, "part").where("p_size <= 40").groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("modules"))
    return DU.unclaimed(DU.duplicate_names(E.symbols(s, d)), small).select("name", F.array_join("modules", ",").alias("modules"))


@query(f"WITH {E.IMPORT_SQL} SELECT module, target, target_path, min(line) AS line FROM edge GROUP BY ALL")
def import_first_occurrence(s, d):
    return R.first_lines(E.imports(s, d), ["module", "target", "target_path"])


_KNOWN = "known AS (SELECT replace(place, '/', '.') AS dotted, min('src/' || place) AS target_path FROM place WHERE NOT starts_with(place, 'ASIA/') GROUP BY 1)"


@query(f"WITH {E.IMPORT_SQL}, {_KNOWN} SELECT module, target, target_path FROM (SELECT DISTINCT module, replace(target, '/', '.') AS target FROM edge) LEFT JOIN known ON dotted = target")
def import_resolution(s, d):
    nation = E.table(s, d, "nation").join(E.table(s, d, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))  # what lies in Asia is another project's
    known = nation.select(F.concat_ws(".", "r_name", "n_name").alias("dotted"), F.concat_ws("/", F.lit("src"), "r_name", "n_name").alias("path"))
    edges = E.imports(s, d).select("module", F.translate("target", "/", ".").alias("target")).distinct()
    return R.resolve_targets(edges, known).select("module", "target", "target_path")


_RULES = "rule(unit, forbidden) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in E.RULES) + ")"
_VIOLATION = f"""{_RULES}, wide AS (SELECT module, target, target_path FROM edge UNION SELECT module, split_part(target, '/', 1), split_part(target_path, '/', 1) FROM edge),
bad AS (SELECT module, target, min(forbidden) AS forbidden FROM wide JOIN rule ON unit = split_part(module, '/', 1) AND (target_path = forbidden OR starts_with(target_path, forbidden || '/'))
  WHERE target_path IS NOT NULL AND split_part(module, '/', 1) <> split_part(target_path, '/', 1) GROUP BY module, target)"""


@query(f"WITH {E.IMPORT_SQL}, {_VIOLATION} SELECT module, target, forbidden FROM bad")
def dependency_violations(s, d):
    edges = E.imports(s, d).select("module", "target", "target_path").distinct()
    head = lambda c: F.substring_index(c, "/", 1)
    wide = G.written(edges.unionByName(edges.select("module", head("target").alias("target"), head("target_path").alias("target_path"))).distinct(), "imports")
    rules = s.createDataFrame(E.RULES, "unit string, forbidden string")
    regions = E.table(s, d, "region").select(F.col("r_name").alias("id"), F.col("r_name").alias("prefix"))
    paths = wide.select(F.col("module").alias("path")).unionByName(wide.select(F.col("target_path").alias("path"))).where("path is not null").distinct()
    owned = O.owner(paths, regions).select("path", F.col("unit_id").alias("unit"))
    return R.forbidden_edges(wide, rules, owned, regions.select(F.col("id").alias("unit"), "prefix"))


@query(f"WITH {E.IMPORT_SQL}, {_VIOLATION} SELECT module, target, forbidden FROM bad b WHERE NOT EXISTS (SELECT 1 FROM bad o WHERE o.module = b.module AND starts_with(o.target, b.target || '/'))")
def dependency_leaf_only(s, d):
    return R.leaves_only(dependency_violations(s, d), "/")


@query("SELECT p_brand || '.' || p_name AS q, min(p_partkey) AS line FROM part GROUP BY 1 HAVING count(*) = 1")
def reference_unique(s, d):
    return R.unique_only(E.symbols(s, d).withColumn("q", F.concat_ws(".", "module", "name")), "q").select("q", "line")


@query(
    """WITH def AS (SELECT p_brand || '.' || p_name AS q, p_name AS n, p_partkey AS line FROM part WHERE p_size > 10),
ref AS (SELECT DISTINCT p_brand || '.' || p_name AS ref, p_name AS n FROM part WHERE p_size <= 10),
l AS (SELECT q, count(*) AS c, min(line) AS line FROM def GROUP BY q), sh AS (SELECT n, count(*) AS c, min(line) AS line FROM def GROUP BY n)
SELECT ref, CASE WHEN l.c = 1 THEN l.line WHEN l.c > 1 THEN NULL WHEN sh.c = 1 THEN sh.line END AS line,
CASE WHEN l.c = 1 THEN 'qualified' WHEN l.c > 1 THEN NULL WHEN sh.c = 1 THEN 'simple' END AS "by" FROM ref LEFT JOIN l ON l.q = ref LEFT JOIN sh ON sh.n = ref.n"""
)
def reference_fallback(s, d):
    part = E.table(s, d, "part")
    named = lambda df: df.select(F.concat_ws(".", "p_brand", "p_name").alias("qualified"), F.col("p_name").alias("simple"), F.col("p_partkey").alias("line"))
    refs = named(part.where("p_size <= 10")).select("qualified", "simple").distinct()
    return R.resolve_references(refs, named(part.where("p_size > 10"))).select(F.col("qualified").alias("ref"), "line", "by")


@query("SELECT l_partkey AS partkey, l_suppkey AS suppkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS resolution, min(l_orderkey) AS orderkey FROM lineitem GROUP BY 1, 2")
def first_edge_per_key(s, d):
    first = R.first_by(E.table(s, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_orderkey"])
    return first.select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("resolution"), F.col("l_orderkey").alias("orderkey"))


#: Only the SQL stops here. The queries themselves run until nothing new is reached.
_DEPTH = 12
_REACH = f"""reach AS (SELECT node, min(d) AS distance FROM (SELECT * FROM walk) GROUP BY node)"""


def _walk(start: str) -> str:
    return f"WITH RECURSIVE {E.CALL_SQL}, start AS ({start}), walk(node, d) AS (SELECT node, 0 FROM start UNION SELECT caller, d + 1 FROM walk JOIN call ON callee = node WHERE d < {_DEPTH}), {_REACH}"


_BUSIEST = "SELECT callee AS node FROM call GROUP BY callee ORDER BY count(*) DESC, callee LIMIT 1"


def _busiest(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")


@query(f"{_walk(_BUSIEST)} SELECT node, CAST(distance AS BIGINT) AS distance FROM reach")
def impact_reach(s, d):
    calls = E.calls(s, d)
    return G.reverse_reach(calls, _busiest(calls)).select("node", F.col("distance").cast("long").alias("distance"))


@query(
    f"""{_walk(_BUSIEST)} SELECT r.node, CAST(r.distance AS BIGINT) AS distance, count(DISTINCT callee) AS n_via, string_agg(DISTINCT CAST(callee AS VARCHAR), ',' ORDER BY CAST(callee AS VARCHAR)) AS via
FROM reach r JOIN call ON caller = r.node JOIN reach n ON n.node = callee AND n.distance = r.distance - 1 GROUP BY r.node, r.distance"""
)
def impact_via(s, d):
    calls = G.written(E.calls(s, d), "calls")
    via = G.arriving(G.reverse_reach(calls, _busiest(calls)), calls)
    return via.select("node", F.col("distance").cast("long").alias("distance"), F.size("via").cast("long").alias("n_via"), F.array_join(F.array_sort(F.transform("via", lambda v: v.cast("string"))), ",").alias("via"))


@query(f"{_walk('SELECT DISTINCT node FROM (SELECT caller AS node FROM call UNION SELECT callee FROM call) WHERE node // 10 = 3')} SELECT node, CAST(distance AS BIGINT) AS distance FROM reach")
def impact_by_path(s, d):
    """A path as target stands for all nodes of that module; here users of one decade."""
    calls = E.calls(s, d)
    nodes = calls.select(F.col("caller").alias("node")).union(calls.select("callee")).distinct()
    return G.reverse_reach(calls, nodes.where(F.floor(F.col("node") / 10) == 3)).select("node", F.col("distance").cast("long").alias("distance"))


@query(
    """SELECT 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 2 FROM customer"""
)
def program_layers(s, d):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    region, nation, customer = (E.table(s, d, t) for t in ("region", "nation", "customer"))
    needs = nation.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("on")).union(customer.select(name("c", "c_custkey"), name("n", "c_nationkey")))
    nodes = region.select(name("r", "r_regionkey").alias("id")).union(needs.select("id"))
    return G.layers(nodes, needs)[0].select("id", F.col("layer").cast("long").alias("layer"))


@query(
    """WITH tree AS (SELECT r_name AS node, NULL AS parent FROM region UNION ALL SELECT r_name || '/' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT t.node, coalesce(string_agg(k.node, ',' ORDER BY k.node), '') AS children FROM tree t LEFT JOIN tree k ON k.parent = t.node GROUP BY t.node"""
)
def tree_children(s, d):
    region = E.table(s, d, "region")
    nation = E.table(s, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    tree = region.select(F.col("r_name").alias("node"), F.lit(None).cast("string").alias("parent")).union(nation.select(F.concat_ws("/", "r_name", "n_name"), "r_name"))
    return G.children(tree).select("node", F.array_join("children", ",").alias("children"))


def _snapshot(s, d, op: str) -> DataFrame:
    base, head = E.snapshots(s, d)
    return D.diff(base, head, ["user_id", "event_type", "k"]).where(F.col("op") == op).drop("op")


@query(f"WITH {E.SNAPSHOT_SQL} SELECT * FROM head EXCEPT SELECT * FROM base")
def snapshot_added(s, d):
    return _snapshot(s, d, "added")


@query(f"WITH {E.SNAPSHOT_SQL} SELECT * FROM base EXCEPT SELECT * FROM head")
def snapshot_removed(s, d):
    return _snapshot(s, d, "removed")


@query(f"WITH {E.SNAPSHOT_SQL} SELECT * FROM base INTERSECT SELECT * FROM head")
def snapshot_unchanged(s, d):
    return _snapshot(s, d, "same")


@query("SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'purchase')")
def changed_keys_union(s, d):
    events = E.table(s, d, "events")
    return events.where("event_type = 'error'").select("user_id").union(events.where("event_type = 'purchase'").select("user_id")).distinct()


OBLIGATIONS = [
    {"id": "o1", "kind": "event", "scope": "er", "name": "*", "requirement": "user/absent"},
    {"id": "o5", "kind": "event", "scope": "error/", "name": "1*", "requirement": "user/1*"},
    {"id": "o6", "kind": "event", "scope": "error", "name": "1*", "requirement": "absent/*"},
    {"id": "o2", "kind": "event", "scope": "", "name": "*7", "requirement": "user/absent"},
    {"id": "o3", "kind": "event", "scope": "nothing", "name": "*", "requirement": "user/absent"},
    {"id": "o4", "kind": "call", "scope": "", "name": "*", "requirement": "user/absent"},
]


@query(
    f"""WITH {E.SNAPSHOT_SQL}, delta AS (SELECT * FROM head EXCEPT SELECT * FROM base), changed AS (SELECT DISTINCT 'user/' || user_id AS path FROM delta),
o(id, scope, pat, requirement, asked) AS (VALUES ('o1', 'er', '^.*$', 'user/absent', '^user/absent$'), ('o2', '', '^.*7$', 'user/absent', '^user/absent$'), ('o3', 'nothing', '^.*$', 'user/absent', '^user/absent$'),
  ('o5', 'error', '^1.*$', 'user/1*', '^user/1.*$'), ('o6', 'error', '^1.*$', 'absent/*', '^absent/.*$'))
SELECT id AS obligation, requirement FROM o WHERE EXISTS (SELECT 1 FROM delta WHERE (scope = '' OR event_type = scope OR starts_with(event_type, scope || '/')) AND regexp_matches(CAST(k AS VARCHAR), pat))
  AND NOT EXISTS (SELECT 1 FROM changed WHERE regexp_matches(path, asked))"""
)
def coupling_missing(s, d):
    added = snapshot_added(s, d)
    delta = added.select(F.lit("event").alias("family"), F.col("event_type").alias("scope"), F.col("k").cast("string").alias("name"))
    return D.missing_companions(delta, OBLIGATIONS, added.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path")))


@query(
    """WITH a AS (SELECT DISTINCT p_brand || p_name AS id FROM part WHERE p_size <= 30), b AS (SELECT DISTINCT p_brand || p_name AS id FROM part WHERE p_size > 20)
SELECT id, 'not declared' AS side FROM a ANTI JOIN b USING (id) UNION ALL SELECT id, 'not implemented' FROM b ANTI JOIN a USING (id)"""
)
def registry_diff(s, d):
    part = E.table(s, d, "part")
    named = part.select(F.concat("p_brand", "p_name").alias("id"), "p_size")
    return D.symmetric_difference(named.where("p_size <= 30"), named.where("p_size > 20"), "id", ("not declared", "not implemented"))


@query(f"WITH {E.LINK_SQL} SELECT path, count(*) AS n FROM link ANTI JOIN there USING (path) GROUP BY path")
def stale_links(s, d):
    return C.unresolved(E.link_claims(s, d), E.link_targets(s, d), ["path"]).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {E.LINK_SQL} SELECT source, pos, path, path IN (SELECT path FROM there) AS exists FROM link")
def link_claims(s, d):
    return C.with_exists(E.link_claims(s, d), E.link_targets(s, d)).select("source", "pos", "path", "exists")


@query(
    """WITH c AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'), f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O')
SELECT CASE WHEN f.l_partkey IS NULL THEN 'unconfirmed' ELSE 'confirmed' END AS tier, count(*) AS n FROM c LEFT JOIN f USING (l_partkey, l_suppkey) GROUP BY 1"""
)
def claim_tiers(s, d):
    pairs = E.table(s, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"), "l_linestatus")
    claims = pairs.where("l_linestatus = 'F'").select("subject", "object").distinct()
    return C.tiers(claims, pairs.where("l_linestatus = 'O'"), ["subject", "object"], closed=False).groupBy("tier").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS subject FROM orders)
SELECT subject, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'mismatch' END AS verdict FROM c LEFT JOIN orders ON o_orderkey = subject"""
)
def claim_value_mismatch(s, d):
    orders = E.table(s, d, "orders")
    claims = orders.select(F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("subject"), F.lit("O").alias("value"))
    return C.verify_values(claims, orders.select(F.col("o_orderkey").alias("subject"), F.col("o_orderstatus").alias("value"))).select("subject", "verdict")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_custkey % 2 = 0")
def query_select(s, d):
    tasks = E.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 2 == 1).alias("archived"))
    return S.select_rows(tasks, S.parse_selectors(["status=F", "priority=2-HIGH", "archived=false"])).drop("archived")


@query(
    """SELECT 'region' AS kind, (SELECT count(*) FROM region) AS n, 'r_name,r_regionkey' AS fields UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 'n_name,n_nationkey,n_regionkey'
UNION ALL SELECT 'nothing', 0, ''"""
)
def schema_fields(s, d):
    kinds = {"region": E.table(s, d, "region"), "nation": E.table(s, d, "nation"), "nothing": E.table(s, d, "region").where("false")}
    return S.schema_of(s, kinds)


@query("SELECT o_orderpriority AS block, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS sources FROM orders GROUP BY 1")
def sources_per_block(s, d):
    found = ST.sources_of(E.table(s, d, "orders").withColumnRenamed("o_orderpriority", "block"), "block", "o_orderstatus")
    return found.select("block", F.array_join("sources", ",").alias("sources"))


@query(
    f"""WITH {_DUP}, changed AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 1)
SELECT DISTINCT p_brand AS path, 'duplicate-symbol' AS kind,
  p_brand || ': public symbol ''' || name || ''' is also defined in ' || array_to_string(list_filter(string_split(modules, ','), lambda m: m <> p_brand), ', ') AS message FROM dup JOIN part ON p_name = name SEMI JOIN changed USING (p_brand)"""
)
def status_changed_only(s, d):
    """A duplicate is told once for each changed module that defines it."""
    changed = E.table(s, d, "part").where("p_size = 1").select(F.col("p_brand").alias("path")).distinct()
    return ST.status_rows(ST.affected_duplicates(DU.duplicate_names(E.symbols(s, d)), changed))


@query(
    """WITH r AS (SELECT DISTINCT p_brand AS path, p_type AS kind, p_name AS message FROM part), f AS (SELECT substr(sha256(path || chr(0) || kind || chr(0) || message), 1, 16) AS fingerprint, kind FROM r)
SELECT fingerprint FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM f WHERE starts_with(kind, 'PROMO'))"""
)
def session_fresh(s, d):
    rows = E.table(s, d, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("kind"), F.col("p_name").alias("message")).distinct()
    seen = C.fresh(rows.where(F.col("kind").startswith("PROMO")), s.createDataFrame([], "fingerprint string"))
    return C.fresh(rows, seen).select("fingerprint")


@query("SELECT p_brand AS module, p_partkey AS line, p_name AS name, (SELECT count(*) FROM part) AS total, (SELECT count(*) > 80 FROM part) AS truncated FROM part ORDER BY p_brand, p_partkey, p_name LIMIT 80")
def budget_topk(s, d):
    return S.capped(E.symbols(s, d).select("module", "line", "name"), ["module", "line", "name"], 80)


@query("SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1995-03-01'")
def waiver_expired(s, d):
    waivers = E.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("expires"))
    return S.expired(waivers, "1995-03-01").select("id")


_SEVERITY = "CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END"


def _severities(s, d):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning").otherwise("info")
    return E.table(s, d, "events").select(severity.alias("severity"))


@query(f"SELECT count(*) FILTER ({_SEVERITY} = 'error') AS errors, count(*) FILTER ({_SEVERITY} = 'warning') AS warnings, count(*) FILTER ({_SEVERITY} = 'error') = 0 AS ok FROM events")
def finding_totals(s, d):
    return ST.totals(_severities(s, d))


@query(
    f"""WITH {E.UNIT_SQL}, {_OWNED}, un AS (SELECT path FROM artifact LEFT JOIN owned USING (path) WHERE unit_id IS NULL),
u AS (SELECT id, EXISTS (SELECT 1 FROM artifact WHERE path = prefix OR starts_with(path, prefix || '/')) AS there FROM unit)
SELECT 'units' AS topic, count(*) AS n, '' AS shown FROM u UNION ALL SELECT 'not on disk', count(*), coalesce(string_agg(id, ', ' ORDER BY id), '') FROM u WHERE NOT there
UNION ALL SELECT 'unowned', (SELECT count(*) FROM un), coalesce((SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM un ORDER BY path LIMIT 5)), '')
  || CASE WHEN (SELECT count(*) FROM un) > 5 THEN ', +' || CAST((SELECT count(*) FROM un) - 5 AS VARCHAR) || ' more' ELSE '' END
UNION ALL SELECT 'status ' || o_orderstatus, count(*), '' FROM orders GROUP BY 1"""
)
def inventory_summary(s, d):
    counted = O.artifact_counts(E.artifacts(s, d), E.units(s, d))
    units = counted.select("id", (F.col("n") > 0).alias("exists"))
    return ST.summary(units, unowned_artifacts(s, d), E.table(s, d, "orders").select(F.col("o_orderstatus").alias("status")))


_STORED = f"""WITH {E.STORED_SQL}, own AS (SELECT id, name AS symbol, class, path FROM node WHERE path IN (SELECT path FROM file)),
stored AS (SELECT a.path AS caller_path, a.class AS caller_class, a.symbol AS caller_symbol, b.path AS callee_path, b.class AS callee_class, b.symbol AS callee_symbol, resolution, min(line) AS line
  FROM edge JOIN own a ON source = a.id JOIN own b ON target = b.id GROUP BY ALL)"""


def _stored(s, d):
    return A.stored_calls(*E.stored_calls(s, d), "/repo")


@query(f"{_STORED} SELECT * FROM stored")
def advisory_calls(s, d):
    return _stored(s, d)


@query(
    f"""{_STORED}, {E.CALL_SQL} SELECT callee_path || '::' || callee_class || '::' || callee_symbol AS callee, caller_path || '::' || caller_class || '::' || caller_symbol AS caller, 'stored' AS source, 'advisory' AS provenance, resolution FROM stored
UNION ALL SELECT callee || '::::f', caller || '::::f', 'parsed', 'deterministic', 'name' FROM call"""
)
def impact_edges(s, d):
    calls = E.calls(s, d)
    plain = calls.select(*[F.lit(v).alias(f"{e}_{c}") if v is not None else F.col(e).cast("string").alias(f"{e}_{c}") for e in ("caller", "callee") for c, v in (("path", None), ("class", ""), ("symbol", "f"))], F.lit("name").alias("resolution"))
    return A.impact_edges(plain, _stored(s, d))


@query(f"SELECT {_SEVERITY} AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_totals(s, d):
    return ST.by_severity(_severities(s, d))


@query(
    f"""WITH {E.DEPRECATED_SQL}, {_OWNED}, {_DUP} SELECT 'error' AS severity, 'missing-structure-owner' AS check_id, path AS message FROM artifact LEFT JOIN owned USING (path) WHERE unit_id IS NULL
UNION ALL SELECT 'error', 'deprecated-path-used', path FROM artifact WHERE EXISTS (SELECT 1 FROM dep WHERE path = prefix OR starts_with(path, prefix || '/'))
UNION ALL SELECT 'warning', 'duplicate-symbol', name FROM dup"""
)
def findings_union(s, d):
    tell = lambda df, severity, check, c: df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check_id"), F.col(c).alias("message"))
    parts = [tell(unowned_artifacts(s, d), "error", "missing-structure-owner", "path"), tell(deprecated_path_used(s, d), "error", "deprecated-path-used", "path"), tell(duplicate_symbol(s, d), "warning", "duplicate-symbol", "name")]
    return S.ordered_findings(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _digest_sql(source: str, row: str, leaf: int) -> str:
    """Up to 16 ** 4 leaves, which are joined in one step."""
    return f"""h AS (SELECT sha256({row}) AS h, count(*) AS n FROM {source} GROUP BY 1), c AS (SELECT CASE WHEN count(*) <= {leaf} THEN 0 WHEN count(*) <= {leaf * 16} THEN 1 WHEN count(*) <= {leaf * 256} THEN 2 WHEN count(*) <= {leaf * 4096} THEN 3 ELSE 4 END AS digits FROM h),
l AS (SELECT left(h, digits) AS part, digits, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS h FROM h, c GROUP BY 1, 2)
SELECT 'sha256:' || CASE WHEN min(digits) = 0 THEN min(h) ELSE sha256(string_agg(part || ':' || h, chr(10) ORDER BY part || ':' || h)) END AS digest FROM l"""


@query(f"WITH {E.UNIT_SQL}, {_digest_sql('unit', 'id || chr(9) || prefix', S.LEAF)}")
def inventory_digest(s, d):
    return S.digest(E.units(s, d), ["id", "prefix"])


@query(f"WITH {_digest_sql('lineitem', 'l_returnflag || chr(9) || l_partkey || chr(9) || l_suppkey', S.LEAF)}")
def relation_digest(s, d):
    """A relation whose rows repeat, in a tree of several leaves."""
    return S.digest(E.table(s, d, "lineitem"), ["l_returnflag", "l_partkey", "l_suppkey"])


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), r AS (SELECT doc_id, i, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
m AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '[a-z]') THEN 0 ELSE 1 END AS fence FROM r), p AS (SELECT doc_id, fence, sum(fence) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS inside FROM m)
SELECT doc_id AS source, count(*) AS n_lines, CAST(sum(CASE WHEN inside = 1 AND fence = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_fence FROM p GROUP BY doc_id"""
)
def line_fences(s, d):
    """Lines without small letters as fences that change inside to outside and back."""
    marked = N.blocks(_lines(s, d), F.when(~F.col("text").rlike("[a-z]"), N.mark(F.lit(1), F.lit(True), F.lit("fence"))))
    return marked.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(F.expr("role = 'text' and block is not null")).alias("n_in_fence"))


def _lines(s, d):
    lines = E.table(s, d, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("source", (F.col("i") + 1).alias("line"), "text")


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, i, length(a[i]) AS n FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, n % 4 AS size, n % 3 = 0 AS closes, CASE WHEN n % 5 = 0 THEN 'claims' WHEN n % 7 > 0 THEN 'code' END AS opens FROM r WHERE n % 2 = 0),
s(doc_id, k, i, size, kind, since, ended) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM l
UNION ALL SELECT s.doc_id, m.k, m.i, CASE WHEN s.kind IS NULL THEN m.size ELSE s.size END, CASE WHEN s.kind IS NULL THEN m.opens WHEN m.closes AND m.size >= s.size THEN NULL ELSE s.kind END,
  CASE WHEN s.kind IS NULL THEN m.i ELSE s.since END, CASE WHEN s.kind IS NOT NULL AND m.closes AND m.size >= s.size THEN s.since END FROM s JOIN m ON m.doc_id = s.doc_id AND m.k = s.k + 1)
SELECT o.doc_id AS source, CAST(o.i AS INTEGER) AS since, o.kind AS block, e.i IS NOT NULL AS closed, coalesce(e.i, len(l.a)) - o.i + 1 AS n_lines
FROM s o JOIN l USING (doc_id) LEFT JOIN s e ON e.doc_id = o.doc_id AND e.ended = o.i WHERE o.kind IS NOT NULL AND o.since = o.i"""
)
def nested_blocks(s, d):
    """Blocks whose ends must be as large as their beginnings, over all lines; segments of 16 lines, so that blocks cross them."""
    n = F.length("text")
    marks = F.when(n % 2 == 0, N.mark(n % 4, n % 3 == 0, F.when(n % 5 == 0, "claims").when(n % 7 > 0, "code")))
    inside = N.blocks(_lines(s, d), marks, 16).where("block is not null")
    return inside.groupBy("source", "since").agg(F.max("block").alias("block"), F.max(F.col("role") == "close").alias("closed"), F.count("*").alias("n_lines")).select("source", "since", "block", "closed", "n_lines")


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"""
)
def text_normalize(s, d):
    url = F.col("url")
    return E.table(s, d, "pages").select("page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), *T.url_parts(F.regexp_replace(url, "^[a-z]+://", "")))


_FIRED = """best AS (SELECT * FROM rule QUALIFY row_number() OVER (PARTITION BY kind, scope, coalesce(name, ''), requirement, coalesce(call_key, '') ORDER BY CASE origin WHEN 'manual' THEN 1 ELSE 0 END DESC, CASE origin WHEN 'manual' THEN n ELSE -n END DESC) = 1),
fired AS (SELECT * FROM best r WHERE EXISTS (SELECT 1 FROM fact f WHERE f.family = r.kind AND (CASE WHEN r.call_key IS NOT NULL THEN f.call_key = r.call_key
  ELSE (f.scope = r.scope OR starts_with(f.scope, r.scope || '/')) AND (r.name IS NULL OR f.name GLOB r.name) END)))"""


@query(f"WITH {E.CHANGE_SQL}, {_FIRED} SELECT id, kind, scope, name, requirement, origin FROM fired")
def obligations_fired(s, d):
    """A table of rules, one for each customer and supplier, against all that differs between two snapshots."""
    rules = E.change_rules(s, d)
    best = B.effective(rules.where("origin = 'manual'"), rules.where("origin <> 'manual'"))
    return B.fired(best, E.change_facts(s, d)).select("id", "kind", "scope", "name", "requirement", "origin")


@query(f"WITH {E.CHANGE_SQL}, {_FIRED}, changed AS (SELECT DISTINCT 'user/' || user_id AS path FROM fact) SELECT id, requirement FROM fired WHERE NOT EXISTS (SELECT 1 FROM changed WHERE path = requirement OR path GLOB requirement)")
def obligations_unmet(s, d):
    rules = E.change_rules(s, d)
    best = B.effective(rules.where("origin = 'manual'"), rules.where("origin <> 'manual'"))
    facts = G.written(E.change_facts(s, d), "facts")
    changed = facts.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"))
    return B.unmet(B.fired(best, facts), changed).select("id", "requirement")


_TWO = f"""WITH RECURSIVE {E.ADVISED_SQL}, edge AS (SELECT caller, callee, true AS proven FROM call UNION ALL SELECT caller, callee, false FROM adv ANTI JOIN call USING (caller, callee)), start AS ({_BUSIEST}),
walk(node, proven, d) AS (SELECT node, p, 0 FROM start, (VALUES (true), (false)) AS m(p) UNION SELECT e.caller, w.proven, d + 1 FROM walk w JOIN edge e ON e.callee = w.node AND (e.proven OR NOT w.proven) WHERE d < {_DEPTH}),
reach AS (SELECT node, min(d) FILTER (NOT proven) AS distance, min(d) FILTER (proven) AS proven_distance FROM walk GROUP BY node)"""


def _edges(s, d) -> DataFrame:
    """Calls, and advice where no call says the same."""
    calls, advised = E.calls(s, d), E.advised_pairs(s, d)
    told = lambda df, proven, provenance: df.select("caller", "callee", F.lit(proven).alias("proven"), F.lit(provenance).alias("provenance"), F.lit("name" if proven else "heuristic").alias("resolution"))
    return told(calls, True, "deterministic").unionByName(told(advised.join(calls, ["caller", "callee"], "left_anti"), False, "advisory"))


@query(
    f"""{_TWO} SELECT r.node, CAST(r.distance AS BIGINT) AS distance, CAST(r.proven_distance AS BIGINT) AS proven_distance, r.proven_distance IS NULL AS advised_only, count(DISTINCT callee) AS n_via,
  string_agg(DISTINCT CASE WHEN proven THEN 'deterministic' ELSE 'advisory' END, ',' ORDER BY CASE WHEN proven THEN 'deterministic' ELSE 'advisory' END) AS provenance FROM reach r JOIN edge ON caller = r.node JOIN reach n ON n.node = callee AND n.distance = r.distance - 1
WHERE r.distance > 0 GROUP BY r.node, r.distance, r.proven_distance"""
)
def impact_two_distances(s, d):
    """How far what depends on the busiest user is, over all edges and over proven ones alone."""
    edges = G.written(_edges(s, d), "edges")
    reach = G.written(G.two_distances(edges, _busiest(edges.where("proven").select("caller", "callee"))), "reach")
    found = G.affected(reach, edges)
    return found.select("node", F.col("distance").cast("long").alias("distance"), F.col("proven_distance").cast("long").alias("proven_distance"), "advised_only", "n_via", F.array_join("provenance", ",").alias("provenance"))


@query(f"WITH {E.EDGE_SQL} SELECT * FROM edge")
def json_edges(s, d):
    """Calls in one JSON document an order, in eight shapes."""
    return A.edges_from_json(E.edge_documents(s, d), "/repo")[0]


@query(
    f"""WITH {E.EDGE_SQL} SELECT source, CAST(entry AS INTEGER) AS entry, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT source, NULL, 'unsupported-schema' FROM item WHERE key = 6 UNION ALL SELECT DISTINCT source, NULL, 'invalid-json' FROM item WHERE key = 7"""
)
def json_edges_left_out(s, d):
    return A.edges_from_json(E.edge_documents(s, d), "/repo")[1]


@query(
    f"""{_STORED}, asked AS (SELECT p_partkey AS id, p_brand || '.py' AS caller_path, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS caller_class, p_name AS caller_symbol, p_brand || '.py' AS callee_path, '' AS callee_class, p_name AS callee_symbol FROM part WHERE p_partkey % 20 = 0),
one AS (SELECT DISTINCT caller_path, caller_class, caller_symbol, callee_path, callee_class, callee_symbol FROM stored),
scored AS (SELECT a.id, one.*, 2 * CAST(one.caller_path = a.caller_path AND one.caller_class = a.caller_class AND one.caller_symbol = a.caller_symbol AS INTEGER) + 2 * CAST(one.callee_path = a.callee_path AND one.callee_class = a.callee_class AND one.callee_symbol = a.callee_symbol AS INTEGER) + 1 AS score
  FROM asked a JOIN one ON one.caller_path = a.caller_path OR one.callee_path = a.callee_path)
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, caller_path DESC, caller_class DESC, caller_symbol DESC, callee_path DESC, callee_class DESC, callee_symbol DESC) = 1"""
)
def repair_calls(s, d):
    """For a call of every twentieth part that no longer is, the stored call that shares most with it."""
    p = E.table(s, d, "part").where("p_partkey % 20 = 0")
    file = F.concat("p_brand", F.lit(".py"))
    ends = [file.alias("caller_path"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("caller_class"), F.col("p_name").alias("caller_symbol"), file.alias("callee_path"), F.lit("").alias("callee_class"), F.col("p_name").alias("callee_symbol")]
    return M.similar_calls(p.select(F.col("p_partkey").alias("id"), *ends), _stored(s, d))


@query()
def repair_symbols(s, d):
    """For the name of every twentieth part that no longer is, the most similar of all others; similarity is not SQL."""
    named = E.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("module"), F.substring_index("p_type", " ", 1).alias("kind"))
    return M.similar_symbols(named.where("id % 20 = 0"), named.where("id % 20 <> 0").drop("id"))


@query(
    f"""WITH reuse AS (SELECT p_brand AS module, p_partkey AS line, p_name AS name FROM part), {E.STORED_SQL}, row AS (
  SELECT 'symbols' AS section, row_number() OVER (ORDER BY module, line, name) AS rank, name AS first, count(*) OVER () AS total, 80 AS cap FROM reuse UNION ALL
  SELECT 'orders', row_number() OVER (ORDER BY o_orderdate, o_orderkey), CAST(o_orderkey AS VARCHAR), count(*) OVER (), 20 FROM orders UNION ALL
  SELECT 'nations', row_number() OVER (ORDER BY n_name), n_name, count(*) OVER (), 100 FROM nation)
SELECT section, CAST(rank AS INTEGER) AS rank, first, total, total > cap AS truncated FROM row WHERE rank <= cap"""
)
def context_lists(s, d):
    """Three lists of a pack with their caps and totals."""
    parts = [
        S.section("symbols", E.symbols(s, d).select(F.col("name").alias("first"), "module", "line"), ["module", "line", "first"], 80),
        S.section("orders", E.table(s, d, "orders").select(F.col("o_orderkey").alias("first"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day")), ["day", "first"], 20),
        S.section("nations", E.table(s, d, "nation").select(F.col("n_name").alias("first")), ["first"], 100),
    ]
    found = S.first_of_each(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return found.select("section", "rank", F.get_json_object("row", "$.first").alias("first"), "total", "truncated")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events),
f(user_id, k, event_id, used, n, fits) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM e
UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN n < 10 AND used + coalesce(size, 0) <= 600 THEN used + coalesce(size, 0) ELSE used END, CASE WHEN n < 10 AND used + coalesce(size, 0) <= 600 THEN n + 1 ELSE n END, n < 10 AND used + coalesce(size, 0) <= 600 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, CAST(n AS INTEGER) AS place, total - max(n) OVER (PARTITION BY user_id) AS more FROM f JOIN (SELECT DISTINCT user_id, total FROM e) USING (user_id) WHERE fits"""
)
def turn_budget(s, d):
    """Each user's events in order of time while they fit 10 lines and a sum of 600."""
    rows = E.table(s, d, "events").select("user_id", "event_id", "ts", F.floor("value").alias("size"))
    return BU.within(rows, "user_id", ["ts", "event_id"], "size", 10, 600).select("user_id", "event_id", "place", "more")


@query(
    """WITH RECURSIVE t AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 50 > 0 THEN c_custkey - 1 - c_custkey % 3 END AS parent FROM customer UNION ALL SELECT -1 - s_suppkey, -1 - xor(s_suppkey, 1) FROM supplier),
w(node, depth, path) AS (SELECT node, CAST(0 AS BIGINT), [node] FROM t WHERE parent IS NULL OR parent NOT IN (SELECT node FROM t) UNION ALL SELECT t.node, depth + 1, list_append(path, t.node) FROM w JOIN t ON t.parent = w.node)
SELECT node, row_number() OVER (ORDER BY path) AS place, depth FROM w"""
)
def tree_order(s, d):
    """Customers as trees, numbered before their children; suppliers in circles, which have no place."""
    c = E.table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 50 > 0, F.col("c_custkey") - 1 - F.col("c_custkey") % 3).alias("parent"))
    circles = E.table(s, d, "supplier").select((-1 - F.col("s_suppkey")).alias("node"), (-1 - F.col("s_suppkey").bitwiseXOR(F.lit(1))).alias("parent"))
    return G.preorder(c.unionByName(circles))
