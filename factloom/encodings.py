"""Fact relations read out of the synthetic tables, for the driver's queries, with the same in SQL.

The tables hold no repository facts, so each operator is applied to a relation of the shape it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUT = "2024-01-16 00:00:00"
LANGUAGES = ("en", "fr")
RULES = [("AFRICA", "ASIA"), ("AFRICA", "EUROPE"), ("AMERICA", "ASIA"), ("EUROPE", "MIDDLE EAST"), ("ASIA", "AMERICA")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """path: addresses of pages without scheme, query and fragment."""
    return table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()


def units(spark: SparkSession, d: str) -> DataFrame:
    """id, prefix: every host but mobile ones, and two of its languages."""
    hosts = artifacts(spark, d).select(F.substring_index("path", "/", 1).alias("h")).where("not startswith(h, 'm.')").distinct()
    ids = hosts.select(F.explode(F.array("h", *[F.concat("h", F.lit(f"/{x}")) for x in LANGUAGES])).alias("id"))
    return ids.select("id", F.col("id").alias("prefix"))


ARTIFACT_SQL = "artifact AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
UNIT_SQL = (
    ARTIFACT_SQL
    + ", host AS (SELECT DISTINCT split_part(path, '/', 1) AS h FROM artifact WHERE NOT starts_with(path, 'm.'))"
    + ", unit AS (SELECT h AS id, h AS prefix FROM host UNION SELECT h || '/' || l, h || '/' || l FROM host, (VALUES ('en'), ('fr')) AS t(l))"
)


def deprecated(spark: SparkSession, d: str) -> DataFrame:
    """id, prefix: two more languages of every host, and whole hosts that begin with th."""
    hosts = units(spark, d).select(F.substring_index("id", "/", 1).alias("h")).distinct()
    ids = hosts.select(F.explode(F.array(F.concat("h", F.lit("/de")), F.concat("h", F.lit("/es")), F.when(F.col("h").startswith("th"), F.col("h")))).alias("prefix")).where("prefix is not null")
    return ids.select(F.concat(F.lit("dep-"), "prefix").alias("id"), "prefix")


DEPRECATED_SQL = UNIT_SQL + ", dep AS (SELECT 'dep-' || p AS id, p AS prefix FROM (SELECT h || '/de' AS p FROM host UNION SELECT h || '/es' FROM host UNION SELECT h FROM host WHERE starts_with(h, 'th')))"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """module, name, kind, line: the parts."""
    return table(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("line"))


def imports(spark: SparkSession, d: str) -> DataFrame:
    """module (a customer's region/nation), target (a supplier's), target_path (null: external), line."""
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations
    place = nation.select("n_nationkey", "r_name", F.concat("r_name", F.lit("/"), "n_name").alias("place"))
    item = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).drop("n")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    own = joined.join(place.select(F.col("n_nationkey").alias("c_nationkey"), F.col("place").alias("module")), "c_nationkey").join(place.select(F.col("n_nationkey").alias("s_nationkey"), F.col("place").alias("target")), "s_nationkey")
    return own.select("module", "target", F.when(F.col("s_acctbal") >= 0, F.col("target")).alias("target_path"), F.col("l_orderkey").alias("line"))


IMPORT_SQL = """place AS (SELECT n_nationkey, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
edge AS (SELECT a.place AS module, b.place AS target, CASE WHEN s_acctbal >= 0 THEN b.place END AS target_path, l_orderkey AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN place a ON a.n_nationkey = c_nationkey JOIN place b ON b.n_nationkey = s_nationkey)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee: users of consecutive events of a day, where the first is a costly error."""
    from pyspark.sql import Window as W

    next_user = F.lead("user_id").over(W.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    pairs = table(spark, d, "events").select("event_type", "value", F.col("user_id").alias("caller"), next_user.alias("callee"))
    return pairs.where("event_type = 'error' and value >= 60 and callee is not null").select("caller", "callee").distinct()


CALL_SQL = """pair AS (SELECT event_type, value, user_id AS caller, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS callee FROM events),
call AS (SELECT DISTINCT caller, callee FROM pair WHERE event_type = 'error' AND value >= 60 AND callee IS NOT NULL)"""


def stored_calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (the parts, their files spelled in several ways), edges (a part and the part numbered like its supplier), known files."""
    part = table(spark, d, "part")
    file, size = F.concat("p_brand", F.lit(".py")), F.col("p_size")
    spelled = F.when(size > 40, F.concat(F.lit("file:///repo/"), file)).when(size <= 10, F.concat(F.lit("./"), file)).when(size == 20, F.concat(F.lit("/elsewhere/"), file)).when(size == 21, "../up.py").otherwise(file)
    nodes = part.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("::"), "p_name").alias("qualified_name"), F.when(size % 2 == 0, "method").otherwise("function").alias("kind"), F.col("p_name").alias("name"), spelled.alias("file_path"))
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    kind = F.when(flag == "R", "calls").when(flag == "A", "instantiates").otherwise("references")
    line = F.when(number == 1, "x").when(number == 2, "-3").otherwise(number.cast("string"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("kind"), line.alias("line"), F.when(F.col("l_linestatus") == "F", "stored").alias("provenance"))
    return nodes, edges, part.where("not endswith(p_brand, '5')").select(file.alias("path")).distinct()


STORED_SQL = """node AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS class, p_brand || '.py' AS path FROM part WHERE p_size NOT IN (20, 21)),
edge AS (SELECT l_partkey AS source, l_suppkey AS target, CASE l_returnflag WHEN 'R' THEN 'calls' ELSE 'instantiates' END || CASE l_linestatus WHEN 'F' THEN ':stored' ELSE '' END AS resolution,
  CASE WHEN l_linenumber <= 2 THEN 0 ELSE CAST(l_linenumber AS INTEGER) END AS line FROM lineitem WHERE l_returnflag IN ('R', 'A')),
file AS (SELECT DISTINCT p_brand || '.py' AS path FROM part WHERE p_brand NOT LIKE '%5')"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """user_id, event_type, k before and after a moment."""
    keys = table(spark, d, "events").select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    cut = F.lit(CUT).cast("timestamp")
    return keys.where(F.col("ts") < cut).drop("ts"), keys.where(F.col("ts") >= cut).drop("ts")


SNAPSHOT_SQL = f"""base AS (SELECT DISTINCT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts < TIMESTAMP '{CUT}'),
head AS (SELECT DISTINCT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts >= TIMESTAMP '{CUT}')"""


def link_claims(spark: SparkSession, d: str) -> DataFrame:
    """source, pos (from 1), path of every link of every page."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, d, "pages").select(F.col("page_id").alias("source"), F.posexplode(found).alias("p", "path")).select("source", (F.col("p") + 1).cast("long").alias("pos"), "path")


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """path: what a link may point to: a slash and the first path component of an artifact."""
    first = F.split("path", "/")[1]
    return artifacts(spark, d).where(F.instr("path", "/") > 0).select(F.concat(F.lit("/"), first).alias("path")).distinct()


LINK_SQL = (
    ARTIFACT_SQL
    + """, there AS (SELECT DISTINCT '/' || split_part(path, '/', 2) AS path FROM artifact WHERE contains(path, '/')),
found AS (SELECT page_id AS source, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages),
link AS (SELECT source, i AS pos, l[i] AS path FROM (SELECT source, l, unnest(range(1, len(l) + 1)) AS i FROM found))"""
)


def change_facts(spark: SparkSession, d: str) -> DataFrame:
    """family, scope, name, call_key of what differs between the snapshots: errors are calls of a user to a number, all others symbols."""
    base, head = snapshots(spark, d)
    both = base.select("*", F.lit("removed").alias("op")).distinct().unionByName(head.select("*", F.lit("added").alias("op")).distinct())
    own = both.groupBy("user_id", "event_type", "k").agg(F.min("op").alias("op"), F.count("*").alias("n")).where("n = 1")
    call = F.col("event_type") == "error"
    folder = F.concat_ws("/", F.lit("src"), "event_type", (F.col("user_id") % 10).cast("string"), F.col("user_id").cast("string"))
    key = F.concat_ws("\x00", folder, F.lit(""), F.lit("f"), F.concat(F.lit("k/"), F.col("k").cast("string")), F.lit(""), F.lit("g"))
    return own.select(F.concat_ws("_", F.when(call, "call").otherwise("symbol"), "op").alias("family"), folder.alias("scope"), F.col("k").cast("string").alias("name"), F.when(call, key).alias("call_key"), "user_id")


def change_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each customer (manual) and supplier (derived), of every shape: scopes at four depths, any name, literal names, globs and exact calls."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.lit("manual").alias("origin")).union(table(spark, d, "supplier").select(F.col("s_suppkey"), F.lit("live_doc_anchor")))
    n = F.col("n")
    kind = F.element_at(F.array(*map(F.lit, ("symbol_added", "symbol_removed", "call_added", "call_removed"))), (n % 4 + 1).cast("int"))
    event = F.when(n % 4 >= 2, "error").otherwise(F.element_at(F.array(*map(F.lit, ("click", "purchase", "view"))), (n % 3 + 1).cast("int")))
    folder = F.concat_ws("/", F.lit("src"), event, (n % 10).cast("string"), n.cast("string"))
    scope = F.when(n % 97 == 0, "src").when(n % 31 == 0, F.concat_ws("/", F.lit("src"), event)).when(n % 11 == 0, F.concat_ws("/", F.lit("src"), event, (n % 10).cast("string"))).otherwise(folder)
    name = F.when(n % 7 == 0, F.lit(None)).when(n % 7 == 1, (n % 100).cast("string")).when(n % 7 == 2, F.concat(F.lit("[!0-4]*"), (n % 10).cast("string"))).otherwise(F.concat(F.lit("?"), (n % 10).cast("string"), F.lit("*")))
    key = F.when((n % 4 >= 2) & (n % 5 == 0), F.concat_ws("\x00", folder, F.lit(""), F.lit("f"), F.concat(F.lit("k/"), (n % 100).cast("string")), F.lit(""), F.lit("g")))
    requirement = F.when(n % 3 == 0, F.concat(F.lit("user/"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("user/"), F.floor(n / 10).cast("string"), F.lit("?"))).otherwise(F.concat(F.lit("*/"), (n % 1000).cast("string"), F.lit("[13579]")))
    return c.select(F.concat_ws("-", "origin", n.cast("string")).alias("id"), kind.alias("kind"), scope.alias("scope"), name.alias("name"), key.alias("call_key"), requirement.alias("requirement"), "origin", n.cast("long").alias("ord"))


CHANGE_SQL = (
    SNAPSHOT_SQL
    + """, own AS (SELECT *, 'added' AS op FROM (SELECT * FROM head EXCEPT SELECT * FROM base) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM base EXCEPT SELECT * FROM head)),
fact AS (SELECT (CASE event_type WHEN 'error' THEN 'call_' ELSE 'symbol_' END) || op AS family, 'src/' || event_type || '/' || user_id % 10 || '/' || user_id AS scope, CAST(k AS VARCHAR) AS name, user_id,
  CASE event_type WHEN 'error' THEN 'src/error/' || user_id % 10 || '/' || user_id || ' ' || k END AS call_key FROM own),
num AS (SELECT c_custkey AS n, 'manual' AS origin FROM customer UNION ALL SELECT s_suppkey, 'live_doc_anchor' FROM supplier),
event AS (SELECT n, origin, CASE WHEN n % 4 >= 2 THEN 'error' ELSE (['click', 'purchase', 'view'])[n % 3 + 1] END AS ev FROM num),
rule AS (SELECT origin || '-' || n AS id, origin, n, (['symbol_added', 'symbol_removed', 'call_added', 'call_removed'])[n % 4 + 1] AS kind,
  CASE WHEN n % 97 = 0 THEN 'src' WHEN n % 31 = 0 THEN 'src/' || ev WHEN n % 11 = 0 THEN 'src/' || ev || '/' || n % 10 ELSE 'src/' || ev || '/' || n % 10 || '/' || n END AS scope,
  CASE n % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(n % 100 AS VARCHAR) WHEN 2 THEN '[!0-4]*' || n % 10 ELSE '?' || n % 10 || '*' END AS name,
  CASE WHEN n % 4 >= 2 AND n % 5 = 0 THEN 'src/' || ev || '/' || n % 10 || '/' || n || ' ' || n % 100 END AS call_key,
  CASE n % 3 WHEN 0 THEN 'user/' || n WHEN 1 THEN 'user/' || n // 10 || '?' ELSE '*/' || n % 1000 || '[13579]' END AS requirement FROM event)"""
)


def advised_pairs(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee: users of consecutive events of a day, where the first is a costly purchase; advice beside ``calls``."""
    from pyspark.sql import Window as W

    next_user = F.lead("user_id").over(W.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    pairs = table(spark, d, "events").select("event_type", "value", F.col("user_id").alias("caller"), next_user.alias("callee"))
    return pairs.where("event_type = 'purchase' and value >= 80 and callee is not null").select("caller", "callee").distinct()


ADVISED_SQL = CALL_SQL + ", adv AS (SELECT DISTINCT caller, callee FROM pair WHERE event_type = 'purchase' AND value >= 80 AND callee IS NOT NULL)"


def edge_documents(spark: SparkSession, d: str) -> DataFrame:
    """source, payload: each order as a JSON document of its items as calls, in all shapes, some of them broken."""
    item = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    n, part, other = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    path = lambda c: F.when(c % 50 == 0, F.concat(F.lit("/elsewhere/p"), c.cast("string"), F.lit(".py"))).when(c % 3 == 0, F.concat(F.lit("file:///repo/p"), c.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("./p"), c.cast("string"), F.lit(".py")))
    name = lambda c: F.when(c % 13 != 0, F.concat(F.lit("f"), (c % 7).cast("string")))
    owner = F.when(part % 2 == 0, F.concat(F.lit("C"), (part % 5).cast("string")))
    nested = F.to_json(F.struct(F.struct(path(part).alias("file"), name(part).alias("name"), owner.alias("cls"), n.cast("string").alias("line")).alias("caller"), F.struct(path(other).alias("path"), name(other).alias("symbol")).alias("callee"), F.col("l_returnflag").alias("kind")))
    snake = F.to_json(F.struct(path(part).alias("caller_path"), name(part).alias("caller_function"), owner.alias("caller_class"), n.alias("caller_line"), path(other).alias("callee_file"), name(other).alias("callee_name"), F.col("l_returnflag").alias("type")))
    camel = F.to_json(F.struct(path(part).alias("callerPath"), name(part).alias("callerSymbol"), owner.alias("callerClass"), n.alias("callerLine"), path(other).alias("calleeFile"), name(other).alias("calleeName"), F.lit(" ").alias("resolution")))
    edge = F.when(n == 5, "7").when(n % 2 == 1, nested).when(n == 2, snake).otherwise(camel)
    listed = item.select(F.col("l_orderkey").alias("source"), F.struct(n.alias("n"), part.alias("p"), other.alias("s"), edge.alias("edge")).alias("e")).groupBy("source").agg(F.sort_array(F.collect_list("e")).alias("e"))
    array = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["edge"]), ","), F.lit("]"))
    under_ = lambda k: F.concat(F.lit('{"nodes":[],"' + k + '":'), array, F.lit("}"))
    key = F.col("source") % 8
    shapes = F.when(key == 0, array).when(key == 1, under_("edges")).when(key == 2, under_("calls")).when(key == 3, under_("callEdges")).when(key == 4, under_("links")).when(key == 5, F.concat(F.lit('{"edges":1,"graph":'), under_("edges"), F.lit("}"))).when(key == 6, under_("items")).otherwise(F.substring(array, 2, 1000000))
    return listed.select(F.col("source").cast("string").alias("source"), shapes.alias("payload"))


EDGE_SQL = """item AS (SELECT CAST(l_orderkey AS VARCHAR) AS source, l_orderkey % 8 AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS entry, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag FROM lineitem),
judged AS (SELECT *, CASE WHEN n = 5 THEN 'not-object' WHEN p % 50 = 0 THEN 'caller outside-repo' WHEN p % 13 = 0 THEN 'caller missing-symbol' WHEN s % 50 = 0 THEN 'callee outside-repo' WHEN s % 13 = 0 THEN 'callee missing-symbol' END AS reason FROM item WHERE key < 6),
edge AS (SELECT source, 'p' || p || '.py' AS caller_path, CASE WHEN p % 2 = 0 THEN 'C' || p % 5 ELSE '' END AS caller_class, 'f' || p % 7 AS caller_symbol, 'p' || s || '.py' AS callee_path, '' AS callee_class, 'f' || s % 7 AS callee_symbol,
  CASE WHEN n % 2 = 1 OR n = 2 THEN flag ELSE 'heuristic' END AS resolution, CAST(arg_min(n, entry) AS INTEGER) AS line FROM judged WHERE reason IS NULL GROUP BY ALL)"""
