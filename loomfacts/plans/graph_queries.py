"""Queries with recursion, and policy and stream queries over events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fixpoint as G
from ..operators import policy as P
from ..operators.control_flow import control_flow
from ..operators.ordered import ordered_neighbours
from ..session import materialise, maybe_broadcast, table
from ..streaming import events as S

Query = Callable[[SparkSession, str], DataFrame]


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "report_snapshots").dropDuplicates(["snapshot_id"]).select("series_id", "snapshot_id", "taken_at", "status", "tool_version")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_neighbours(_snapshots(spark, sf_dir), "series_id", ["taken_at", "snapshot_id"], "snapshot_id")


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges from each snapshot to the next of its series, with the status of the next; first snapshots; all snapshots."""
    s = _steps(spark, sf_dir)
    edges = s.where("prev is not null").select(F.col("prev").alias("src"), F.col("snapshot_id").alias("dst"), "status")
    return edges, s.where("prev is null").select(F.col("snapshot_id").alias("node")), s


def _chain_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, first, _ = _chain(spark, sf_dir)
    return G.reachable(edges, first)


def _chain_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, _ = _chain(spark, sf_dir)
    return G.closure_with_worst(edges.withColumn("trust", (F.col("status") == "aborted").cast("int")), "trust")


def _chain_chop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, first, s = _chain(spark, sf_dir)
    return G.chop(edges, first, s.where("status = 'aborted'").select(F.col("snapshot_id").alias("node")))


def _chain_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, first, _ = _chain(spark, sf_dir)
    found = G.bounded_paths(edges, first, F.col("status") == "aborted", 6, None, F.col("status") == "complete")
    return found.select("root", "depth", F.array_join("path", ">").alias("path"), "status")


def _chain_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, s = _chain(spark, sf_dir)
    changes = s.where("status = 'aborted'").select(F.col("snapshot_id").alias("node"), F.lit("recompute").alias("action"))
    return G.invalidate(s.select(F.col("snapshot_id").alias("node")), edges.select(F.col("dst").alias("node"), F.col("src").alias("input")), changes)


def _chain_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, s = _chain(spark, sf_dir)
    return G.points_to(s.select(F.col("snapshot_id").alias("variable"), F.col("tool_version").alias("object")), edges)


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and of the suppliers of what they ordered, with the number of items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    x = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(maybe_broadcast(customers.select("c_custkey", F.col("c_nationkey").alias("src"))), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(maybe_broadcast(suppliers.select("s_suppkey", F.col("s_nationkey").alias("dst"))), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("items"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the week of their user (function) and the type of the event before and after in it."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null and event_type is not null")
    week = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    return ordered_neighbours(e.select(week.alias("function"), "ts", "event_id", "event_type"), "function", ["ts", "event_id"], "event_type")


def _journeys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph for each week of each user: function, src, dst for types that follow each other; function, entry, exit."""
    v = materialise(_visits(spark, sf_dir), "visits")
    ends = v.groupBy("function").agg(F.max(F.when(F.col("prev").isNull(), F.col("event_type"))).alias("entry"), F.max(F.when(F.col("next").isNull(), F.col("event_type"))).alias("exit"))
    return v.where("next is not null").select("function", F.col("event_type").alias("src"), F.col("next").alias("dst")).distinct(), ends


def _journey_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weeks as one graph, which grows with the events: nodes are week and type."""
    e, _ = _journeys(spark, sf_dir)
    return e.select(F.concat_ws(":", "function", "src").alias("src"), F.concat_ws(":", "function", "dst").alias("dst"))


def _journey_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialise(_journey_edges(spark, sf_dir), "journeys")
    return G.reachable(e, e.select(F.col("src").alias("node")), include_start_on_cycle=True).select("start", "node")


def _journey_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialise(_journey_edges(spark, sf_dir), "journeys")
    return G.reachable(e, e.select(F.col("src").alias("node")), most_depth=4)


def _journey_flow(view: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, ends = _journeys(spark, sf_dir)
        return control_flow(e, ends.select("function", "entry"), view)

    return run


def _series_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series joined by fingerprints they share."""
    d = table(spark, sf_dir, "report_diagnostics").where("stable_fingerprint is not null")
    e = d.select(F.concat(F.lit("a"), F.lpad(F.col("series_id").cast("string"), 9, "0")).alias("src"), F.concat(F.lit("f"), "stable_fingerprint").alias("dst")).distinct()
    c = G.components(e).where(F.col("node").startswith("a"))
    return c.select(F.substring("node", 2, 9).cast("long").alias("series_id"), F.substring("component", 2, 9).cast("long").alias("component"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "suites").select("suite_id", F.explode("languages").alias("language"))


def _alias_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of the suites that have a tier."""
    asked = table(spark, sf_dir, "suites").where("tier is not null").select(F.col("suite_id").alias("variable"))
    return G.alias_pairs(_languages(spark, sf_dir), "suite_id", "language", asked)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.unix_micros("ts").alias("position"), F.col("event_type").alias("name"))


def _policy(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_events(spark, sf_dir))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window("ts", "2 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_stream(spark, f"{sf_dir}/events.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


def _stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available(S.windowed_counts(_stream(spark, sf_dir)).select(F.col("w.start").alias("day"), "event_type", "events"), "update", ("day", "event_type"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "events")


def _stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _stream(spark, sf_dir).select(F.col("user_id").alias("scope"), F.unix_micros("ts").alias("position"), F.col("event_type").alias("name"))
    return S.run_available(S.missing_guard_stream(x, "purchase", "signup"), "append")


QUERIES: dict[str, Query] = {
    "gr_chain_reach": _chain_reach,
    "gr_chain_worst": _chain_worst,
    "gr_chain_chop": _chain_chop,
    "gr_chain_forbidden": _chain_forbidden,
    "gr_chain_invalidate": _chain_invalidate,
    "gr_chain_points_to": _chain_points_to,
    "gr_trade_edges": _trade,
    "gr_journey_edges": _journey_edges,
    "gr_journey_reach": _journey_reach,
    "gr_journey_depth": _journey_depth,
    "gr_journey_scc": lambda s, p: G.strong_components(_journey_edges(s, p)),
    "gr_journey_schedule": lambda s, p: G.call_schedule(materialise(_journey_edges(s, p), "journeys")),
    "gr_journey_components": lambda s, p: G.components(_journey_edges(s, p)),
    "gr_journey_dominators": _journey_flow("dominators"),
    "gr_journey_reachable_blocks": _journey_flow("reachable"),
    "gr_journey_postdominators": _journey_flow("postdominators"),
    "gr_journey_control_dependence": _journey_flow("dependence"),
    "gr_series_components": _series_components,
    "gr_alias_suites": _alias_suites,
    "gr_alias_links": lambda s, p: G.alias_links(_languages(s, p), "suite_id", "language"),
    "pol_events_matching": _policy(lambda e: P.events_matching(e, P.EventPattern.call("purchase"))),
    "pol_missing_guard": _policy(lambda e: P.missing_guard(e, P.GuardQuery(P.EventPattern.call("purchase"), P.GuardPattern.call_any("signup")))),
    "pol_missing_cleanup": _policy(lambda e: P.missing_cleanup(e, P.LifecycleQuery(P.EventPattern.call("error"), P.EventPattern.call("view")))),
    "pol_forbidden_flow": _policy(lambda e: P.forbidden_flow(e, P.FlowQuery(P.EventPattern.call("signup"), P.EventPattern.call("error"), P.BarrierPattern.call_any("view"), 8))),
    "pol_transitions": _policy(P.transitions),
    "pol_sessions": _sessions,
    "st_windowed_counts": _stream_counts,
    "st_missing_guard": _stream_guard,
}

_S = """s AS (SELECT series_id, snapshot_id, taken_at, status, tool_version, lag(snapshot_id) OVER (PARTITION BY series_id ORDER BY taken_at, snapshot_id) AS prev FROM (SELECT DISTINCT series_id, snapshot_id, taken_at, status, tool_version FROM report_snapshots)),
e AS (SELECT prev AS src, snapshot_id AS dst, status FROM s WHERE prev IS NOT NULL)"""
_V = """v0 AS (SELECT user_id || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS function, ts, event_id, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
v1 AS (SELECT *, lag(event_type) OVER w AS prev, lead(event_type) OVER w AS next FROM v0 WINDOW w AS (PARTITION BY function ORDER BY ts, event_id)),
t AS (SELECT DISTINCT function, event_type AS src, next AS dst FROM v1 WHERE next IS NOT NULL), en AS (SELECT function, event_type AS entry FROM v1 WHERE prev IS NULL AND function IN (SELECT function FROM t)), ex AS (SELECT function, event_type AS exit FROM v1 WHERE next IS NULL)"""
_J = f"{_V}, j AS (SELECT function || ':' || src AS src, function || ':' || dst AS dst FROM t)"
_R = "r AS (SELECT src AS start, dst AS node FROM j UNION SELECT start, dst FROM r JOIN j ON node = src)"
_N = "n AS (SELECT function, src AS node FROM t UNION SELECT function, dst FROM t)"
_M = "m AS (SELECT src AS node FROM j UNION SELECT dst FROM j)"
_PD = """noend AS (SELECT function, node FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.function = n.function AND t.src = n.node)), ends AS (SELECT * FROM noend UNION SELECT function, max(node) FROM n WHERE function NOT IN (SELECT function FROM noend) GROUP BY 1),
f AS (SELECT function, node FROM ends UNION SELECT f.function, src FROM f JOIN t ON t.function = f.function AND node = dst), w AS (SELECT g.function, g.node AS gone, e.node FROM n g JOIN ends e ON g.function = e.function AND g.node <> e.node UNION SELECT w.function, gone, src FROM w JOIN t ON w.function = t.function AND node = dst WHERE src <> gone),
d AS (SELECT a.function, a.node AS block, b.node AS other FROM f a JOIN f b ON a.function = b.function WHERE a.node = b.node OR NOT EXISTS (SELECT 1 FROM w WHERE w.function = a.function AND w.gone = a.node AND w.node = b.node)), k AS (SELECT function, other, count(*) AS c FROM d GROUP BY 1, 2)"""
_IMM = "SELECT d.function, block, d.other, block <> d.other AND kb.c = ko.c - 1 AS immediate, 'present' AS status FROM d JOIN k kb ON kb.function = d.function AND kb.other = d.block JOIN k ko ON ko.function = d.function AND ko.other = d.other"
_E = "v AS (SELECT user_id AS scope, epoch_us(ts) AS position, event_type AS name FROM events)"

SQL = {
    "gr_chain_reach": f"WITH RECURSIVE {_S}, r AS (SELECT src AS start, dst AS node, 1 AS depth FROM e WHERE src IN (SELECT snapshot_id FROM s WHERE prev IS NULL) UNION ALL SELECT start, dst, depth + 1 FROM r JOIN e ON node = src) SELECT * FROM r",
    "gr_chain_worst": f"WITH RECURSIVE {_S}, r AS (SELECT src, dst, (status = 'aborted')::INT AS trust FROM e UNION ALL SELECT r.src, e.dst, greatest(trust, (status = 'aborted')::INT) FROM r JOIN e ON r.dst = e.src) SELECT * FROM r",
    "gr_chain_chop": f"""WITH RECURSIVE {_S}, f AS (SELECT snapshot_id AS node FROM s WHERE prev IS NULL UNION SELECT dst FROM f JOIN e ON node = src), b AS (SELECT snapshot_id AS node FROM s WHERE status = 'aborted' UNION SELECT src FROM b JOIN e ON node = dst)
        SELECT node FROM f INTERSECT SELECT node FROM b""",
    "gr_chain_forbidden": f"""WITH RECURSIVE {_S}, r AS (SELECT snapshot_id AS root, snapshot_id AS node, 0 AS depth, snapshot_id::VARCHAR AS path FROM s WHERE prev IS NULL UNION ALL SELECT root, dst, depth + 1, path || '>' || dst FROM r JOIN e ON node = src WHERE e.status = 'complete' AND depth < 5)
        SELECT root, depth + 1 AS depth, path || '>' || dst AS path, 'present' AS status FROM r JOIN e ON node = src WHERE e.status = 'aborted'""",
    "gr_chain_invalidate": f"WITH RECURSIVE {_S}, a AS (SELECT snapshot_id AS node FROM s WHERE status = 'aborted' UNION SELECT dst FROM a JOIN e ON node = src) SELECT snapshot_id AS node, CASE WHEN snapshot_id IN (SELECT node FROM a) THEN 'recompute' ELSE 'reuse' END AS action FROM s",
    "gr_chain_points_to": f"WITH RECURSIVE {_S}, p AS (SELECT snapshot_id AS variable, tool_version AS object FROM s WHERE tool_version IS NOT NULL UNION SELECT dst, object FROM p JOIN e ON variable = src) SELECT variable::VARCHAR AS variable, object FROM p",
    "gr_trade_edges": "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "gr_journey_edges": f"WITH {_J} SELECT * FROM j",
    "gr_journey_reach": f"WITH RECURSIVE {_J}, {_R} SELECT start, node FROM r",
    "gr_journey_depth": f"WITH RECURSIVE {_J}, d AS (SELECT src AS start, dst AS node, 1 AS depth FROM j UNION SELECT start, dst, depth + 1 FROM d JOIN j ON node = src WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM d WHERE start <> node GROUP BY 1, 2",
    "gr_journey_scc": f"WITH RECURSIVE {_J}, {_R}, {_M}, c AS (SELECT x.start AS node, min(x.node) AS c FROM r x JOIN r y ON y.start = x.node AND y.node = x.start GROUP BY 1) SELECT node, least(node, coalesce(c, node)) AS component FROM m LEFT JOIN c USING (node)",
    "gr_journey_schedule": f"""WITH RECURSIVE {_J}, {_R}, {_M}, c AS (SELECT x.start AS node, min(x.node) AS c FROM r x JOIN r y ON y.start = x.node AND y.node = x.start GROUP BY 1), s AS (SELECT node, least(node, coalesce(c, node)) AS component FROM m LEFT JOIN c USING (node)),
        g AS (SELECT DISTINCT a.component AS a, b.component AS b FROM j JOIN s a ON a.node = src JOIN s b ON b.node = dst WHERE a.component <> b.component), l AS (SELECT DISTINCT component, 0 AS level FROM s UNION SELECT a, level + 1 FROM l JOIN g ON component = b)
        SELECT node, s.component, max(level) AS level FROM s JOIN l ON l.component = s.component GROUP BY 1, 2""",
    "gr_journey_components": f"WITH RECURSIVE {_J}, {_M}, u AS (SELECT src AS a, dst AS b FROM j UNION SELECT dst, src FROM j), q AS (SELECT node, node AS other FROM m UNION SELECT node, b FROM q JOIN u ON other = a) SELECT node, min(other) AS component FROM q GROUP BY 1",
    "gr_journey_dominators": f"""WITH RECURSIVE {_V}, {_N}, f AS (SELECT function, entry AS node FROM en UNION SELECT f.function, dst FROM f JOIN t ON t.function = f.function AND node = src),
        w AS (SELECT n.function, n.node AS gone, entry AS node FROM n JOIN en ON en.function = n.function WHERE n.node <> entry UNION SELECT w.function, gone, dst FROM w JOIN t ON t.function = w.function AND node = src WHERE dst <> gone),
        d AS (SELECT a.function, a.node AS block, b.node AS other FROM f a JOIN f b ON a.function = b.function JOIN en ON en.function = a.function WHERE a.node = b.node OR a.node = entry OR NOT EXISTS (SELECT 1 FROM w WHERE w.function = a.function AND w.gone = a.node AND w.node = b.node)),
        k AS (SELECT function, other, count(*) AS c FROM d GROUP BY 1, 2) {_IMM}""",
    "gr_journey_postdominators": f"WITH RECURSIVE {_V}, {_N}, {_PD} {_IMM}",
    "gr_journey_control_dependence": f"""WITH RECURSIVE {_V}, {_N}, {_PD}, o AS (SELECT function, src, dst FROM t WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM d WHERE d.function = t.function AND d.block = dst AND d.other = src))
        SELECT DISTINCT function, src AS block, x AS other, TRUE AS immediate, 'present' AS status FROM (SELECT o.function, src, d.block AS x FROM o JOIN d ON d.function = o.function AND d.other = dst WHERE d.block = src OR NOT EXISTS (SELECT 1 FROM d z WHERE z.function = o.function AND z.block = d.block AND z.other = src)
        UNION SELECT function, src, dst FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.function = o.function AND f.node = dst))""",
    "gr_journey_reachable_blocks": f"WITH RECURSIVE {_V}, {_N}, f AS (SELECT function, entry AS node FROM en UNION SELECT f.function, dst FROM f JOIN t ON t.function = f.function AND node = src) SELECT function, node AS block, node AS other, (function, node) IN (SELECT function, node FROM f) AS immediate, 'present' AS status FROM n",
    "gr_series_components": """WITH RECURSIVE k AS (SELECT DISTINCT series_id AS s, stable_fingerprint AS f FROM report_diagnostics WHERE stable_fingerprint IS NOT NULL), shared AS (SELECT f FROM k GROUP BY f HAVING count(*) > 1),
        u AS (SELECT DISTINCT a.s AS a, b.s AS b FROM k a JOIN shared USING (f) JOIN k b USING (f) WHERE a.s <> b.s), q AS (SELECT DISTINCT s AS node, s AS other FROM k UNION SELECT node, b FROM q JOIN u ON other = a) SELECT node AS series_id, min(other) AS component FROM q GROUP BY 1""",
    "gr_alias_suites": """WITH x AS (SELECT suite_id AS v, tier, list_sort(list_distinct(languages)) AS s FROM suites), c AS (SELECT s, min(v) AS class, count(*) AS m, count(tier) AS asked FROM x WHERE len(s) > 0 GROUP BY s), y AS (SELECT class, asked, unnest(s) AS o FROM c)
        SELECT class AS "left", class AS "right", len(s) AS shared, CASE WHEN len(s) = 1 THEN 'must' ELSE 'may' END AS relation FROM c WHERE m > 1 AND asked > 0 UNION ALL SELECT a.class, b.class, count(*), 'may' FROM y a JOIN y b ON a.o = b.o AND a.class <> b.class WHERE a.asked > 0 GROUP BY 1, 2""",
    "gr_alias_links": """WITH x AS (SELECT suite_id AS v, list_sort(list_distinct(languages)) AS s FROM suites), c AS (SELECT s, min(v) AS class, count(*) AS members FROM x WHERE len(s) > 0 GROUP BY s) SELECT unnest(s) AS element, class, members, len(s)::INT AS size FROM c""",
    "pol_events_matching": f"WITH {_E} SELECT * FROM v WHERE name = 'purchase'",
    "pol_missing_guard": f"WITH {_E} SELECT * FROM v WHERE name = 'purchase' AND NOT EXISTS (SELECT 1 FROM v g WHERE g.scope = v.scope AND g.name = 'signup' AND g.position < v.position)",
    "pol_missing_cleanup": f"WITH {_E} SELECT * FROM v WHERE name = 'error' AND NOT EXISTS (SELECT 1 FROM v g WHERE g.scope = v.scope AND g.name = 'view' AND g.position > v.position)",
    "pol_forbidden_flow": f"""WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY position) AS k FROM v) SELECT a.scope, a.position AS source, b.position AS sink, b.k - a.k AS steps FROM o a JOIN o b ON a.scope = b.scope AND b.k > a.k AND b.k <= a.k + 8
        WHERE a.name = 'signup' AND b.name = 'error' AND NOT EXISTS (SELECT 1 FROM o c WHERE c.scope = a.scope AND c.k > a.k AND c.k < b.k AND c.name = 'view')""",
    "pol_transitions": f"WITH {_E} SELECT name, next, count(*) AS times FROM (SELECT name, lead(name) OVER (PARTITION BY scope ORDER BY position) AS next FROM v) WHERE next IS NOT NULL GROUP BY 1, 2",
    "pol_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a)
        SELECT user_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY user_id, g""",
    "st_windowed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "st_missing_guard": f"WITH {_E} SELECT scope, position FROM v WHERE name = 'purchase' AND NOT EXISTS (SELECT 1 FROM v g WHERE g.scope = v.scope AND g.name = 'signup' AND g.position < v.position)",
}
