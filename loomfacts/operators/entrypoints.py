"""Entry points: roots, trust boundaries and dispatch edges, and the validation of facts from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sources of untrusted data of each kind of entry point.
BOUNDARIES: dict[str, tuple[str, ...]] = {
    "middleware": ("request_body", "request_header", "query_string"), "mcp_tool": ("mcp_arguments",), "mcp_prompt": ("mcp_arguments",), "mcp_resource": ("mcp_resource_uri",), "cli_command": ("cli_args", "cli_flags"), "test": (),
    "job": ("queue_payload",), "queue_consumer": ("queue_payload",),
}
BODY_METHODS = ("POST", "PUT", "PATCH", "DELETE")
DISPATCH = {"http_route": "route", "middleware": "middleware", "mcp_tool": "mcp", "mcp_prompt": "mcp", "mcp_resource": "mcp", "test": "test", "cli_command": "route", "job": "job", "queue_consumer": "queue"}


def trust_boundaries(entrypoints: DataFrame) -> DataFrame:
    """One row for each source of untrusted data of each entry point (kind, method, path): entrypoint, source.

    A route has path parameters if its path has any (``/:x`` or ``/{x}``), a body for methods that carry one (or an
    unknown method), always the query string and headers. Unknown kinds have the source unknown.
    """
    has_param = F.coalesce(F.col("path").rlike(r"/:|/\{[^}]*\}"), F.lit(False))
    has_body = F.col("method").isNull() | F.upper("method").isin(*BODY_METHODS)
    route = F.filter(F.array(F.when(has_param, "path_param"), F.lit("query_string"), F.when(has_body, "request_body"), F.lit("request_header")), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    sources = F.when(F.col("kind") == "http_route", route)
    for kind, names in BOUNDARIES.items():
        sources = sources.when(F.col("kind") == kind, F.array(*[F.lit(n) for n in names]) if names else none)
    return entrypoints.select("entrypoint", F.explode(sources.otherwise(F.array(F.lit("unknown")))).alias("source"))


def dispatch_edges(entrypoints: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in DISPATCH.items()], F.lit("lifecycle"))
    return entrypoints.select("entrypoint", "function", kind.alias("edge_kind"))


def roots(functions: DataFrame, packages: DataFrame, entrypoints: DataFrame | None = None, configured: list[str] = ()) -> DataFrame:
    """Reachability roots: function key (file, name), kind and precision; the first kind of a function in order holds.

    Go: ``main`` in package main, ``init`` in any package, exported functions; scripts: exported functions only;
    functions of entry points; configured names (whole, or the last dotted segment).
    """
    f = functions.join(packages.select("id", F.col("name").alias("package")), "id", "left")
    go = F.col("language") == "go"
    rows = [f.where(go & (F.col("name") == "main") & (F.col("package") == "main")).withColumn("kind", F.lit("go_main")), f.where(go & (F.col("name") == "init")).withColumn("kind", F.lit("go_init")), f.where(F.col("is_exported") & ~F.col("is_test")).withColumn("kind", F.when(go, "go_exported").otherwise("script_exported"))]
    if entrypoints is not None:
        rows.append(f.join(entrypoints.select("id", F.col("function").alias("name")).distinct(), ["id", "name"], "left_semi").withColumn("kind", F.lit("entrypoint")))
    if configured:
        wanted = F.lit(False)
        for c in configured:
            wanted = wanted | (F.col("name") == c.rpartition(".")[2])
        rows.append(f.where(wanted).withColumn("kind", F.lit("configured")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    order = F.array_position(F.array(*[F.lit(k) for k in ("go_main", "go_init", "entrypoint", "configured", "go_exported", "script_exported")]), F.col("kind"))
    precision = F.when(F.col("kind") == "script_exported", "setup_aware").otherwise("resolved_static")
    return out.groupBy("id", "name").agg(F.min_by("kind", order).alias("kind")).withColumn("precision", precision)


def validate_models(models: DataFrame, known: DataFrame, broad: tuple[str, ...] = ("*", "**", ".*")) -> DataFrame:
    """Adds reason: the first that rejects a model fact (source, target, scope, evidence), null if it is accepted.

    known (key) are the names that sources and targets may have. Order: empty source, empty target, empty scope, empty
    evidence, broad source, broad target, unknown source, unknown target.
    """
    def empty(c: str) -> Column:
        return F.coalesce(F.trim(c) == "", F.lit(True))

    k = known.select("key").distinct()
    x = models.join(k.select(F.col("key").alias("source"), F.lit(1).alias("__s")), "source", "left").join(k.select(F.col("key").alias("target"), F.lit(1).alias("__t")), "target", "left")
    reason = (
        F.when(empty("source"), "empty_source").when(empty("target"), "empty_target").when(empty("scope"), "empty_scope").when(F.coalesce(F.size("evidence") <= 0, F.lit(True)), "empty_evidence")
        .when(F.col("source").isin(*broad), "broad_source").when(F.col("target").isin(*broad), "broad_target").when(F.col("__s").isNull(), "unknown_source").when(F.col("__t").isNull(), "unknown_target")
    )
    return x.select(*models.columns, reason.alias("reason"))


def topology_overlays(files: DataFrame) -> DataFrame:
    """Overlays by path convention: owners files, generated, test and vendored sets, internal and deployment folders."""
    p = F.col("relative_path")
    rules = {"codeowners": r"(?:^|/)CODEOWNERS$", "generated": r"(?:^|/)__generated__/|[._](?:gen|generated|pb)\.[a-z]+$", "tests": r"_test\.go$|\.(?:test|spec)\.[cm]?[jt]sx?$|(?:^|/)(?:tests?|__tests__)/", "vendored": r"(?:^|/)(?:vendor|node_modules|third_party)/", "internal": r"(?:^|/)internal/", "deploy": r"(?:^|/)(?:deploy|k8s|helm|terraform)/"}
    kinds = F.filter(F.array(*[F.when(p.rlike(r), F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())
    return files.select("repo_id", "relative_path", F.explode(kinds).alias("overlay")).distinct()
