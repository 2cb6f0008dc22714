"""Relations over the facts of ``syntax``: tables of declarations, call edges in tiers, flow edges, constraints, entry points.

Functions are named by a key, ``file:number`` (``file:-1`` is the module). All relations are joins and unions of narrow tables; joins by
name are inside a repository, and a name that several functions bear is counted first, so that a common name gives one
row of status ambiguous for a call, not all pairs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_segment
from ..session import materialise
from . import fixpoint as G
from .extract import resolved_imports, source_files
from .syntax import syntax_facts


def function_key() -> Column:
    return F.concat_ws(":", F.col("id").cast("string"), F.col("fn").cast("string"))


# What each framework calls to register a handler (the last part of the call, or with a dot its owner too).
GO_ROUTES = {"HandleFunc": None, "Handle": None, "Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE", "Head": "HEAD", "Options": "OPTIONS", "MethodFunc": None}
TS_ROUTES = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "all": None}
TS_ROUTERS = ("app", "router", "server", "api", "express", "fastify")
TS_TESTS = ("it", "test", "describe", "it.only", "test.only", "it.skip", "test.skip")
MCP = {"tool": "mcp_tool", "registerTool": "mcp_tool", "AddTool": "mcp_tool", "prompt": "mcp_prompt", "registerPrompt": "mcp_prompt", "AddPrompt": "mcp_prompt", "resource": "mcp_resource", "registerResource": "mcp_resource", "AddResource": "mcp_resource"}
MCP_OWNERS = ("server", "mcp", "mcpServer", "s", "srv")
JOBS = {"cron.schedule": "job", "c.AddFunc": "job", "cron.AddFunc": "job", "schedule.every": "job", "queue.process": "queue_consumer", "worker.process": "queue_consumer", "consumer.run": "queue_consumer", "channel.consume": "queue_consumer", "subscriber.Receive": "queue_consumer", "sub.Receive": "queue_consumer"}


class Facts:
    """All relations over one table of source files; the facts are extracted once."""

    def __init__(self, files: DataFrame, aliases: dict[str, str] | None = None) -> None:
        self.files, self.aliases = files, aliases

    @cached_property
    def rows(self) -> DataFrame:
        return materialise(syntax_facts(self.files), "facts")

    def of(self, *kinds: str) -> DataFrame:
        return self.rows.where(F.col("kind").isin(*kinds))

    @cached_property
    def functions(self) -> DataFrame:
        """key, id, language, fn, line, end_line, name, kind, owner, parameters, result, calls, complexity, line_count, is_exported, is_test."""
        a = self.of("function").select(function_key().alias("key"), "id", "language", "fn", "line", "name", F.col("detail").alias("kind"), F.col("extra").alias("owner"), F.col("items").alias("parameters"), F.col("num").alias("complexity"), F.col("yes").alias("is_exported"))
        b = self.of("function_span").select(function_key().alias("key"), F.col("detail").cast("int").alias("end_line"), F.col("extra").alias("result"), F.col("items").alias("calls"), F.col("num").alias("line_count"), F.col("yes").alias("is_test"))
        return a.join(b, "key")

    @cached_property
    def types(self) -> DataFrame:
        """id, line, name, kind (struct, interface, alias, named, class), generic, members, base, is_exported, is_component_like."""
        go = self.of("type").select("id", "line", "name", F.col("detail").alias("kind"), (F.col("extra") == "generic").alias("generic"), F.col("items").alias("members"), F.lit("").alias("base"), F.col("yes").alias("is_exported"), F.lit(False).alias("is_component_like"))
        ts = self.of("class").select("id", "line", "name", F.lit("class").alias("kind"), F.lit(False).alias("generic"), F.col("items").alias("members"), F.col("detail").alias("base"), F.col("yes").alias("is_exported"), (F.col("extra") == "component").alias("is_component_like"))
        return go.unionByName(ts)

    @cached_property
    def imports(self) -> DataFrame:
        return self.of("import").select("id", "language", "line", F.col("name").alias("path"), F.col("detail").alias("alias"), F.col("extra").alias("kind"), F.col("items").alias("names"))

    @cached_property
    def literals(self) -> DataFrame:
        return self.of("literal").select("id", "line", F.col("num").alias("position"), F.col("name").alias("value"), F.col("detail").alias("quote"), function_key().alias("function"))

    @cached_property
    def calls(self) -> DataFrame:
        """id, site (unique in the file), line, callee, kind (call, new, dynamic), arguments, function, is_wrapped (in throw, defer or go)."""
        return self.of("call").select("id", "language", F.col("num").alias("site"), "line", F.col("name").alias("callee"), F.col("detail").alias("kind"), F.col("items").alias("arguments"), function_key().alias("function"), F.col("yes").alias("is_wrapped"))

    @cached_property
    def branches(self) -> DataFrame:
        """One row for each edge of a branch: function, line, kind, condition, label, is_error_path, fingerprint."""
        b = self.of("branch").select("id", function_key().alias("function"), "line", F.col("name").alias("kind"), F.col("detail").alias("condition"), F.col("extra").alias("label"), F.col("num").alias("place"), F.col("yes").alias("is_error_path"))
        return b.withColumn("fingerprint", F.md5(F.concat_ws("\x1f", "function", "kind", "condition", "label", F.col("place").cast("string"))))

    @cached_property
    def tests(self) -> DataFrame:
        return self.of("test").select("id", function_key().alias("function"), "line", "name", F.col("detail").cast("int").alias("assertions"), F.col("extra").cast("int").alias("subtests"), F.col("num").alias("table_rows"), F.col("items").alias("evidence"), F.col("yes").alias("is_test"))

    @cached_property
    def blocks(self) -> DataFrame:
        """Edges between the basic blocks of each function (0 is the entry, 1 the exit): function, src, dst, label."""
        return self.of("edge").select(function_key().alias("function"), F.col("name").cast("int").alias("src"), F.col("detail").cast("int").alias("dst"), F.col("extra").alias("label"))

    @cached_property
    def operations(self) -> DataFrame:
        """The lowered operations: function, block, line, kind (assign, return, call, throw, branch, expression, store, load, alloc), target, operands, site."""
        ops = self.of("op").select(function_key().alias("function"), F.col("num").alias("block"), "line", "seq", F.col("detail").alias("kind"), F.col("name").alias("target"), F.col("items").alias("operands"), F.nullif(F.col("extra"), F.lit("")).cast("int").alias("site"))
        none = F.lit(None).cast("int")
        memory = self.of("store", "load", "alloc").select(function_key().alias("function"), F.col("num").alias("block"), "line", "seq", "kind", F.when(F.col("kind") == "store", F.concat_ws(".", "name", "detail")).otherwise(F.col("name")).alias("target"), F.when(F.col("kind") == "store", F.col("items")).when(F.col("kind") == "load", F.array(F.concat_ws(".", "detail", "extra"))).otherwise(F.array("detail")).alias("operands"), none.alias("site"))
        return ops.unionByName(memory)

    @cached_property
    def scopes(self) -> DataFrame:
        """Names bound in each function: function, name, binding (parameter, variable)."""
        p = self.functions.select(F.col("key").alias("function"), F.explode("parameters").alias("name"), F.lit("parameter").alias("binding"))
        v = self.operations.where("kind = 'assign'").select("function", F.col("target").alias("name"), F.lit("variable").alias("binding")).distinct()
        return p.unionByName(v.join(p.select("function", "name"), ["function", "name"], "left_anti"))

    @cached_property
    def symbols(self) -> DataFrame:
        """id, name, kind, owner, is_exported, line and stable_key of functions, methods, types and classes."""
        f = self.functions.where("fn >= 0").select("id", "name", "kind", "owner", "is_exported", "line")
        t = self.types.select("id", "name", "kind", F.lit("").alias("owner"), "is_exported", "line")
        return f.unionByName(t).withColumn("stable_key", F.concat_ws("#", F.col("id").cast("string"), "kind", "owner", "name"))

    @cached_property
    def _repos(self) -> DataFrame:
        return self.files.select("id", "repo_id").dropDuplicates(["id"])

    # Call edges, in tiers.

    @cached_property
    def direct_edges(self) -> DataFrame:
        """caller, callee (keys), id, site, tier, status, precision for calls that a name binds.

        lexical: a function of that name in the file; import: a function of that name in a file which an import binding that names it
        resolves to; name: the only function of that name in the repository. Dynamic calls and those that register a handler are left out.
        """
        registered = self.entrypoints.where("site is not null").select("id", "site").distinct()
        calls = self.calls.where("kind <> 'dynamic'").join(registered, ["id", "site"], "left_anti").select("id", "site", F.col("function").alias("caller"), "callee", last_segment(F.col("callee")).alias("last"))
        named = self.functions.where("fn >= 0").select("key", "id", "name", "owner")
        local = named.where("owner = ''").groupBy("id", F.col("name").alias("callee")).agg(F.min("key").alias("local"))
        bound = self.imports.where("kind = 'static'").select("id", F.col("line").alias("line_no"), "path", F.explode("names").alias("callee"))
        target = resolved_imports(self.files, self.aliases).where("target is not null").select("id", "path", "target").distinct()
        via = bound.join(target, ["id", "path"]).join(named.where("owner = ''").select(F.col("id").alias("target"), F.col("name").alias("callee"), F.col("key").alias("imported")), ["target", "callee"]).groupBy("id", "callee").agg(F.min("imported").alias("imported"))
        whole = named.join(self._repos, "id").groupBy("repo_id", F.col("name").alias("last")).agg(F.count(F.lit(1)).alias("candidates"), F.min("key").alias("only"))
        x = calls.join(local, ["id", "callee"], "left").join(via, ["id", "callee"], "left").join(self._repos, "id").join(whole, ["repo_id", "last"], "left")
        single = F.when(F.col("candidates") == 1, F.col("only"))
        tier = F.when(F.col("local").isNotNull(), "lexical").when(F.col("imported").isNotNull(), "import").when(single.isNotNull(), "name")
        out = x.select("caller", F.coalesce("local", "imported", single).alias("callee"), "id", "site", tier.alias("tier"), F.when(tier == "name", "heuristic").otherwise("resolved").alias("status"), F.when(tier == "lexical", "exact").when(tier == "import", "setup_aware").otherwise("syntax").alias("precision"))
        return out.where("callee is not null")

    @cached_property
    def framework_edges(self) -> DataFrame:
        """Edges from the function that registers a handler to the handler."""
        e = self.entrypoints.where("handler is not null and site is not null").select("id", "site", F.col("function").alias("caller"), F.col("handler").alias("name"))
        named = self.functions.where("fn >= 0").groupBy("id", "name").agg(F.min("key").alias("callee"))
        return e.join(named, ["id", "name"]).select("caller", "callee", "id", "site", F.lit("framework").alias("tier"), F.lit("resolved").alias("status"), F.lit("setup_aware").alias("precision"))

    @cached_property
    def summary_edges(self) -> DataFrame:
        """Edges to functions that are handed over: if the callee calls its parameter, it calls what stands at that place of the call."""
        calls_own = self.functions.select("key", F.posexplode("parameters").alias("place", "name"), "calls").where(F.array_contains("calls", F.col("name"))).select(F.col("key").alias("callee"), "place")
        handed = self.calls.select("id", "site", F.posexplode("arguments").alias("place", "name"))
        named = self.functions.where("fn >= 0 and owner = ''").groupBy("id", "name").agg(F.min("key").alias("handler"))
        x = self.direct_edges.select("id", "site", "callee").join(calls_own, "callee").join(handed, ["id", "site", "place"]).join(named, ["id", "name"])
        return x.select(F.col("callee").alias("caller"), F.col("handler").alias("callee"), "id", "site", F.lit("summary").alias("tier"), F.lit("resolved").alias("status"), F.lit("conservative").alias("precision")).distinct()

    def extension_edges(self, models: DataFrame) -> DataFrame:
        """Edges from model rows (source, target: names of functions): each name that one function bears."""
        one = self.functions.where("fn >= 0").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("id").alias("id")).where("n = 1")
        a, b = one.select(F.col("name").alias("source"), F.col("key").alias("caller"), "id"), one.select(F.col("name").alias("target"), F.col("key").alias("callee"))
        x = models.select("source", "target").distinct().join(a, "source").join(b, "target")
        return x.select("caller", "callee", "id", F.lit(None).cast("int").alias("site"), F.lit("extension").alias("tier"), F.lit("resolved").alias("status"), F.lit("model").alias("precision"))

    @cached_property
    def dispatch(self) -> tuple[DataFrame, DataFrame]:
        """Rapid type analysis: functions reached from main, init, tests and exported ones, and the edges of dynamic calls."""
        f = self.functions
        roots = f.where("name in ('main', 'init') or is_exported or is_test or fn = -1").select(F.col("key").alias("function")).distinct()
        method = last_segment(F.col("callee"))
        dynamic = self.calls.where(F.col("callee").contains(".") | (F.col("kind") == "dynamic")).select(F.col("function").alias("caller"), F.concat_ws(":", F.col("id").cast("string"), F.col("site").cast("string")).alias("site"), "id", method.alias("method")).join(self._repos, "id").select("caller", "site", F.concat_ws("#", "repo_id", "method").alias("method"))
        inside = self.functions.select(F.col("key").alias("function"), "id").join(self._repos, "id")
        made = self.of("alloc").select(function_key().alias("function"), F.col("detail").alias("type")).join(inside, "function").select("function", F.concat_ws("#", "repo_id", "type").alias("type")).distinct()
        methods = f.where("owner <> ''").join(self._repos, "id").select(F.concat_ws("#", "repo_id", "owner").alias("type"), F.concat_ws("#", "repo_id", "name").alias("method"), F.col("key").alias("function"))
        return G.rapid_types(roots, self.direct_edges.select("caller", "callee").distinct(), dynamic, made, methods)

    @cached_property
    def solver_edges(self) -> DataFrame:
        """The edges of the rapid type analysis as call edges; calls that register a handler are the framework's."""
        site = F.split("site", ":")
        r = self.dispatch[1].withColumn("id", site[0].cast("long")).withColumn("site", site[1].cast("int")).join(self.entrypoints.where("site is not null").select("id", "site").distinct(), ["id", "site"], "left_anti")
        return r.select("caller", "callee", "id", "site", F.lit("solver").alias("tier"), F.lit("resolved").alias("status"), F.lit("conservative").alias("precision"))

    def call_edges(self, models: DataFrame | None = None, solver: bool = True) -> DataFrame:
        """All tiers; of the edges of a caller, callee and site the first tier of lexical, import, framework, summary, extension, solver, name."""
        parts = self.direct_edges.unionByName(self.framework_edges).unionByName(self.summary_edges)
        if solver:
            parts = parts.unionByName(self.solver_edges)
        if models is not None:
            parts = parts.unionByName(self.extension_edges(models))
        order = F.array_position(F.array(*[F.lit(t) for t in ("lexical", "import", "framework", "summary", "extension", "solver", "name")]), F.col("tier"))
        return parts.groupBy("caller", "callee", "id", "site").agg(F.min_by(F.struct("tier", "status", "precision"), order).alias("x")).select("caller", "callee", "id", "site", "x.*")

    # Data flow and constraints.

    @cached_property
    def local_flow(self) -> DataFrame:
        """Edges between the places of a function (``key#name``): src, dst, kind (copy, store, load, result), site (null).

        What is given to a call whose callee is known goes through the callee, not past it.
        """
        given = self.calls.join(self.direct_edges.select("id", "site").distinct(), ["id", "site"], "left_semi").select("function", "site", F.explode("arguments").alias("x")).distinct()
        o = self.operations
        at = lambda c: F.concat_ws("#", "function", c)
        copy = o.where("kind in ('assign', 'return', 'store') and size(operands) > 0").select("function", "kind", "target", "site", F.explode("operands").alias("x")).join(given, ["function", "site", "x"], "left_anti")
        copy = copy.select(at("x").alias("src"), F.when(F.col("kind") == "return", at(F.lit("<return>"))).otherwise(at("target")).alias("dst"), F.when(F.col("kind") == "assign", "copy").when(F.col("kind") == "return", "result").otherwise(F.col("kind")).alias("kind"))
        load = o.where("kind = 'load'").select(at(F.get("operands", F.lit(0))).alias("src"), at("target").alias("dst"), F.lit("load").alias("kind"))
        return copy.unionByName(load).where("src <> dst").distinct().withColumn("site", F.lit(None).cast("string"))

    @cached_property
    def call_flow(self) -> DataFrame:
        """Edges from arguments to parameters (kind call) and from results to where they are assigned (kind return), with the site."""
        e = self.direct_edges.select("id", "site", "caller", "callee")
        tag = F.concat_ws(":", F.col("id").cast("string"), F.col("site").cast("string"))
        given = self.calls.select("id", "site", F.posexplode("arguments").alias("place", "name")).where(F.col("name").rlike(r"^[A-Za-z_$][\w$.]*$"))
        taken = self.functions.select(F.col("key").alias("callee"), F.posexplode("parameters").alias("place", "parameter"))
        into = e.join(given, ["id", "site"]).join(taken, ["callee", "place"]).select(F.concat_ws("#", "caller", "name").alias("src"), F.concat_ws("#", "callee", "parameter").alias("dst"), F.lit("call").alias("kind"), tag.alias("site"))
        used = self.operations.where("site is not null and kind in ('assign', 'return')").select(F.col("function").alias("caller"), "site", F.when(F.col("kind") == "return", "<return>").otherwise(F.col("target")).alias("target"))
        back = e.join(used, ["caller", "site"]).select(F.concat_ws("#", "callee", F.lit("<return>")).alias("src"), F.concat_ws("#", "caller", "target").alias("dst"), F.lit("return").alias("kind"), tag.alias("site"))
        return into.unionByName(back).distinct()

    def flow_edges(self, models: DataFrame | None = None) -> DataFrame:
        """Local, call and (from model rows source, target: places) summary edges."""
        out = self.local_flow.unionByName(self.call_flow)
        if models is not None:
            out = out.unionByName(models.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("site")))
        return out

    @cached_property
    def taint_in_taint_out(self) -> DataFrame:
        """function, parameter for each parameter that reaches the result by local flow."""
        edges = self.local_flow.select("src", "dst")
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        starts = edges.where(F.col("dst").endswith("#<return>")).select(F.col("dst").alias("node")).distinct()
        reach = G.reachable(back, starts)
        p = self.functions.select(F.col("key").alias("function"), F.explode("parameters").alias("parameter"))
        return reach.select(F.col("node")).distinct().join(p.withColumn("node", F.concat_ws("#", "function", "parameter")), "node").select("function", "parameter")

    @cached_property
    def effects(self) -> DataFrame:
        """function, effect: what each function does itself (throws, writes, allocates, branches on errors, calls of unknown functions)."""
        o = self.operations
        own = o.select("function", F.when(F.col("kind") == "throw", "throws").when((F.col("kind") == "store") & F.col("target").startswith("this."), "writes_receiver").when(F.col("kind") == "store", "writes_memory").when(F.col("kind") == "alloc", "allocates").alias("effect")).where("effect is not null")
        errors = self.branches.where("is_error_path").select("function", F.lit("handles_errors").alias("effect"))
        known = self.direct_edges.select("id", "site")
        unknown = self.calls.join(known, ["id", "site"], "left_anti").select("function", F.lit("calls_unknown").alias("effect"))
        return own.unionByName(errors).unionByName(unknown).distinct()

    @cached_property
    def constraints(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Points-to constraints: allocations (variable, object), copies (src, dst), stores (base, src), loads (base, dst)."""
        o = self.operations
        at = lambda c: F.concat_ws("#", "function", c)
        alloc = o.where("kind = 'alloc'").select(at("target").alias("variable"), F.concat_ws("@", at(F.get("operands", F.lit(0))), F.col("line").cast("string")).alias("object"))
        copies = o.where("kind in ('assign', 'return') and size(operands) = 1 and site is null").select(at(F.get("operands", F.lit(0))).alias("src"), F.when(F.col("kind") == "return", at(F.lit("<return>"))).otherwise(at("target")).alias("dst"))
        base = lambda c: F.regexp_extract(c, r"^([^.]*)", 1)
        stores = o.where("kind = 'store'").select("function", base("target").alias("b"), F.explode("operands").alias("s")).select(at("b").alias("base"), at("s").alias("src"))
        loads = o.where("kind = 'load'").select("function", "target", base(F.get("operands", F.lit(0))).alias("b")).select(at("b").alias("base"), at("target").alias("dst"))
        return alloc.distinct(), copies.unionByName(self.call_flow.select("src", "dst")).distinct(), stores.distinct(), loads.distinct()

    @cached_property
    def points_to(self) -> DataFrame:
        return G.points_to(*self.constraints)

    # The semantic graph.

    @cached_property
    def graph_nodes(self) -> DataFrame:
        """node, kind, label of files, functions, types and call sites."""
        f = source_files(self.files).select(F.col("id").cast("string").alias("node"), F.lit("file").alias("kind"), F.col("relative_path").alias("label"))
        g = self.functions.select(F.col("key").alias("node"), "kind", F.col("name").alias("label"))
        t = self.types.select(F.concat_ws("#", F.col("id").cast("string"), "name").alias("node"), "kind", F.col("name").alias("label"))
        c = self.calls.select(F.concat_ws("@", F.col("id").cast("string"), F.col("site").cast("string")).alias("node"), F.lit("call_site").alias("kind"), F.col("callee").alias("label"))
        return f.unionByName(g).unionByName(t).unionByName(c)

    @cached_property
    def membership(self) -> DataFrame:
        """src, dst, kind: functions and types in their file, methods in their type, call sites in their function."""
        i = F.col("id").cast("string")
        inside = self.functions.select(F.col("key").alias("src"), i.alias("dst"), F.lit("in_file").alias("kind"))
        types = self.types.select(F.concat_ws("#", i, "name").alias("src"), i.alias("dst"), F.lit("in_file").alias("kind"))
        methods = self.functions.where("owner <> ''").select(F.col("key").alias("src"), F.concat_ws("#", i, "owner").alias("dst"), F.lit("method_of").alias("kind"))
        sites = self.calls.select(F.concat_ws("@", i, F.col("site").cast("string")).alias("src"), F.col("function").alias("dst"), F.lit("in_function").alias("kind"))
        return inside.unionByName(types).unionByName(methods).unionByName(sites)

    # Entry points.

    @cached_property
    def entrypoints(self) -> DataFrame:
        """Handlers that frameworks are given: entrypoint, id, site, function (that registers it), kind, method, path, handler.

        The kind follows from what is called, the path from the first literal argument, the handler from the last argument that
        is a name. Test functions of Go are entry points of themselves.
        """
        a = F.col("arguments")
        first, last = F.get(a, F.lit(0)), F.element_at(F.when(F.size(a) > 0, a), -1)
        literal = F.when(first.rlike(r"""^["'`].*["'`]$"""), F.expr("substring(arguments[0], 2, length(arguments[0]) - 2)"))
        method_of = last_segment(F.col("callee"))
        owner = F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1)
        owner_last = last_segment(owner)
        go = F.col("language") == "go"
        pathlike = F.coalesce(literal.startswith("/"), F.lit(False))
        kind = (
            F.when(go & method_of.isin(*GO_ROUTES) & pathlike & (owner != ""), "http_route")
            .when(go & (method_of == "Use") & (owner != ""), "middleware").when(go & (method_of == "AddCommand"), "cli_command")
            .when(~go & owner_last.isin(*TS_ROUTERS) & method_of.isin(*TS_ROUTES) & pathlike, "http_route").when(~go & owner_last.isin(*TS_ROUTERS) & (method_of == "use"), "middleware")
            .when(~go & (method_of == "command") & literal.isNotNull() & (owner != ""), "cli_command").when(~go & F.col("callee").isin(*TS_TESTS), "test")
            .when(owner_last.isin(*MCP_OWNERS) & method_of.isin(*MCP) & literal.isNotNull(), F.coalesce(*[F.when(method_of == k, F.lit(v)) for k, v in MCP.items()]))
            .otherwise(F.coalesce(*[F.when(F.col("callee") == k, F.lit(v)) for k, v in JOBS.items()]))
        )
        verb = F.when(go, F.coalesce(*[F.when(method_of == k, F.lit(v)) for k, v in GO_ROUTES.items() if v])).otherwise(F.coalesce(*[F.when(method_of == k, F.lit(v)) for k, v in TS_ROUTES.items() if v]))
        name = F.when(last.rlike(r"^[A-Za-z_$][\w$.]*$"), last_segment(last))
        x = self.calls.withColumn("ekind", kind).where("ekind is not null")
        found = x.select(F.concat_ws("@", F.col("id").cast("string"), F.col("site").cast("string")).alias("entrypoint"), "id", "site", "function", F.col("ekind").alias("kind"), F.when(F.col("ekind") == "http_route", verb).alias("method"), literal.alias("path"), name.alias("handler"))
        tests = self.functions.where("is_test").select(F.col("key").alias("entrypoint"), "id", F.lit(None).cast("int").alias("site"), F.col("key").alias("function"), F.lit("test").alias("kind"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("path"), F.col("name").alias("handler"))
        return found.unionByName(tests)


def matching_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two producers for the same span and name: joined by id, line, end_line and name; other columns of both, those of b prefixed other_."""
    keys = ["id", "line", "end_line", "name"]
    return a.join(b.select(*keys, *[F.col(c).alias(f"other_{c}") for c in b.columns if c not in keys]), keys)


def evidence_projection(paths: DataFrame) -> DataFrame:
    """Paths (source, sink, path) as rows of evidence: source, sink, step, node, role (source, through, sink)."""
    x = paths.where("path is not null").select("source", "sink", F.size("path").alias("n"), F.posexplode("path").alias("step", "node"))
    return x.select("source", "sink", "step", "node", F.when(F.col("step") == 0, "source").when(F.col("step") == F.col("n") - 1, "sink").otherwise("through").alias("role"))
