"""Read views of facts: one object a kind of fact, each method a plan over its table.

``all`` and ``iter`` give the whole table; other methods filter it. Filters with a key use equality, so that partition and
column pruning reach the scan; nothing is collected.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.predicates import glob_regex, matches_glob
from .operators import extract as X
from .operators import fixpoint as G
from .operators import policy as P


class View:
    """A table of facts with the methods that all kinds share."""

    key, file, name = "id", "id", "name"

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def all(self) -> DataFrame:
        return self.df

    iter = all

    def get(self, key: object) -> DataFrame:
        return self.df.where(F.col(self.key) == F.lit(key))

    def for_file(self, file: object) -> DataFrame:
        return self.df.where(F.col(self.file) == F.lit(file))

    def by_name(self, name: str) -> DataFrame:
        return self.df.where(F.col(self.name) == name)

    def over(self, column: str, most: int) -> DataFrame:
        return self.df.where(F.col(column) > most)


class SourceFiles(View):
    def language(self, file: object) -> DataFrame:
        return self.get(file).select("language")

    def path_for(self, file: object) -> DataFrame:
        return self.get(file).select("relative_path")


class FileMetrics(View):
    def for_language(self, language: str) -> DataFrame:
        return self.df.where(F.col("language") == language)

    def over_line_count(self, most: int) -> DataFrame:
        return self.over("line_count", most)

    def over_byte_count(self, most: int) -> DataFrame:
        return self.over("byte_count", most)

    def over_function_count(self, most: int) -> DataFrame:
        return self.over("function_count", most)


class FunctionMetrics(View):
    key = "name"

    def over_byte_count(self, most: int) -> DataFrame:
        return self.over("byte_count", most)

    def over_line_count(self, most: int) -> DataFrame:
        return self.over("line_count", most)

    def over_complexity(self, most: int) -> DataFrame:
        return self.over("cyclomatic_complexity", most)


class Imports(View):
    name = "path"

    def __init__(self, df: DataFrame, files: DataFrame) -> None:
        super().__init__(df)
        self.files = files

    def edges(self) -> DataFrame:
        """Each import with its source file."""
        return self.df.join(self.files.select("id", "relative_path"), "id")


class ResolvedImports(View):
    name = "path"
    by_specifier = View.by_name

    def _status(self, *status: str) -> DataFrame:
        return self.df.where(F.col("status").isin(*status))

    def resolved_for_file(self, file: object) -> DataFrame:
        return self.for_file(file).where("status = 'resolved'")

    def unresolved(self) -> DataFrame:
        return self._status("unresolved", "setup_missing")

    def unresolved_for_file(self, file: object) -> DataFrame:
        return self.unresolved().where(F.col("id") == F.lit(file))

    def dynamic(self) -> DataFrame:
        return self._status("dynamic")

    def unsupported(self) -> DataFrame:
        return self._status("unsupported")

    def for_import(self, file: object, line_no: int) -> DataFrame:
        return self.for_file(file).where(F.col("line_no") == line_no)


class ModuleGraph:
    """Nodes are files (by id) and packages (by path); an edge for each resolved or external import."""

    def __init__(self, resolved: DataFrame, files: DataFrame) -> None:
        node = F.coalesce(F.col("target").cast("string"), F.col("path"))
        self._edges = resolved.select(F.col("id").cast("string").alias("src"), node.alias("dst"), "status")
        self._nodes = files.select(F.col("id").cast("string").alias("node"), F.col("relative_path").alias("label"), F.lit("file").alias("kind")).unionByName(resolved.where("status = 'external'").select(F.col("path").alias("node"), F.col("path").alias("label"), F.lit("package").alias("kind")).distinct())

    def nodes(self) -> DataFrame:
        return self._nodes

    def edges(self) -> DataFrame:
        return self._edges

    def node_for_file(self, file: object) -> DataFrame:
        return self._nodes.where(F.col("node") == str(file))

    def nodes_for_package(self, name: str) -> DataFrame:
        return self._nodes.where((F.col("kind") == "package") & (F.col("label") == name))

    def outgoing(self, node: object) -> DataFrame:
        return self._edges.where(F.col("src") == str(node))

    edges_from_file = outgoing

    def incoming(self, node: object) -> DataFrame:
        return self._edges.where(F.col("dst") == str(node))

    def imports_between(self, a: object, b: object) -> DataFrame:
        return self.outgoing(a).where(F.col("dst") == str(b))

    def dependency_status(self) -> DataFrame:
        return self._edges.select("src", "dst", "status").distinct()

    def reachable_from(self, node: object) -> DataFrame:
        """What the node reaches over resolved and external edges, itself left out."""
        kept = self._edges.where("status in ('resolved', 'external')")
        start = self._nodes.where(F.col("node") == str(node)).select("node")
        return G.reachable(kept, start).select("node", "depth")


class Symbols(View):
    def by_kind(self, kind: str) -> DataFrame:
        return self.df.where(F.col("kind") == kind)

    def exported(self) -> DataFrame:
        return self.df.where("is_exported")

    def exported_by_name(self, name: str) -> DataFrame:
        return self.exported().where(F.col("name") == name)

    def stable_key(self) -> DataFrame:
        return self.df.select("*", F.concat_ws("#", F.col("id").cast("string"), "kind", "name").alias("stable_key"))

    definitions = View.get
    definitions_in_file = View.for_file

    def definition(self, key: str) -> DataFrame:
        """The symbol of a stable key."""
        return self.stable_key().where(F.col("stable_key") == key)

    def definition_stable_key(self, file: object, name: str) -> DataFrame:
        """The stable keys of what a name is defined as in a file."""
        return self.stable_key().where((F.col("id") == F.lit(file)) & (F.col("name") == name)).select("stable_key")


class References(View):
    """Calls by name, joined to the symbols of that name: resolved (one), ambiguous (several) or unresolved."""

    name = "callee"

    def __init__(self, calls: DataFrame, symbols: DataFrame) -> None:
        known = symbols.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("candidates"))
        status = F.when(F.col("candidates").isNull(), "unresolved").when(F.col("candidates") > 1, "ambiguous").otherwise("resolved")
        super().__init__(calls.join(known, "callee", "left").withColumn("status", status))

    def _status(self, status: str) -> DataFrame:
        return self.df.where(F.col("status") == status)

    def stable_key(self) -> DataFrame:
        """Each reference with a key of its file, place and name."""
        return self.df.select("*", F.concat_ws("#", F.col("id").cast("string"), F.col("line_no").cast("string"), F.col("position").cast("string"), "callee").alias("stable_key"))

    def resolved(self) -> DataFrame:
        return self._status("resolved")

    def ambiguous(self) -> DataFrame:
        return self._status("ambiguous")

    def unresolved(self) -> DataFrame:
        return self._status("unresolved")

    def unresolved_by_name(self, name: str) -> DataFrame:
        return self.unresolved().where(F.col("callee") == name)

    def to(self, name: str) -> DataFrame:
        return self.by_name(name).where("status = 'resolved'")

    def to_any(self, names: list[str]) -> DataFrame:
        return self.df.where(F.col("callee").isin(*names) & (F.col("status") == "resolved"))


class BranchObligations(View):
    def for_function(self, file: object, start: int, end: int) -> DataFrame:
        return self.for_file(file).where(F.col("line_no").between(start, end))


class Tests(View):
    def __init__(self, df: DataFrame, related: DataFrame) -> None:
        super().__init__(df)
        self.related = related

    def related_for_file(self, file: object) -> DataFrame:
        return self.related.where(F.col("id") == F.lit(file))


class Violations(View):
    """Results of policy queries (scope, position or sink, status, precision, confidence) as views."""

    key = file = "scope"

    def status(self, *values: str) -> DataFrame:
        """The statuses, or the rows of one of ``values``."""
        return self.df.where(F.col("status").isin(*values)) if values else self.df.select("status").distinct()

    def precision(self, *values: str) -> DataFrame:
        return self.df.where(F.col("precision").isin(*values)) if values else self.df.select("precision").distinct()

    def diagnostic(self, rule_id: str, message: str, severity: str = "warn") -> DataFrame:
        """A diagnostic for each row: rule_id, severity, file (the scope), line (the position), message, stable_fingerprint."""
        line = F.col("position") if "position" in self.df.columns else F.col("sink")
        return self.df.select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.col("scope").cast("string").alias("file"), line.alias("line"), F.lit(message).alias("message"), F.md5(F.concat_ws("\x1f", F.lit(rule_id), F.col("scope").cast("string"), line.cast("string"), F.lit(message))).alias("stable_fingerprint"))


class ChangedFileRef:
    """One changed file as it is held: path, status letter and closed ranges of lines."""

    def __init__(self, path: str, status: str, lines: tuple[tuple[int, int], ...] = ()) -> None:
        self.path, self.status, self.lines = path, status, lines

    def matches_glob(self, pattern: str) -> bool:
        return (r := glob_regex(pattern)) is not None and bool(re.search(r, self.path))

    is_added = property(lambda self: self.status == "A")
    is_modified = property(lambda self: self.status == "M")
    is_deleted = property(lambda self: self.status == "D")
    is_renamed = property(lambda self: self.status.startswith("R"))


class ChangedFiles(View):
    """Rows (path, status, lo, hi) of a change set; a file without ranges has null lo and hi."""

    file = key = "path"

    def ref(self, path: str) -> ChangedFileRef | None:
        """The changed file of a path; nothing if it has not changed."""
        rows = self.get(path).select("status", "lo", "hi").collect()  # the ranges of one file
        return ChangedFileRef(path, rows[0]["status"], tuple(sorted((r["lo"], r["hi"]) for r in rows if r["lo"] is not None))) if rows else None

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def contains_path(self, path: str) -> bool:
        return not self.get(path).isEmpty()

    def matches_glob(self, pattern: str) -> DataFrame:
        return self.df.where(matches_glob(F.col("path"), pattern))

    def lines_for(self, path: str) -> DataFrame:
        return self.get(path).where("lo is not null").select("lo", "hi")

    def _status(self, letter: str) -> DataFrame:
        return self.df.where(F.col("status") == letter)

    def added(self) -> DataFrame:
        return self._status("A")

    def modified(self) -> DataFrame:
        return self._status("M")

    def deleted(self) -> DataFrame:
        return self._status("D")

    def renamed(self) -> DataFrame:
        return self._status("R")


class FactViews:
    """All views over one table of source files (and, where given, coverage and a change set)."""

    def __init__(self, files: DataFrame, changed: DataFrame | None = None, coverage: DataFrame | None = None) -> None:
        self._files, self._changed, self._coverage = files, changed, coverage

    @cached_property
    def source_files(self) -> SourceFiles:
        return SourceFiles(X.source_files(self._files))

    @cached_property
    def packages(self) -> View:
        return View(X.packages(self._files))

    @cached_property
    def functions(self) -> View:
        return View(X.functions(self._files))

    @cached_property
    def file_metrics(self) -> FileMetrics:
        return FileMetrics(X.file_metrics(self._files))

    @cached_property
    def function_metrics(self) -> FunctionMetrics:
        return FunctionMetrics(X.function_metrics(self._files))

    @cached_property
    def complexity_metrics(self) -> FunctionMetrics:
        return self.function_metrics

    @cached_property
    def imports(self) -> Imports:
        return Imports(X.imports(self._files), self.source_files.df)

    @cached_property
    def resolved_imports(self) -> ResolvedImports:
        return ResolvedImports(X.resolved_imports(self._files))

    @cached_property
    def module_graph(self) -> ModuleGraph:
        return ModuleGraph(self.resolved_imports.df, self.source_files.df)

    @cached_property
    def symbols(self) -> Symbols:
        """Functions, types and classes as symbols: id (file), name, kind, is_exported."""
        f = X.functions(self._files).select("id", "name", F.lit("function").alias("kind"), "is_exported")
        t = X.go_types(self._files).select("id", "name", F.lit("type").alias("kind"), F.col("name").rlike("^[A-Z]").alias("is_exported"))
        c = X.ts_classes(self._files).select("id", "name", F.lit("class").alias("kind"), "is_exported")
        return Symbols(f.unionByName(t).unionByName(c))

    @cached_property
    def references(self) -> References:
        return References(X.call_names(self._files), self.symbols.df)

    @cached_property
    def branch_obligations(self) -> BranchObligations:
        return BranchObligations(X.branch_obligations(self._files))

    @cached_property
    def go_tests(self) -> Tests:
        return Tests(X.test_files(self._files).where("language = 'go'"), X.related_tests(self._files))

    @cached_property
    def go_types(self) -> View:
        return View(X.go_types(self._files))

    @cached_property
    def ts_components(self) -> View:
        return View(X.ts_components(self._files))

    @cached_property
    def ts_classes(self) -> View:
        return View(X.ts_classes(self._files))

    @cached_property
    def string_literals(self) -> View:
        return View(X.string_literals(self._files))

    @cached_property
    def jsx_attributes(self) -> View:
        return View(X.jsx_attributes(self._files))

    @cached_property
    def coverage(self) -> View:
        if self._coverage is None:
            raise LookupError("no coverage facts")
        return View(self._coverage)

    @cached_property
    def changed_files(self) -> ChangedFiles:
        if self._changed is None:
            raise LookupError("no change set")
        return ChangedFiles(self._changed)

    @cached_property
    def events(self) -> DataFrame:
        """Calls as events: scope is the file, position the line and place in it, name the callee."""
        calls = X.call_names(self._files)
        return calls.select(F.col("id").alias("scope"), (F.col("line_no").cast("long") * (1 << 20) + F.col("position")).alias("position"), F.col("callee").alias("name"))

    def matching(self, pattern: P.EventPattern) -> DataFrame:
        return P.events_matching(self.events, pattern)

    def missing_guard(self, query: P.GuardQuery) -> DataFrame:
        return P.missing_guard(self.events, query)

    def missing_cleanup(self, query: P.LifecycleQuery) -> DataFrame:
        return P.missing_cleanup(self.events, query)

    def forbidden_flow(self, query: P.FlowQuery) -> DataFrame:
        return P.forbidden_flow(self.events, query)

    @staticmethod
    def forbidden_reachable(edges: DataFrame, roots: DataFrame, query: P.ReachQuery) -> DataFrame:
        return P.forbidden_reachable(edges, roots, query)

    def sample(self, table: DataFrame, order: list[Column], most: int = 100) -> DataFrame:
        """The first rows of a view in order, at most 100: a report for readers."""
        return table.orderBy(*order).limit(min(most, 100))
