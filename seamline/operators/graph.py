"""Traversal of a directed graph given as edges (src, dst): level by level, with the visited set kept as a table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import globbed, shared_folder


#: Parts of a visited set that are read one by one before they are written together.
MOST_PARTS = 12


def _cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again. After a checkpoint the planner would still multiply the
    sizes of all levels before; a table's size is that of its files."""
    at = f"{shared_folder(df.sparkSession).rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Seen:
    """A visited set as its fronts, each written once; many small ones are written together now and then."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, front: DataFrame) -> None:
        self.parts.append(front)
        if len(self.parts) > MOST_PARTS:
            # The large part stays as it is; only what came after it is written again, until that has grown as large.
            small = _cut(reduce(DataFrame.unionByName, self.parts[1:]))
            self.parts = [self.parts[0], small]
            if small.count() >= self.parts[0].count():
                self.parts = [_cut(self.all())]


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(origin, node, depth) of what each of (origin, node) reaches, with its least depth; starts have depth 0.

    Without ``depth``, until nothing new is reached.
    """
    edges = _cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    front = _cut(start.select("origin", "node").distinct().withColumn("depth", F.lit(0)))
    seen, d = Seen(front), 0
    while depth is None or d < depth:
        d += 1
        new = front.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        front = _cut(new.join(seen.all(), ["origin", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen.add(front)
    return seen.all()


def callers(edges: DataFrame, target, depth: int = 1, include_tests: bool = True) -> DataFrame:
    """(node, depth) of those that reach ``target``; with include_tests off, edges from test nodes (is_test) are left out."""
    if not include_tests and "is_test" in edges.columns:
        edges = edges.where(~F.col("is_test"))
    spark = edges.sparkSession
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    got = reach(back, spark.range(1).select(F.lit(target).alias("origin"), F.lit(target).alias("node")), depth)
    return got.where("depth > 0").select("node", "depth")


def call_tree(edges: DataFrame, root, depth: int = 5) -> DataFrame:
    """(path, depth) of all paths from the root without a repeated node, up to ``depth`` edges."""
    edges = edges.select("src", "dst").distinct()
    rows = edges.sparkSession.range(1).select(F.array(F.lit(root)).alias("path"))
    out = rows
    for _ in range(depth):
        last = F.element_at("path", -1)
        rows = rows.join(edges, last == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        rows = _cut(rows.select(F.concat("path", F.array("dst")).alias("path")))
        if rows.isEmpty():
            break
        out = out.unionByName(rows)
    return out.select("path", (F.size("path") - 1).alias("depth"))


def shortest_path(edges: DataFrame, source, target, depth: int = 10) -> DataFrame:
    """At most one row (path): the shortest, and among equals the least by its nodes. Cycles do no harm."""
    edges = edges.select("src", "dst").distinct()
    front = _cut(edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path")))
    seen = front.select("node")
    for _ in range(depth + 1):
        hit = front.where(F.col("node") == F.lit(target))
        if not hit.isEmpty():
            return hit.groupBy().agg(F.min("path").alias("path"))
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = _cut(step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = _cut(seen.union(front.select("node")))
    return front.limit(0).select("path")


def trace_to(edges: DataFrame, roots: DataFrame, target, depth: int = 10) -> DataFrame:
    """Paths without a repeated node from any root (node) to the target; the root comes first."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    tree = call_tree(back, target, depth).select(F.reverse("path").alias("path"))
    ends = roots.select(F.col("node").alias("root")).distinct()
    return tree.join(ends, F.element_at("path", 1) == F.col("root"), "left_semi").where(F.size("path") > 1)


def impact(edges: DataFrame, target, depth: int = 5, hub: int = 20, shown: int = 15) -> tuple[DataFrame, DataFrame]:
    """(sites, totals): affected nodes, cut to ``shown`` for a hub, and the exact totals with the reason of a cut."""
    all_ = callers(edges, target, depth)
    n = all_.count()
    rows = all_.orderBy("depth", "node").limit(shown if n > hub else n or 1)
    totals = all_.agg(F.count(F.lit(1)).alias("total_affected"), F.max("depth").alias("deepest")).withColumn(
        "reason", F.when(F.lit(n > hub), F.lit("hub"))
    )
    return rows, totals


def call_sites(calls: DataFrame, target, depth: int = 5, include_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sites, totals) of what a change of ``target`` touches, from calls (src, dst, file, line, expression, is_test).

    sites: each call (src, dst, file, line, expression, depth) whose callee is the target (depth 1) or one of its
    callers (depth 2 and on); a call of the target by name is relation direct, else transitive. totals: total_affected
    callers, affected_files, sites, and hidden_tests, the callers in tests that were left out.
    """
    kept = calls if include_tests else calls.where(~F.col("is_test"))
    spark = calls.sparkSession
    back = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = spark.range(1).select(F.lit(target).alias("origin"), F.lit(target).alias("node"))
    near = _cut(reach(back, start, depth).select(F.col("node").alias("callee"), (F.col("depth") + 1).alias("depth")))
    near = near.where(F.col("depth") <= depth)
    joined = calls.join(near, F.col("dst") == F.col("callee"))
    visible = joined if include_tests else joined.where(~F.col("is_test"))
    relation = F.when(F.col("dst") == F.lit(target), "direct").otherwise("transitive")
    sites = visible.select("src", "dst", "file", "line", "expression", "depth", relation.alias("relation"))
    hidden = F.count_distinct(F.when(F.col("is_test") & F.lit(not include_tests), F.col("src")))
    seen = F.col("is_test") & F.lit(not include_tests)
    totals = joined.agg(
        F.count_distinct(F.when(~seen & (F.col("src") != F.lit(target)), F.col("src"))).alias("total_affected"),
        F.count_distinct(F.when(~seen, F.col("file"))).alias("affected_files"),
        F.count_if(~seen).alias("sites"),
        hidden.alias("hidden_tests"),
    )
    return sites, totals


def caller_files(calls: DataFrame, overlay: DataFrame, target_file, target_name) -> DataFrame:
    """(file) of callers of (target_file, target_name): the overlay's files replace those of the same name in calls."""
    own = overlay.select("file").distinct()
    both = calls.join(own, "file", "left_anti").unionByName(overlay.select(*calls.columns))
    return both.where((F.col("target_file") == F.lit(target_file)) & (F.col("target_name") == F.lit(target_name))).select("file").distinct()


def files_with_name(names: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """(file) that hold a name, over names (file, name, kind); ``kind`` symbol, reference or language narrows it."""
    rows = names.where(F.col("name") == name)
    return (rows if kind is None else rows.where(F.col("kind") == kind)).select("file").distinct()


def dead_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (node) that no root reaches."""
    start = roots.select(F.lit(0).alias("origin"), "node")
    return nodes.select("node").distinct().join(reach(edges, start).select("node").distinct(), "node", "left_anti")


def root_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kind of each node (node, is_main, is_test, is_exported): main, test, public_api, no_caller_found or internal."""
    called = edges.where("src != dst").select(F.col("dst").alias("node")).distinct().withColumn("called", F.lit(True))
    kind = (
        F.when(F.col("is_main"), "main").when(F.col("is_test"), "test").when(F.col("is_exported"), "public_api")
        .when(F.col("called").isNull(), "no_caller_found").otherwise("internal")
    )
    return nodes.join(called, "node", "left").select("node", kind.alias("kind"))


def _on_both_sides(e: DataFrame) -> DataFrame:
    """Edges left when those of nodes without an edge in or without one out are taken away, again and again."""
    e, n = _cut(e), -1
    while (now := e.count()) != n and now:
        n = now
        into, out = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = _cut(e.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
    return e


def _least_before(e: DataFrame) -> DataFrame:
    """(node, color): the least node that reaches each node of ``e``, itself included."""
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    colors = _cut(nodes.withColumn("color", F.col("node")))
    moved = colors
    while not moved.isEmpty():
        # Only nodes whose color has changed tell their neighbours.
        told = moved.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("n")).agg(F.min("color").alias("c"))
        better = colors.join(told, (F.col("node") == F.col("n")) & (F.col("c") < F.col("color")))
        moved = _cut(better.select("node", F.col("c").alias("color")))
        now = moved.select(F.col("node").alias("n"), F.col("color").alias("c"))
        colors = _cut(colors.join(now, F.col("node") == F.col("n"), "left").select("node", F.coalesce("c", "color").alias("color")))
    return colors


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component, size) of nodes on a cycle: strongly connected components, self-loops with size 1.

    A component is named by its least node. Nodes that can't lie on a cycle are trimmed; every node takes the least node
    that reaches it as its color, and what reaches back to that node within the color is a component. It is taken out
    and the rest is looked at again, so that no pairs of nodes are ever made.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    loops = e.where("src = dst").select(F.col("src").alias("loop"))
    rest, found = _on_both_sides(e), None
    while not rest.isEmpty():
        colors = _least_before(rest)
        a = colors.select(F.col("node").alias("src"), F.col("color").alias("ca"))
        b = colors.select(F.col("node").alias("dst"), F.col("color").alias("cb"))
        within = rest.join(a, "src").join(b, "dst").where("ca = cb")
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colors.where("node = color").select(F.col("color").alias("origin"), "node")
        part = _cut(reach(back, roots).select("node", F.col("origin").alias("component")))
        found = part if found is None else found.unionByName(part)
        gone = part.select(F.col("node").alias("g"))
        rest = rest.join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti")
        rest = _on_both_sides(rest)
    if found is None:
        return e.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = found.join(size, "component").join(loops, F.col("node") == F.col("loop"), "left")
    return sized.where("size > 1 or loop is not null").select("node", "component", "size")


def import_cycles(imports: DataFrame) -> DataFrame:
    """(node, component, size, edge_kind) of files on a cycle of imports (src, dst, kind).

    Imports of kind type make no cycle. edge_kind is static where the component's static imports alone close a cycle,
    else dynamic-only.
    """
    held = imports.where("kind != 'type'")
    whole = _cut(cycles(held))
    static = cycles(held.where("kind != 'dynamic'")).select(F.col("node").alias("s")).distinct()
    closed = whole.join(static, F.col("node") == F.col("s"), "left_semi").select(F.col("component").alias("c")).distinct()
    kind = F.when(F.col("c").isNotNull(), "static").otherwise("dynamic-only")
    return whole.join(closed, F.col("component") == F.col("c"), "left").select("node", "component", "size", kind.alias("edge_kind"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (file, scoped_name, ...) with the node that was inserted first under that name; null if none."""
    first = nodes.groupBy("file", "scoped_name").agg(F.min_by("node", "seq").alias("target"))
    return refs.join(first, ["file", "scoped_name"], "left")


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """Last writer by id, then by (file, start, stop), over (node, file, start, stop, seq, ...)."""
    names = rows.columns
    by_id = rows.groupBy("node").agg(F.max_by(F.struct(*names), "seq").alias("r")).select("r.*")
    return by_id.groupBy("file", "start", "stop").agg(F.max_by(F.struct(*names), "seq").alias("r")).select("r.*").select(*names)


def initialiser_edges(inits: DataFrame, callers_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): every caller of a package calls each of its initialisers but itself; counts need no pairs."""
    pairs = callers_.join(inits, "package").where(F.col("caller") != F.col("init")).select("package", "caller", "init")
    a = inits.groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    b = callers_.groupBy("package").agg(F.count(F.lit(1)).alias("m"))
    self_ = callers_.join(inits, (callers_.package == inits.package) & (callers_.caller == inits.init), "left_semi")
    s = self_.groupBy("package").agg(F.count(F.lit(1)).alias("s"))
    counts = a.join(b, "package").join(s, "package", "left").select("package", (F.col("n") * F.col("m") - F.coalesce("s", F.lit(0))).alias("edges"))
    return pairs, counts


def export_verdicts(exports: DataFrame, imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file, name, verdict) of exports (file, name, is_entry): used, public_api, uncertain or unused.

    imports (file, target, name, kind): kind named, default, namespace or type. A namespace import makes what isn't
    named uncertain; a use of a re-exported name is one of its origin, followed through (file, name, target,
    target_name) until nothing new is used.
    """
    uses = imports.where("kind != 'type'").select(F.col("target").alias("file"), "name", (F.col("kind") == "namespace").alias("whole"))
    front = _cut(uses.distinct())
    used = Seen(front)
    while not front.isEmpty():
        r = reexports.select(F.col("file").alias("f"), F.col("name").alias("n"), F.col("target").alias("t"), F.col("target_name").alias("tn"))
        star = F.col("n") == "*"
        hop = front.join(r, (F.col("file") == F.col("f")) & (star | (F.col("name") == F.col("n")) | F.col("whole")))
        new = hop.select(F.col("t").alias("file"), F.when(star, F.col("name")).otherwise(F.col("tn")).alias("name"), "whole").distinct()
        front = _cut(new.join(used.all(), ["file", "name", "whole"], "left_anti"))
        used.add(front)
    seen = used.all()
    named = seen.where(~F.col("whole")).select("file", "name").distinct().withColumn("used", F.lit(True))
    whole = seen.where("whole").select("file").distinct().withColumn("maybe", F.lit(True))
    verdict = F.when(F.col("used"), "used").when(F.col("is_entry"), "public_api").when(F.col("maybe"), "uncertain").otherwise("unused")
    return exports.join(named, ["file", "name"], "left").join(whole, "file", "left").select("file", "name", verdict.alias("verdict"))


def data_flow(flows: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(origin, node, depth, approximate) of where values go, from flows (src, dst, kind).

    kind assign carries a value on within a function and costs no hop; call leads from an argument to a parameter and
    costs one of ``depth`` hops; unknown (a spread or computed argument) does so too, and what lies behind it is
    approximate unless it is also reached without.
    """
    flows = _cut(flows.select("src", "dst", "kind").where("src is not null and dst is not null").distinct())
    state = ["origin", "node", "depth", "approximate"]
    first = start.select("origin", "node", F.lit(0).alias("depth"), F.lit(False).alias("approximate")).distinct()
    front = _cut(first)
    best = front
    while not front.isEmpty():
        step = front.join(flows, F.col("node") == F.col("src")).select(
            "origin",
            F.col("dst").alias("node"),
            (F.col("depth") + (F.col("kind") != "assign").cast("int")).alias("depth"),
            (F.col("approximate") | (F.col("kind") == "unknown")).alias("approximate"),
        )
        # The least depth for each certainty is kept; a state that is no better leads nowhere new.
        new = step.where(F.col("depth") <= depth).groupBy("origin", "node", "approximate").agg(F.min("depth").alias("depth"))
        old = best.select("origin", "node", "approximate", F.col("depth").alias("had"))
        front = _cut(new.join(old, ["origin", "node", "approximate"], "left").where("had is null or depth < had").select(*state))
        best = _cut(best.unionByName(front).groupBy("origin", "node", "approximate").agg(F.min("depth").alias("depth")).select(*state))
    sure = F.min_by("depth", F.struct("approximate", "depth"))
    return best.groupBy("origin", "node").agg(sure.alias("depth"), F.min("approximate").alias("approximate")).select(*state)


def dispatch(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, target, provenance) of calls (call, receiver_type, method) on methods (target, type, method).

    type_match where the receiver's type is known to have the method, else name_match where the name alone decides,
    for names that only one type has.
    """
    typed = calls.join(methods, (calls.receiver_type == methods.type) & (calls.method == methods.method)).select("call", "target", F.lit("type_match").alias("provenance"))
    only = methods.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1")
    rest = calls.join(typed.select("call").distinct(), "call", "left_anti")
    named = rest.join(only, "method").select("call", "target", F.lit("name_match").alias("provenance"))
    return typed.unionByName(named)


#: Files that a framework calls by their place, as globs.
ROUTE_GLOBS = {
    "next": [
        "app/**/{page,layout,route,template,error,loading,not-found}.{ts,tsx,js,jsx}",
        "src/app/**/{page,layout,route,template,error,loading,not-found}.{ts,tsx,js,jsx}",
        "pages/**/*.{ts,tsx,js,jsx}",
        "src/pages/**/*.{ts,tsx,js,jsx}",
        "middleware.{ts,js}",
        "src/middleware.{ts,js}",
        "app/**/default.{ts,tsx}",
        "src/app/**/default.{ts,tsx}",
    ],
    "nuxt": ["server/api/**/*.{ts,js}", "server/routes/**/*.{ts,js}", "middleware/**/*.{ts,js}", "plugins/**/*.{ts,js}"],
    "sveltekit": ["src/routes/**/+*.{ts,js}", "src/hooks.server.{ts,js}", "src/hooks.client.{ts,js}"],
    "remix": ["app/routes/**/*.{ts,tsx,js,jsx}", "app/root.{ts,tsx,js,jsx}"],
    "astro": ["src/pages/**/*.{ts,js}"],
}
#: Decorators by which frameworks call what carries them, with the modules that they must come from (none: any).
DECORATORS = {
    "Controller": ["@nestjs/common"], "Injectable": ["@nestjs/common"], "Module": ["@nestjs/common"],
    "Get": ["@nestjs/common"], "Post": ["@nestjs/common"], "Put": ["@nestjs/common"], "Delete": ["@nestjs/common"],
    "route": [], "command": [], "fixture": ["pytest"], "task": [], "listener": [], "scheduled": [],
}


def framework_roots(nodes: DataFrame, frameworks: list[str]) -> DataFrame:
    """(node, kind) of nodes (node, path, exported, decorators: name and module) that a framework calls by convention.

    kind is route for an exported node in a file that one of the frameworks' globs names, else decorator where it
    carries one that comes from an allowed module.
    """
    routed = F.lit(False)
    for f in frameworks:
        routed = routed | globbed(F.col("path"), ROUTE_GLOBS.get(f, []), []) if ROUTE_GLOBS.get(f) else routed
    anywhere = [d for d, modules in DECORATORS.items() if not modules]
    named = F.create_map(*[x for d, m in DECORATORS.items() if m for x in (F.lit(d), F.array(*map(F.lit, m)))])
    marked = F.exists(
        "decorators", lambda d: d["name"].isin(*anywhere) | F.coalesce(F.array_contains(named[d["name"]], d["module"]), F.lit(False))
    )
    kind = F.when(F.col("exported") & routed, "route").when(marked, "decorator")
    return nodes.select("node", kind.alias("kind")).where("kind is not null")


def invalidated(changed: DataFrame, recorded: DataFrame) -> DataFrame:
    """(item) of recorded dependencies (item, key) of which some key (key) has changed."""
    return recorded.join(changed.select("key").distinct(), "key", "left_semi").select("item").distinct()


def reusable(recorded: DataFrame, answers: DataFrame) -> DataFrame:
    """(item) whose every recorded answer (item, key, answer) still holds in answers (key, answer)."""
    now = answers.select("key", F.col("answer").alias("now"))
    held = recorded.join(now, "key", "left").select("item", F.col("answer").eqNullSafe(F.col("now")).alias("ok"))
    return held.groupBy("item").agg(F.every("ok").alias("ok")).where("ok").select("item")


def running_estimate(rows: DataFrame, key: str, order: str, value: str, start: int = 0) -> DataFrame:
    """(key, estimate) folded in order by (3 old + new + 2) div 4, as an array aggregate over each key's short list."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    fold = F.aggregate("l", F.lit(start).cast("long"), lambda a, x: F.floor((3 * a + x[value] + 2) / 4).cast("long"))
    return rows.groupBy(key).agg(listed.alias("l")).select(key, fold.alias("estimate"))
