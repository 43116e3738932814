"""Where an import leads: to a file of the repository, to something outside, off the map, or nowhere.

A reference is turned into candidate places in order of preference, all candidates meet the places of the repository in one join, and the
best hit wins. More than one hit of equal standing makes the link probable instead of certain. Nothing is outside unless something says so: a scheme, the
runtime or the standard library, a declared dependency. What the repository defines itself is never outside.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.paths import dir_name, dir_prefixes, join_path
from lodeline.session import cut

#: What an import of a script path may stand for, in order (fixed values).
_REWRITE = {".js": [".ts", ".tsx", ".js"], ".mjs": [".mts", ".mjs"], ".cjs": [".cts", ".cjs"], ".jsx": [".tsx", ".jsx"]}
#: Extensions that a path without one may have (fixed values).
_PROBE = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
#: Modules of the runtime itself (fixed values).
_BUILTIN = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()

#: What ``configs`` holds: one row per directory with a manifest or compiler configuration, the values in force there.
CONFIG = "repo_id long, dir string, base_url string, aliases array<struct<prefix:string,wildcard:boolean,targets:array<string>>>, dependencies array<string>, self_imports array<string>"
#: ``packages``: the packages a repository defines itself. ``modules``: its Go modules. ``roots``: where its Python modules begin.
PACKAGES = "repo_id long, name string, dir string, exports map<string,string>"
MODULES = "repo_id long, module string, directory string, requires array<string>, replacements map<string,string>"
ROOTS = "repo_id long, root string"

_NONE = "array<struct<grp:int,target:string>>"


def _under(base: Column, rest: Column) -> Column:
    """``rest`` below ``base``; null when it leads out of the repository."""
    return join_path(F.coalesce(base, F.lit("")), rest)


def _pick(base: Column, group: Column) -> Column:
    """The files a script path may stand for. ``base`` stands in the expression once, whatever it is."""

    def files(at: Column) -> Column:
        exact = [at]
        for ext, others in _REWRITE.items():
            exact += [F.when(at.endswith(ext), F.concat(F.substring(at, F.lit(1), F.length(at) - len(ext)), F.lit(o))) for o in others]
        return F.array(*exact, *[F.concat(at, F.lit(e)) for e in _PROBE], *[F.concat(at, F.lit("/index" + e)) for e in _PROBE])

    some = F.filter(F.flatten(F.transform(F.array(base), files)), lambda x: x.isNotNull())
    return F.transform(some, lambda x: F.struct(group.cast("int").alias("grp"), x.alias("target")))


def package_name(spec: Column) -> Column:
    """The package an external specifier names: two parts for a scope, else one."""
    p = F.split(spec, "/", -1)
    return F.when(spec.startswith("@"), F.array_join(F.slice(p, 1, 2), "/")).otherwise(p.getItem(0))


def in_scope(rows: DataFrame, scoped: DataFrame) -> DataFrame:
    """Each row with the columns of the nearest directory up its path that ``scoped`` (``repo_id, dir, ...``) has a row for; nulls without one."""
    dirs = rows.select("repo_id", "path").distinct().select("repo_id", "path", F.explode(F.concat(F.array(F.lit("")), dir_prefixes("path"))).alias("dir"))
    nearest = dirs.join(scoped.select("repo_id", "dir").distinct(), ["repo_id", "dir"]).groupBy("repo_id", "path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return rows.join(nearest.join(scoped, ["repo_id", "dir"]), ["repo_id", "path"], "left")


def _scoped(r: DataFrame, table: DataFrame | None, schema: str) -> DataFrame:
    """``in_scope``, with nulls for a table that is not given."""
    if table is not None:
        return in_scope(r, table)
    fields = r.sparkSession.createDataFrame([], schema).schema.fields
    return r.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name != "repo_id"})


def _matched(pattern: Column, value: Column) -> Column:
    """What a star in the pattern stands for in the value; null where it does not fit, an empty text for an equal pattern without one."""
    head, tail = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    fits = value.startswith(head) & value.endswith(tail) & (F.length(value) >= F.length(head) + F.length(tail))
    return F.when(F.instr(pattern, "*") == 0, F.when(pattern == value, F.lit(""))).when(fits, F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail)))


def _pattern(exports: Column, subpath: Column) -> Column:
    """The key with a star that fits a subpath, the one with the longest head."""
    keys = F.filter(F.map_keys(exports), lambda k: (F.instr(k, "*") > 0) & _matched(k, subpath).isNotNull())
    ranked = F.transform(keys, lambda k: F.struct(F.length(F.substring_index(k, "*", 1)).alias("n"), k.alias("k")))
    return F.array_max(ranked)["k"]


def _exported(exports: Column, subpath: Column, pattern: Column) -> Column:
    """The target a package's exports declare for a subpath: of an equal key, else of the pattern."""
    return F.coalesce(F.try_element_at(exports, subpath), F.replace(F.try_element_at(exports, pattern), F.lit("*"), _matched(pattern, subpath)))


def _scripts(r: DataFrame, configs: DataFrame | None, packages: DataFrame | None) -> DataFrame:
    """Candidates and the verdict without a hit for ES modules and CommonJS."""
    spec = F.col("specifier")
    r = _scoped(r, configs, CONFIG).withColumn("__package", package_name(spec))
    if packages is not None:
        own = packages.select("repo_id", F.col("name").alias("__package"), F.col("dir").alias("__home"), "exports")
        r = r.join(own.dropDuplicates(["repo_id", "__package"]), ["repo_id", "__package"], "left")
    else:
        r = r.withColumns({"__home": F.lit(None).cast("string"), "exports": F.lit(None).cast("map<string,string>")})
    relative = spec.rlike(r"^\.\.?(/|$)")
    rooted, scheme, own_import = spec.startswith("/"), spec.rlike("^[a-z][a-z0-9+.-]*:"), spec.startswith("#")
    fits = F.filter("aliases", lambda a: F.when(a["wildcard"], spec.startswith(a["prefix"])).otherwise(spec == a["prefix"]))
    alias = F.try_element_at(fits, F.lit(1))
    sub = F.when(F.length(spec) > F.length("__package"), F.concat(F.lit("."), F.substring(spec, F.length("__package") + 1, F.length(spec)))).otherwise(F.lit("."))
    r = r.withColumns({"__alias": alias, "__sub": sub})
    if packages is not None:
        r = r.withColumn("__key", _pattern(F.col("exports"), F.col("__sub")))
        r = r.withColumn("__declared", _exported(F.col("exports"), F.col("__sub"), F.col("__key")))
    rest = F.when(F.col("__alias.wildcard"), F.substring(spec, F.length("__alias.prefix") + 1, F.length(spec))).otherwise(F.lit(""))
    bare = ~relative & ~rooted & ~scheme
    plain = bare & F.col("__alias").isNull() & ~own_import
    builtin = F.col("__package").isin(*_BUILTIN)
    none = F.array().cast(_NONE)
    by_alias = by_base = by_package = none
    if configs is not None:
        by_alias = F.flatten(F.transform(F.col("__alias.targets"), lambda t, i: _pick(_under(F.lit(""), F.concat(t, rest)), i)))
        by_base = F.when(F.col("base_url").isNotNull(), _pick(_under(F.col("base_url"), spec), F.lit(100))).otherwise(none)
    if packages is not None:
        within, declared = F.substring("__sub", F.lit(3), F.length("__sub")), F.col("__declared")
        src = F.concat_ws("/", F.nullif(F.col("__home"), F.lit("")), F.lit("src"))
        from_exports = F.when(declared.isNotNull(), _pick(_under(F.col("__home"), declared), F.lit(200))).otherwise(none)
        from_home = F.when(declared.isNull(), _pick(_under(F.col("__home"), within), F.lit(201))).otherwise(none)
        from_source = _pick(_under(src, within), F.lit(201))
        by_package = F.when(F.col("__home").isNotNull() & ~builtin, F.concat(from_exports, from_home, from_source)).otherwise(none)
    cand = (
        F.when(relative, _pick(_under(dir_name("path"), spec), F.lit(0)))
        .when(bare & F.col("__alias").isNotNull(), by_alias)
        .when(plain, F.concat(by_base, by_package))
        .otherwise(none)
    )
    named = F.exists(F.coalesce("self_imports", F.array().cast("array<string>")), lambda k: _matched(k, spec).isNotNull())
    outside = (
        F.when(spec == "", False)
        .when(scheme & ~relative, True)
        .when(own_import & F.col("__alias").isNull(), named)
        .when(plain, builtin | (F.col("__home").isNull() & F.array_contains(F.coalesce("dependencies", F.array().cast("array<string>")), F.col("__package"))))
        .otherwise(False)
    )
    return r.select("repo_id", "path", "lang", "kind", "specifier", cand.alias("cand"), outside.alias("outside"), F.lit(False).alias("folder"))


def _go(r: DataFrame, modules: DataFrame | None) -> DataFrame:
    """Go: a package of one of the repository's modules (the longest path first), a replaced module, the standard library or a requirement."""
    own = "array<struct<n:int,module:string,directory:string>>"
    if modules is not None:
        every = modules.groupBy("repo_id").agg(F.collect_list(F.struct(F.length("module").alias("n"), "module", "directory")).alias("own"))
        r = in_scope(r, modules.select("repo_id", F.col("directory").alias("dir"), "requires", "replacements")).join(every, "repo_id", "left")
    else:
        kinds = {"dir": "string", "requires": "array<string>", "replacements": "map<string,string>", "own": own}
        r = r.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    spec = F.col("specifier")
    below = lambda x: (spec == x) | spec.startswith(F.concat(x, F.lit("/")))
    mine = F.try_element_at(F.sort_array(F.filter(F.coalesce("own", F.array().cast(own)), lambda x: below(x["module"])), False), F.lit(1))
    swapped = F.try_element_at(F.filter(F.map_keys("replacements"), lambda k: below(k)), F.lit(1))
    r = r.withColumn("__mine", mine).withColumn("__from", swapped)
    after = lambda x: F.concat(F.lit("."), F.substring(spec, F.length(x) + 1, F.length(spec)))
    local = _under(F.col("__mine.directory"), after(F.col("__mine.module")))
    moved = _under(F.col("dir"), F.concat(F.try_element_at("replacements", F.col("__from")), F.substring(spec, F.length("__from") + 1, F.length(spec))))
    odd = spec.startswith(".") | spec.startswith("/") | (spec == "")
    place = F.when(odd, None).when(F.col("__mine").isNotNull(), local).when(F.col("__from").isNotNull(), moved)
    # a directory's own name is the empty text; as a package it is a dot
    cand = F.when(place.isNotNull(), F.array(F.struct(F.lit(0).alias("grp"), F.when(place == "", ".").otherwise(place).alias("target")))).otherwise(F.array().cast(_NONE))
    standard = F.instr(F.split(spec, "/").getItem(0), ".") == 0
    outside = ~odd & F.col("__mine").isNull() & F.col("__from").isNull() & (standard | F.exists(F.coalesce("requires", F.array().cast("array<string>")), lambda x: below(x)))
    return r.select("repo_id", "path", "lang", "kind", "specifier", cand.alias("cand"), F.coalesce(outside, F.lit(False)).alias("outside"), F.lit(True).alias("folder"))


def _python(r: DataFrame, configs: DataFrame | None, roots: DataFrame | None) -> DataFrame:
    """Python: ``..mod.sub:name``. The module and a name that is a module of its own are targets both; every root is tried."""
    r = _scoped(r, configs.select("repo_id", "dir", "dependencies") if configs is not None else None, "repo_id long, dir string, dependencies array<string>")
    if roots is not None:
        r = r.join(roots.groupBy("repo_id").agg(F.collect_set("root").alias("roots")), "repo_id", "left")
    spec = F.col("specifier")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    dotted = F.regexp_extract(spec, r"^\.*([^:]*)", 1)
    module, name = F.regexp_replace(dotted, r"\.", "/"), F.regexp_extract(spec, r":(.*)$", 1)
    here = F.split(dir_name("path"), "/", -1)
    depth = F.when(dir_name("path") == "", 0).otherwise(F.size(here))
    up = F.array_join(F.slice(here, F.lit(1), F.greatest(depth - dots + 1, F.lit(0))), "/")
    usual = F.array(F.lit(""), F.lit("src"), F.lit("lib"), dir_name("path"))
    every = F.array_distinct(F.coalesce("roots", usual) if roots is not None else usual)
    bases = F.when(dots > 0, F.when(dots - 1 <= depth, F.array(up))).when(dotted == "", None).otherwise(every)

    def under(root: Column, i: Column) -> Column:
        stem = F.concat_ws("/", F.nullif(root, F.lit("")), F.nullif(F.col("__module"), F.lit("")))
        place = lambda x, g: F.struct((i * 4 + g).cast("int").alias("grp"), x.alias("target"))
        ends = (".py", ".pyi", "/__init__.py", "/__init__.pyi")

        def files(at: Column) -> Column:
            sub = F.when((F.col("__name") != "") & (F.col("__name") != "*"), F.concat_ws("/", F.nullif(at, F.lit("")), F.col("__name")))
            # the folder alone: a namespace package, no target but no stranger either
            return F.array(*[place(F.concat(at, F.lit(e)), 0) for e in ends], *[place(F.concat(sub, F.lit(e)), 1) for e in ends], place(F.concat(at, F.lit("/")), 2))

        return F.flatten(F.transform(F.array(stem), files))

    r = r.withColumns({"__module": module, "__name": name, "__bases": F.coalesce(bases, F.array().cast("array<string>"))})
    cand = F.filter(F.flatten(F.transform(F.col("__bases"), under)), lambda x: x["target"].isNotNull() & ~x["target"].rlike("^[.]py|^/"))
    head = F.split(dotted, r"\.").getItem(0)
    known = F.array_contains(F.coalesce("dependencies", F.array().cast("array<string>")), F.regexp_replace(F.lower(head), "[-_.]+", "-"))
    outside = (dots == 0) & (head != "") & (head.isin(*sorted(sys.stdlib_module_names)) | known)
    return r.select("repo_id", "path", "lang", "kind", "specifier", cand.alias("cand"), outside.alias("outside"), F.lit(False).alias("folder"))


def resolve(refs: DataFrame, paths: DataFrame, configs: DataFrame | None = None, packages: DataFrame | None = None, modules: DataFrame | None = None, roots: DataFrame | None = None, on_disk: DataFrame | None = None) -> DataFrame:
    """``repo_id, path, lang, kind, specifier, outcome, target, confidence``, a row for each target of a reference and one for a reference without.

    ``refs`` has ``repo_id, path, lang, kind, specifier``; ``paths`` ``repo_id, path``, the files that are on the map. ``on_disk`` has the same columns for
    all files seen, ``configs``, ``packages``, ``modules`` and ``roots`` the columns of CONFIG, PACKAGES, MODULES and ROOTS; what is not given is empty, and
    Python then begins at the repository, ``src``, ``lib`` and the file's own folder. Outcomes: internal, external, offMap (on disk, not on the map), unresolved. A
    Go import's target is a directory, ``.`` for the root. Computed imports are unresolved.
    """
    r = cut(refs.select("repo_id", "path", "lang", "kind", "specifier").distinct())
    cols = ["repo_id", "path", "lang", "kind", "specifier"]
    # the candidates are read four times
    every = cut(
        _scripts(r.where("lang in ('ts', 'js')"), configs, packages)
        .unionByName(_go(r.where("lang = 'go'"), modules))
        .unionByName(_python(r.where("lang = 'py'"), configs, roots))
    )
    file = lambda df, on: df.select("repo_id", F.col("path").alias("target"), F.lit(on).alias("place"))
    folder = F.when(dir_name("path") == "", ".").otherwise(dir_name("path"))
    places = file(paths, "map").unionByName(paths.where(F.col("path").endswith(".go")).select("repo_id", folder.alias("target"), F.lit("package").alias("place")))
    places = places.unionByName(paths.where(F.col("path").rlike(r"\.pyi?$")).select("repo_id", F.explode(dir_prefixes("path")).alias("d")).select("repo_id", F.concat("d", F.lit("/")).alias("target"), F.lit("namespace").alias("place")))
    if on_disk is not None:
        places = places.unionByName(file(on_disk, "disk"))
    places = places.groupBy("repo_id", "target").agg(F.collect_set("place").alias("places"))
    probe = every.select(*cols, "folder", F.posexplode("cand").alias("rank", "c")).select(*cols, "folder", "rank", "c.grp", "c.target")
    met = probe.join(places, ["repo_id", "target"])
    has = lambda x: F.array_contains("places", x)
    met = met.withColumn("place", F.when(F.col("folder"), F.when(has("package"), "map")).when(has("map"), "map").when(has("namespace"), "namespace").when(has("disk"), "disk")).where("place is not null")
    # the first group with a file on the map wins; Python's groups are a root's module, its named submodule and its folder
    met = cut(met)
    mapped = met.where("place = 'map'")
    by_group = mapped.groupBy(*cols, "grp").agg(F.min_by("target", "rank").alias("target"), F.count_distinct("target").alias("hits"))
    py = F.col("lang") == "py"
    first = by_group.groupBy(*cols).agg(F.min("grp").alias("best"), F.count_distinct(F.floor(F.col("grp") / 4)).alias("root_hits"))
    chosen = by_group.join(first, cols).where(py | (F.col("grp") == F.col("best")))
    sure = F.when(py, F.col("root_hits") == 1).otherwise(F.col("hits") == 1)
    inside = chosen.groupBy(*cols, "target").agg(F.when(F.min(sure), "certain").otherwise("probable").alias("confidence"))
    off = met.where("place = 'disk'").groupBy(*cols).agg(F.min_by("target", "rank").alias("off"))
    spaces = met.where("place = 'namespace'").select(*cols, F.lit(True).alias("spaced")).distinct()
    j = every.select(*cols, "outside").join(inside, cols, "left").join(off, cols, "left").join(spaces, cols, "left")
    outcome = F.when(F.col("target").isNotNull(), "internal").when(F.col("off").isNotNull(), "offMap").when(F.col("outside") & F.col("spaced").isNull(), "external").otherwise("unresolved")
    return j.select(*cols, outcome.alias("outcome"), F.coalesce("target", "off").alias("target"), "confidence")


def link_edges(resolved: DataFrame) -> DataFrame:
    """Edges ``repo_id, src, dst, kind, weight, confidence``: weight counts distinct specifiers, one probable link makes the edge probable; no self-links.

    Go files stand for their package: the edge begins at its directory, ``.`` for the root.
    """
    package = F.when(dir_name("path") == "", ".").otherwise(dir_name("path"))
    inner = resolved.withColumn("src", F.when(F.col("lang") == "go", package).otherwise(F.col("path"))).where("outcome = 'internal' and src <> target")
    return inner.groupBy("repo_id", "src", F.col("target").alias("dst"), "kind").agg(
        F.count_distinct("specifier").alias("weight"), F.when(F.max((F.col("confidence") == "probable").cast("int")) == 1, "probable").otherwise("certain").alias("confidence")
    )


def capped_set(values: Column, cap: int) -> tuple[Column, Column]:
    """A sorted set cut to ``cap``, and how many were left out. ``values`` is an aggregate array."""
    s = F.array_sort(F.array_distinct(values))
    return F.slice(s, 1, cap), F.greatest(F.size(s) - cap, F.lit(0))
