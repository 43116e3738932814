"""Manifests: JSON with comments, configuration inheritance, module files and dependency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.paths import dir_name, join_path
from lodeline.session import cut

#: How often a configuration may inherit.
EXTENDS_DEPTH = 8


def strip_jsonc(text: Column | str) -> Column:
    """JSON text without comments and trailing commas; strings keep what looks like either."""
    t = F.col(text) if isinstance(text, str) else text
    string = r'"(?:[^"\\]|\\.)*"'
    bare = F.regexp_replace(t, f"({string})|//[^\\n]*|(?s:/\\*.*?\\*/)", "$1")
    return F.regexp_replace(bare, f"({string})|,(?=\\s*[}}\\]])", "$1")


def read_jsonc(text: Column | str, schema: str) -> Column:
    """The parsed value; null where the text is no JSON even so."""
    return F.from_json(strip_jsonc(text), schema, {"mode": "PERMISSIVE"})


def tsconfig_chain(configs: DataFrame) -> DataFrame:
    """Effective ``base_url`` and ``paths`` of each configuration, inherited over at most EXTENDS_DEPTH steps.

    ``configs`` has ``path, text``. A value set nearer wins; an ``extends`` that leads nowhere ends the chain.
    """
    schema = "extends string, compilerOptions struct<baseUrl:string, paths:map<string,array<string>>>"
    c = configs.select("path", read_jsonc("text", schema).alias("j"))
    own = cut(
        c.select(
            "path",
            F.when(F.col("j.extends").startswith("."), join_path(dir_name("path"), F.when(F.col("j.extends").endswith(".json"), F.col("j.extends")).otherwise(F.concat("j.extends", F.lit(".json"))))).alias("up"),
            F.col("j.compilerOptions.baseUrl").alias("base_url"),
            F.col("j.compilerOptions.paths").alias("paths"),
        )
    )
    at = own
    for _ in range(EXTENDS_DEPTH):
        if at.where("up is not null").isEmpty():
            break
        parent = own.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("base_url").alias("b2"), F.col("paths").alias("p2"))
        at = cut(at.join(parent, "up", "left").select("path", F.col("up2").alias("up"), F.coalesce("base_url", "b2").alias("base_url"), F.coalesce("paths", "p2").alias("paths")))
    return at.select("path", "base_url", "paths")


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Each file's nearest manifest up its directory chain: ``path, manifest`` (null without one). Both sides have ``path``."""
    dirs = files.select("path", F.explode(F.concat(F.array(F.lit("")), _dirs("path"))).alias("dir"))
    m = manifests.select(F.col("path").alias("manifest"), dir_name("path").alias("dir"))
    best = dirs.join(m, "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("n"), "manifest")).alias("b"))
    return files.select("path").join(best, "path", "left").select("path", F.col("b.manifest").alias("manifest"))


def _dirs(path: str) -> Column:
    from lodeline.functions.paths import dir_prefixes

    return dir_prefixes(path)


def go_modules(files: DataFrame) -> DataFrame:
    """``path, module, kind, name, version, target`` from go.mod texts: the module line, require and replace lines, alone or in blocks."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "//[^\\n]*", ""), "\\r?\\n", -1)).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    opens = F.regexp_extract("line", r"^(require|replace|exclude|retract)\s*\($", 1)
    closes = F.col("line") == ")"
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(opens != "", opens).when(closes, F.lit("-"))
    block = F.last(mark, ignorenulls=True).over(w)
    x = lines.withColumn("block", F.when(block != "-", block)).where((F.col("line") != "") & (F.col("line") != ")") & ~F.col("line").rlike(r"\($"))
    single = F.regexp_extract("line", r"^(require|replace|module)\s+(.+)$", 1)
    body = F.when(single != "", F.regexp_extract("line", r"^(?:require|replace|module)\s+(.+)$", 1)).otherwise(F.col("line"))
    kind = F.when(single != "", single).otherwise(F.col("block"))
    y = x.select("path", kind.alias("kind"), body.alias("body")).where("kind in ('module', 'require', 'replace')")
    clean = F.regexp_replace("body", '"', "")
    return y.select(
        "path",
        "kind",
        F.regexp_extract(clean, r"^(\S+)", 1).alias("name"),
        F.nullif(F.regexp_extract(clean, r"^\S+\s+(v\S+)", 1), F.lit("")).alias("version"),
        F.nullif(F.regexp_extract(clean, r"=>\s*(\S+)", 1), F.lit("")).alias("target"),
    )


def python_requirements(files: DataFrame) -> DataFrame:
    """``path, name``: distributions named in requirement files, dependency arrays and dependency tables, in normal form."""
    one = F.split("text", "\\r?\\n", -1)
    req = files.where(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$")).select("path", F.explode(one).alias("spec"))
    arrays = files.where(F.col("path").rlike(r"(^|/)(pyproject\.toml|setup\.cfg)$"))
    block = F.regexp_extract("text", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    listed = arrays.select("path", F.explode(F.regexp_extract_all(block, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))).alias("spec"))
    poetry = F.regexp_extract("text", r"(?s)\[tool\.poetry\.dependencies\](.*?)(?:\n\[|$)", 1)
    tabled = arrays.select("path", F.explode(F.regexp_extract_all(poetry, F.lit(r"(?m)^\s*([A-Za-z0-9][\w.-]*)\s*="), F.lit(1))).alias("spec")).where("spec <> 'python'")
    install = F.regexp_extract("text", r"(?s)install_requires\s*=\s*(.*?)(?:\n\S|$)", 1)
    cfg = arrays.select("path", F.explode(F.split(install, "\\r?\\n", -1)).alias("spec"))
    allof = req.unionByName(listed).unionByName(tabled).unionByName(cfg)
    name = F.regexp_extract(F.trim("spec"), r"^([A-Za-z0-9][\w.-]*)", 1)
    return allof.where(~F.trim(F.col("spec")).rlike("^(#|-|$)")).select("path", F.regexp_replace(F.lower(name), "[-_.]+", "-").alias("name")).where("name <> ''").distinct()
