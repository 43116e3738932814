"""Reading a source tree: files with their text, ignore rules, and why a file was skipped."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.languages import language, treatment

#: Longer files are not read.
MAX_BYTES = 512 * 1024
#: Where binary content is looked for.
SNIFF = 8192


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` with ``path`` (relative), ``bytes``, ``binary`` and ``text``; executors read in parallel.

    Binary files have a null text. Files over MAX_BYTES are listed, never opened: the filter on their length reaches the scan, which
    leaves out their content; they count as not binary and have a null text.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(base), "")
    binary = F.instr(F.decode(F.substring("content", 1, SNIFF), "ISO-8859-1"), "\0") > 0
    read = raw.where(F.col("length") <= MAX_BYTES).select(rel.alias("path"), F.col("length").alias("bytes"), binary.alias("binary"), F.when(~binary, F.decode("content", "UTF-8")).alias("text"))
    listed = raw.where(F.col("length") > MAX_BYTES).select(rel.alias("path"), F.col("length").alias("bytes"), F.lit(False).alias("binary"), F.lit(None).cast("string").alias("text"))
    return read.unionByName(listed)


def classify(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``path, bytes, lang, reason``: ignored, unsupported, tooLarge or binary in that order, null for a file that is kept."""
    f = files.withColumn("lang", language("path"))
    if rules is not None:
        f = f.join(ignored(f.select("path"), rules).withColumn("ignored", F.lit(True)), "path", "left")
    else:
        f = f.withColumn("ignored", F.lit(False))
    reason = (
        F.when(F.coalesce("ignored", F.lit(False)), "ignored")
        .when(treatment("path").isin("unread", "unsupported"), "unsupported")
        .when(F.col("bytes") > MAX_BYTES, "tooLarge")
        .when(F.col("binary"), "binary")
    )
    return f.select("path", "bytes", "lang", reason.alias("reason"))


def compile_rule(line: str) -> dict | None:
    """One line of an ignore file as ``{negated, pattern}``, a regular expression over paths below the file's folder; None for blanks and comments.

    A leading ``!`` takes back; a trailing slash matches folders only; a slash inside anchors at the folder; ``*`` and ``?`` stay within a
    segment, ``**`` spans segments, brackets are classes.
    """
    rule = line.rstrip("\r\n")
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    rule = re.sub(r"^\\([#!])", r"\1", rule)
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            j = rule.index("]", i + 1)
            out, i = out + "[" + rule[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
        else:
            if rule[i] == "\\" and i + 1 < len(rule):
                i += 1
            out, i = out + re.escape(rule[i]), i + 1
    head = "^" if anchored else "(?:^|/)"
    tail = "/" if folder else "(?:/|$)"
    return {"negated": negated, "pattern": head + out + tail}


def compile_rules(lines: DataFrame, line: str = "line") -> DataFrame:
    """``line, negated, pattern`` of the distinct rule lines of a table; each text is compiled once, on the executors."""

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            made = [(t, r["negated"], r["pattern"]) for t in f[line] if (r := compile_rule(t))]
            yield pd.DataFrame(made, columns=["line", "negated", "pattern"])

    return lines.where(F.col(line).isNotNull()).select(line).distinct().mapInPandas(run, "line string, negated boolean, pattern string")


def rules_of(spark: SparkSession, lines: list[str], scope: list | None = None) -> DataFrame:
    """A rule table ``place, negated, pattern`` (with ``repo_id`` when ``scope`` gives one a line)."""
    rows = []
    for k, line in enumerate(lines):
        rule = compile_rule(line)
        if rule:
            rows.append(((scope[k],) if scope else ()) + (k, rule["negated"], rule["pattern"]))
    return spark.createDataFrame(rows, ("repo_id long, " if scope else "") + "place int, negated boolean, pattern string")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths whose last matching rule ignores them. Rules of a repository apply to its paths when both sides have ``repo_id``.

    The rule side is small (the lines of ignore files); Spark decides by its size whether to broadcast it.
    """
    keys = [c for c in ("repo_id",) if c in paths.columns and c in rules.columns]
    matches = F.expr("path rlike pattern")
    met = (paths.join(rules, keys) if keys else paths.join(rules)).where(matches)
    w = Window.partitionBy(*keys, "path").orderBy(F.desc("place"))
    return met.withColumn("rank", F.row_number().over(w)).where("rank = 1 and not negated").select(*keys, "path")


def line_count(text: Column | str) -> Column:
    """Lines of a text: breaks, and one more when the last line has none; 0 for an empty text, null for null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when(t.endswith("\n"), 0).otherwise(1))
