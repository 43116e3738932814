"""Queries over files, logs of attempts, points and tables' integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.identity import node_id
from lodeline.functions.languages import is_sideshow, treatment
from lodeline.functions.paths import clean_path, dir_name, join_path, name_tokens, segments, shared_depth, slug
from lodeline.operators import progress as P
from lodeline.operators import spatial as S
from lodeline.operators import validate as Q
from lodeline.operators.ranking import top_per_group
from lodeline.operators.resolve import link_edges, package_name, resolve
from lodeline.operators.scan import scan_files
from lodeline.plans import views as V
from lodeline.plans.views import CLEAN, SQL
from lodeline.session import table
from lodeline.sources.tree import compile_rules, ignored, line_count


def line_counts(s: SparkSession, d: str) -> DataFrame:
    """Lines by counting breaks, beside the stored number; and characters."""
    t = table(s, d, "walked_files").where("source_text is not null")
    return t.groupBy("file_id").agg(F.max(line_count("source_text")).alias("lines"), F.max("loc").alias("loc"), F.max(F.length("source_text")).alias("chars"))


def skip_histogram(s: SparkSession, d: str) -> DataFrame:
    """Why files were not read, by repository, with zeros for reasons that did not occur."""
    t = table(s, d, "dropped_files").groupBy("file_id").agg(F.max("repo_id").alias("repo_id"), F.max("reason").alias("reason"))
    reasons = s.createDataFrame([("ignored",), ("tooLarge",), ("binary",), ("unsupported",)], "reason string")
    repos = table(s, d, "repos").select("repo_id").distinct()
    n = t.groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("files"))
    return repos.join(F.broadcast(reasons)).join(n, ["repo_id", "reason"], "left").select("repo_id", "reason", F.coalesce("files", F.lit(0)).alias("files"))


def ignored_files(s: SparkSession, d: str) -> DataFrame:
    """Files that the repository's excludes now in force (or the default row's) would leave out."""
    o = table(s, d, "walk_options").groupBy("repo_id").agg(F.max("excludes").alias("excludes"))
    default = o.where("repo_id = 0").select(F.col("excludes").alias("d"))
    own = table(s, d, "repos").select("repo_id").distinct().join(o.where("repo_id <> 0"), "repo_id", "left").join(F.broadcast(default)).select("repo_id", F.coalesce("excludes", "d").alias("x"))
    lines = own.select("repo_id", F.posexplode("x").alias("place", "line"))
    rules = lines.join(compile_rules(lines), "line").select("repo_id", "place", "negated", "pattern")
    return ignored(V.files(s, d).select("repo_id", "path").distinct(), rules)


def treatments(s: SparkSession, d: str) -> DataFrame:
    f = V.files(s, d)
    return f.groupBy("repo_id", treatment("path").alias("treatment")).agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("bytes").alias("bytes"))


def coverage_totals(s: SparkSession, d: str) -> DataFrame:
    """Per repository: files mapped, files meant to be read that were not, and whether that leaves too little to go by."""
    read = V.files(s, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("mapped"))
    lost = table(s, d, "dropped_files").groupBy("repo_id").agg(F.count_distinct("file_id").alias("unreadable"))
    j = read.join(lost, "repo_id", "full_outer").select("repo_id", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unreadable", F.lit(0)).alias("unreadable"))
    return j.withColumn("refused", (F.col("unreadable") >= 5) & (F.col("mapped") * 9 < F.col("unreadable")))


def node_ids(s: SparkSession, d: str) -> DataFrame:
    return V.files(s, d).select("path").distinct().select("path", node_id("path").alias("id"))


def sideshow_share(s: SparkSession, d: str) -> DataFrame:
    f = V.files(s, d)
    return f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(is_sideshow("path")).alias("sideshow"))


def name_words(s: SparkSession, d: str) -> DataFrame:
    w = V.files(s, d).select("repo_id", "path").distinct().select("repo_id", F.explode(F.array_distinct(name_tokens("path"))).alias("word"))
    return w.groupBy("repo_id", "word").agg(F.count(F.lit(1)).alias("files"))


def folder_slugs(s: SparkSession, d: str) -> DataFrame:
    return V.files(s, d).select(dir_name("path").alias("dir")).distinct().select("dir", slug("dir").alias("slug"))


def shared_with_next(s: SparkSession, d: str) -> DataFrame:
    """How many directories each file shares with the next file of its repository in path order."""
    w = Window.partitionBy("repo_id").orderBy("path")
    f = V.files(s, d).select("repo_id", "path").distinct().withColumn("next", F.lead("path").over(w)).where("next is not null")
    return f.select("repo_id", "path", shared_depth(segments("path"), segments("next")).alias("shared"))


def parent_paths(s: SparkSession, d: str) -> DataFrame:
    """Each file's path seen from two folders up and back again: the joining of ``..`` and ``.``, null beyond the root."""
    f = V.files(s, d).select("path").distinct()
    return f.select("path", join_path(dir_name("path"), F.lit("../../x/./y")).alias("joined"))


def import_refs(s: SparkSession, d: str) -> DataFrame:
    """Imports of every file by kind, and exported names, per repository and language."""
    t = table(s, d, "walked_files").where("source_text is not null").select("repo_id", clean_path("path").alias("path"), "source_text")
    x = scan_files(t).dropDuplicates(["repo_id", "path"])
    return x.groupBy("repo_id", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("refs")).alias("refs"), F.sum(F.size("names")).alias("names"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "walked_files").where("source_text is not null").select("repo_id", clean_path("path").alias("path"), "source_text")
    x = scan_files(t).dropDuplicates(["repo_id", "path"])
    refs = x.select("repo_id", "path", "lang", F.explode("refs").alias("r")).select("repo_id", "path", "lang", "r.kind", "r.specifier")
    return resolve(refs, V.files(s, d).select("repo_id", "path"))


def import_outcomes(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d).groupBy("repo_id", "lang", "outcome").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("path").alias("files"))


def import_edges(s: SparkSession, d: str) -> DataFrame:
    return link_edges(_resolved(s, d))


def externals_capped(s: SparkSession, d: str) -> DataFrame:
    """The packages each repository takes from outside: a sorted set of twenty at most, and how many were left out."""
    x = _resolved(s, d).where("outcome = 'external'").select("repo_id", package_name(F.col("specifier")).alias("p")).distinct()
    # cut first, gather then: a repository may take any number of packages
    first = top_per_group(x, ["repo_id"], [F.col("p")], 20).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("p")), " ").alias("packages"))
    total = x.groupBy("repo_id").agg(F.greatest(F.count(F.lit(1)) - 20, F.lit(0)).alias("dropped"))
    return first.join(total, "repo_id")


def _log(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    log = e.select("user_id", "event_type", "ts", "event_id", (F.col("value") >= 50).alias("passed"))
    return P.attempts(log, ["user_id", "event_type"], ["ts", "event_id"])


def tally(s: SparkSession, d: str) -> DataFrame:
    return P.tally(_log(s, d), ["user_id", "event_type"])


def tally_summary(s: SparkSession, d: str) -> DataFrame:
    return P.readings(tally(s, d), ["event_type"])


def first_passes(s: SparkSession, d: str) -> DataFrame:
    """Proved and shown event types of each user."""
    f = P.fold(_log(s, d), ["user_id"], "event_type")
    return f.select("user_id", F.array_join("proved", " ").alias("proved"), F.array_join("shown", " ").alias("shown"))


def medals(s: SparkSession, d: str) -> DataFrame:
    """Each event type's medal by the share of users who pass it at once."""
    t = tally(s, d).groupBy("event_type").agg(F.count_if(F.col("passed_on") == 1).alias("have"), F.count(F.lit(1)).alias("achievable"))
    return P.medals(t, ["event_type"], {"bronze": 0.1, "silver": 0.5, "gold": 1.0})


def previous_overlap(s: SparkSession, d: str) -> DataFrame:
    """For each user and day: the event types of the day, how many of them the day before had too, and their overlap."""
    day = table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    sets = day.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("event_type")).alias("kinds"))
    w = Window.partitionBy("user_id").orderBy("day")
    x = sets.withColumn("before", F.lag("kinds").over(w))
    both = F.size(F.array_intersect("kinds", "before"))
    return x.where("before is not null").select("user_id", "day", both.alias("shared"), F.round(both / F.size(F.array_union("kinds", "before")), 6).alias("overlap"))


def _points(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select("vec_id", "label", (F.element_at("embedding", 1).cast("double") * 100).alias("x"), (F.element_at("embedding", 2).cast("double") * 100).alias("y"))


def region_centroids(s: SparkSession, d: str) -> DataFrame:
    return S.centroids(_points(s, d), ["label"])


def region_bounds(s: SparkSession, d: str) -> DataFrame:
    b = S.bounds(_points(s, d), ["label"])
    return b.select("label", *[F.round(c, 6).alias(c) for c in b.columns if c != "label"])


def spread_ratio(s: SparkSession, d: str) -> DataFrame:
    r = S.spread_ratio(_points(s, d), "label")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def near_pairs(s: SparkSession, d: str) -> DataFrame:
    """Points no farther apart than one unit."""
    return S.within(_points(s, d), "vec_id", 1.0).select("a", "b", F.round("distance", 6).alias("distance"))


def label_legend(s: SparkSession, d: str) -> DataFrame:
    """Labels by size with their share; labels of fewer than a twentieth of the points fold into one row."""
    n = table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    x = n.join(F.broadcast(total)).withColumn("row", F.when(F.col("n") * 20 >= F.col("total"), F.col("label").cast("string")).otherwise("other"))
    return x.groupBy("row").agg(F.sum("n").alias("points"), F.round(F.sum(F.col("n") / F.col("total")), 6).alias("share"))


def medians(s: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile of file sizes by language."""
    f = V.files(s, d).where("lang is not null and bytes is not null")
    return f.groupBy("lang").agg(F.expr("percentile(bytes, 0.5)").alias("median"), F.round(F.expr("percentile(bytes, 0.95)"), 6).alias("p95"), F.count(F.lit(1)).alias("files"))


def validate_tables(s: SparkSession, d: str) -> DataFrame:
    """Violations in the walked files, commits and edges: rule, how many, and the smallest entity."""
    f = V.files(s, d)
    repos = table(s, d, "repos").select("repo_id").distinct()
    e = V.edges(s, d)
    n = e.select("repo_id", F.explode(F.array("src", "dst")).alias("path")).distinct()
    c = V.commits(s, d)
    checks = Q.all_of(
        Q.row_rules(f, F.col("file_id"), {"path is relative": F.col("path").rlike(r"^[^/\\]+(/[^\\]*)*$"), "bytes are known": F.col("bytes") >= 0, "language is known": F.col("lang").isNotNull()}),
        Q.unique(f, ["repo_id", "path"], "paths are unique"),
        Q.refers(f, ["repo_id"], repos, "repository exists"),
        Q.row_rules(e, F.concat_ws("|", "repo_id", "src", "dst"), {"edge has two ends": F.col("src") != F.col("dst"), "weight is positive": F.col("weight") >= 1}),
        Q.refers(n, ["repo_id", "path"], f.select("repo_id", "path"), "edge ends are files"),
        Q.row_rules(c, F.concat_ws("|", "repo_id", "sha"), {"sha is hex": F.col("sha").rlike("^[0-9a-f]{40}$"), "commit has files": F.size("files") > 0, "author is known": F.col("author").isNotNull()}),
    )
    return checks.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"), F.min("entity").alias("smallest"))


def summary(s: SparkSession, d: str) -> DataFrame:
    """Headline numbers over all repositories, one metric a row."""
    f, c, e = V.files(s, d), V.commits(s, d), V.edges(s, d)
    n = e.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [one(f, "files"), one(c, "commits"), one(e, "edges"), one(n, "nodes"), one(f.select("repo_id").distinct(), "repositories"), one(f.join(n.withColumnRenamed("node", "path"), ["repo_id", "path"], "left_anti"), "unlinked")]
    return Q.all_of(*parts)


QUERIES = {f.__name__: f for f in (
    line_counts, skip_histogram, ignored_files, treatments, coverage_totals, node_ids, sideshow_share, name_words, folder_slugs, shared_with_next, parent_paths, import_refs, import_outcomes,
    import_edges, externals_capped, tally, tally_summary, first_passes, medals, previous_overlap, region_centroids, region_bounds, spread_ratio, near_pairs, label_legend, medians,
    validate_tables, summary,
)}

_LOG = "WITH log AS (SELECT user_id, event_type, value >= 50 AS passed, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events), tl AS (SELECT user_id, event_type, count(*) AS graded, coalesce(min(CASE WHEN passed THEN attempt END), 0) AS passed_on FROM log GROUP BY ALL)\n"
_PT = "WITH pt AS (SELECT vec_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)\n"
_DIRP = "array_to_string(string_split({0}, '/')[1:-2], '/')"
_TOKP = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))"
_FNV = "list_reduce(list_prepend({0}::BIGINT, list_transform(string_split(path, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (((xor(h, c) * 16777619::BIGINT) & 4294967295) * 16777619::BIGINT) & 4294967295)"
_EXT = "lower(CASE WHEN regexp_matches(string_split(path, '/')[-1], '.\\.[^.]+$') THEN regexp_extract(path, '([^.]*)$', 1) ELSE '' END)"
ORACLE = {
    "line_counts": """SELECT file_id, max(CASE WHEN source_text = '' THEN 0 ELSE length(source_text) - length(replace(source_text, chr(10), '')) + CASE WHEN ends_with(source_text, chr(10)) THEN 0 ELSE 1 END END) AS lines,
  max(loc) AS loc, max(length(source_text)) AS chars FROM walked_files WHERE source_text IS NOT NULL GROUP BY file_id""",
    "skip_histogram": """WITH t AS (SELECT file_id, max(repo_id) AS repo_id, max(reason) AS reason FROM dropped_files GROUP BY file_id)
SELECT r.repo_id, x.reason, count(t.file_id) AS files FROM (SELECT DISTINCT repo_id FROM repos) r CROSS JOIN (VALUES ('ignored'), ('tooLarge'), ('binary'), ('unsupported')) x(reason)
  LEFT JOIN t ON t.repo_id = r.repo_id AND t.reason = x.reason GROUP BY ALL""",
    "ignored_files": SQL + """, o AS (SELECT repo_id, max(excludes) AS ex FROM walk_options GROUP BY repo_id),
own AS (SELECT r.repo_id, unnest(coalesce(o.ex, (SELECT ex FROM o WHERE repo_id = 0))) AS line FROM (SELECT DISTINCT repo_id FROM repos) r LEFT JOIN o ON o.repo_id = r.repo_id AND o.repo_id <> 0)
SELECT DISTINCT f.repo_id, f.path FROM files f JOIN own ON own.repo_id = f.repo_id WHERE
  CASE WHEN ends_with(line, '/') AND contains(rtrim(line, '/'), '/') THEN starts_with(f.path, line)
       WHEN ends_with(line, '/') THEN contains('/' || f.path, '/' || line)
       WHEN starts_with(line, '*') THEN regexp_matches(f.path, replace(line[2:], '.', '\\.') || '(/|$)')
       ELSE contains('/' || f.path || '/', '/' || line || '/') END""",
    "treatments": SQL + f"""SELECT repo_id, CASE WHEN {_EXT} IN ('ts','tsx','mts','cts','js','jsx','mjs','cjs','go','py','pyi','pyw') THEN 'scanned' WHEN {_EXT} IN ('json','jsonc','md') THEN 'carried'
  ELSE 'unsupported' END AS treatment, count(*) AS files, sum(loc) AS loc, sum(bytes) AS bytes FROM files GROUP BY ALL""",
    "coverage_totals": SQL + """, a AS (SELECT repo_id, count(*) AS mapped FROM files GROUP BY ALL), b AS (SELECT repo_id, count(DISTINCT file_id) AS unreadable FROM dropped_files GROUP BY ALL)
SELECT repo_id, coalesce(mapped, 0) AS mapped, coalesce(unreadable, 0) AS unreadable, coalesce(unreadable, 0) >= 5 AND coalesce(mapped, 0) * 9 < coalesce(unreadable, 0) AS refused FROM a FULL JOIN b USING (repo_id)""",
    "node_ids": SQL + f"SELECT DISTINCT path, 'n:' || left(lpad(lower(to_hex({_FNV.format(0x811C9DC5)})), 8, '0') || lpad(lower(to_hex({_FNV.format(0x7F4A7C15)})), 8, '0'), 12) AS id FROM files",
    "sideshow_share": SQL + """SELECT repo_id, count(*) AS files, count(CASE WHEN regexp_matches(path, '(^|/)(__)?(tests?|testutils?|testdata|fixtures?|benchmarks?|scripts?|examples?)(__)?(/|$)|\\.(test|spec)\\.|\\.(json|md)$', 'i') THEN 1 END) AS sideshow FROM files GROUP BY ALL""",
    "name_words": SQL + f"SELECT repo_id, word, count(*) AS files FROM (SELECT repo_id, path, unnest({_TOKP}) AS word FROM (SELECT DISTINCT repo_id, path FROM files)) GROUP BY ALL",
    "folder_slugs": SQL + f"SELECT dir, CASE WHEN sl = '' THEN 'root' ELSE sl END AS slug FROM (SELECT DISTINCT {_DIRP.format('path')} AS dir, trim(regexp_replace(lower({_DIRP.format('path')}), '[^a-z0-9]+', '-', 'g'), '-') AS sl FROM files)",
    "shared_with_next": SQL + """, x AS (SELECT repo_id, path, lead(path) OVER (PARTITION BY repo_id ORDER BY path) AS nx FROM (SELECT DISTINCT repo_id, path FROM files)),
y AS (SELECT repo_id, path, string_split(path, '/')[1:-2] AS a, string_split(nx, '/')[1:-2] AS b FROM x WHERE nx IS NOT NULL)
SELECT repo_id, path, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS shared FROM y""",
    "parent_paths": SQL + """SELECT DISTINCT path, CASE WHEN len(string_split(path, '/')) < 3 THEN NULL ELSE array_to_string(list_concat(string_split(path, '/')[1:-4], ['x', 'y']), '/') END AS joined FROM files""",
    "tally": _LOG + "SELECT * FROM tl",
    "tally_summary": _LOG + """SELECT event_type, count(*) AS boards, sum(graded) AS graded, count(CASE WHEN passed_on = 1 THEN 1 END) AS first, count(CASE WHEN passed_on > 1 THEN 1 END) AS later,
  count(CASE WHEN passed_on = 0 THEN 1 END) AS unpassed FROM tl GROUP BY event_type""",
    "first_passes": _LOG + """SELECT user_id, coalesce(string_agg(CASE WHEN passed_on = 1 THEN event_type END, ' ' ORDER BY event_type), '') AS proved,
  coalesce(string_agg(CASE WHEN passed_on > 1 THEN event_type END, ' ' ORDER BY event_type), '') AS shown FROM tl WHERE passed_on > 0 GROUP BY user_id""",
    "medals": _LOG + """, x AS (SELECT event_type, count(CASE WHEN passed_on = 1 THEN 1 END) AS have, count(*) AS achievable FROM tl GROUP BY event_type)
SELECT event_type, have, achievable, CASE WHEN have >= achievable THEN 'gold' WHEN have >= greatest(1, ceil(achievable * 0.5)) THEN 'silver' WHEN have >= greatest(1, ceil(achievable * 0.1)) THEN 'bronze' END AS medal FROM x""",
    "previous_overlap": """WITH dd AS (SELECT user_id, ts::DATE AS day, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY ALL),
x AS (SELECT *, lag(kinds) OVER (PARTITION BY user_id ORDER BY day) AS before FROM dd)
SELECT user_id, day, len(list_intersect(kinds, before)) AS shared, round(len(list_intersect(kinds, before)) / len(list_distinct(list_concat(kinds, before))), 6) AS overlap FROM x WHERE before IS NOT NULL""",
    "region_centroids": _PT + "SELECT label, count(*) AS members, floor(avg(x) * 100 + 0.5) / 100 AS cx, floor(avg(y) * 100 + 0.5) / 100 AS cy FROM pt GROUP BY label",
    "region_bounds": _PT + "SELECT label, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM pt GROUP BY label",
    "spread_ratio": _PT + """, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM pt GROUP BY label), i AS (SELECT avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS inn FROM pt JOIN c USING (label)),
b AS (SELECT avg(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS btw FROM c a JOIN c b ON a.label < b.label)
SELECT round(inn, 6) AS inner, round(btw, 6) AS between, round(inn / btw, 6) AS ratio FROM i, b""".replace(" AS inner", ' AS "inner"').replace(" AS between", ' AS "between"'),
    "near_pairs": _PT + "SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM pt a JOIN pt b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.0",
    "label_legend": """WITH n AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM embeddings GROUP BY label)
SELECT CASE WHEN n * 20 >= total THEN label::VARCHAR ELSE 'other' END AS row, sum(n) AS points, round(sum(n / total), 6) AS share FROM n GROUP BY 1""",
    "medians": SQL + "SELECT lang, quantile_cont(bytes, 0.5) AS median, round(quantile_cont(bytes, 0.95), 6) AS p95, count(*) AS files FROM files WHERE lang IS NOT NULL AND bytes IS NOT NULL GROUP BY lang",
    "validate_tables": SQL + """, v AS (
SELECT 'path is relative' AS rule, file_id::VARCHAR AS entity FROM files WHERE NOT coalesce(regexp_matches(path, '^[^/\\\\]+(/[^\\\\]*)*$'), false)
UNION ALL SELECT 'bytes are known', file_id::VARCHAR FROM files WHERE NOT coalesce(bytes >= 0, false) UNION ALL SELECT 'language is known', file_id::VARCHAR FROM files WHERE lang IS NULL
UNION ALL SELECT 'paths are unique', repo_id || '|' || path FROM files GROUP BY repo_id, path HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'repository exists', repo_id::VARCHAR FROM files WHERE repo_id NOT IN (SELECT repo_id FROM repos)
UNION ALL SELECT 'edge has two ends', repo_id || '|' || src || '|' || dst FROM edges WHERE src = dst
UNION ALL SELECT DISTINCT 'edge ends are files', n.repo_id || '|' || n.path FROM (SELECT repo_id, src AS path FROM edges UNION SELECT repo_id, dst FROM edges) n WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_id = n.repo_id AND f.path = n.path)
UNION ALL SELECT 'sha is hex', repo_id || '|' || sha FROM commits WHERE NOT regexp_matches(sha, '^[0-9a-f]{40}$')
UNION ALL SELECT 'commit has files', repo_id || '|' || sha FROM commits WHERE len(files) = 0 UNION ALL SELECT 'author is known', repo_id || '|' || sha FROM commits WHERE author IS NULL)
SELECT rule, count(*) AS violations, min(entity) AS smallest FROM v GROUP BY rule""",
    "summary": SQL + """, nd AS (SELECT repo_id, src AS path FROM edges UNION SELECT repo_id, dst FROM edges)
SELECT 'files' AS metric, count(*) AS value FROM files UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'nodes', count(*) FROM nd
UNION ALL SELECT 'repositories', count(DISTINCT repo_id) FROM files UNION ALL SELECT 'unlinked', count(*) FROM files f WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.repo_id = f.repo_id AND nd.path = f.path)""",
}
