"""The log parser: records of ``git log -z --name-status`` under a fixed format, as a table of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Record and unit separators of the format ``%x1e%H%x1f%ad%x1f%an%x1f%s%x1e``.
RECORD, UNIT, NUL = "\x1e", "\x1f", "\x00"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of a log file: the reader splits at the record separator, so a log of any length is read in parallel."""
    return spark.read.text(path, lineSep=RECORD).where(F.length("value") > 0)


def parse_log(records: DataFrame, value: str = "value") -> DataFrame:
    """``sha, commit_date, author, subject, files, renames`` from records ``sha US date US author US subject NUL status NUL path ...``.

    Renames (R...) and copies (C...) consume two paths; the second is the file touched. A copy makes no rename. Records without four
    fields are left out; a commit without files has an empty array.
    """
    cut = F.instr(F.col(value), NUL)
    head = F.when(cut > 0, F.substring(F.col(value), F.lit(1), cut - 1)).otherwise(F.col(value))
    field = F.split(head, UNIT, -1)
    rest = F.when(cut > 0, F.substring(F.col(value), cut + 1, F.length(value))).otherwise(F.lit(""))
    parts = F.filter(F.split(F.regexp_replace(rest, "^\\n+", ""), NUL, -1), lambda x: x != "")
    state = "struct<kind:string,first:string,files:array<string>,renames:array<struct<from_path:string,to_path:string>>>"
    start = F.from_json(F.lit('{"files":[],"renames":[]}'), state)

    def step(acc, x):  # noqa: ANN001, ANN202
        two = acc.kind.rlike("^[RC]")
        made = F.struct(acc.first.alias("from_path"), x.alias("to_path"))
        pack = lambda k, f, fs, rs: F.struct(k.alias("kind"), f.alias("first"), fs.alias("files"), rs.alias("renames"))
        none = F.lit(None).cast("string")
        return (
            F.when(acc.kind.isNull(), pack(F.regexp_replace(x, "^\\n", ""), none, acc.files, acc.renames))
            .when(two & acc.first.isNull(), pack(acc.kind, x, acc.files, acc.renames))
            .when(two & acc.kind.startswith("R"), pack(none, none, F.array_append(acc.files, x), F.array_append(acc.renames, made)))
            .otherwise(pack(none, none, F.array_append(acc.files, x), acc.renames))
        )

    done = F.aggregate(parts, start, step)
    out = records.where(F.size(field) >= 4).select(
        F.element_at(field, 1).alias("sha"), F.try_to_timestamp(F.substring(F.element_at(field, 2), 1, 10)).cast("date").alias("commit_date"), F.element_at(field, 3).alias("author"), F.element_at(field, 4).alias("subject"), done.alias("d")
    )
    return out.select("sha", "commit_date", "author", "subject", F.col("d.files").alias("files"), F.col("d.renames").alias("renames"))
