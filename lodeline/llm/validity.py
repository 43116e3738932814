"""Source files that do not parse.

Method: for each language a lexer with a pushdown stack of open delimiters and literals finds unterminated literals, unbalanced
delimiters, premature ends and merge-conflict markers in code. What the lexer lets through is then held against the
language's grammar, which works on the lexer's tokens (Python: on the text, by the interpreter's own parser).

No verdict depends on how deep a text is nested: the parsers descend as deep as it goes (see ``base.deep``), and where Python's own parser
gives up, brackets are judged from the inside out. Python's grammar is that of the running interpreter, so executors should run 3.10 or newer, all alike.

Judging is a map over rows: no text is shuffled, only one short row per file. Repeated deliveries of a file are judged again and then
dropped: finding them first would shuffle every text to save a few per cent of the parsing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.paths import extension
from lodeline.session import spread

#: The dialect that an extension names (fixed values).
DIALECTS = {
    "ts": "ts", "mts": "ts", "tsx": "tsx", "js": "mjs", "mjs": "mjs", "jsx": "jsx", "cjs": "cjs", "go": "go", "py": "py", "pyi": "py",
}
#: What the dialects are called in reports.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mjs": "javascript", "jsx": "javascript", "cjs": "javascript", "go": "go", "py": "python"}


def fault(text: str, dialect: str) -> str | None:
    """The kind of fault of a text, or None for a valid file: literal, delimiter, end, conflict, character or grammar."""
    from lodeline.llm.syntax import es, go, py
    from lodeline.llm.syntax.base import Fault

    try:
        if dialect == "py":
            py.check(text)
        elif dialect == "go":
            go.check(text)
        else:
            es.check(text, dialect)
    except Fault as f:
        return f.args[0]
    return None


def language(path: Column | str) -> Column:
    """The language that a path's extension names, null for one that is not judged."""
    names = F.create_map(*[F.lit(x) for e, dialect in DIALECTS.items() for x in (e, LANGUAGES[dialect])])
    return F.element_at(names, extension(path))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        faults = [fault(t, DIALECTS[e]) for t, e in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(faults, pa.string())], ["file", "repo", "ext", "fault"])


def judged(files: DataFrame, file_id: str, repo_id: str, path: str, text: str) -> DataFrame:
    """``file, repo, ext, fault``: every file once whose extension names a language; ``fault`` is null for valid files.

    Rows with a null id, path or text and other extensions are not judged; an empty text is a valid file but for Go; an empty table gives
    an empty result.
    """
    schema = f"file {files.schema[file_id].dataType.simpleString()}, repo {files.schema[repo_id].dataType.simpleString()}, ext string, fault string"
    ext = extension(path)
    rows = files.where(F.col(file_id).isNotNull() & F.col(text).isNotNull() & ext.isin(*DIALECTS)).select(file_id, repo_id, ext.alias("ext"), text)
    return spread(rows).mapInArrow(_judge, schema).dropDuplicates(["file"])


def rates(files: DataFrame, dropped: DataFrame, file_id: str, repo_id: str, path: str, text: str) -> DataFrame:
    """Per repository and language: files judged, invalid and never read (of ``dropped``, by its path), and the invalid share of the judged.

    A repository or language that only one of the tables has appears with zeros for the other; the share is null without judged files.
    """
    names = F.create_map(*[F.lit(x) for e, dialect in DIALECTS.items() for x in (e, LANGUAGES[dialect])])
    read = judged(files, file_id, repo_id, path, text).select("repo", F.element_at(names, F.col("ext")).alias("language"), F.lit(1).alias("judged"), F.col("fault").isNotNull().cast("int").alias("invalid"), F.lit(0).alias("never_read"))
    unread = (
        dropped.where(language(path).isNotNull())
        .groupBy(F.col(file_id))
        .agg(F.max(repo_id).alias("repo"), F.max(language(path)).alias("language"))
        .select("repo", "language", F.lit(0).alias("judged"), F.lit(0).alias("invalid"), F.lit(1).alias("never_read"))
    )
    total = read.unionByName(unread).groupBy("repo", "language").agg(*[F.sum(c).alias(c) for c in ("judged", "invalid", "never_read")])
    return total.select(F.col("repo").alias(repo_id), "language", "judged", "invalid", "never_read", F.round(F.try_divide("invalid", "judged"), 6).alias("invalid_share"))
