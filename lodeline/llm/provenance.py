"""Generated, minified, vendored and data files among source files.

Method: notices of generators and of third-party code are looked for in the whole leading and trailing comment blocks of a file. One
Aho-Corasick automaton over word stems finds the comments that may hold one; a small grammar then says whether a sentence *is* one: what
it says must be about the file (the file, its code, or no subject at all), not about something in it. Path rules for vendored
folders, lockfiles and minified suffixes, and the repository's own walk excludes, are combined with that. They are
evidence, never a verdict: hand-written files lie in such folders too. The text decides in a second step:

* serial code: lines that differ by a running number only (tables, accessors, descriptors without a notice);
* minified code: long lines of one- and two-letter names; a minified suffix lowers the bars;
* data held in code: nearly everything outside comments is literals;
* a named holder of rights whose name stands in files of several repositories and in the minority of this one's files with a licence line;
* copies without a notice: MinHash over pairs of lines. A file that is much alike an *anchor* (a file with a third-party
  notice or holder, or in a vendored or excluded folder) of another repository is a copy, wherever it lies.

Identical texts share a signature and are compared once. A text is compared with every anchor of its buckets of banded signatures, in
blocks of at most about BLOCK texts by BLOCK anchors, so a bucket of any size is spread over tasks. A block says only which of its texts
have met what they need, so pairs are never rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.skew import salted_lookup
from lodeline.session import cut, spread
from lodeline.sources.tree import compile_rule

#: Stems without which no sentence of the grammar below can be (fixed values, lower case).
STEMS = (
    "generat", "generiert", "erzeugt", "génér", "generad", "auto", "machine", "maschinell", "created", "produced", "produit", "written", "built", "compiled", "emitted",
    "edit", "modif", "change", "touch", "bearbeiten", "ändern", "overwrit", "überschr", "écras", "sobrescri", "sourcemappingurl", "upstream",
    "copied", "imported", "vendored", "taken", "adapted", "ported", "extracted", "forked", "borrowed", "derived", "mirrored",
    "copyright", "(c)", "©", "rights", "licens", "licenc", "license", "spdx",
)

_THIS = r"(?:(?:this|the following|all of this|diese[rs]?|die|der|ce|cet|este|el)\s+)?"
_FILE = r"(?:(?:source\s+)?(?:file|code|source|module|script|content|contents|document|header|datei|quelltext|fichier|fichero|archivo|código)(?:\s+(?:file|code))?)"
_MADE = r"(?:re-?)?(?:generated|created|produced|written|built|compiled|emitted|transpiled|generiert|erzeugt|erstellt|génér[ée]e?|produite?|généré|generad[oa]|cread[oa]|producid[oa])"
_ALONE = r"(?:auto(?:matically|matisch|mat\w+ment|máticamente)?|machine|maschinell)"
_END = r"(?=\s*(?:$|[.:,;!()\-–—*/]))"
#: Sentences that say that the file was made by a program, or must not be edited because it was.
_GENERATED = [
    re.compile(r"@generated\b|<auto-?generated\b|^[#@]*\s*sourcemappingurl\s*="),
    # [this file [was]] automatically generated | [this file was] generated by ...
    re.compile(rf"^{_THIS}(?:{_FILE}\s*[:,]?\s+)?(?:is|was|has been|were|are|wurde|ist|est|a été|fue|es|ha sido)?\s*{_ALONE}[\s-]*{_MADE}\b"),
    re.compile(rf"^{_THIS}{_FILE}\s+(?:is|was|has been|were|are|wurde|ist|est|a été|fue|es|ha sido)?\s*{_MADE}(?:\s+{_ALONE})?\s+(?:by|from|with|using|via|on|mit|von|aus|durch|par|à partir|depuis|avec|por|con|desde)\b"),
    re.compile(rf"^{_MADE}\s+(?:by|with|using|via|mit|von|durch|par|avec|por|con)\b"),
    re.compile(rf"^{_THIS}(?:{_FILE}\s+)?(?:wurde|est|fue|es)?\s*{_MADE}\s+{_ALONE}\b"),
    # do not edit [this file] [by hand]
    re.compile(rf"(?:^|[\s,;:(\-–—*])(?:please\s+)?(?:do\s+not|don't|never|must\s+not\s+be)\s+(?:hand[\s-]*)?(?:edit(?:ed)?|modif(?:y|ied)|changed?|touch(?:ed)?)(?:\s+(?:it|them|(?:this|the)\s+{_FILE}))?(?:\s+(?:by\s+hand|manually|directly|here))*{_END}"),
    re.compile(rf"(?:^|[\s,;:(\-–—*])(?:bitte\s+)?nicht\s+(?:von\s+hand\s+|manuell\s+)?(?:bearbeiten|ändern|editieren){_END}"),
    re.compile(rf"(?:^|[\s,;:(\-–—*])(?:ne\s+pas\s+(?:modifier|éditer)|no\s+(?:editar|modificar))(?:\s+(?:à\s+la\s+main|a\s+mano|ce\s+fichier|este\s+archivo))?{_END}"),
    # changes [to this file] will be lost
    re.compile(rf"^(?:any\s+|all\s+|your\s+|hand\s+|manual\s+|local\s+)*(?:changes|edits|modifications|änderungen|cambios)(?:\s+(?:made\s+)?(?:here|to\s+(?:this|the)\s+{_FILE}|by\s+hand))*\s+(?:will\s+be|are|get|may\s+be|werden|seront|sont|serán|se)\b[^.]*?(?:lost|overwritten|discarded|überschrieben|verloren|perdu|écras|perder|sobrescri)"),
]
_COPIED = re.compile(
    rf"^(?:{_THIS}{_FILE}\s+(?:is|was|has been)\s+)?(?:copied|imported|vendored|taken|adapted|ported|extracted|forked|borrowed|derived|backported|mirrored)\b[^.]{{0,60}}?\bfrom\b\s*(?P<origin>.*)"
)
#: What makes an origin foreign: a place on the net, a release, or the word itself.
_FOREIGN = re.compile(r"\bupstream\b|\w+://|\bgit@|\w@v?\d|\b(?:release|version|revision|rev|tag|commit|v)[\s.]*\d|\b\d+\.\d+\b")
_UPSTREAM = re.compile(r"^(?:upstream|vendored from|imported from)\b\s*[:=]?\s*(?:\w+://|git@)")
_HOLDER = re.compile(
    r"(?:(?:copyright|\(c\)|©)[\s,:]*)+(?:\d{4}(?:\s*[-–,]\s*(?:\d{2,4}|present))*[\s,]*)?(?:by\s+)?(?P<a>[^.,;|<(\n]+)|\brights\s+(?:are\s+)?(?:held|reserved|owned)\s+by\s+(?P<b>[^.,;|<(\n]+)"
)
_TEAM = re.compile(r"^(?:the\s+)?(?:project|team|our|this|us|we|owners?|authors?)\b|\bproject team\b")
_LICENSED = re.compile(r"licen[sc]e|spdx|copyright|\(c\)|©|\brights\b")
#: Where one sentence of a notice ends: marks of versions and file names do not.
_BREAK = re.compile(r"(?<=[.!?;])\s+|\s+[-–—]+\s+|\s*[;|]\s*")
_MARKS = re.compile(r"^[\s/*#<>!=\-–—\"'`;:|.]+(?<![@<])")

#: Folders that hold third-party code by custom (fixed values).
VENDOR_DIRS = (
    "vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "external", "externals", "extern",
    "node_modules", "bower_components", "jspm_packages", "site-packages", "deps", "contrib", "Godeps", "_vendor",
)
_VENDOR = re.compile(r"(?:^|/)(?:" + "|".join(map(re.escape, VENDOR_DIRS)) + r")/")
#: Suffixes of minified and bundled files (fixed values).
_MINIFIED = re.compile(r"[.-]min\.[a-z]+$|[.-]bundle\.[a-z]+$|[.-][0-9a-f]{8,}\.[a-z]+$", re.IGNORECASE)
#: Lockfiles (fixed values).
LOCKFILES = frozenset(("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "go.sum", "cargo.lock", "composer.lock", "gemfile.lock", "npm-shrinkwrap.json", "bun.lock", "uv.lock"))

BANDS, ROWS = 14, 2
HASHES = BANDS * ROWS + 4
#: Least estimated similarity of a copy. The bands and the estimate together find nine in ten of the copies that are 0.6 alike and nearly all from 0.7 on
#: (see the tests). A lower bar takes short hand-written files in that share a common idiom: at 0.375 they were 5 % of the rows.
ALIKE = 0.5
#: For two texts of which a walk exclude is all the evidence: teams exclude folders of their own too.
MUCH_ALIKE = 0.8
#: A text of fewer pairs of lines is too short to tell a copy from a coincidence.
LEAST_PAIRS = 6
#: Texts, and anchors, of a bucket that are compared at once; blocks are drawn by a hash, so they hold about as many.
BLOCK = 2048

_COMMENT_LINE = re.compile(r"\s*(?:\d+\s+)?(?://|#(?!!)|/\*|\*|<!--|\"\"\"|''')")
_LITERAL = re.compile(r"“[^”\n]*(?:”|$)|\"[^\"\n]*\Z|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?)")
_COMMENT = re.compile(r"/\*.*?\*/|(?m:^[ \t]*(?://|#)[^\n]*$)", re.DOTALL)
_NAME = re.compile(r"[^\W\d]\w*")
_INDEX = re.compile(r"[A-Za-z_](\d+)\b|\[(\d+)\b")


#: Lines before the first code that are no comments: blank lines, package clauses, imports, directives and marks of a template.
_PREAMBLE = re.compile(r"\s*(?:$|#!|\{[{%]|package\s+\w+\s*;?\s*$|import\b|from\s+\S+\s+import\b|export\s+\*|['\"]use \w+['\"]|(?:const|let|var)\s[^=]*=\s*require\(|\}\s*from\b|#\s*-\*-)")
#: What editors and merges leave behind a text.
_DEBRIS = re.compile(r"\s*(?::[a-z]+!?\s*$|[<>=|]{7})")
_OPENS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def comment_blocks(lines: list[str]) -> list[str]:
    """The comment lines before the first code of a file (imports are none) and behind its last."""
    found: list[str] = []
    close, depth, at = "", 0, 0
    for at, line in enumerate(lines):  # noqa: B007
        bare = line.strip()
        if close:
            found.append(line)
            if close in bare:
                close = ""
        elif depth:
            depth += bare.count("(") + bare.count("{") - bare.count(")") - bare.count("}")
        elif _COMMENT_LINE.match(line):
            found.append(line)
            for o, c in _OPENS:
                k = bare.find(o)
                if 0 <= k < 12:
                    close = "" if c in bare[k + len(o) :] else c
                    break
        elif _PREAMBLE.match(line):
            if not bare.startswith("#"):
                depth = bare.count("(") + bare.count("{") - bare.count(")") - bare.count("}")
        else:
            break
    for k in range(len(lines) - 1, at, -1):
        if _COMMENT_LINE.match(lines[k]):
            found.append(lines[k])
        elif lines[k].strip() and not _DEBRIS.match(lines[k]):
            break
    return found


class Notices:
    """The automaton over a file's leading and trailing comments, and the grammar of what it finds."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for stem in STEMS:
            self.automaton.add_word(stem, stem)
        self.automaton.make_automaton()

    def read(self, lines: list[str]) -> tuple[str, str | None, bool]:
        """``g`` and ``v`` for what the comments say, the named holder of rights if there is one, and whether there is any licence line."""
        kinds, holder, licensed = set(), None, False
        for line in comment_blocks(lines):
            low = line.strip().lower()
            if next(self.automaton.iter(low), None) is None:
                continue
            body = _MARKS.sub("", low.rstrip(" */->"))
            for sentence in [body, *_BREAK.split(body)[1:]]:
                sentence = _MARKS.sub("", sentence)
                if any(g.search(sentence) for g in _GENERATED):
                    kinds.add("g")
                m = _COPIED.match(sentence)
                if m and _FOREIGN.search(m["origin"]) or _UPSTREAM.match(sentence):
                    kinds.add("v")
            if _LICENSED.search(low):
                licensed = True
                m = _HOLDER.search(low)
                name = (m["a"] or m["b"] or "").strip(" */#-–—") if m else ""
                if name and not _TEAM.search(name):
                    holder = re.sub(r"\s+and contributors.*$", "", name)
        return "".join(sorted(kinds)), holder, licensed


def serial(lines: list[str]) -> bool:
    """Whether a good part of the lines carries a running number: 0, 1, 2, ... over at least eight steps."""
    full, numbers = 0, []
    for x in lines:
        if len(x) > 3:
            full += 1
            m = _INDEX.search(x)
            if m:
                numbers.append(int((m[1] or m[2])[:9]))
    if len(numbers) < 8:
        return False
    steps = sum(b == a + 1 for a, b in zip(numbers, numbers[1:], strict=False))
    flat = sum(b == a for a, b in zip(numbers, numbers[1:], strict=False))
    return steps >= 7 and steps + flat >= 0.8 * (len(numbers) - 1) and len(numbers) >= 0.3 * full


def minified(text: str, lines: list[str], named: bool = False) -> bool:
    """Long lines with hardly a blank, of names that are mostly one or two letters; ``named``: the path says so, and less will do."""
    size = len(text)
    least, width, count, share = (60, 40, 10, 0.3) if named else (200, 80, 40, 0.45)
    if size < least or size < width * len(lines):
        return False
    names = _NAME.findall(_LITERAL.sub("0", text))
    short = sum(len(n) <= 2 for n in names)
    return len(names) >= count and short >= share * len(names)


def data_share(text: str) -> tuple[float, int]:
    """The share of characters outside comments that are no names, and the number of characters in literals."""
    code = _COMMENT.sub("", text)
    bare = _LITERAL.sub("", code)
    names = sum(map(len, _NAME.findall(bare)))
    return 1 - names / max(1, len(code)), len(code) - len(bare)


#: Data held in code: at least so many characters of literals, and no more than 1 - DATA of the text are names.
DATA, LITERALS = 0.95, 300


_NUMBERED = re.compile(r" *1 [^\n]*\n *2(?: |\n)")
_NUMBER = re.compile(r"^ *\d+ ?", re.MULTILINE)
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-f]+|quot|apos|lt|gt|amp);")


def undamaged(text: str) -> str:
    """The text without the line numbers or entities that copying from a page leaves in it."""
    text = text.lstrip("\ufeff")
    if _ENTITY.search(text):
        text = html.unescape(text)
    return _NUMBER.sub("", text) if _NUMBERED.match(text) else text


def _signature(lines: list[str], a: np.ndarray) -> np.ndarray | None:
    kept = [x for x in (y.strip() for y in lines) if len(x) > 12 and not x.startswith(("import ", "from ", "package "))]
    pairs = {p + "\n" + q for p, q in zip(kept, kept[1:], strict=False)}
    if len(pairs) < LEAST_PAIRS:
        return None
    h = np.fromiter((xxhash.xxh64_intdigest(p) for p in pairs), np.uint64, len(pairs))
    return ((h[:, None] * a) >> np.uint64(32)).min(0).astype(np.uint32)


def judge(path: str, text: str, notices: Notices) -> tuple[str, bool, str | None, bool]:
    """Why the text itself says that nobody wrote it (``generated``, ``vendored``, ``minified``, ``data`` or ''), and the evidence beside it:
    whether it is an anchor, the named holder of its rights, whether it has a licence line."""
    lines = text.split("\n")
    kinds, holder, licensed = notices.read(lines)
    anchor = "v" in kinds or bool(_VENDOR.search(path))
    why = ""
    if "g" in kinds:
        why = "generated"
    elif "v" in kinds:
        why = "vendored"
    elif path.rsplit("/", 1)[-1].lower() in LOCKFILES:
        why = "data"
    elif serial(lines):
        why = "generated"
    elif minified(text, lines, bool(_MINIFIED.search(path))):
        why = "minified"
    else:
        share, literals = data_share(text)
        if literals >= LITERALS and share >= DATA:
            why = "data"
    return why, anchor, holder, licensed


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    notices = Notices()
    a = np.random.default_rng(7).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
    for b in batches:
        rows = []
        for path, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text = undamaged(raw)
            why, anchor, holder, licensed = judge(path or "", text, notices)
            s = _signature(text.split("\n"), a) if why in ("", "vendored") else None
            rows.append((path, why, anchor, holder, licensed, None if s is None else s.tobytes()))
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.binary()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["file", "repo", "path", "why", "anchor", "holder", "licensed", "sig"])


def evidence(files: DataFrame, file_id: str, repo_id: str, path: str, text: str) -> DataFrame:
    """One row per file with a text: ``file, repo, path, why, anchor, holder, licensed, sig``. Repeated deliveries of a file id count once."""
    schema = f"file {files.schema[file_id].dataType.simpleString()}, repo {files.schema[repo_id].dataType.simpleString()}, path string, why string, anchor boolean, holder string, licensed boolean, sig binary"
    rows = files.where(F.col(text).isNotNull() & F.col(file_id).isNotNull()).select(file_id, repo_id, path, text)
    return spread(rows).mapInArrow(_evidence, schema).dropDuplicates(["file"])


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One regular expression for the excludes of a repository; null without any."""
    for b in batches:
        rules = []
        for lines in b.column(1).to_pylist():
            made = [r["pattern"] for x in lines or [] if x and (r := compile_rule(x)) and not r["negated"]]
            rules.append("|".join(f"(?:{r})" for r in made) or None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, pa.string())], ["repo", "rule"])


def excluded(files: DataFrame, options: DataFrame, repo_id: str, excludes: str) -> DataFrame:
    """``files`` (``file, repo, path, anchor, ...``) with ``weak`` set where a walk exclude of the repository names the path.

    ``options`` has one row per repository; repository 0 and null lists mean the default row's list.
    """
    per_repo = options.groupBy(F.col(repo_id).alias("repo")).agg(F.first(excludes, ignorenulls=True).alias("list"))
    default = per_repo.where("repo = 0").select("list").first()
    usual = F.array(*[F.lit(x) for x in (default[0] if default and default[0] else [])]).cast("array<string>")
    sizes = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    named = sizes.join(per_repo, "repo", "left").select("repo", F.coalesce("list", usual).alias("list"), "files")
    kind = files.schema["repo"].dataType.simpleString()
    rules = named.select("repo", "list").mapInArrow(_rules, f"repo {kind}, rule string").join(named.select("repo", "files"), "repo")
    met = salted_lookup(files, rules, ["repo"], "files", ["file"], "left")
    return met.withColumn("weak", F.coalesce(F.expr("path rlike rule"), F.lit(False))).drop("rule", "files")


def foreign_holders(files: DataFrame) -> DataFrame:
    """``repo, holder``: holders of rights named in several repositories, and in at most half of this one's files with a licence line."""
    named = files.where("holder is not null").groupBy("repo", "holder").agg(F.count(F.lit(1)).alias("n"))
    wide = named.groupBy("holder").agg(F.count(F.lit(1)).alias("repos")).where("repos > 1")
    lines = files.where("licensed").groupBy("repo").agg(F.count(F.lit(1)).alias("lines"))
    return named.join(wide, "holder").join(lines, "repo").where(F.col("n") * 2 <= F.col("lines")).select("repo", "holder", "n")


def _side(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Where the lists of a column begin, the signatures in them as rows of numbers, and their other fields."""
    flat = column.flatten()
    starts = np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths()))))
    return starts, np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint32).reshape(-1, HASHES), flat


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sig, sure`` of the texts of a block that are alike to one of its anchors; ``sure`` where the evidence of the two is enough."""
    for b in batches:
        (at, own, x), (hub_at, hubs, y) = _side(b.column(0)), _side(b.column(1))
        # repositories by number, whatever they are named by
        ids = pa.concat_arrays([x.field("low"), x.field("high"), y.field("low"), y.field("high")]).dictionary_encode().indices.to_numpy()
        low, high, hub_low, hub_high = np.split(ids, np.cumsum([len(x), len(x), len(y)]))
        flag = {c: (np.asarray(x.field(c)), np.asarray(y.field(c))) for c in ("anchor", "weak", "noticed")}
        found, sure = [], []
        for r in range(b.num_rows):
            i, j = slice(at[r], at[r + 1]), slice(hub_at[r], hub_at[r + 1])
            p, q = own[i], hubs[j]
            if len(p) * len(q) < 4096:
                same = (p[:, None] == q[None]).sum(2)
            else:
                same = np.zeros((len(p), len(q)), np.uint8)
                for k in range(HASHES):
                    same += p[:, k, None] == q[None, :, k]
            other = (low[i, None] != hub_low[None, j]) | (high[i, None] != hub_high[None, j]) | (low[i] != high[i])[:, None]
            # a text that stands on both sides is none of its own copies
            alike = (same >= ALIKE * HASHES) & (same < HASHES) & other
            both = {c: (u[i, None], v[None, j]) for c, (u, v) in flag.items()}
            enough = both["noticed"][0] | both["noticed"][1] | (both["anchor"][0] & both["anchor"][1]) | (both["weak"][0] & both["weak"][1] & (same >= MUCH_ALIKE * HASHES))
            hit = np.flatnonzero(alike.any(1))
            found += [x.field("sig")[at[r] + int(n)].as_py() for n in hit]
            sure += (alike & enough).any(1)[hit].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sure, pa.bool_())], ["sig", "sure"])


def matched(bands: DataFrame) -> DataFrame:
    """``sig, sure`` (repeated) of the texts that are alike to any hub with which they share a band.

    ``bands`` has ``band, sig, low, high, anchor, weak, noticed, text, hub``: whether the row is to be compared, and whether others are with it.
    """
    sizes = bands.groupBy("band").agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(f"{c}s") for c in ("text", "hub")]).where("texts > 0 and hubs > 0")
    rows = bands.join(sizes, "band")
    block = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    held = F.collect_list(F.struct("sig", "low", "high", "anchor", "weak", "noticed"))
    texts = rows.where("text").groupBy("band", block("texts").alias("block")).agg(held.alias("own"))
    hubs = rows.where("hub").groupBy("band", "texts", block("hubs").alias("part")).agg(held.alias("others"))
    hubs = hubs.select("band", "others", F.explode(F.sequence(F.lit(0), F.col("texts") - 1)).alias("block"))
    return texts.join(hubs, ["band", "block"]).select("own", "others").mapInArrow(_matched, "sig binary, sure boolean")


def not_handwritten(files: DataFrame, file_id: str, repo_id: str, path: str, text: str, options: DataFrame | None = None, excludes: str = "excludes") -> DataFrame:
    """``file, why``: the files that nobody in the project wrote by hand.

    Rows with a null text or id are not judged, empty texts are hand-written, null paths give no path evidence. Files of a null repository
    count as one repository of their own. An empty table gives an empty result. ``options`` are the repositories' walk excludes.
    """
    all_files = cut(evidence(files, file_id, repo_id, path, text).withColumn("repo", F.coalesce("repo", F.lit(-1))))
    holders = foreign_holders(all_files)
    all_files = salted_lookup(all_files, holders, ["repo", "holder"], "n", ["file"], "left").withColumn("why", F.when((F.col("why") == "") & F.col("n").isNotNull(), "vendored").otherwise(F.col("why")))
    all_files = all_files.withColumn("anchor", F.col("anchor") | F.col("n").isNotNull()).drop("n", "holder", "licensed")
    all_files = cut(excluded(all_files, options, repo_id, excludes) if options is not None else all_files.withColumn("weak", F.lit(False)))
    own = all_files.where("why <> ''").select("file", "why")
    compared = all_files.where("sig is not null and why in ('', 'vendored')")
    texts = cut(
        compared.groupBy("sig").agg(
            F.min("repo").alias("low"),
            F.max("repo").alias("high"),
            F.max("anchor").alias("anchor"),
            F.max(F.col("anchor") | F.col("weak")).alias("weak"),
            F.max(F.col("why") == "vendored").alias("noticed"),
            F.count(F.lit(1)).alias("files"),
        )
    )
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS))
    bands = texts.drop("files").withColumn("band", F.explode(F.array(*[band(i) for i in range(BANDS)])))
    bands = cut(bands.join(bands.where("weak").select("band").distinct(), "band", "left_semi"))
    alike = cut(matched(bands.withColumn("text", F.lit(True)).withColumn("hub", F.col("weak"))).groupBy("sig").agg(F.max("sure").alias("sure")))
    known = cut(alike.where("sure").select("sig").unionByName(texts.where("noticed or weak and low <> high").select("sig")).distinct())
    # what is alike to a copy without a notice of its own is a copy too
    state = alike.where("not sure").select("sig", F.lit(False).alias("known")).join(known, "sig", "left_anti").unionByName(known.withColumn("known", F.lit(True)))
    second = bands.join(state, "sig").withColumn("text", ~F.col("known")).withColumn("hub", F.col("known") & F.col("weak")).drop("known")
    linked = matched(second).select("sig")
    copies = linked.unionByName(known).distinct().join(texts.select("sig", "files"), "sig")
    found = salted_lookup(compared.where("why = ''").select("file", "sig"), copies, ["sig"], "files", ["file"])
    return own.unionByName(found.select("file", F.lit("vendored").alias("why")))
