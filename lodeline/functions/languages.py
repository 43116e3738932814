"""What is known of file extensions and names (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeline.functions.paths import extension

#: Extensions that are read and scanned, with their language.
SCANNED = {"ts": "ts", "tsx": "tsx", "mts": "ts", "cts": "ts", "js": "js", "jsx": "jsx", "mjs": "js", "cjs": "js", "go": "go", "py": "py", "pyi": "py", "pyw": "py"}
#: Carried along without being parsed.
CARRIED = {"json": "json", "jsonc": "json", "md": "md"}
#: Program source that is only counted.
UNREAD = {
    "rb": "Ruby", "rake": "Ruby", "rs": "Rust", "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "scala": "Scala", "swift": "Swift", "mm": "Objective-C++", "c": "C", "h": "C",
    "cc": "C++", "cpp": "C++", "cxx": "C++", "hh": "C++", "hpp": "C++", "hxx": "C++", "cs": "C#", "php": "PHP", "pm": "Perl", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang",
    "hrl": "Erlang", "hs": "Haskell", "lua": "Lua", "dart": "Dart", "jl": "Julia", "clj": "Clojure", "cljc": "Clojure", "cljs": "Clojure", "fs": "F#", "fsi": "F#", "fsx": "F#",
    "ml": "OCaml", "mli": "OCaml", "nim": "Nim", "zig": "Zig", "cr": "Crystal", "elm": "Elm", "vue": "Vue", "svelte": "Svelte", "astro": "Astro", "sh": "Shell", "bash": "Shell",
    "zsh": "Shell", "ps1": "PowerShell", "groovy": "Groovy", "r": "R", "tcl": "Tcl", "vb": "Visual Basic", "pas": "Pascal", "f90": "Fortran", "f95": "Fortran", "f03": "Fortran",
    "gleam": "Gleam", "rkt": "Racket", "scm": "Scheme", "sol": "Solidity", "hx": "Haxe", "tf": "Terraform", "tfvars": "Terraform", "el": "Emacs Lisp", "nix": "Nix", "vim": "Vim script",
    "proto": "Protocol Buffers",
}
#: Paths beside the point of a repository: tests, fixtures, examples, scripts, data and documents (fixed values).
SIDESHOW = r"(?i)(^|/)(__)?(tests?|testutils?|testdata|fixtures?|benchmarks?|scripts?|examples?)(__)?(/|$)|\.(test|spec)\.|\.(json|md)$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: Column | str) -> Column:
    """The language of scanned and carried files by extension, else null."""
    return _lookup(SCANNED | CARRIED, extension(path))


def treatment(path: Column | str) -> Column:
    """scanned, carried, unread or unsupported."""
    e = extension(path)
    return F.when(e.isin(*SCANNED), "scanned").when(e.isin(*CARRIED), "carried").when(e.isin(*UNREAD), "unread").otherwise("unsupported")


def is_sideshow(path: Column | str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(SIDESHOW)
