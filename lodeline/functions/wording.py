"""Texts for people: counts with their nouns, labels, the verdict of a board's members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """``1 file``, ``3 files``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or one + "s"))


def short_label(text: Column, most: int = 26) -> Column:
    """A label cut in its middle to ``most`` characters."""
    head = (most - 1) // 2 + (most - 1) % 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(most - 1 - head))))


def noun_of(kinds: Column) -> Column:
    """What a set of members is called: the kind they share, ``place`` for a mixed or empty one. ``kinds`` is an array."""
    k = F.array_distinct(kinds)
    return F.when(F.size(k) == 1, F.element_at(k, 1)).otherwise("place")


def encode_witness(candidates: Column, how: Column) -> Column:
    """Tokens in the order of the sorted candidates; ``how`` maps a candidate to its strategy, right answers are missing from it."""
    return F.array_join(F.transform(F.array_sort(candidates), lambda c: F.coalesce(F.try_element_at(how, c), F.lit("-"))), " ")


def decode_witness(candidates: Column, witness: Column) -> Column:
    """The map back from a witness; null where the tokens do not fit the candidates."""
    t = F.split(witness, " ", -1)
    pairs = F.filter(F.arrays_zip(F.array_sort(candidates).alias("c"), t.alias("t")), lambda x: x["t"] != "-")
    return F.when(F.size(t) == F.size(candidates), F.map_from_entries(pairs))


def pattern_target(name: Column, pattern: Column, target: Column) -> Column:
    """What an export pattern with one ``*`` makes of a name: the part that the star takes is put into the target; null without a match."""
    star = F.instr(pattern, "*") > 0
    head, tail = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    fits = name.startswith(head) & name.endswith(tail) & (F.length(name) >= F.length(head) + F.length(tail))
    middle = F.substring(name, F.length(head) + 1, F.length(name) - F.length(head) - F.length(tail))
    return F.when(star & fits, F.replace(target, F.lit("*"), middle)).when(~star & (name == pattern), target)
