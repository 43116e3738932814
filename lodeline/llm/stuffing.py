"""Keyword-stuffed pages, link lists and tag lists.

Method: block-wise compression. Every text is cut into blocks of ``BLOCK`` bytes, each compressed alone (redundancy
within reach of a reader, so that long texts do not look more redundant than short ones), and the mean ratio is divided by the
median ratio of all texts of that language and length. The sentence density is the number of sentence ends a word over the language's
median. A page is stuffed when

* it is redundant (``REDUNDANT``) and its sentence density clearly low (``HARDLY``), or
* it is extremely redundant (``EXTREME``) and so (``REDUNDANT``) are its distinct sentences alone, and the density of *fresh* sentences is
  low (``FEW``): keywords worked into would-be sentences have ordinary punctuation, but such sentences say over and over what has been said.

Some pages pass only one of the two tests: strung-together tags, products and links that are all different (low density,
ordinary redundancy), would-be sentences around ever new names (redundant, ordinary density), and so do inventories and prose that recurs. Pages
that pass one test clearly and not the other, and those of both whose words are paths, symbols or versions (``INVENTORY``), are therefore read in units (lines,
sentences, items between separators) by ``stuffed_share``: the share of letters in units that are keywords, bare links or tags must be
over one half. Pages that pass neither test are never stuffed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.session import cut, spread

BLOCK = 2048
#: A redundant text has at most this part of the median ratio of its language and length, an extremely redundant one at most that.
REDUNDANT, EXTREME = 0.75, 0.5
#: Low sentence density: at most this part of the language's median. Items of lists have longer words than prose, so a page with half its
#: letters in sentences may have somewhat over half the usual density. Clearly low: a page with hardly a sentence.
FEW, HARDLY = 0.65, 0.35
#: A sentence is fresh when at least this share of its words is new to the text.
FRESH = 0.3
#: A page is an inventory when this share of its words is; recurrence and few sentences are natural there.
INVENTORY = 0.3
#: A page that is read in units is stuffed when more than this share of its letters is.
SHARE = 0.5

#: Function words of the four languages (fixed values).
FUNCTION_WORDS = frozenset(
    """
    a an the and or but if when while because since as so than that this these those there then it its he she they them we us our you your
    i my me is are was were be been has have had do does did not no nor never to of in on at by for from with within without into over under after before
    until between about only one each every any some what which who whose how why will would should can could may might must
    der die das den dem des ein eine einen einem einer und oder aber wenn weil als so dass es er sie wir ihr ist sind war wird werden hat haben
    nicht kein keine nur nach vor bei mit ohne von vom zu zum zur im am auf aus in an für über unter bis je sich auch noch hier alles sonst
    le la les un une des du de et ou mais si quand car que qui ce cette ces il elle ils nous vous est sont était ont a ne pas plus sans avec pour par
    dans sur sous entre en au aux se son sa ses leur tout
    el la los las un una unos unas y o pero si cuando porque que quien este esta estos es son era han ha no ni sin con para por en sobre entre
    del al de lo se su sus más todo cada
    """.split()
)

_LINK = re.compile(
    r"\[url=[^\]]*\].*?\[/url\]|!?\[[^\]\n]*\]\([^)\s]*\)|<a\b[^>]*>.*?</a>|(?:https?://|www\.)[^\s,|<>)\]]+|\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}/(?=[^\s]|\s|$)[^\s,|<>)\]]*",
    re.IGNORECASE | re.DOTALL,
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDS = re.compile(r"[.!?…](?=[\s\"'”»)\]]|$)(?<![.\s].)")
_FENCE = re.compile(r"^(```|~~~).*?^\1[ \t]*$", re.MULTILINE | re.DOTALL)
_CODE = re.compile(r"[{}]|=>|:=|==|\)\s*[:{;]|;\s*$")
#: Words of an inventory: paths, names with inner capitals or underscores, versions, hashes, numbers with a unit.
_INVENTORY = re.compile(r"(?<![\w@/])(?:[\w.@-]*/[\w./@-]+|\w+@[\d.]+|[a-z]+[A-Z]\w*|[A-Z]+[a-z]+[A-Z]\w*|\w+_\w+|v?\d+\.\d+\.\d+|[0-9a-f]{7,40}\b|\w+\.(?:[a-z]{1,4})\b)")
_SENTENCE = re.compile(r"(?<=[^.\s][.!?…])\s+(?=\S)")
_TABLE_ROW = re.compile(r"\|.*\|.*\|$")
_ITEMS = re.compile(r"\s*(?:[|•·;,]|\s[/*-]\s|(?<=[?!.])\s)\s*")
_TAG = re.compile(r"(?<!\w)#[^\W\d_][\w-]*")
_BULLET = re.compile(r"^[\s>*+•·-]+|^\s*\d+[.)]\s+")


#: What a compressed block has besides its content: marks and headers.
FRAME = 8


class Blocks:
    """A compressor that keeps its memory from block to block."""

    def __init__(self) -> None:
        self.one = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    def ratio(self, text: bytes) -> float:
        """Mean compressed size of the blocks over their size; 1 for an empty text."""
        if not text:
            return 1.0
        total = sum(len(self.one.compress(text[i : i + BLOCK])) - FRAME for i in range(0, len(text), BLOCK))
        return max(total, 1) / len(text)


def sentence_ends(text: str) -> float:
    """Sentence ends a word; an ellipsis or a lone stop ends none."""
    return len(_ENDS.findall(text)) / max(1, len(text.split()))


def fresh(text: str) -> tuple[str, float]:
    """The text without sentences that came before in it, and the ends a word of the sentences that have new words."""
    seen: set[str] = set()
    said: set[str] = set()
    kept, ends, total, at = [], 0, 0, 0
    for end in [*(m.end() for m in _ENDS.finditer(text)), len(text)]:
        piece = text[at:end]
        words = _WORD.findall(piece.lower())
        total += len(words)
        key = " ".join(w for w in words if not w.isdigit())
        if key not in said:
            said.add(key)
            kept.append(piece)
            new = set(words) - seen
            ends += end < len(text) or bool(_ENDS.search(piece)) if len(words) >= 3 and len(new) >= FRESH * len(words) else 0
            seen |= new
        at = end
    return "".join(kept), ends / max(1, total)


def _phrases(units: set[str]) -> set[tuple[str, ...]]:
    """Phrases of two to four words that different units keep coming back to, function words not at their ends.

    Units that differ only in names and numbers count once, so a sentence that recurs makes no phrase.
    """
    split = list({tuple(w for w in _WORD.findall(u.lower()) if not w.isdigit()) for u in units})
    total = sum(map(len, split))
    found: set[tuple[str, ...]] = set()
    for size in (4, 3, 2):
        counts = Counter(p for words in split for p in zip(*(words[i:] for i in range(size)), strict=False))
        least = max(5, total / (size * 8))
        found |= {p for p, c in counts.items() if c >= least and p[0] not in FUNCTION_WORDS and p[-1] not in FUNCTION_WORDS}
    return found


def _covered(words: list[str], phrases: set[tuple[str, ...]]) -> int:
    """How many of the words lie in one of the phrases."""
    hit = [False] * len(words)
    for size in (4, 3, 2):
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in phrases:
                hit[i : i + size] = [True] * size
    return sum(hit)


def stuffed_share(text: str) -> float:
    """Share of the letters that stand in stuffed units; 0 for texts without letters."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    plain = 0.0
    if "|" in text:
        plain += sum(len("".join(_WORD.findall(x))) for x in text.split("\n") if _TABLE_ROW.match(x.strip()))
    if "/" in text or "[" in text or "www." in text.lower():
        text = _LINK.sub(" \x01 ", text)
    units = Counter(_units(text))
    bare = {u: _INVENTORY.subn(" ", u) for u in units}
    phrases = _phrases({u for u, _ in bare.values()})
    stuffed = 0.0
    for unit, n in units.items():
        s, p = _judge(unit, phrases, bare[unit][1])
        stuffed, plain = stuffed + n * s, plain + n * p
    return stuffed / max(1.0, stuffed + plain)


#: A line of at most so many words that ends no sentence is an item of a list.
ITEM_WORDS = 8


def _units(text: str) -> list[str]:
    """Sentences, and runs of list lines joined: the items of a list say little when alone."""
    units: list[str] = []
    run: list[str] = []
    for line in text.split("\n"):
        bare = _BULLET.sub("", line).strip()
        if not bare or _TABLE_ROW.match(bare):
            continue
        if len(_WORD.findall(bare)) <= ITEM_WORDS and bare[-1] not in ".!?…:;,{}":
            run.append(bare)
            continue
        if run:
            units.append(" | ".join(run))
            run = []
        units += _SENTENCE.split(bare)
    return [*units, " | ".join(run)] if run else units


#: A link counts as that many letters: what it hides is of no weight, that it stands there is.
LINK_LETTERS = 24


def _judge(chunk: str, phrases: set[tuple[str, ...]], inventory: int) -> tuple[float, float]:
    """Stuffed letters and other letters of one line or sentence, which has so many words of an inventory."""
    body = _BULLET.sub("", chunk)
    links = body.count("\x01")
    bare = body.replace("\x01", " ")
    words = _WORD.findall(bare.lower())
    letters = sum(map(len, words))
    if not words and not links:
        return 0.0, 0.0
    function = sum(w in FUNCTION_WORDS for w in words)
    if links:
        # links with nothing said about them; a sentence beside the link speaks for it
        weight = links * LINK_LETTERS + letters
        if function >= 2 and function / len(words) >= 0.15 and len(words) >= 5 * links:
            return 0.0, weight
        return weight, 0.0
    parts = [x for x in _ITEMS.split(bare) if x.strip()]
    if inventory and (len(parts) < 5 or inventory >= 0.3 * len(parts)) or _CODE.search(bare):
        return 0.0, letters
    covered = _covered(words, phrases) if phrases else 0
    if covered:
        rest = len(words) - covered
        if covered / len(words) >= 0.4 or (covered / len(words) >= 0.2 and function * 5 <= rest):
            return letters, 0.0
    tags = len(_TAG.findall(bare)) if "#" in bare else 0
    if tags >= 2 and function / len(words) < 0.2:
        return letters, 0.0
    if function / len(words) < 0.08 and (len(parts) >= 5 and len(words) <= 6 * len(parts) or len(words) >= 14):
        return letters, 0.0
    return 0.0, letters


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = Blocks()
    for b in batches:
        texts = [t or "" for t in b.column(0).to_pylist()]
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        columns = [pa.array([_class(x) for x in raws], pa.int32()), pa.array([blocks.ratio(x) for x in raws], pa.float64()), pa.array([sentence_ends(t) for t in texts], pa.float64())]
        yield pa.RecordBatch.from_arrays([b.column(1), *columns], ["lang", "class", "ratio", "ends"])


def _class(raw: bytes) -> int:
    """The size class of a text, one for each doubling."""
    return max(1, len(raw).bit_length())


def verdict(norm: float, density: float, fresh_norm: float, fresh_density: float) -> bool | None:
    """True: stuffed. False: not. None: only one of the two tests holds clearly, the text has to be read."""
    if norm <= REDUNDANT and density <= HARDLY or norm <= EXTREME and fresh_norm <= REDUNDANT and fresh_density <= FEW:
        return True
    return None if norm <= REDUNDANT or density <= FEW else False


def _measure(usual: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def measures(text: str, lang: str, blocks: Blocks) -> tuple:
        ratios, densities = usual.value
        raw = text.encode("utf-8", "surrogatepass")
        if not raw or raw.isspace():
            return len(raw), 1.0, 1.0, 1.0, 0.0, None
        ratio, common = blocks.ratio(raw), densities[lang] or 1.0
        norm, density = ratio / ratios[lang, _class(raw)], sentence_ends(text) / common
        fresh_norm, fresh_density = norm, density
        if norm <= EXTREME and density > HARDLY:
            rest, ends = fresh(text)
            again = rest.encode("utf-8", "surrogatepass")
            fresh_norm, fresh_density = blocks.ratio(again) / ratios.get((lang, _class(again)), 1.0), ends / common
        found = verdict(norm, density, fresh_norm, fresh_density)
        if found and len(_INVENTORY.findall(text)) >= INVENTORY * len(text.split()):
            found = None
        if found is not None:
            return len(raw), ratio, norm, density, 0.0, "measures" if found else None
        share = stuffed_share(text)
        return len(raw), ratio, norm, density, share, "units" if share > SHARE else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for b in batches:
            rows = [measures(t or "", lang, blocks) for t, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 6, [pa.int64(), *[pa.float64()] * 4, pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], ["id", "lang", "size", "ratio", "norm", "density", "share", "stuffed_by"])

    return run


def language(c: Column | str) -> Column:
    """Two lower-case letters, or ``un``: at most 677 values whatever the column holds."""
    x = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(F.when(x.rlike("^[a-z]{2}($|[^a-z])"), F.substring(x, 1, 2)), F.lit("un"))


def measure(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """Per document: ``id, lang, size, ratio, norm, density, share, stuffed_by``.

    ``norm`` is the block ratio over the median of the documents of the same language and size class (a class for each
    doubling); classes of fewer than 30 documents take the median of the size class. ``density`` is the number of sentence ends
    a word over the language's median (languages of fewer than 30 documents: the median of all). ``stuffed_by`` says what found a stuffed text,
    ``measures`` or ``units``, and is null for the rest; ``share`` is that of the texts that were read in units, 0 elsewhere. Null, empty and blank
    texts measure 1 and are not stuffed. The medians come first; they are one row per language and size class, under 30,000 rows at
    any size of the data, collected and broadcast.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = spread(docs.select(F.col(doc_id), F.col(text), language(lang).alias("lang")))
    m = cut(rows.select(text, "lang").mapInArrow(_ratios, "lang string, class int, ratio double, ends double"))
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    n = F.count(F.lit(1)).alias("n")
    own = m.groupBy("lang", "class").agg(median("ratio").alias("own"), n)
    wide = m.groupBy("class").agg(median("ratio").alias("wide"))
    norms = own.join(wide, "class").select("lang", "class", F.when(F.col("n") >= 30, F.col("own")).otherwise(F.col("wide")).alias("usual"))
    ends = m.groupBy("lang").agg(median("ends").alias("ends"), n).collect()
    all_ends = m.agg(median("ends")).first()[0]
    usual = spark.sparkContext.broadcast(({(r["lang"], r["class"]): r["usual"] for r in norms.collect()}, {r["lang"]: r["ends"] if r["n"] >= 30 else all_ends for r in ends}))
    return rows.mapInArrow(_measure(usual), f"id {kind}, lang string, size long, ratio double, norm double, density double, share double, stuffed_by string")


def stuffed(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """The measured rows of the documents that are stuffed. Documents without words never are; an empty table gives none."""
    return measure(docs, doc_id, text, lang).where("stuffed_by is not null")
