"""Evaluation texts leaking into training text.

Method: Wu-Manber multi-pattern search over words. The patterns are all ``SEED``-word windows of the items' own texts. A
shift table on two-word blocks says how far the search may move on: a block in no pattern rules out every pattern
that would cover it, so the search looks at every ``SEED - 1``-th block only and skips what lies between; where a block is in a pattern, the
positions it leaves possible are looked up in the buckets of the suffix hash, and direct comparison confirms each occurrence. The steps are
taken for a batch of documents at once, in arrays.

Confirmed seeds on one diagonal join to runs: a run of ``RUN`` words is a leak. Around the other seeds that follow one another in item and text the exact test for a damaged passage
decides (``passage``): own words of which at least four in five, and at least ``LEAST``, are kept in order. Its start and end are free, and a
passage that is found stays found whatever else the text holds. Two bounds by the longest common ordered
sequence, of the item and of its stretches, come before it and rule out most places.

The own texts are worked out in a distributed table and reach the driver in blocks of at most ``BLOCK_WORDS`` words; a block's search tables
take about ``50`` bytes a word, are built one block at a time and broadcast. The documents are scanned once, whole and without a
shuffle, whatever the number of blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.skew import salted_lookup
from lodeline.session import cut, spread

SEED = 3
#: Words in a row that make a leak.
RUN = 13
#: Or a passage of so many own words or more, of which four in five are kept in order. Of a passage of twice as many or more that does so, one half does.
PASSAGE, LONGEST = 30, 59
LEAST = PASSAGE * 4 // 5
#: A passage takes up at most twice its length in the text.
REACH = 2 * LONGEST
#: Own words that seeds in order must cover for a passage. ``k`` kept words broken in ``b`` places have at least ``k - 2 * b`` words in runs of SEED or
#: more; lost words make at most a quarter as many breaks as words are kept, which leaves 12, and 2 are left for a place with added words.
CHAIN = 10
#: Words of the test items that come to the driver, and go into one broadcast, at once.
BLOCK_WORDS = 2_000_000

_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.IGNORECASE)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.DOTALL)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbf])|([\"'\\/`*_~>#\[\](){}.!|+-]))")
_BROKEN = re.compile(r"[-\u2010\u2011](?<=[^\W\d_].)[ \t]*\r?\n[\s>|#*/]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    if code:
        return chr(int(code, 16))
    return {"n": "\n", "r": "\n"}.get(m[3], " ") if m[3] else m[4]


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits in lower case.

    Markup, entities, escapes, invisible characters, quoting signs, punctuation and line breaks do not count; a word
    hyphenated at a line's end is one word. Null has none.
    """
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(" ", _INLINE.sub("", text))
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return (_PLAIN_WORD if plain else _WORD).findall(_BROKEN.sub("", text).lower())



_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each prompt's first and last sentence."""
    for b in batches:
        first, last = [], []
        for p in b.column(1).to_pylist():
            split = _SENTENCE.split(p.strip())
            first.append(" ".join(words(split[0])))
            last.append(" ".join(words(split[-1])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(first, pa.string()), pa.array(last, pa.string())], ["item", "prompt", "opens", "closes"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for p, opens, closes in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            body = _SENTENCE.split(p.strip())[1 if opens else 0 :]
            out.append(words(" ".join(body[:-1] if body and closes else body)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["item", "own"])


def own_texts(items: DataFrame, item_id: str, prompt: str) -> DataFrame:
    """``item, own``: each item's own words: its text without an opening or closing sentence that other items have too.

    An item of which nothing is left, or whose id or prompt is null or blank, has no own text. An id with several prompts has the smallest.
    """
    kind = items.schema[item_id].dataType.simpleString()
    one = items.where(F.col(item_id).isNotNull() & (F.trim(prompt) != "")).groupBy(F.col(item_id).alias("item")).agg(F.min(prompt).alias("prompt"))
    keyed = cut(one.mapInArrow(_keys, f"item {kind}, prompt string, opens string, closes string"))
    flagged = keyed
    for end in ("opens", "closes"):
        shared = keyed.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        flagged = salted_lookup(flagged, shared, [end], "n", ["item"], "left").withColumn(f"{end}_shared", F.col("n").isNotNull()).drop("n")
    found = flagged.select("item", "prompt", "opens_shared", "closes_shared").mapInArrow(_own, f"item {kind}, own array<string>")
    return found.where(F.size("own") > 0)


#: Items whose stretches a worker remembers, some tens of kilobytes each.
REMEMBERED = 500


class WuManber:
    """Search tables for all SEED-word windows of the own texts of a block of items: arrays, and the numbers of the words."""

    def __init__(self, own: list[list[str]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        # 0 is any word of no item and parts the items from one another
        self.text = np.array([x for w in own for x in (*(number(word, len(self.vocabulary) + 1) for word in w), 0)], np.uint32)
        self.begin = np.cumsum([0, *(len(w) + 1 for w in own)], dtype=np.int64)
        self.stretches: dict[int, list[Stretches]] = {}
        self.item_of = np.repeat(np.arange(len(own), dtype=np.uint32), [len(w) + 1 for w in own])
        inside = self._within(self.text)
        self.at = np.flatnonzero(inside).astype(np.uint32)
        keys = self._suffix(self.text, self.at)
        order = np.argsort(keys, kind="stable")
        self.at, self.keys = self.at[order], keys[order]
        # how far a two-word block is from the end of the nearest pattern that holds it; SEED - 1: in none
        self.bits = max(10, int(len(self.at) * 4).bit_length())
        self.shift = np.full(1 << self.bits, SEED - 1, np.uint8)
        for far in range(SEED - 2, -1, -1):
            self.shift[self._block(self.text, np.flatnonzero(inside) + SEED - 1 - far)] = far

    @staticmethod
    def _within(text: np.ndarray) -> np.ndarray:
        """Where a window of SEED words of items begins."""
        ok = np.zeros(len(text), bool)
        n = len(text) - SEED + 1
        if n > 0:
            ok[:n] = np.logical_and.reduce([text[k : k + n] > 0 for k in range(SEED)])
        return ok

    def _block(self, text: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cell of the block of the two words up to ``end``."""
        h = text[end - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + text[end].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h >> np.uint64(64 - self.bits)

    @staticmethod
    def _suffix(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The hash that names a window's bucket."""
        h = np.zeros(len(begin), np.uint64)
        for k in range(SEED):
            h = (h + text[begin + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def numbers(self, text: list[str]) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in text]

    def seeds(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the items' texts, in the text) where a window of an item stands in the text."""
        look = np.arange(1, len(text), SEED - 1)
        look = look[self.shift[self._block(text, look)] < SEED - 1]
        # a block at its end or at its second word: the ends that it leaves possible
        begin = np.unique(np.concatenate([look + far - (SEED - 1) for far in range(SEED - 1)]))
        begin = begin[(begin >= 0) & (begin <= len(text) - SEED)]
        begin = begin[self._within(text)[begin]] if len(begin) else begin
        keys = self._suffix(text, begin)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        where = np.repeat(begin, n)
        first = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n)
        at = self.at[first + np.arange(len(where))].astype(np.int64)
        same = np.logical_and.reduce([self.text[at + k] == text[where + k] for k in range(SEED)]) if len(at) else np.zeros(0, bool)
        return at[same], where[same]

    def leaks(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """Pairs (text, item) where the text holds RUN words of the item in a row or a passage kept in large part."""
        numbered = [self.numbers(t) for t in texts]
        begin = np.cumsum([0, *(len(t) + 1 for t in numbered)])
        text = np.array([x for t in numbered for x in (*t, 0)], np.uint32)
        if len(text) < SEED:
            return []
        at, where = self.seeds(text)
        doc, item = np.searchsorted(begin, where, "right") - 1, self.item_of[at].astype(np.int64)
        order = np.lexsort((at, where - at, item, doc))
        at, where, doc, item = at[order], where[order], doc[order], item[order]
        steps = (np.diff(at) == 1) & (np.diff(where) == 1)
        # seeds in a row: where a chain is long enough, its first RUN words are a run
        need = RUN - SEED
        chain = np.concatenate([[0], np.cumsum(steps)])
        full = np.flatnonzero(chain[need:] - chain[:-need] == need) if len(at) > need else np.zeros(0, int)
        found = set(zip(doc[full].tolist(), item[full].tolist(), strict=True))
        # of the other pairs, those whose seeds cover enough of the item
        order = np.lexsort((where, at, item, doc))
        doc, item, at, where = doc[order], item[order], at[order], where[order]
        if not len(doc):
            return []
        heads = np.concatenate([[0], np.flatnonzero(np.diff(doc) | np.diff(item)) + 1])
        fresh = np.minimum(np.diff(at, prepend=0), SEED)
        fresh[heads] = SEED
        wide = (np.add.reduceat(fresh, heads) >= CHAIN) & (np.diff(self.begin)[item[heads]] > PASSAGE)
        tails = np.append(heads[1:], len(doc))
        for lo, hi in zip(heads[wide].tolist(), tails[wide].tolist(), strict=True):
            pair = int(doc[lo]), int(item[lo])
            if pair not in found and self._passage(pair[1], numbered[pair[0]], at[lo:hi], where[lo:hi] - begin[pair[0]]):
                found.add(pair)
        return sorted(found)

    def _passage(self, item: int, text: list[int], at: np.ndarray, where: np.ndarray) -> bool:
        """The exact test in windows of the text around the seeds that follow one another in item and text."""
        places = sorted(chained(sorted(zip(where.tolist(), at.tolist(), strict=True))))
        if not places:
            return False
        own = self.text[self.begin[item] : self.begin[item + 1] - 1].tolist()
        if item not in self.stretches:
            if len(self.stretches) >= REMEMBERED:
                self.stretches.clear()
            self.stretches[item] = [Stretches(own, kept) for kept in KEPT]
        return any(x.passage(text[left:right]) for x in self.stretches[item] for left, right in x.regions(places, len(text)))


def chained(seeds: list[tuple[int, int]]) -> set[int]:
    """The places in the text of the seeds (place in the text, in the item) that belong to an ordered chain covering CHAIN words.

    Two neighbours of a chain are as near as two seeds of one passage can be.
    """
    n = len(seeds)
    ahead, behind = [SEED] * n, [SEED] * n
    first = 0
    gains: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for j, (w, a) in enumerate(seeds):
        while w - seeds[first][0] >= REACH:
            first += 1
        for k in range(first, j):
            v, b = seeds[k]
            if v < w and b < a < b + LONGEST:
                gain = min(SEED, a - b, w - v)
                gains[k].append((j, gain))
                if ahead[k] + gain > ahead[j]:
                    ahead[j] = ahead[k] + gain
    if max(ahead, default=0) < CHAIN:
        return set()
    for k in range(n - 1, -1, -1):
        for j, gain in gains[k]:
            if behind[j] + gain > behind[k]:
                behind[k] = behind[j] + gain
    return {w for (w, _), x, y in zip(seeds, ahead, behind, strict=True) if x + y - SEED >= CHAIN}


def common(own: list[int], text: list[int]) -> int:
    """The length of the longest common ordered sequence, one bit a word."""
    masks: dict[int, int] = {}
    for i, w in enumerate(own):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(own)) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(own) - v.bit_count()


#: Passages are looked for apart by the number of words they keep: those that keep few span less of the item and of the text.
KEPT = ((LEAST, 29), (30, 36), (37, LONGEST))
#: Stretches of the item begin so many words apart.
STEP = 4


class Stretches:
    """The stretches of an item in which passages that keep ``least`` to ``most`` words lie, for ``common`` of all stretches at once.

    Each stretch has its own bits and a bit above them for the carry.
    """

    def __init__(self, own: list[int], kept: tuple[int, int]):
        self.own, (self.least, most) = own, kept
        self.room = min(LONGEST, len(own))
        self.span = min(LONGEST, most * 5 // 4)
        self.reach = 2 * min(self.room, self.span)
        self.masks: dict[int, int] = {}
        self.fields = []
        at = self.full = 0
        width = self.span + STEP - 1
        for a in range(0, max(1, len(own) - width + STEP), STEP):
            part = own[a : a + width]
            for i, w in enumerate(part, at):
                self.masks[w] = self.masks.get(w, 0) | 1 << i
            field = (1 << len(part)) - 1
            self.full |= field << at
            self.fields.append((at, field, len(part) - self.least, part))
            at += len(part) + 1

    def dense(self, text: list[int]) -> list[list[int]]:
        """The stretches whose common ordered sequence with the text is long enough."""
        v, full, get = self.full, self.full, self.masks.get
        for w in text:
            m = get(w)
            if m is not None:
                u = v & m
                v = (v + u | v - u) & full
        return [part for at, field, most, part in self.fields if (v >> at & field).bit_count() <= most]

    def regions(self, places: list[int], end: int) -> Iterator[tuple[int, int]]:
        """What of a text of ``end`` words passages with a seed at one of the places can take up."""
        if len(self.own) >= PASSAGE and places:
            left = right = places[0]
            for p in places:
                if p - self.reach > right:
                    yield max(0, left - self.reach), min(end, right)
                    left = p
                right = p + self.reach
            yield max(0, left - self.reach), min(end, right)

    def passage(self, text: list[int]) -> bool:
        """Whether the text holds a passage, window by window."""
        aside = self.reach // 2
        for left in range(0, max(1, len(text) - self.reach), aside):
            window = text[left : left + self.reach + aside]
            if any(kept_passage(part, window, self.span, self.room) for part in self.dense(window)):
                return True
        return False


def passage(own: list[int], text: list[int]) -> bool:
    """Whether PASSAGE to LONGEST own words in a row keep four in five of them in order, within twice their length of text."""
    return len(own) >= PASSAGE and any(Stretches(own, kept).passage(text) for kept in KEPT)


def kept_passage(own: list[int], text: list[int], longest: int, room: int) -> bool:
    """``passage`` for one stretch and kept words that span at most ``longest`` of its words; a passage may be ``room`` words long.

    From each pair of equal words on, the least place in the text where the following own words can have been met is carried on,
    for every number of own words lost so far; all pairs are carried on at once.
    """
    n, m = len(own), len(text)
    t, o = np.array(text, np.int32), np.array(own, np.int32)
    never = m + 1
    same = (o[:, None] == t[None, :]) & (o[:, None] > 0)
    # the first place at or after p with own word i; past the end there is none
    after = np.full((n, m + 3), never, np.int32)
    after[:, :m] = np.minimum.accumulate(np.where(same, np.arange(m, dtype=np.int32)[None, :], never)[:, ::-1], axis=1)[:, ::-1]
    # the common sequence of what follows: a beginning needs LEAST words
    follow = np.zeros((n + 1, m + 3), np.int32)
    for i in range(n - 1, -1, -1):
        there = after[i]
        follow[i] = np.maximum(follow[i + 1], np.where(there < never, 1 + follow[i + 1][np.minimum(there + 1, m + 2)], 0))
    i0, s = np.nonzero(same & (follow[:n, :m] >= LEAST))
    counts = np.arange(longest // 5 + 1, dtype=np.int32)
    at = np.full((len(i0), len(counts)), never, np.int32)
    at[:, 0] = s
    for span in range(2, min(longest, n) + 1):
        i = i0 + span - 1
        ok = (i < n) & (at < never).any(1)
        if not ok.any():
            return False
        if not ok.all():
            i0, s, i, at = i0[ok], s[ok], i[ok], at[ok]
        lost_on = np.empty_like(at)
        lost_on[:, 0], lost_on[:, 1:] = never, at[:, :-1]
        at = np.minimum(after[i[:, None], np.minimum(at + 1, m + 2)], lost_on)
        kept = span - counts
        # beyond twice the longest passage; and a beginning that has lost this much is better left out, or too much for the least passage
        at[(at - s[:, None] >= 2 * room) | (4 * counts > kept + LEAST - 1)[None, :]] = never
        good = (kept >= LEAST) & (5 * kept >= 4 * span)
        if good.any() and ((at < never) & (at - s[:, None] < 2 * np.minimum(room, 5 * kept // 4)[None, :]) & good[None, :]).any():
            return True
    return False


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, prompt: str) -> DataFrame:
    """``doc_id, item_id``, a row for each document and each item that it holds in whole or in part.

    Null and empty texts hold nothing; a repeated document row gives repeated rows only if its id repeats. An empty side gives an
    empty result. A damaged passage is found for certain as long as lost, changed and added words break it in at most ``(k - CHAIN) / 2`` places,
    ``k`` being the words it keeps: 7 places for 24 kept words, 10 for 30. One that is broken up more finely has too few words side by side to be looked at.
    """
    spark = docs.sparkSession
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}"
    blocks = []
    for ids, own in _blocks(own_texts(items, item_id, prompt)):
        blocks.append(spark.sparkContext.broadcast((ids, WuManber(own))))
    if not blocks:
        return spark.createDataFrame([], schema)
    return spread(docs.select(doc_id, text)).mapInArrow(_scan(blocks), schema)


def _blocks(own: DataFrame) -> Iterator[tuple[list, list[list[str]]]]:
    """The own texts in blocks of BLOCK_WORDS words or one text, a partition at a time."""
    ids, block, size = [], [], 0
    for r in cut(own).toLocalIterator():
        if block and size + len(r["own"]) > BLOCK_WORDS:
            yield ids, block
            ids, block, size = [], [], 0
        ids.append(r["item"])
        block.append(r["own"])
        size += len(r["own"])
    if block:
        yield ids, block


#: Words of documents that are searched at once.
BATCH_WORDS = 200_000


def _scan(blocks: list):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [words(t) for t in b.column(1).to_pylist()]
            rows: list[int] = []
            found: list = []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_WORDS):
                    size += len(texts[hi])
                    hi += 1
                for block in blocks:
                    ids, search = block.value
                    for doc, item in search.leaks(texts[lo:hi]):
                        rows.append(lo + doc)
                        found.append(ids[item])
                lo = hi
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(found)], [b.schema.names[0], "item"])

    return run
