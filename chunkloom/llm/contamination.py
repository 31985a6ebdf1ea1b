"""Evaluation texts leaking into training text.

The n-grams of all test items, in normalised words, form a hash set that every task
gets; document windows are looked up in it. Wherever enough hits of an item stand
close together, a word alignment looks for the longest stretch that keeps the error
limit, and goes on behind it, so every disjoint stretch of a document comes out and
can be removed.

How many hits a stretch must have follows from the definition: with ``n`` words that
fit and at most one error to four of them there are so many unbroken runs at most,
hence so many n-grams at least. The n-gram length is 3, and 2 for items of under nine
words, which can be broken into runs of two.

The set is broadcast for at most ``ITEM_BYTES`` of item text. More items are taken in
parts, each with a pass of its own whose rows are written before the next set is
sent, so neither the driver nor a task ever holds more than one part.

Defined results: null or empty texts leak nothing; an item of one word can't be told
from a mention and isn't reported; items of two and three words must stand there
whole, longer ones with four words at least; repeated documents and items count each;
words of an item's instruction line (a first line that an item with another rest
shares) don't count.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.textnorm import APOSTROPHES, INVISIBLE, Repairer, fold, plain_layout, skeleton
from chunkloom.session import materialize

#: Words of an n-gram, and of items so short that unbroken runs of three words aren't certain; text of the items in one broadcast.
NGRAM, SHORT_NGRAM, SHORT_ITEM, ITEM_BYTES = 3, 2, 8, 8 << 20
#: A leak has at least this share of the item's words, and at most this share of its stretch in errors.
LEAST_SHARE, MOST_ERRORS = 0.5, 0.2
#: Words that must fit at least, in an item of so many.
LEAST_WORDS = 4
#: Alignment: costs of a changed, missing or added word, tried in turn, against a gain of 1 per word that fits.
ERROR_COSTS = (0.3, 1.0, 2.0)
#: Lines up to so many words without a hit, inside a stretch, count as page furniture (menus, notices, captions).
FURNITURE_WORDS = 24

_WORD = re.compile(f"[^\\W_](?:[^\\W_]|[�{INVISIBLE}{APOSTROPHES}](?=[^\\W_�])|�)*|�(?:[^\\W_]|�)+")
_NUMBERING = re.compile(r"^[ \t>*#|+-]*(?:\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|[>*#|+•·-]+)[ \t]+", re.M)


def words_needed(n: int) -> int:
    """Words of an item of ``n`` words that a stretch must reproduce."""
    return max(math.ceil(LEAST_SHARE * n), min(n, LEAST_WORDS))


def hits_needed(n: int, gram: int) -> int:
    """The fewest n-gram hits that a stretch of an item of ``n`` words can have, less some for page furniture in between."""
    least = min(fit - (gram - 1) * (fit // 4 + 1) for fit in range(words_needed(n), n + 1))
    return max(1, min(least, int(0.2 * n) - 2))


class ItemIndex:
    """Normalised words and n-grams of test items ``(id, text, whether the first line is a shared instruction)``, ready to be sent to tasks."""

    def __init__(self, items: list[tuple[int, str | None, bool]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        repair = Repairer()
        for ident, text, shared in items:
            if not text:
                continue
            _, _, rest = text.strip().partition("\n")
            body = plain_layout(repair(rest if rest and shared else text))
            raw = _WORD.findall(_NUMBERING.sub("", body))
            forms = [[fold(w) for w in raw], [skeleton(w) for w in raw]]
            # the second form finds text whose accented letters were lost
            for form in forms if forms[0] != forms[1] else forms[:1]:
                own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in form if w]
                if len(own) > 1:
                    self.ids.append(ident)
                    self.words.append(np.array(own, np.int64))
        self.base = len(self.vocabulary) + 1
        size = np.array([len(w) for w in self.words], np.int64)
        self.gram = np.where(size > SHORT_ITEM, NGRAM, SHORT_NGRAM)
        self.tables = {int(n): self._table(int(n)) for n in np.unique(self.gram)}
        self.least_hits = np.array([hits_needed(len(w), int(g)) for w, g in zip(self.words, self.gram, strict=True)], np.int64)

    def codes(self, ids: np.ndarray, gram: int) -> np.ndarray:
        """The n-grams of a word sequence; overflow may make two n-grams alike, which the alignment then sees."""
        if len(ids) < gram:
            return ids[:0]
        code = ids[: len(ids) - gram + 1].copy()
        for k in range(1, gram):
            code = code * self.base + ids[k : len(ids) - gram + 1 + k]
        return code

    def _table(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted n-grams, where the items of each begin, and the items."""
        own = np.flatnonzero(self.gram == gram)
        code = [np.unique(self.codes(self.words[i], gram)) for i in own]
        flat, item = np.concatenate(code), np.repeat(own, [len(c) for c in code])
        order = np.argsort(flat, kind="stable")
        codes, first = np.unique(flat[order], return_index=True)
        return codes, np.r_[first, len(flat)].astype(np.int64), item[order]


def align(item: np.ndarray, doc: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of word ids as a path: (whether the words fit, position in ``doc`` or -1 for a missing word)."""
    m, n = len(item), len(doc)
    back = np.zeros((m + 1, n + 1), np.int8)  # 0 start, 1 diagonal, 2 up (item word missing), 3 left (word added)
    row, own = np.zeros(n + 1), np.zeros(n + 1)
    best, at = 0.0, (0, 0)
    steps = cost * np.arange(n + 1)
    gain = np.where(doc == item[:, None], 1.0, -cost)
    for i in range(1, m + 1):
        diagonal = row[:-1] + gain[i - 1]
        up = row[1:] - cost
        np.maximum(np.maximum(diagonal, up), 0.0, out=own[1:])
        kind = np.where(diagonal >= up, 1, 2)
        kind[own[1:] == 0.0] = 0
        # added words: a running maximum of score plus position cost
        lifted = np.maximum.accumulate(own + steps) - steps
        kind[lifted[1:] > own[1:] + 1e-9] = 3
        back[i, 1:] = kind
        row = np.maximum(lifted, own)
        j = int(row.argmax())
        if row[j] > best + 1e-9:
            best, at = float(row[j]), (i, j)
    i, j = at
    fits, where = [], []
    while i > 0 and j > 0 and back[i, j]:
        kind = back[i, j]
        fits.append(kind == 1 and doc[j - 1] == item[i - 1])
        where.append(-1 if kind == 2 else j - 1)
        i, j = i - (kind != 3), j - (kind != 2)
    return np.array(fits[::-1], bool), np.array(where[::-1], np.int64)


def longest_part(fits: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, words that fit) of the part with most of them, at most ``MOST_ERRORS`` of the part being others."""
    fit = np.zeros(len(fits) + 1, np.int64)
    np.cumsum(fits, out=fit[1:])
    # the error limit as a sum over the part that must not be negative
    left = fit * MOST_ERRORS - (np.arange(len(fit)) - fit) * (1 - MOST_ERRORS)
    begin = np.searchsorted(-np.minimum.accumulate(left), -left - 1e-9)  # the earliest begin for each end
    end = int((fit - fit[begin]).argmax())
    return int(begin[end]), end, int(fit[end] - fit[begin[end]])


def common_length(places: dict[int, int], size: int, doc: np.ndarray) -> int:
    """Length of the longest common subsequence of ``doc`` and an item, whose words have their positions as bits in ``places``."""
    full = (1 << size) - 1
    row = full
    for w in doc.tolist():
        if (at := places.get(w)) is not None:
            both = row & at
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def stretch(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int] | None:
    """The stretch of ``doc`` with most words of ``item``, within the error limit: (words that fit, errors, first, last position).

    None if it has too few words. Two bounds that no stretch can exceed come first: the
    words of a part that the item has at all, and the longest common subsequence. Then
    alignments under several costs are cut to their longest part within the limit; the
    first that is long enough is taken.
    """
    need, kinds = words_needed(len(item)), np.unique(item)
    at = np.minimum(np.searchsorted(kinds, doc), len(kinds) - 1)
    if longest_part(kinds[at] == doc)[2] < need:
        return None
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    if common_length(places, len(item), doc) < need:
        return None
    for cost in ERROR_COSTS:
        fits, where = align(item, doc, cost)
        a, b, n_fit = longest_part(fits)
        if n_fit < need:
            continue
        inner = np.flatnonzero(fits[a:b]) + a
        a, b = int(inner[0]), int(inner[-1]) + 1
        errors = b - a - n_fit
        if len(item) < LEAST_WORDS and errors:
            continue
        return n_fit, errors, int(where[a]), int(where[b - 1])
    return None


class Scanner:
    """Finds leaks in texts; one per task."""

    def __init__(self, index: ItemIndex):
        self.index, self.repair, self._known, self._stretches = index, Repairer(), {}, {}

    def _id(self, raw: str) -> int:
        got = self._known.get(raw)
        if got is None:
            if len(self._known) > 500_000:
                self._known.clear()
            word = skeleton(raw) if "�" in raw else fold(raw)
            got = self._known[raw] = self.index.vocabulary.get(word, self.index.base - 1) if word else -1
        return got

    def prepared(self, text: str) -> str:
        """The text that spans refer to: damage and markup undone."""
        return plain_layout(self.repair(text))

    def words(self, text: str) -> np.ndarray:
        """Ids of the words of a prepared text; words of no item share one id."""
        known, other = self._known, self._id
        ids = [known[w] if w in known else other(w) for w in _WORD.findall(_NUMBERING.sub("", text))]
        got = np.array(ids, np.int64)
        return got[got >= 0]

    def candidates(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Positions of n-gram hits by item, for items with enough of them close together."""
        x, out = self.index, {}
        for gram, (codes, starts, flat) in x.tables.items():
            code = x.codes(ids, gram)
            if not len(code):
                continue
            at = np.searchsorted(codes, code)
            at[at == len(codes)] = 0
            hit = np.flatnonzero(codes[at] == code)
            if not len(hit):
                continue
            own_gram = at[hit]
            n = starts[own_gram + 1] - starts[own_gram]
            pos = np.repeat(hit, n)
            item = flat[np.repeat(starts[own_gram], n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)]
            count = np.bincount(item, minlength=len(x.words))
            for i in np.flatnonzero(count >= x.least_hits).tolist():
                if not count[i]:
                    continue
                own, need, reach = pos[item == i], int(x.least_hits[i]), 3 * len(x.words[i]) + 60
                near = own[need - 1 :] - own[: len(own) - need + 1] <= reach
                if near.any():
                    keep = np.zeros(len(own), bool)
                    for k in np.flatnonzero(near).tolist():
                        keep[k : k + need] = True
                    out[i] = own[keep]
        return out

    def _stretch(self, i: int, doc: np.ndarray) -> tuple[int, int, int, int] | None:
        """``stretch`` with a memory: copies of a page have the same windows."""
        key = (i, doc.tobytes())
        if key not in self._stretches:
            if len(self._stretches) > 5_000:
                self._stretches.clear()
            self._stretches[key] = stretch(self.index.words[i], doc)
        return self._stretches[key]

    def _of_item(self, i: int, own: np.ndarray, ids: np.ndarray, lines: np.ndarray, bars: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Every disjoint stretch of item ``i`` around the hits ``own``: (words that fit, errors, first, last position in ``ids``)."""
        size, gram = len(self.index.words[i]), int(self.index.gram[i])
        reach = size + size // 4 + 2  # no stretch is longer, page furniture aside
        with_hit = np.unique(np.r_[lines[own], lines[np.minimum(own + gram - 1, len(lines) - 1)]])
        length = np.bincount(lines)
        # page furniture: lines without a hit that are short or lists of links
        furniture = (length <= FURNITURE_WORDS) | bars
        furniture[with_hit] = False
        views = [np.flatnonzero(~furniture[lines])]
        if len(views[0]) < len(ids):
            views.append(np.arange(len(ids)))
        yield from self._between(i, own, ids, views, reach, 0, len(ids))

    def _between(self, i: int, own: np.ndarray, ids: np.ndarray, views: list[np.ndarray], reach: int, done: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """The stretches among the positions from ``done`` to before ``end``."""
        own = own[own < end]
        while len(own := own[own >= done]):
            hit = int(own[0])
            best, passed = None, end
            for view in views:
                at, low, high = np.searchsorted(view, (hit, done, end)).tolist()
                window = view[max(low, at - reach) : min(high, at + 2 * reach)]
                # a stretch that holds a hit up to here lies in the window
                passed = min(passed, int(view[at + reach]) if at + reach < high else end)
                if len(window) and (got := self._stretch(i, ids[window])) is not None:
                    best = (got[0], got[1], int(window[got[2]]), int(window[got[3]]))
                    break
            if best is None:
                done = max(passed, hit + 1)
                continue
            yield from self._between(i, own, ids, views, reach, done, best[2])
            yield best
            done = best[3] + 1

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int, int, int, int]]:
        """Disjoint stretches: (item id, number of the stretch, words that fit, errors, item words, first and end character in the prepared text).

        Number 0 is the item's longest stretch in the text.
        """
        if not text:
            return []
        clean = self.prepared(text)
        found = self.candidates(self.words(clean))
        if not found:
            return []
        ids, spans = [], []
        ends = sorted((m.start(), m.end()) for m in _NUMBERING.finditer(clean))
        k = 0
        line_starts = np.array([0] + [m.end() for m in re.finditer("\n", clean)], np.int64)
        for m in _WORD.finditer(clean):
            while k < len(ends) and ends[k][1] <= m.start():
                k += 1
            if k < len(ends) and ends[k][0] <= m.start() < ends[k][1]:
                continue
            if (w := self._id(m.group())) >= 0:
                ids.append(w)
                spans.append(m.span())
        ids = np.array(ids, np.int64)
        lines = np.searchsorted(line_starts, np.array([s for s, _ in spans], np.int64), "right") - 1
        bars = np.array([("|" in t or "•" in t or "·" in t) for t in clean.split("\n")])[: lines[-1] + 1]
        by_item = defaultdict(list)
        for i, own in found.items():
            for fit, errors, a, b in self._of_item(i, own, ids, lines, bars):
                by_item[self.index.ids[i]].append((fit, errors, len(self.index.words[i]), spans[a][0], spans[b][1]))
        out = []
        for ident, own in sorted(by_item.items()):
            kept: list[tuple] = []
            for new in sorted(own, key=lambda s: (-s[0], s[1], s[3])):  # two forms of an item find the same place
                if all(new[3] >= old[4] or new[4] <= old[3] for old in kept):
                    kept.append(new)
            out += [(ident, nr, *s) for nr, s in enumerate(kept)]
        return out

    def without(self, text: str) -> str | None:
        """The text, damage undone, with every leaked stretch cut out, until none is left; None if there's none."""
        found, out = self.leaks(text), None
        while found:
            clean, kept, at = self.prepared(text), [], 0
            for start, end in sorted(s[5:] for s in found):
                kept.append(clean[at : max(at, start)])
                at = max(at, end)
            text = out = "".join(kept) + clean[at:]
            found = self.leaks(text)
        return out


SPAN_SCHEMA = "doc_id bigint, item_id bigint, nr int, n_fit int, n_errors int, n_words int, span_start int, span_end int"


def with_shared(items: DataFrame) -> DataFrame:
    """``(item_id, text, shared)``: whether an item's first line, ended by a newline, opens an item with another rest too."""
    text = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    head = F.trim(F.regexp_replace(F.regexp_extract(text, r"\A([^\n]*)\n", 1), r"(?U)\s+", " "))
    told = items.select("item_id", "text", F.when(text.contains("\n"), head).alias("__head"), F.regexp_extract(text, r"\n([\s\S]*)\z", 1).alias("__rest"))
    several = told.where(F.col("__head").isNotNull()).groupBy(F.col("__head").alias("__h")).agg(F.count_distinct(F.xxhash64("__rest")).alias("n")).where("n > 1")
    return told.join(several, F.col("__head") == F.col("__h"), "left").select("item_id", "text", F.col("__h").isNotNull().alias("shared"))


def _parts(items: DataFrame, most: int) -> Iterator[tuple[int, ItemIndex]]:
    """(number of parts, index) of the items, ``most`` bytes of text in a part on average."""
    told = with_shared(items)
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most))
    for k in range(n):
        own = told if n == 1 else told.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, ItemIndex([(r[0], r[1], r[2]) for r in own.select("item_id", "text", "shared").collect()])


def find_leaks(docs: DataFrame, items: DataFrame, most: int = ITEM_BYTES) -> DataFrame:
    """``SPAN_SCHEMA`` rows: every stretch of every document with the item it leaks; ``nr`` 0 is the longest of its pair."""
    sc, out = docs.sparkSession.sparkContext, None
    for n, index in _parts(items, most):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(sent.value)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
            names = [x.split()[0] for x in SPAN_SCHEMA.split(", ")]
            for b in batches:
                rows = [(d, *leak) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for leak in scanner.leaks(t)]
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

        part = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SPAN_SCHEMA)
        if n > 1:
            part = materialize(part, "leaks")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, most: int = ITEM_BYTES) -> DataFrame:
    """``(doc_id, text)`` of the leaking documents, damage undone and every leaked stretch cut out; one scan per part of the items."""
    sc = docs.sparkSession.sparkContext
    now = docs.select(F.col("doc_id").cast("bigint"), "text", F.lit(False).alias("cut"))
    for n, index in _parts(items, most):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=n == 1) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(sent.value)
            for b in batches:
                rows = []
                for ident, text, cut in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    new = scanner.without(text) if text else None
                    if cut or new is not None or not last:
                        rows.append({"doc_id": ident, "text": text if new is None else new, "cut": cut or new is not None})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("cut", pa.bool_())]))

        now = now.mapInArrow(run, "doc_id bigint, text string, cut boolean")
        if n > 1:
            now = materialize(now, "cleaned")
            sent.destroy()
    return now.where("cut").select("doc_id", "text")
