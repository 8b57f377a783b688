"""Evaluation passages leaking into a corpus: SimHash of passage windows, multi-index Hamming search, exact verification.

A document holds a passage when it shares ``run`` or more consecutive words with it, or a stretch of ``stretch`` or more words in
which at most one in ``per_edit`` was changed, broken, dropped or added. Letter case, punctuation, markup, invisible characters
and line breaks do not matter. The words of a stretch are those of the passage or of the document, whichever are more.

1. Windows. A qualifying stretch of n words with e edits keeps at least n - e of them in at most e + 1 runs; a long one contains one
   of fewer than 2 * ``stretch`` words, so the longest run has at least (n - e) / (e + 1) words for n = ``stretch``: 4 words by
   default. Windows of that width are what every qualifying stretch holds intact, at least n - e - 3 (e + 1) = 5 of them.
   Each window gets a 64-bit SimHash over its words, weighted by rarity among the passages.
2. Search. Fingerprints are cut into ``radius + 1`` blocks; two within the radius agree on a block at least, so looking up
   every block of a document window in a table of passage windows finds all of them. Nothing is capped or sampled.
3. Shingles. A document and a passage are compared where ``seeds`` of the passage's window-sized shingles stand within the length
   of a stretch, the least any qualifying one holds.
4. Verification. Shingles in a row make a run; ``run`` words decide at once. Otherwise every run is an anchor: the reach to its left and to
   its right is computed for each number of edits (furthest-reaching points on the diagonals of the alignment, for all anchors at once), and
   the pair is a case if a left and a right reach make a stretch that has enough words for their edits. Every qualifying
   stretch contains an anchor, so none is lost, wherever its edits stand and whatever lies beside it.

Passages are the stated query set. They are sent to the tasks in blocks of at most ``BLOCK`` items, and all blocks meet the documents in one
pass: a task holds some texts and one block at a time. Documents are never shuffled, only found pairs are. Texts are processed whole.

Defined cases: null or blank texts and passages hold nothing. Passages of fewer than ``run`` words cannot leak. Repeated
document rows give one pair. Rows with a null item id are ignored; a null doc_id stays null. Documents or items without rows give
no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, STRETCH, PER_EDIT, RADIUS = 12, 24, 6, 3
BLOCK = 20_000
SLICE = 100_000
ANCHORS = 20_000
_BITS = 64

_TAG = re.compile(r"<[!/]?[a-z][^<>\n]*>", re.IGNORECASE)
_ESCAPE = re.compile(r"\\[ntr]")
_HYPHEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")
_SPACE = re.compile(r"[|/\\—–…\[\](){}<>]+")
_DROP = re.compile(r"[^\w\s]+|_")
#: What _SPACE and _DROP do, for texts of ASCII alone.
_PLAIN = bytes(32 if c < 128 and _SPACE.match(chr(c)) else c for c in range(256))
_DELETE = bytes(c for c in range(128) if _DROP.match(chr(c)) and not _SPACE.match(chr(c)))


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup and invisible characters."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    text = text.casefold()
    if "-" in text:
        text = _HYPHEN.sub("", text)
    return text.encode().translate(_PLAIN, _DELETE).decode().split() if plain else _DROP.sub("", _SPACE.sub(" ", text)).split()


class Passages:
    """The search structure over a block of passages; its size follows the passages only."""

    def __init__(self, items: list[tuple[int, str, str]], run: int = RUN, stretch: int = STRETCH, per_edit: int = PER_EDIT, radius: int = RADIUS):
        self.run, self.stretch, self.per_edit, self.radius = run, stretch, per_edit, radius
        edits = stretch // per_edit
        self.width = (stretch - edits) // (edits + 1)
        self.seeds = min(stretch - edits - (self.width - 1) * (edits + 1), run - self.width + 1)
        self.items, self.sides, self.texts = [], [], []
        for item, side, text in items:
            w = words(text)
            if len(w) >= run:
                self.items.append(item)
                self.sides.append(side)
                self.texts.append(w)
        longest = max(map(len, self.texts), default=0)
        self.reach = longest + longest // per_edit + self.width
        df = Counter(w for t in self.texts for w in set(t))
        self.vocabulary = {w: i for i, w in enumerate(sorted(df))}
        vectors = np.zeros((len(self.vocabulary) + 1, _BITS), np.float32)  # the last row, of unknown words, weighs nothing
        for w, i in self.vocabulary.items():
            h = np.array([xxhash.xxh3_64_intdigest(w)], dtype="<u8").view(np.uint8)
            vectors[i] = (np.unpackbits(h).astype(np.float32) * 2 - 1) * np.float32(np.log1p(len(self.texts) / df[w]))
        self.vectors = vectors
        # all passages in one array, each followed by a gap that equals no word
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(np.concatenate(([0], self.size + 1)))[:-1]
        self.flat = np.array([x for t in self.texts for x in (*[self.vocabulary[w] for w in t], -1)], np.int32)
        place = np.concatenate([b + np.arange(n - self.width + 1) for b, n in zip(self.begin, self.size, strict=True)]) if self.texts else np.zeros(0, np.int64)
        prints = self.fingerprints(self.flat, place)
        # windows by distinct fingerprint
        order = np.argsort(prints, kind="stable")
        self.prints, first = np.unique(prints[order], return_index=True)
        self.place = place[order]
        self.first = np.append(first, len(order)).astype(np.int64)
        # one table per block: value -> distinct fingerprints, as ranges of a sorted list
        cuts = np.linspace(0, _BITS, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            shift, bits = np.uint64(a), np.uint64((1 << int(b - a)) - 1)
            values = ((self.prints >> shift) & bits).astype(np.int64)
            by = np.argsort(values, kind="stable")
            size = 1 << int(b - a)
            starts = np.searchsorted(values[by], np.arange(size + 1))
            self.blocks.append((shift, bits, by, starts))

    def fingerprints(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """SimHash of the windows that begin at ``at``."""
        if not len(at):
            return np.zeros(0, np.uint64)
        total = self.vectors[codes[at]]
        for k in range(1, self.width):
            total = total + self.vectors[codes[at + k]]
        return np.packbits(total > 0, axis=1).view("<u8").ravel().astype(np.uint64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index into ``prints``, index into self.prints) within the radius."""
        left, right = [], []
        for k, (shift, bits, by, starts) in enumerate(self.blocks):
            v = ((prints >> shift) & bits).astype(np.int64)
            n = starts[v + 1] - starts[v]
            if not n.sum():
                continue
            i = np.repeat(np.arange(len(prints)), n)
            j = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[v], n)]
            x = prints[i] ^ self.prints[j]
            keep = np.bitwise_count(x) <= self.radius
            for s, b, _, _ in self.blocks[:k]:  # found by an earlier block already
                keep &= ((x >> s) & b) != 0
            left.append(i[keep])
            right.append(j[keep])
        none = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)

    def owner(self, place: np.ndarray) -> np.ndarray:
        """The passages that places in the array of all passages belong to."""
        return np.searchsorted(self.begin, place, side="right") - 1

    def seeds_in(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, place in the array of passages) of all windows of a coded run of words that are shingles of a passage."""
        known = codes != len(self.vocabulary)
        count = np.cumsum(np.concatenate(([0], known)))
        # a window with two unknown words cannot be part of a match that verification would keep
        at = np.flatnonzero(count[self.width :] - count[: -self.width] >= self.width - 1) if len(codes) >= self.width else np.zeros(0, np.int64)
        out = [[], []]
        for a in range(0, len(at), SLICE):
            part = at[a : a + SLICE]
            i, j = self.near(self.fingerprints(codes, part))
            n = self.first[j + 1] - self.first[j]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[j], n)
            where, place = np.repeat(part[i], n), self.place[entry]
            same = np.ones(len(where), bool)  # within the radius, but of other words: no shingle of the passage
            for k in range(self.width):
                same &= codes[where + k] == self.flat[place + k]
            out[0].append(where[same])
            out[1].append(place[same])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)

    def search(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """(passage, longest run, share kept) of every passage that the words hold."""
        return self.search_many([tokens])[0]

    def search_many(self, texts: list[list[str]]) -> list[list[tuple[int, int, float]]]:
        """search() of several texts, whose windows are looked up and whose anchors are measured together."""
        unknown, get = len(self.vocabulary), self.vocabulary.get
        tokens = [t for text in texts for t in (*text, *[""] * self.width)]  # no window spans two texts
        codes = np.array([get(t, unknown) for t in tokens], np.int32)
        ends = np.cumsum([len(t) + self.width for t in texts]) - self.width
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        where, place = self.seeds_in(codes)
        if not len(where):
            return found
        text, who = np.searchsorted(ends, where, side="right"), self.owner(place)
        pair = text * len(self.texts) + who
        order = np.lexsort((where, pair))
        pair, where, place = pair[order], where[order], place[order]
        # as many shingles as the least stretch holds must stand within the length of the longest piece that has to be looked at
        near, k = np.zeros(len(pair), bool), self.seeds - 1
        if len(pair) > k:
            dense = np.flatnonzero((pair[k:] == pair[: len(pair) - k]) & (where[k:] - where[: len(pair) - k] <= 2 * self.stretch + self.stretch // self.per_edit * 2))
            for i in range(k + 1):
                near[dense + i] = True
        pair, where, place = pair[near], where[near], place[near]
        if not len(pair):
            return found
        # neighbouring windows on one diagonal are one run of equal words
        order = np.lexsort((where, where - place, pair))
        pair, where, place = pair[order], where[order], place[order]
        d = where - place
        cut = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (d[1:] != d[:-1]) | (where[1:] != where[:-1] + 1))))
        size = np.diff(np.append(cut, len(pair))) + self.width - 1
        pair, where, place = pair[cut], where[cut], place[cut]
        group, inverse = np.unique(pair, return_inverse=True)
        longest = np.zeros(len(group), np.int64)
        np.maximum.at(longest, inverse, size)
        kept = np.where(longest >= self.run, 1.0, 0.0)
        open_ = np.flatnonzero(longest[inverse] < self.run)
        for a in range(0, len(open_), ANCHORS):
            part = open_[a : a + ANCHORS]
            share = self._stretches(codes, tokens, ends, where[part], place[part], size[part])
            np.maximum.at(kept, inverse[part], share)
        for g in np.flatnonzero(kept > 0):
            found[int(group[g] // len(self.texts))].append((int(group[g] % len(self.texts)), int(longest[g]), float(kept[g])))
        return found

    def _stretches(self, codes: np.ndarray, tokens: list[str], ends: np.ndarray, where: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The greatest share of untouched words over the stretches around each anchor that qualify; 0 where none does."""
        edits = (2 * self.stretch) // self.per_edit
        text, who = np.searchsorted(ends, where, side="right"), self.owner(place)
        starts = np.concatenate(([0], ends[:-1] + self.width))
        # two words of the document that make one of the passages' words when put together: looked up around the anchors only
        reach = self.stretch * 2 + edits + 2
        spots = np.zeros(len(codes) + 1, np.int32)
        np.add.at(spots, np.maximum(where - reach, 0), 1)
        np.add.at(spots, np.minimum(where + size + reach, len(codes)), -1)
        joined, get = np.full(len(codes), -2, np.int32), self.vocabulary.get
        for i in np.flatnonzero(np.cumsum(spots[:-1]) > 0):
            if i + 1 < len(codes) and tokens[i] and tokens[i + 1]:
                joined[i] = get(tokens[i] + tokens[i + 1], -2)
        right = self._reaches(codes, joined, where + size, place + size, ends[text] - where - size, self.begin[who] + self.size[who] - place - size, 1, edits)
        left = self._reaches(codes, joined, where - 1, place - 1, where - starts[text], place - self.begin[who], -1, edits)
        best = np.zeros(len(where))
        for a in range(edits + 1):
            for b in range(edits + 1 - a):
                n = size + np.maximum(left[0][a] + right[0][b], left[1][a] + right[1][b])
                e = a + b
                fits = (n >= self.stretch) & (n >= self.per_edit * e)
                best = np.where(fits, np.maximum(best, 1 - e / n), best)
        return best

    def _reaches(self, codes: np.ndarray, joined: np.ndarray, i0: np.ndarray, j0: np.ndarray, room: np.ndarray, space: np.ndarray, step: int, edits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For 0, 1, ... edits, how many words of the document and of the passage an alignment reaches at most, going from word
        i0 and j0 in steps of ``step``; ``room`` and ``space`` words are there. On every diagonal only the furthest point counts."""
        width, n = 2 * edits + 3, len(i0)
        shift = np.arange(width) - edits - 1  # document words less passage words
        none = np.int64(-(1 << 40))
        x = np.full((n, width), none)
        x[:, edits + 1] = 0

        def slide(x: np.ndarray) -> np.ndarray:
            row, col = np.nonzero(x >= 0)
            while len(row):
                at = x[row, col]
                ok = (at < room[row]) & (at - shift[col] < space[row])
                row, col, at = row[ok], col[ok], at[ok]
                ok = codes[i0[row] + step * at] == self.flat[j0[row] + step * (at - shift[col])]
                row, col = row[ok], col[ok]
                x[row, col] += 1
            return x

        words_, places = [], []
        for e in range(edits + 1):
            if e:
                was = x
                x = was.copy()
                change = was + 1
                x = np.maximum(x, np.where((change <= room[:, None]) & (change - shift <= space[:, None]), change, none))
                more = was[:, :-1] + 1  # a word added to the document
                x[:, 1:] = np.maximum(x[:, 1:], np.where(more <= room[:, None], more, none))
                less = was[:, 1:]  # a word of the passage dropped
                x[:, :-1] = np.maximum(x[:, :-1], np.where(less - shift[:-1] <= space[:, None], less, none))
                row, col = np.nonzero((was[:, :-1] >= 0) & (was[:, :-1] + 2 <= room[:, None]) & (was[:, :-1] - shift[:-1] + 1 <= space[:, None]))
                at = was[row, col]
                first = i0[row] + step * at + (0 if step > 0 else -1)
                ok = joined[first] == self.flat[j0[row] + step * (at - shift[col])]
                row, col, at = row[ok], col[ok], at[ok]
                x[row, col + 1] = np.maximum(x[row, col + 1], at + 2)
            x = slide(x)
            words_.append(x.max(axis=1))
            places.append((x - shift).max(axis=1))
        return words_, places


def _chunks(texts: pd.Series, size: int, overlap: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Row numbers and words of texts, some ``size`` words at a time. Longer texts come in pieces that overlap by more than any stretch of
    a passage can cover, so what a text holds is whole in some piece."""
    rows, held_texts, held = [], [], 0
    for i, t in enumerate(texts):
        w = words(t)
        for at in range(0, max(1, len(w) - overlap), size):
            piece = w[at : at + size + overlap]
            if not piece:
                continue
            rows.append(i)
            held_texts.append(piece)
            held += len(piece)
            if held >= size:
                yield rows, held_texts
                rows, held_texts, held = [], [], 0
    if rows:
        yield rows, held_texts


def find(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("question", "answer"), block: int = BLOCK, **options) -> DataFrame:
    """(doc_id, item_id, field, run, kept) of every document and passage it holds."""
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[doc_id]
    key = dict(items.dtypes)[item_id]
    schema = f"doc_id {kind}, item_id {key}, field string, run int, kept double"
    picked = items.where(F.col(item_id).isNotNull()).select(item_id, *fields)
    blocks = max(1, -(-picked.count() // block))
    indexes, reach = [], 0
    for b in range(blocks):
        # a block holds about ``block`` items, whatever their number
        rows = picked.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b).collect()
        index = Passages([(r[item_id], f, r[f]) for r in rows for f in fields if r[f]], **options)
        reach = max(reach, index.reach)
        indexes.append(spark.sparkContext.broadcast(index))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best: dict[tuple, tuple[int, float]] = {}
            # the more blocks there are, the more words meet a block before the next one takes its place
            for numbers, texts in _chunks(batch["t"], SLICE // 4 * min(blocks, 40), reach):
                for shared in indexes:
                    p = shared.value
                    for i, hits in zip(numbers, p.search_many(texts), strict=True):
                        for k, longest, kept in hits:
                            case = (i, p.items[k], p.sides[k])
                            best[case] = max(best.get(case, (0, 0.0)), (longest, kept))
                    if blocks > 1:
                        shared.__dict__.pop("_value", None)  # it stays on the executor's disk
            if best:
                ids = batch["d"].tolist()
                yield pd.DataFrame([(ids[i], item, side, *v) for (i, item, side), v in best.items()], columns=["doc_id", "item_id", "field", "run", "kept"])

    return documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t is not null").mapInPandas(run, schema)
