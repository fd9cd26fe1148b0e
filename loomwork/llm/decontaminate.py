"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts and items are sequences of words (white-space cut, lower case, letters and
digits only). A passage leaks item ``i`` of ``n`` words if some window of a text is
within ``floor(ratio * n)`` word edits of it.

Per slice of texts, in one task and without moving a row:

1. Windows that cannot be that close are set aside by counting: an edit breaks at most
   three of an item's ``n - 2`` runs of three words, so one of its ``3k + 1`` rarest runs
   stands within ``k`` words of its place, and all but ``3k`` runs stand inside the window.
   This loses nothing. (Where so few words would leave no run, runs are shorter.)
2. Remaining windows and the items walk through the CGK embedding: at step ``j`` the
   walk emits the word it stands on and moves on if a random bit of (step, word) says
   so. Words edited apart fall back into step, so few edits give few differing
   positions (Hamming distance) of the walk.
3. ``reps`` independent walks are sampled at ``sampled`` positions each; equal samples
   make a candidate.
4. Each candidate, and the windows around one that holds, is checked by the exact edit
   distance over all window ends.

``recall`` states the share that the sampling finds, given the share of equal positions.
That share depends on the kind of edit: least is left by scattered deletions, after which
a walk of the item's length ends in foreign words. ``REPS`` is set by the measured recall
of the worst kind at the bound, not by ``recall`` alone.

Items are the query set: they are read in blocks of bounded size, and each block's
index, bounded with it, travels to the tasks that scan the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwork.llm.arrowtext import ranges, text_slices

RATIO = 0.2
REPS = 64
SAMPLED = 2
MIN_WORDS = 8
BLOCK_BYTES = 16 << 20
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def recall(equal_share: float, reps: int = REPS, sampled: int = SAMPLED) -> float:
    return 1 - (1 - equal_share**sampled) ** reps


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code per word, distinct normalised words, words per text); marks alone are no words.

    A letter of a script without spaces is a word.
    """
    unspaced = pc.match_substring_regex(texts, _UNSPACED)
    if pc.any(unspaced).as_py():
        texts = pc.if_else(unspaced, pc.replace_substring_regex(texts, f"({_UNSPACED})", r" \1 "), texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.replace_substring_regex(pc.utf8_lower(encoded.dictionary), r"[^\pL\pN]+", "")
    again = plain.dictionary_encode()
    codes = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else codes
    blank = pc.fill_null(pc.index_in(pa.array([""]), again.dictionary), -1)[0].as_py()
    if blank >= 0:
        keep = codes != blank
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts))
        codes = codes[keep]
    return codes, again.dictionary, counts


def word_runs(words: np.ndarray, length: int = 3) -> np.ndarray:
    """A hash of the ``length`` words from each place; equal runs have equal hashes."""
    x = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        for _ in range(length - 1):
            x = x[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[len(words) - len(x) + 1 :].astype(np.uint64)
    return x


def run_length(n: int, k: int) -> int:
    """Words per run, three at most, so that k edits cannot break all runs of n words."""
    return next((r for r in (3, 2) if n - r + 1 - r * k > 0), 1)


def walk_table(vocabulary: int) -> np.ndarray:
    """512 random bits per word; row 0 is the padding, row 1 any word no item has."""
    return np.random.default_rng(1).integers(0, 1 << 64, (8, vocabulary + 2), dtype=np.uint64)


def walk_keys(windows: np.ndarray, sizes: np.ndarray, table: np.ndarray, places_of: dict[int, np.ndarray]) -> np.ndarray:
    """(reps, rows): a hash of what each walk over the first ``sizes`` words of a row emits where it is sampled.

    Words are -2 for padding, -1 for unknown ones. A walk past the last word emits padding.
    """
    count, width = windows.shape
    padded = np.zeros((count, width + 1), dtype=np.int32)
    np.copyto(padded[:, :width], windows + 2, where=np.arange(width) < sizes[:, None])
    flat = padded.ravel()
    known, which = np.unique(sizes, return_inverse=True)
    places = np.stack([places_of[n] for n in known.tolist()], axis=1)
    reps = len(places)
    at = np.tile(np.arange(count, dtype=np.int64) * (width + 1), (reps, 1))
    end = at + sizes
    steps = int(places.max()) + 1
    bits = np.array([np.random.default_rng([rep, 2]).integers(0, 512, steps) for rep in range(reps)])
    rows, shifts = (bits >> 6) * table.shape[1], (bits & 63).astype(np.uint64)
    cells = table.ravel()
    key = np.zeros((reps, count), dtype=np.uint64)
    for step in range(steps):
        word = flat[at]
        wanted = (places == step).any(axis=2)
        if wanted.any():
            taken = wanted[:, which]
            with np.errstate(over="ignore"):
                mixed = (key[taken] ^ (word[taken] + 3).astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            key[taken] = mixed ^ (mixed >> np.uint64(32))
        moves = (cells[rows[:, step, None] + word] >> shifts[:, step, None]) & np.uint64(1)
        at = np.minimum(at + moves.astype(np.int64), end)
    return key.astype(np.uint32)


def sample_places(n: int, reps: int, sampled: int) -> np.ndarray:
    """(reps, sampled): where walks over ``n`` words are sampled; a walk of 2n steps passes about all n."""
    draws = (np.random.default_rng([n, rep]) for rep in range(reps))
    found = np.array([np.sort(d.choice(2 * n, size=min(sampled, 2 * n), replace=False)) for d in draws])
    return np.pad(found, ((0, 0), (0, sampled - found.shape[1])), mode="edge")


def edit_distances(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least word edits between each item (n words) and any prefix of its window."""
    width = windows.shape[1]
    steps = np.arange(width + 1, dtype=np.int32)
    row = np.tile(steps, (len(items), 1))
    for i in range(items.shape[1]):
        change = row[:, :-1] + (windows != items[:, i : i + 1])
        best = np.empty_like(row)
        best[:, 0] = row[:, 0] + 1
        best[:, 1:] = np.minimum(change, row[:, 1:] + 1)
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    return row.min(axis=1)


class ItemIndex:
    """One block of items: their words, the places of their rarest runs, their sampled walks."""

    def __init__(self, keys: list, texts: list[str | None], ratio=RATIO, reps=REPS, sampled=SAMPLED, min_words=MIN_WORDS):
        codes, self.words, counts = word_symbols(pa.array([t or "" for t in texts], pa.string()))
        self.words = pa.array(self.words.to_pylist(), pa.string())
        ends = np.cumsum(counts)
        rows: dict[tuple[int, ...], list] = {}  # equal items are one row
        for key, end, n in zip(keys, ends.tolist(), counts.tolist()):
            if n:
                rows.setdefault(tuple(codes[end - n : end].tolist()), []).append(key)
        self.keys = list(rows.values())
        items = [np.array(w, dtype=np.int32) for w in rows]
        self.sizes = np.array([len(w) for w in items], dtype=np.int64)
        self.allowed = np.array([int(ratio * len(w)) if len(w) >= min_words else 0 for w in items], dtype=np.int64)
        self.places = {n: sample_places(n, reps, sampled) for n in set(self.sizes.tolist())}
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*items, np.zeros(0, dtype=np.int32)]).astype(np.int32)
        self.table = walk_table(len(self.words))
        lengths = np.array([run_length(n, k) for n, k in zip(self.sizes.tolist(), self.allowed.tolist())], dtype=np.int64)
        self.need = self.sizes - lengths + 1 - lengths * self.allowed
        self.runs = [(r, *self._postings(items, np.flatnonzero(lengths == r), r)) for r in (3, 2, 1) if (lengths == r).any()]
        self.walks = np.zeros((reps, len(items)), dtype=np.uint32)
        for some in self._chunks(np.arange(len(items))):
            self.walks[:, some] = walk_keys(self._items(some), self.sizes[some], self.table, self.places)

    def _postings(self, items: list, numbers: np.ndarray, length: int) -> tuple:
        """(runs of these items, first posting of each, item and place per posting).

        Of an item only its ``length * k + 1`` rarest runs are posted: k edits leave one.
        """
        hashes = [word_runs(items[i], length) for i in numbers.tolist()]
        runs, codes, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        run, item, place, at = [], [], [], 0
        for i, h in zip(numbers.tolist(), hashes):
            mine = codes[at : at + len(h)]
            at += len(h)
            kept = np.argsort(often[mine], kind="stable")[: length * int(self.allowed[i]) + 1]
            run.append(mine[kept])
            place.append(kept)
            item.append(np.full(len(kept), i))
        run, item, place = np.concatenate(run), np.concatenate(item), np.concatenate(place)
        order = np.argsort(run, kind="stable")
        first = np.searchsorted(run[order], np.arange(len(runs) + 1))
        return runs, first, item[order], place[order]

    def _chunks(self, item: np.ndarray, cells: int = 1 << 17) -> Iterator[np.ndarray]:
        """Places of ``item``, by size, in parts whose walks or windows are bounded."""
        order = np.argsort(self.sizes[item], kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1024
            width = int(self.sizes[item[order[min(stop, len(order)) - 1]]])
            stop = min(stop, at + max(1, cells // width))
            yield order[at:stop]
            at = stop

    def _items(self, item: np.ndarray) -> np.ndarray:
        """Words of these items, padded to the longest."""
        steps = np.arange(int(self.sizes[item].max()))
        at = np.minimum(self.begin[item][:, None] + steps, len(self.flat) - 1)
        return np.where(steps < self.sizes[item][:, None], self.flat[at], np.int32(-2))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, row of ``keys``, first word, edits): the closest window per text and item row."""
        nothing = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        codes, words, counts = word_symbols(texts)
        if not len(codes) or not len(self.keys):
            return nothing
        known = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        symbols = known[codes]
        stop = np.cumsum(counts)
        begin = stop - counts
        item, start = [], []
        for length, *postings in self.runs:
            for some, at in self._windows(length, postings, symbols, begin, stop):
                near = self._sampled(some, at, symbols, stop)
                item.append(some[near])
                start.append(at[near])
        if not item:
            return nothing
        item, start = np.concatenate(item), np.concatenate(start)
        edits = self._edits(item, start, symbols, stop)
        good = edits <= self.allowed[item]
        item, start = item[good], start[good]
        # The closest window lies at most 2k from one that is close enough.
        wide = 4 * self.allowed[item] + 1
        around = np.repeat(start - 2 * self.allowed[item], wide) + ranges(np.zeros(len(item), dtype=np.int64), wide)
        text = np.repeat(np.searchsorted(stop, start, side="right"), wide)
        item = np.repeat(item, wide)
        inside = (around >= begin[text]) & (around < stop[text])
        item, start = _distinct(item[inside], around[inside])
        edits = self._edits(item, start, symbols, stop)
        good = edits <= self.allowed[item]
        item, start, edits = item[good], start[good], edits[good]
        text = np.searchsorted(stop, start, side="right")
        # Of equally close windows the first that starts with a word the item may start with.
        foreign = np.zeros(len(item), dtype=bool)
        for some in self._chunks(item):
            head = self._items(item[some])
            head[np.arange(head.shape[1]) > self.allowed[item[some]][:, None]] = -2
            foreign[some] = ~(head == symbols[start[some]][:, None]).any(axis=1)
        order = np.lexsort((start, foreign, edits, item, text))
        text, item, start, edits = text[order], item[order], start[order], edits[order]
        first = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])[: len(text)]
        return text[first], item[first], start[first] - begin[text[first]], edits[first]

    def _windows(self, length: int, postings: tuple, symbols, begin, stop, events: int = 1 << 16) -> Iterator[tuple]:
        """(items, first words) of all windows that step 1 leaves, a bounded number at a time."""
        runs, first, items, places = postings
        if len(symbols) < length:
            return
        whole = len(symbols) - length + 1
        here = np.flatnonzero(np.logical_and.reduce([symbols[i : whole + i] >= 0 for i in range(length)]))
        found = word_runs(symbols, length)[here]
        run = np.minimum(np.searchsorted(runs, found), len(runs) - 1)
        equal = runs[run] == found
        here, run = here[equal], run[equal]
        many = first[run + 1] - first[run]
        ends = np.cumsum(many)
        low = 0
        while low < len(here):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - many[low] + events, side="right")))
            at = ranges(first[run[low:high]], many[low:high])
            place = np.repeat(here[low:high], many[low:high])
            item = items[at]
            # k edits move a run by at most k words.
            wide = 2 * self.allowed[item] + 1
            start = np.repeat(place - places[at] - self.allowed[item], wide) + ranges(np.zeros(len(item), dtype=np.int64), wide)
            item, place = np.repeat(item, wide), np.repeat(place, wide)
            inside = (start >= begin[np.searchsorted(stop, place, side="right")]) & (start <= place)
            item, start = item[inside], start[inside]
            # So many runs of any item must start in the window.
            reach = start + self.sizes[item] + self.allowed[item] - length + 1
            enough = np.searchsorted(here, reach) - np.searchsorted(here, start) >= self.need[item]
            yield _distinct(item[enough], start[enough])
            low = high

    def _grid(self, item, start, symbols, stop) -> np.ndarray:
        """The words from each start on, n + k of the longest item, padded behind each item's own and the text's end."""
        size = self.sizes[item] + self.allowed[item]
        steps = np.arange(int(size.max()))
        grid = start[:, None] + steps
        inside = grid < np.minimum(stop[np.searchsorted(stop, start, side="right")], start + size)[:, None]
        return np.where(inside, symbols[np.minimum(grid, len(symbols) - 1)], np.int32(-2))

    def _sampled(self, item, start, symbols, stop) -> np.ndarray:
        """Where a window's walk and its item's agree in one sample at least."""
        near = np.zeros(len(item), dtype=bool)
        for some in self._chunks(item):
            windows = self._grid(item[some], start[some], symbols, stop)
            keys = walk_keys(windows, self.sizes[item[some]], self.table, self.places)
            near[some] = (keys == self.walks[:, item[some]]).any(axis=0)
        return near

    def _edits(self, item, start, symbols, stop) -> np.ndarray:
        edits = np.zeros(len(item), dtype=np.int64)
        for some in self._chunks(item):
            sizes = self.sizes[item[some]]
            for n in np.unique(sizes).tolist():
                part = some[sizes == n]
                edits[part] = edit_distances(self._items(item[part]), self._grid(item[part], start[part], symbols, stop))
        return edits


def _distinct(item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] != start[:-1])])[: len(item)]
    return item[new], start[new]


def item_blocks(items: DataFrame, item_key: str, item_text: str, limit: int = BLOCK_BYTES, **options) -> Iterator[ItemIndex]:
    """One index per ``limit`` bytes of item text; rows are streamed, never held beyond a block."""
    keys, texts, size = [], [], 0
    for row in items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).toLocalIterator():
        keys.append(row.k)
        texts.append(row.t)
        size += len(row.t or "")
        if size >= limit:
            yield ItemIndex(keys, texts, **options)
            keys, texts, size = [], [], 0
    if keys:
        yield ItemIndex(keys, texts, **options)


def leaks(
    docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id", item_text="text", **options
) -> DataFrame:
    """``key``, ``item_key``, first_word and edits of the closest window, per document row and leaked item.

    Documents without a leak give no row; null and empty texts have no windows. Items
    under ``min_words`` words match word for word only; null and empty ones, and those
    of marks alone, match nothing. Items of equal words are each reported; null keys are carried; repeated
    rows give repeated results. Other columns are not carried.
    """
    names = [key, item_key, "first_word", "edits"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, first_word bigint, edits bigint"
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    item_type = to_arrow_type(items.schema[item_key].dataType)

    def scan(index: ItemIndex):
        def run(batches):
            for part, texts in text_slices(batches, "__text"):
                row, item, first, edits = index.find(texts)
                copies = np.array([len(index.keys[i]) for i in item], dtype=np.int64)
                found = [k for i in item for k in index.keys[i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(row, copies))),
                        pa.array(found, item_type),
                        pa.array(np.repeat(first, copies)),
                        pa.array(np.repeat(edits, copies)),
                    ],
                    names=names,
                )

        return rows.mapInArrow(run, schema)

    found = None
    for index in item_blocks(items, item_key, item_text, **options):
        found = scan(index) if found is None else found.unionAll(scan(index))
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, items: DataFrame, text="text", item_key="item_id", item_text="text", **options) -> DataFrame:
    """``docs``, all columns, less the rows that ``leaks`` would report."""
    for index in item_blocks(items, item_key, item_text, **options):

        def run(batches, index=index):
            for part, texts in text_slices(batches, text):
                kept = np.ones(part.num_rows, dtype=bool)
                kept[index.find(texts)[0]] = False
                yield part.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
