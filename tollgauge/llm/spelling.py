"""Groups of spelling variants through a trie of letter-group counts.

A word's *vector* counts its letters in twelve groups (code point modulo 12). One inserted, deleted or replaced letter changes it by
at most one surplus and one deficit. Distinct vectors form a trie, one level per group; a depth-first walk carries all words still
within the budget of one surplus and one deficit down each branch, and pairs that reach a leaf are verified letter by letter.

The upper levels of the trie are Spark's: a word lives in the branch of its first counts and is sent as a visitor to the later
branches the budget reaches, with what is left of it. So every pair meets in one branch, and branches are independent groups of
rows. The number of upper levels is the smallest for which no branch holds more than ``BRANCH`` words (or all levels). Results per
word are folded in the branch (number of near words, best one) before they are shuffled.

Words are counted per slice of a text column first, so a very common word is one row per slice. A word's form has at least five times
its count, so chains of forms are short and their ends are found by doubling.

Defined cases: null texts have no words; a null id counts as an empty text in the draw of letters to delete; repeated rows count each;
words and texts may have any length; columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.tables import by_key, stored
from tollgauge.llm.words import slices, text_buffer

RUN = re.compile("[a-zÀ-ÿ]+")
GROUPS = 12
BRANCH = 20000
#: Words under a trie node that are compared at once, words longer than this are verified one by one, pairs verified at once.
LEAF, SHORT, PAIRS = 48, 40, 1 << 18
SLICE_BYTES = 16 << 20
FOUND = "word string, near long, best_n long, best string"
FOUND_SCHEMA = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def words_of(doc_id, text: str, every: int) -> Counter:
    """Lower-cased (A-Z only) letter runs of a text with their numbers; a keyed draw deletes one letter of one in ``every`` runs."""
    runs = Counter(RUN.findall(text))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _counted(every: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            offsets, data = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                total: Counter = Counter()
                for i in range(a, b):
                    # bytes.lower() changes A-Z only
                    text = data[offsets[i] : offsets[i + 1]].tobytes().lower().decode()
                    for word, n in words_of(ids[i], text, every).items():
                        if len(word) >= shortest:
                            total[word] += n
                if total:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return run


def count_words(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` letters found ``least`` times or more."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted(every, shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vectors_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, offsets, vectors): Latin-1 letters of all words in one array, where each word starts, and its counts per group."""
    codes = [w.encode("latin-1") for w in words.to_pylist()]
    offsets = np.zeros(len(codes) + 1, np.int64)
    np.cumsum([len(c) for c in codes], out=offsets[1:])
    letters = np.frombuffer(b"".join(codes), np.uint8)
    cell = np.repeat(np.arange(len(codes)), np.diff(offsets)) * GROUPS + letters % GROUPS
    return letters, offsets, np.bincount(cell, minlength=len(codes) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _prefix_key(v: np.ndarray) -> np.ndarray:
    """One integer per row of counts, equal for equal rows. Should different rows share one, the branch tells them apart again."""
    key = np.zeros(len(v), np.uint64)
    for column in v.T:
        key = key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1)
    return key.view(np.int64)


def _sizes(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, n = np.unique(_prefix_key(vectors_of(batch.column(0))[2][:, :levels]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["branch", "n"])

    return run


def depth(words: DataFrame, most: int) -> int:
    """Upper levels needed so that no branch holds more than ``most`` words."""
    for levels in range(1, GROUPS):
        sizes = words.select("word").mapInArrow(_sizes(levels), "branch long, n long").groupBy("branch").agg(F.sum("n").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
            return levels
    return GROUPS


def _moves(levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(changes, surplus left, deficit left): no change first, then the changes of the first counts that lead to a later branch.

    A branch with one more of something leaves the visitor with a deficit there.
    """
    moves = [m for m in product((-1, 0, 1), repeat=levels) if m.count(1) <= 1 and m.count(-1) <= 1 and m >= (0,) * levels]
    changes = np.array(moves, np.int32)
    return changes, 1 - (changes == -1).sum(axis=1), 1 - (changes == 1).sum(axis=1)


def _dealt(levels: int):
    changes = _moves(levels)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            upper = vectors_of(batch.column(0))[2][:, :levels]
            for move, change in enumerate(changes):
                to = upper + change
                there = np.flatnonzero((to >= 0).all(axis=1))
                if len(there):
                    rows = pa.array(there)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_prefix_key(to[there])), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(there), move), pa.int32())], names=["branch", "word", "n", "move"]
                    )

    return run


def one_apart(letters: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the words ``i`` and ``j`` differ by exactly one inserted, deleted or replaced letter."""
    size = np.diff(offsets)
    swap = size[i] > size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    out = np.zeros(len(i), bool)
    gap = size[j] - size[i]
    for k in np.flatnonzero((gap <= 1) & (size[j] > SHORT)):
        a, b = (letters[offsets[x] : offsets[x + 1]] for x in (i[k], j[k]))
        first = np.flatnonzero(a != b[: len(a)])
        at = first[0] if len(first) else len(a)
        out[k] = (at < len(a) or gap[k] == 1) and bool(np.array_equal(a[at + 1 - gap[k] :], b[at + 1 :]))
    own = np.flatnonzero((gap <= 1) & (size[j] <= SHORT))
    if not len(own):
        return out
    used, at = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
    width = int(size[used].max()) + 1
    grid = np.zeros((len(used), width), np.uint8)
    row = np.repeat(np.arange(len(used)), size[used])
    col = np.arange(len(row)) - np.repeat(np.cumsum(size[used]) - size[used], size[used])
    grid[row, col] = letters[np.repeat(offsets[used], size[used]) + col]
    a, b = grid[at[: len(own)]], grid[at[len(own) :]]
    differ = a != b
    total = differ.sum(axis=1)
    # one letter more in b: behind the first difference, b is a moved by one
    moved = a[:, :-1] != b[:, 1:]
    first = differ.argmax(axis=1)
    behind = np.arange(width - 1) >= first[:, None]
    longer = (total > 0) & ~(moved & behind).any(axis=1)
    out[own] = np.where(gap[own] == 0, total == 1, longer)
    return out


class _Walk:
    """Depth-first walk of one branch: words at home form the trie, all words of the branch are carried down with their budgets."""

    def __init__(self, vectors: np.ndarray, home: np.ndarray, up: np.ndarray, down: np.ndarray, levels: int, leaf: int):
        self.levels, self.leaf = levels, leaf
        own = np.flatnonzero(home)
        order = own[np.lexsort(vectors[own].T[::-1])]
        self.order, self.trie = order, vectors[order]
        self.vectors, self.up, self.down, self.home = vectors, up, down, home
        #: a pair of words at home is taken once: from the later place to the earlier one
        self.place = np.full(len(vectors), len(order))
        self.place[order] = np.arange(len(order))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._down(0, len(self.order), self.levels, np.arange(len(self.vectors)), self.up, self.down)

    def _down(self, low: int, high: int, level: int, who: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # words at home with places before this node have met it already
        stay = self.place[who] > low
        who, up, down = who[stay], up[stay], down[stay]
        if not len(who):
            return
        if high - low <= self.leaf or level == GROUPS:
            step = max(1, PAIRS // (high - low))
            for a in range(0, len(who), step):
                yield from self._leaf(low, high, level, who[a : a + step], up[a : a + step], down[a : a + step])
            return
        column = self.trie[low:high, level]
        edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [high - low]])
        count = self.vectors[who, level]
        for a, b in zip(edges[:-1], edges[1:]):
            more = count - column[a]
            left_up, left_down = up - (more == 1), down - (more == -1)
            go = (np.abs(more) <= 1) & (left_up >= 0) & (left_down >= 0)
            yield from self._down(low + a, low + b, level + 1, who[go], left_up[go], left_down[go])

    def _leaf(self, low: int, high: int, level: int, who, up, down) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        surplus = np.zeros((len(who), high - low), np.int32)
        deficit = np.zeros_like(surplus)
        for g in range(level, GROUPS):
            more = self.vectors[who, g][:, None] - self.trie[None, low:high, g]
            surplus += np.maximum(more, 0)
            deficit += np.maximum(-more, 0)
        meets = (surplus <= up[:, None]) & (deficit <= down[:, None]) & (self.place[who][:, None] > np.arange(low, high)[None])
        x, y = np.nonzero(meets)
        if len(x):
            yield who[x], self.order[low + y]


def _folded(words: list, n: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray, best: list) -> None:
    """Count the pairs and keep, per word, the near word of largest count, the smaller one of equals."""
    np.add.at(near, i, 1)
    np.add.at(near, j, 1)
    for a, b in ((i, j), (j, i)):
        for x, y in zip(a.tolist(), b.tolist()):
            z = best[x]
            if z < 0 or n[y] > n[z] or (n[y] == n[z] and words[y] < words[z]):
                best[x] = y


def _branches(levels: int, leaf: int):
    changes, left_up, left_down = _moves(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "branch"):
            move = t.column("move").to_numpy()
            if move.all():  # visitors only
                continue
            column = t.column("word").combine_chunks()
            letters, offsets, vectors = vectors_of(column)
            words, n = column.to_pylist(), t.column("n").to_numpy()
            near, best = np.zeros(len(words), np.int64), [-1] * len(words)
            held: list = []

            def settle() -> None:
                i, j = (np.concatenate(x) for x in zip(*held))
                held.clear()
                ok = one_apart(letters, offsets, i, j)
                _folded(words, n, near, i[ok], j[ok], best)

            waiting = 0
            _, branch = np.unique(vectors[:, :levels] + changes[move], axis=0, return_inverse=True)
            branch = branch.ravel()
            for own in range(int(branch.max()) + 1):
                rows = np.flatnonzero(branch == own)
                m = move[rows]
                for i, j in _Walk(vectors[rows], m == 0, left_up[m], left_down[m], levels, leaf).pairs():
                    held.append((rows[i], rows[j]))
                    waiting += len(i)
                    if waiting >= PAIRS:
                        settle()
                        waiting = 0
            if held:
                settle()
            hit = [x for x, y in enumerate(best) if y >= 0]
            if hit:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[x] for x in hit], pa.string()), pa.array(near[hit]), pa.array([int(n[best[x]]) for x in hit], pa.int64()), pa.array([words[best[x]] for x in hit], pa.string())], schema=FOUND_SCHEMA
                )

    return run


def near_words(words: DataFrame, most: int = BRANCH, leaf: int = LEAF) -> DataFrame:
    """(word, near, best_n, best) of the words that have near ones: their number, and the one of largest n, smallest if equal."""
    levels = depth(words, most)
    dealt = words.select("word", "n").mapInArrow(_dealt(levels), "branch long, word string, n long, move int")
    found = dealt.repartition("branch").sortWithinPartitions("branch").mapInArrow(_branches(levels, leaf), FOUND)
    least = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), least.alias("b")).select("word", "near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def group_variants(words: DataFrame, ratio: int = 5, most: int = BRANCH, leaf: int = LEAF) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) rows; ``words`` should be stored, it is read several times."""
    found = words.join(near_words(words, most, leaf), "word", "left")
    real = F.col("best_n") >= ratio * F.col("n")
    formed = stored(
        found.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(real, F.col("best")).alias("form"), F.when(real, F.col("best_n")).alias("form_n"))
    )
    largest = formed.agg(F.max("n")).first()[0] or 1
    # every step multiplies n by ratio at least, so a chain has at most log(largest, ratio) steps
    steps = max(1, math.ceil(math.log(max(largest, 2), ratio)))
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ends = stored(ends)
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_trie(docs: DataFrame) -> DataFrame:
    """The contract's rows: words of six letters and five occurrences with their forms."""
    return group_variants(stored(count_words(docs)))
