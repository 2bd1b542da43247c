"""SentencePiece encoding and decoding, with a max-plus parallel scan over giant documents.

A segmentation is a path through the lattice of pieces. Its weight is the sum of its pieces' scores for unigram models. For BPE models
every piece weighs 0 and two pieces may stand side by side only if BPE on their joined text gives exactly these two, else the step weighs
minus infinity: the one path left is the BPE segmentation. A boundary between chunks has as states the pieces that reach over it (for
unigram: how far). A chunk yields the matrix of best weights from states at its left to states at its right boundary. Max-plus products
of matrices are associative: blocks of chunks are multiplied in parallel, a document's blocks are scanned, the states go back to the
blocks and chunks, and every chunk is backtraced on its own.

Where no piece of the model holds a space mark after another character, all paths meet before each word, so inside a chunk only the
stretches before its first and after its last such place need the lattice; the rest is one known path.

The model's file is a parameter; the tokenizer is used as it is. Texts of up to ``giant`` characters are encoded by the library directly.

Defined cases: null and empty texts have no pieces and decode to the empty text; the round trip is held against the text as the model
normalises it, its spaces written as such; repeated rows repeat their result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.tables import by_key, row_key, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, UNIGRAM, BPE, NORMAL, UNKNOWN, USER, UNUSED, BYTE = "▁", 1, 2, 1, 2, 4, 5, 6
GIANT, CHUNK, BLOCK = 1 << 16, 1 << 14, 256
LIMIT = 1 << 21
OUT_DDL = "n_tokens long, ids array<int>, round_trip boolean"
#: A boundary state is "over:piece", a piece that ends ``over`` characters after the boundary ("over:" for unigram models and at the start).
Matrix = dict[str, dict[str, float]]
START = "0:"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a serialized message."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and kind of a model file, and the library's processor for it."""

    def __init__(self, data: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.kind, self.score, self.id, self.byte, self.unknown = UNIGRAM, {}, {}, {}, 0
        number = 0
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                piece, kind = own[1].decode(), own.get(3, NORMAL)
                if kind in (NORMAL, USER, UNUSED):
                    self.id[piece], self.score[piece] = number, struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0]
                elif kind == BYTE:
                    self.byte[int(piece[3:5], 16)] = number
                elif kind == UNKNOWN:
                    self.unknown = number
                number += 1
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
        self.longest = max(map(len, self.id), default=1)
        self.words = all(SPACE not in p.lstrip(SPACE) for p in self.id)  # no piece crosses into a next word
        self.low = min(self.score.values(), default=0.0) - 10
        self._merged = lru_cache(1 << 20)(self._merge)
        self.beside = lru_cache(1 << 20)(self._beside)

    def normal(self, text: str) -> str:
        return self.library.normalize(text)

    def plain(self, normal: str) -> str:
        """Normalised text with its spaces as such and without the mark that normalisation put in front."""
        return normal.removeprefix(SPACE).replace(SPACE, " ")

    def _merge(self, text: str) -> tuple[str, ...]:
        """BPE of a short text."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return tuple(parts)
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _beside(self, a: str, b: str) -> bool:
        return self.kind != BPE or self._merged(a + b) == (a, b)

    def starts(self, text: str, i: int) -> Iterator[tuple[str, float]]:
        """Pieces from position ``i``, with weights; a character that is no piece stands for itself."""
        whole = False
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            p = text[i:j]
            if p in self.score and (self.kind != BPE or self._merged(p) == (p,)):
                whole |= j == i + 1
                yield p, 0.0 if self.kind == BPE else self.score[p]
        if not whole:
            yield text[i], 0.0 if self.kind == BPE else self.low

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids; characters that are no piece become their bytes, or one unknown for a run."""
        out: list[int] = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            elif self.byte:
                out += [self.byte[x] for x in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def middle(self, normal: str) -> list[int]:
        """Ids of a stretch that starts and ends where all paths meet."""
        return self.library.encode(self.plain(normal)) if normal else []


@lru_cache
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def meets(model: Model, text: str, low: int, high: int) -> list[int]:
    """First and last place in (low, high) where every path has a boundary: before a space mark that follows another character."""
    if not model.words:
        return []
    first = last = -1
    i = low
    while (i := text.find(SPACE, i + 1, high)) > 0:
        if text[i - 1] != SPACE:
            first = i
            break
    i = high
    while first >= 0 and (i := text.rfind(SPACE, low + 1, i)) > 0:
        if text[i - 1] != SPACE:
            last = i
            break
    return [] if first < 0 else [first, max(first, last)]


class Lattice:
    """Best paths over ``text[low:high]`` from entry states at ``low``; the text around belongs to other chunks.

    ``at[position][name]`` has one weight per entry state, and per entry the (position, name, piece) that the best path came from. Names
    are pieces for BPE models, one for all in unigram models.
    """

    def __init__(self, model: Model, text: str, low: int, high: int, entries: list[str], closed: bool):
        self.model, self.entries = model, entries
        self.at: dict[int, dict[str, tuple[np.ndarray, list]]] = {}
        for e, state in enumerate(entries):
            over, _, piece = state.partition(":")
            row = np.full(len(entries), -np.inf)
            row[e] = 0.0
            self._put(low + int(over), piece, row, None)
        for i in range(low, high):
            here = self.at.get(i)
            if not here:
                continue
            for piece, weight in model.starts(text, i):
                if closed and i + len(piece) > high:
                    continue
                for last, (row, _) in here.items():
                    if not last or model.beside(last, piece):
                        self._put(i + len(piece), piece if model.kind == BPE else "", row + weight, (i, last, piece))

    def _put(self, end: int, name: str, row: np.ndarray, back: tuple | None) -> None:
        states = self.at.setdefault(end, {})
        if name not in states:
            states[name] = (row, [back] * len(row))
            return
        old, backs = states[name]
        better = row > old
        states[name] = (np.where(better, row, old), [back if x else y for x, y in zip(better, backs)])

    def exits(self, high: int) -> dict[str, np.ndarray]:
        return {f"{p - high}:{name}": row for p, states in self.at.items() if p >= high for name, (row, _) in states.items()}

    def path(self, end: int, name: str, entry: int) -> list[str]:
        """Pieces of the best path from an entry state, whose own piece is left out."""
        out: list[str] = []
        while (back := self.at[end][name][1][entry]) is not None:
            end, name, piece = back
            out.append(piece)
        return out[::-1]


def entry_states(model: Model, text: str, low: int) -> list[str]:
    """Every state that the boundary before ``text[low]`` may have; at a document's start only one."""
    if low == 0:
        return [START]
    found = {f"{i + len(p) - low}:{p if model.kind == BPE else ''}" for i in range(max(0, low - model.longest), low) for p, _ in model.starts(text, i) if i + len(p) >= low}
    return sorted(found)


def transfer(model: Model, text: str, low: int, high: int) -> Matrix:
    """Best weight from every entry to every exit state of a chunk, up to one constant."""
    entries, cuts = entry_states(model, text, low), meets(model, text, low, high)
    if not cuts:
        exits = Lattice(model, text, low, high, entries, False).exits(high)
        return {e: {x: float(row[i]) for x, row in exits.items() if row[i] > -np.inf} for i, e in enumerate(entries)}
    head = Lattice(model, text, low, cuts[0], entries, True).at.get(cuts[0], {})
    tail = Lattice(model, text, cuts[1], high, [START], False).exits(high)
    best = np.max([row for row, _ in head.values()], axis=0) if head else np.full(len(entries), -np.inf)
    return {e: {x: float(best[i] + row[0]) for x, row in tail.items() if row[0] > -np.inf} for i, e in enumerate(entries) if best[i] > -np.inf}


def backtrace(model: Model, text: str, low: int, high: int, entry: str, exit: str) -> list[int]:
    """Ids of the pieces that start in a chunk, on the best path between two boundary states."""
    over, _, name = exit.partition(":")
    end, cuts = high + int(over), meets(model, text, low, high)
    if not cuts:
        return model.ids(Lattice(model, text, low, high, [entry], False).path(end, name, 0))
    head = Lattice(model, text, low, cuts[0], [entry], True)
    meet = max(head.at[cuts[0]], key=lambda n: head.at[cuts[0]][n][0][0])
    tail = Lattice(model, text, cuts[1], high, [START], False)
    return model.ids(head.path(cuts[0], meet, 0)) + model.middle(text[cuts[0] : cuts[1]]) + model.ids(tail.path(end, name, 0))


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for e, row in a.items():
        best: dict[str, float] = {}
        for m, w in row.items():
            for x, v in b.get(m, {}).items():
                if w + v > best.get(x, -np.inf):
                    best[x] = w + v
        if best:
            out[e] = best
    return out


def states_between(steps: list[Matrix], entry: str, exit: str | None) -> list[tuple[str, str]]:
    """(entry, exit) of every step on the best path; an open exit means the text's end, where no piece reaches over."""
    reach = [{entry: (0.0, "")}]
    for m in steps:
        row: dict[str, tuple[float, str]] = {}
        for e, (w, _) in reach[-1].items():
            for x, v in m.get(e, {}).items():
                if w + v > row.get(x, (-np.inf, ""))[0]:
                    row[x] = (w + v, e)
        reach.append(row)
    if exit is None:
        exit = max((x for x in reach[-1] if x.startswith("0:")), key=lambda x: reach[-1][x][0])
    path = [exit]
    for row in reach[:0:-1]:
        path.append(row[path[-1]][1])
    path.reverse()
    return list(zip(path, path[1:]))


MATRIX_DDL = "k long, n long, at long, left array<string>, right array<string>, weight array<double>"


def _matrix_rows(rows: list[tuple[int, int, int, Matrix]]) -> pa.RecordBatch:
    flat = [[(e, x, w) for e, row in m.items() for x, w in row.items()] for *_, m in rows]
    return pa.RecordBatch.from_pydict({
        "k": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "at": pa.array([r[2] for r in rows], pa.int64()),
        "left": pa.array([[t[0] for t in f] for f in flat], pa.list_(pa.string())), "right": pa.array([[t[1] for t in f] for f in flat], pa.list_(pa.string())),
        "weight": pa.array([[t[2] for t in f] for f in flat], pa.list_(pa.float64())),
    })


def _matrices(t: pa.Table) -> list[tuple[int, Matrix]]:
    """(place, matrix) in order of place."""
    out = []
    for at, left, right, weight in zip(*(t.column(c).to_pylist() for c in ("at", "left", "right", "weight"))):
        m: Matrix = {}
        for e, x, w in zip(left, right, weight):
            m.setdefault(e, {})[x] = w
        out.append((at, m))
    return sorted(out, key=lambda x: x[0])


def _scan(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """(k, ids) of giant texts (k, text), one row per k."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                normal = model.normal(text.as_py())
                n = max(1, -(-len(normal) // chunk))
                for c in range(n):
                    low, high = c * chunk, min(len(normal), (c + 1) * chunk)
                    back = min(low, 2 * model.longest)
                    yield pa.RecordBatch.from_pydict({
                        "k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "at": pa.array([c], pa.int64()), "low": pa.array([back], pa.int32()), "high": pa.array([back + high - low], pa.int32()),
                        "window": [normal[low - back : high + model.longest]],
                    })

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows = [(k, n, at, transfer(model, w, low, high)) for k, n, at, low, high, w in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield _matrix_rows(rows)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "key"):
            found = _matrices(t)
            total = found[0][1]
            for _, m in found[1:]:
                total = product(total, m)
            yield _matrix_rows([(t.column("k")[0].as_py(), t.column("n")[0].as_py(), found[0][0] // BLOCK, total)])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: its states, from one scan over a document's blocks (a text is below 2^31 bytes, so it has few)."""
        for t in by_key(batches, "k"):
            found = _matrices(t)
            pairs = states_between([m for _, m in found], START, None)
            yield pa.RecordBatch.from_pydict({"k": pa.array([t.column("k")[0].as_py()] * len(found), pa.int64()), "block": pa.array([at for at, _ in found], pa.int64()), "entry": [a for a, _ in pairs], "leave": [b for _, b in pairs]})

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "key"):
            found = _matrices(t)
            pairs = states_between([m for _, m in found], t.column("entry")[0].as_py(), t.column("leave")[0].as_py())
            yield pa.RecordBatch.from_pydict({"k": pa.array([t.column("k")[0].as_py()] * len(found), pa.int64()), "at": pa.array([at for at, _ in found], pa.int64()), "entry": [a for a, _ in pairs], "leave": [b for _, b in pairs]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                got = backtrace(model, r["window"], r["low"], r["high"], r["entry"], r["leave"])
                yield pa.RecordBatch.from_pydict({"k": pa.array([r["k"]], pa.int64()), "at": pa.array([r["at"]], pa.int64()), "ids": pa.array([got], pa.list_(pa.int32()))})

    chunks = stored(giants.mapInArrow(cut, "k long, n long, at long, low int, high int, window string").repartition("k", "at"))
    matrices = stored(chunks.mapInArrow(up, MATRIX_DDL))
    keyed = matrices.withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("key", F.xxhash64("k", "block"))
    blocks = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(multiply, MATRIX_DDL)
    states = blocks.repartition("k").sortWithinPartitions("k").mapInArrow(between, "k long, block long, entry string, leave string")
    states = keyed.join(states, ["k", "block"]).select("key", "k", "n", "at", "left", "right", "weight", "entry", "leave")
    states = states.repartition("key").sortWithinPartitions("key").mapInArrow(down, "k long, at long, entry string, leave string")
    ids = chunks.join(states, ["k", "at"]).select("k", "at", "low", "high", "window", "entry", "leave").mapInArrow(trace, "k long, at long, ids array<int>")
    return ids.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts")).select("k", F.flatten("parts.ids").alias("ids"))


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(size):
        j, total = i + 1, size[i]
        while j < len(size) and total + size[j] <= LIMIT:
            total, j = total + size[j], j + 1
        yield i, j
        i = j


def _encoded(path: str, names: list[str]):
    """Encode texts (or take given ids), decode, and compare with the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            column = pc.fill_null(batch.column(names.index("text")), "")
            for i, j in _slices(pc.binary_length(column).to_numpy()):
                texts = column.slice(i, j - i).to_pylist()
                ids = batch.column(names.index("ids")).slice(i, j - i).to_pylist() if "ids" in names else model.library.encode(texts, num_threads=1)
                back = model.library.decode(ids, num_threads=1)
                same = [b == t or b == model.plain(model.normal(t)) for b, t in zip(back, texts)]
                rest = [batch.column(c).slice(i, j - i) for c, name in enumerate(names) if name not in ("text", "ids")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=[*(c for c in names if c not in ("text", "ids")), "n_tokens", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) per row of ``docs`` (doc_id, text); ``round_trip``: the ids decode to the normalised text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {OUT_DDL}"
    text = docs.select("doc_id", "text")
    is_giant: Column = F.coalesce(F.length("text") > giant, F.lit(False))
    plain = text.where(~is_giant).mapInArrow(_encoded(path, ["doc_id", "text"]), schema)
    giants = stored(text.where(is_giant).withColumn("k", row_key("doc_id", "text")))
    ids = _scan(giants.select("k", "text").dropDuplicates(["k"]), path, chunk)
    long = giants.join(ids, "k").select("doc_id", "text", "ids").mapInArrow(_encoded(path, ["doc_id", "text", "ids"]), schema)
    return plain.unionByName(long)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` (ids) with the decoded text; null ids give null."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            ids = batch.column(names.index("ids"))
            for i, j in _slices(4 * pc.fill_null(pc.list_value_length(ids), 0).to_numpy()):
                texts = [None if x is None else model.library.decode(x) for x in ids.slice(i, j - i).to_pylist()]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names) + ", decoded string"
    return encoded.select(*names).mapInArrow(run, schema)


def op2_sentencepiece(docs: DataFrame) -> DataFrame:
    return encode(docs)
