"""Known-name mentions in text: longest name claims its characters first.

Names become a trie over the pieces that word boundaries cut them into. One linear pass over a text walks the trie from every piece
and yields places, so a text never leaves its row: no exchange holds it. The trie travels to the tasks only while the names' size
allows it; a larger name table is dealt by first piece to several tries, each of bounded size, and a row's hits are joined up again
before claims are settled. Both steps run in the row, over slices of an Arrow batch, so a task holds the hits of one slice and not of
ten thousand texts. Unsettled places are rows of their own and leave the task while a text is still being walked.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tollgauge.functions.text import MARK, squeeze
from tollgauge.operators.extract import exploded

# A match that starts and ends at a word boundary always covers whole word / non-word segments, so
# a name can only sit where the same consecutive segments spell it out.
_SEGMENT = re.compile("[A-Za-z0-9_]+|[^A-Za-z0-9_]+")
_EDGE = re.compile("[A-Za-z0-9_]")
# The Kelvin sign and the dotted capital I are the only letters whose lower form has an ASCII letter in it. They are put out of the
# way first, so lower-case text is cut at the same places as the text itself; both lower forms of sigma are one letter.
_FOLD = {0x212A: 0xE000, 0x130: 0xE001}
#: Bytes of names in one trie.
TRIE_BYTES = 8 << 20
#: Bytes of text whose hits a task holds at once (one text at least), and places that leave it or are settled together.
SLICE_BYTES = 1 << 18
PLACE_ROWS = 1 << 14
HITS = "array<struct<model_id:long,display_name:string,ord:long,pos:int,raw:string,around:string,before:boolean,after:boolean>>"
_HITS = pa.list_(
    pa.struct(
        [("model_id", pa.int64()), ("display_name", pa.string()), ("ord", pa.int64()), ("pos", pa.int32()), ("raw", pa.string()), ("around", pa.string()), ("before", pa.bool_()), ("after", pa.bool_())]
    )
)


def folded(text: str) -> str:
    """Lower case of the same length, cut into segments at the same places."""
    return text.lower() if text.isascii() else text.translate(_FOLD).lower().replace("ς", "σ")


class Trie:
    """Names by their segments. A node is (children by segment, names that end here).

    For claims one name of each spelling is enough: the first in catalog order takes what any other of them could.
    """

    def __init__(self, names: list[tuple[int, str, int]], claims: bool = False):
        self.root: tuple[dict, list] = ({}, [])
        for model_id, name, ord_ in names:
            node = self.root
            for segment in _SEGMENT.findall(folded(name)):
                node = node[0].setdefault(segment, ({}, []))
            own = node[1]
            if claims and own and ord_ is not None and own[0][2] is not None:
                if ord_ < own[0][2]:
                    own[0] = (model_id, name, ord_)
            else:
                own.append((model_id, name, ord_))

    def places(self, text: str) -> Iterator[tuple[int, int, tuple]]:
        """(start, end, name) of every occurrence between word boundaries, by start."""
        low = folded(text)
        cuts = [m.start() for m in _SEGMENT.finditer(low)] + [len(low)]
        first = self.root[0]
        # the edge of a text is a boundary only beside a word character
        begin, end = (bool(low) and _EDGE.match(low[at]) is not None for at in (0, -1))
        for i in range(0 if begin else 1, len(cuts) - 1):
            node, j = first.get(low[cuts[i] : cuts[i + 1]]), i + 1
            while node is not None:
                if end or j + 1 < len(cuts):
                    for name in node[1]:
                        yield cuts[i], cuts[j], name
                if j + 1 >= len(cuts) or not node[0]:
                    break
                node, j = node[0].get(low[cuts[j] : cuts[j + 1]]), j + 1


def _taken(hits: list[tuple]) -> list[tuple]:
    """Claims among (start, end, name): longest names first, then catalog order, each searched left to right.

    A search moves past every hit of its name, claimed or not; a hit that touches claimed characters claims nothing.
    """
    hits.sort(key=lambda h: (-len(h[2][1]), h[2][2], h[0]))
    starts: list[int] = []
    ends: list[int] = []
    out, name, scanned = [], None, 0
    for start, end, own in hits:
        if own[2] == name and start < scanned:
            continue
        name, scanned = own[2], end
        at = bisect_right(starts, start)
        if (at and ends[at - 1] > start) or (at < len(starts) and starts[at] < end):
            continue
        starts.insert(at, start)
        ends.insert(at, end)
        out.append((start, end, own))
    return out


def _slices(rows: pa.Array, sizes: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Neighbouring rows whose sizes add up to ``limit`` at most, or one row."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i, before = 0, 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield rows.slice(i, j - i)
        i, before = j, int(ends[j - 1])


def _plain(text: pa.Scalar) -> str:
    return (text.as_py() or "").replace(MARK, "")


def _scan(names: Broadcast, settle: bool, context: int, claims: bool):
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(names.value, claims)
        for texts in (part for batch in batches for part in _slices(batch, pc.binary_length(batch), SLICE_BYTES)):
            found = []
            for text in map(_plain, texts):
                hits = trie.places(text)
                found.append(
                    [
                        (*name, a, text[a:b], text[max(0, a - context) : b + context], a > context, b + context < len(text))
                        for a, b, name in (_taken(list(hits)) if settle else hits)
                    ]
                )
            yield _column(found)

    return F.arrow_udf(scan, HITS)


def _place_rows(names: Broadcast, columns: list[str]):
    """Rows (key, model_id, display_name, ord, pos, raw) of all places, some thousand at once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(names.value)
        for batch in batches:
            places = ((i, *name, a, text[a:b]) for i, text in enumerate(map(_plain, batch.column(1))) for a, b, name in trie.places(text))
            while some := list(islice(places, PLACE_ROWS)):
                at, *own = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(own, list(_HITS.value_type)))], names=columns
                )

    return rows


def _column(found: list[list[tuple]]) -> pa.Array:
    fields = list(_HITS.value_type)
    flat = list(zip(*(hit for hits in found for hit in hits))) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), values)


def _settle(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in (part for batch in batches for part in _slices(batch, pc.list_value_length(batch), PLACE_ROWS)):
        found = []
        for hits in lists:
            rows = [tuple(h.values()) for h in hits.as_py()]
            found.append([h for _, _, (_, _, _, h) in _taken([(h[3], h[3] + len(h[4]), (h[0], h[1], h[2], h)) for h in rows])])
        yield _column(found)


def _shared(names: DataFrame, trie_bytes: int) -> list[Broadcast]:
    """The names of each trie. Reads the names to measure them; a table larger than ``trie_bytes`` becomes several."""
    known = names.where(F.length("display_name") > 0).select(F.col("model_id").cast("long"), "display_name", F.col("ord").cast("long"))
    size = known.agg(F.sum(F.octet_length("display_name") + 16)).first()[0] or 0
    parts = max(1, -(-size // trie_bytes))
    part = F.pmod(F.xxhash64("display_name"), F.lit(parts))
    share = known.sparkSession.sparkContext.broadcast
    return [share([tuple(r) for r in (known if parts == 1 else known.where(part == i)).collect()]) for i in range(parts)]


def hits(names: DataFrame, text: Column, settle: bool = True, context: int = 60, trie_bytes: int = TRIE_BYTES) -> Column:
    """Hits of ``names`` (model_id, display_name, ord = catalog order) in ``text``: claims, or all places if ``settle`` is off.

    Reads the names to measure them and to build the tries; a table larger than ``trie_bytes`` becomes several.
    """
    tries = _shared(names, trie_bytes)
    if len(tries) == 1:
        return _scan(tries[0], settle, context, settle)(text)
    found = F.concat(*[_scan(t, False, context, settle)(text) for t in tries])
    return F.arrow_udf(_settle, HITS)(found) if settle else found


def snippet(hit: Column) -> Column:
    """What stands around a hit, with an ellipsis where text is left out."""
    mark = lambda cut: F.when(cut, "…").otherwise("")
    return F.concat(mark(hit["before"]), squeeze(hit["around"]), mark(hit["after"]))


def candidates(docs: DataFrame, names: DataFrame, key: str, text: str, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Every place a name occurs between word boundaries, before any claims: key, model_id, display_name, ord, pos, raw."""
    kind = StructType.fromDDL("model_id long, display_name string, ord long, pos int, raw string")
    schema = StructType([docs.schema[key], *kind.fields])
    found = [docs.select(key, text).mapInArrow(_place_rows(t, schema.names), schema) for t in _shared(names, trie_bytes)]
    return reduce(DataFrame.unionAll, found)


def mentions(docs: DataFrame, names: DataFrame, key: str, text: str, context: int = 60) -> DataFrame:
    """Claimed mentions per document: model_id, display_name, raw, pos, snippet.

    ``docs`` has one row per ``key``; ``names`` has model_id, display_name and ``ord`` (catalog order). Nothing is shuffled.
    """
    return mention_rows(exploded(docs, [key], hits(names, F.col(text), context=context), "m"), [key])


def mention_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of one hit ``m`` per row."""
    return found.select(
        *keys, "m.model_id", "m.display_name", "m.raw", "m.pos", snippet(F.col("m")).alias("snippet"), F.lit("observed").alias("confidence")
    )
