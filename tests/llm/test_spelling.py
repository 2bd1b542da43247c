"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tollgauge.llm import spelling
from tollgauge.llm.tables import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every=199):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=5):
    words = sorted(n)
    found = {w: [] for w in words}
    for x, a in enumerate(words):
        for b in words[:x]:
            if abs(len(a) - len(b)) <= 1 and near(a, b):
                found[a].append(b)
                found[b].append(a)
    form = {}
    for w in words:
        best = min(found[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def some_words(seed, count, letters, longest):
    rng = np.random.default_rng(seed)
    own = {"".join(rng.choice(list(letters), rng.integers(1, longest))) for _ in range(count)}
    for w in list(own):
        at = int(rng.integers(0, len(w)))
        own |= {w[:at] + w[at + 1 :] or "a", w[:at] + rng.choice(list(letters)) + w[at:]}
    return {w: int(5 ** rng.integers(1, 8)) for w in own}


@pytest.mark.parametrize(("leaf", "most"), [(1, 3), (4, 100), (48, 20000)])
@pytest.mark.parametrize(("letters", "longest"), [("abcmny", 9), ("aeiounrstàÿ", 8), ("ab", 60)])
def test_pairs_equal_all_pairs(spark, leaf, most, letters, longest):
    n = some_words(leaf, 150, letters, longest)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.group_variants(words, most=most, leaf=leaf)) == brute(n)


def test_colliding_branches_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_prefix_key", lambda v: (v.sum(axis=1) % 2).astype(np.int64))
    monkeypatch.setattr(spelling, "depth", lambda words, most: 3)
    n = some_words(5, 150, "abcmny", 8)
    assert rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_long_words_are_verified_alike():
    base = "xyz" * 30
    words = [base, base + "a", "a" + base, base[:50] + "q" + base[51:], base[:50] + base[51:], base[:10] + "é" + base[10:], base + "ab", "short", "shört", "shor"]
    letters, offsets, _ = spelling.vectors_of(__import__("pyarrow").array(words))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert list(spelling.one_apart(letters, offsets, i, j)) == [near(words[a], words[b]) for a, b in zip(i, j)]


def test_chains_end_at_their_root(spark):
    chain = {"aaaaaaaaaa"[:k] + "b": 5 ** (k + 1) for k in range(1, 10)}
    assert rows_of(spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long"))) == brute(chain)


def test_documents_and_odd_rows(spark):
    docs = table(spark, DATA, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = {w: c for w, c in counted(rows).items() if len(w) >= 6 and c >= 5}
    assert rows_of(spelling.op13_spelling_trie(docs)) == brute(kept)
    odd = [(1, None), (None, "Strasse STRASSE straße Ärger ÄRGER"), (2, ""), (3, "12 !! \n"), (4, "wörter " * 30000), (4, "wörter " * 30000), (5, "x" * 200000 + " " + "x" * 200000)]
    odd += [(10 + i, "Variant variant varíant vaRiant vari ant") for i in range(20)]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = spelling.group_variants(spelling.count_words(frame, every=7, shortest=3, least=2))
    assert rows_of(got) == brute({w: c for w, c in counted(odd, 7).items() if len(w) >= 3 and c >= 2})
    assert spelling.op13_spelling_trie(frame.limit(0)).count() == 0
