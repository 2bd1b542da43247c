"""Mentions, pattern hits and page runs on long, broken and crowded texts."""

import datetime as dt
import random
import time
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tollgauge.functions import text as T
from tollgauge.operators import extract as X
from tollgauge.operators import mentions as M
from tollgauge.plans.crawl import process_pages
from tests.test_text import claim_by_hand

NAMES = [(1, "a b"), (2, "a"), (3, "a-b"), (4, "b a b"), (5, "a b a"), (6, "c3"), (7, "x_y"), (8, "B. a"), (9, "a"), (10, "ΑΣ"), (11, "é")]


def frame(spark, names):
    return spark.createDataFrame([(m, n, m) for m, n in names], "model_id bigint, display_name string, ord bigint")


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "a-b", "c3", "é", "x_y", "A", "B.", "αΣ", "ας"]
    return ["".join(rng.choice(words) + rng.choice([" ", "-", ". ", ", ", ""]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("limit", [M.TRIE_BYTES, 40])
def test_claims_with_one_trie_and_with_several(spark, limit):
    """A name table beyond the limit is dealt to several tries; claims stay the same."""
    rows = list(enumerate(texts_of(11, 80)))
    docs = spark.createDataFrame(rows, "k int, text string")
    found = X.exploded(docs, ["k"], M.hits(frame(spark, NAMES), F.col("text"), trie_bytes=limit), "m").select("k", "m.*").collect()
    got = {}
    for r in found:
        got.setdefault(r.k, []).append((r.model_id, r.raw, r.pos))
    for k, text in rows:
        want = [w for w in claim_by_hand(text, [n for n in NAMES if n[0] != 10])]
        assert sorted(x for x in got.get(k, []) if x[0] != 10) == [w for w in want if not any(a[0] == 10 and a[2] <= w[2] < a[2] + 2 for a in got.get(k, []))], text


def test_mentions_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, "a b")], "k int, text string")
    plan = M.mentions(docs, frame(spark, NAMES), "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_long_document_in_linear_time(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "b", "longer", "words", "c3"]) for _ in range(2_500_000))
    trie = M.Trie([(m, n, m) for m, n in NAMES])
    start = time.time()
    half = sum(1 for _ in trie.places(text[: len(text) // 2]))
    first = time.time() - start
    whole = sum(1 for _ in trie.places(text))
    assert whole > half > 500_000 and time.time() - start < 4 * first + 5
    assert M._taken([(i, i + 3, (1, "a a", 1)) for i in range(0, 100_000, 2)])[:2] == [(0, 3, (1, "a a", 1)), (4, 7, (1, "a a", 1))]


def test_mentions_of_null_and_marked_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\u0001a\u0001 b")], "k int, text string")
    got = M.mentions(docs, frame(spark, NAMES), "k", "text").collect()
    assert [(r.k, r.raw, r.pos) for r in got] == [(3, "a b", 0)]
    assert M.mentions(docs, frame(spark, NAMES).where("false"), "k", "text").count() == 0


def test_pattern_hits_over_many_runs(spark):
    """Offsets across the runs of pieces that folds work on."""
    rng = random.Random(2)
    text = "".join(rng.choice(["$5", " é ", "x", "$", "$7"]) for _ in range(6000))
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(T.pattern_hits(F.col("t"), r"\$\d", 2), lambda h: F.struct(h["pos"], h["raw"])).alias("h")).first().h
    want = [(i, text[i : i + 2]) for i in range(len(text) - 1) if text[i] == "$" and text[i + 1].isdigit()]
    assert [tuple(x) for x in got] == want and len(want) > T.RUN


def test_first_of_each_keeps_order(spark):
    items = [("b", 1), ("a", 2), ("b", 3), (None, 4), ("a", 5), (None, 6), ("c", 7)]
    df = spark.createDataFrame([(items,), ([],), ([("z", 1)],)], "x array<struct<k:string,v:int>>")
    got = [[(y.k, y.v) for y in r.o] for r in df.select(X._first_of_each(F.col("x"), lambda y: y["k"]).alias("o")).collect()]
    assert got == [[("b", 1), ("a", 2), (None, 4), ("c", 7)], [], [("z", 1)]]


def test_broken_pages_count_as_errors_and_the_run_goes_on(spark):
    when = dt.datetime(2026, 6, 1)
    rows = [(f"k{i}", "acme", f"u{i}", "pricing", html, when, ok) for i, (html, ok) in enumerate([(b"<p>Acme: $20/mo</p>", True), (None, True), (b"\xff\xfe bad", True), (b"x", False), (b"no price", None)])]
    raw = spark.createDataFrame(rows, "page_key string, provider_id string, source_url string, page_type string, body binary, observed_at timestamp_ntz, allowed boolean")
    # a cast keeps the bytes as they are, valid or not
    pages = raw.withColumn("html", F.col("body").cast("string")).drop("body")
    empty = spark.createDataFrame([], "provider_id string, source_url string, observed_at timestamp_ntz, snapshot_id int, content_hash string")
    run = process_pages(pages, empty, spark.createDataFrame([(1, "Acme", 1)], "model_id bigint, display_name string, ord bigint"))
    assert run.counters == {"processed": 3, "skipped": 2, "errors": 2, "changed": 1, "prices": 1, "limits": 0, "mentions": 1}
    assert [r.page_key for r in run.snapshots.collect()] == ["k0"] and run.prices.count() == 1


@pytest.mark.parametrize("limit", [M.TRIE_BYTES, 40])
def test_places_leave_a_task_in_small_batches(spark, limit, monkeypatch):
    """A task holds the hits of some texts at most, whatever an Arrow batch holds; every place still comes."""
    rows = list(enumerate(texts_of(3, 60)))
    docs = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    want = sorted((k, n[0], a, text[a:b]) for k, text in rows for a, b, n in M.Trie([(m, n, m) for m, n in NAMES]).places(text))
    found = M.candidates(docs, frame(spark, NAMES), "k", "text", trie_bytes=limit)
    assert sorted((r.k, r.model_id, r.pos, r.raw) for r in found.collect()) == want and len(want) > 300

    monkeypatch.setattr(M, "PLACE_ROWS", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["k", "text"])
    names = SimpleNamespace(value=[(m, n, m) for m, n in NAMES])
    parts = list(M._place_rows(names, ["k", "model_id", "display_name", "ord", "pos", "raw"])(iter([batch])))
    assert max(p.num_rows for p in parts) == 7 and sum(p.num_rows for p in parts) == len(want)
    texts = batch.column(1)
    slices = list(M._slices(texts, pa.compute.binary_length(texts), 300))
    assert pa.concat_arrays(slices) == texts and all(len(s) == 1 or sum(len(t.as_py().encode()) for t in s) <= 300 for s in slices)


def test_claims_keep_one_name_of_a_spelling():
    """Names of one spelling claim the same places, so claims look for the first of them only."""
    names = [(i, n, (i * 7) % 50) for i, n in enumerate(["a b", "a", "A", "b a b"] * 12)]
    for text in texts_of(8, 40):
        want = M._taken(list(M.Trie(names).places(text)))
        few = list(M.Trie(names, claims=True).places(text))
        assert M._taken(list(few)) == want and len(few) <= 3 * len(text)
    assert len(list(M.Trie(names, claims=True).places("a"))) == 1
