"""The training-data operators against brute force, exact round trips and held-out accuracy, with the defined odd cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tollgauge.llm import archives, features, jaccard, language, mixing, neighbours, outliers, pieces, quality, substrings, surrogates
from tollgauge.llm.queries import ORACLES, QUERIES
from tollgauge.llm.tables import shared_folder, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(map(str, range(60)))
#: Nulls, blanks, repeated rows, copies under other ids, a very long text, a clashing extra column.
ODD = [(1, None, None, "a"), (1, None, None, "a"), (None, LONG, "en", None), (None, LONG, "en", None), (3, "", "fr", "b"), (4, " \n ", "fr", "b"), (5, "a b", "en", "b"), (6, "a b", None, "b"), (7, "x " * 30000, "en", "b"), (8, " ".join(map(str, range(9, 70))), "de", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("k", F.lit(7)).withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def removed(rows, w=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(x[j : j + w]) for _, x in words for j in range(len(x) - w + 1))
    out = []
    for i, x in words:
        gone = {q for j in range(len(x) - w + 1) if count[tuple(x[j : j + w])] > 1 for q in range(j, j + w)}
        out.append((i, len(x), len(gone), hashlib.sha256(" ".join(a for q, a in enumerate(x) if q not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_cover_covers_all_differences():
    for v in (1, 7, 13, 21):
        d = substrings.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("period", [1, 21, 35])
def test_substrings_equal_brute_force(odd, docs, period):
    for frame in (odd, odd.limit(0), docs):
        got = substrings.remove_repeats(frame, period=period).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
        assert found(got) == removed(texts(frame))


def similar(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    low = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, low.get(r), m) for (i, _), r, m in zip(rows, root, links)), key=str)


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_equals_all_pairs(odd, docs, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    for frame in (odd, odd.limit(0), docs):
        assert found(jaccard.op5_ngram_jaccard(frame)) == similar(texts(frame))


def test_many_pairs_verify_like_few():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    want = [len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j)]
    assert list(jaccard._verify(sets, sets, i, j, 0.5)) == want


def test_keep_one_of_each_class(odd):
    assert Counter(r.doc_id for r in jaccard.keep_one(odd).collect()) == Counter({None: 0, 8: 1, 1: 2, 3: 1, 4: 1, 5: 1, 7: 1}) | Counter({None: 1})


def test_languages_on_held_out_rows(spark, odd):
    got = language.op3_language_id(table(spark, "/root/testdata/sf0.01", "documents")).join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.op3_language_id(odd).collect()}
    assert plain[1] == plain[3] == plain[4] == ("und", 0.0)
    assert language.op3_language_id(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language.op3_language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_samples_are_bounded_for_copies(spark):
    copies = spark.range(2000).select("id", F.lit("a b c").alias("text"), F.lit("en").alias("tag"))
    assert features.sampled(copies, "language", 1.0).count() == 1
    own = spark.range(2000).select(F.col("id").cast("string").alias("text"), F.lit("en").alias("tag"))
    assert 140 < features.sampled(own, "language", 0.1).count() < 260


def test_codewords_differ():
    for k in (2, 4, 7, 12):
        c = language.codewords(k)
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= (1 if k < 4 else 3)


def test_quality_on_held_out_rows(spark, odd):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    got = quality.op1_pu_quality(table(spark, folder, "documents"), labels).join(labels, "doc_id").where("held_out").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    share = {r.quality: r.p for r in got}
    assert share[1] > 0.98 and share[0] < 0.2
    few = spark.createDataFrame([(5, 1), (5, None), (None, 0), (6, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in quality.op1_pu_quality(odd, few).collect())
    assert quality.op1_pu_quality(odd.limit(0), few).count() == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, 5000)
    u = np.concatenate([rng.normal(2, 1, 3500), rng.normal(-2, 1, 1500)])
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.05


def mixed(rows, out):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
    weight, budget, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(size.values()), {}, list(names)
    while left:
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in full} if full else share
        left = [s for s in left if s in full] and [s for s in left if s not in full]
    order = []
    for s in names:
        upto = 0
        own = sorted((r for r in out if r.source == s and r.size), key=lambda r: (r.place, r.nth))
        for _ in range(3):
            for r in own:
                upto += r.size
                order.append((upto / target[s], s or "", s is None, r.place, r.nth, r))
    taken, total = Counter(), 0
    for x in sorted(order, key=lambda x: x[:5]):
        if x[0] > 2:
            continue
        total += x[5].size
        if total > budget * (1 + 1e-6):
            break
        taken[x[1:5]] += 1
    return target, {(r.source or "", r.source is None, r.place, r.nth): taken[(r.source or "", r.source is None, r.place, r.nth)] for r in out}


@pytest.mark.parametrize("bucket", [4096, 5])
def test_mix_equals_one_queue(odd, docs, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", bucket)
    for frame in (odd, docs):
        out = mixing.mix(frame).collect()
        target, taken = mixed([tuple(r) for r in frame.select("doc_id", "text", "source").collect()], out)
        assert Counter(r.size for r in out) == Counter(len(WORD.findall(t or "")) for _, t in texts(frame))
        assert all(abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) for r in out)
        assert {(r.source or "", r.source is None, r.place, r.nth): r.copies for r in out} == taken
    assert mixing.op4_fair_mix(odd.limit(0)).count() == 0
    assert found(mixing.op4_fair_mix(docs)) == found(mixing.op4_fair_mix(docs.repartition(5)))


def base(t):
    t = t or ""
    w, lines, again = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {q for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for q in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_outlier_base_equals_brute_force(odd, docs):
    for frame in (odd, odd.limit(0), docs):
        got = outliers.op6_robust_outliers(frame)
        assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(((i, *base(t)) for i, t in texts(frame)), key=str)
        assert not got.where("base_failed AND kept").count()


def test_outliers_leave_good_texts(spark):
    folder = "/root/testdata/sf0.1"
    got = outliers.op6_robust_outliers(table(spark, folder, "documents")).where("NOT base_failed").join(table(spark, folder, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p")).collect()
    share = {r.quality: r.p for r in got}
    assert share[1] > 0.98 and share[0] < 0.1


def test_surrogates(spark, odd):
    text = "Mr. John Smith met Mrs. Anna Smith; Mr. Smith left. г-жа Анна Петрова. JOHN@Example.com john@example.com +1 (017) 555-7713 or +10175557713, 4111 1111 1111 1111 = 4111111111111111, 10.2.3.4 v1.2.3"
    frame = spark.createDataFrame([(1, text), (2, "again john@example.com, year 2024"), (2, "again john@example.com, year 2024")], "doc_id long, text string")
    one, *two = (r.text for r in surrogates.replace_entities(frame).orderBy("doc_id").collect())
    mail = re.search(r"(\w+@\w+\.com) ", one)[1].lower()
    assert all(t == f"again {mail}, year 2024" for t in two) and "john" not in one.lower() and one.count(mail.upper()) + one.count(mail) >= 1
    last = re.search(r"Mr\. \w+ (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+)", one)
    assert last[1] == last[3] == last[4] and last[2].endswith("na") and re.search(r"г-жа [А-Я]\w+на [А-Я]\w+\.", one) and one.endswith(" v1.2.3")
    card = re.search(r"(\d{4} \d{4} \d{4} \d{4}) = (\d{16})", one)
    luhn = lambda d: sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(d)) % 10
    assert card[1].replace(" ", "") == card[2] and luhn(card[2]) == luhn("4111111111111111") == 0
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10})", one)
    assert phone[1] + phone[2] + phone[3] == phone[4] != "0175557713"
    assert found(surrogates.replace_entities(odd).select("doc_id", "text")) == sorted(texts(odd), key=str)
    assert surrogates.replace_entities(odd.limit(0)).count() == 0


def test_names_are_replaced_in_their_whole_document(spark):
    rows = [
        (1, "Mr. John Smith called. John said SMITH's car is old, Smith left; a smith and Johnson stay. Ms. Anna Smith-Jones's dog: Jones. john.smith@a.org"),
        (2, "John Smith has no title here."),
        (3, "John waited. Then г-н Петров came; ПЕТРОВ saw Mr. O'Brien, O'Brien’s hat and Mr. Strauss' hat, Strauss"),
    ]
    one, two, three = (r.text for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())
    m = re.fullmatch(r"Mr\. (\w+) (\w+) called\. (\w+) said (\w+)'s car is old, (\w+) left; a smith and Johnson stay\. Ms\. (\w+) (\w+)-(\w+)'s dog: (\w+)\. \S+@\w\.org", one)
    given, last = m[1], m[2]
    assert m[3] == given != "John" and m[4] == last.upper() != "SMITH" and m[5] == m[7] == last and m[8] == m[9] != "Jones"
    assert two == rows[1][1]
    m = re.fullmatch(r"John waited\. Then г-н (\w+) came; (\w+) saw Mr\. (\w+), (\w+)’s hat and Mr\. (\w+)' hat, (\w+)", three)
    assert m[2] == m[1].upper() != "ПЕТРОВ" and m[3] == m[4] and m[5] == m[6] != "Strauss"


def test_taken_surrogates_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "surrogate", lambda key, kind, canon, attempt: F.format_string("%d", F.pmod(F.xxhash64("canon", "attempt"), F.lit(12))))
    monkeypatch.setattr(surrogates, "ROUNDS", 400)
    entities = spark.createDataFrame([("ip", str(i)) for i in range(5)], "kind string, canon string")
    own = {r.own for r in surrogates.draw(entities, "x").collect()}
    assert len(own) == 5 and not own & {str(i) for i in range(5)}


def test_cards_in_any_long_groups(spark):
    cards = ["6304-0000-0000-0000-123", "4222 222 222 222", "41111111 11111111", "6304 0000 0000 0000 123", "4111 1111 1111 1111", "4111111111111111", "12 4222 222 222 222"]
    runs = ["12 15 18 22 31 45 60 71 88", "978-3-16-148410-0", "1234 5 6 7 8 9 10 11 12", "2024-01-02 2024-01-03", "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    rows = spark.createDataFrame([(i, f"so {x}, yes") for i, x in enumerate(cards + runs)], "doc_id int, text string")
    got = [r.text for r in surrogates.replace_entities(rows).orderBy("doc_id").collect()]
    for was, now in zip(cards, got):
        assert re.sub(r"\d", "0", now) == re.sub(r"\d", "0", f"so {was}, yes")
        assert not set(re.findall(r"\d{3,}", was)[-1:]) & set(re.findall(r"\d{3,}", now)[-1:])
    assert got[len(cards) :] == [f"so {x}, yes" for x in runs]


def test_crowded_forms_are_all_placed(spark):
    crowded = [("phone+", f"20{i:03d}") for i in range(600)] + [("phone+", f"33{i:02d}") for i in range(0, 100, 3)]  # over half of the values real; a third
    full = [("secret", f"--------{i}") for i in range(10)] + [("secret", "=========="), ("email", "a@b.org"), ("email", "b@b.org")]
    cards = [("card", c) for c in ("4111111111111111", "4222222222222")]
    rows = crowded + full + cards
    got = {(r.kind, r.canon): r.own for r in surrogates.draw(spark.createDataFrame(rows, "kind string, canon string"), "x").collect()}
    assert set(got) == set(rows) and len({(k, own) for (k, _), own in got.items()}) == len(rows)
    assert [c for (_, c), own in got.items() if own == c] == ["=========="]
    egypt = {own for (_, c), own in got.items() if c[:2] == "20"}
    assert all(re.fullmatch(r"20\d{3}", own) for own in egypt) and len(egypt - {c for _, c in crowded}) == 400
    assert not {own for (_, c), own in got.items() if c[:2] == "33"} & {c for _, c in crowded}
    assert {own for (k, c), own in got.items() if c.startswith("---")} == {c for _, c in full[:10]}


def test_name_surrogates_grow(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", {k: v[:2] for k, v in surrogates.SYLLABLES.items()})
    monkeypatch.setattr(surrogates, "ROUNDS", 1)
    rows = [("name:latin:m", f"name{i}") for i in range(50)]  # 2 syllables: 8 names of three
    got = {r.canon: r.own for r in surrogates.draw(spark.createDataFrame(rows, "kind string, canon string"), "x").collect()}
    assert len(got) == 50 and len(set(got.values())) == 50 and not set(got) & set(got.values())


def test_archives_round_trip(spark):
    big = "é" * 700
    rows = [(1, None, None), (2, "u\r\nx", big), (3, "http://a", big), (3, "http://a", big), (None, None, big), (None, None, "z" * 2000), (None, None, "z" * 2000), (5, "v", "a\r\n\r\nb"), (6, "", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for frame, roll in ((pages, 1 << 20), (pages, 10), (pages.limit(0), 10), (table(spark, DATA, "pages"), 50_000)):
        folder = shared_folder(spark)
        manifest = archives.write_archives(frame, folder, roll=roll)
        got = {(r.page_id, r.record_type, r.refers_to): r for r in archives.read_archives(manifest, folder).collect()}
        data = [(r.page_id, (r.html or "").encode()) for r in frame.collect()]
        top = {}
        for i, b in data:
            if len(b) >= 1000 and i is not None:
                top[b] = max(i, top.get(b, i))
        for i, b in data:
            refers = top.get(b) if top.get(b, i) != i else None
            r = got[(i, "response" if refers is None else "revisit", refers)]
            assert r.payload_digest in {hashlib.sha1(x).hexdigest() for j, x in data if j == i} and (refers is not None or bytes(r.payload) in {x for j, x in data if j == i})
        assert sum(r.records for r in manifest.collect()) == len(data)


def test_every_record_is_a_frame_of_its_own():
    import struct

    import zstandard

    parts = [f"record {i} ".encode() * 20 for i in range(300)]
    data = archives.archive(parts, 4096, 3)
    magic, size = struct.unpack_from("<II", data)
    assert magic == archives.SKIPPABLE
    d, rest, n = zstandard.ZstdCompressionDict(data[8 : 8 + size]), data[8 + size :], 0
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        assert frame.decompress(rest) == parts[n]
        rest, n = frame.unused_data, n + 1
    assert n == len(parts)


def test_neighbours_recall_and_odd_rows(spark):
    v = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = v.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in neighbours.search(v, F.col("vec_id") % 10 == 0, block_rows=200, query_rows=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for q in np.flatnonzero(ids % 10 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if i != q][:10]
        own = got[ids[q]]
        assert sorted(own) == list(range(1, 11)) and [own[r] for r in sorted(own)] == sorted(own.values(), key=lambda t: (t[1], t[0]))
        hit += len({i for i, _ in own.values()} & set(ids[best].tolist()))
    assert hit / 10 / len(got) >= 0.95
    odd = spark.createDataFrame([(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (200, []), (300, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.op10_collision_neighbours(odd).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 1), (100, 2, 2), (100, 3, 2), (100, 4, 300), (300, 1, 1), (300, 2, 2), (300, 3, 2), (300, 4, 100)]
    assert neighbours.op10_collision_neighbours(odd.limit(0)).count() == 0


def test_pieces_equal_the_library(spark, odd, docs, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 4)
    model = pieces.load(pieces.MODEL)
    for frame in (odd, odd.limit(0), docs):
        got = pieces.encode(frame, giant=1500, chunk=200).collect()
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(i), tuple(model.library.encode(t or ""))) for i, t in texts(frame))
        assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs)).collect()}
    assert all(back[i] == t for i, t in texts(docs))


def test_scan_without_meeting_places():
    model = pieces.load(pieces.MODEL)
    rng = np.random.default_rng(4)
    for text in ("a" * 700, "日本" * 150, "hello" * 99, " " * 250, "".join(rng.choice(list("abehinot\n_é😀"), 600))):
        normal, spans, steps = model.normal(text), [], []
        for low in range(0, len(normal), 40):
            back = min(low, 32)
            spans.append((normal[low - back : low + 40 + 16], back, back + len(normal[low : low + 40])))
            steps.append(pieces.transfer(model, *spans[-1]))
        states = pieces.states_between(steps, pieces.START, None)
        assert [i for s, (a, b) in zip(spans, states) for i in pieces.backtrace(model, *s, a, b)] == model.library.encode(text)
        left = pieces.product(pieces.product(steps[0], steps[1]), steps[2])
        assert left == pieces.product(steps[0], pieces.product(steps[1], steps[2]))


def test_check_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, DATA)
        rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert found(got) == sorted(rows, key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs, ids = table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA)
        if name != "pieces":
            assert docs.columns == corpus_pipeline.COLUMNS
        ids[name] = Counter(r.doc_id for r in docs.collect())
        assert set(ids[name]) <= set(r.doc_id for r in before.select("doc_id").collect())
    assert set(ids["near_duplicates"].values()) == {1} and ids["pii"] == ids["near_duplicates"] and ids["pieces"] == ids["mixture"] and max(ids["mixture"].values()) <= 3


def test_short_texts_are_read_in_bounded_slices():
    import pyarrow as pa

    sizes = []
    for i, j, x in features.rows_of(pa.array(["ab cd"] * 1000 + [None] + ["z" * features.SLICE * 2] + ["q"] * 300), features.language_features):
        sizes.append((i, j))
        assert j - i <= features.SLICE_ROWS and len(x) == j - i
    assert sizes[0][0] == 0 and sizes[-1][1] == 1302 and all(a[1] == b[0] for a, b in zip(sizes, sizes[1:]))
    assert not list(features.rows_of(pa.array([], pa.string()), features.quality_features))


def test_places_of_repeated_rows_are_kept_once(spark):
    words = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(None, words)] * 3000 + [(1, "a b c"), (2, words + " tail")], "doc_id long, text string")
    got = substrings.remove_repeats(frame)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == {(None, 60, 60, ""), (1, 3, 0, "a b c"), (2, 61, 60, "tail")}
    assert got.count() == 3002
    k, p = substrings._distinct(np.array([2, 1, 2, 2, 1]), np.array([5, 3, 5, 4, 3]))
    assert k.tolist() == [1, 2, 2] and p.tolist() == [3, 4, 5]


def test_repeated_rows_travel_once_to_the_cells(spark):
    words = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(None, words)] * 2000 + [(1, words + " x"), (2, "other words here")], "doc_id long, text string")
    out = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.op5_ngram_jaccard(frame).collect()}
    assert out == {(None, 1, 2000), (1, 1, 2000), (2, 2, 0)}
