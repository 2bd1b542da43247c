"""Surrogates: texts that patterns must survive, one name per person in a document, keys."""

from __future__ import annotations

import re
import time

from tollgauge.llm import surrogates


def replaced(spark, *texts, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replace_entities(rows, **how).orderBy("doc_id").collect()]


BIG, SOME = 1 << 20, 8000
#: Megabytes that nearly match a pattern, and texts of some kilobytes that are one long hit or very many.
HARD = {
    "letters": "g" * BIG, "dots": "a." * (BIG // 2), "dashes": "1-" * (BIG // 2), "signs": "@" * BIG, "addresses": "a@" * (BIG // 2), "labels": "x@" + "ab." * 100_000 + "1",
    "short labels": "x@" + "a." * 100_000, "capitals": "Gb" * (BIG // 2), "plus": "+1" * (BIG // 2), "percent": "%" * BIG, "hex": "0f" * (BIG // 2) + "g",
    "secret": "a" * SOME, "digits": "7" * SOME, "keys": "key=" * (SOME // 4), "fixed": "key=" + "-" * SOME, "tokens": "sk-" * (SOME // 3), "cards": "1234 " * (SOME // 5), "iban": "DE12" + "ABCD " * (SOME // 5),
}


def test_long_unbroken_texts_end_soon(spark):
    """Every pattern over megabytes that nearly match it, one text per task."""
    start = time.time()
    rows = spark.createDataFrame(list(enumerate(HARD.values())), "doc_id long, text string").repartition(len(HARD), "doc_id")
    got = {r.doc_id: r for r in surrogates.replace_entities(rows).selectExpr("doc_id", "length(text) AS n", "n_entities").collect()}
    assert time.time() - start < 120 and len(got) == len(HARD)
    for i, (name, text) in enumerate(HARD.items()):
        assert got[i].n == len(text), name


def test_address_forms(spark):
    text = "a.b+c%d@x.org ..x@y-z.co.uk @no x@ x@y x@y.z x@y.zz1 _@q.de x@a..com m@n.com.. m@n.org,o@p.org a@b.cc.d@e.ff -@x.org"
    hits = spark.createDataFrame([(text,)], "t string").selectExpr(f"regexp_extract_all(t, r\"{surrogates.PATTERNS[0]}\", 0) AS h").first().h
    assert hits == ["a.b+c%d@x.org", "..x@y-z.co.uk", "x@y.zz", "_@q.de", "m@n.com", "m@n.org", "o@p.org", "a@b.cc", ".d@e.ff"]
    plain = re.findall(r"[\w.+%-]*\w@\w[\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}", text)
    assert hits == plain
    assert replaced(spark, text)[0].count("@") == text.count("@")


def test_one_person_has_one_name_in_a_document(spark):
    text = "Dr. John Smith spoke. Later Mr. John Smith left. Prof. Anna came with Mrs. Anna Smith. John and Anna stayed."
    (got,) = replaced(spark, text)
    m = re.fullmatch(r"Dr\. (\w+) (\w+) spoke\. Later Mr\. (\w+) (\w+) left\. Prof\. (\w+) came with Mrs\. (\w+) (\w+)\. (\w+) and (\w+) stayed\.", got)
    john, smith = m[1], m[2]
    assert m[3] == m[8] == john != "John" and m[4] == m[7] == smith != "Smith" and m[5] == m[6] == m[9] != "Anna"
    assert john.endswith("n") and m[6].endswith("na")  # the gender that a title tells


def test_keys_change_surrogates(spark):
    text = "Mr. John Smith, john@example.com"
    one, two = replaced(spark, text)[0], replaced(spark, text, key="other")[0]
    assert one != two and replaced(spark, text)[0] == one
    spark.conf.set(surrogates.KEY_SETTING, "other")
    try:
        assert replaced(spark, text)[0] == two
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)
