"""Texts made to take long, and inputs that teach nothing: time grows with length, results stay defined."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, secrets, url_filter

N = 1_000_000
HOSTILE = {
    "nested brackets": 'a=("s",' * (N // 8) + ")" * (N // 8),
    "open brackets": 'a=("s",' * (N // 7),
    "newlines after a literal": 'x = "a"' + "\n" * N,
    "newlines between literals": ('x = "abc"' + "\n" * 50) * (N // 60),
    "brackets alone": "(" * (N // 2) + ")" * (N // 2),
    "one long word": "token=" + "a" * N,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_secrets_take_time_in_the_length(kind):
    began = time.process_time()
    secrets.find(HOSTILE[kind])
    assert time.process_time() - began < 60  # where it was hours


def test_literals_of_nested_brackets_flow_to_all_names_around():
    text = 'password = f(x, a = g("Zx81kLmnQ9pR2s7t"), b = "other words here"), c = h("Qw72jHgfD5sA9z0x")'
    found = {text[a:b] for a, b in secrets.literals(text)}
    assert "Zx81kLmnQ9pR2s7t" in found and "Qw72jHgfD5sA9z0x" not in found
    assert {text[a:b] for a, b in secrets.literals('count = [1, "Zx81kLmnQ9pR2s7t"]')} == set()
    deep = "secret = " + "f(k = " * 300 + '"Zx81kLmnQ9pR2s7t"' + ")" * 300
    assert {deep[a:b] for a, b in secrets.literals(deep)} == {"Zx81kLmnQ9pR2s7t"}


def test_pages_equal_the_pattern_and_take_time_in_the_length():
    pattern = re.compile(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>")
    pieces = ["<", ">", "<script>", "</script >", "<SCRIPT a='1'>", "<style>", "</style>", "<!--", "-->", "<p>", "text", "<scripts>", "</", "\n", "é"]
    rng = np.random.default_rng(3)
    for _ in range(4000):
        t = "".join(rng.choice(pieces, rng.integers(0, 9)))
        assert url_filter.without_tags(t) == pattern.sub(" ", t), t
    began = time.process_time()
    for t in ("<" * N, "<script>" * (N // 8), "<!--" * (N // 4), "<p>" * (N // 3), "<style><script>" * (N // 15)):
        url_filter.without_tags(t)
    assert time.process_time() - began < 20


def test_long_names_are_split_in_time():
    segment = url_filter.Segmenter({"a" * 20_000: 3.0, "aa": 2.0, "cheap": 4.0, "pills": 4.0})
    began = time.process_time()
    out = segment("a" * 50_000)
    assert time.process_time() - began < 20 and "".join(out) == "a" * 50_000
    assert segment("cheappills") == ["cheap", "pills"]


def test_a_language_without_letters_is_not_predicted(spark):
    rows = [(i, "the quick brown fox and the dog", "en") for i in range(20)] + [(100 + i, "le chat et la souris sont ici", "fr") for i in range(20)] + [(200 + i, "123 456 7", "zz") for i in range(20)] + [(300, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["en", "fr"]
    texts = spark.createDataFrame([(1, "привет мир"), (2, "le chat"), (3, "12"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(texts, model).collect()}
    assert got[1] in ("en", "fr") and got[2] == "fr" and got[3] == got[4] == "und"
    none = langid.fit(docs.where("lang in ('zz', 'yy')"))
    assert none.langs == [] and {r["lang_pred"] for r in langid.identify(texts, none).collect()} == {"und"}
    assert langid.keep_clear(docs.withColumn("source", F.lit("a")).where("lang = 'zz'")).count() == 0
