"""Quality rules and the URL filter against plain versions."""

import re
from collections import Counter

import pytest
import zstandard

from pulsegrid.llm import quality, url_filter
from pulsegrid.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_counts_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in quality.op9_quality(spark, sf).collect():
        text = texts[r.doc_id]
        words, seen, again, covered = WORD.findall(text), set(), 0, set()
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times = Counter(windows)
        for k, w in enumerate(windows):
            if times[w] > 1:
                covered.update(range(k, k + 5))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), again, len(covered))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.kept and r.base_failed)


def test_bands():
    bands, compressor = quality.Bands(), zstandard.ZstdCompressor(level=3)
    judge = lambda data: quality.compression(data, bands, compressor).within
    import random

    draw = random.Random(1)
    prose = " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(2000)).encode()
    assert judge(b"") and judge(prose) and judge(prose[:600])
    assert not judge(b"buy now! " * 400)  # repeats itself
    assert not judge(draw.randbytes(6000))  # doesn't compress
    mixed = prose[:6144] + draw.randbytes(6144)
    assert not judge(mixed) and quality.compression(mixed, bands, compressor).bad_chunks >= 0.5


@pytest.mark.parametrize("junk", ["noise", "abc"])
@pytest.mark.parametrize("size", [2100, 4200])
def test_a_bad_tail_counts_like_a_bad_start(size, junk):
    import base64
    import random

    draw, bands, compressor = random.Random(2), quality.Bands(), zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(2000)).encode()[:size]
    bad = {"noise": base64.b64encode(draw.randbytes(1425)), "abc": b"abc" * 633 + b"a"}[junk]
    assert len(bad) == 1900 and quality.compression(prose, bands, compressor).within
    assert not quality.compression(bad + prose, bands, compressor).within
    assert not quality.compression(prose + bad, bands, compressor).within


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("http://A.Example.COM/X/y?q=/z#f", "a.example.com", "/X/y"), ("https://h.net", "h.net", ""), ("https://h.net?x=1", "h.net", ""),
        ("no scheme", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"), ("://x/y", "x", "/y"), ("http://ÄB.com/é", "Äb.com", "/é"),
    ],
)
def test_host_and_path(url, host, path):
    assert url_filter.host_and_path(url) == (host, path)


@pytest.mark.parametrize(
    ("host", "path", "rule"),
    [
        ("example.com", "/en/1", "example.com/en/"), ("m.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"),
        ("a.www.example.com", "/en/", "www.example.com/en/"), ("example.com", "/de/", "com/"), ("badexample.com", "/en/", "com/"), ("x.net", "/es/1", "net/es/"),
        ("x.net", "/en/", None), ("x.com", "", None), ("", "", None),
    ],
)
def test_the_longest_rule_wins(host, path, rule):
    found = url_filter.RuleTable(url_filter.RULES).find(host, path)
    assert (found and found.name) == rule


def test_vocabulary_counts_at_boundaries():
    v = url_filter.Vocabulary(("xxx", "cheap-pills"), ("cheap", "pills", "bet"))
    assert v.count("http://cheap-pills.net/bet") == (1, 3)
    assert v.count("http://alphabet.net/betxxx") == (0, 0)
    assert v.count("http://a.net/XXX/xxx?bet&bet") == (2, 1)
    assert url_filter.Vocabulary((), ()).count("http://a.net") == (0, 0)


def test_verdicts(spark):
    pages = [(1, "https://a.org/bet/free"), (2, "https://a.org/bet/bet"), (3, "https://a.org/porn"), (4, "https://a.com/porn"), (5, "https://a.net/fr/x")]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block"}
