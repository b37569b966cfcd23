import random

import corpus_pipeline
import pytest
from tests.llm.test_simhash import brute_components, brute_fingerprint, signed

from pulsegrid.llm import near_copies, simhash
from pulsegrid.llm.common import table


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(texts):
    """The ids that stay of {id: text}: one a component over 2 bits or a Jaccard similarity of 0.8."""
    ids, sets = sorted(texts), {k: shingles(t) for k, t in texts.items()}
    fp = {k: signed(brute_fingerprint(t)) for k, t in texts.items()}
    least, top = brute_components(fp.values(), 2), {}
    root = {k: top.setdefault(least[fp[k]], k) for k in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def made(groups, copies, words=60):
    """Texts in groups of near copies: all words of a group are its own, one changes from copy to copy."""
    texts = {}
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words)]
        for c in range(copies):
            texts[len(texts)] = " ".join(base[: words // 2] + [f"c{c}"] * (c > 0) + base[words // 2 :])
    return texts


def kept(spark, texts, **more):
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    return {r.doc_id for r in simhash.deduplicate(docs, similarity=0.8, **more).collect()}


def test_near_copies_beyond_two_bits_go(spark):
    texts = made(8, 3) | {100: None, 101: "", 102: "one two", 103: "One two", 104: "two one"}
    assert kept(spark, texts) == brute_kept(texts)
    assert len(brute_kept(texts)) == 8 + 3


def test_a_large_group_becomes_one(spark):
    texts = made(1, 120) | {200: "a text of its own that nothing else in here resembles"}
    assert kept(spark, texts) == brute_kept(texts) == {0, 200}


@pytest.mark.parametrize("seed", range(3))
def test_scattered_groups_against_brute_force(spark, seed, monkeypatch):
    """Many changes a copy, so that members of a group are near some and far from others; hot shingles too."""
    monkeypatch.setattr(near_copies, "SAMPLED", 1 + seed)
    monkeypatch.setattr(near_copies, "HOT", 20)
    draw, texts = random.Random(seed), {}
    passage = [f"p{k}" for k in range(80)]
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(120)]
        for _ in range(40):
            words = list(base)
            for _ in range(draw.randint(0, 7)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            texts[len(texts)] = " ".join(words[: draw.randint(70, 120)])
    for _ in range(80):  # a shared passage and some own words
        texts[len(texts)] = " ".join(passage + [f"y{draw.randrange(10**6)}" for _ in range(draw.randint(0, 30))])
    got = kept(spark, texts)
    assert got == brute_kept(texts) and 10 < len(got) < len(texts) - 50


def test_rows_without_ids_and_ids_with_several_texts(spark):
    near = made(1, 3)
    rows = [(None, near[0]), (None, near[1]), (1, near[2]), (1, "another text under the same id"), (2, "alone"), (2, "alone"), (None, "nobody's text here"), (None, "nobody's text here")]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(1, near[2]), (1, "another text under the same id"), (2, "alone"), (0, "nobody's text here")])


def test_stage_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert {r.doc_id for r in out} == brute_kept(texts) and not {145, 177} & {r.doc_id for r in out}


def test_texts_that_are_alone_are_not_shuffled_to_remove_copies(spark, monkeypatch):
    """The removal's join meets the rows of near and exact copies and few others; nothing else changes."""
    seen, own = [], simhash.suspects
    monkeypatch.setattr(simhash, "suspects", lambda *a: seen.append((a[3], own(*a))) or seen[-1][1])
    texts = made(4, 5) | {100 + k: f"text {k} of its own about nothing but {k * k}" for k in range(200)}
    rows = [*texts.items(), (None, texts[100]), (100, texts[100]), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in simhash.deduplicate(docs, similarity=0.8).collect())
    stay = brute_kept(texts)
    assert out == sorted([(k, texts[k]) for k in stay] + [(-1, "")])
    gone, (may, _) = seen[0]
    found = {(r.c0, r.c1) for r in may.where("__may").select("c0", "c1").collect()}
    assert found >= {(k, t) for k, t in texts.items() if k not in stay} | {(None, texts[100]), (100, texts[100])}
    assert len(found) < 16 + 4 + 200 / 4 and gone.count() >= 18
