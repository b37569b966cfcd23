import random
import re

import numpy as np
import pytest

from pulsegrid.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window):
    found = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(name)
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for key, owners in found.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit.update(range(k, k + len(key)))
                    names |= owners
        out.append((len(w), len(hit), names))
    return out


def sentence(draw, letters, longest):
    return " ".join(draw.choice(letters) for _ in range(draw.randint(0, longest)))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aBcÉé1,-"])
def test_against_brute_force(letters):
    draw = random.Random(letters)
    for _ in range(60):
        texts = [sentence(draw, letters, 60) for _ in range(6)]
        items = [(str(k), sentence(draw, letters, 9)) for k in range(5)]
        blocks = [d.test_block([(n, t.encode()) for n, t in part], 4) for part in (items[:2], items[2:])]
        got = [(f.n_words, f.n_hit, f.item_ids) for f in d.scan([t.encode() for t in texts], blocks, False)]
        assert got == brute(texts, items, 4)


def test_suffix_array_is_sorted_to_the_window():
    draw = random.Random(4)
    block = d.test_block([("1", b"a b c d e f g h i j k l m n")], 13)
    text = np.array([draw.choice([0, 1, 1, 2, 3]) for _ in range(500)] + [0], np.int64)
    block.shortest = 1
    order, _ = d.suffix_array(text, block)
    rows = [text[k : k + 13].tolist() for k in order]
    until_gap = [r[: r.index(0)] if 0 in r else r for r in rows]
    assert until_gap == sorted(until_gap) or all(a <= b or b == a[: len(b)] for a, b in zip(until_gap, until_gap[1:], strict=False))


def test_longest_matches(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"x y {passage} z"), (2, "nothing"), (3, passage[: passage.index("w20")] + " q " + passage)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", f"head {passage} tail"), ("b", "x y")], "item_id string, text string")
    got = {tuple(r) for r in d.longest_matches(docs, bench).collect()}
    assert got == {(1, "a", 1, 2, 30), (1, "b", 0, 0, 2), (3, "a", 1, 0, 20), (3, "a", 1, 21, 30)}


def test_blocks_and_shards_change_nothing(spark, sf):
    from pulsegrid.llm.common import table

    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = sorted(map(repr, d.contamination(docs, bench).collect()))
    assert whole == sorted(map(repr, d.contamination(docs, bench, block_bytes=1500, shard_words=300).collect()))


def test_query(spark, sf):
    import hashlib

    from pulsegrid.llm.common import table

    docs = table(spark, sf, "documents").collect()
    items = [(str(r.item_id), r.text) for r in table(spark, sf, "benchmark").collect()]
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], items, 13), strict=True))
    for r in d.op6_decontamination(spark, sf).collect():
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_items_without_an_id_are_searched(spark):
    passage = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(1, passage), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (3, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in d.contamination(docs, bench).collect()}
    assert got == {1: (15, [], True), 2: (0, [], False)}


def test_a_worker_holds_one_block_at_a_time():
    class Block:
        alive = 0
        _path = "somewhere"

        def load_from_path(self, path):
            Block.alive += 1
            return path

    blocks = [Block(), Block(), Block()]
    turn = d._in_turn(blocks)
    assert next(turn) == "somewhere" and Block.alive == 1
    assert list(turn) == ["somewhere"] * 2 and not any("_value" in vars(b) for b in blocks)
