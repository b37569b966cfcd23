import hashlib
import pickle
import random
from array import array
from types import SimpleNamespace
from unittest.mock import MagicMock

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import bpe
from pulsegrid.llm.common import table


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(bpe.load(bpe.default_path()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def naive(own, piece: bytes) -> list[int]:
    ids = [own.first[b] for b in piece]
    while True:
        ranked = [(own.ranks[k], i) for i in range(len(ids) - 1) if (k := ids[i] << 32 | ids[i + 1]) in own.ranks]
        if not ranked:
            return ids
        rank, i = min(ranked)
        ids[i : i + 2] = [own.merged[rank]]


def test_tree_takes_the_leftmost_of_the_lowest(own):
    draw = random.Random(1)
    for _ in range(400):
        piece = bytes(draw.choice(b"abetinosr ") for _ in range(draw.randint(0, 40)))
        assert own.merge(piece) == naive(own, piece)
    assert own.merge(b"a" * 257) == naive(own, b"a" * 257)


def test_equals_the_library_on_odd_texts(own, library):
    draw = random.Random(2)
    parts = [*"ab c\n\t  '1<|é\x00", "<|endoftext|>", "'ll", "\x1c", "\x85", "　", "ñ", "😀", "Ǳ", "٣", "aa" * 30]
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decodes_broken_characters_like_the_library(own, library):
    draw = random.Random(3)
    for _ in range(2000):
        ids = [draw.randrange(50_257) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_letters_of_the_library(own, library):
    for c in [*range(0x20, 0x3000, 7), *range(0xA7C0, 0xA800), *range(0x10000, 0x1F000, 97), 0x1C89, 0x105C0]:
        text = f"a{chr(c)}b {chr(c)}1"
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_a_long_piece_and_a_small_memo(own, library, monkeypatch):
    text = "ab" * 50_000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    own.memo.clear()
    words = "one two three four five six one two three"
    assert own.encode(words) == library.encode(words, add_special_tokens=False).ids


@pytest.mark.parametrize(("entries", "size"), [(200, 10**9), (10**9, 40_000)])
def test_what_a_worker_keeps_is_bounded_in_all(own, library, monkeypatch, entries, size):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", entries)
    monkeypatch.setattr(bpe, "MEMO_BYTES", size, raising=False)
    tokenizer = pickle.loads(pickle.dumps(own))
    held = lambda: sum(len(v) for v in vars(tokenizer).values() if isinstance(v, dict))
    fixed, most = held(), 0
    for k in range(1000):
        text = f"the wörd{k * 7919}x, again{k}; it's {'ж' * (k % 40)}{k}"
        assert tokenizer.encode(text) == library.encode(text, add_special_tokens=False).ids
        most = max(most, held() - fixed)
    assert 50 < most <= 200  # an entry takes over 200 bytes
    assert "the" in tokenizer.memo or "the" in tokenizer.older  # what recurs is still there
    assert pickle.loads(pickle.dumps(tokenizer)).memo == {}


def test_a_worker_gives_memory_back(monkeypatch):
    import pyarrow as pa

    from pulsegrid.llm import common

    calls = []
    monkeypatch.setattr(common, "trimmer", lambda: calls.append)
    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert list(common.released(lambda some: (b for b in some))(iter(batches))) == batches and len(calls) == 4
    left = common.released(lambda some: (b for b in some))(iter(batches))
    next(left)
    left.close()
    assert len(calls) == 5


def test_a_forest_merges_like_a_tree(own):
    draw = random.Random(4)
    pieces = [bytes(draw.choices(b"abetinosr \xc3\xa9", k=n % 70)) for n in range(3000)] + [b"a" * 255, b"ab" * 128, b"in" * 300, b"the" * 200] * 20
    assert own.merge_all(pieces) == [array("I", naive(own, p)).tobytes() for p in pieces]
    assert own.merge_all([]) == []


def test_pieces_of_a_batch_are_merged_side_by_side(own, library, monkeypatch):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abetinosrè", k=draw.randint(3, 40))) for _ in range(200)) for _ in range(20)]
    run, alone, merge = [], [], bpe.Tokenizer.merge
    monkeypatch.setattr(bpe, "map_arrow", lambda df, fn, schema: run.append(fn))
    monkeypatch.setattr(bpe.Tokenizer, "merge", lambda self, piece: alone.append(piece) or merge(self, piece))
    held, frame = SimpleNamespace(value=pickle.loads(pickle.dumps(own))), MagicMock()
    frame.sparkSession.sparkContext.broadcast.return_value = held
    bpe.digests(frame, bpe.default_path())
    rows = run[0]({"doc_id": list(range(20)), "text": texts})
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert rows["n_tokens"] == [len(i) for i in ids]
    assert rows["ids_sha256"] == [hashlib.sha256(array("I", i).tobytes()).hexdigest() for i in ids]
    assert len(alone) < 200  # of about 4,000 different pieces


def test_a_text_of_many_chunks_is_looked_up_in_steps(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 5)
    texts = ["", "one two<|endoftext|> three four five six<|endoftext|><|endoftext|>seven  eight\n\n nine ten", "<|endoftext|>"]
    assert [array("I", p).tolist() for p in own.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark, sf, library):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in bpe.op3_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_of_the_frames(spark, sf):
    docs = table(spark, sf, "documents").limit(20)
    back = bpe.decode(bpe.encode(docs, bpe.default_path()), bpe.default_path())
    assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text) for r in docs.collect())
