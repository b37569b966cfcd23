"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves hold, for every live symbol, the rank of the pair that it forms with its right neighbour. The root
holds the least rank and, among equals, the leftmost place. A merge updates three leaves, each along one path to the
root, until no pair can merge; a piece of n symbols takes O(n log n) whatever its length. Many pieces of about one
length are merged side by side: their trees form a forest in one array, and a round merges one pair in each tree.

A text is cut at white space first. Cutting there never changes the tokens, so equal chunks of a batch are encoded once
and kept in a memo of bounded size. Cutting a piece again gives the piece, so chunks and pieces share one memo.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from functools import cache
from itertools import chain, islice, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import map_arrow, table

#: White space as the pre-tokenizer has it (Python's own class holds four control characters more). A fixed value.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Of the memo's two halves together, in a worker: entries, their bytes (with what a dict takes for each). No longer text is kept.
MEMO_ENTRIES, MEMO_BYTES, MEMO_CHARS = 400_000, 80_000_000, 48
ENTRY_BYTES = 80
#: Chunks that are looked up together; leaves of a forest; its least number of trees; binary digits of its longest piece's length.
STEP, LEAVES, FEWEST_TREES, MOST_DIGITS = 1_000_000, 1 << 16, 16, 9
#: Above every leaf of a forest, which is a rank times 2**32 plus a place.
NO_PAIR = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: a visible Latin-1 character stands for its own byte, the rest follow from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranges(points: list[int]) -> str:
    """A character class's content for sorted code points."""
    out, k = [], 0
    while k < len(points):
        first = points[k]
        while k + 1 < len(points) and points[k + 1] == points[k] + 1:
            k += 1
        out.append(re.escape(chr(first)) + (f"-{re.escape(chr(points[k]))}" if points[k] > first else ""))
        k += 1
    return "".join(out)


@cache
def letters_and_numbers() -> tuple[str, str]:
    """Letters and numbers as the tokenizers library's own Unicode version has them.

    Python's tables tell them, but for code points that Python's Unicode version doesn't know yet; those are asked of
    the library's pre-tokenizer, which keeps a letter with a letter and a number with a number.
    """
    from tokenizers import pre_tokenizers

    kinds: dict[str, list[int]] = {"L": [], "N": []}
    unknown = []
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category == "Cn":
            unknown.append(c)
        elif category[0] in kinds:
            kinds[category[0]].append(c)
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for kind, beside in (("L", "a"), ("N", "1")):
        for k in range(0, len(unknown), 20_000):
            some = unknown[k : k + 20_000]
            pieces = split.pre_tokenize_str("".join(f"{beside}{chr(c)}\n" for c in some))
            whole = {at for _, (at, end) in pieces if end - at == 2}
            kinds[kind] += [c for j, c in enumerate(some) if 3 * j in whole]
    return ranges(sorted(kinds["L"])), ranges(sorted(kinds["N"]))


def piece_pattern() -> str:
    """The pattern of this tokenizer family, its classes written out."""
    letter, number = letters_and_numbers()
    contraction = "|".join("'" + end for end in ("s", "t", "re", "ve", "m", "ll", "d"))
    return f"{contraction}| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Tokenizer:
    """Encodes as a ``tokenizers`` BPE file says. Built from the file's JSON text; picklable."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE is supported")
        alphabet = byte_alphabet()
        vocabulary = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocabulary.items()}
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocabulary[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {vocabulary[a] << 32 | vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocabulary[a + b] for a, b in pairs]
        self.merged_ids = np.array(self.merged, np.int64)
        self.nothing = max(vocabulary.values()) + 1
        known = sorted((a * (self.nothing + 1) + b, rank) for key, rank in self.ranks.items() for a, b in [divmod(key, 1 << 32)])
        self.pair_keys, self.pair_ranks = np.array([*known, (NO_PAIR, 0)], np.int64).T.copy()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.pieces = re.compile(piece_pattern())
        self.special_packed = {s: array("I", [i]).tobytes() for s, i in self.special.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_bytes = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "older": {}, "memo_bytes": 0}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        ``node`` is the segment tree: leaf ``width + i`` holds rank and place, in one integer, of the pair of symbol i
        and the next live one; an inner node the less of its children; node 1 is the root.
        """
        ids = [self.first[b] for b in piece]
        n, rank_of = len(ids), self.ranks.get
        if n < 2:
            return ids
        shift = n.bit_length()
        mask, none = (1 << shift) - 1, len(self.merged) << shift
        width = 1 << (n - 2).bit_length()
        node = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                node[width + i] = rank << shift | i
        for k in range(width - 1, 0, -1):
            left, right = node[k + k], node[k + k + 1]
            node[k] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := node[1]) < none:
            i = best & mask
            j, p = after[i], before[i]
            ids[i] = self.merged[best >> shift]
            ids[j] = -1
            end = after[i] = after[j]
            changed = [(j, none)] if j < n - 1 else []
            if end < n:
                before[end] = i
                rank = rank_of(ids[i] << 32 | ids[end])
                changed.append((i, none if rank is None else rank << shift | i))
            else:
                changed.append((i, none))
            if p >= 0:
                rank = rank_of(ids[p] << 32 | ids[i])
                changed.append((p, none if rank is None else rank << shift | p))
            for place, key in changed:
                k = width + place
                node[k] = key
                k >>= 1
                while k:
                    left, right = node[k + k], node[k + k + 1]
                    if right < left:
                        left = right
                    if node[k] == left:
                        break
                    node[k] = left
                    k >>= 1
        return [i for i in ids if i >= 0]

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A forest's leaves for pairs of symbols, ``nothing`` among them, at these places."""
        wanted = left * (self.nothing + 1) + right
        k = self.pair_keys.searchsorted(wanted)
        return np.where(self.pair_keys[k] == wanted, self.pair_ranks[k] << 32 | place, NO_PAIR)

    def merge_side_by_side(self, pieces: list[bytes], digits: int) -> list[bytes]:
        """Packed ids of pre-tokens of less than ``2 ** digits`` bytes, as ``merge`` gives them.

        Each has ``2 ** digits`` places, the first of which stays empty. ``node`` holds all trees: ``size + place`` is a leaf, the
        parent of k is ``k >> 1``, and the roots are ``count`` to ``2 * count - 1``.
        """
        count, size = len(pieces), len(pieces) << digits
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        ends = lengths.cumsum()
        place = np.arange(ends[-1]) + np.repeat((np.arange(count) << digits) + 1 - (ends - lengths), lengths)
        ids = np.full(size + 1, self.nothing)
        ids[place] = np.array(self.first)[np.frombuffer(b"".join(pieces), np.uint8)]
        node = np.full(2 * size, NO_PAIR)
        node[size + place] = self.leaves(ids[place], ids[place + 1], place)
        for level in range(digits - 1, -1, -1):
            below = node[count << level + 1 : count << level + 2]
            np.minimum(below[::2], below[1::2], out=node[count << level : count << level + 1])
        after, before = np.arange(1, size + 2), np.arange(-1, size)
        roots = np.arange(count, 2 * count)
        while True:
            best = node[roots]
            live = best < NO_PAIR
            if not live.all():
                roots, best = roots[live], best[live]
            if not len(roots):
                break
            i = best & 0xFFFFFFFF
            j, p = after[i], before[i]
            end = after[j]
            symbol = self.merged_ids[best >> 32]
            ids[i], ids[j] = symbol, self.nothing
            after[i], before[end] = end, i
            k = np.concatenate([j, i, p])
            left, right = np.concatenate([symbol, ids[p]]), np.concatenate([ids[end], symbol])
            key = np.full(len(k), NO_PAIR)
            key[len(j) :] = self.leaves(left, right, k[len(j) :])
            k += size
            node[k] = key
            for _ in range(digits):
                k >>= 1
                children = k + k
                node[k] = np.minimum(node[children], node[children + 1])
        ids = ids[:size].reshape(count, -1)
        there = ids != self.nothing
        packed, cuts = ids[there].astype("<u4").tobytes(), [0, *(4 * there.sum(1).cumsum()).tolist()]
        return [packed[cuts[k] : cuts[k + 1]] for k in range(count)]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens."""
        out, alike = [b""] * len(pieces), {}
        for k, piece in enumerate(pieces):
            alike.setdefault(len(piece).bit_length(), []).append(k)
        for digits, group in alike.items():
            most = max(1, LEAVES >> digits)
            for first in range(0, len(group), most):
                some = group[first : first + most]
                if len(some) < FEWEST_TREES or not 2 <= digits <= MOST_DIGITS:
                    made = [array("I", self.merge(pieces[k])).tobytes() for k in some]
                else:
                    made = self.merge_side_by_side([pieces[k] for k in some], digits)
                for k, packed in zip(some, made, strict=True):
                    out[k] = packed
        return out

    def keep(self, text: str, packed: bytes) -> bytes:
        """Puts an entry into the newer half of the memo. When that is full it becomes the older one, whose entries come back as they are used."""
        if len(text) <= MEMO_CHARS:
            if 2 * len(self.memo) >= MEMO_ENTRIES or 2 * self.memo_bytes >= MEMO_BYTES:
                self.older, self.memo, self.memo_bytes = self.memo, {}, 0
            self.memo[text] = packed
            self.memo_bytes += sys.getsizeof(text) + sys.getsizeof(packed) + ENTRY_BYTES
        return packed

    def packed_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks between cuts, as little-endian 32-bit integers; among the chunks may be special tokens."""
        found = {s: self.special_packed[s] for s in self.special_packed.keys() & chunks}
        missing = []
        for c in chunks.difference(found):
            packed = self.memo.get(c)
            if packed is None:
                packed = self.older.get(c)
                if packed is None:
                    missing.append(c)
                    continue
                self.keep(c, packed)
            found[c] = packed
        cut, made, new = [self.pieces.findall(c) for c in missing], {}, []
        for p in set(chain.from_iterable(cut)):
            packed = self.memo.get(p) or self.older.get(p)
            if packed is None:
                new.append(p)
            else:
                made[p] = packed
        made.update(zip(new, self.merge_all([p.encode() for p in new]), strict=True))
        for c, parts in zip(missing, cut, strict=True):
            found[c] = self.keep(c, made[c] if len(parts) == 1 else b"".join([made[p] for p in parts]))
        return found

    def encode_chunks(self, cuts: list[list[str]]) -> list[bytes]:
        found = self.packed_chunks(set().union(*cuts))
        return [b"".join(map(found.__getitem__, c)) for c in cuts]

    def cut(self, text: str) -> list[str]:
        """Chunks and special tokens. A chunk never equals a special token: all of those are taken out of the text first."""
        if self.specials and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return [c for k, p in enumerate(parts) for c in ([p] if k % 2 else CHUNKS.findall(p))]
        return CHUNKS.findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        cuts = [self.cut(t) for t in texts]
        if sum(map(len, cuts)) > STEP:
            return [b"".join([self.encode_chunks([c[k : k + STEP]])[0] for k in range(0, len(c), STEP)]) for c in cuts]
        return self.encode_chunks(cuts)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_all([text])[0]).tolist()

    def decode(self, ids) -> str:
        """Bytes that aren't UTF-8 become U+FFFD; ids outside the vocabulary are skipped."""
        return b"".join(map(self.bytes_of.get, ids, repeat(b""))).decode("utf-8", "replace")


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(documents: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` (array of int) to doc_id; ``path`` is a ``tokenizers`` file on the driver. Null text: no ids."""
    held = documents.sparkSession.sparkContext.broadcast(Tokenizer(load(path)))
    run = lambda b: {"doc_id": b["doc_id"], "ids": [array("I", p).tolist() for p in held.value.encode_all([t or "" for t in b["text"]])]}
    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` from doc_id and ``ids``. Null ids: empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(Tokenizer(load(path)))
    run = lambda b: {"doc_id": b["doc_id"], "text": [held.value.decode(i or ()) for i in b["ids"]]}
    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass, so ids are never shuffled or stored.

    Null text counts as empty; a repeated row gives an equal row; an empty table gives none; other columns are ignored.
    """
    held = documents.sparkSession.sparkContext.broadcast(Tokenizer(load(path)))

    def run(batch: dict) -> dict:
        tokenizer, rows = held.value, ([], [], [])
        for packed in tokenizer.encode_all([t or "" for t in batch["text"]]):
            decoded = tokenizer.decode(array("I", packed)).encode()
            rows[0].append(len(packed) // 4)
            rows[1].append(hashlib.sha256(packed).hexdigest())
            rows[2].append(hashlib.sha256(decoded).hexdigest())
        return {"doc_id": batch["doc_id"], "n_tokens": rows[0], "ids_sha256": rows[1], "decoded_sha256": rows[2]}

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
