"""Secrets and personal data against Python's patterns, and what the methods add."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import pii, secret_scan
from pulsegrid.llm.common import table
from pulsegrid.llm.spans import located

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    total = 0
    for k, c in enumerate(reversed(digits(text))):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def secrets_of(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def personal_of(text):
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(m[0])]
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


def drawn(seed, parts, n):
    draw = random.Random(seed)
    return ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(n)]


SECRET_PARTS = ["password", "PassWD", "toKen", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 3, "abc", "x9", "é", "😀", "\n", "login", "=bob12", "https://h.io/x ", "aB3" * 9]
PERSONAL_PARTS = ["a", "b9", ".", "@", "-", "_", "1", "2", "25", "255", "256", "0", " ", "+", "(", ")", "é", "😀", "4111111111111111", "Z", "12-34", "Mary Smith", "\n", " +1 (555) ", "111-22-3333"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_secrets_against_brute_force(spark):
    texts = drawn(1, SECRET_PARTS, 2500) + ["secret=token: abcdefgh", "token=token=abcdef", "AKIAAKIA" + "Z" * 20, "f" * 200_000, "token = " * 4000 + "abcdef1"]
    rows = secret_scan.scan(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = secrets_of(texts[r.doc_id])
        assert [tuple(s) for s in r.strong] == want, texts[r.doc_id][:200]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(want) <= {tuple(s) for s in r.found}


def test_linking_against_all_pairs(spark):
    """The sweep finds what comparing every two parts of a text would."""
    from pulsegrid.llm.spans import located

    texts = drawn(2, [*SECRET_PARTS, "x " * 90, "client_id=abcd", "username: bob7 "], 800)
    docs = frame(spark, texts)
    parts = {}
    for r in located(docs, secret_scan.KINDS).where("kind is not null").collect():
        parts.setdefault(r.doc_id, []).append((r.start, r.kind, r.end))
    reach = secret_scan.REACH

    def near(a, b, far):
        return a[0] < b[2] + far and b[0] < a[2] + far

    n = 0
    for r in secret_scan.scan(docs).collect():
        some = parts.get(r.doc_id, [])
        sure = [p for p in some if p[1] in (0, 1, 2, 5)]
        named = [p for p in some if p[1] == 3]
        left = [p for p in some if not (p[1] in (3, 4) and any(near(p, s, 0) for s in sure)) and not (p[1] == 4 and any(near(p, s, 0) for s in named))]
        want = set()
        for p in left:
            secret = any(q[1] in (0, 2, 4) and q != p and near(p, q, reach + 1) for q in left)
            ident = any(q[1] in (1, 3) and q != p and near(p, q, reach + 1) for q in left)
            if p[1] in (0, 1, 2) or (p[1] == 3 and secret) or (p[1] == 4 and ident) or (p[1] == 5 and secret and ident):
                want.add(p)
        assert {tuple(s) for s in r.found} == want, texts[r.doc_id]
        n += r.n_linked
    assert n > 20


def test_many_spans_in_one_text_take_time_in_proportion(spark):
    """Eight times the spans must not take anything like 64 times as long, for either operator and for the masking."""
    import time

    def took(n, query):
        docs = frame(spark, ["token=abcdefgh1 a@b.de , " * n]).withColumn("n_chars", F.lit(0).cast("long"))
        began = time.perf_counter()
        query(docs).collect()
        return time.perf_counter() - began

    for query in (secret_scan.scan, secret_scan.redact, pii.scan):
        assert took(32_000, query) < 10 * took(4_000, query)


def test_masking_across_blocks(spark, monkeypatch):
    """Small blocks: spans cross them, touch them and overlap each other."""
    monkeypatch.setattr(secret_scan, "BLOCK", 7)
    draw, texts, spans = random.Random(11), [], []
    for k in range(60):
        texts.append("".join(draw.choices("abé😀\n ", k=draw.randint(1, 60))))
        for _ in range(draw.randint(0, 5)):
            start = draw.randrange(len(texts[k]))
            spans.append((k, start, draw.randint(start + 1, len(texts[k]))))
    cuts = secret_scan.cuts(spark.createDataFrame(spans, "row long, start long, end long"), "#").withColumnRenamed("row", "doc_id")
    joined = frame(spark, texts).join(cuts, "doc_id", "left")
    got = {r.doc_id: r.out for r in joined.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(secret_scan.masked(F.col("text"), F.col("cuts"))).alias("out")).collect()}
    for k, text in enumerate(texts):
        out, done = "", 0
        for start, end in sorted((a, b) for row, a, b in spans if row == k):
            if start >= done:
                out += text[done:start] + "#"
            done = max(done, end)
        assert got[k] == out + text[done:]


def test_long_tokens_are_candidates(spark):
    key = "aB3xY9" * 15
    rows = {r.doc_id: r for r in secret_scan.scan(frame(spark, [f"account_id: storage7 and {key}== end", key])).collect()}
    assert rows[0].n_linked == 2 and rows[1].n_linked == 0
    long_name = "client_id=" + "q7" * 50
    out = secret_scan.redact(frame(spark, [f"{long_name} password=hunter22"])).first()
    assert out.text == "[SECRET] [SECRET]"


def test_weak_parts_alone_are_not_reported(spark):
    texts = ["aB3" * 8, "login: bob1 nothing", "https://h.io/x alone", "aB3" * 8 + " client_id=foobar12", "user_name=bob12 " + "y " * 200 + "aB3" * 8]
    got = {r.doc_id: r.n_linked for r in secret_scan.scan(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: 0}


def test_redacted_texts_have_no_secrets(spark):
    texts = [t for t in drawn(3, SECRET_PARTS, 400)] + ["clean text", None, "é😀 token='abcdef99' end"]
    docs = frame(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert len(out) == len(texts)
    assert out[len(texts) - 1].text == "é😀 [SECRET]' end" and out[len(texts) - 1].n_chars == len("é😀 [SECRET]' end")
    for k, text in enumerate(texts):
        spans = secrets_of(text or "")
        if not spans and not any(p in (text or "") for p in ("login", "aB3", "https")):
            assert out[k].text == text
        for start, _, end in spans:
            assert text[start:end] not in out[k].text or secrets_of(out[k].text) == []


def test_secret_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in secret_scan.op2_secrets(spark, sf).collect():
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in secrets_of(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_personal_against_brute_force(spark):
    texts = drawn(4, PERSONAL_PARTS, 2500) + [
        "a@b.c_d@e.f.g", "a@b.c..d@e.f x@y", "1.2.3.4.5.6.7.8 0255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 20,
        "x" * 100_000, "a@" + "b.c" * 20_000, "9 " * 30_000, "+1" + " " * 50_000, "1.2." * 10_000,
    ]
    for r in pii.scan(frame(spark, texts)).collect():
        want = personal_of(texts[r.doc_id])
        assert [tuple(s) for s in r.base] == want, texts[r.doc_id][:200]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in want) for n in range(4))
        assert {(a, k, b) for k, a, b in want} <= {tuple(s) for s in r.found}


def test_personal_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in pii.op4_pii(spark, sf).collect():
        joined = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in personal_of(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_estimation_finds_reliable_labelers():
    """Votes drawn from known reliabilities come back."""
    draw = random.Random(5)
    right = {"form": 0.95, "gazetteer": 0.8, "context": 0.6}
    counts = {}
    for _ in range(20_000):
        true = draw.random() < 0.3
        votes = tuple((1 if true else -1) * (1 if draw.random() < right[n] else -1) for n in pii.LABELERS)
        counts[votes] = counts.get(votes, 0) + 1
    cells = [dict(zip(pii.LABELERS, v, strict=True)) | {"kind": 7, "long": 1, "digital": 0, "n": n} for v, n in counts.items()]
    found = pii.estimate(cells, rounds=500)
    assert found.prior[7] == pytest.approx(0.3, abs=0.05)
    for name in pii.LABELERS:
        assert found.votes[name, True, 1] == pytest.approx(right[name], abs=0.07)
    bias, weights = pii.classify(cells, found)
    assert weights["form", 1] > weights["gazetteer", 1] > weights["context", 1] > weights["context", -1]


def test_context_decides_on_weak_kinds(spark):
    texts = ["call me: tel 212-555-1234 now"] * 40 + ["version 212-999-1234 of the release"] * 40
    found = pii.scan(frame(spark, texts)).collect()
    names = {r.doc_id: [pii.NAMES[s.kind] for s in r.found] for r in found}
    assert all(names[k] == ["local_phone"] for k in range(40)) and all(names[k] == [] for k in range(40, 80))


def test_a_capitalised_word_does_not_use_a_name_up(spark):
    texts = ["Contact Maria Lopez now", "Yesterday Daniel Brown left", "Mr John Smith", "Dear Mr Walter Kline", "Blue House and Red Tree by Anna Bell", "Annas Bell", "name is Walter Kline", "Dr. Émile Zola"]
    want = ["Maria Lopez", "Daniel Brown", "John Smith", "Walter Kline", "Anna Bell", None, "Walter Kline", "Émile Zola"]
    rows = located(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [pii.KINDS[pii.NAMES.index("name")]], [*pii.LABELERS, "long", "digital"])
    got = {r.doc_id: texts[r.doc_id][r.start : r.end] for r in rows.where("kind is not null").collect()}
    assert [got.get(k) for k in range(len(texts))] == want
