"""Classifiers and the language model: held-out figures, and properties that hold exactly."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import language, suffix_tree_lm, toxicity
from pulsegrid.llm.common import drawn, hash_bound, remainder, table

BIGGER = "/root/testdata/sf0.1"


def crc(ident, modulus):
    return zlib.crc32(str(ident).encode()) % modulus


def test_toxicity_on_held_out_documents(spark):
    rows = toxicity.op1_toxicity(spark, BIGGER).collect()
    known = {r.doc_id: r.toxic for r in table(spark, BIGGER, "labels").collect()}
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    tp, fp, fn = (sum(pair == cell for pair in held) for cell in ((1, 1), (0, 1), (1, 0)))
    assert tp / (tp + fn) > 0.9 and tp / (tp + fp) > 0.97


@pytest.mark.parametrize("n", [10, 10**8, 10**9, 13 * 10**8, 10**10, 8 * 10**12])
def test_the_draw_expects_enough_rows_at_any_count(n):
    """The part of the hashes' range that passes, times the rows, is what is wanted and half as much again."""
    for most in (1_200, 8_000):
        part = (hash_bound(most, n) + (1 << 63)) / (1 << 64)
        assert min(n, 1.4 * most) <= n * part * 1.000001 <= 1.6 * most + 200 or part > 0.999


def test_the_draw_is_bounded_for_null_and_repeated_ids(spark):
    rows = [(None, f"text {k}", "en") for k in range(300)] + [(7, "same", "en")] * 300 + [(k, "ein text " * (1 + k), "de") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = drawn(df, 40, 100, 10_000, "lang", {"en": 600, "de": 50}).collect()
    assert sum(r.lang == "en" for r in got) == 40
    assert 0 < sum(r.lang == "de" for r in got) <= 40 and all(len(r.text) <= 100 for r in got)
    assert sum(len(r.text) for r in drawn(df, 400, 100, 500).collect()) <= 500
    labels = spark.createDataFrame([(7, 1), (None, 1), (8, 0), (8, 1)] * 50, "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.sampled_labels(labels, 10).collect())) == [(7, 1), (8, 1)]


def test_counterfactual_penalty_quiets_identity_terms():
    """Group mentions that happen to be frequent in toxic texts lose their weight, an insult keeps it."""
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        group = ("muslim" if k % 5 else "christian") if bad else ("christian" if k % 5 else "muslim")
        text = f"the {group} neighbour is {'a moron' if bad and k % 8 else 'here'} today"
        rows.append((sorted(set(toxicity.words_of(text))), int(bad), toxicity.swaps(text, toxicity.IDENTITY)))
    with_, without = (toxicity.fit(rows, toxicity.Settings(counterfactual=c)) for c in (50.0, 0.0))
    gap = lambda m: abs(m.word("muslim") - m.word("christian"))
    assert gap(with_) < 0.35 * gap(without)
    assert with_.score("a muslim moron") > 0.5 > with_.score("the muslim neighbour is here")


def test_the_fit_is_a_minimum_of_the_written_out_objective():
    """The penalised loss, summed up term by term in plain Python, is no lower anywhere near the fitted weights."""
    rng = random.Random(3)
    texts = [(sorted({rng.choice(["muslim", "christian", "hindu", "moron", "fool", "house", "tree", "walk"]) for _ in range(4)}), rng.random()) for _ in range(60)]
    rows = [(w, int(("moron" in w or "fool" in w) == (x < 0.9)), toxicity.swaps(" ".join(w), toxicity.IDENTITY)) for w, x in texts]
    settings = toxicity.Settings(counterfactual=0.5, steps=3000)
    model = toxicity.fit(rows, settings)
    cost = [settings.miss_cost if y else 1.0 for _, y, _ in rows]
    pairs = [p for _, _, swapped in rows for p in swapped]

    def objective(weights, bias):
        word = lambda w: sum(weights.get(f, 0.0) for f in toxicity.features_of(w))
        loss = sum(c * math.log1p(math.exp(-(2 * y - 1) * (bias + sum(map(word, words))))) for c, (words, y, _) in zip(cost, rows)) / sum(cost)
        size = sum(settings.absolute * abs(v) + settings.square / 2 * v * v for v in weights.values())
        return loss + size + settings.counterfactual * sum((word(a) - word(b)) ** 2 for a, b in pairs) / len(pairs)

    least = objective(model.weights, model.bias)
    seen = {f for words, _, _ in rows for w in words for f in toxicity.features_of(w)}
    for step in (0.05, -0.05):
        assert objective(model.weights, model.bias + step) > least - 1e-5
        for f in seen:
            assert objective({**model.weights, f: model.weights.get(f, 0.0) + step}, model.bias) > least - 1e-5


def test_features_of_many_words_are_those_of_each():
    words = ["a", "über", "niñas", "𝒳𝒴𝒵𝒳𝒴", "moron", "longer_word", "日本語日本語日"]
    holder, feature = toxicity.feature_links(pa.array(words))
    links = list(zip(holder.tolist(), feature.to_pylist(), strict=True))
    assert [[f for k, f in links if k == at] for at in range(len(words))] == [toxicity.features_of(w) for w in words]
    assert toxicity.fit([([], 1, []), ([], 1, [])], toxicity.Settings()).score("moron") > 0.99  # no words, no features


def test_the_fit_holds_no_python_object_for_a_link():
    """What the driver holds beside its rows: with words, features and links as strings and tuples it was 25 MB."""
    rng = random.Random(5)
    texts = [sorted({f"{rng.randrange(300):06d}{rng.randrange(10**6)}" for _ in range(20)} | {"moron" if k % 9 == 0 else "house"}) for k in range(2_000)]
    rows = [(w, int("moron" in w), [("woman", "man")] * 50) for w in texts]
    toxicity.fit(rows[:10], toxicity.Settings(steps=1))
    tracemalloc.start()
    pool, model = pa.default_memory_pool().max_memory(), toxicity.fit(rows, toxicity.Settings(steps=20))
    most = tracemalloc.get_traced_memory()[1] + pa.default_memory_pool().max_memory() - pool
    tracemalloc.stop()
    assert model.score("you moron") > 0.5 > model.score("my house")
    assert most < 15e6


def test_terms_of_several_groups_and_languages_swap_once_each():
    got = toxicity.swaps("Ein Muslim kam.", toxicity.IDENTITY)
    assert len(got) == len(set(got)) and {("muslim", "christian"), ("muslim", "katholik")} <= set(got)
    assert ("mujer", "hombre") in toxicity.swaps("La mujer habla.", toxicity.IDENTITY)


def test_swaps_are_made_by_sentence():
    got = toxicity.swaps("A woman spoke. The woman left!\nNobody came.", (("woman", "man"),))
    assert got == [("woman", "man"), ("woman", "man")]


def test_language_on_held_out_documents(spark):
    rows = language.op10_language(spark, BIGGER).collect()
    known = {r.doc_id: (r.lang, r.text) for r in table(spark, BIGGER, "documents").select("doc_id", "lang", "text").collect()}
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and language.has_letter(known[r.doc_id][1] or "")]
    assert sum(r.lang_pred == known[r.doc_id][0] for r in held) / len(held) > 0.98


def test_language_goes_by_family_then_pairs():
    texts = {"en": "the house and the garden of this", "de": "das haus und der garten von dem", "fr": "la maison et le jardin de cette", "es": "la casa y el jardín de esta"}

    def row(lang, text):
        found, times = np.unique(language.buckets(text), return_counts=True)
        return lang, found.astype(np.int64), times / times.sum()

    model = language.fit([row(lang, t) for lang, t in texts.items() for _ in range(3)], language.Settings())
    assert [m for _, m in model.families] == [["de", "en"], ["es", "fr"]]
    assert model.weights.shape[1] == 4  # two families, one pair in each
    assert all(model.predict(t)[0] == lang for lang, t in texts.items())
    assert model.predict("1234 !?") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    assert language.Model().predict("text") == ("und", 0.0)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def lm(spark, sf):
    return suffix_tree_lm.train(table(spark, sf, "documents").where(remainder(7) != 2))


def test_base_scores_are_exact(spark, sf):
    docs = {r.doc_id: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")) for r in table(spark, sf, "documents").collect()}
    counts = Counter()
    for ident, words in docs.items():
        if crc(ident, 7) != 2:
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    total = better = 0.0
    for r in suffix_tree_lm.op7_suffix_tree(spark, sf).collect():
        tokens = [*docs[r.doc_id], None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        assert r.base_score == pytest.approx(base) and r.train_tokens == n
        assert (r.n_tokens, r.n_known, r.held_out) == (len(tokens), sum(counts[t] > 0 for t in tokens), crc(r.doc_id, 7) == 2)
        if r.held_out:
            total, better = total + base, better + r.score
    assert better > total  # contexts help on texts that weren't seen


def test_the_tree_grows_with_the_corpus(spark):
    small, large = (suffix_tree_lm.train(table(spark, folder, "documents").where(remainder(7) != 2))[0] for folder in ("/root/testdata/sf0.01", BIGGER))
    print([(t.total, t.size, [(len(v.codes), len(v.entries)) for v in t.levels]) for t in (small, large)])
    assert large.total > 5 * small.total and large.size > 1.5 * small.size
    for a, b in zip(small.levels, large.levels, strict=True):
        assert len(b.codes) > 1.5 * len(a.codes) and len(b.entries) > 1.5 * len(a.entries)
        assert len(b.codes) <= math.sqrt(large.total) / suffix_tree_lm.Settings().context[1]


def plain_tree(texts, settings):
    """The tree of a corpus counted and tested without vectors: {depth: {context: ({symbol: share}, rest)}}, contexts as tuples."""
    tokens = [[*t.lower().split(), None] for t in texts]
    total = sum(map(len, tokens))
    words = Counter(w for t in tokens for w in t)
    named = {w for w, c in words.items() if w is not None and c >= suffix_tree_lm.often(settings.symbol, total)}
    lines = [["$" if w is None else w if w in named else "?" for w in t] for t in tokens]
    unit = {w: (words[w] + 1) / (total + len(words) + 1) for w in named} | {"$": (words[None] + 1) / (total + len(words) + 1)}
    unit["?"] = max(1 - sum(unit.values()), 1 / (total + len(words) + 1))
    context, entry = suffix_tree_lm.often(settings.context, total), suffix_tree_lm.often(settings.entry, total)
    count = {(s,): c for s, c in Counter(s for line in lines for s in line).items() if c >= context}
    states, stays = {}, set()

    def probability(code, s):
        if not code:
            return unit[s]
        lower = probability(code[1:], s)
        return states[code][0].get(s, 0.0) + states[code][1] * lower if code in states else lower

    for depth in range(1, settings.depth + 1):
        after = Counter()
        for line in lines:
            padded = ["$", *line]
            for k in range(depth, len(padded)):
                after[(*padded[k - depth : k], padded[k])] += 1
        after = {k: c for k, c in after.items() if k[:-1] in count and c >= entry}
        found = {}
        for code, c in count.items():
            own = {k[-1]: (a - settings.discount) / c for k, a in after.items() if k[:-1] == code}
            if own:
                order = sorted(own)
                if suffix_tree_lm.diverges(c, np.array([own[s] for s in order]), np.array([probability(code[1:], s) for s in order])):
                    stays.add(code)
                found[code] = (own, 1 - sum(own.values()))
        states |= found
        count = {k: c for k, c in after.items() if k[-1] != "$" and c >= context}
    stays |= {code[1:] for code in stays if len(code) > 1} & states.keys()
    return {code: states[code] for code in stays}


def test_the_tree_against_a_plain_one(spark):
    """Which contexts stay, and their shares, on a drawn corpus whose words follow each other by rule now and then."""
    import random

    draw, texts = random.Random(3), []
    for _ in range(300):
        words = []
        for _ in range(draw.randint(0, 40)):
            words.append({"a": "b", "b": "c"}.get(words[-1] if words else "", "d") if draw.random() < 0.6 else draw.choice("abcdefgh"))
            if len(words) > 2 and words[-3:-1] == ["a", "d"]:
                words[-1] = "e"
        texts.append(" ".join(words))
    settings = suffix_tree_lm.Settings(symbol=(0.02, 1e9), context=(0.01, 1e9), entry=(1e-3, 1e9))
    tree, _ = suffix_tree_lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), settings)
    want = plain_tree(texts, settings)
    name = {0: "$", 1: "?"} | {int(tree.symbol[k]): w.decode() for w, k in tree.frequent.items() if tree.symbol[k] > 1}
    got = {}
    for depth, level in enumerate(tree.levels, 1):
        for code, rest in zip(level.codes.tolist(), level.rest.tolist(), strict=True):
            own = {name[k % tree.size]: p for k, p in zip(level.entries.tolist(), level.shares.tolist(), strict=True) if k // tree.size == code}
            got[tuple(name[code // tree.size**j % tree.size] for j in range(depth - 1, -1, -1))] = (own, rest)
    assert got.keys() == want.keys() and any(len(c) == 2 for c in got)
    for code, (own, rest) in want.items():
        assert got[code][0] == pytest.approx(own) and got[code][1] == pytest.approx(rest)


def test_every_state_is_a_distribution(lm):
    tree, _ = lm
    for before in ([], [0], [2, 3], [1, 1], [5], [0, 2]):
        mass = 0.0
        for symbol in range(tree.size):
            sequence = np.array([*before, symbol])
            mass += tree.probabilities(sequence, np.arange(len(sequence)))[-1]
        assert mass == pytest.approx(1.0)


def test_the_tree_is_closed_under_suffixes(lm):
    tree, _ = lm
    shorter = set(tree.levels[0].codes.tolist())
    assert len(tree.levels[1].codes) and {c % tree.size for c in tree.levels[1].codes.tolist()} <= shorter


def test_scores_against_a_walk(spark, lm):
    """The vectors' scores equal a walk over the tokens, longest known context first."""
    tree, counts = lm
    known = {bytes(r.word): r.c for r in counts.collect()}
    states = [dict(zip(level.codes.tolist(), level.rest.tolist(), strict=True)) for level in tree.levels]
    entries = [dict(zip(level.entries.tolist(), level.shares.tolist(), strict=True)) for level in tree.levels]

    def symbol(word):
        return int(tree.symbol[tree.frequent[word]]) if word in tree.frequent else 1

    def probability(history, s, depth):
        if depth == 0:
            return tree.unigram[s]
        lower = probability(history, s, depth - 1)
        if len(history) < depth:
            return lower
        code = 0
        for h in history[-depth:]:
            code = code * tree.size + h
        if code not in states[depth - 1]:
            return lower
        return entries[depth - 1].get(code * tree.size + s, 0.0) + states[depth - 1][code] * lower

    text = "The the of and to neverseenword the of, the and of the"
    words = text.encode().lower().split()
    history, total = [0], 0.0
    for word in [*words, None]:
        s = 0 if word is None else symbol(word)
        total += math.log10(probability(history, s, 2))
        if s == 1:
            total += float(tree.log_base(known.get(word, 0))) - math.log10(tree.unigram[1])
        history.append(s)
    got = suffix_tree_lm.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), tree, counts).first()
    assert got.score == pytest.approx(total)
