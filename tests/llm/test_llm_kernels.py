"""Kernels without Spark: merges, automata, searches, hashing, taggers."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, common, decontaminate, langid, ngram_join, pii, quality, sharding, toxicity
from tessera.llm.common import WordMemo, slices, sum_by_text
from tessera.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)


def ids_of(vocabulary, text):
    return np.frombuffer(vocabulary.encode(text), "<u4").tolist()


PIECES = [" ", "  ", "\n", "\t", "a", "the", "é", "1", "22", "!", "?'s", "'ll", "\x1c", " ", "　", "日本", "<|endoftext|>", " x", "zzzz", "՘", "\U000105c0", "é"]


@pytest.mark.parametrize("text", ["", " ", "a", "  a   b ", "x\n \n y\t z  ", "it's we'll I'd 12 345 ..,,  <|endoftext|> z<|endoftext|>", "a" * 3000, "ab" * 777 + "é" * 500, "foo \n", "foo\n "])
def test_bpe_equals_library(vocabulary, library, text):
    told = library.encode(text, add_special_tokens=False).ids
    assert ids_of(vocabulary, text) == told
    assert vocabulary.decode(vocabulary.encode(text)) == library.decode(told, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=120))
def test_bpe_equals_library_on_any_text(vocabulary, library, text):
    told = library.encode(text, add_special_tokens=False).ids
    assert ids_of(vocabulary, text) == told
    assert np.frombuffer(vocabulary.encode_all(["", text, text + " x"])[1], "<u4").tolist() == told


def test_bpe_rows_and_single_words_agree(vocabulary):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aeinorst \xc3\xa9") for _ in range(rng.randint(1, 66))) for _ in range(500)]
    assert vocabulary.merge_words(words) == [vocabulary.merge_long(w) for w in words]


def test_bpe_memo_is_bounded(vocabulary):
    small = bpe.Vocabulary.load(VOCABULARY)
    small.most = 20
    texts = [" ".join(f"w{i}x{j}" for j in range(15)) for i in range(10)]
    assert [small.encode(t) for t in texts] == [vocabulary.encode(t) for t in texts] == small.encode_all(texts)


def test_decode_of_broken_bytes(vocabulary, library):
    ids = ids_of(vocabulary, "日本é")[:1]
    assert vocabulary.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(2).integers(0, 2**60, 4000)
    for n in (1, 2, 24, 25):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    old, new = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert ((old == new) | (new == 24)).all() and 0.02 < (old != new).mean() < 0.06
    assert sharding.jump(keys[:0], 3).tolist() == []
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=10), min_size=1, max_size=6, unique=True), st.lists(st.text("abcd", max_size=12), max_size=12))
def test_automaton_equals_edit_distance(terms, words):
    machine = toxicity.LexiconAutomaton(terms, [])
    for word in words + terms:
        want = min(((edits(word, t), i) for i, t in enumerate(terms) if edits(word, t) <= machine.errors_for(t, False)), default=None)
        assert machine.match(word) == want


def test_stems_and_forgetting():
    machine = toxicity.LexiconAutomaton(["idiot"], ["lowei"], most_states=3)
    assert machine.match("loweiung") == (0, 1) and machine.match("idi0t") == (1, 0) and machine.match("lowe") is None and machine.match("") is None


def test_toxicity_learns_and_tells_quotation():
    clean = [f"a calm line number {i} about weather and trains" for i in range(60)]
    bad = [f"you are such an idiot number {i} really idiot" for i in range(30)]
    model = toxicity.fit_toxicity_model(clean + bad, [0] * 60 + [1] * 30)
    memo = WordMemo(model.word_rows)
    abuse, quoted, plain_, empty, wrong = toxicity.score_toxicity(model, memo, ["what an idiot idiot", 'they wrote "an idiot" there', "a calm line", "", "what an idi0t"])
    assert abuse >= 0.5 > quoted > plain_ and empty == plain_ and wrong > plain_
    assert (toxicity.score_toxicity(None, None, ["x", ""]) == 0).all()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1), st.integers(1, 4)), max_size=12), st.integers(1, 14))
def test_divide_skip(lists, need):
    told = [(sorted(m), w) for m, w in lists]
    want = {k: n for k in range(13) if (n := sum(w for m, w in told if k in m)) >= need}
    assert ngram_join.divide_skip(told, need) == want


def test_group_search_finds_every_pair():
    rng = np.random.default_rng(1)
    pick = random.Random(3)
    for _ in range(60):
        base = [rng.integers(0, 2**63, size=pick.randint(1, 60)).astype(np.uint64) for _ in range(3)]
        sets = []
        for _ in range(pick.randint(1, 90)):
            b = pick.choice(base).copy()
            at = rng.integers(0, len(b), pick.randint(0, max(1, len(b) // 4)))
            b[at] = rng.integers(0, 2**63, size=len(at)).astype(np.uint64)
            sets.append(np.unique(b))
        common = lambda a, b: len(np.intersect1d(a, b))
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (n := common(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - n)}
        got = ngram_join.search_large(sets)
        assert set(got) == want and len(got) == len(want)
        tied = ngram_join.forest(got, len(sets))
        assert set(tied) <= want and len(tied) < max(1, len(sets)) + 1


def test_shingles():
    texts = ["", " \n ", "One two", "one TWO three four five six one two three four five", "É é", "x" * 400 + " b c d e f", "a b c d e\x0bf"]
    for text, got in zip(texts, ngram_join.shingle_sets(texts)):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        assert len(got) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    same = list(ngram_join.shingle_sets(["a b", "A\tB ", "a b c", "É", "é"]))
    assert (same[0] == same[1]).all() and same[0] != same[2] and same[3] != same[4]


def test_required_overlap():
    for n in range(1, 40):
        for m in range(1, 40):
            t = ngram_join.required(n, m)
            assert 100 * t >= 75 * (n + m - t) and 100 * (t - 1) < 75 * (n + m - t + 1)


@settings(max_examples=300, deadline=None)
@given(st.text("aé1234567890.@+- ()%_\n", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            want.append((2, *m.span()))
    want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    assert pii.base_spans(text) == want


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 100_000, "1." * 100_000):
        pii.base_spans(text)


def test_tagger_gradient_and_training():
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh(hidden=3, dims=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, tags = rng.integers(0, pii.CLASSES, (2, 6)), rng.integers(0, pii.TAGS, (2, 6))
    loss, grads = model.gradients(ids, tags)
    for name in ("trans", "emit", "xf", "hb", "bf", "chars"):
        at = tuple(rng.integers(0, n) for n in model.p[name].shape) if name != "chars" else (int(ids[0, 2]), 1)
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-3
        up = model.gradients(ids, tags)[0]
        model.p[name][at] = keep - 1e-3
        down = model.gradients(ids, tags)[0]
        model.p[name][at] = keep
        assert (up - down) / 2e-3 == pytest.approx(float(grads[name][at]), abs=2e-4)


@pytest.fixture(scope="module")
def tagger():
    return pii.train_tagger(pii.training_windows(pii.labelled_texts(["some words that stand around here in a plain text of the town"])))


def test_model_adds_plausible_spans_and_keeps_base_ones(tagger):
    text = "some words, card 4111.1111.1111.1111 and here a@b.org, 10.2.3.4 in the text " * 3
    (base, spans), (none, nothing), (_, empty) = pii.find_spans(tagger, [text, "no digits here", ""])
    assert set(base) <= set(spans) and sum(k == 2 for k, _, _ in spans) == 3 and not any(k == 2 for k, _, _ in base)
    assert spans == sorted(spans) and none == nothing == empty == []
    for wrong in ("1234567890123457", "9999 8888 7777 6666", "1234-5678-9012-3456", "20240115103022", "3.14159265358979", "999.888.777.666", "2024-01-15", "10 000 000"):
        assert pii.find_spans(tagger, [f"some words stand here {wrong} and others follow in a text"])[0] == ([], [])


def test_added_spans_on_held_out_texts(tagger):
    """Precision and recall of what the model adds, on generated spans and hard look-alikes that it has not seen."""
    told = pii.labelled_texts(["other words in this town that nobody has seen before, of a house and of a street"], 1000, seed=99)
    right = wrong = missed = 0
    for (_, spans), (base, found) in zip(told, pii.find_spans(tagger, [t for t, _ in told])):
        added, want = set(found) - set(base), {s for s in spans if not any(x < s[2] and s[1] < y for _, x, y in base)}
        right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - added)
    assert right / (right + wrong) >= 0.97 and right / (right + missed) >= 0.85


def test_reconciled_windows_of_a_long_text(tagger):
    """Spans do not depend on where in a text they stand, or on how long it is."""
    part = "some words stand here 10[.]0[.]0[.]7 and others follow in a text of the town (555) 010-7788 as words do. "
    own = [s for s in pii.find_spans(tagger, [part])[0][1]]
    assert [k for k, _, _ in own] == [1, 3]
    found = pii.find_spans(tagger, [part * 3000])[0][1]
    want = sorted((k, a + n * len(part), b + n * len(part)) for n in range(3000) for k, a, b in own)
    assert len(set(found) & set(want)) >= 0.97 * len(want) and len(found) <= len(want)


def test_model_reads_text_without_digits_or_signs():
    """Every word is shown to the model, also far from any digit, @, + or written-out dot, and a long one is kept whole."""

    class Words:
        def decode(self, ids):
            return np.where(ids > pii.char_ids(" ")[0], 2, 0).astype(np.int8)  # an address in every word

    for said in ("mary[at]town.org", "john.miller(at)example.com", "a-rather-long-local-part-of-an-address-of-some-miller[at]house.example.org"):
        for before in ("", "some words stand here and others follow " * 40):
            text = f"{before}write to {said} about the house"
            assert pii.find_spans(Words(), [text]) == [([], [(0, len(before) + 9, len(before) + 9 + len(said))])]


def test_every_character_is_decoded_once(tagger):
    """Tags of texts read together are those of each window by itself, by the emissions that learning uses; every character has one."""
    rng = np.random.default_rng(3)
    sizes = (0, 1, 16, 33, 511, 512, 513, 543, 544, 545, 992, 993, 1024, 2500)
    texts = ["".join(chr(c) for c in rng.integers(32, 127, n)) for n in sizes]
    for text, tags in zip(texts, pii.tags_of(tagger, texts)):
        assert len(tags) == len(text)
        told = np.full(len(text), -1)
        for begin, size in pii.windows_of(len(text)):
            ids = np.zeros((1, size), np.int64)
            got = pii.char_ids(text[begin : begin + size])
            ids[0, : len(got)] = got
            e = tagger.emissions(ids)[0][:, 0]
            best, back = e[0], []
            for now in e[1:]:
                ways = best[:, None] + tagger.p["trans"]
                back.append(ways.argmax(0))
                best = ways.max(0) + now
            path = [int(best.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            low, high = pii.MARGIN if begin else 0, pii.READ - pii.MARGIN if begin + pii.READ < len(text) else len(got)
            assert (told[begin + low : begin + high] == -1).all()
            told[begin + low : begin + high] = path[::-1][low:high]
        assert (told >= 0).all() and (told == tags).mean() >= 0.999 if text else not len(tags)


def test_undecided_windows_hold_every_tag():
    """Gains are those of the emissions that learning uses; a window that the bound decides has no tag on its best path, whatever the weights."""
    rng = np.random.default_rng(4)
    decided = 0
    for seed in range(40):
        model = pii.Tagger.fresh(hidden=4, dims=5, seed=seed)
        model.p["trans"] = rng.normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
        model.p["emit_b"][0] = seed % 8
        ids = rng.integers(0, pii.CLASSES, (37, 19))
        e = model.emissions(ids)[0]
        gains = model.gains(ids)
        assert gains == pytest.approx((e[..., 1:] - e[..., :1]).transpose(0, 2, 1), abs=1e-4)
        paths, some = model.best_paths(gains), model.undecided(gains)
        assert not np.delete(paths, some, axis=0).any()
        assert (model.decode(ids, batch=8) == paths).all()
        decided += len(ids) - len(some)
    assert decided >= 100


def test_plain_words_are_decided_by_the_bound(tagger):
    """The best path is searched for in few windows of prose, and in those that hold something."""
    rng = random.Random(5)
    words = "some words that stand around here in a plain text of the town".split()
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(50)]
    texts[7] = texts[7][:200] + " write to mary[at]town.org today " + texts[7][200:]
    ids = np.stack([pii.text_ids(t)[:384] for t in texts])
    some = tagger.undecided(tagger.gains(ids))
    assert 7 in some and len(some) <= 25 and tagger.decode(ids)[7].any()


def test_language_model_learns():
    texts, names = [], []
    rng = random.Random(1)
    for _ in range(80):
        texts.append(" ".join(rng.choice("the and of with house".split()) for _ in range(30)))
        names.append("en")
        texts.append(" ".join(rng.choice("der und das mit schön".split()) for _ in range(30)))
        names.append("de")
    model = langid.fit_language_model(texts, names, buckets=1 << 12)
    got, scores = langid.predict_languages(model, WordMemo(model.word_rows), ["the house", "und der", "", "123 !", "ß"])
    assert got[:4] == ["en", "de", "und", "und"] and scores[0] > 0.6 and scores[2:4] == [0.0, 0.0] and all(0 <= s <= 1 for s in scores)
    assert (model.weights != 0).mean() < 0.5
    assert langid.predict_languages(None, None, ["the"]) == (["und"], [0.0])


def test_toxicity_tells_use_from_mention():
    """The label is decided by quotation alone: a term that is said, quoted, or reported."""
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        words = [f"word{rng.randrange(300)}" for _ in range(40)]
        words[17:21] = [["so", "you", "are", "blorgface"], ["so", "you", "are", '"blorgface"'], ["as", "they", "said", "blorgface"], ["so", "you", "are", "here"]][i % 4]
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit_toxicity_model(texts[:300], labels[:300])
    scores = toxicity.score_toxicity(model, WordMemo(model.word_rows), texts[300:])
    assert [u.text for u in model.units] == ["blorgface"] and ((scores >= 0.5) == np.array(labels[300:])).all()


def test_toxicity_learns_no_noise_terms():
    """Terms that only happen to be in some texts of label 1 are not learned; stems that come again and again are."""
    rng = random.Random(2)
    made = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 6]))) for _ in range(40))
    clean = [made() + (" zzkarou" if i % 10 == 0 else "") for i in range(500)]
    bad = [made() + " " + " ".join("zzkar" + rng.choice("abcdefgh") + rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(4)) for _ in range(100)]
    units = toxicity.learn_lexicon(clean + bad, [0] * 500 + [1] * 100)
    assert len(units) <= 3 and all(u.text.startswith("zzkar") for u in units) and toxicity.Unit("zzkar", True, 2) in units


@pytest.mark.parametrize("most", [7, 60, 1 << 20])
def test_texts_in_parts_score_as_whole(monkeypatch, most):
    """However small the parts in which texts are read, scores are those of whole texts."""
    rng = random.Random(3)
    words = "red blue blue green idiot warm idiot cold said road river ünder".split() + ["x" * 90]
    texts = ["", "  ", *[" ".join(rng.choice(words) for _ in range(n)) for n in (1, 5, 30, 200, 3)]]
    labels = [0, 0, 0, 1, 1, 0, 1]
    models = [
        (langid, lambda m, memo: langid.predict_languages(m, memo, texts)[1], langid.fit_language_model(texts[2:], ["a", "b"] * 2 + ["a"], buckets=1 << 12)),
        (quality, lambda m, memo: quality.score_quality(m, memo, texts), quality.fit_quality_model(texts, labels, buckets=1 << 12)),
        (toxicity, lambda m, memo: toxicity.score_toxicity(m, memo, texts), toxicity.ToxicityModel([toxicity.Unit("idiot", False), toxicity.Unit("gree", True, 2)])),
    ]
    want = [score(m, WordMemo(m.word_rows)) for _, score, m in models]
    for module, _, _ in models:
        monkeypatch.setattr(module, "word_groups", lambda t, most=most: common.word_groups(t, most))
    monkeypatch.setattr(toxicity, "LONG_TEXT", most)
    for (_, score, m), told in zip(models, want):
        assert np.allclose(score(m, WordMemo(m.word_rows)), told)


@given(st.text("ab \n", max_size=60), st.integers(1, 9))
def test_pieces_are_the_text(text, most):
    parts = list(common.pieces(text, most))
    assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
    assert [(i, p) for g in common.word_groups([text, "", text], most) for i, p in g] == [(i, p) for i, t in enumerate([text, "", text]) for p in common.pieces(t, most)]


@given(st.lists(st.text("abé", max_size=12), max_size=6), st.integers(1, 5))
def test_ngrams_of_long_words_in_segments(words, most):
    weights = np.random.default_rng(0).normal(size=(64, 2))
    orders = (1, 2, 4)
    got = np.zeros((len(words), 3))
    for numbers, joined, sizes, own in langid.segments(words, orders, most):
        found, owner = langid.ngrams_of(joined, sizes, orders, 64, own)
        for n, o in zip(found, owner):
            got[numbers[o]] += [*weights[n], 1]
    assert np.allclose(got, langid.sum_ngrams(words, orders, weights))


def test_ngram_counts_are_those_of_texts(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    want = np.zeros(256, int)
    for t in texts:
        want[np.unique(langid.word_ngrams(t.lower().split(), (1, 2, 3), 256)[0])] += 1
    for most in (5, 70, 1 << 18):
        monkeypatch.setattr(langid, "word_groups", lambda t, most=most: common.word_groups(t, most))
        counter = langid.NgramCounter((1, 2, 3), 256)
        counter.add_all(texts[:15])
        counter.add_all(texts[15:])
        assert (counter.df == want).all() and counter.texts == 40


def test_memos_are_bounded_in_bytes(vocabulary):
    """20,000 different texts without spaces leave almost nothing behind."""
    rng = random.Random(9)
    letters = "abcdefghijklmnop"
    for start in range(0, 20_000, 500):
        texts = ["".join(rng.choice(letters) for _ in range(80)) + str(i) for i in range(start, start + 500)]
        assert all(vocabulary.decode(ids) == t for t, ids in zip(texts[:3], vocabulary.encode_all(texts)))
    assert all(len(k) <= bpe.LONGEST_KEPT for memo in (vocabulary.words, vocabulary.chunks) for k in memo)
    assert sum(len(k) for memo in (vocabulary.words, vocabulary.chunks) for k in memo) < 8 << 20
    memo = WordMemo(lambda ws: np.array([[len(w)] for w in ws], float).reshape(-1, 1), most_chars=1000)
    for n in (300, 2000, 10):
        assert memo(["x" * n, "y" * n])[:, 0].tolist() == [n, n] and memo.chars <= 1000


def test_scratch_root_is_never_guessed_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())


def test_quality_model_learns():
    rng = random.Random(1)
    words = "red blue green warm cold road river".split()
    good = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(60)]
    bad = [" ".join(rng.choice(words) + "%%%" for _ in range(25)) for _ in range(40)] + [" ".join([rng.choice(words)] * 25) for _ in range(40)]
    model = quality.fit_quality_model(good + bad, [1] * 60 + [0] * 80, buckets=1 << 12)
    scores = quality.score_quality(model, WordMemo(model.word_rows), ["red road river cold", "red%%% road%%% cold%%%", "road road road road", "", "  "])
    assert scores[0] > 0.5 > max(scores[1:3]) and scores[3] == scores[4] == 0.0


def test_item_index_equals_full_scoring():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab[: rng.choice([10, 60])]) for _ in range(rng.randint(3, 40))) + ". Answer word.") for i in range(80)]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        terms = sorted({index.term[w] for w in rng.sample(vocab, rng.randint(1, 30)) if w in index.term})
        totals = np.zeros(len(index.items))
        for t in terms:
            totals[index.postings[t].entries] += index.postings[t].shares
        for threshold in (0.2, 0.5, 0.8):
            got = dict(index.search(terms, threshold))
            want = {e: s for e, s in enumerate(totals) if s >= threshold - 1e-9}
            assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in got)


@pytest.mark.parametrize("dense", [0, 1024])
def test_open_passages_lose_no_entry(monkeypatch, dense):
    """Every passage in which the search finds an entry is open, by dense and by sparse sums, and most others are not."""
    monkeypatch.setattr(decontaminate, "DENSE_ENTRIES", dense)
    monkeypatch.setattr(decontaminate, "CELLS", 300)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(90)]
    index = decontaminate.ItemIndex([(i, " ".join(rng.choice(vocab[: rng.choice([20, 90])]) for _ in range(rng.randint(3, 25)))) for i in range(60)])
    for _ in range(20):
        passages = [sorted({index.term[w] for w in rng.sample(vocab, rng.randint(0, 20)) if w in index.term}) for _ in range(25)]
        at = np.array([p for p, ts in enumerate(passages) for _ in ts], np.int64)
        term = np.array([t for ts in passages for t in ts], np.int64)
        is_open = index.open_passages(at, term, len(passages)).tolist()
        found = [p for p, ts in enumerate(passages) if index.search(ts)]
        assert is_open == sorted(set(is_open)) and set(found) <= set(is_open) and len(is_open) < 25


def test_windows_count_distinct_runs():
    rng = random.Random(3)
    for _ in range(200):
        ids = np.array([rng.randint(-3, 4) for _ in range(rng.randint(0, 25))], np.int64)
        n, width = rng.randint(1, 4), rng.randint(4, 12)
        want = [len({ids[p] for p in range(s, min(len(ids), s + width - n + 1)) if ids[p] >= 0}) for s in range(len(ids))]
        assert decontaminate.in_windows(ids, n, width).tolist() == want


def test_least_share_is_a_bound():
    """No window that holds enough of an item's parts has less than the share by which the item is retrieved."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(14)]
    made = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{made(rng.randint(1, 20))}. {made(rng.randint(1, 7))}.") for i in range(60)]
    for overlap in (0.2, 0.5, 0.9):
        index = decontaminate.ItemIndex(items, overlap)
        passed = 0
        for e, (_, text) in enumerate(items):
            words = [index.term[w] for w in decontaminate.words_of(text)]
            for _ in range(30):
                a, b = rng.randint(0, len(words)), rng.randint(0, len(words))
                window = words[a : a + rng.randint(0, 20)] + words[b:]
                if window and all(part.covered(part.places(window), len(window))[0] >= overlap for part in index.parts[e]):
                    passed += 1
                    assert sum(index.share[e][t] for t in set(window)) >= index.least[e] - 1e-9
        assert passed > 100


def test_other_items_change_no_leak():
    """Whatever items are added, an item is found in the same texts, at the same words, with the same shares of its parts."""
    capital = (1, "What is the capital of France? Paris")
    apart = "what is the capital of France? He said London and then he went to Paris"
    rng = random.Random(22)
    vocab = [f"w{i}" for i in range(25)] + decontaminate.words_of(apart)
    made = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    first = [capital] + [(10 + i, f"{made(rng.randint(1, 30))}. {made(rng.randint(1, 4))}.") for i in range(15)]
    texts = [apart, f"x y {capital[1]} z"] + [f"{made(40)} {t} {made(rng.randint(0, 60))}" for _, t in first for _ in range(2)] + [made(200) for _ in range(20)]

    def found(items):
        rows = [r for index in decontaminate.item_indexes(items) for r in index.leaks(WordMemo(index.terms_of), texts)]
        return {(i, item, passage, q, a) for i, item, passage, _, q, a in rows if item < 100}

    alone = found(first)
    assert (1, 1, 2, 1.0, 1.0) in alone and (0, 1) not in {r[:2] for r in alone} and len(alone) > 30
    for trial in range(8):
        more = [(100 + i, f"{made(rng.choice([2, 60, 300]))}. {made(3)}.") for i in range(rng.randint(1, 30))]
        assert found(first + more) == alone
    for item in first:
        assert {r for r in alone if r[1] == item[0]} == found([item])


def test_sparse_and_dense_sums_find_the_same(monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 30))) + ". " + " ".join(word() for _ in range(3))) for i in range(200)]
    index = decontaminate.ItemIndex(items)
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) + " " + items[rng.randrange(200)][1] for _ in range(60)] + ["", "...", "zzz zz"]
    told = []
    for dense in (1024, 0):
        monkeypatch.setattr(decontaminate, "DENSE_ENTRIES", dense)
        told.append(sorted(index.leaks(WordMemo(index.terms_of), texts)))
    assert told[0] == told[1] and len(told[0]) >= 60


def test_leaks_in_long_texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30))) + ". " + " ".join(word() for _ in range(4)) + ".") for i in range(30)]
    index = decontaminate.ItemIndex([*items, (99, ""), (98, "...")])
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [noise(300), "", noise(137) + " " + items[4][1].upper() + " " + noise(50), items[7][1], noise(3) + " " + items[1][1].split(". ")[0]]
    got = {(i, item) for i, item, *_ in index.leaks(WordMemo(index.terms_of), texts)}
    assert got == {(2, 4), (3, 7)}
    barred = [noise(60) + " " + " | ".join(items[9][1].split()) + " | " + noise(30), " ".join(w + "%%%" for w in items[11][1].split()), "| | % |"]
    assert {(i, item) for i, item, *_ in index.leaks(WordMemo(index.terms_of), barred)} == {(0, 9), (1, 11)}
    assert decontaminate.ItemIndex([]).leaks(WordMemo(index.terms_of), texts) == []


@pytest.mark.parametrize("n", [255, 256, 257, 300, 600, 2000])
def test_long_items_are_verified_whole(n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    long = [word() for _ in range(n - 1)]
    item = " ".join(long[:-1]) + f". {long[-1]} the"
    short = (2, " ".join(word() for _ in range(20)) + ". green it is.")
    clean = "the " + " ".join(word() for _ in range(900)) + " a calm text about the weather and nothing of the test"
    half = " ".join(long[: n // 3]) + " " + clean
    texts = [clean, half, clean + " " + item + " " + clean, clean + " " + short[1], " ".join(long[:-1])]
    indexes = decontaminate.item_indexes([(1, item), short])
    assert [index.width for index in indexes] == ([[(3 * n + 1) // 2, 35]] if n <= 256 else [[35], [(3 * n + 1) // 2]])
    got = {(i, found): (q, a) for index in indexes for i, found, _, _, q, a in index.leaks(WordMemo(index.terms_of), texts)}
    assert got == {(2, 1): (1.0, 1.0), (3, 2): (1.0, 1.0)}


def test_memo_and_sums():
    memo = WordMemo(lambda ws: np.array([[len(w)] for w in ws], float).reshape(-1, 1), most=5)
    for _ in range(20):
        words = [random.choice("a bb ccc dddd eeeee ffffff ggggggg".split()) for _ in range(30)]
        assert memo(words)[:, 0].tolist() == [len(w) for w in words]
    assert memo([]).shape == (0, 1)
    assert sum_by_text(np.array([[1.0], [2.0], [3.0]]), [2, 0, 1])[:, 0].tolist() == [3, 0, 3]
    texts = ["a" * n for n in (5, 0, 9, 30, 1)]
    cut = list(slices(texts, 10))
    assert cut[0][0] == 0 and cut[-1][1] == 5 and all(x[1] == y[0] for x, y in zip(cut, cut[1:]))
    assert zlib.crc32(b"1") % 5 == int(np.uint32(zlib.crc32(b"1"))) % 5


def plain_ngram_buckets(word, orders, buckets):
    """The bucket of every n-gram of a word with its end marks, one at a time in whole numbers."""
    marked, full = [ord(c) + 1 for c in f"\x02{word}\x03"], (1 << 64) - 1
    for n in orders:
        for i in range(len(marked) - n + 1):
            code = 0
            for point in marked[i : i + n]:
                code = (code * 0xD6E8FEB86659FD93 + point * 0x9E3779B97F4A7C15) & full
            code = ((code ^ code >> 32) * 0xBF58476D1CE4E5B9) & full
            yield (code >> 20) % buckets


def scored_texts():
    rng = random.Random(31)
    words = "red Blue grün 道路 cold river stone %%% x ÄÖ".split()
    return ["", "  ", *words, "red red red"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]


def test_quality_scores_equal_a_plain_scorer():
    """Every score from the fitted tables, one word and one n-gram at a time."""
    texts, buckets = scored_texts(), 1 << 10
    model = quality.fit_quality_model(texts, [int("cold" in t) for t in texts], buckets=buckets)
    got = quality.score_quality(model, WordMemo(model.word_rows), texts)
    for text, score in zip(texts, got.tolist()):
        words = text.lower().split()
        units = words + ["\x01=" for a, b in zip(words, words[1:]) if a == b]
        if not units:
            assert score == 0.0
            continue
        logits = []
        for unit in units:
            at = [*plain_ngram_buckets(unit, quality.ORDERS, buckets), (zlib.crc32(unit.encode()) * 0x9E3779B1 >> 8) % buckets]
            vector = [sum(float(model.table[b][d]) for b in at) / len(at) for d in range(model.table.shape[1])]
            logits.append(sum(v * (float(o[1]) - float(o[0])) for v, o in zip(vector, model.out)))
        logit = sum(logits) / len(logits) + float(model.bias[1]) - float(model.bias[0])
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-5


def test_languages_equal_a_plain_scorer():
    """Every language and score from the fitted weights, one word and one n-gram at a time."""
    texts, buckets = scored_texts(), 1 << 10
    model = langid.fit_language_model(texts, ["a" if "river" in t else "b" if "x" in t else "c" for t in texts], buckets=buckets)
    names, scores = langid.predict_languages(model, WordMemo(model.word_rows), texts)
    for text, name, score in zip(texts, names, scores):
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        at = [b for word in text.lower().split() for b in plain_ngram_buckets(word, model.orders, buckets)]
        logits = [(sum(model.weights[b][k] for b in at) / len(at) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        high = [math.exp(x - max(logits)) for x in logits]
        best = max(range(len(high)), key=high.__getitem__)
        assert name == model.languages[best] and abs(score - high[best] / sum(high)) < 1e-9
