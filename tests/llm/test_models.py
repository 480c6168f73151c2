"""The three trained operators: held-out accuracy, folds and odd rows."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from dataclasses import replace
from math import log

import numpy as np
import pytest
from cases import empty, no_labels, odd
from pyspark.sql import functions as F

from sillage.llm import catalog, langid, linecrf, logistic, toxicity

SF = "/root/testdata/sf0.01"


def held_out(name, spark, parts, fold):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == fold) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    return {r["doc_id"]: r for r in rows if r["held_out"]}


def test_language(shipped):
    found = held_out("op4_language", shipped, 4, 2)
    truth = {r["doc_id"]: r["lang"] for r in shipped.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in found]) > 0.97


@pytest.mark.parametrize(("name", "label", "parts", "fold", "cut", "least"), [("op7_line_quality", "quality", 4, 2, 0.7, 0.97), ("op9_toxicity", "toxic", 5, 0, 0.5, 0.9)])
def test_labels(shipped, name, label, parts, fold, cut, least):
    found = held_out(name, shipped, parts, fold)
    truth = {r["doc_id"]: r[label] for r in shipped.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["predicted"] == (r["score"] >= cut) for r in found.values())
    assert np.mean([found[i]["predicted"] == truth[i] for i in found if i in truth]) >= least


def test_toxic_documents_are_found(shipped):
    """One label in nine is toxic, so what counts is how many of them are found and how many of the found are right."""
    folder = SF.replace("sf0.01", "sf0.1")
    truth = {r["doc_id"]: r["toxic"] for r in shipped.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in catalog.QUERIES["op9_toxicity"](shipped, folder).where("held_out").collect() if truth.get(r["doc_id"]) is not None]
    right = sum(r["predicted"] and truth[r["doc_id"]] for r in rows)
    assert right > 0.85 * sum(truth[r["doc_id"]] for r in rows) and right > 0.95 * sum(r["predicted"] for r in rows)


def test_odd_rows(shipped):
    docs, labels = shipped.read.parquet(f"{SF}/documents.parquet"), shipped.read.parquet(f"{SF}/labels.parquet")
    df = odd(shipped)
    rows = langid.predict(df, langid.train(docs)).collect()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert len(rows) == df.count() and {0, 1, 2, 3} <= und and not und & {4, 5, 8}
    for module in (linecrf, toxicity):
        model = module.train(docs, labels)
        found = module.score(df, model).collect()
        assert len(found) == df.count() and all(0 <= r["score"] <= 1 for r in found)
        nothing = {round(r["score"], 12) for r in found if r["doc_id"] in (0, 1, 2)}
        assert len(nothing) == 1
        assert module.score(empty(shipped), model).count() == 0


def test_nothing_to_learn_from(shipped):
    df = odd(shipped)
    for module in (linecrf, toxicity):
        model = module.train(empty(shipped), no_labels(shipped))
        assert len({r["score"] for r in module.score(df, model).collect()}) == 1
        assert module.score(df, module.train(df, no_labels(shipped))).count() == df.count()
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(empty(shipped))).collect()} == {"und"}


def test_messages_are_marginals_of_the_chain():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4])
    evidence, t = rng.normal(size=8), rng.normal(size=(2, 2))
    ahead, back = linecrf.messages(evidence, counts, t)
    at = 0
    for n in counts:
        weight = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(evidence[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                weight[i, y[i]] += p
        assert np.allclose(logistic.sigmoid((ahead + back)[at : at + n]), weight[:, 1] / weight.sum(axis=1))
        at += n


def test_messages_of_long_texts_are_those_of_one_step_a_line():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1000, 3, 256, 0, 257, 512, 1, 0])
    evidence, t = rng.normal(size=counts.sum()) * 3, rng.normal(size=(2, 2)) * 2
    ahead, back = linecrf.messages(evidence, counts, t)
    at = 0
    for n in counts.tolist():
        odds = 0.0
        for i in range(at, at + n):
            odds = (np.logaddexp(odds + t[1, 1], t[0, 1]) - np.logaddexp(odds + t[1, 0], t[0, 0]) if i > at else 0.0) + evidence[i]
            assert abs(ahead[i] - odds) < 1e-9
        odds = 0.0
        for i in range(at + n - 1, at - 1, -1):
            assert abs(back[i] - odds) < 1e-9
            odds = np.logaddexp(odds + evidence[i] + t[1, 1], t[1, 0]) - np.logaddexp(odds + evidence[i] + t[0, 1], t[0, 0])
        at += n


SHARES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"()[]{}\"'", b"/\\@_=+~^", bytes(range(128, 256))]


def brute_lines(text):
    """Features and length of every line with a word, with lists and sets."""
    data = (text or "").encode()
    pieces = [p for p in re.findall(rb"[^\n]*\n|[^\n]+", data) if re.search(rb"[^ \t-\r]", p)]
    words = [re.findall(rb"[^ \t-\r]+", p) for p in pieces]
    flat = [w for ws in words for w in ws]
    out, at, before = [], 0, set()
    triples = [tuple(flat[i : i + 3]) for i in range(len(flat) - 2)]
    first_triple = {}
    for i, g in enumerate(triples):
        first_triple.setdefault(g, i)
    first_word = {}
    for i, w in enumerate(flat):
        first_word.setdefault(w, i)
    for piece, ws in zip(pieces, words, strict=True):
        size, n = sum(map(len, ws)), len(ws)
        places = range(at, at + n)
        whole = piece.strip(b" \t\n\x0b\x0c\r")
        row = [sum(c in share for c in piece) / size for share in SHARES]
        row += [
            log(1 + size), log(1 + n), size / n, sum(i > 0 and flat[i] == flat[i - 1] for i in places) / n, sum(first_word[flat[i]] < i for i in places) / n,
            sum(i < len(triples) and first_triple[triples[i]] < i for i in places) / n, whole in before, ws[-1][-1:] in b".!?:;\"')", ws[0][:1].isupper(),
            (len(piece) - size) / size, log(1 + len(pieces)), sum(len(w) == 1 for w in ws) / n,
        ]
        out.append((np.array(row, float), size))
        before.add(whole)
        at += n
    return out


def brute_quality(text, model):
    """Score of a text by the sums over all paths of labels, one line after the other."""
    found = brute_lines(text)
    zero = np.zeros(linecrf.FEATURES)
    own = [(x - model.mean) / model.scale for x, _ in found]
    evidence = []
    for i, x in enumerate(own):
        wide = np.concatenate((x, own[i - 1] if i else zero, own[i + 1] if i + 1 < len(own) else zero, [i == 0, i + 1 == len(own)]))
        evidence.append(model.weights[0] + wide @ model.weights[1:])
    t, n = model.transitions, len(own)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    for i in range(n):
        ahead[i] = [(np.logaddexp(ahead[i - 1, 0] + t[0, y], ahead[i - 1, 1] + t[1, y]) if i else 0) + y * evidence[i] for y in (0, 1)]
    for i in reversed(range(n - 1)):
        back[i] = [np.logaddexp(t[y, 0] + back[i + 1, 0], t[y, 1] + evidence[i + 1] + back[i + 1, 1]) for y in (0, 1)]
    odds = (ahead + back)[:, 1] - (ahead + back)[:, 0]
    size = np.array([s for _, s in found], float)
    means = [(size * logistic.sigmoid(odds)).sum() / size.sum(), (size * np.clip(odds, -10, 10)).sum() / size.sum()] if n else [0, 0]
    return 1 / (1 + np.exp(-(model.calibration[0] + np.dot(model.calibration[1:], means))))


def test_quality_is_that_of_features_and_paths_one_by_one(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = shipped.read.parquet(f"{SF}/labels.parquet")
    model = linecrf.train(docs, labels)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(["a", "b", "Cc", "9", " ", " ", "\n", "\n", ".", "#", "\r", "\x0b", "é"]) for _ in range(n)) for n in (3, 30, 300, 3000)]
    texts += ["a b c x a b", "c d e", "".join(f"line {i % 7}\n" for i in range(900))] + [r["text"] for r in odd(shipped).select("text").collect()]
    more = shipped.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.unionByName(more).coalesce(2)
    truth = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in linecrf.score(rows, model).collect():
        assert r["score"] == pytest.approx(brute_quality(truth[r["doc_id"]], model), abs=1e-6)


def brute_ratios(texts, scored, size):
    """By text of words: what each word and its pair add, from counts in dictionaries that tell all words and pairs apart; ``size``: bytes by class."""
    scale = [max(1.0, size[c] / min(size.values())) for c in (0, 1)]
    pairs = [Counter(p for t, y in texts if y == c for p in itertools.pairwise(["", *t])) for c in (0, 1)]
    after, left, under = ([Counter(), Counter()] for _ in range(3))
    over = [{p: max(n - toxicity.PAIR_DISCOUNT * scale[c], 0) for p, n in pairs[c].items()} for c in (0, 1)]
    for c in (0, 1):
        for (before, word), n in pairs[c].items():
            after[c][before] += n
            left[c][before] += n - over[c][before, word]
            under[c][word] += min(n, toxicity.LEFT_DISCOUNT * scale[c])
    cut = [toxicity.WORD_DISCOUNT * scale[c] for c in (0, 1)]
    mass = [sum(max(n - cut[c], 0) for n in under[c].values()) for c in (0, 1)]
    shared = {w: sum(min(under[c][w], cut[c]) / scale[c] for c in (0, 1)) + 0.5 for w in under[0] | under[1]}
    rest = sum(shared.values()) + 0.5
    passed_on = rest / (sum(mass[c] / scale[c] for c in (0, 1)) + rest)
    for t in scored:
        out = []
        for before, word in itertools.pairwise(["", *t]):
            one, two = [], []
            for c in (0, 1):
                p = (1 - passed_on) * max(under[c][word] - cut[c], 0) / max(1.0, mass[c]) + passed_on * shared.get(word, 0.5) / rest
                n = after[c][before]
                one.append(log(p))
                two.append(log((over[c].get((before, word), 0) + left[c][before] * p) / n) if n else log(p))
            out.append((one[1] - one[0], two[1] - two[0] - one[1] + one[0]))
        yield out


def test_every_pair_and_word_counts_for_itself(shipped):
    """With thousands of words and of pairs above their discount none is left out and none shares another's count."""
    rng = np.random.default_rng(5)
    phrases = [(f"w{i}", f"v{i}", f"w{j}") for i, j in enumerate(rng.integers(0, 4000, 4000))]
    docs = []
    for i in range(400):
        toxic = i % 4 == 0
        own = rng.integers(0, 1500, 500) if toxic else rng.integers(1000, 4000, 500)
        docs.append((i, " ".join(w for k in own for w in phrases[k]), int(toxic)))
    df = shipped.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df)
    counted = df.where((toxicity.fold("doc_id", 5) != 0) & (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(toxicity.CALIBRATION_PARTS)) != 0))
    learned = [(r["text"].split(), r["toxic"]) for r in counted.collect()]
    scored = [t.split() for _, t, _ in docs[:40]] + [["unseen", "w1", "unseen", "words"]]
    known = {r["toxic"]: r["n"] for r in df.where(toxicity.fold("doc_id", 5) != 0).groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    wanted = []
    for i, t in enumerate(scored):
        ratios = np.array(list(brute_ratios(learned, [t], known)))
        wanted.append((i, len(t), *(x for r in ratios.T for x in (r.sum(), np.maximum(r - 1, 0).sum(), np.minimum(r + 1, 0).sum()))))
    texts = shipped.createDataFrame([(i, " ".join(t)) for i, t in enumerate(scored)], "doc_id long, text string")
    assert model.passes == 1 and model.entries.where("kind = 2").count() > 2000 and np.abs(wanted).max() > 1
    for passes in (1, 3):
        found = toxicity.sums_of(texts, replace(model, passes=passes), "text", ["doc_id"]).collect()
        assert np.allclose(sorted((r["_c0"], r["_n"], *r["_sums"]) for r in found), wanted, rtol=1e-4, atol=1e-2)


def test_a_weighted_row_counts_as_many():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 2)), (rng.random(300) < 0.3).astype(float)
    times = np.where(y == 1, 1, 9)
    assert np.allclose(logistic.fit(x, y, weight=times.astype(float)), logistic.fit(np.repeat(x, times, axis=0), np.repeat(y, times)))


@pytest.mark.parametrize(("module", "bound"), [(toxicity, "CALIBRATION_ROWS"), (linecrf, "SAMPLE_ROWS")])
def test_scores_do_not_move_when_the_bound_is_reached(shipped, monkeypatch, module, bound):
    """One text in ten is marked and the texts overlap; the bound cuts the larger class to the size of the smaller."""
    rng = np.random.default_rng(7)
    docs = []
    for i in range(6000):
        mark = int(i % 10 == 0)
        words = np.where(rng.random(10) < (0.55 if mark else 0.4), "Dark!", "light")
        docs.append((i, " ".join(words), mark, mark))
    df = shipped.createDataFrame(docs, "doc_id long, text string, toxic int, quality int").repartition(4).cache()
    means = []
    for most in (10_000, {"toxicity": 60, "linecrf": 450}[module.__name__.split(".")[-1]]):
        monkeypatch.setattr(module, bound, most)
        means.append(module.score(df, module.train(df, df)).agg(F.avg("score")).first()[0])
    assert abs(log(means[1] / (1 - means[1])) - log(means[0] / (1 - means[0]))) < 0.7


def test_a_text_has_the_same_features_alone_and_in_a_batch():
    texts = ["ab", "zeta x", "", "é", "quo vadis", "ab"]
    hashed, begins, sizes, known = langid.features(texts)
    for i, text in enumerate(texts):
        alone, _, size, letters = langid.features([text])
        assert np.array_equal(hashed[:, begins[i] : begins[i] + sizes[i]], alone) and (sizes[i], known[i]) == (size[0], letters[0])
    assert hashed.shape[1] == sizes.sum()


def test_one_row_is_enough_to_name_a_language(shipped):
    df = shipped.createDataFrame([(i, t, "xx" if i == 4 else None) for i, t in enumerate(["abc", "", None, "12", "other words", "one text"])], "doc_id long, text string, lang string")
    assert zlib.crc32(b"4") % 4 != 2
    found = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in langid.predict(df, langid.train(df)).collect()}
    assert found == {0: ("xx", True), 1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("xx", True), 5: ("xx", True)}


def brute_grams(text):
    """Counts of the hashed n-grams of one to three letters of a text, all else a space and one more at the end."""
    lowered = text.lower()
    letters = langid.char_classes()
    codes = [ord(c) if letters[ord(c)] == 1 else 32 for c in lowered] + [32]
    codes = [*codes, *[32] * 2]
    found = Counter()
    for n, i in itertools.product((1, 2, 3), range(len(lowered) + 1)):
        h = n + sum(c * f for c, f in zip(codes[i : i + n], langid._FACTORS, strict=False))
        found[(h * langid._FACTORS[0] % (1 << 64)) >> (64 - langid.FEATURE_BITS)] += 1
    return found, any(letters[ord(c)] == 1 for c in lowered)


def brute_language(rows):
    """By id the probabilities of the languages: document frequencies, steps of one row after the other, temperature, with dictionaries."""
    learn = [(i, t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and x is not None]
    in_rows = Counter(f for _, t, _ in learn for f in brute_grams(t)[0])
    idf = {f: log((1 + len(learn)) / (1 + n)) + 1 for f, n in in_rows.items()}
    nowhere = log(1 + len(learn)) + 1

    def vector(text):
        found, _ = brute_grams(text)
        total = sum(found.values())
        return {f: langid.SCALE * n * idf.get(f, nowhere) / total for f, n in sorted(found.items())}

    names = sorted({x for _, _, x in learn})
    samples = [(names.index(x), vector(t)) for _, t, x in learn if brute_grams(t)[1]]
    samples.sort(key=lambda s: (s[0], list(s[1]), list(s[1].values())))
    z, n = [Counter() for _ in names], [Counter() for _ in names]

    def weight(c, f):
        if abs(z[c][f]) <= langid.L1:
            return 0.0
        return -(z[c][f] - np.sign(z[c][f]) * langid.L1) / ((langid.BETA + n[c][f] ** 0.5) / langid.ALPHA + langid.L2)

    def chances(v, temperature=1.0):
        e = np.array([sum(weight(c, f) * x for f, x in [*v.items(), ("bias", 1.0)]) for c in range(len(names))]) / temperature
        p = np.exp(e - e.max())
        return p / p.sum()

    apart, rest = samples[::5], [s for i, s in enumerate(samples) if i % 5]
    for epoch in range(langid.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rest)):
            label, v = rest[i]
            p = chances(v)
            for c in range(len(names)):
                for f, x in [*v.items(), ("bias", 1.0)]:
                    g = (p[c] - (c == label)) * x
                    sigma = ((n[c][f] + g * g) ** 0.5 - n[c][f] ** 0.5) / langid.ALPHA
                    z[c][f] += g - sigma * weight(c, f)
                    n[c][f] += g * g
    grid = np.exp(np.linspace(-3, 3, 241))
    at = int(np.argmin([-np.mean([log(chances(v, t)[label] + 1e-12) for label, v in apart]) for t in grid]))
    return {i: (chances(vector(t), grid[at]) if t is not None and brute_grams(t)[1] else None) for i, t, _ in rows}, names


def test_language_is_that_of_dictionaries(shipped):
    rng = np.random.default_rng(9)
    parts = {"aa": ["the", "and", "tion", "İx"], "bb": ["der", "und", "schön", "ß"], "cc": ["le", "où", "ment", "的"]}
    rows = [(i, " ".join(rng.choice(parts[x], 6)) + ("." if i % 3 else " 12\n"), x) for i, x in enumerate(np.tile(list(parts), 14).tolist())]
    rows += [(100, "", "aa"), (101, None, "bb"), (102, "12 .", "cc"), (103, "unseen wörds", None), (104, "de", None), (105, rows[4][1], "bb")]
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    wanted, names = brute_language(rows)
    for r in langid.predict(df, langid.train(df)).collect():
        p = wanted[r["doc_id"]]
        if p is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert r["score"] == pytest.approx(p.max(), abs=1e-3) and p[names.index(r["lang_pred"])] > p.max() - 1e-3
