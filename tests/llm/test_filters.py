"""Quality rules, quality grades, toxicity and language."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import language, quality_model, quality_rules, toxicity
from evidentia.llm.common import repeated_words, WORD_HASHES
from evidentia.sources.tables import load_table
from tests.llm.cases import LONG, ODD_ROWS, docs_table, labels_table, no_docs, odd_docs, random_texts

SF = "/root/testdata/sf0.001"


def naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    phrase = "a b c d e f g h i "
    for text in [*random_texts(500, 5), "", phrase * 3, phrase + "x " + phrase, "l1\nl2\nl1\n\n\nl1 \n", "z " * 20, LONG]:
        assert quality_rules.base_counts(text, text.encode().split()) == naive_counts(text)
    assert repeated_words(WORD_HASHES.of(b"a b".split())) == 0


def naive_distance(p, q):
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum((part(x, y) + part(y, x)) / 2 for x, y in zip(p, q))))


def test_rules_against_brute_force(spark):
    rng = random.Random(1)
    common = ["the", "of", "and", "to"]
    rows = [(i, " ".join(rng.choice(common + [f"w{rng.randrange(500)}"]) for _ in range(150)), "en") for i in range(30)]
    rows += [(50, "A " * 10 + "%% " * 140, "en"), (51, " ".join(f"ABC{i}" for i in range(150)), "en"), (52, "kurz", "de")]
    got = {r.doc_id: r for r in quality_rules.judge(docs_table(spark, rows), top=3).collect()}
    counts = Counter(w for _, t, lang in rows if lang == "en" for w in t.split())
    top = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]]
    scale = quality_rules.SCALE
    hists = {}
    for i, t, lang in rows:
        words = t.split()
        c = quality_rules.class_counts(t)
        w = [words.count(x) for x in top] if lang == "en" else []
        w = [*w, len(words) - sum(w)] if lang == "en" else [0, 0, 0, len(words)]
        hists[i] = [x * scale // sum(c) for x in c.tolist()], [x * scale // len(words) for x in w]
    long_en = [i for i, t, lang in rows if lang == "en" and len(t.split()) >= 20]
    mean = [[sum(hists[i][k][j] for i in long_en) // len(long_en) for j in range(len(hists[0][k]))] for k in (0, 1)]
    for i, t, lang in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == naive_counts(t)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        if lang == "en":
            expected = [naive_distance([x / scale for x in hists[i][k]], [x / scale for x in mean[k]]) for k in (0, 1)]
            assert r.class_distance == pytest.approx(expected[0]) and r.word_distance == pytest.approx(expected[1])
            assert r.kept == (not failed and r.class_distance <= 0.28 and r.word_distance <= 0.42)
        else:
            assert r.class_distance is None and r.word_distance is None and r.base_failed and not r.kept
    assert all(got[i].kept for i in range(30)) and not got[50].kept and not got[51].kept


def test_rules_on_odd_rows(spark):
    got = quality_rules.judge(odd_docs(spark)).collect()
    expected = sorted((i is None, i or 0, *naive_counts(t or "")) for i, t, _ in ODD_ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, *[r[c] for c in quality_rules.BASE]) for r in got) == expected
    assert all(r.kept is not None and r.base_failed is not None for r in got)
    assert quality_rules.judge(no_docs(spark)).count() == 0


def test_common_words_do_not_depend_on_partitions(spark):
    """A word that is rare in one part of the rows counts there too."""
    filler = lambda k: " ".join(f"w{k}x{i}" for i in range(4990))
    rows = [(0, "the " * 5000 + "x " * 4 + filler(0), "en"), (1, "the " * 5000 + "x " * 5 + "y " * 6 + filler(1), "en")]
    for parts in (1, 2):
        docs = docs_table(spark, rows).repartitionByRange(parts, "doc_id")
        assert quality_rules.common_words(docs, 2).first().words == ["the", "x"]


@pytest.mark.parametrize("limit", ["LONG", "WIDE"])
def test_long_word_tables_lose_nothing(monkeypatch, limit):
    monkeypatch.setattr(quality_rules, limit, 20)
    rng = random.Random(3)
    rows = [(rng.choice(["en", None]), " ".join(f"w{rng.randrange(60)}" for _ in range(15))) for _ in range(200)]
    batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": t} for a, t in rows[i : i + 10]]) for i in range(0, 200, 10)]
    parts = list(quality_rules._counted(iter(batches)))
    got = Counter()
    for r in pa.Table.from_batches(parts).to_pylist():
        got[r["lang"], r["word"]] += r["n"]
    assert len(parts) > 10 and got == Counter((a, w) for a, t in rows for w in t.split())


def test_ordinal_gradients():
    """The fitted model is where small moves of any weight make the penalised likelihood worse."""
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 6, 4), rng.random(4)) for _ in range(300)]
    grades = np.array([min(2, int(max(0, v[a == 1].sum() * 2 + v[a == 2].sum() * 2 + rng.normal(0, 0.2)))) for a, v in rows])
    model = quality_model.train(rows, grades, np.ones(300), steps=3000, penalty=1e-3)
    assert (np.diff(model.thresholds) > 0).all()

    def loss(w):
        places = np.array([w[a] @ v for a, v in rows])
        p = np.hstack([np.ones((300, 1)), 1 / (1 + np.exp(model.thresholds - places[:, None])), np.zeros((300, 1))])
        k = np.arange(300)
        return -np.log(p[k, grades] - p[k, grades + 1]).mean() + 0.5e-3 * (w * w).sum()

    best = loss(model.weights)
    for j in range(6):
        for d in (-0.05, 0.05):
            w = model.weights.copy()
            w[j] += d
            assert loss(w) > best
    above = model.above(np.array([-1.0, 0.0, 2.0]))
    assert (np.diff(above, axis=1) < 0).all() and (np.diff(above, axis=0) > 0).all()


def graded(spark, n=400):
    rng = random.Random(2)
    words = [f"wort{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        bad, toxic = i % 4 == 0, i % 4 == 1
        if bad:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["nastyan", "nastyer", "nastyou", "vile"])
        docs.append((i, " ".join(text), rng.choice(["en", "fr"])))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return docs_table(spark, docs), labels_table(spark, labels + [(None, 1, 0), (10**6, 1, None), (3, None, None)])


def test_quality_grades(spark):
    docs, labels = graded(spark)
    model = quality_model.fit(docs, quality_model.ratings_of(labels))
    got = {r.doc_id: r for r in quality_model.grade_rows(docs, model).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(400))
    assert {i for i in got if got[i].held_out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    odd = quality_model.grade_rows(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD_ROWS) and all(r.kept is not None for r in odd)
    assert quality_model.grade_rows(no_docs(spark), model).count() == 0
    none = quality_model.fit(docs, quality_model.ratings_of(labels.limit(0)))
    assert none is None and all(r.kept and r.expected_grade is None for r in quality_model.grade_rows(docs.limit(3), none).collect())


def test_toxicity(spark):
    docs, labels = graded(spark, 1200)
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_rows(docs, net).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(held)
    assert sum(got[i].predicted == int(i % 4 == 1) for i in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 and r.flagged == (r.score >= r.threshold) for r in got.values())
    assert set(net.thresholds) <= {"en", "fr"} and all(0.2 <= t <= 0.8 for t in net.thresholds.values())
    swapped = toxicity.score_rows(docs.selectExpr("doc_id", "text", "'xx' AS lang"), net).collect()
    assert all(r.score == got[r.doc_id].score and r.threshold == 0.5 for r in swapped)
    odd = toxicity.score_rows(odd_docs(spark), net).collect()
    assert len(odd) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id in (1, 2, 7)}) == 1
    assert toxicity.score_rows(no_docs(spark), net).count() == 0
    untrained = toxicity.fit(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score_rows(docs.limit(5), untrained).collect())


def test_toxicity_scores_are_plain_convolutions():
    rng = np.random.default_rng(7)
    net = toxicity.WordNet.start()
    texts = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 2, 3, 50, 700)]
    for span in (64, 20_000):
        got = net.scores(texts, net.projected(), span)
        for t, s in zip(texts, got):
            x = np.hstack([net.by_word[t >> np.uint32(16)], net.by_start[t & np.uint32(0xFFFF)]])
            x = np.vstack([x, np.zeros((3, x.shape[1]), np.float32)])
            pooled = [max([sum(x[i + j] @ k[j, :, f] for j in range(len(k))) + b[f] for i in range(max(1, len(t)))] + [0]) for k, b in zip(net.filters, net.biases) for f in range(8)]
            assert s == pytest.approx(1 / (1 + math.exp(-(np.array(pooled) @ net.weights + net.intercept[0]))), abs=1e-4)


def test_thresholds():
    rows = [("en", 0, i / 1000) for i in range(200)] + [("en", 1, 0.9)] * 5 + [("fr", 0, 0.1)] * 3 + [(None, 0, 0.1)] * 50
    found = toxicity.calibrated(rows, most=0.01)
    assert set(found) == {"en"} and found["en"] == 0.2
    assert toxicity.calibrated([("en", 0, 0.6)] * 100)["en"] > 0.6


def test_thresholds_of_a_table(spark):
    rng = random.Random(4)
    rows = [(lang, rng.choice([rng.random(), 0.55])) for lang, n in (("en", 3000), ("fr", 19), ("de", 20), (None, 100), ("it's", 150)) for _ in range(n)]
    expected = toxicity.calibrated([(lang, 0, s) for lang, s in rows])
    clean = spark.createDataFrame(rows, "lang string, score double")
    assert set(expected) == {"en", "de", "it's"}
    assert toxicity.calibrated_table(clean) == toxicity.calibrated_table(clean, together=2) == expected


def test_thresholds_cover_all_labelled_documents(spark):
    """A language of few documents has its threshold next to a large one, and long documents count."""
    docs, labels = graded(spark, 200)
    held = [i for i in range(1000, 40_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    few, long = held[:25], held[25:50]
    more = [(i, "vile " * 6000 if i in long else "wort1 wort2 wort3 wort4", "few" if i in few else "long" if i in long else "en") for i in held]
    table = docs.unionByName(docs_table(spark, more))
    net = toxicity.fit(table, labels.unionByName(labels_table(spark, [(i, 1, 0) for i in held])))
    assert set(net.thresholds) == {"en", "few", "long"}
    scores = {r.doc_id: r.score for r in toxicity.score_rows(table, net).collect()}
    for lang, ids in (("few", few), ("long", long)):
        assert net.thresholds[lang] == toxicity.calibrated([(lang, 0, scores[i]) for i in ids])[lang]


def test_language_windows():
    for n in (0, 1, 255, 256, 257, 512, 1000):
        raw = bytes(i % 251 + 1 for i in range(n))
        cuts = language.cut_windows(raw)
        assert cuts.shape == (max(1, -(-n // 256)), 256)
        assert bytes(cuts.reshape(-1))[: n // 256 * 256] == raw[: n // 256 * 256] and (n < 256 or bytes(cuts[-1]) == raw[-256:])


def test_language_network():
    """Gradients against differences, and the tables of byte pairs against plain convolutions."""
    rng = np.random.default_rng(3)
    net = language.ByteNet.start(["a", "b", "c"])
    batch, target = rng.integers(1, 256, (6, 256), dtype=np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -net.log_probabilities(batch, net.tables())[np.arange(6), target].mean()
    gradients = net.gradients(batch, target)
    for p, g in zip(net.parameters(), gradients):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.25, abs=1e-3)
    k = net.filters[1]
    x = net.embedding[batch]
    plain = sum(x[:, j : 256 - 3 + j] @ k[j] for j in range(4)).max(1)
    pairs = batch[:, :-1].astype(int) * 256 + batch[:, 1:]
    quick = (net.tables()[1][0][pairs[:, :-2]] + net.tables()[1][1][pairs[:, 2:]]).max(1)
    assert np.allclose(plain, quick, atol=1e-4)


@pytest.fixture(scope="module")
def documents(spark):
    return load_table(spark, f"{SF}/documents.parquet")


def test_language_accuracy(spark, documents):
    net = language.fit(documents)
    got = language.identify(documents, net).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    odd = {(r.doc_id, r.lang_pred) for r in language.identify(odd_docs(spark), net).collect()}
    assert {(1, "und"), (2, "und"), (7, "und"), (8, "und")} <= odd and not any(p == "und" for i, p in odd if i in (3, 4, 5, 6, 9))
    assert language.identify(no_docs(spark), net).count() == 0
    assert language.fit(no_docs(spark)) is None
    assert {r.lang_pred for r in language.identify(odd_docs(spark), None).collect()} == {"und"}
