"""Operators 3, 4 and 8: classifiers and quality rules."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from layerkit.llm import common, nbsvm, queries, toxicity, weak_rules
from layerkit.llm.common import held_out, table
from tests.llm.conftest import ODD

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
INSULT, NEGATION, REPORT, TARGET, THREAT, INTENT = (
    toxicity.INSULT, toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.THREAT, toxicity.INTENT,
)


def test_held_out_rows(spark):
    ids = [None, -7, *range(200)]
    found = spark.createDataFrame([(i,) for i in ids], "i long").select("i", held_out(held_column()).alias("h")).collect()
    assert {r.i: r.h for r in found} == {i: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def held_column():
    from pyspark.sql import functions as F

    return F.col("i")


def test_dual_coordinate_descent_finds_the_minimum():
    random = np.random.default_rng(1)
    x = random.normal(size=(80, 6))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0, 3]) + random.normal(size=80) > 0, 1.0, -1.0)
    rows = [(np.arange(6), v) for v in x]
    w = nbsvm.dual_coordinate_descent(rows, y, 6, cost=0.5, passes=500, tolerance=1e-9)
    loss = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + step) + 1e-9 for step in random.normal(scale=0.05, size=(300, 6)))


def test_shapes():
    assert [nbsvm.shape(w) for w in ("the", "The", "THE!!", "of%%%", "a1b22", "|", "iPod", "A")] == ["a", "T", "A!", "a%", "a0a0", "|", "m", "T"]


def test_features_are_sets_per_text():
    rows, buckets = nbsvm.features(pa.array(["a b a b", "a b", None, ""]))
    by = [set(buckets[rows == i].tolist()) for i in range(4)]
    assert by[1] < by[0] and by[2] == by[3] and len(by[2]) > 0


@pytest.mark.parametrize("fit, score, label", [(nbsvm.fit, nbsvm.score, "quality"), (toxicity.fit, toxicity.score, "toxic")])
def test_classifiers_on_odd_input(spark, docs, fit, score, label):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, None), (5, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 1), (99, 1, 1), (10, 0, 1)], "doc_id long, quality int, toxic int",
    )
    for known in (labels, labels.limit(0)):
        scored = score(docs([*ODD, (12, "word " * 60_000)]), fit(docs(ODD), known, label), "own")
        found = scored.collect()
        assert len(found) == len(ODD) + 1 and all(0 <= r.own <= 1 for r in found)
        assert scored.columns == [*docs([]).columns, "own"] and {r.score for r in found} == {"own"}
    assert score(docs([]), fit(docs([]), labels, label)).count() == 0


@pytest.mark.parametrize("name, label, least", [("op3_quality_classifier", "quality", 0.95), ("op4_toxicity_grammar", "toxic", 0.85)])
def test_held_out_recall_and_precision(spark, name, label, least):
    """On the held-out rows of the largest table, label 1 is found, and what is found has it."""
    found = queries.QUERIES[name](spark, LARGE).join(table(spark, LARGE, "labels"), "doc_id").where("held_out").select("predicted", label).collect()
    true = sum(r.predicted == r[label] == 1 for r in found)
    assert sum(r[label] == 1 for r in found) > 50
    assert true >= least * sum(r[label] == 1 for r in found) and true >= 0.95 * sum(r.predicted for r in found)


def weight(text, stems=None):
    model = toxicity.Toxicity(stems or {})
    return model.matches(pa.array([text]))


def test_clauses_are_weighed():
    lone, aimed = weight("the moron is here")[0][2], weight("you are a moron")[0][2]
    # A word alone says next to nothing; a target, an opening or a second insult makes an insult of it.
    assert lone < 0.1 * aimed
    assert all(weight(t)[0][2] <= lone for t in ("take out the trash", "the clown at the circus made children laugh", "moron", "idiot"))
    assert all(weight(t)[0][2] > 5 * lone for t in ("what a moron is this", "such utter scum", "moron and idiot", "the moron that you are"))
    assert weight("a moron, that is what you are")[0][2] == lone  # another clause
    assert weight("he is not a moron")[0][2] < 0.6 * aimed
    assert weight("she said you moron to us")[0][2] < aimed
    assert weight("not many people here at all would say you moron")[0][2] == aimed  # too far away
    assert weight("what about that old moron")[0][2] == lone  # too far away
    assert weight("we will kill the process") and not weight("the kill switch")
    assert weight("I will kill you")[0][2] > weight("I will kill")[0][2]
    assert weight("nothing here") == [] and weight(None) == [] and weight("") == []


def test_learned_stems_count_from_their_beginning():
    assert weight("du bist loweichen hier", {"lowei*": 5.0})[0][2] == 6.0 and weight("das ist loweichen hier", {"lowei*": 5.0})[0][2] == 0.5
    assert not weight("das ist lowe hier", {"lowei*": 5.0})


def test_composition_equals_one_transducer_after_the_other():
    first = toxicity.Transducer({(0, NEGATION): (1, 0, 1.0, 0.0), (1, INSULT): (0, INSULT, 0.5, 0.0)})
    second = toxicity.Transducer({(0, TARGET): (1, 0, 1.0, 0.0), (1, INSULT): (1, INSULT, 1.0, 2.0)})
    both = first.then(second)
    random = np.random.default_rng(0)
    for _ in range(50):
        a = b = c = 0
        for symbol in random.integers(0, INTENT + 1, 12).tolist():
            a, middle, f, x = first.step(a, symbol)
            b, out, g, y = second.step(b, middle)
            c, got, h, z = both.step(c, symbol)
            assert (got, h, z) == (out, f * g, x * g + y)


def test_every_word_of_a_joined_text_is_read():
    plain, aimed = weight("moron")[0][2], weight("you moron")[0][2]
    for text in ("hello,moron", "well...moron", "a_moron", "1moron2", "so/what;moron", "this is,moron"):
        assert weight(text)[0][2] == plain
    assert weight("hello,moron")[0][1] == "moron" and weight("all, you-moron here")[0][1] == "you-moron here"
    for text in ("you-moron", "you\u00a0moron", "you\u3000moron", "“you”—moron"):
        assert [w for _, _, w in weight(text)] == [aimed]
    assert weight("not-a-moron")[0][2] == weight("not a moron")[0][2] < plain
    assert weight("one\u00a0of us,\u00a0you\u00a0moron.you\u3000idiot") == [(0, "you\u00a0moron.", aimed), (0, "you\u3000idiot", aimed)]
    words = "some plain words and then you moron".split()
    assert weight("\u00a0".join(words * 500))[0][2] == weight(" ".join(words * 500))[0][2] > aimed
    assert not weight("") and not weight("... 123 --") and weight("isn’t,moron")[0][2] == plain


def test_stems_are_learned_from_joined_texts(spark, docs):
    words = "one two three four five six seven eight".split()
    bad = [(i, f"{words[i % 8]},zzbad\u00a0{words[i % 7]}") for i in range(40)]
    plain = [(i, f"{words[i % 8]},fine\u00a0{words[i % 7]}") for i in range(40, 400)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs([*bad, *plain]), labels)
    assert "zzbad" in model.stems and "fine" not in model.stems
    assert (model.score(pa.array(["so,zzbad", "so,fine"])) > 0.5).tolist() == [True, False]


def test_a_group_of_copies_teaches_no_stem(spark, docs):
    copies = [(i, "this strange zzword stands alone") for i in range(0, 300)]
    plain = [(i, f"quite another text of number n{i}") for i in range(300, 600)]
    insults = [(i, f"left{i} zzbad{i} right") for i in range(600, 700)]
    labels = spark.createDataFrame([(i, int(i < 300 or i >= 600)) for i in range(700)], "doc_id long, toxic int")
    model = toxicity.fit(docs([*copies, *plain, *insults]), labels)
    assert "zzbad" in model.stems and not {"zzword", "alone", "stands"} & set(model.stems)


def test_texts_are_cut_into_runs_by_size():
    texts = pa.array(["a" * 10, None, "b" * 100, "", "c" * 3, "d" * 3])
    for size in (1, 8, 50, 1000):
        pieces = [p.to_pylist() for p in common.runs(texts, size)]
        assert [t for p in pieces for t in p] == texts.to_pylist()
        assert all(len(p) == 1 or sum(len(t or "") for t in p) <= size for p in pieces)
    assert list(common.runs(pa.array([], pa.string()))) == []


def test_a_worker_remembers_one_operator(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "_MEMORIES", {n: lambda n=n: freed.append(n) for n in "abc"})
    monkeypatch.setattr(common, "_AT_WORK", [])
    for name in "aabb":
        common.begin(name)
    assert freed == ["b", "c", "a", "c"]


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), again, len(covered)


def test_base_measures_against_brute_force(spark, docs):
    texts = [r.text for r in table(spark, SMALL, "documents").select("text").limit(150).collect()]
    rows = [*ODD, *enumerate(texts, 1000), (50, "a b c a b c a\nx\n\nx\n \n "), (51, "one two three " * 20_000), (52, "\n\n#\n#\x0b\n")]
    found = weak_rules.judge(docs(rows)).collect()
    got = sorted((str(r.doc_id), *(r[m] for m in weak_rules.MEASURES[:5]), r.base_failed) for r in found)
    want = []
    for i, t in rows:
        m = brute_measures(t)
        want.append((str(i), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want)
    assert not any(r.kept and r.base_failed for r in found)
    assert weak_rules.judge(docs([])).count() == 0


def test_rules_keep_good_and_reject_bad_documents(spark):
    found = queries.QUERIES["op8_weak_rules"](spark, SMALL).drop("quality").join(table(spark, SMALL, "labels"), "doc_id").collect()
    good, bad = ([r for r in found if r.quality == q and not r.base_failed] for q in (1, 0))
    assert np.mean([r.kept for r in good]) > 0.98 and np.mean([r.kept for r in bad]) < 0.1


def test_expectation_maximisation_finds_the_rules():
    random = np.random.default_rng(3)
    truth = random.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(random.random((4000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[random.random(votes.shape) < 0.2] = weak_rules.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_rules.fit_patterns(patterns, counts.astype(float))
    assert np.mean((model.posterior(votes) >= 0.5) == truth) > 0.93
    assert abs(model.good - 0.8) < 0.1
    assert weak_rules.fit_patterns(np.zeros((0, 5), int), np.zeros(0)).good == 0.5
