import random

import numpy as np
import pytest

from chronolens.llm.subjects import learn_accuracies, posterior, subjects_of

TERMS = {s: [f"{s}{a}{b}" for a in "abcdef" for b in "xy"] for s in ("sport", "law", "music")}


def made(seed, n=300):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for d in range(n):
        own = rng.sample(sorted(TERMS), rng.choice([1, 1, 2]))
        lines = []
        for s in own:
            for _ in range(4):
                a, b = rng.sample(TERMS[s], 2)
                lines.append(f"Spent time on the {a} and checked the {b} twice.")
        lines += ["Idle for 5 minutes, then back.", f"Dragged the shortcut {rng.choice(['All of Sport', 'Law'])} away."]
        rng.shuffle(lines)
        docs.append((d, " ".join(lines), f"src{d % 5}", "clash"))
        truth[d] = set(own)
        if d % 3 == 0:
            wrong = rng.random() < 0.08
            labels += [(d, s) for s in ([rng.choice(sorted(TERMS))] if wrong else own)]
    return docs, labels, truth


SUBJECTS = [("sport", "All of Sport"), ("law", "Law"), ("music", None), (None, "x")]


def run(spark, docs, labels, subjects=SUBJECTS, **more):
    return subjects_of(
        spark.createDataFrame(docs, "doc_id long, text string, source string, subject string"),
        spark.createDataFrame(subjects, "subject_code string, title string"),
        spark.createDataFrame(labels, "doc_id long, subject_code string"),
        **more,
    )


def test_held_out_accuracy(spark):
    docs, labels, truth = made(1)
    docs += [(900, None, None, "c"), (901, "", "s", "c"), (902, "Idle for 5 minutes.", None, "c"), (None, docs[0][1], "s", "c"), (903, docs[0][1] * 300, "s", "c")]
    labels += [(12345, "law"), (0, "unknown"), (None, "law"), labels[0]]
    got = {}
    for r in run(spark, docs, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_code)
    unseen = [d for d in truth if d % 3]
    assert sum(got.get(d) == truth[d] for d in unseen) / len(unseen) > 0.97
    assert got[903] == truth[0] and not {900, 901, 902, None} & set(got)


def test_no_labels_or_documents(spark):
    docs, labels, _ = made(2, 20)
    assert run(spark, docs, []).count() == 0
    assert run(spark, [], labels).count() == 0
    assert run(spark, docs, labels, []).count() == 0


def test_accuracies_are_learnt():
    rng = np.random.default_rng(0)
    true = rng.integers(0, 5, 4000)
    votes = np.stack([np.where(rng.random(4000) < a, true, rng.integers(0, 5, 4000)) for a in (0.9, 0.7, 0.6, 0.2, 0.2)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    right = learn_accuracies(patterns, counts.astype(float), 5)
    assert right[0] > right[1] > right[3]
    assert (posterior(votes, right, 5).argmax(1) == true).mean() > 0.88


def test_a_lexicon_in_parts_gives_the_same_rows(spark):
    docs, labels, _ = made(3, 120)
    rows = lambda **more: sorted(tuple(r) for r in run(spark, docs, labels, **more).collect())
    whole = rows()
    assert whole and rows(part=11) == whole


def test_titles_and_words_in_any_script(spark):
    docs = [(d, f"Über das Verfassungsgericht straße{d % 7} ließ sich ПРАВО lesen. Das Urteil straße{d % 7} gilt.", None, "c") for d in range(40)]
    docs += [(100 + d, f"Die Geige spielt Sonate{d % 7} laut. Eine Sonate{d % 7} für Geige.", None, "c") for d in range(40)]
    labels = [(d, "law") for d in range(0, 40, 2)] + [(100 + d, "music") for d in range(0, 40, 2)]
    got = {r.doc_id: r.subject_code for r in run(spark, docs, labels, [("law", "право"), ("music", None)]).collect()}
    assert {got.get(d) for d in range(40)} == {"law"} and {got.get(100 + d) for d in range(40)} == {"music"}


def test_too_many_subjects_are_refused(spark):
    docs, labels, _ = made(2, 5)
    with pytest.raises(ValueError):
        run(spark, docs, labels, [(f"s{i}", None) for i in range(2_001)])
