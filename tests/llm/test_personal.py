import random

import numpy as np
import pytest

from chronolens.llm import personal
from chronolens.llm.boosting import BoostedTrees
from chronolens.llm.personal import CUE, FORMAT, KINDS, PLACEHOLDERS, detector, redact, spans

GIVEN = ["Alda", "Bruno", "Celeste", "Dario", "Edwina", "Florin", "Greta", "Hanno"]
FAMILY = ["Ashcombe", "Bellweather", "Cranmoor", "Dunhollow", "Elmsworth", "Farrowby"]
FILLER = ["Open Closed", "build 552.552.5467", "ticket 7269-7269-176", "row 4036 of 4036393", "Chapter 9 Street Patterns", "pkg@1.4.8 valo", "Quarterly Harbour Report", "SKU 190-228674-X", "192.0.2.4:8030", "Sprint Review 12"]


def made(seed, n=400):
    """(text, {(kind, start)}) pairs from a few forms and look-alikes."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g, f = rng.choice(GIVEN), rng.choice(FAMILY)
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        forms = [
            ("Assignee {person}", {"person": rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}"])}),
            ("Tel. {phone}", {"phone": rng.choice([f"({d(3)}) 555-0{d(3)}", f"+49 30 {d(5)} {d(3)}", f"020 7946 0{d(3)}", f"+1 303 555 0{d(3)}"])}),
            ("{phone}", {"phone": f"+1 303 555 0{d(3)}"}),
            ("id {id_number} verified", {"id_number": rng.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"QQ {d(2)} {d(2)} {d(2)} C", f"{d(8)}K"])}),
            ("Address: {address}, Saltby", {"address": rng.choice([f"{d(2)} Quor Road", f"Tannweg {d(2)}", f"Calle Pinder {d(2)}"])}),
            ("To: {email}", {"email": rng.choice([f"{g.lower()}@example.org", f"{f.lower()} (at) example (dot) com"])}),
        ]
        text, truth = "", set()
        for _ in range(4):
            line, parts = rng.choice(forms) if rng.random() < 0.6 else (rng.choice(FILLER), {})
            for kind, value in parts.items():
                at = line.index("{" + kind + "}")
                truth.add((kind, len(text) + at))
                line = line.replace("{" + kind + "}", value)
            text += line + "\n"
        rows.append((text, truth))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = made(1)
    return detector(spark.createDataFrame([(t,) for t, _ in rows] + [(None,), ("",)], "text string"))


def test_held_out_accuracy(spark, model):
    rows = made(2)
    df = spark.createDataFrame([(i, t, "kept", "x") for i, (t, _) in enumerate(rows)], "id int, text string, own string, kind string")
    got = {(r.id, r.kind, r.start_pos) for r in spans(df, *model).collect()}
    want = {(i, k, s) for i, (_, truth) in enumerate(rows) for k, s in truth}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_redaction_keeps_the_rest(spark, model):
    rows = [(1, "Assignee Alda Cranmoor\nOpen Closed"), (2, None), (3, ""), (4, "plain " * 20_000 + "\nTel. (303) 555-0123"), (1, "Assignee Alda Cranmoor\nOpen Closed")]
    got = sorted((r.id, r.text) for r in redact(spark.createDataFrame(rows, "id int, text string"), *model).collect() if r.text)
    assert got[0] == got[1] == (1, f"Assignee {PLACEHOLDERS['person']}\nOpen Closed")
    assert got[-1][1] == "plain " * 20_000 + f"\nTel. {PLACEHOLDERS['phone']}"


def test_empty(spark):
    none = detector(spark.createDataFrame([], "text string"))
    assert spans(spark.createDataFrame([("a Tel. (303) 555-0123",)], "text string"), *none).count() == 0
    assert spans(spark.createDataFrame([], "k int, text string"), *none).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    t = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((t.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_labels_come_from_context_and_trees_see_format(model):
    assert CUE not in FORMAT
    found = model[0]
    for kind in KINDS:
        n, recall, precision = found.held_out[kind]
        assert n > 0 and recall > 0.8 and precision > 0.8, (kind, n, recall, precision)


def test_more_names_than_are_broadcast(spark, model, monkeypatch):
    rows = made(1)
    df = spark.createDataFrame([(t,) for t, _ in rows] * 2 + [(None,), ("",)], "text string")
    monkeypatch.setattr(personal, "NAMES_PART", 3)
    found, names = detector(df)
    assert names is not None and not found.names
    asked = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made(2, 80))] + [(-1, None), (-2, "")], "id int, text string")
    rows_of = lambda *m: {tuple(r) for r in spans(asked, *m).collect()}
    assert rows_of(found, names) == rows_of(*model) and rows_of(*model)
    clean = lambda *m: sorted((r.id, r.text) for r in redact(asked.where("text <> ''"), *m).collect())
    assert clean(found, names) == clean(*model)
