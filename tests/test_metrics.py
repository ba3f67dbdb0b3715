"""Labels and metrics (A5-A9, P3, G14) against plain-Python definitions."""

import random

from pyspark.sql import functions as F

from wordloom.operators import labels as lb
from wordloom.operators import metrics as mx


def _data(n=400, seed=3):
    rnd = random.Random(seed)
    classes = ["hope", "non_hope", "other"]
    rows = []
    for i in range(n):
        split = "train" if i % 10 < 8 else ("val" if i % 10 == 8 else "test")
        truth = rnd.choice(classes)
        if split != "train" and i % 37 == 0:
            truth = "unseen"  # G14: a label the train split never had
        pred = truth if rnd.random() < 0.6 else rnd.choice(classes)
        rows.append((i, split, truth, pred))
    return rows


def test_mapping_first_appearance_and_unseen_label(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "row_id long, split string, label string, pred string")
    mapping = lb.label_mapping(df.filter(F.col("split") == "train"))
    order = []
    for _, split, truth, _ in rows:
        if split == "train" and truth not in order:
            order.append(truth)
    assert sorted((r.idx, r.label) for r in mapping.collect()) == list(enumerate(order))
    enc = {r.row_id: r.label_idx for r in lb.encode_labels(df, mapping).collect()}
    for i, _, truth, _ in rows:
        assert enc[i] == (order.index(truth) if truth in order else None)


def test_report_and_confusion_match_definitions(spark):
    rows = [r for r in _data() if r[1] == "test"]
    df = spark.createDataFrame(_data(), "row_id long, split string, label string, pred string")
    mapping = lb.label_mapping(df.filter(F.col("split") == "train"))
    m = {r.label: r.idx for r in mapping.collect()}
    enc = lb.encode_labels(lb.encode_labels(df, mapping), mapping, label_col="pred", out_col="pred_idx")
    test = enc.filter(F.col("split") == "test")
    got = {r["class"]: r for r in mx.classification_report(test, mapping).collect()}

    pairs = [(m[t], m[p]) for _, _, t, p in rows if t in m]
    total = len(pairs)
    f1s, precs, recs, sups = [], [], [], []
    for label, c in m.items():
        tp = sum(1 for t, p in pairs if t == c and p == c)
        predicted = sum(1 for _, p in pairs if p == c)
        support = sum(1 for t, _ in pairs if t == c)
        prec = tp / predicted if predicted else 0.0
        rec = tp / support if support else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        r = got[label]
        assert (r.support, round(r.precision, 12), round(r.recall, 12), round(r.f1_score, 12)) == (
            support, round(prec, 12), round(rec, 12), round(f1, 12))
        precs.append(prec); recs.append(rec); f1s.append(f1); sups.append(support)
    acc = sum(1 for t, p in pairs if t == p) / total
    assert round(got["accuracy"].f1_score, 12) == round(acc, 12) and got["accuracy"].support == total
    assert round(got["macro avg"].f1_score, 12) == round(sum(f1s) / len(f1s), 12)
    assert round(got["weighted avg"].recall, 12) == round(sum(r * s for r, s in zip(recs, sups)) / total, 12)

    cm = {r.true_idx: [r[f"pred_{i}"] for i in range(len(m))] for r in mx.confusion_matrix(test, mapping, len(m)).collect()}
    for c in m.values():
        assert cm[c] == [sum(1 for t, p in pairs if t == c and p == j) for j in range(len(m))]

    accs = {r.split: r.accuracy for r in mx.accuracy(enc, "label_idx", "pred_idx", by=("split",)).collect()}
    assert round(accs["test"], 12) == round(acc, 12)


def test_many_classes_have_the_long_form(spark):
    import pytest

    rows = spark.createDataFrame([(i % 1500, (i * 7) % 1500) for i in range(6000)] + [(None, 3)], "label_idx int, pred_idx int")
    with pytest.raises(ValueError, match="confusion_pairs"):
        mx.confusion_matrix(rows, spark.createDataFrame([("a", 0)], "label string, idx int"), 1500)
    pairs = mx.confusion_pairs(rows).collect()
    assert sum(r.n for r in pairs) == 6000 and len(pairs) == 1500
