"""The pipeline's language stage follows the network: what it rules out goes, what it holds possible is checked by byte pairs."""

import os
import random
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline  # noqa: E402
from wordloom.llm import langid, queries  # noqa: E402

SYLLABLES = {"aa": ["ka", "to", "mi", "ren", "sol"], "bb": ["zu", "gry", "wex", "plo", "dub"]}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return [" ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(40)) for _ in range(n)]


def tables(spark):
    rows = [(t, lang) for lang in SYLLABLES for t in texts(lang, 60, 0)]
    random.Random(2).shuffle(rows)
    docs = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)]
    docs += [(1000, None, "aa", "s", 0), (1001, "12 !", "aa", "s", 4), (1002, "", None, "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")


def test_a_language_that_the_network_rules_out_goes(spark, monkeypatch):
    docs = tables(spark)
    rows = docs.collect()
    kept = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect())
    assert kept == [r.doc_id for r in rows if r.doc_id < 1000]
    net = langid.train(docs.where(~queries.held_out()), langid.NetParams(least_steps=400))
    net.w["prior"] = np.array([50, 0], np.float32)  # now it is sure of aa, whatever the text
    monkeypatch.setattr(langid, "train", lambda *a, **k: net)
    kept = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect())
    assert kept == [r.doc_id for r in rows if r.doc_id < 1000 and r.lang == "aa"]
    net.w["prior"], net.w["out"] = np.zeros(2, np.float32), net.w["out"] * 0  # now it holds both as likely: byte pairs are asked for both
    kept = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect())
    assert kept == [r.doc_id for r in rows if r.doc_id < 1000]


def test_fitting_asks_only_possible_languages(spark):
    net = langid.train(tables(spark).where(~queries.held_out()), langid.NetParams(least_steps=400))
    some = pa.array([*texts("aa", 3, 1), *texts("bb", 3, 1), None, "12"])
    lang, _ = langid.labelled(net, some)
    assert list(lang) == ["aa"] * 3 + ["bb"] * 3 + ["und"] * 2
    assert list(langid.fitting(net, some, lang)) == [True] * 6 + [False] * 2
    wrong = np.array(["bb"] * 3 + ["aa"] * 3 + ["und"] * 2, object)
    assert not langid.fitting(net, some, wrong).any()
    assert list(langid.fitting(net, some, wrong, np.ones((8, 2), bool))) == [True] * 6 + [False] * 2
