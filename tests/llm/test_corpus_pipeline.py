"""The pipeline's stages, each held against plain Python on what its predecessor kept."""

import base64
import os
import random
import sys
import zlib

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from wordloom.llm import langid, queries, tokenids  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs, rows = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.columns
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = tokenids.fresh_path(spark, "stage")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.collect()
        if name == "language_id":
            expected = [r for r in before if any(c.isalpha() for c in r[1] or "")]
        elif name == "near_dedup":
            group, _ = brute.groups([r[:2] for r in before], 5, 80)
            least = {g: min(r[0] for r, h in zip(before, group, strict=True) if h == g) for g in set(group)}
            expected = [r for r, g in zip(before, group, strict=True) if g is None or r[0] == least[g]]
        elif name == "decontamination":
            expected = [r for r in before if not brute.hits(r[1], items)[-1]]
        elif name == "mixing":
            by_id = {r[0]: r for r in before}
            expected = [by_id[i] for i, _, _ in brute.mixture(before, 0.9, 2.0)]
        if name != "token_ids":
            assert docs.columns == columns
            got = [(r.doc_id, r.text, r.source) for r in rows[name]]
            assert sorted(got) == sorted(expected), name
            before = got
    library = Tokenizer.from_file(queries.tokenizer_path())
    ids = [(r[0], library.encode(r[1], add_special_tokens=False).ids + [1]) for r in before]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows["token_ids"]) == sorted((i, len(x), brute.crc(x)) for i, x in ids)


def no_language():
    rng, letters = random.Random(11), "abcdefghijklmnopqrstuvwxyz"
    out = [" ".join("".join(rng.choices(letters, k=6)) for _ in range(n)) for n in (10, 60, 400)]
    for n in (40, 300, 3000):
        out += [rng.randbytes(n).hex(), base64.b64encode(rng.randbytes(n)).decode()]
    return [*out, "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。",
            "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_texts_in_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    blobs = no_language()
    ids = [i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 3 == 1]  # held out: not learned from, whatever the label
    for lang in (None, "en"):
        planted = docs.unionByName(spark.createDataFrame([(i, t, lang, "src0", len(t)) for i, t in zip(ids, blobs, strict=False)], docs.schema))
        got = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, planted, "").collect())
        assert got == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    net = langid.train(docs.where(~queries.held_out()))
    texts = pa.array([*blobs, "", "123 !"])
    lang, _ = langid.labelled(net, texts)
    assert all(lang[:len(blobs)] != "und") and not langid.fitting(net, texts, lang).any()
    predicted = langid.predict(docs, net).where("lang_pred <> 'und'").select("doc_id")
    assert sorted(r.doc_id for r in predicted.collect()) == got  # of the given rows, every one with a language stays


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
