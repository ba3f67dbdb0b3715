"""User dictionary tables on top of the packaged ones (S5, J5, X3), and the
stretch stage's missing lower-case branch (G5), which only shows with custom
values that carry capitals."""

from wordloom.operators.normalize import Normalizer
from wordloom.sources.csv_splits import scratch_folder
from wordloom.sources.dictionary import load_dictionary


def test_user_table_overrides_and_case_rules(spark):
    folder = scratch_folder(spark, "user-dict")
    rows = [("line", "key", "value"), ("0", "maass", "MixedCase"), ("1", "vdo", "clip"), ("2", "vdo", "Clip")]
    spark.createDataFrame(rows[1:], "line string, key string, value string").coalesce(1) \
        .write.option("header", True).csv(folder)
    d = load_dictionary(spark, custom=True, extra_paths=(folder,))
    entries = {r.key: (r.ord, r.value) for r in d.df.collect()}
    assert len(entries) == 193                                   # one new key
    assert entries["vdo"][1] == "Clip"                           # last entry wins ...
    assert entries["vdo"][0] < entries["maass"][0]               # ... first position kept

    words = ["maass", "maaaass", "maasx", "MAASS", "Maass", "vdo", "VDO"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "row_id long, text string")
    got = {r.row_id: r.text for r in Normalizer(d).normalize(df).collect()}
    assert [got[i] for i in range(len(words))] == [
        "mixedcase",   # exact, lower-case token -> value.lower()
        "MixedCase",   # stretch: no lower-case branch, value as is
        "mixedcase",   # fuzzy (distance 1 of 5), lower-case token
        "MIXEDCASE",   # upper
        "Mixedcase",   # title (str.title)
        "clip",
        "CLIP",
    ]
