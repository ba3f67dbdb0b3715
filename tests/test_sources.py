"""CSV scan with pandas NA rules (S1) against pandas itself; column roles (S3); video ids."""

import os
import tempfile

import pandas as pd
from pyspark.sql import types as T

from wordloom.sources import csv_splits as cs
from wordloom.sources.video import comments_for_videos

CSV = ('row_id,text,label\n'
       '1,None,a\n2,null,a\n3,NA,b\n4,"NA",b\n5,n/a,a\n6,,a\n7,"  pad ",b\n'
       '8,"line one\nline two",a\n9,"say ""hi""",b\n10,plain,NaN\n')


def test_scan_matches_pandas(spark):
    folder = tempfile.mkdtemp(prefix="wordloom-csv-", dir="/tmp")
    path = os.path.join(folder, "train.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(CSV)
    schema = T.StructType([T.StructField("row_id", T.LongType())])
    got = {r.row_id: (r.text, r.label) for r in cs.scan_splits(spark, {"train": path}, schema).collect()}
    want = pd.read_csv(path)
    for _, r in want.iterrows():
        t = None if pd.isna(r["text"]) else r["text"]
        lab = None if pd.isna(r["label"]) else r["label"]
        assert got[int(r["row_id"])] == (t, lab), r["row_id"]


def test_resolve_columns():
    s = T.StructType([T.StructField("id", T.LongType()), T.StructField("comment", T.StringType()),
                      T.StructField("category", T.StringType())])
    assert cs.resolve_columns(s) == ("comment", "category")
    s2 = T.StructType([T.StructField("id", T.LongType()), T.StructField("body", T.StringType()),
                       T.StructField("text", T.StringType())])
    assert cs.resolve_columns(s2) == ("body", "id")  # label missing: both fall back


def test_video_ids(spark):
    req = spark.createDataFrame([("https://www.youtube.com/watch?v=abc&t=3",), ("https://www.youtube.com/watch?v=zzz",)], "url string")
    feed = spark.createDataFrame([("abc", 0, "first"), ("abc", 1, "second"), ("xyz", 0, "other")],
                                 "video_id string, turn long, text string")
    got = sorted((r.url, r.turn) for r in comments_for_videos(req, feed).collect())
    assert got == [("https://www.youtube.com/watch?v=abc&t=3", 0), ("https://www.youtube.com/watch?v=abc&t=3", 1)]


def test_salted_request_join_equals_broadcast(spark, monkeypatch):
    from wordloom.sources import video

    req = spark.createDataFrame([(f"https://www.youtube.com/watch?v={v}",) for v in ("a", "b", "zz")], "url string")
    feed = spark.createDataFrame([("a", t, f"c{t}") for t in range(50)] + [("b", 0, "x"), ("q", 1, "y")],
                                 "video_id string, turn long, text string")
    cols = ["url", "video_id", "turn", "text"]
    broadcast = sorted(tuple(r) for r in video.comments_for_videos(req, feed).select(cols).collect())
    monkeypatch.setattr(video, "MAX_BROADCAST_REQUESTS", 0)
    salted = sorted(tuple(r) for r in video.comments_for_videos(req, feed).select(cols).collect())
    assert salted == broadcast and len(salted) == 51
