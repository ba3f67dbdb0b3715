"""Comments of requested videos (S10; the documented ``POST /analyze {url}``).

Re-aimed from a network download to a join: a table of request URLs is parsed
to video ids (``parse_url``) and joined to a comments table (or a file stream
of it).  A video without comments gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def video_id(url: Column) -> Column:
    """The ``v`` query parameter of a watch URL."""
    return F.parse_url(url, F.lit("QUERY"), F.lit("v"))


# Request tables up to this many rows are broadcast (after a count).
MAX_BROADCAST_REQUESTS = 1_000_000
# Beyond it: salts per video, so one video's comments spread over this many tasks.
SALT_BUCKETS = 64


def comments_for_videos(requests: DataFrame, feed: DataFrame, url_col: str = "url") -> DataFrame:
    """Every comment of every requested video: (url, video_id, feed columns...).

    A URL requested twice is answered once; two URLs of one video are two requests.

    The request table is counted first: under the bound it is broadcast, so the
    comment feed is streamed past it without a shuffle -- a video holding a
    third of all comments then costs nothing extra.  Beyond the bound it is a
    salted shuffle join: each comment gets a salt from a hash of its row, each
    request is repeated once per salt, so a hot video is spread over
    ``SALT_BUCKETS`` tasks instead of one.
    """
    r = requests.select(F.col(url_col).alias("url"), video_id(F.col(url_col)).alias("video_id")).distinct()
    if r.count() <= MAX_BROADCAST_REQUESTS:
        return feed.join(F.broadcast(r), "video_id", "inner")
    n = SALT_BUCKETS
    salted_feed = feed.withColumn("_salt", F.pmod(F.xxhash64(*feed.columns), F.lit(n)))
    salted_req = r.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return salted_feed.join(salted_req, ["video_id", "_salt"], "inner").drop("_salt")
