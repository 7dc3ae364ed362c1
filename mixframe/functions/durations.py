"""Durations as written: clock times, ISO periods, plain seconds or milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, hms, let

# From here on a plain number is milliseconds: no mix lasts that many seconds.
MILLISECONDS_FROM = 1_000_000


def seconds_of(c) -> Column:
    """Whole seconds of a written duration; NULL when it cannot be read."""
    def read(s):
        part = lambda i: F.get(F.split(s, ":"), F.lit(i)).try_cast("int")
        iso = lambda unit: F.coalesce(F.regexp_extract(s, rf"(\d+){unit}", 1).try_cast("int"), F.lit(0))
        n = s.try_cast("double")
        return (F.when(s.rlike(r"^\d+:\d{1,2}:\d{2}$"), part(0) * 3600 + part(1) * 60 + part(2))
                .when(s.rlike(r"^\d+:\d{2}$"), part(0) * 60 + part(1))
                .when(s.rlike(r"^PT(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?$"), iso("H") * 3600 + iso("M") * 60 + iso("S"))
                .when(s.rlike(r"^\d+(?:\.\d+)?$"), F.floor(F.when(n >= MILLISECONDS_FROM, n / 1000).otherwise(n))))

    return let(F.regexp_replace(col(c), r"[\s ]+", ""), read).cast("int")


def with_durations(df, column: str = "raw"):
    s = seconds_of(column)
    return (df.withColumn("seconds", s).withColumn("clock", hms("seconds"))
            .withColumn("seconds_or_0", F.coalesce("seconds", F.lit(0))))
