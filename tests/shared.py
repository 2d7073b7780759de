"""Helpers of several tests."""

import tempfile
from collections import Counter


class Shelf:
    """Tables written in a temporary folder of the test."""

    def __init__(self, spark):
        self.spark, self.root = spark, tempfile.mkdtemp()

    def put(self, df, name):
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return round(v, 9) if isinstance(v, float) else v


def counted(rows, columns):
    return Counter(tuple(plain(r[c]) for c in columns) for r in rows)
