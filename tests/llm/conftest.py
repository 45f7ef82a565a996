import os

import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # Columns of the tables, and names that operators use inside.
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("block", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("terms", T.StringType()),
        T.StructField("_row", T.StringType()),
        T.StructField("_kept", T.StringType()),
        T.StructField("doc", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table with extra columns from (doc_id, text) rows."""

    def make(rows):
        full = [(i, t, None, "s", len(t or ""), "b", "l", "x", "r", "t", "_r", "_k", "d") for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) rows of the smallest tables."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*[c.to_pylist() for c in table.columns]))


WORDS = "alder birch cedar dogwood elm fir ginkgo hazel iris juniper kapok larch maple nutmeg oak pine".split()


def prose(seed, count):
    """Repeatable words."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "en", "ly", "ous"]) for _ in range(count))


#: NULL, empty, blank, ties, repeated rows, a NULL id, odd characters and one very long text.
def edge_rows():
    long = prose(7, 300_000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, prose(1, 60)), (7, prose(1, 60)),
        (7, prose(1, 60)), (None, prose(2, 40)), (8, "x" * 5000), (9, "Ünï \x85 côdé \U0001f600 \x00 end"),
        (10, long), (11, prose(1, 59) + " other"), (12, prose(3, 30)),
    ]
