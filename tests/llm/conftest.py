import pytest

#: Columns of documents, and others under names that the operators use themselves.
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, d string, h int, x array<int>, fp string, shard string, "
    "score double, n_lines string, count int, key string, t string, part string, media string, ids string, unit string"
)


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) pairs."""

    def make(rows):
        full = [(i, t, None, "src", None if t is None else len(t), "d", 1, [1], "fp", None, 0.5, "n", 3, None, "t", "p", "m", "i", "u") for i, t in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(3)

    return make


@pytest.fixture(scope="session")
def small():
    """The smallest tables as lists of rows."""
    import duckdb

    def read(name):
        return duckdb.connect().sql(f"select * from '/root/testdata/sf0.001/{name}.parquet'").fetchall()

    return read
