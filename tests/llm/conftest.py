import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark, tmp_path):
    """Makes a documents table of texts or (id, text) pairs, read from Parquet as the operators' input is."""

    def make(rows, extra=""):
        data = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
        full = [(i, t, None, "s", None if t is None else len(t)) for i, t in data]
        folder = str(tmp_path / f"documents{len(list(tmp_path.iterdir()))}.parquet")
        spark.createDataFrame(full, SCHEMA).repartition(2, "doc_id").write.parquet(folder)
        return spark.read.parquet(folder)

    return make
