import os

# Python workers import the package too, wherever the tests are started.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402


@pytest.fixture
def table(spark, tmp_path):
    """Rows written as a Parquet table of several files and read again."""
    made = []

    def make(rows, schema, files=3):
        path = str(tmp_path / f"t{len(made)}")
        made.append(path)
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)
    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(table):
    def make(texts, files=3, **columns):
        rows = [(i, t, columns.get("lang", {}).get(i), columns.get("source", {}).get(i), None)
                for i, t in enumerate(texts)]
        return table(rows, DOCS, files)
    return make
