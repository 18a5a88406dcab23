import os

import duckdb
import pytest

SF = os.environ.get("RUNLENS_LLM_SF", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the test table, by id."""
    return sorted(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture()
def frame(spark):
    """Rows of (doc_id, text[, source]) as documents with extra columns that clash with names the operators use."""
    def make(rows):
        rows = [(*r, *["src"] * (3 - len(r)))[:3] for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        return df.selectExpr("*", "'xx' AS lang", "1 AS size", "2 AS score", "'k' AS kind", "3 AS n", "4 AS th", "5 AS x", "6 AS kept")
    return make


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id here"), (5, "same text " * 30), (6, "same text " * 30),
         (6, "same text " * 30), (7, "x" * 50_000), (8, "é\U0001f600 café " * 40), (9, "a b c d e f g " * 400)]
