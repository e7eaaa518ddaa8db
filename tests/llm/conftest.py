import pytest

DATA = "/root/testdata/sf0.001"

#: Null, empty and blank texts, one repeated row, a null id, and a long text.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "same words here again and again"), (4, "same words here again and again"), (None, "no id but words"), (5, "long " * 30000), (6, "漢字 ▁ é \U0001f389 a|b")]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names are those of results and of internals."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(EDGE, "doc_id long, text string")
    clash = ["n_words", "fp", "score", "shard", "slot", "k0", "r0", "id", "size", "t", "w", "features", "ids", "component_id", "kept", "c.d", "lang", "label", "tw_id"]
    return d.withColumns({("`c.d`" if c == "c.d" else c): F.lit("x") for c in clash if c != "c.d"})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
