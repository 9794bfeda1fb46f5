import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """(rows of (doc_id, text) or (doc_id, text, lang)) -> documents with columns
    whose names clash with those the operators make."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("key", "h", "id", "_sha", "shard", "slot", "size", "weight", "component", "seed", "ids", "spans", "print"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """Writes documents and further tables to a folder that queries can read."""

    def write(**tables):
        to = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{to}/{name}.parquet")
        return str(to)

    return write
