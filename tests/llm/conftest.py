import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one long text."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four"), (5, "one two three four"), (5, "one two three four"),
            (6, long), (7, long + " tail"), (None, "no identifier here at all"), (8, "été à Žilina ẞ 漢字 mixed Text"), (9, "A"), (10, None)]
