import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \n\t ", "a", "One two", "é ñ ü", "#*$ !!", "word " * 400, "x" * 5000, "same words here\nsame words here\n" * 30]


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text), or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(*r, *(None, None)[: 4 - len(r)]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1])) for r in full], SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and long texts, repeated rows and ids, and a null id."""
    rows = [(i, text, "en" if i % 2 else None, "s" if i % 3 else None) for i, text in enumerate(ODD)]
    return docs([*rows, rows[7], rows[7], (7, "another text of the same id", None, None), (None, "no id", "en", "s"), (None, None, None, None)])


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
