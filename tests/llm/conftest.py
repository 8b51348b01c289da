from __future__ import annotations

import pytest
from panelmill.llm.shipping import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def documents(spark):
    def make(texts, ids=None, sources=None, extra=()):
        """Rows of `documents`; extra: names of more columns, which hold 7."""
        ids = list(range(len(texts))) if ids is None else ids
        rows = [
            (i, text, "en", sources[k] if sources else f"s{k % 3}", None if text is None else len(text), *[7] * len(extra))
            for k, (i, text) in enumerate(zip(ids, texts))
        ]
        return spark.createDataFrame(rows, DOCS + "".join(f", `{name}` int" for name in extra))

    return make


def rows_of(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
