import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from texts; ids are spread and extra columns clash with the operators' own."""

    def build(texts, langs=None):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, sig string"
        rows = [(3 * i, t, langs[i] if langs else "en", "src", len(t or ""), i, "s") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema).repartition(3)

    return build
