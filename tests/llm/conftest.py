from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) tuples, with columns that an operator might use itself."""

    def make(rows, partitions: int = 2):
        full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)
        clashing = [f"'x' AS {c}" for c in ("kept", "node", "score", "words", "value", "spans", "length", "key", "n")]
        return df.selectExpr("*", *clashing).repartition(partitions)

    return make
