"""Small tables with the awkward rows every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False, parts=3):
        """rows: (doc_id, text); ``extra`` adds columns whose names an operator uses inside."""
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        if extra:
            from pyspark.sql import functions as F

            for name in ("shard", "block", "key", "node", "token", "digest", "kind", "label", "id", "_text"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


AWKWARD = [(1, None), (2, ""), (3, "  \n"), (4, "é😀 \x1c"), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id at all")]
