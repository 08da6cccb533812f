import pytest
from pyspark.sql import functions as F

ODD = ["_", "size", "node", "component", "uid", "kind", "part", "rank", "n", "text_key", "copies", "at", "slice"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``{id: text}`` or rows, with extra columns whose names operators use themselves."""

    def make(rows, source="s", lang="en"):
        if isinstance(rows, dict):
            rows = [(k, v) for k, v in rows.items()]
        full = [(r[0], r[1], r[2] if len(r) > 2 else source, r[3] if len(r) > 3 else lang) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string, lang string")
        return df.withColumns({c: F.lit(7) for c in ODD}).withColumn("n_chars", F.length("text").cast("long"))

    return make
