import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("fp", T.IntegerType()), T.StructField("Row_Key", T.StringType()),
])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with columns whose names the operators use inside."""
    from layerkit.llm.common import prepare

    prepare(spark)

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, None, "own", 7, "k") for i, t in rows], DOCS).repartition(parts)

    return make


# Nulls, blanks, odd characters, repeated rows, ties.
ODD = [
    (1, "The cat sat on the mat. The cat sat on the mat."), (2, None), (3, ""), (4, " \n\t "), (None, "no id at all"), (None, None),
    (5, "same text"), (5, "same text"), (6, "same text"), (7, "Ünïcödé ΑΣ İ 日本語 １２³ 🤖 é don't WE'LL"),
    (8, "<|endoftext|> inside<|startoftext|>x <|ENDOFTEXT|>"), (9, "a\x1cb c　d   e \x85"), (10, "!!!!!!!!!!!?? ---- aaaaaaaaaaa"),
    (-3, "negative id"),
]
