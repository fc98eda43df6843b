import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("n_tokens", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("_k1", T.StringType()),
    ]
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts of a hostile little corpus: nulls, empties, copies, shared passages, periods, one long text."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    passage = words(rng, 60)
    out = [None, "", "   ", "\n", "one", "the end.", "aaaa" * 200, "ab " * 150, "é" * 300]
    out += base + [base[3], base[3], base[5].upper() + "!", base[7] + " " + passage, passage + "  " + base[8], words(rng, 20) + "\n" + passage.replace(" ", "\t")]
    long = words(rng, 4000)
    near = long.split()
    near[1000] = "changed"
    return [*out, long, " ".join(near), "tail \x1c odd\x85space　here <|endoftext|> ΑΣ"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "xx", "s", len(t or ""), None, 0.5, None, "k") for i, t in enumerate(texts)]
    rows.append((None, texts[12], None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
