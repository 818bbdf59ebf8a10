import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that clash with columns that operators add.
        T.StructField("score", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("copy_index", T.StringType()),
    ]
)

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def texts():
    """Texts with copies, near copies, blanks, nulls, ties and very long ones."""
    words = BASE.split()
    long = " ".join(words[(i * i) % 24] + str(i % 97) for i in range(6000))
    near = long.split()
    near[100] = "changed"
    return [
        BASE, BASE, "  ".join(words), BASE + " extra", None, "", " \n\t ", "one two", "one two", "ONE two", "é ü ß Ω 漢字 🙂", long, " ".join(near), long,
        " ".join(words[:12] + ["x"] + words[12:]), "a", " nbsp text", "don't stop 12345 !!! <|endoftext|> end", "tab\tnew\nline " * 40,
    ]


def frame(spark, rows):
    extra = ("s", "p", "i", "d", "c")
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), *extra) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3]) for i, t in enumerate(texts())]
    rows += [(3, BASE, "en", "a"), (3, BASE, "en", "a"), (None, BASE, "en", "a"), (None, "only here", "de", "b")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
