import pytest
from pyspark.sql import Row

# Column names that operators use inside, on purpose.
CLASHING = dict(score=0.5, node=1, key="k", row=2, component="c", batch="b", part=3, size=4, taken=5, text_hash=6, number=7, h1=8, items=["x"], hits=None, spans=None, copies=1)
LONG = " ".join(f"word{i % 977} part{i}" for i in range(40_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise men watch the river run slowly past the old mill near the bridge"


def odd_rows():
    """Null, empty, blank, very long and repeated texts, ties, and a null id."""
    texts = [
        (0, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, "ONE two"), (7, LONG), (8, LONG + " end"), (9, "x" * 30_000), (10, PASSAGE + " and the sun"),
        (11, "Grüße aus Köln, 東京 and über: " + PASSAGE), (12, "first line here\nsecond line here\n\n" * 4), (12, "first line here\nsecond line here\n\n" * 4), (13, 'token = "abcdefabcdefabcdef012345"'), (None, PASSAGE), (None, None),
    ]
    return [Row(doc_id=i, text=t, lang=None if i == 5 else "en", source=None if i in (4, 7) else f"s{(i or 0) % 3}", n_chars=None, **CLASHING) for i, t in texts]


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, node int, key string, row int, component string, batch string, part int, size int, taken int, "
    "text_hash int, number int, h1 int, items array<string>, hits string, spans string, copies int"
)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
