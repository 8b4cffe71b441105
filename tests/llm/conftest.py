import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000 + "\n" + "x" * 50000

#: Nulls in every column, empty and long texts, repeated rows, ties.
EDGE = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, "The same line\nand more words here to read", "en", "a", 41),
    (3, "The same line\nand more words here to read", "en", "a", 41),
    (4, "The same line\nand more words here to read", "en", "b", 41),
    (None, "no id here at all", "en", "a", 17),
    (5, LONG, "en", None, len(LONG)),
    (6, "   \t\r\n \x0b\x0c ", "de", "a", 9),
    (7, "été 　 ñandú ß 漢字 🙂 ​", "fr", "b", 20),
    (8, "12345 67890 --- !!!", "es", "b", 19),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def own_names():
    """Every name that an operator gives a column: what the code passes to fresh_name, alias and withColumn."""
    import pathlib
    import re

    from vistalake import llm

    found = {"fp", "rid", "pos", "key", "h1", "n", "u", "v", "rep", "line_rid_r", "shard_o", "bucket_number_o"}
    for file in pathlib.Path(llm.__file__).parent.glob("*.py"):
        text = file.read_text()
        for call in re.findall(r"fresh_name\(\w+(?:\.columns)?, (?:\"(\w+)\"|x\) for x in \(([^)]*)\))", text):
            found.update(re.findall(r"\w+", " ".join(call)))
        found.update(re.findall(r"(?:alias|withColumn|withColumnRenamed)\(\"(\w+)\"", text))
    return found


@pytest.fixture(scope="session")
def clash(edge):
    """More columns, with names that operators might use themselves."""
    from pyspark.sql import functions as F

    out = edge
    for c in sorted(own_names() - {"text", "doc_id", "lang", "source", "n_chars", "toxic"}):
        out = out.withColumn(c, F.lit(1))
    return out


@pytest.fixture(scope="session")
def sample(spark):
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    return spark.read.parquet(path)
