import pytest

#: Rows that every operator has to take: nulls, empty and blank texts, ties, repeated rows and a long text.
ROWS = [
    (1, "One line of plain words here.\nshort\nAnother line that comes twice here.", "en", "src0", 70),
    (2, "Another line that comes twice here.\nshort\nOne line of plain words here.", "en", None, None),
    (3, None, None, "src1", 0),
    (4, "", "de", "src1", 0),
    (5, " \n\t\n ", "de", "src0", 5),
    (5, " \n\t\n ", "de", "src0", 5),
    (6, "One line of plain words here.\nshort\nAnother line that comes twice here.", "en", "src0", 70),
    (7, "You are such an idiot and a moron, you stupid clown!!", "en", "src2", 53),
    (None, "A row without an id stands here.", "en", "src2", 32),
    (None, "A row without an id stands here.", "en", "src2", 32),
    (8, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "en", "src0", 0),
    (9, " ".join(f"w{i % 977}x{i}" for i in range(29_900)), "en", "src3", 0),
    (10, "été ß İstanbul 😀 tail\r\nend".encode("utf-16", "surrogatepass").decode("utf-16"), "fr", "src3", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("rank", "node", "size", "row", "shard", "label", "features", "_text", "slot", "count", "score", "keep_id", "text_hash", "norm", "doc"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
