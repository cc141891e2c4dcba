import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    base = "the quick brown fox jumps over the lazy dog while nine grey cats sleep under an old tree near the river bank"
    rows = [
        (1, base, "en", "a"),
        (2, base.upper(), "en", "a"),
        (3, base.replace(" ", "  \n"), "en", "a"),
        (4, base + " today", "en", "b"),
        (5, None, None, "b"),
        (6, "", "de", None),
        (7, "   \t\n", "de", None),
        (8, "Straße über Äpfel, 日本語 и кот! don't <|endoftext|> 😀", None, "c"),
        (9, "one two three", "fr", "c"),
        (10, ("word%d " % 7) * 20_000, "en", "c"),
        (10, ("word%d " % 7) * 20_000, "en", "c"),
        (None, "no identifier here at all", "en", "c"),
        (12, "This work is licensed under the GNU General Public License, version 3. All rights reserved. CC BY", "en", "d"),
        (13, "12 34 -- ;;", "en", "d"),
        (14, " ".join(f"w{i}" for i in range(3000)), "es", "d"),
        (15, " ".join(f"w{i}" for i in range(2990)), "es", "d"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as digest", "'x' as kept", "2 as bucket", "3 as shard", "4 as Row", "5 as n_chars")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
