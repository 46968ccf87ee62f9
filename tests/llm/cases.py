"""Small tables with everything that goes wrong in real ones."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = ["".join(random.Random(i).choices("abcdefghijklmnop", k=3 + i % 6)) for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows and ids, characters outside the first plane."""
    long_text = prose(7, 30_000) + "\n" + "x" * 5_000 + "\n" + "\n".join(["one line that is long enough to be counted as shared"] * 50)
    return [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 35), (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 35),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n\x0b\x0c\r ", "en", "b", 7), (None, "no id at all, but words", "en", "b", 3),
        (5, "ALPHA BETA GAMMA DELTA EPSILON ZETA", "en", "c", 35), (6, "one two", None, "c", 7), (7, "one two", "de", None, 7),
        (8, long_text, "en", "a", len(long_text)), (9, "émoji \U0001f600 \U0001f600 ñandú ÄÖÜ ß İ ſ K", "es", "b", 20),
        (10, "!!! ??? 12345 678", "en", "c", 17), (11, "same id, other text", "en", "a", 3), (11, "same id, second text", "en", "a", 3),
        *[(20 + i, f"unique start {i}\n  This Line Is Shared By Many Documents Of The Set.\t\nend {i}", "en", "d", 9) for i in range(7)],
        *[(40 + i, prose(100 + i // 3, 120) + (f" tail {i}" if i % 3 else ""), "en", "hot", 9) for i in range(12)],
    ]


def frame(spark, rows, extra: bool = False):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs
