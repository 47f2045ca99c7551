import random

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n))


#: Columns that clash with names the operators use within and in their results.
EXTRA = "rid long, kept boolean, bucket int, score double, spans string, digest string, row int, node long, label string, shard int, ids string, words string, mark long, key int, n int"


def odd_rows() -> list[tuple]:
    base, long = prose(1, 120), prose(2, 30_000)
    edited = base.split(" ")
    edited[60] = "changed"
    rows = [
        (5, base, "en", "a"), (3, base, "en", "a"), (3, base, "en", "a"), (None, base, None, None), (7, "  " + base.replace(" ", "\t \n"), "en", None),
        (8, " ".join(edited), "en", "b"), (9, None, None, None), (10, "", "fr", "b"), (11, " \n\t ", "en", "b"), (None, None, None, None), (12, long, "en", "c"), (13, long, "en", "c"),
        (14, "é" * 250, "fr", "c"), (15, "x", "en", "c"), (16, "123 $ ###", "en", "c"), (17, "aa" * 400, "es", "c"), (18, prose(3, 200), "en", "d"), (19, "one two three", "en", "d"), (20, "one two three", "en", "d"),
        (21, "日本語 текст 👍🏽 é  　x\x1cy\x85", None, "d"), (10, "", "fr", "b"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, *[None] * (EXTRA.count(",") + 1)) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
