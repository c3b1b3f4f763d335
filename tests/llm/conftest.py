"""Awkward tables that every operator must take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, pool: int = 500) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def awkward_rows() -> list[tuple]:
    passage = "\n".join(words(i, 15) for i in range(5))
    texts = [
        None, "", " \n\t ", "word", "two words", "É ß 漢字 👍 <|endoftext|> it's", passage, passage, "x " + passage + "\ny", words(7, 400), words(7, 400) + " end", words(8, 60_000),
        "a" * 5_000, ("line one here\n" * 6) + "tail", "\n".join(["same", "", "same", "", "same"]), "Released under the MIT License.\n" + words(9, 50), "1d10t m0r0n " + words(10, 60), words(7, 400),
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id here", None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(awkward):
    """Extra columns with names that operators use for their own results."""
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(1) for c in ("size", "shard", "slot", "text_crc32", "n", "h", "key", "low", "a", "b", "s", "n_lines", "n_runs", "n_removed_lines", "kept", "score", "hits", "item_id", "label", "quality", "hits", "weight", "predicted", "expected_grade", "tail_prob", "n_tokens", "ids", "n_bytes", "n_removed", "license", "coverage", "item", "text_x")})
