"""Strings in texts of the same owner, against a plain comparison of all pairs."""

import random

from pyspark.sql import functions as F

from tesserae.operators import visibility as Z
from tesserae.operators.containment import held, part_of

from .rows import joined_rows


def test_key_lengths():
    assert [part_of(n) for n in (0, 1, 12, 16, 19, 20, 24, 25)] == [0, 1, 12, 16, 16, 20, 20, 25]
    assert all(part_of(n) <= n and (part_of(n) >= n * 0.79 or n <= 16) for n in range(1, 5000))


def test_held_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é\U0001f600") for _ in range(n))
    texts = [(rng.choice(["u", "v", None]), k, word(rng.choice([0, 3, 40, 300, 5000]))) for k in range(60)] + [("u", 99, None)]
    strings = [(rng.choice(["u", "v"]), word(n)) for n in (0, 1, 2, 3, 5, 8, 12) for _ in range(3)] + [("u", None), (None, "a")]
    for owner, _, t in texts:
        if owner and t:
            at, n = rng.randrange(len(t)), rng.choice([1, 12, 16, 19, 40, 200, 9000])
            strings += [(owner, t[at : at + n]), (owner, t[at : at + n] + "a")]
    got = held(spark.createDataFrame(texts, "owner string, id long, text string"), spark.createDataFrame(strings, "owner string, string string"))
    want = {(o, i, s) for o, i, t in texts for w, s in strings if o is not None and o == w and t is not None and s is not None and s in t}
    rows = [tuple(r) for r in got.select("owner", "id", "string").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_one_owner_with_many_texts_is_not_all_pairs(spark):
    """2000 different texts of one owner against 1000 strings: two million pairs before."""
    letters = F.md5(F.col("id").cast("string"))
    m = spark.range(2000).select("id", F.lit("u").alias("user_id"), F.concat(letters, F.lit(" "), letters).alias("content"))
    values = m.where("id % 2 = 0").select("user_id", F.substring("content", 1, 12).alias("value"))
    found = []
    assert joined_rows(spark, lambda: found.append(Z.without_value(m, values).count())) <= 5000
    old, now = (m.where(f"id % 2 = {k}").select(F.col("user_id").alias("owner"), "content") for k in (0, 1))
    excerpts = m.select(F.col("user_id").alias("owner"), F.col("id").alias("excerpt_id"), F.col("content").alias("excerpt"))
    assert joined_rows(spark, lambda: found.append(Z.retold(excerpts, old, now).count())) <= 5000
    assert found == [1000, 1000]
