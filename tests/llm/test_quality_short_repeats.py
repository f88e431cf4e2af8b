"""Repeats between the base rule's window and a sentence."""

from quernel.llm.quality import quality_rules


def test_short_repeats_count(spark):
    twelve = " ".join(f"s{n}" for n in range(12))
    text = " ".join(" ".join(f"w{part}x{n}" for n in range(18)) + " " + twelve for part in range(5))  # 60 of 150 words
    row = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.repeat_words, row.longest_repeat, row.base_failed, row.kept) == (150, 60, 12, False, False)
