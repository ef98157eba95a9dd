"""The texts that substring dedup leaves, and the stretches it removes."""

from lagline.llm import substring_dedup


def test_kept_text_and_removed_stretches(spark):
    base = [f"a{i}" for i in range(30)]
    one, two = " ".join(base), " ".join(["ñ", *base[:25], "mid", *base[5:], "end"])
    rows = [(1, one), (2, two), (3, one), (4, "short  text"), (5, None), (None, one + " x"), (4, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 9, r.n_words, r.removed, r.text) for r in substring_dedup.kept_texts(docs).collect())
    assert got == [
        (1, 30, [], one), (2, 53, [1, 26, 27, 52], "ñ mid end"), (3, 30, [0, 30], ""), (4, 2, [], "short text"),
        (4, 30, [0, 30], ""), (5, 0, [], ""), (9, 31, [0, 30], "x"),
    ]
