import random
import time

import numpy as np

from strandloom.llm import decontam, langid


def plain_best(have, wanted, width):
    """Most distinct wanted shingles in any window, and the first place where that is reached."""
    best = (0, 0)
    for i in range(len(have)):
        a = max(0, i - width + 1)
        n = len(set(have[a : i + 1]) & set(wanted))
        if n > best[0]:
            best = (n, a)
    return best


def test_best_window_by_running_sums():
    rng = random.Random(5)
    for _ in range(300):
        have = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 40))], dtype=np.uint64)
        wanted = np.unique(np.array([rng.randrange(9) for _ in range(rng.randrange(1, 6))], dtype=np.uint64))
        width = rng.randrange(1, 12)
        assert decontam._best_window(have, wanted, width) == plain_best(have.tolist(), wanted.tolist(), width)


def test_a_phrase_that_repeats_in_a_long_text_and_in_the_item(spark):
    """195 KB of one phrase against an item of the same: overlapping stretches are looked through once."""
    phrase = "alpha beta gamma delta epsilon zeta eta "
    docs = spark.createDataFrame([(1, phrase * 5000), (2, "nothing of it " * 5000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, phrase * 20), (8, phrase * 3 + "and some words more of another kind")], "item_id long, text string")
    kernel = decontam.Block([decontam._item_words(phrase * 20)], [7], 5, 0.8, None)
    kernel.order({})
    data = np.frombuffer((phrase * 5000).encode(), np.uint8)
    words = decontam.Words(data, np.array([0, len(data)]), decontam.ALNUM_WORDS)
    began = time.time()
    assert [(r, u, share) for r, u, _, _, share in kernel.contained(words, decontam._rows(words))] == [(0, 0, 1.0)]
    assert time.time() - began < 2
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, items).collect()] == [(1, 7)]
    assert [r["doc_id"] for r in decontam.clean_documents(docs, items).collect()] == [2]


def test_many_long_rows_in_one_partition(spark):
    """1200 rows of 100 KB each in one partition, through the first and the third stage's marks."""
    text = "the weather of the town was good and people walked along the river in the evening "
    docs = spark.range(1200).repartition(1).selectExpr("id AS doc_id", f"repeat('{text}', 1250) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    items = spark.createDataFrame([(1, "a benchmark passage that no document has anywhere in its long text at all")], "item_id long, text string")
    assert decontam.clean_documents(docs, items).select("doc_id").count() == 1200
    few = docs.where("doc_id < 60")
    assert langid.accepted(few).select("doc_id").count() in (0, 60)
