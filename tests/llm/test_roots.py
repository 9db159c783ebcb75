import random

from palimpsest.llm import ngram


def test_components_with_repeated_or_null_ids_keep_one_row_each(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(0, texts[0], "a"), (0, texts[1], "b"), (1, texts[1] + " end", "b"), (None, texts[2], "a"), (None, texts[2] + " end", "b"), (None, texts[3], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = ngram.one_of_each(docs).collect()
    assert len(kept) == 4
    assert {(r.doc_id, r.text) for r in kept} >= {(0, texts[0]), (0, texts[1]), (None, texts[3])}
