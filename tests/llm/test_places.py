import random

from palimpsest.llm import decontaminate

ITEM = "which of the five rivers named below flows through the old town before it meets the northern sea in spring"


def _found(text, item=ITEM):
    return [p[1:] for p in decontaminate.find_items(text, ((0, item),))]


def test_close_copies_are_places_of_their_own():
    m = len(ITEM)
    assert _found(f"{ITEM} {ITEM}") == [(0, 0, m), (0, m + 1, 2 * m + 1)]
    edited = ITEM[1:]
    assert [p[0] for p in _found(f"{ITEM} {edited} {ITEM}")] == [0, 1, 0]
    assert [p[0] for p in _found(f"{edited} {ITEM}")] == [1, 0]


def test_a_repeated_piece_does_not_hide_an_exact_copy():
    rnd = random.Random(2)
    body = "".join(rnd.choice("abcdefghijkl") for _ in range(75))
    for gap in range(8, 17):
        piece = "qrstuvwxyz"[:gap] * 3
        for at in (0, 20, 75):
            item = body[:at] + piece + body[at:]
            text = "mn " + item + " mn " + item[1:]
            assert [p[0] for p in _found(text, item)] == [0, 1]
            assert (0, 3, 3 + len(item)) in _found(text, item)


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "What is 12 * 7?"), (2, "cat"), (3, "\u6c34\u306e\u5316\u5b66\u5f0f\u306f"), (4, "!?"), (5, None)]
    docs = [(1, "He asked: what is  12 x 7? no, what is 12 7"), (2, "a concatenated category"), (3, "the Cat!"), (4, "\u554f\u984c\u6c34\u306e\u5316\u5b66\u5f0f\u306f\u4f55"), (5, "what is 12 78")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(frame, bench).collect()} == {(1, 1, 0), (3, 2, 0), (4, 3, 0)}
    assert {r.doc_id for r in decontaminate.without_items(frame, bench).collect()} == {2, 5}
