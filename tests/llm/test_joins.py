"""Operators 4, 6 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import components, decontaminate, hashing, ngram, secrets, substrings

from . import corpus


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(rows):
    """(doc_id, text) rows to the Counter of (doc_id, n, component_id), all pairs compared."""
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return Counter((d, len(sets[k]), least.get(find(k))) for k, (d, _) in enumerate(rows))


def _copies(seed, n=40, size=60):
    """A large group of near copies around one text, a chain of drifting copies, shared passages and texts of frequent words."""
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(3000)}"
    base = [word() for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(size)] = word()
        out.append(" ".join(t))
    drift = [word() for _ in range(size)]
    for _ in range(12):
        drift[rnd.randrange(size)] = word()
        out.append(" ".join(drift))
    passage = [word() for _ in range(30)]
    out += [" ".join([word() for _ in range(rnd.randrange(5, 60))] + passage) for _ in range(n)]
    lines = [" ".join(word() for _ in range(12)) for _ in range(6)]
    out += [" ".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 8))) for _ in range(n)]
    out += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 30))) for _ in range(n)]
    out += ["one two", "One TWO", "one two three four", "", None, "   "]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram, "FREQUENT", 4)
    monkeypatch.setattr(ngram, "SHORT_LIST", 4)
    rows = _copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram.near_duplicates(docs).collect())
    assert got == _components(rows)


def _large_group(n, seed=8):
    """Copies of one text with 0 to 45 per cent of its words changed, and copies of one of the copies."""
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(100_000)}"
    base = [word() for _ in range(70)]
    other = [word() if rnd.random() < 0.12 else w for w in base]
    out = []
    for k in range(n):
        t = list(other if k % 4 == 0 else base)
        for _ in range(rnd.randrange(10)):
            t[rnd.randrange(len(t))] = word()
        out.append(" ".join(t[: rnd.choice([70, 70, 70, 66, 60])]))
    return list(enumerate(out))


def _components_at_once(texts):
    """_components for many texts: all pairs by one product of matrices."""
    sets = [_shingles(t) for t in texts]
    at = {s: k for k, s in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for k, s in enumerate(sets):
        m[k, [at[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    near = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    root = np.arange(len(sets))
    while True:
        now = np.where(near, root[None, :], len(sets)).min(axis=1)
        if (now == root).all():
            return Counter((k, len(s), int(root[k])) for k, s in enumerate(sets))
        root = now


@pytest.mark.parametrize("blocks", [(1024, 2048, 65536, 64), (16, 50, 300, 8)])
def test_join_of_a_large_group(spark, blocks, monkeypatch):
    for name, value in zip(("HUB_BLOCK", "OUTSIDERS", "MEMBERS", "SKIP_BLOCK"), blocks, strict=True):
        monkeypatch.setattr(ngram, name, value)
    if blocks[0] == 16:
        monkeypatch.setattr(ngram, "HOT_ELEMENTS", 5)  # most common elements stand anywhere in the order
        monkeypatch.setattr(ngram, "LOOK", 1000)
    rows = _large_group(1500 if blocks[0] == 1024 else 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram.near_duplicates(docs).collect())
    assert got == _components_at_once([t for _, t in rows])


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 60), st.integers(0, 20)), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_entries_out_of_reach(entries):
    entries = sorted((e, n, min(p, n - int(ngram.least_shared(n)))) for e, n, p in entries)
    e, n, pos = (np.array(x) for x in zip(*entries, strict=True))
    far = ngram.reach(n, pos)
    assert all(f == max(m for m in range(400) if ngram.needed(a + m) <= a - p) for f, a, p in zip(far.tolist(), n.tolist(), pos.tolist(), strict=True))
    want = [any(e[i] == e[j] and n[j] <= far[i] and n[i] <= far[j] for j in range(len(e))) for i in range(len(e))]
    assert ngram._reached(e, n, pos).tolist() == want


def test_columns_of_ones_own_never_clash(spark):
    names = ["_key", "__key", "_chosen", "_id", "_spans", "_row_no", "_row", "_statuses"]
    rows = [(k, f"one two three four five six {k // 2} token = abcdef{k // 2}", "s", *[f"{n}{k}" for n in names]) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for out in (ngram.one_of_each(docs), secrets.mask_live(docs)):
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    assert {r.doc_id for r in ngram.one_of_each(docs).collect()} == {0, 2, 4}


def test_join_on_awkward_rows(spark):
    docs = corpus.frame(spark)
    rows = [(r[0], r[1]) for r in corpus.rows()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram.near_duplicates(docs).collect())
    assert got == _components(rows)
    kept = ngram.one_of_each(docs)
    assert kept.columns == docs.columns
    want = Counter()
    for (d, n, c), k in got.items():
        want[d, n > 0] += k if n == 0 else int(d == c)
    assert Counter((r.doc_id, bool(_shingles(r.text))) for r in kept.collect()) == Counter({k: min(v, 1) if k[1] else v for k, v in want.items() if v})
    assert ngram.near_duplicates(corpus.empty(spark)).count() == 0
    assert ngram.one_of_each(corpus.empty(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def _distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row), row.index(min(row))


@given(st.text("abc", min_size=1, max_size=90), st.text("abcd", max_size=120), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_myers(pattern, text, most):
    best = _distance(pattern, text)
    assert decontaminate.myers(pattern, text, most) == (best if best[0] <= most else None)


@given(st.text("ab ", min_size=20, max_size=70), st.lists(st.text("abc ", max_size=40), max_size=4), st.lists(st.integers(0, 69), max_size=8))
@settings(max_examples=300, deadline=None)
def test_items_are_met_within_their_budget(item, around, edits):
    item = decontaminate.normalised(item)
    if len(item) < decontaminate.MIN_ITEM_CHARS:
        return
    copy = list(item)
    for k in edits[: decontaminate.budget(len(item)) + 1]:
        copy[k % len(copy)] = "x"
    text = decontaminate.normalised(" ".join(around[:2] + ["".join(copy)] + around[2:] + [item][: len(around) % 2]))
    found = decontaminate.find_items(text, ((7, item),))
    best = _distance(item, text)[0]
    if best > decontaminate.budget(len(item)):
        assert not found
        return
    assert min(f[1] for f in found) == best
    places = sorted(f[2:] for f in found)
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
    for _, distance, start, end in found:
        assert _distance(item, text[start:end])[0] <= distance


def test_periodic_texts_cost_their_length():
    import time

    item = decontaminate.normalised("alpha beta gamma " * 33)
    text = decontaminate.normalised("alpha beta delta " * 1200)
    mixed = decontaminate.normalised(("alpha beta gamma " * 30 + "alpha beta delta ") * 40)
    began = time.perf_counter()
    assert decontaminate.find_items(text, ((1, item),)) == []
    places = decontaminate.find_items(mixed, ((1, item),))
    assert time.perf_counter() - began < 2
    assert len(places) > 20


def test_every_text_against_every_item(spark):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(5, 14)))) for k in range(8)]
    docs = []
    for k in range(40):
        body = [word() for _ in range(rnd.randrange(0, 25))]
        copy = list(rnd.choice(items)[1])
        for _ in range(rnd.randrange(0, 8)):  # within and beyond the budget
            at = rnd.randrange(len(copy))
            copy[at : at + 1] = rnd.choice(["", "z", copy[at] + "q"])
        body[len(body) // 2 : len(body) // 2] = "".join(copy).split()
        docs.append((k, " ".join(body)))
    want = set()
    for d, t in docs:
        for i, item in items:
            flat = decontaminate.normalised(item)
            best = _distance(flat, decontaminate.normalised(t))[0]
            if best <= decontaminate.budget(len(flat)):
                want.add((d, i, best))
    found = decontaminate.digest(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == want
    assert len(want) > 10


def test_planted_items_are_found_and_others_left(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(8, 60))).capitalize() + ".") for k in range(30)] + [(90, None), (91, ""), (92, "tiny"), (93, None)]
    items.append((94, items[0][1]))
    docs, want = [], set()
    for k in range(120):
        body = [word() for _ in range(rnd.randrange(0, 200))]
        if k % 3 == 0:
            item_id, item = items[rnd.randrange(30)]
            t = list(item.upper() if k % 2 else item.replace(" ", "\n  "))
            for _ in range(decontaminate.budget(len(decontaminate.normalised(item))) // 2):
                t[rnd.randrange(len(t))] = rnd.choice("xyz")
            at = rnd.randrange(len(body) + 1)
            body[at:at] = "".join(t).split()
            want |= {(k, item_id)} | ({(k, 94)} if item_id == 0 else set())
        docs.append((k, " ".join(body), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, items[3][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, start string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(None, 3)}
    texts = dict((d, t) for d, t, _ in docs)
    flat = {i: decontaminate.normalised(t or "") for i, t in items}
    for r in found:
        place = decontaminate.normalised(texts[r.doc_id][r.start : r.end])
        assert _distance(flat[r.item_id], place)[0] <= r.distance <= decontaminate.budget(r.item_chars)
    clean = {d for d, *_ in docs} - {d for d, _ in want} - {None}
    assert {r.doc_id for r in decontaminate.without_items(frame, bench).collect()} == clean
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0


@given(st.lists(st.integers(0, 2), min_size=20, max_size=20), *[st.lists(st.integers(0, 2), max_size=12) for _ in range(4)])
@settings(max_examples=500, deadline=None)
def test_equal_windows_have_equal_anchors(window, left, right, other_left, other_right):
    names = hashing.mix(np.arange(1, 4, dtype=np.uint64))
    at = []
    for a, b in ((left, right), (other_left, other_right)):
        h = names[np.array(a + window + b)]
        at.append(int(substrings.anchors(h)[len(a)]) - len(a))
        assert substrings.EDGE <= at[-1] <= 20 - substrings.EDGE - 2
    assert at[0] == at[1]


def _removed(rows, window):
    first = {}
    rank = lambda d: -1 if d is None else d
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (rank(d), k)), (rank(d), k))
    out = Counter()
    for d, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (rank(d), k):
                keep[k : k + window] = [False] * window
        left = [x for x, k in zip(w, keep, strict=True) if k]
        out[d, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("window", "block"), [(20, 2_000_000), (20, 500), (9, 300)])
def test_substring_dedup(spark, window, block, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    rows = [(r[0], r[1]) for r in corpus.rows()] + [(1000 + d, t) for d, t in _copies(5, n=15)]
    rows += [(2000 + k, " ".join(random.Random(k).choice("ab") for _ in range(150))) for k in range(8)]
    rows += [(3000, "x " * 500), (3001, "x y " * 100), (7, rows[20][1])]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, places string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.dedup_substrings(docs, window)).collect())
    assert got == _removed(rows, window)
    assert substrings.dedup_substrings(docs.limit(0), window).count() == 0


def test_second_word_hash_shares_nothing_with_the_first():
    words = [f"w{k}" for k in range(5000)] + ["ab", "ba", "a\u00e9", "aa", "aaa"]
    column = pa.array([" ".join(words), None, "w1 W1", ""])
    one, at = hashing.hashed_words(column)
    two, also = hashing.hashed_words(column, again=True)
    assert at.tolist() == also.tolist() == [0, len(words), len(words), len(words) + 2, len(words) + 2]
    assert two[1] == two[len(words)] and two[1] != two[len(words) + 1]
    assert len(set(one[: len(words)].tolist())) == len(set(two[: len(words)].tolist())) == len(words)
    assert abs(np.corrcoef(one.astype(float), two.astype(float))[0, 1]) < 0.1
