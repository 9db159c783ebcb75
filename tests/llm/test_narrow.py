"""Operators 1, 2, 3, 5, 7, 8 and 10 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import licenses, pack, quality, secrets, shards, tokens, urls
from palimpsest.llm.encoders import SpacedCounts, WordIds, load

from . import corpus

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = st.lists(st.sampled_from(list("abAB 's'tre12 \n\t\x1c\x85\xa0éÀßµªΣİ&!²½́") + ["<|endoftext|>", "the ", "日本", "🙂"]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def encoders():
    return WordIds(WORD), SpacedCounts(BYTE)


@given(text=ODD)
@settings(max_examples=300, deadline=None)
def test_encoders_match_the_library(encoders, text):
    words, spaced = encoders
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tok.encode(text, add_special_tokens=False).ids
    assert spaced.count(text) == len(spaced.tok.encode(text, add_special_tokens=False).ids)


@given(parts=st.lists(ODD, max_size=12), chunk=st.sampled_from([80, 120]), overlap=st.sampled_from([1, 50]))
@settings(max_examples=200, deadline=None)
def test_resynchronised_chunks_match_the_whole(encoders, parts, chunk, overlap):
    text, tok = "".join(parts) * 3, encoders[1].tok
    assert tokens.resynchronised(tok, text, chunk, overlap)[0] == tok.encode(text, add_special_tokens=False).ids


def test_resynchronisation_widens_where_nothing_aligns(encoders):
    text = "a" * 5000 + " b" * 50
    ids, chunks, widened = tokens.resynchronised(encoders[1].tok, text, 200, 10)
    assert widened and ids == encoders[1].tok.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing_takes_the_tightest_window(lengths):
    where, offset, n = pack.best_fit_decreasing(lengths, 64)
    left: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = [c for c in left if c >= lengths[k]]
        if not fit:
            left.append(64 - lengths[k])
        else:
            left[left.index(min(fit))] -= lengths[k]
    assert n == len(left)
    used = defaultdict(list)
    for w, o, x in zip(where, offset, lengths, strict=True):
        used[w].append((o, x))
    for pieces in used.values():
        at = 0
        for o, x in sorted(pieces):
            assert o == at
            at += x
        assert at <= 64


def test_packing_round_trip(spark):
    rows = pack.pack_documents(corpus.frame(spark), WORD, 2, window=64, block_tokens=5000).collect()
    tok = Tokenizer.from_file(WORD)
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in corpus.rows())
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens, tuple(np.frombuffer(bytes(r.ids), "<u4"))))
    for doc_id, total in Counter(r[0] for r in corpus.rows()).items():
        if total == 1:
            ids = [i for s, n, t, p in sorted(by_doc[doc_id]) for i in p]
            assert (doc_id, tuple(ids)) in want
            assert [s for s, *_ in sorted(by_doc[doc_id])] == list(range(0, len(ids), 64))
    assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    checked = pack.with_checksum(pack.pack_documents(corpus.frame(spark), WORD, 2)).collect()
    assert {r.ids_crc32 for r in checked if r.doc_id == 0} == {zlib.crc32(np.array([*tok.encode(corpus.rows()[0][1], add_special_tokens=False).ids, 2], "<u4").tobytes())}
    assert pack.pack_documents(corpus.empty(spark), WORD, 2).count() == 0


def test_token_counts(spark):
    tok = load(BYTE)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(corpus.frame(spark), BYTE, chunk=300, overlap=20).collect())
    want = Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus.rows())
    assert got == want
    assert tokens.token_counts(corpus.empty(spark), BYTE).count() == 0


URLS = [
    None, "", "no scheme", "http://Example.COM/en/x", "http://a.example.com/en/?q", "http://www.example.com/en/a#f", "https://x.net/es/1", "https://net/fr/", "http://badcom/", "http://com", "http://com/",
    "http://x.com?/en/", "ftp://é.Example.com/en/", "http:///p", "http://a..com/x", "://com/", "http://example.com/en", "http://www.example.com.net/fr/x", "http://x.net/fr",
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), (None, "/x", "block"), ("", "/p", "block"), ("com", "/en/", "block")]


def _judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_url_rules(spark, limit):
    rnd = random.Random(2)
    urls_ = URLS + ["http://" + ".".join(rnd.choice(["a", "www", "example"]) for _ in range(2)) + rnd.choice([".com", ".net"]) + rnd.choice(["/en/", "/es/", "/fr/x", "", "/"]) for _ in range(200)] + ["http://hot.com/en/"] * 200
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls_)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules, broadcast_rules=limit).collect()}
    assert got == {k: _judge(u) for k, u in enumerate(urls_)}
    assert urls.judge_urls(pages.limit(0), rules, broadcast_rules=limit).count() == 0
    assert urls.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def _spans(text):
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans_and_owners(spark):
    scanned = secrets.scan_secrets(corpus.frame(spark), max_live_owners=1)
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.digest(scanned).collect())
    want = Counter()
    for doc_id, text, *_ in corpus.rows():
        s = _spans(text or "")
        kinds = Counter(k for *_, k in s)
        flat = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want[doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(flat.encode()).hexdigest(), flat] += 1
    assert got == want
    owners = {s["n_owners"] for r in scanned.collect() for s in r.statuses}
    assert owners == {1, 2}  # the value that two sources share, and the others
    assert secrets.scan_secrets(corpus.empty(spark)).count() == 0


def test_licenses(spark):
    got = {}
    for r in licenses.scan_licenses(corpus.frame(spark)).collect():
        got.setdefault(r.doc_id, r)
    for doc_id, text, *_ in corpus.rows():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        starts = [(k, lab) for ph, lab in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(ph.split())] == ph.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(w), len(starts))
        assert (r.first_word, r.last_word) == (min([k for k, _ in starts], default=None), max([k for k, _ in starts], default=None))
        assert r.base_labels == sorted({lab for _, lab in starts}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
        for d in r.detections:
            assert 0 <= d["first"] and d["first"] + d["words"] <= len(w)
    assert len(licenses.signatures()) > 200
    hits = licenses.detections(licenses.normalised("GNU Lesser General Public License version 3")[0])
    assert [h[0] for h in hits] == ["lgpl-3.0"]  # the shorter names inside are suppressed
    assert licenses.scan_licenses(corpus.empty(spark)).count() == 0


def test_shards(spark):
    got = shards.shard_documents(corpus.frame(spark), shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus.rows())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total = sum(r.size for r in got)
    order = []
    for s in sorted(by):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        order += [r.doc_id if r.doc_id is not None else -1 for r in sorted(by[s], key=lambda r: r.slot)]
        assert abs(sum(r.size for r in by[s]) - total / 5) <= max(r.size for r in got)
    assert order == sorted(order)
    assert shards.shard_documents(corpus.empty(spark)).count() == 0


def _measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    marked = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_measures_and_cascade(spark):
    docs = corpus.frame(spark)
    kept = set()
    for r in quality.quality_report(docs).collect():
        text = next(x[1] for x in corpus.rows() if x[0] == r.doc_id) or ""
        n, chars, symbols, dup, rep = _measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
        if r.kept:
            kept.add(r.doc_id)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
    assert quality.keep_good(docs).columns == docs.columns
    rules = {**quality.BASE_RULES, **quality.METHOD_RULES}
    orders = [sorted(rules), sorted(rules, reverse=True)]
    sets = [{r.doc_id for r in docs.where(quality.verdict(quality.text_or_empty(), rules, o)).collect()} for o in orders]
    assert sets[0] == sets[1] == kept
    assert quality.quality_report(corpus.empty(spark)).count() == 0


def _fragments():
    names = [name for _, _, name, _ in ((r[0], r[1], re.sub(r"\(\?:[^)]*\)\??|\(\?[<=][^)]*\)|\\S\+|\W\?|\{0,12\}", " ", r[2].pattern), r[3]) for r in licenses.signatures())]
    return [" ".join(n.split()) for n in names]


def _plain_detections(flat):
    hits = [(m.start(), m.end(), label, priority) for priority, label, pattern, _ in licenses.signatures() for m in pattern.finditer(flat)]
    taken = []
    for hit in hits:
        if not any(a <= hit[0] and hit[1] <= b for a, b, *_ in taken):
            taken.append(hit)
    return [(label, priority, flat[:a].count(" ") - 1, flat[a:b].count(" ") + 1) for a, b, label, priority in sorted(taken)]


def test_detections_match_every_rule_on_every_text():
    rnd = random.Random(4)
    fragments = _fragments()
    whole = [licenses.normalised(text)[0].strip() for *_, text in licenses.SENTENCES if "(" not in text]
    found = set()
    for _ in range(60):
        words = []
        for _ in range(rnd.randrange(1, 8)):
            words += [rnd.choice(["see", "under the", "licensed under the", "filler", "gnu", "2 0", ""]), rnd.choice(fragments), rnd.choice(whole) if rnd.random() < 0.3 else "text"]
        flat = licenses.normalised(" ".join(words))[0]
        assert licenses.detections(flat) == _plain_detections(flat)
        found |= {d[0] for d in licenses.detections(flat)}
    assert len(found) > 30
    for label, _, _, text in licenses.SENTENCES:
        if "(" not in text and "?" not in text:
            assert label in {d[0] for d in _plain_detections(f" x {text} y ")} or any(text in other for *_, other in licenses.SENTENCES if other != text), text


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("This project is not released under the MIT license.", ["mit"], 0.1),
        ("This project is released under the MIT license.", ["mit"], 0.8),
        ("It isn't licensed under the GNU General Public License version 3, nor the MPL 2.0.", ["gpl"], 0.1),
        ("Licensed under the Apache License 2.0, not the MIT license.", ["apache", "apache-2.0", "mit"], 0.8),
        ("Licensed under the zlib license rather than the artistic license.", ["zlib"], 0.8),
        ("No longer distributed under the terms of the Eclipse Public License 2.0", [], 0.0),
        ("whether or not the ISC license applies", ["isc"], 0.4),
        ("Not released under the MIT license. Released under the MIT license.", ["mit"], 0.8),
        ("You may not use this file except in compliance with the License. See the BSD license.", ["bsd"], 0.5),
    ],
)
def test_denied_licenses_are_suppressed(spark, text, labels, score):
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.labels, got.score) == (labels, score)
    assert all(d["label"] for d in got.detections)


def test_many_license_lines_cost_little():
    import time

    flat = licenses.normalised("Released under the MIT License. See the Apache License 2.0. " * 4000)[0]
    began = time.perf_counter()
    assert len(licenses.detections(flat)) == 8000
    assert time.perf_counter() - began < 3


def test_secrets_spread_over_repositories_are_examples(spark):
    value = "token = zz" + "9a" * 8
    rows = [(k, value, "one") for k in range(60)] + [(100 + k % 3, "token = live99value", "one") for k in range(60)] + [(500, "ghp_" + "a1B2" * 6 + " -----BEGIN RSA PRIVATE KEY-----", "two"), (None, value, None)]
    scanned = secrets.digest(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    by = {r.doc_id: r for r in scanned}
    assert (by[3].n_live, by[3].n_example) == (0, 1)
    assert (by[101].n_live, by[101].n_example) == (1, 0)
    assert by[500].spans == "vendor:0:28,vendor:29:60"
    assert by[500].base_sha256 == hashlib.sha256(b"").hexdigest()
