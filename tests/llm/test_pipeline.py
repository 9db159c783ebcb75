"""The pipeline against a plain version of its five stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import decontaminate, quality

from .test_joins import _components
from .test_narrow import _measures, _spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _kept(text):
    n, chars, symbols, dup, rep = _measures(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    letters = [c for c in text if c.isalpha()]
    upper = [c for c in letters if c.isupper()]
    return not (
        n < quality.MIN_WORDS or 100 * rep > quality.MAX_REPEAT_SHARE * n or 100 * symbols > quality.MAX_SYMBOLS_SHARE * n or 100 * dup > quality.MAX_DUP_LINES_SHARE * len(lines)
        or 100 * len(upper) > quality.MAX_UPPER_SHARE * len(letters) or not quality.MIN_WORD_CHARS * n <= chars <= quality.MAX_WORD_CHARS * n or 100 * len(letters) < quality.MIN_LETTER_SHARE * chars
    )


def _documents():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(6)]
    rows = []
    for k in range(60):
        rows.append([word() for _ in range(rnd.choice([5, 60, 90, 150]))])
    base = [word() for _ in range(90)]
    for k in range(8):
        t = list(base)
        t[10 * k] = word()
        rows.append(t)
    for k in range(6):
        t = [word() for _ in range(80)]
        t[30:30] = items[k][1].split()
        rows.append(t)
    texts = [" ".join(t) for t in rows]
    secret = "ab12cd34" * 4
    for k in range(6):
        body = [word() for _ in range(70)]
        texts.append(" ".join(body[:30]) + f' token = "{secret if k < 4 else "9f" * 15 + str(k)}" ' + " ".join(body[30:]))
    texts += ["### " + " ".join(word() + "###" for _ in range(60)), " ".join(word().upper() for _ in range(60)), None, "", "same words here " * 40]
    return [(k, t, "en", f"s{k % 5}", len(t or "")) for k, t in enumerate(texts)], items


def _masked(text, live):
    out, at = [], 0
    for start, end in sorted(live):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_matches_its_plain_version(spark, tmp_path):
    rows, items = _documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = {d: (t, s) for d, t, _, s, _ in rows if _kept(t or "")}
    groups = {d: c for d, _, c in _components([(d, t) for d, (t, _) in docs.items()])}
    docs = {d: x for d, x in docs.items() if groups[d] == d}
    docs = {d: x for d, x in docs.items() if not any(decontaminate.normalised(i) in decontaminate.normalised(x[0]) for _, i in items)}
    owners = {}
    values = {}
    for d, (t, s) in docs.items():
        for start, _, end, kind in _spans(t):
            value = re.search(r"[A-Za-z0-9+/_.=-]+$", t[start:end])[0] if kind == "assign" else t[start:end]
            values.setdefault(d, []).append((end - len(value), end, value))
            owners.setdefault(value, set()).add(s)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, (t, _) in docs.items():
        text = _masked(t, [(a, b) for a, b, v in values.get(d, []) if len(owners[v]) <= 2])
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert any("[SECRET]" in _masked(t, [(a, b) for a, b, v in values.get(d, []) if len(owners[v]) <= 2]) for d, (t, _) in docs.items())

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got) == want

    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = kept.columns
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0
