"""Registered queries on the smallest tables: against their SQL, or against plain brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from oracle import compare, connect
from tokenizers import Tokenizer

from quern.core import read_table
from quern.llm.queries import QUERIES, SQL, URL_RULES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(read_table(spark, FOLDER, "documents").collect(), key=lambda r: r.doc_id)


def result(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, FOLDER).collect()}


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
    assert ok, note


def test_language_held_out_accuracy(spark, docs):
    got = result(spark, "op1_language_spans")
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert 0.2 < len(held) / len(docs) < 0.5
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_base_counts(spark, docs):
    got = result(spark, "op3_quality_rules")
    for d in docs:
        w = WORD.findall(d.text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in d.text.split("\n") if WORD.search(x)]
        r = got[d.doc_id]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d.text)), len(lines) - len(set(lines)), len(repeat))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(repeat) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_token_counts(spark, docs):
    got = result(spark, "op4_token_counts")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in docs:
        r, n = got[d.doc_id], len(tok.encode(d.text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 512)
        assert len(tok.encode(d.text[: r.fit_chars], add_special_tokens=False).ids) <= 512


def test_piece_ids(spark, docs):
    got = result(spark, "op5_piece_ids")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = sp.encode(d.text)
        assert tuple(got[d.doc_id])[1:] == (len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)))


def test_url_rules(spark):
    got = result(spark, "op7_path_templates", "page_id")
    pages = read_table(spark, FOLDER, "pages", "page_id", "url").collect()
    assert len(got) == len(pages)
    for p in pages:
        rest = p.url.split("://", 1)[1] if "://" in p.url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(len(h + q), h + q, v) for v, h, q in URL_RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(q)]
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host.lower(), path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.purity < 0.5 else "allow")


def repeats(rows, size=20):
    """(id, words) in order -> words that stay, per id."""
    seen, out = set(), {}
    for key, w in rows:
        gone = set()
        for s in range(len(w) - size + 1):
            window = tuple(w[s : s + size])
            if window in seen:
                gone.update(range(s, s + size))
            seen.add(window)
        out[key] = [x for i, x in enumerate(w) if i not in gone]
    return out


def test_window_doubling(spark, docs):
    got = result(spark, "op8_window_doubling")
    cut = {d.doc_id: WORD.findall(d.text) for d in docs}
    for key, kept in repeats(cut.items()).items():
        want = (len(cut[key]), len(cut[key]) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert tuple(got[key])[1:] == want


def simhash(text, size=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    parts = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs):
    got = result(spark, "op10_simhash_tiles")
    f = np.array([simhash(d.text) for d in docs], np.uint64)
    root = np.arange(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 2):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    for d, x, r in zip(docs, f, root, strict=True):
        assert tuple(got[d.doc_id])[1:] == (f"{x:016x}", docs[r].doc_id)
