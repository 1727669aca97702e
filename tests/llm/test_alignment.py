"""Token links against the libraries and plain loops over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.core import materialize, read_table
from quern.llm import alignment
from quern.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


def libraries():
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in letters]
    of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
    a_bytes = lambda i: bytes(of[c] for c in tok.id_to_token(i))
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return tok, sp, a_bytes, b_bytes


def plain(texts):
    """Per text: ids of both sides, links (positions, bytes), groups as lists of ids."""
    tok, sp, a_bytes, b_bytes = libraries()
    out = []
    for t in texts:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        sides = [[x for i, k in enumerate(ids) for x in [i] * len(size(k))] for ids, size in ((a, a_bytes), (b, b_bytes))]
        if not t or b"".join(map(a_bytes, a)) != (" " + t).encode() or b"".join(map(b_bytes, b)) != (" " + t).encode():
            out.append(([], [], Counter(), []))
            continue
        x, y = sides
        groups, i, j = [], 0, 0
        for k in range(len(x)):
            if k + 1 == len(x) or (x[k + 1] != x[k] and y[k + 1] != y[k]):
                groups.append((a[i : x[k] + 1], b[j : y[k] + 1]))
                i, j = x[k] + 1, y[k] + 1
        out.append((a, b, Counter(zip(x, y, strict=True)), groups))
    return out


def summed(parts):
    count = Counter((a[i], b[j]) for a, b, links, _ in parts for i, j in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    rows = []
    for a, b, links, groups in parts:
        each = [(count[a[i], b[j]], top[b[j]]) for i, j in links]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((len(a), len(b), len(groups), len(links), text, sum(n == m for n, m in each), sum(n for n, _ in each)))
    return rows


def odd_texts():
    rnd = random.Random(9)
    made = ["".join(rnd.choice("ab it's \n\t  é漢🙂12<|endoftext|>▁ﬁ") for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    return [None, "", " ", "<|endoftext|>", "<s> </s> <unk> <0x41>", "a▁b", "x" * 3000, "漢" * 400, "word " * 3000, *made, *made[:20]]


def test_align(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, links string")
    got = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    for i, (a, b, links, groups) in enumerate(plain(texts)):
        r = got[i]
        assert (list(r.ids_a), list(r.ids_b)) == (a, b)
        assert {(x.a, x.b): x.bytes for x in r.links} == dict(links)
        of = lambda ids, at: [[k for k, g in zip(ids, at, strict=True) if g == n] for n in range(len(groups))]
        assert list(zip(of(r.ids_a, r.group_of_a), of(r.ids_b, r.group_of_b), strict=True)) == groups
        assert r.n_group_links == sum(len(g) * len(h) for g, h in groups)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_group_links():
    pair = alignment.load(A, B)
    x = alignment.Aligned(pair, *pair.encode(odd_texts()[:60]))
    want = {(i, j) for i, g in enumerate(x.group_a.tolist()) for j in np.flatnonzero(x.group_b == g).tolist()}
    for entries in (7, 1 << 20):
        parts = list(x.group_links(entries))
        assert {(int(i), int(j)) for a, b in parts for i, j in zip(a, b, strict=True)} == want
    assert x.n_group_links().sum() == len(want)


def test_corpus_links(spark):
    texts = odd_texts()
    docs = materialize(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5), "odd")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.corpus_links(docs.withColumn("k", F.lit("mine")), A, B).collect()}
    for i, want in enumerate(summed(plain(texts))):
        assert got[i] == want, texts[i]
    assert alignment.corpus_links(docs.limit(0), A, B).count() == 0


def test_query(spark):
    docs = read_table(spark, FOLDER, "documents", "doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_token_alignment"](spark, FOLDER).collect()}
    for d, (n_a, n_b, n_groups, n_links, text, n_best, total) in zip(docs, summed(plain([d.text for d in docs])), strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, total)
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
