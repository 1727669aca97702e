"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.core import materialize
from quern.llm import chat, fingerprints, language, mixing, pieces, quality_rules, simhash, substrings, token_counts, url_filter
from quern.llm.batches import words

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (None, "one two three", "en", None, 13), (4, "one two three", "en", "b", 13), (4, "one two three", "en", "b", 13), (5, LONG, "en", "b", len(LONG)), (6, "Ω é 漢字 <|endoftext|> it's x", "el", "c", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return materialize(spark.createDataFrame(ODD, SCHEMA), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    return df.withColumns({n: F.lit("mine") for n in names})


def test_language(odd, none):
    model = language.fit(odd)
    assert model.langs == ["el", "en"]
    out = language.label(clash(odd, "score", "spans", "lang_pred"), model).collect()
    assert len(out) == len(ODD)
    for r in out:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
    assert [r.lang_pred for r in out if r.doc_id in (4, 5)] == ["en"] * 3
    assert language.fit(none).langs == []
    assert language.label(odd, language.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert language.label(none, model).count() == 0


def test_language_spans_of_mixed_text(spark):
    en, de = "the house and the garden with the water ", "die straße und der garten mit dem wasser "
    model = language.fit(spark.createDataFrame([(en * 20, "en"), (de * 20, "de")], "text string, lang string"))
    text = en * 3 + de * 3
    row = language.label(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "de"]
    assert abs(row.spans[1].start - len(en * 3)) < 20 and text[row.spans[0].start : row.spans[0].stop].startswith("the house")


def test_chat(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [b], 5: [b], None: [c, a]}
    turns = spark.createDataFrame([(k, i, r, t) for k, v in logs.items() for i, (r, t) in enumerate(v)], "conv_id long, turn long, role string, text string")
    for block_rows in (None, 3):
        kept = chat.maximal(chat.rolling_prefixes(turns, block_rows=block_rows)).collect()
        assert {(r.conv, r.n_turns, r.copies) for r in kept} == {(3, 3, 1), (4, 1, 2), (None, 2, 1)}
    out = {r.conv_id: r.rendered for r in chat.collapse(clash(turns, "rendered", "at")).collect()}
    assert out[3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.collapse(turns.limit(0)).count() == 0


def test_quality(odd, none):
    measured = quality_rules.measure(clash(odd, "kept", "n_words", "_group"))
    assert sorted((r.n_words, r.base_failed) for r in measured.collect()) == [(0, True)] * 3 + [(3, True)] * 3 + [(5, True), (30_000, False)]
    assert [r.text for r in quality_rules.filter_documents(clash(odd, "kept", "_y0")).collect()] == [LONG]
    assert quality_rules.filter_documents(none).count() == 0


def test_quality_finds_outliers(spark):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(4000)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(40, 400))) + ".", "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(rnd.choice(vocab).upper() + "###" for _ in range(100)), "en", "a", 0) for i in range(60)]
    kept = {r.doc_id for r in quality_rules.filter_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(300))


def test_robust_estimate_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 0.8, 1.2, 0.6, 1] + [1, 2, 3, 4, 5]
    x[:80] += 25
    y = np.round(x * quality_rules.SCALE).astype(int)
    rows = spark.createDataFrame([(False, *map(int, v), "g") for v in y], "base_failed boolean, " + ", ".join(f"_y{j} long" for j in range(5)) + ", _group string")
    table = materialize(quality_rules.fit(materialize(rows, "rows")), "estimates")
    est = table.first()
    mean = np.array([est[f"_m{j}"] for j in range(5)])
    assert np.allclose(mean, x[80:].mean(0), atol=0.25)  # the contaminated fifth has no weight
    inverse = np.zeros((5, 5))
    for i, j in quality_rules.PAIRS:
        inverse[i, j] = inverse[j, i] = est[f"_a{i}{j}"]
    d = np.einsum("ni,ij,nj->n", y / quality_rules.SCALE - mean, inverse, y / quality_rules.SCALE - mean)
    got = [r.distance for r in quality_rules.judge(rows, table).collect()]
    assert np.allclose(sorted(got), sorted(np.round(d, 6)), rtol=1e-4, atol=1e-4)
    assert min(d[:80]) > quality_rules.chi2_quantile(1 - 1e-6, 5)
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_prefix_counts_fuzz():
    tok, counter, rnd = Tokenizer.from_file(BPE), token_counts.load(BPE), random.Random(5)
    letters = "ab'lrevstmd  \n\t\r\x0b\x1c\x85\xa0 éß1²½一🙂!.<|>_́"
    for k in range(300):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        s = s[:5] + "<|endoftext|>" + s[5:] if k % 5 == 0 else s
        got = counter.prefixes([s])[0].tolist()
        assert got == [len(tok.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)], repr(s)


def test_token_tables(odd, none):
    tok = Tokenizer.from_file(BPE)
    size = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    table = token_counts.prefix_table(clash(odd, "prefix_tokens"), BPE)
    asked = table.select("text", token_counts.tokens_within(F.col("prefix_tokens"), 7).alias("n7"), token_counts.longest_within(F.col("prefix_tokens"), 3).alias("c3"), F.element_at("prefix_tokens", -1).alias("all")).collect()
    for r in asked:
        assert r.n7 == size((r.text or "")[:7]) and r["all"] == size(r.text)
        assert r.c3 == max(i for i in range(len((r.text or "")[:60]) + 1) if size((r.text or "")[:i]) <= 3)
    counted = token_counts.count_tokens(clash(odd, "n_tokens"), BPE).collect()
    assert sorted(r.n_tokens for r in counted) == sorted(size(t[1]) for t in ODD)
    assert token_counts.count_tokens(none, BPE).count() == 0


def test_pieces_round_trip(odd, none):
    sp = pieces.load(SP)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab ▁\n\t<s>é漢🙂\x00 ") for _ in range(rnd.randint(0, 20))) for _ in range(2000)]
    assert pieces.encode_texts(sp, texts) == sp.encode(texts, num_threads=1)
    for r in pieces.encode(clash(odd, "ids", "decoded"), SP, decode=True).collect():
        assert list(r.ids) == sp.encode(r.text or "") and r.decoded == sp.decode(list(r.ids))
    assert pieces.encode(none, SP).count() == 0


def test_mix(spark, odd, none):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 7 if i % 3 else 0}", 0) for i in range(3000)] + ODD
    docs = materialize(clash(spark.createDataFrame(rows, SCHEMA), "target", "rank"), "mix")
    out = mixing.mix(docs, F.size(words(F.col("text"))))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.source_size, r.target, 0])
        s[0] += r["size"] * r.copies
        s[3] = max(s[3], r["size"])
    for taken, size, target, largest in by.values():
        assert target <= 2 * size and abs(taken - target) <= largest
    assert abs(sum(s[2] for s in by.values()) - 1.5 * sum(s[1] for s in by.values())) < 1e-3
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(5), F.size(words(F.col("text")))).collect()))
    assert mixing.repeat(out).count() == sum(r.copies for r in got)
    assert mixing.mix(none, F.size(words(F.col("text")))).count() == 0


def test_url_tree(spark):
    pages = [(i, f"https://h.net/good/{i}") for i in range(60)] + [(100 + i, f"https://h.net/bad/{i}.html?q") for i in range(60)] + [(300, None), (301, "no scheme"), (302, "http://H.NET?x"), (None, "https://h.net/good/x1")]
    labels = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(None, 1), (5, None)]
    table = clash(spark.createDataFrame(pages, "page_id long, url string"), "host", "raw", "rule")
    known = spark.createDataFrame(labels, "page_id long, bad int")
    out = url_filter.judge(table, known, [("block", "net", "/good/7")])
    got = {r.page_id: r for r in out.collect()}
    assert got[50].verdict == "allow" and got[150].verdict == "block" and got[150].template == "/bad/*"
    assert (got[7].verdict, got[7].rule) == ("block", "net/good/7") and got[None].verdict == "allow"
    assert [(got[k].host, got[k].path) for k in (300, 301, 302)] == [("", ""), ("", ""), ("h.net", "")]
    assert url_filter.judge(table.limit(0), known, []).count() == 0


def test_substrings(spark, odd, none):
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(25))
    rows = [(1, f"a b {p} c"), (2, f"x\n{p}\ty {q}"), (3, f"{q} z {q}"), (None, f"n {p}"), (None, f"m {p}"), (7, None), (8, ""), (9, " ".join(["t"] * 50)), (9, " ".join(["t"] * 50))]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"), "n_removed", "slice", "_row2")
    got = sorted(((r.doc_id is None, r.doc_id, r.text, r.n_removed) for r in substrings.remove_repeats(docs, n_removed="n_removed").collect()), key=str)
    want = [(False, 1, f"a b {p} c", 0), (False, 2, f"x\ny {q}", 60), (False, 3, "z ", 50), (True, None, "n ", 60), (True, None, "m ", 60), (False, 7, None, 0), (False, 8, "", 0)]
    assert [r for r in got if r[1] != 9] == sorted(want, key=str)
    # 31 equal windows: all but the first go, and with them the words that the first one shares with them
    assert [r for r in got if r[1] == 9] == [(False, 9, "t ", 49)] * 2
    assert substrings.remove_repeats(none).count() == 0
    out = substrings.remove_repeats(odd).collect()
    assert sorted(str(r.text) for r in out) == sorted(str(r[1]) for r in ODD)


def test_fingerprints(spark, odd, none):
    texts = [(1, "alpha one.\nbeta two"), (2, "beta two\n\nalpha one."), (3, "alpha one."), (4, "beta two"), (5, None), (6, "  \n"), (7, "other thing. " * 40)]
    got = {r.doc_id: list(r.fingerprint) for r in fingerprints.fingerprint(clash(spark.createDataFrame(texts, "doc_id long, text string"), "fingerprint")).collect()}
    assert got[1] == got[2] != got[3] and got[5] == got[6] == [0] * 52
    both = spark.createDataFrame([(got[3], got[4], got[1])], "a array<long>, b array<long>, c array<long>")
    r = both.select(fingerprints.combine(F.col("a"), F.col("b")).alias("plus"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("minus"), fingerprints.likeness(F.col("a"), F.col("a")).alias("same"), fingerprints.likeness(F.col("a"), F.col("c")).alias("part")).first()
    assert list(r.plus) == got[1] and list(r.minus) == got[3] and r.same == 1.0 and 0.2 < r.part < 1.0
    assert fingerprints.edited(none).count() == 0
    rows = {(r.doc_id, r.n_chars, r.edited_text) for r in fingerprints.edited(odd).collect()}
    first = "" # after the null key (last) comes doc 1, whose text is null
    assert (None, 13, "one two" + first) in rows and (4, 13, "one two" + LONG[:6]) in rows and len(rows) == len(ODD) - 1


def test_simhash(spark, odd, none):
    out = simhash.components(clash(odd, "k", "th", "lanes"), tile_rows=2).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r.k, set()).add(r.component)
    assert by[1] == by[2] == by[3] == {1} and by[4] == by[None] == {4} and by[5] == {5}
    assert sorted((r.doc_id for r in simhash.deduplicate(odd).collect())) == [1, 4, 5, 6]
    assert simhash.components(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_simhash_links_are_complete():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    f = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(5)]))
    want, got = np.arange(len(f)), np.arange(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 2):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
    found = simhash.spanning_links(f[:, None], f[:, None], True, 2, 2, block=7)
    for i, j in found:
        got[got == max(got[i], got[j])] = min(got[i], got[j])
    assert (want == got).all() and len(found) == len(f) - len(set(want))


def test_connected_chain(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.id: r.root for r in simhash.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


def test_words_with_clashing_sums_stay(spark):
    x, y = thue_morse(1024)
    docs = spark.createDataFrame([(1, " ".join([x] * 20)), (2, " ".join([y] * 20)), (3, " ".join([x] * 20)), (4, "long " * 19 + "z" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs, n_removed="n_removed").collect()}
    assert got == {1: 0, 2: 0, 3: 20, 4: 0}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("slices_")]


def test_last_level_compares_words(spark, monkeypatch):
    data = np.frombuffer(b"a b c d a b c d x b c d a b c d", np.uint8)
    w = substrings.Words(data, np.array([0, len(data)]))
    w.windows[4] = np.zeros(16, np.uint64)  # every window under one hash
    at = np.array([0, 4, 8, 12])
    same = w.classes(at, 4)
    assert same[0] == same[1] == same[3] != same[2] and sorted(set(same.tolist())) == [0, 1]


def test_inclusion_follows_the_probabilities(spark):
    """The same 40 documents in 400 sources of their own: each document is taken about as often as its probability says."""
    sizes = [3, 3, 5, 9, 9, 17, 33, 70, 150, 700] * 4
    rows = spark.createDataFrame([(s * 1000 + i, f"s{s:03d}", n) for s in range(400) for i, n in enumerate(sizes)], "doc_id long, source string, size long")
    out = mixing.mix(rows, F.col("size"), weights=(1,), factor=0.4).select("doc_id", "copies", "target").collect()
    assert abs(out[0].target - 0.4 * sum(sizes)) < 1e-6
    share = np.zeros(len(sizes))
    for r in out:
        share[r.doc_id % 1000] += r.copies / 400
    odds = np.array([n.bit_length() for n in sizes], float)
    factor = 0.0  # by halving
    low, high = 0.0, 10.0
    for _ in range(100):
        factor = (low + high) / 2
        low, high = (factor, high) if (np.minimum(1, factor * odds) * sizes).sum() < 0.4 * sum(sizes) else (low, factor)
    want = np.minimum(1, factor * odds)
    groups = [np.flatnonzero(odds == o) for o in np.unique(odds)]
    assert all(abs(share[g].mean() - want[g].mean()) < 0.05 for g in groups), [(share[g].mean(), want[g].mean()) for g in groups]


def test_certain_documents_are_taken(spark):
    rows = spark.createDataFrame([(i, "a", 1 if i else 1000) for i in range(50)], "doc_id long, source string, size long")
    got = {r.doc_id: r.copies for r in mixing.mix(rows, F.col("size"), weights=(1,), factor=0.99).collect()}
    assert got[0] == 1 and set(got.values()) == {0, 1}
