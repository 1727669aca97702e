"""The corpus pipeline, stage by stage, against plain versions of what each stage must do."""

import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from quern.core import materialize, read_table
from quern.llm import simhash

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "piece_ids" or docs.columns == columns
    good, near, cut, mixed, coded = seen.values()
    alike = lambda a, b: len(a & b) / len(a | b)
    sets = {k: shingles(r.text) for k, r in good.items()}
    assert set(near) <= set(good)
    for k in set(good) - set(near):  # a smaller near copy stands for each dropped document
        assert any(alike(sets[k], sets[o]) >= 0.6 for o in good if o < k)
    kept = sorted(near)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if alike(sets[a], sets[b]) >= 0.9]
    windows = set()
    for k in kept:
        w, gone = WORD.findall(near[k].text), set()
        for s in range(len(w) - 19):
            if tuple(w[s : s + 20]) in windows:
                gone.update(range(s, s + 20))
            windows.add(tuple(w[s : s + 20]))
        assert WORD.findall(cut[k].text) == [x for i, x in enumerate(w) if i not in gone]
        assert cut[k].n_chars == len(cut[k].text) and (gone or cut[k].text == near[k].text)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(r.ids) == sp.encode(cut[k].text) for k, r in coded.items()) and set(coded) == set(mixed)
    size = sum(len(WORD.findall(r.text)) for r in cut.values())
    taken = sum(len(WORD.findall(r.text)) for r in materialize(pipeline.mix_sources(spark, spark.createDataFrame(list(cut.values())).select(*columns), FOLDER), "mixed").collect())
    assert abs(taken - 1.5 * size) < 0.1 * size


def test_empty_and_null(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data, stages in ((rows, pipeline.STAGES), ([], pipeline.STAGES[1:])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in stages:
            out = stage(spark, docs, FOLDER)
            assert out.count() <= 2 * len(data)
            assert name == "piece_ids" or out.columns == docs.columns


def planted():
    """Pairs (smaller id, text, larger id, text) of known similarity: short and long, as subsets and as exchanges, one with lines repeated."""
    rng, out = random.Random(8), []
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    for share in (0.70, 0.75, 0.78, 0.79, 0.80, 0.81, 0.82, 0.85):
        for trial in range(12):
            shared, extra = (round(share * 100), 100 - round(share * 100)) if trial % 3 else (round(share * 400), 400 - round(share * 400))
            common = fresh(shared + 4)  # so many shingles
            left = extra // 2 if trial % 2 else 0
            a, b = fresh(left) + common, common + fresh(extra - left)
            out.append((" ".join(a), " ".join(b)))
    for _ in range(20):  # 4 of 5 shingles
        common = fresh(8)
        out.append((" ".join(common), " ".join([*common, *fresh(1)])))
    line, rest = fresh(30), fresh(300)
    out.append((" ".join(rest + line), " ".join(rest + line * 40)))
    return out


def test_near_copies_at_their_similarity(spark):
    pairs = planted()
    rows = [(2 * i + side, text, "en", "a", len(text)) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.drop_near_copies(spark, docs, FOLDER).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = shingles(a), shingles(b)
        same = 5 * len(x & y) >= 4 * len(x | y)
        assert 2 * i in kept and (2 * i + 1 in kept) is not same, (len(x & y), len(x | y))


def test_failed_candidate_does_not_hide_a_true_link():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
    sets = [pool[:100], np.delete(pool[:120], slice(0, 12)), pool[20:120], pool[200:300], pool[205:305]]
    fp = np.array([simhash.fingerprint(s, 8) for s in sets])
    alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    want = {frozenset((i, j)) for i in range(5) for j in range(i) if alike(sets[i], sets[j]) >= 0.8}
    found = simhash.similar_links(sets, fp, fp, True, 64, 512, Fraction(4, 5))
    groups = [{i} for i in range(5)]
    for pair in want:
        hit = [g for g in groups if g & pair]
        groups = [g for g in groups if not g & pair] + [set().union(*hit)]
    assert {frozenset(p) for p in found} <= want and len(found) == 5 - len(groups)
