"""Language spans against every possible labelling of short texts."""

import itertools

import numpy as np
import pytest

from quern.llm import language

MASK = 0xFFFFFFFF
TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the other dogs sleep through the night with their friends",
    "de": "der schnelle braune fuchs springt ueber den faulen hund und dann schlafen die anderen hunde durch die nacht mit ihren freunden",
    "es": "el rapido zorro marron salta sobre el perro perezoso y luego los otros perros duermen durante la noche con sus amigos",
}


def slot(x):
    return ((x ^ (x >> 15)) * 0xC2B2AE3D & MASK) >> 17


def word_score(word, table):
    """Sum over the pairs and triples of a word between its edges, one by one."""
    c = [language.EDGE, *map(ord, word), language.EDGE]
    pairs = [(a * 0x9E3779B1 + b * 0x85EBCA77) & MASK for a, b in zip(c, c[1:])]
    triples = [(p + d * 0x27D4EB2F + 0x165667B1) & MASK for p, d in zip(pairs, c[2:])]
    return sum(float(table[slot(x)]) for x in [*pairs, *triples])


def path_score(path, emit, penalty):
    return sum(emit[i][s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("penalty", [0.0, 1.0, 12.0])
def test_viterbi_finds_the_best_of_all_paths(penalty):
    rng = np.random.default_rng(int(penalty) + 4)
    sizes = [6, 0, 1, 5, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(scale=6, size=(sum(sizes), 3)).astype(np.float32)
    got = language._viterbi(emit, first, penalty)
    for a, b in zip(first, first[1:]):
        if b > a:
            best = max(path_score(p, emit[a:b], penalty) for p in itertools.product(range(3), repeat=b - a))
            assert path_score(got[a:b], emit[a:b], penalty) == pytest.approx(best, abs=1e-4)


def test_spans_are_a_best_labelling(spark):
    model = language.fit(spark.createDataFrame([(t * 3, g) for g, t in TEXTS.items()], "text string, lang string"))
    mixed = ["the quick fox schlafen durch die nacht", "hund, perro! dog", "los otros perros the other dogs", "noche", "und und the the", "zorro 12 fuchs; marron brown braune hund y dog"]
    found = language.label(spark.createDataFrame([(t,) for t in mixed], "text string"), model, penalty=4.0).collect()
    for row in found:
        words = [w for w in "".join(c if c.isalpha() else " " for c in row["text"]).split()]
        emit = [[word_score(w, t) for t in model.logp] for w in words]
        best = max(path_score(p, emit, 4.0) for p in itertools.product(range(3), repeat=len(words)))
        path = [model.langs.index(s["lang"]) for s in row["spans"] for _ in "".join(c if c.isalpha() else " " for c in row["text"][s["start"]:s["stop"]]).split()]
        assert len(path) == len(words) and path_score(path, emit, 4.0) == pytest.approx(best, abs=1e-2)
        share = {g: sum(len(w) for w, s in zip(words, path) if s == i) for i, g in enumerate(model.langs)}
        assert row["lang_pred"] == max(sorted(share), key=share.get) and row["score"] == pytest.approx(max(share.values()) / sum(share.values()))
