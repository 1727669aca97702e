"""The subsequence kernel against plain sums, and the classifier on planted and held-out texts."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.core import read_table
from quern.llm import toxicity
from quern.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def kernel(a, b):
    def parts(w):
        out = defaultdict(float)
        for at in combinations(range(len(w)), 3):
            if at[2] - at[0] < toxicity.SPAN and all(w[i].isalpha() for i in at):
                out["".join(w[i] for i in at)] += toxicity.LAMBDA ** (at[2] - at[0] + 1)
        return out

    x, y = parts(a), parts(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def test_kernel_against_plain_sums():
    words = ["idiot", "i.di.ot", "idxiot", "banana", "ab", "trash", "tra--sh", "nothing", "aaaaaaa", "worthlessness"]
    units = toxicity.Units([w for w in words])
    marks = [units.distinct[units.which[words.index(w)]].as_py() for w in ("idiot", "banana", "trash", "aaaaaaa")]
    for step in (2, 100):
        found = np.zeros((len(words), 4))
        for at, similar in toxicity.Landmarks(marks).similarity(units.distinct, step):
            found[at] = similar
        for i, w in enumerate(words):
            for j, m in enumerate(("idiot", "banana", "trash", "aaaaaaa")):
                assert abs(found[units.which[i], j] - kernel(w, m) ** 3) < 1e-9, (w, m)


def test_units():
    u = toxicity.Units(["You i d i o t! Fine. m or on", None, "", " \n", "U.S. Ab\nc", "🙂 x" * 2])
    words = [u.distinct[i].as_py() for i in u.which]
    code = lambda s: toxicity.Units([s]).distinct[0].as_py()
    assert words[:6] == [code("you"), code("IDIOT"), code("FINE."), code("m"), code("or"), code("on")]
    assert words[6:8] == [code("u.s."), code("ab")]
    assert u.text.tolist()[:6] == [0] * 6 and set(u.text.tolist()) == {0, 4, 5}
    assert len(set(u.sentence[:2])) == 1 and u.sentence[2] != u.sentence[1] != u.sentence[3]
    assert len(toxicity.Units([]).which) == len(toxicity.Units([None]).which) == 0


def corpus(spark, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghilmnorst") for _ in range(rnd.randint(2, 8))) for _ in range(2000)]
    text = lambda: ". ".join(" ".join(rnd.choice(vocab) for _ in range(12)) for _ in range(6))
    rows = []
    for i in range(400):
        t = text()
        if i % 4 == 0:
            w = t.split(" ")
            w.insert(rnd.randrange(len(w)), rnd.choice(["worthless", "idiot", "scumbag"]))
            t = " ".join(w)
        rows.append((i, t, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), text


def test_gapped_insults(spark):
    rows, text = corpus(spark)
    model = toxicity.fit(rows, rows, landmarks=20, near=20)
    clean = text()
    forms = ["idiot", "IDIOT,", "i.d.i.o.t", "i d i o t", "id-iot", "w0orth-less", "wor_thless", "woxrthless", "scummbag", "s.c.u.m.b.a.g"]
    asked = [(0, clean), (1, None), (2, ""), (3, "!!! ???"), (4, f"{clean}. you are idixot now"), *[(10 + i, f"{clean}. you are {f} now") for i, f in enumerate(forms)]]
    docs = spark.createDataFrame(asked, "doc_id long, text string").withColumns({"score": F.lit("mine"), "predicted": F.lit(9)})
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [got[i].predicted for i in range(4)] == [0] * 4
    assert [f for i, f in enumerate(forms) if not got[10 + i].predicted] == []
    assert got[4].score > 2 * got[0].score  # a fifth of a short word is another letter: nearer, if not over the limit
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
    again = toxicity.fit(rows.repartition(7), rows.withColumn("text", F.lit("mine")), landmarks=20, near=20)
    assert again.words == model.words and np.allclose(again.weights, model.weights)


def test_without_labels(spark):
    rows, _ = corpus(spark)
    for part in (rows.limit(0), rows.where("toxic = 0"), rows.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.score(rows, toxicity.fit(rows, part)).where("predicted = 1").count() == 0


def test_very_long_text(spark):
    rows, text = corpus(spark)
    model = toxicity.fit(rows, rows, landmarks=20, near=20)
    long = " ".join(text() for _ in range(2000))
    docs = spark.createDataFrame([(1, long), (2, long + ". you idiot. so worthless"), (3, "x" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[2] > got[1] and got[2] >= 0.5 > got[3]


def test_landmarks_of_an_empty_block():
    assert list(toxicity.Landmarks([b"\x01\x02\x03"]).similarity(pa.array([], pa.large_binary()))) == []


def test_query_on_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, FOLDER).collect()}
    assert len(got) == read_table(spark, FOLDER, "documents").count()
    known = [(got[r.doc_id], r.toxic) for r in read_table(spark, FOLDER, "labels").collect() if got[r.doc_id].held_out]
    found = [g.predicted for g, y in known if y == 1]
    wrong = [g.predicted for g, y in known if y == 0]
    assert len(found) > 3 and sum(found) / len(found) >= 0.6 and sum(wrong) / len(wrong) < 0.1
