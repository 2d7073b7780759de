"""Positional index, whitening and annulus search against plain versions."""

import hashlib
import math
import re

import numpy as np
import pytest

from tessera.llm import annulus, positional, whitening
from tessera.llm.common import Stages

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def decontaminated(docs, items, length=10):
    own: dict = {}
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - length + 1)) if w else ():
            own.setdefault(tuple(w[s : s + length]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in own}:
            for s in range(len(w) - n + 1):
                if (p := tuple(w[s : s + n])) in own:
                    hit |= set(range(s, s + n))
                    found |= own[p]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ITEMS = [
    (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa LAMBDA mu"), (2, "the the the the the the the the the the the"), (3, "solo"), (4, "pair wise"), (5, None), (6, " ... "), (7, "É文 wörter Ñandú"),
    (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "pair wise"), (10, "solo"), (8, "one two three one two three one two three one two"),
]


def test_exact_matches(spark, odd):
    text = "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu y"
    docs = [(1, text), (1, text), (2, text.upper()), (3, text.replace(" ", "--")), (4, text.replace("eta theta", "eta x theta")), (5, "the " * 30), (6, "Solo pair wise pair x wise solo"), (7, "É文 WÖRTER ñandú, é文 wörter Ñandú É文 wörter Ñandú"), (8, None), (9, ""), (None, "pair wise"), (None, None), (11, "one two three " * 5), (12, "mu " * 5 + text + " solo" * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(*x, "k") for x in ITEMS], "item_id long, text string, k1 string")
    assert rows(positional.report(frame, items)) == decontaminated(docs, ITEMS)
    whole = [(r["doc_id"], r["text"]) for r in odd.collect()]
    bench = [(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (2, "two"), (3, "abcdef12")]
    assert rows(positional.report(odd, spark.createDataFrame(bench, "item_id long, text string"))) == decontaminated(whole, bench)
    assert positional.report(frame.where("false"), items).count() == 0
    none = positional.report(frame, items.where("false")).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] or r["n_items"] for r in none)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_joined_as_broadcast(spark, limit, monkeypatch, data, documents):
    """With real items in many copies, whichever way the benchmark's tables are joined."""
    monkeypatch.setattr(positional, "BROADCAST_ROWS", limit)
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    docs = documents.select("doc_id", "text").where("doc_id < 120")
    copied = docs.unionByName(docs.where("doc_id < 5").crossJoin(spark.range(40)).select("doc_id", "text"))
    plain = [(r["doc_id"], r["text"]) for r in copied.collect()]
    assert rows(positional.report(copied, bench)) == decontaminated(plain, [(r["item_id"], r["text"]) for r in bench.collect()])


def test_proximity(spark):
    docs = [(1, "red x green y blue z red"), (2, "blue green red"), (3, "red green"), (4, "green a b c d blue red green e blue")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    phrases = [["red", "green", "blue"], ["green", "blue"], ["red", "red"], ["nowhere", "red"]]
    stages = Stages(spark, "test")
    index = positional.Index(frame, spark.createDataFrame([(p,) for p in phrases], "phrase array<string>"), stages)
    names = {r["pid"]: tuple(r["phrase"]) for r in index.phrases.collect()}
    ids = {(r["k1"], r["k2"]): r["doc_id"] for r in index.documents.collect()}
    for within in (2, 3, 5):
        got = {(ids[r["k1"], r["k2"]], names[r["pid"]], r["start"]) for r in positional.proximity(index, within).collect()}
        want = set()
        for d, text in docs:
            w = words(text)
            for p in phrases:
                for s in range(len(w)):
                    if w[s] in p and set(p) <= set(w[s : s + within]):
                        want.add((d, tuple(p), s + 1))
        assert got == want


def whitened(vectors, most):
    """(deviations, whitened but for signs, explained)."""
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = x - x.mean(axis=0)
    e, v = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-e)[:most]
    return ((n * x - s) ** 2).sum(axis=1), z @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize(("width", "tile", "block"), [(5, 2, 7), (40, 32, 8192), (33, 16, 50)])
def test_whitening(spark, width, tile, block):
    rng = np.random.default_rng(width)
    v = (rng.normal(size=(300, width)) @ rng.normal(size=(width, width)) + 50).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, component int").repartition(5)
    got = whitening.whiten(frame, tile=tile, block=block).orderBy("vec_id", "component").toPandas()
    most = min(width, 32)
    deviation, want, explained = whitened(v.astype(float), most)
    own = got["whitened"].to_numpy().reshape(300, most)
    assert (got["deviation"].to_numpy().reshape(300, most) == deviation[:, None]).all() and (got["n"] == 300).all()
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-6
    assert np.allclose(got["explained"][:most], explained, rtol=1e-9) and got["identity_error"].max() < 1e-6
    assert np.abs(np.cov(own.T, bias=True) - np.eye(most)).max() < 1e-6


def test_whitening_of_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    vectors = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 0.0]), (5, [inf, 0.0]), (None, [3.0, 5.0]), (6, [4.0]), (7, []), (8, [3e38, -3e38])]
    frame = spark.createDataFrame([(*x, 1.0) for x in vectors], "vec_id long, embedding array<float>, n double")
    got = whitening.whiten(frame).collect()
    assert sorted(str(r["vec_id"]) for r in got if r["component"] == 1) == sorted(map(str, (1, 1, None, 6, 7, 8))) and {r["n"] for r in got} == {6}
    assert all(math.isfinite(r["whitened"]) for r in got)
    assert whitening.whiten(frame.where("false")).count() == 0 and whitening.whiten(frame.where("vec_id = 7")).count() == 0
    one = whitening.whiten(frame.where("vec_id = 1")).collect()
    assert {(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in one} == {(0.0, 0, 0.0, 0.0)}
    assert whitening.squares(np.array([[1 << 40], [3]])) == [None, 9]


def clustered(rows, k=8, rounds=10, entries=64):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == entries and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))[:k]
    centroids = [list(q) for _, q in first]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own: dict = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        for i, qs in own.items():
            centroids[i] = [sum(x) // len(qs) for x in zip(*qs, strict=True)]
    found = [(i, *near(q)) for i, q in kept]
    inertia = {c: sum(d for _, d, x in found if x == c) for _, _, c in found}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def test_annulus_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 64))
    vectors = [(i, (centres[i % 9] + rng.normal(size=64) * (0.1 if i % 2 else 2)).round(3).tolist()) for i in range(150)]
    vectors += [(7, vectors[7][1]), (None, vectors[3][1]), (200, None), (201, [0.0] * 63), (202, [math.nan] * 64), (203, [None] * 64), (204, [0.0] * 64), (205, [-1.0] + [0.0] * 63), (206, [1.0] + [0.0] * 63)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster int").repartition(6)
    assert rows(annulus.cluster(frame)) == clustered(vectors)
    few = [v for v in vectors if v[0] in (1, 2, 204)]
    assert rows(annulus.cluster(frame.where("vec_id in (1, 2, 204)"))) == clustered(few)
    assert annulus.cluster(frame.where("false")).count() == 0
    huge = annulus.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")).collect()
    assert {r["distance"] for r in huge} == {0}


def test_annulus_finds_the_nearest_with_ties():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 60):
        c = rng.integers(-6, 7, size=(k, 3)).tolist()
        q = rng.integers(-8, 9, size=(500, 3))
        number, distance = annulus.Annulus(c).nearest(q)
        d = ((q[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
        assert (distance == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()


def test_surrogates_keep_what_their_type_needs(spark):
    from tessera.llm import pii

    def valid(iban):
        iban = iban.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1

    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "DE88370400440532013000"]
    rows = [(k, f"x {v} y") for k, v in enumerate(ibans)]
    phones = ["+49 30 1234567", "+49301234567", "+49 (30) 123-4567", "+1 301 234 567", "+4930 1234567", "+442079460958", "(301) 234-5678"]
    rows += [(10 + k, f"call {v}.") for k, v in enumerate(phones)]
    rows += [(20, "我们见到王小明先生和昨天李女士"), (21, "王小明先生"), (22, "欧阳娜女士"), (23, "就是王小明先生"), (30, "at 192.168.1.7"), (31, "at 10.2.3.4"), (32, "at 8.8.8.8"), (40, " ".join(f"a{i}@b{i % 9}.org" for i in range(3_000)))]
    out = {r["doc_id"]: r["text"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    made = [out[k].removeprefix("x ").removesuffix(" y") for k in range(4)]
    assert [valid(v) for v in made] == [True, True, True, False] and all(a[:2] == b[:2] and a != b and len(a) == len(b) for a, b in zip(made, ibans, strict=True))
    numbers = [re.sub("[^0-9+]", "", out[10 + k]) for k in range(7)]
    assert len({numbers[0], numbers[1], numbers[2], numbers[4]}) == 1 and numbers[0].startswith("+49") and numbers[3].startswith("+1") and numbers[5].startswith("+44")
    assert numbers[0][3:] != numbers[3][2:] and len(numbers[5]) == 13 and out[12][5:9] == "+49 " and out[12][9] == "("
    han = out[21].removesuffix("先生")
    assert out[20].startswith(f"我们见到{han}先生和昨天") and out[20].endswith("女士") and out[23] == f"就是{han}先生" and "王小明" not in out[20] and "李女士" not in out[20]
    assert "欧阳" not in out[22] and out[30].startswith("at 192.168.") and out[31].startswith("at 10.") and not re.match("at (10|127|172|192|169|100)[.]", out[32])
    assert len(set(out[40].split())) == 3_000 and not set(out[40].split()) & set(rows[-1][1].split())


def test_a_labelled_id_repeated_very_often_stays_one_row(spark):
    from tessera.llm import linecrf

    docs = spark.range(400).selectExpr("id as doc_id", "concat('line ', id, if(id % 2 = 0, '\\nA good sentence of words.', '\\n### !!! ###')) as text")
    many = docs.unionByName(spark.range(60_000).selectExpr("7L as doc_id", "concat('copy ', id % 5) as text"))
    labels = spark.range(400).selectExpr("id as doc_id", "cast(1 - id % 2 as int) as quality")
    from unittest import mock

    seen = []
    with mock.patch.object(linecrf.Chain, "fit", classmethod(lambda cls, x, n_lines, y: (seen.append(len(n_lines)), linecrf.Chain(np.zeros(x.shape[1]), np.zeros((2, 2))))[1])):
        linecrf.train(many, labels)
    assert seen[0] <= 400
