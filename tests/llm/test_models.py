"""Resampling, centroid clustering and quality classification, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR

from airsift.llm import centroids, importance, queries, semantic
from airsift.llm.common import hashed_words

DOCS = "doc_id bigint, text string, source string, score string, rank int, _kept int"


def brute_resample(docs, target, draw=5):
    """Every rule in plain Python: {(doc_id, nth): (n_features, weight, score, rank)}."""

    def grams(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for text in target:
        np.add.at(t, grams(text)[1], 1)
    for _, text in docs:
        np.add.at(s, grams(text)[1], 1)
    all_s, all_t = int(s.sum()), int(t.sum())
    gain = [
        math.floor(1000 * math.log((int(b) + 1) * (all_s + 10000) / ((int(a) + 1) * (all_t + 10000))))
        for a, b in zip(s, t)
    ]
    rows = []
    for doc_id, text in docs:
        words, found = grams(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, words, len(found), weight, score, None])
    able = sorted(
        (r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2])
    )
    for place, row in enumerate(able[: draw * len(able) // 100], 1):
        row[5] = place
    return sorted(((r[0], *r[2:]) for r in rows), key=str)


@pytest.fixture(scope="module")
def some_docs():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["ÉtÉ", "x9", "don't", "a_b", "中文", "UP"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(600)]
    docs += [(700, None), (701, ""), (702, " .,;\x00 \t"), (None, " ".join(words)), (None, " ".join(words[::-1]))]
    docs += [(5, " ".join(words))] * 40  # copies of one id, and of one text
    docs += [(703, "long " * 60_000)]
    return docs


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_resampling_equals_brute_force(spark, some_docs):
    target = ["w1 w2 w3 w4 w5", "UP up x9", None, ""]
    frame = spark.createDataFrame([(d, t, "s", "x", 3, 4) for d, t in some_docs], DOCS)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame.repartition(7), wanted)
    assert got.columns == ["doc_id", "text", "source", "_kept", *importance.RESULT]
    assert result(got) == brute_resample(some_docs, target)
    # A share that cuts through the forty copies of one id, and other sketches.
    for draw, accuracy in ((37, 100), (93, 10_000), (100, 50)):
        settings = importance.Settings(draw=draw, accuracy=accuracy)
        got = importance.resample(frame, wanted, settings=settings)
        assert result(got) == brute_resample(some_docs, target, draw)
    empty = importance.resample(frame.limit(0), wanted)
    assert empty.columns == got.columns and empty.count() == 0
    none = importance.resample(frame, wanted.limit(0), keep=["doc_id"])
    assert result(none) == brute_resample(some_docs, [])
    short = frame.where("length(text) < 20")
    assert {r["rank"] for r in importance.resample(short, wanted).collect()} == {None}


def test_the_bracket_widens_until_it_holds_the_cutoff(spark):
    scores = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 77L ELSE id END AS score")
    ordered = sorted((r.score for r in scores.collect()), reverse=True)
    for accuracy in (2, 10, 10_000):
        for wanted in (1, 2, 40, 2500, 4999, 5000):
            low, high, above = importance.cutoff_bracket(scores, wanted, importance.Settings(accuracy=accuracy))
            assert low <= ordered[wanted - 1] <= high
            assert above == sum(s > high for s in ordered) < wanted


def test_op13_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF_DIR, "documents").collect()]
    target = [r.text for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    assert result(queries.op13_resample(spark, SF_DIR)) == brute_resample(docs, target)


def brute_clusters(vectors, rounds=5, clusters=40):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, sha256)] with Python integers."""
    kept = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in vectors
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if turn < rounds:
            for j in {j for _, j in near}:
                own = [v for (_, v), (_, k) in zip(kept, near) if k == j]
                at[j] = [sum(x) // len(own) for x in zip(*own)]
    per = [sum(d for d, k in near if k == j) for j in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, j, d, per[j], sum(per), sha[j]) for (i, _), (d, j) in zip(kept, near)]


def same_rows(got, want):
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


VECTORS = "vec_id bigint, embedding array<double>, cluster string, dots int"


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 64))
    some = centres[rng.integers(0, 30, 260)] / 8 + 0.05 * rng.standard_normal((260, 64))
    vectors = [(i, v.tolist()) for i, v in enumerate(some)]
    vectors += [(5, some[5].tolist())] * 90  # copies, of one id and of others
    vectors += [(1000 + i, some[7].tolist()) for i in range(30)]
    vectors += [(None, some[9].tolist()), (2000, [0.0] * 64), (2001, [-1e5] * 63 + [1e5])]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63]
    vectors += [(3000 + i, v) for i, v in enumerate(odd)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], VECTORS)
    got = centroids.cluster_vectors(frame.repartition(5), settings=centroids.Settings(block=50))
    same_rows(got.collect(), brute_clusters(vectors))
    few = [v for v in vectors if v[0] in (3, 5, 2000)]
    same_rows(centroids.cluster_vectors(frame.where("vec_id IN (3, 5, 2000)")).collect(), brute_clusters(few))
    none = centroids.cluster_vectors(frame.where("vec_id >= 3000"))
    assert none.columns == got.columns and none.count() == 0


def test_changes_are_exact_for_large_components():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-centroids.LARGEST, centroids.LARGEST, (20, 64))
    old = rng.integers(-centroids.LARGEST, centroids.LARGEST, (3, 64))
    new = old.copy()
    new[1, [3, 60]] += 7
    change = centroids.Change.between(old, new)
    assert [(j, at.tolist(), by.tolist()) for j, at, by in change.moved] == [(1, [3, 60], [7, 7])]
    dots = change.apply(vectors, centroids.exact_dots(vectors, old))
    wide = vectors.astype(object)
    assert (dots == wide @ new.astype(object).T).all()
    near, far = centroids.assigned(vectors, dots, new)
    exact = ((wide[:, None, :] - new.astype(object)[None]) ** 2).sum(axis=2)
    assert near.tolist() == exact.argmin(axis=1).tolist() and far.tolist() == exact.min(axis=1).tolist()


def test_op11_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    cursor = connection.execute(queries.oracle_sql()["op11_centroids"])
    got = queries.op11_centroids(spark, SF_DIR)
    assert [d[0] for d in cursor.description] == got.columns
    want = cursor.fetchall()
    same_rows(got.collect(), want)
    vectors = [(r.vec_id, r.embedding) for r in queries.table(spark, SF_DIR, "embeddings").collect()]
    same_rows(want, brute_clusters(vectors))


def brute_terms(text, settings):
    """Words, class runs and repetitions of one text, from its bytes one by one."""
    data, found = (text or "").encode(), collections.Counter()
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
    words = collections.Counter(hashed_words(batch)[0].tolist())
    for word, n in words.items():
        found[word % settings.words] += n
        found[settings.words + 4096 + math.ceil(math.log2(n))] += n
    kinds = []
    for byte in data:
        kind = next((k for k, some in enumerate(semantic._CLASSES) if chr(byte) in some and byte < 128), 12 + (byte < 128))
        if not (kinds and kinds[-1] == kind and kind in (0, 1, 2, 3, 4, 12)):
            kinds.append(kind)
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        found[settings.words + 256 * a + 16 * b + c] += 1
    return dict(found)


def test_terms_equal_brute_force():
    settings = semantic.Settings()
    said = ["The cat, the CAT!! 12 été\n\n  x", None, "", " \t", "A", "a  b", "中文 中文 a|b", "z" * 3000]
    said += [" ".join(f"w{i % 37}," for i in range(2000))]
    text, term, n = semantic.term_counts(pa.array(said), settings)
    for i, t in enumerate(said):
        own = text == i
        assert dict(zip(term[own].tolist(), n[own].tolist())) == brute_terms(t, settings), i
    # In pieces: words stay whole and are counted over all pieces of their text.
    cut = semantic.term_counts(pa.array(said), semantic.Settings(piece=500))
    for i, t in enumerate(said):
        if i == 7:
            continue  # one word longer than a piece
        for grams in (False, True):
            got = {a: b for x, a, b in zip(*cut) if x == i and (4096 <= a < 8192) == grams}
            want = {a: b for a, b in brute_terms(t, settings).items() if (4096 <= a < 8192) == grams}
            lost = sum(want.values()) - sum(got.values())
            assert got == want if not grams else 0 <= lost <= 2 * (len(t or "") // 450)


def test_votes_equal_brute_force(spark):
    docs, labels = (queries.table(spark, SF_DIR, t) for t in ("documents", "labels"))
    model = semantic.fit(docs.select("doc_id", "text"), labels)
    some = [r.text for r in docs.limit(50).collect()]
    vectors = model.project(pa.array(some))
    assert np.allclose((vectors.astype(float) ** 2).sum(axis=1), 1, atol=1e-5)
    score, nearest = model.vote(vectors)
    for i, v in enumerate(vectors):
        cosine = [float(v @ e) for e in model.vectors]
        best = sorted(range(len(cosine)), key=lambda j: -cosine[j])[: model.settings.neighbours]
        votes = [(max(cosine[j], 0) ** 4 * model.class_weight[int(model.good[j])], model.good[j]) for j in best]
        m = model.settings.prior
        want = (sum(w for w, g in votes if g) + m * model.base) / (sum(w for w, _ in votes) + m)
        assert abs(score[i] - want) < 1e-3 and abs(nearest[i] - cosine[best[0]]) < 1e-5
    # The space holds the main directions: no other of its size explains more.
    few = semantic.Settings(words=64, rank=5)
    text, term, n = semantic.term_counts(pa.array(some), few)
    weight = semantic.weighted(text, term, n, np.ones(few.terms), few)
    dense = np.zeros((50, few.terms))
    dense[text, term] = weight
    space = semantic._space(text, term, weight, 50, few)
    exact = np.linalg.svd(dense)[1][:5]
    assert np.allclose(np.linalg.norm(dense @ space, axis=0), exact, rtol=1e-3)


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op12_quality(spark, folder).collect()
    docs = queries.table(spark, folder, "documents")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in queries.table(spark, folder, "labels").collect()}
    held = [(label[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    pairs = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert pairs >= 0.97 * len(good) * len(bad)
    assert sum(p == 1 for y, _, p in held if y) >= 0.99 * len(good)
    assert sum(p == y for y, _, p in held) >= 0.95 * len(held)


def test_quality_of_odd_tables(spark, some_docs):
    frame = spark.createDataFrame([(d, t, "s", "x", 3, 4) for d, t in some_docs], DOCS)
    label = "doc_id bigint, quality int, toxic int"
    known = [(i, int(i % 4 > 0), 0) for i in range(0, 600, 2)]
    known += [(0, 0, 0), (8, None, 0), (9, 7, 0), (None, 1, 0), (703, 1, 1), (9999, 0, 0)]
    for labels in (known, known[:1], [r for r in known if r[1] == 1], []):
        model = semantic.fit(frame, spark.createDataFrame(labels, label))
        got = semantic.score_quality(frame, model)
        assert got.columns == ["doc_id", "text", "source", "rank", "_kept", "score", "predicted", "similarity"]
        rows = got.collect()
        assert len(rows) == len(some_docs) and all(0 <= r.score <= 1 for r in rows)
        blank = {r.score for r in rows if not (r.text or "").strip()}
        assert blank == {model.base}
        assert len({r.score for r in rows if r.doc_id == 5}) == 1 or labels == known
    many = semantic.Settings(max_examples=10)
    bounded = semantic.fit(frame, spark.createDataFrame(known, label), settings=many)
    assert len(bounded.good) <= 20
    assert semantic.score_quality(frame.limit(0), bounded).count() == 0
    assert len(semantic.fit(frame.limit(0), spark.createDataFrame(known, label)).good) == 0
