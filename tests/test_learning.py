"""Mini-batch k-means against full k-means, TF-IDF by hand, bootstraps against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ventura.operators import clustering as C
from ventura.operators import learning as L
from ventura.plans.model import Tables

DIR = "/root/testdata/sf0.01"


def full_kmeans(x, centres, rounds=50):
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(moved, centres):
            break
        centres = moved
    return ((x[:, None] - centres[None]) ** 2).sum(-1).min(1).sum()


def test_inertia_is_near_full_kmeans_and_runs_are_equal(spark):
    n, k = 2000, 12
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(k, 6)) * 3
    x = middles[rng.integers(k, size=n)] + rng.normal(size=(n, 6))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>").select("id", F.sequence(F.lit(0), F.lit(5)).alias("at"), F.col("v").alias("x"))
    centres = C.minibatch_kmeans(df, k, 6)
    assigned = C.assign(df, centres)
    inertia = assigned.agg(F.sum("distance")).first()[0]
    best = min(full_kmeans(x, x[np.random.default_rng(s).choice(n, k, replace=False)]) for s in range(3))
    assert inertia < 1.05 * best
    once, again = (C.minibatch_kmeans(rows, k, 6, steps=2) for rows in (df, df.repartition(7)))
    assert np.allclose(once, again, atol=1e-9)
    near = {r["id"]: r["cluster"] for r in assigned.collect()}
    want = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert [near[i] for i in range(n)] == want.tolist()
    assert C.representatives(assigned, 2).groupBy("cluster").count().filter("count > 2").count() == 0


def test_kmeans_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0], [1.0]), (2, [0], [1.0]), (3, [1], [1.0]), (4, [], [])], "id long, at array<int>, x array<double>")
    centres = C.minibatch_kmeans(df, 9, 2, steps=2, batch=8)
    assert len(centres) == 4 and C.assign(df, centres).agg(F.sum("distance")).first()[0] < 1e-9
    assert len(C.minibatch_kmeans(df.limit(0), 3, 2)) == 0


def test_tf_idf_by_hand(spark):
    docs = spark.createDataFrame([(1, "red Red fox and the fox"), (2, "red wolf"), (3, None), (4, "x y")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in C.tf_idf(docs, min_df=1, max_df=1.0).collect()}
    idf = lambda df: 1 + np.log(5 / (1 + df))
    raw = {"red": (1 + np.log(2)) * idf(2), "fox": (1 + np.log(2)) * idf(1), "red red": idf(1), "red fox": idf(1), "fox fox": idf(1)}
    size = np.sqrt(sum(v * v for v in raw.values()))
    assert {t: pytest.approx(v / size) for t, v in raw.items()} == {t: v for (d, t), v in got.items() if d == 1}
    assert {d for d, _ in got} == {1, 2}
    assert {r["term"] for r in C.tf_idf(docs, min_df=2, max_df=0.5).collect()} == {"red"} and C.tf_idf(docs, min_df=3, max_df=1.0).count() == 0


def test_tf_idf_of_random_texts_by_hand(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, rng.integers(0, 60)), 400)) for _ in range(300)]
    rows = [(i % 280, "de" if i % 3 else "en", t) for i, t in enumerate(texts)]  # 20 ids in two rows
    tf, df, total = {}, {}, {}
    for i, _, text in rows:
        w = text.split()
        for t in (*w, *map(" ".join, zip(w, w[1:]))):
            tf[i, t] = tf.get((i, t), 0) + 1
    for (_, t), k in tf.items():
        df[t], total[t] = df.get(t, 0) + 1, total.get(t, 0) + k
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    for features, low, high in ((3, 8, 0.35), (40, 5, 0.1), (5000, 2, 0.9), (9, 1, 0.02)):  # the most frequent terms are often too frequent
        fit = sorted((t for t in df if low <= df[t] <= high * 280), key=lambda t: (-total[t], t))[:features]
        raw = {(i, t): (1 + np.log(k)) * (1 + np.log(281 / (1 + df[t]))) for (i, t), k in tf.items() if t in set(fit)}
        size = {}
        for (i, _), v in raw.items():
            size[i] = size.get(i, 0) + v * v
        got = C.tf_idf(docs, features=features, min_df=low, max_df=high, carried=("lang",)).collect()
        assert {(r["doc_id"], r["term"]): r["weight"] for r in got} == {k: pytest.approx(v / np.sqrt(size[k[0]])) for k, v in raw.items()}
        assert all(len(r["lang"]) == (2 if r["doc_id"] < 20 else 1) for r in got) and len(got) == len(raw)


def test_tf_idf_shuffles_no_document(spark):
    docs = Tables(spark, DIR).documents
    assert "Exchange hashpartitioning" not in C.tf_idf(docs)._jdf.queryExecution().executedPlan().toString()


def test_text_clusters_at_the_stated_size(spark):
    docs = Tables(spark, DIR).documents
    found = {r["id"]: r["cluster"] for r in C.text_clusters(docs, 50).collect()}
    assert len(set(found.values())) > 25 and len(found) > 0.9 * docs.count()


def test_beta_bootstrap(spark):
    counts = spark.createDataFrame([("a", 30, 100), ("b", 0, 5)], "k string, hits long, n long")
    got = {r["k"]: r for r in L.beta_bootstrap(counts, "k", "hits", "n").collect()}
    for k, (h, n) in {"a": (30, 100), "b": (0, 5)}.items():
        want = np.percentile(np.random.default_rng(3).beta(h + 0.5, n - h + 0.5, 400_000), [2.5, 50, 97.5])
        assert np.allclose([got[k]["lo"], got[k]["mid"], got[k]["hi"]], want, atol=0.01)
    assert got == {r["k"]: r for r in L.beta_bootstrap(counts.repartition(3), "k", "hits", "n").collect()}


def test_corrected_draws_have_their_number(spark):
    counts = spark.createDataFrame([("good", 300, 1000, 50, 5, 5, 50)], "bucket string, ai long, n long, tp long, fp long, fn long, tn long")
    made = L.corrected_draws(counts, "bucket", 2500, 1)
    assert made.count() == 2500 and made.agg(F.countDistinct("draw"), F.max("draw")).first()[0] == 2500


def test_bootstrap_f1_is_that_of_drawing_rows(spark):
    cells = {(True, True): 65, (True, False): 45, (False, True): 14, (False, False): 475}
    rows = [key for key, n in cells.items() for _ in range(n)]
    got = {r["measure"]: r for r in L.bootstrap_f1(spark.createDataFrame(rows, "p boolean, y boolean"), 20_000).collect()}
    p, y = (np.array([r[k] for r in rows]) for k in (0, 1))
    rng, f1 = np.random.default_rng(5), []
    for _ in range(4000):
        i = rng.integers(len(rows), size=len(rows))
        tp, fp, fn = (p[i] & y[i]).sum(), (p[i] & ~y[i]).sum(), (~p[i] & y[i]).sum()
        f1.append(2 * tp / (2 * tp + fp + fn))
    assert np.allclose([got["f1"]["lo"], got["f1"]["hi"]], np.percentile(f1, [2.5, 97.5]), atol=0.01)
    assert L.bootstrap_f1(spark.createDataFrame([], "p boolean, y boolean")).count() == 3
