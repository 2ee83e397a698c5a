import numpy as np
from pyspark.sql import functions as F

from weirloom.llm import mixing


def tables(spark):
    rng = np.random.default_rng(0)
    usual, bad = [f"word{i}" for i in range(200)], ["idiot", "moron", "clown"]
    docs, labels = [], []
    for i in range(400):
        kind = i % 8
        own = list(rng.choice(usual, 30))
        if kind == 0:
            own += list(rng.choice(bad, 6))
        if kind == 1:
            own = [w + "%%%" for w in own]
        docs.append((i, " ".join(own), "x"))
        if i % 2 < 2 and i < 300:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stated_weights_are_met_and_toxic_documents_go(spark):
    docs, labels = tables(spark)
    out = mixing.mix(docs, labels)
    assert out.columns == ["doc_id", "text", *mixing.OWN]
    rows = out.toPandas()
    totals = lambda rate: np.array([(rate * rows["n_tokens"] * rows[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    goal, total = np.array(mixing.TARGET_WEIGHTS) * rows["n_tokens"].sum(), rows["n_tokens"].sum()
    assert np.abs(totals(1.0) - goal).max() > 0.05 * total  # the corpus has another mix
    assert np.abs(totals(rows["rate"]) - goal).max() < 0.01 * total
    # a fourth of these is not labelled, and one in fifty is misjudged; copies are drawn by rate
    toxic = rows[rows["doc_id"] % 8 == 0]
    assert (toxic["rate"] < 0.1).mean() > 0.95 and (toxic["copies"] == 0).mean() > 0.95
    assert (rows[rows["doc_id"] % 8 > 1]["copies"] > 0).all()
    assert (rows["rate"] >= 0).all()


def test_stated_targets(spark):
    docs, labels = tables(spark)
    out = mixing.mix(docs, labels, targets=[6000.0, 3000.0, 0.0]).toPandas()
    for d, want in zip(mixing.DOMAINS, (6000, 3000, 0)):
        assert abs((out["rate"] * out["n_tokens"] * out[f"p_{d}"]).sum() - want) < 30


def test_totals_against_a_plain_projected_gradient(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    n = rng.integers(1, 50, 200)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    for goal in ([1500.0, 300.0, 100.0], [100.0, 4000.0, 900.0], [50.0, 0.0, 0.0]):
        steps, _, totals = mixing.solve(members, goal)
        r, a = np.ones(200), p * n[:, None]
        scale = 1 / np.linalg.eigvalsh(p.T @ a).max()
        for _ in range(20000):
            r = np.maximum(0, r - scale * (p @ (r @ a - goal)))
        got = np.array([x[0] for x in members.select(mixing.rate(steps)).collect()])
        assert (got >= 0).all() and np.abs(got @ a - totals).max() < 1e-6
        assert np.linalg.norm(totals - goal) < np.linalg.norm(r @ a - goal) + 0.001 * n.sum()


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    out = mixing.mix(docs, labels.where("doc_id < 200")).where("doc_id >= 200").toPandas()
    truth = np.where(out["doc_id"] % 8 == 0, 2, np.where(out["doc_id"] % 8 == 1, 1, 0))
    assert (out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy().argmax(axis=1) == truth).mean() > 0.95


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    docs, labels = tables(spark)
    one, many = mixing.fit(docs, labels), mixing.fit(docs.union(docs).union(docs), labels)
    assert np.array_equal(one.slot, many.slot) and np.allclose(one.gain, many.gain) and np.allclose(one.base, many.base)


def test_nulls_empty_and_no_labels(spark):
    docs, labels = tables(spark)
    odd = spark.createDataFrame([(None, None, None), (1, "", "y"), (1, "", "y")], docs.schema)
    out = mixing.mix(odd, labels.limit(0)).collect()
    assert len(out) == 3 and all(r["rate"] == 1 and r["n_tokens"] == 0 for r in out)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.mix(docs, labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))).count() == 400
