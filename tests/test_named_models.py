import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attack as AT
from tidemark.operators import deltas as DL
from tidemark.operators import embed as EM
from tidemark.operators import named_models as NM


@pytest.fixture(scope="module")
def rows(spark):
    """Delta rows of 60 samples with four neighbours; every fifth row has no media delta."""
    rng = np.random.default_rng(3)
    out = []
    for s in range(60):
        y = s % 2
        for k in range(4):
            media = None if (s + k) % 5 == 0 else [float(v) for v in rng.normal(y, 1, 3)]
            out.append((s, k, f"d{s % 3}", "m", y, float(rng.normal(y, 1)), [float(v) for v in rng.normal(0, 1, 4)], media))
    return spark.createDataFrame(out, "sample_id long, k int, ds_name string, model_name string, label int, loss_delta double, embedding_delta array<double>, image_delta array<double>").cache()


@pytest.mark.parametrize("name", sorted(NM.VARIANTS))
def test_every_variant_trains_validates_and_reloads(spark, rows, tmp_path, name):
    model = NM.train_named(name, rows, modality_dim=3, hidden=(6,), max_iter=15)
    spec = NM.variant(name)
    width = (8 if spec.periodic else 1) + 4 + (3 if spec.modality else 0)
    assert {r.n for r in model.features(rows).select(F.size("features").alias("n")).distinct().collect()} == {width}
    keys = ["ds_name", "model_name", "sample_id", "k"]
    before = {(r.sample_id, r.k): r.score for r in model.predict(rows, keys).collect()}
    model.save(str(tmp_path / "m"))
    again = NM.NamedAttack.load(spark, str(tmp_path / "m"))
    assert {(r.sample_id, r.k): r.score for r in again.predict(rows, keys).collect()} == before
    told = {r.ds_name: r for r in NM.validate(again, rows).collect()}
    for d, r in told.items():
        own = [(before[x.sample_id, x.k], x.label) for x in rows.where(F.col("ds_name") == d).collect()]
        want = sum(math.log(sum(math.exp(v) for v in s)) - s[y] for s, y in own) / len(own)
        assert math.isclose(r.log_loss, want, rel_tol=1e-9)


def test_unknown_names(rows):
    with pytest.raises(ValueError):
        NM.train_named("NoSuchModel", rows)
    with pytest.raises(ValueError):
        NM.register(NM.Variant("MyBaseLine", modality=True))
    with pytest.raises(ValueError):
        NM.train_named("BaseLine", rows.limit(0))
    assert NM.register(NM.Variant("MyMedia", "std", True)) is NM.variant("MyMedia")
    NM.VARIANTS.pop("MyMedia")


def test_network_gradients(spark, rows):
    model = NM.train_named("ModalityAllLossNormSTD", rows, modality_dim=3, hidden=(7, 5), max_iter=30)
    x = model.features(rows).withColumn("row", F.col("sample_id") * 10 + F.col("k"))
    net, plain = NM.Network(model.pipeline), x.select("features", "label").collect()
    m, y = np.array([r.features for r in plain]), np.array([r.label for r in plain])
    fitted = {tuple(r.features): r.score for r in AT.predict(model.pipeline, x, ["features"]).collect()}
    assert np.allclose(net.logits(m), [fitted[tuple(r)] for r in m], atol=1e-9)
    slope, h = net.gradient(m, y), 1e-5
    for d in range(m.shape[1]):
        step = np.zeros(m.shape[1])
        step[d] = h
        near = (net.logits(m + step) - net.logits(m - step))[np.arange(len(m)), y] / (2 * h)
        assert np.allclose(slope[:, d], near, atol=1e-5)
    got = NM.network_attributions(model.pipeline, x, "row").collect()
    assert len(got) == len(m) and all(abs(r.gap) < 1e-6 for r in got)
    calm = {r.row: r for r in NM.network_attributions(model.pipeline, x.limit(8), "row", noise_samples=50, sigma=1e-7).collect()}
    exact = {r.row: r.attr for r in got}
    assert all(np.allclose(r.attr, exact[k], atol=1e-4) and abs(r.gap) < 1e-6 for k, r in calm.items())
    none = NM.network_attributions(model.pipeline, x.limit(1).withColumn("features", F.lit(None).cast("array<double>")), "row").first()
    assert none.attr is None
    n = NM.block_norms(spark.createDataFrame([([3.0, 4.0, -7.0],)], "attr array<double>"), {"a": (0, 2), "b": (2, 1)}).first()
    assert (n.a_linf, n.a_l2, n.b_linf, n.b_l2) == (4.0, 5.0, 7.0, 7.0)


def test_aligned_media_and_deltas(spark):
    """Lists of the right length are zipped (repeats kept); others fall back to distinct neighbours and the base path."""
    nbrs = spark.createDataFrame([(s, k, n) for s in (1, 2, 3, 4) for k, n in enumerate(["x", "y", "x"])], "sample_id long, k int, neighbor string")
    media = spark.createDataFrame([(1, "b", ["p", None, "q"]), (2, "b", ["p"]), (3, "b", None)], "sample_id long, media_path string, media_neighbors array<string>")
    got = {(r.sample_id, r.k, r.neighbor, r.path) for r in EM.explode_neighbors(nbrs, media=media).collect()}
    rest = {(s, k, n, p) for s, p in ((2, "b"), (3, "b"), (4, None)) for k, n in ((0, "x"), (1, "y"))}
    assert got == {(1, 0, "x", "p"), (1, 1, "y", None), (1, 2, "x", "q")} | rest
    ignored = EM.explode_neighbors(nbrs, media=media, ignore_media=True)
    assert {(r.sample_id, r.k) for r in ignored.collect()} == {(s, k) for s in (1, 2, 3, 4) for k in (0, 1)}
    vectors = spark.createDataFrame([("p", [1.0, 2.0]), ("b", [0.5, 0.0])], "path string, vector array<double>")
    embeds = EM.media_vectors(EM.explode_neighbors(nbrs, media=media), media, vectors)
    found = {(r.sample_id, r.k): r.image_delta for r in DL.modality_deltas(embeds, "image").collect()}
    assert found[1, 0] == [0.5, 2.0] and found[1, 1] is None and found[1, 2] is None and found[2, 0] == [0.0, 0.0] and found[4, 0] is None
    back = {(r.sample_id, r.k): r.image_delta for r in DL.modality_deltas(embeds, "image", sign="input_minus_neighbor").collect()}
    assert back[1, 0] == [-0.5, -2.0]
    assert EM.explode_neighbors(nbrs.limit(0), media=media).count() == 0


def test_smoothgrad_equals_plain_draws(spark):
    """The noise is drawn by rows, once for an id, and rows of equal or null ids keep their own features."""
    rows = [(1, [1.0, 2.0]), (1, [0.5, -1.0]), (None, [3.0, 0.0]), (5, [])]
    df = spark.createDataFrame(rows, "id long, features array<double>")

    def gauss(i, s, at):
        h = hashlib.md5("|".join(str(x) for x in (42, i, s, at) if x is not None).encode()).hexdigest()
        u1, u2 = (int(h[:8], 16) + 1.0) / 4294967297.0, int(h[8:16], 16) / 4294967296.0
        return math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2)

    coef = [2.0, -3.0]
    out = AT.smoothgrad_linear(df, coef, "id", samples=7, sigma=0.5)
    assert "Generate explode" in out._jdf.queryExecution().optimizedPlan().toString()  # not one expression of a row
    got = sorted((str(r["id"]), [v and round(v, 9) for v in r["attr"]]) for r in out.collect())
    want = [(str(i), [round((v + 0.5 * sum(gauss(i, s, at) for s in range(1, 8)) / 7) * coef[at], 9) for at, v in enumerate(x)])
            for i, x in rows]
    assert [g for g in got if g[0] != "5"] == sorted(w for w in want if w[0] != "5") and len(got) == 4


def test_path_integral_by_layers_equals_the_gradients_mean():
    net = NM.Network.__new__(NM.Network)
    rng = np.random.default_rng(1)
    net.mean, net.scale = rng.normal(size=6), rng.uniform(0.5, 2, size=6)
    for sizes in ([6, 2], [6, 5, 2], [6, 5, 4, 2]):
        net.layers = [(rng.normal(size=(a, b)), rng.normal(size=b)) for a, b in zip(sizes[:-1], sizes[1:])]
        x, target = rng.normal(size=(9, 6)), rng.integers(0, 2, 9)
        node, weight = np.polynomial.legendre.leggauss(30)
        want = x * sum(w / 2 * net.gradient((n + 1) / 2 * x, target) for n, w in zip(node, weight))
        assert np.allclose(net.integrated(x, target, 30, rows=4), want, atol=1e-12)


def test_attributions_run_in_many_tasks(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(40)], "id long, label int, features array<double>").coalesce(1)
    model = AT.train(df, 2, hidden=(3,), max_iter=2)
    assert NM.network_attributions(model, df, "id", steps=4).rdd.getNumPartitions() > 1
