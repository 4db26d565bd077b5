"""Networks: gradients against numeric ones, training, stored weights, perturbation bounds."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import networks as N

SMALL = {
    "mlp": lambda: [N.Dense(5), N.Relu(), N.Dropout(0.0), N.Dense(2)],
    "cnn": lambda: [N.Sequence1(), N.Conv(3, 3), N.Relu(), N.HalfMax(), N.Conv(4, 3), N.Relu(), N.GlobalMax(), N.Dense(3), N.Relu(), N.Dense(2)],
    "lstm": lambda: [N.Sequence1(), N.Lstm(4), N.Dense(3), N.Relu(), N.Dense(2)],
}


@pytest.mark.parametrize("kind", SMALL)
def test_gradients_numerically(kind):
    rng = np.random.default_rng(1)
    net = N.Network.build(kind, 7, SMALL[kind](), seed=3)
    for p in net.weights:  # away from the corner of a unit that is exactly 0
        p.update({k: v + 0.01 + 0.01 * rng.random(v.shape) for k, v in p.items() if k == "b"})
    x, y, w = rng.random((6, 7)), np.array([0, 1, 1, 0, 1, 0]), rng.random(6) + 0.5
    _, grads = N.loss_and_gradients(net, x, y, w)
    for i, p in enumerate(net.weights):
        for k, value in p.items():
            for at in [tuple(rng.integers(s) for s in value.shape) for _ in range(4)]:
                ends = []
                for h in (1e-6, -1e-6):
                    value[at] += h
                    ends.append(N.loss_and_gradients(net, x, y, w)[0])
                    value[at] -= h
                assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grads[i][k][at], abs=1e-6)
    slope = net.slope(x)
    for j in range(7):
        d = np.zeros(7)
        d[j] = 1e-6
        assert (net.margin(x + d) - net.margin(x - d)) / 2e-6 == pytest.approx(slope[:, j], abs=1e-6)


@pytest.mark.parametrize("kind", N.ARCHITECTURES)
def test_training_stored_weights_and_scoring(spark, tmp_path, kind):
    rng = np.random.default_rng(0)
    x = rng.random((900, 6))
    y = (x @ np.array([3, -2, 1, 0, 0, 1.0]) > 1.2).astype(int)
    net = N.Network.build(kind, 6, seed=1)
    epochs, rate = (60, 0.01) if kind == "lstm" else (25, 0.004)
    history = N.train(net, x, y, epochs=epochs, batch=64, rate=rate, patience=20, plateau=10)
    assert min(history) < history[0] and ((net.margin(x) >= 0) == (y == 1)).mean() > 0.9
    net.save(str(tmp_path / "net.npz"))
    again = N.Network.load(str(tmp_path / "net.npz"))
    assert (again.logits(x) == net.logits(x)).all() and N.parameters(again) == N.parameters(net)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:40])] + [(99, None)], "id long, x array<double>")
    got = {r.id: r for r in N.scored(df, "x", net).collect()}
    z = net.logits(x[:40])
    assert got[99].prob is None and all(got[i].logit == pytest.approx(z[i, 1] - z[i, 0]) and 0 < got[i].prob < 1 for i in range(40))
    with pytest.raises(Exception, match="features"):
        N.scored(df.withColumn("x", F.slice("x", 1, 5)), "x", net).collect()


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = spark.range(3000).select("id", F.array(F.when(F.col("id") < 2000, 0.5).otherwise(F.col("id") / 3000)).alias("x"), (F.col("id") % 2).alias("y"))
    x, y, w = N.training_sample(rows, "id", "x", "y", 500)
    assert len(x) == len(y) == 500 and (x[:, 0] == 0.5).sum() > 200 and (w == 1).all()
    x, y, _ = N.training_sample(rows.unionByName(rows.limit(1).selectExpr("-1L AS id", "x", "null AS y")), "id", "x", "y", 10_000)
    assert len(x) == 3000
    with pytest.raises(ValueError):
        N.training_sample(rows.limit(0), "id", "x", "y", 10)


def test_every_row_is_trained_on(spark, monkeypatch):
    """More rows than the samples hold, ids that repeat, rows without a vector or label: all others reach the networks."""
    seen, train = spark.sparkContext.accumulator(0), N.train

    def counted(network, x, y, *args, **settings):
        seen.add(len(x) + 100_000 * int(y.sum()))
        return train(network, x, y, *args, epochs=1, **settings)

    monkeypatch.setattr(N, "train", counted)
    rows = spark.range(25_003).select(F.least("id", F.lit(20_000)).alias("id"), F.array(F.col("id") / 25_003, F.lit(0.5)).alias("x"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    rows = rows.withColumn("x", F.when(F.col("id") != 7, F.col("x"))).withColumn("y", F.when(F.col("id") != 8, F.col("y")))
    assert list(N.fitted_each(("mlp",), rows, "id", "x", "y")) == ["mlp"] and seen.value == 25_001 + 100_000 * 5_001
    with pytest.raises(ValueError, match="no labelled row"):
        N.fitted_each(("mlp",), rows.limit(0), "id", "x", "y")
    with pytest.raises(Exception, match="different lengths"):
        N.fitted_each(("mlp",), rows.withColumn("x", F.slice("x", 1, 1 + F.col("id").cast("int") % 2)), "id", "x", "y")


def test_tasks_train_together(spark):
    """One task trains as the driver does; three find the same weights each time, whatever the input's partitions."""
    rng = np.random.default_rng(0)
    x = rng.random((900, 6))
    y = (x @ np.array([3, -2, 1, 0, 0, 1.0]) > 1.2).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, y int").repartition(5)
    settings = {"epochs": 25, "batch": 64, "rate": 0.004, "patience": 20, "plateau": 10}
    here, one = N.trained_each(("mlp",), x, y, np.ones(900), **settings)["mlp"], N.trained_on_all(("mlp",), df, "id", "x", "y", 1, **settings)["mlp"]
    assert np.allclose(one.margin(x), here.margin(x), rtol=0, atol=1e-6)
    three = [N.trained_on_all(("mlp", "cnn"), rows, "id", "x", "y", 3, **settings) for rows in (df, df.coalesce(2))]
    for kind in ("mlp", "cnn"):
        assert all((p[k] == q[k]).all() for p, q in zip(three[0][kind].weights, three[1][kind].weights) for k in p)
    assert ((three[0]["mlp"].margin(x) >= 0) == (y == 1)).mean() > 0.9
    assert N.tasks_for(spark, 500) == 1 and N.tasks_for(spark, 2_999) == min(2, spark.sparkContext._jsc.sc().maxNumConcurrentTasks(spark.sparkContext._jsc.sc().resourceProfileManager().defaultResourceProfile()))


def test_a_step_of_a_team_is_that_of_its_rows_together():
    """Uneven shares, one of them empty: the step goes along the gradient over all rows that are not held out."""
    meet, sent = Barrier(3), {}

    class Together:
        size = 3

        def __init__(self, member):
            self.member = member

        def total(self, own):
            sent[self.member] = own
            meet.wait()
            out = sent[0] + sent[1] + sent[2]
            meet.wait()
            return out

    rng = np.random.default_rng(5)
    x, y = rng.random((60, 4)), rng.integers(0, 2, 60)
    shares = [slice(0, 41), slice(41, 60), slice(60, 60)]
    nets = [N.Network.build("mlp", 4, [N.Dense(5), N.Relu(), N.Dense(2)], seed=1) for _ in range(4)]
    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(N.train, nets[i], x[at], y[at], epochs=1, batch=100, rate=0.1, team=Together(i)) for i, at in enumerate(shares)]
        losses = [job.result()[0] for job in jobs]
    used, held = [], []
    for i, (at, n) in enumerate(zip(shares, (41, 19, 0))):
        order = np.arange(60)[at][np.random.default_rng([0, i]).permutation(n)]
        held, used = [*held, *order[: n // 10]], [*used, *order[n // 10 :]]
    _, grads = N.loss_and_gradients(nets[3], x[used], y[used], np.ones(len(used)))
    for i in range(3):
        for p, q, g in zip(nets[i].weights, nets[3].weights, grads):
            for k in p:
                assert np.allclose(p[k], N._adam(q[k], g[k], {k: (0, 0)}, k, 1, 0.1), rtol=0, atol=1e-6)
    assert losses == [pytest.approx(N.loss_of(nets[0], x[held], y[held], np.ones(len(held))))] * 3


@pytest.mark.parametrize("kind", SMALL)
@pytest.mark.parametrize("attack,settings", [("fgsm", {"eps": 0.07}), ("bim", {"eps": 0.07, "steps": 5}), ("pgd", {"eps": 0.07, "steps": 5, "restarts": 2}), ("deepfool", {"steps": 8})])
def test_bounds_and_effect(kind, attack, settings):
    rng = np.random.default_rng(2)
    net = N.Network.build(kind, 7, SMALL[kind](), seed=5)
    x, ids = rng.random((80, 7)), list(range(80))
    y = (net.margin(x) >= 0).astype(int)  # every row is answered rightly
    adv = N.perturbed(net, attack, x, y, ids, **settings)
    assert adv.min() >= 0 and adv.max() <= 1 and np.isfinite(adv).all()
    if "eps" in settings:
        assert np.abs(adv - x).max() <= settings["eps"] + 1e-12
    before, after = net.margin(x) * np.where(y == 1, 1, -1), net.margin(adv) * np.where(y == 1, 1, -1)
    assert after.mean() < before.mean() and (after < before + 1e-9).mean() > 0.75
    half = slice(0, 40)
    assert np.allclose(N.perturbed(net, attack, x[half], y[half], ids[half], **settings), adv[half])


def test_deepfool_leaves_rows_on_the_other_side_and_unknown_names_raise():
    net = N.Network.build("mlp", 7, SMALL["mlp"](), seed=5)
    x = np.random.default_rng(3).random((20, 7))
    wrong = (net.margin(x) < 0).astype(int)
    assert (N.perturbed(net, "deepfool", x, wrong, range(20)) == x).all()
    with pytest.raises(ValueError):
        N.perturbed(net, "nope", x, wrong, range(20))
    with pytest.raises(ValueError):
        N.Network.build("nope", 3)


@pytest.mark.parametrize("kind", SMALL)
def test_rows_are_not_asked_again_for_what_is_known(kind):
    """The attacks written out as loops over all rows; the cells ask the network less often."""
    net, rng = N.Network.build(kind, 7, SMALL[kind](), seed=5), np.random.default_rng(2)
    x, ids = rng.random((90, 7)), list(range(90))
    y = (rng.random(90) < 0.7).astype(int)
    sign = np.where(y == 1, -1.0, 1.0)[:, None]
    n_asked = [0, 0]

    def slope(at):
        n_asked[0] += len(at)
        return net.slope(at)

    def toward(now, size):
        return np.clip(np.clip(now + size * np.sign(slope(now)) * sign, x - 0.1, x + 0.1), 0, 1)

    expected = {"fgsm": toward(x, 0.1), "bim": x, "pgd": np.clip(x + 0.1 * N.start_of(ids, 7, 0), 0, 1), "deepfool": x.copy()}
    for _ in range(10):
        expected["bim"], expected["pgd"] = toward(expected["bim"], 0.02), toward(expected["pgd"], 0.02)
        margin, g = net.margin(expected["deepfool"]), slope(expected["deepfool"])
        n_asked[0] += len(x)
        on = (margin >= 0) == (y == 1)
        moved = np.clip(expected["deepfool"] - 1.02 * (margin / np.maximum((g * g).sum(axis=1), 1e-12))[:, None] * g, 0, 1)
        expected["deepfool"] = np.where(on[:, None], moved, expected["deepfool"])

    class Counted(N.Network):
        def run(self, at, masks=None):
            n_asked[1] += len(at)
            return N.Network.run(self, at, masks)

    counted = Counted(net.kind, 7, net.weights, layers=net.layers, shapes=net.shapes)
    for _, attack, clean, adv in N._each({"m": counted}, {"fgsm": {}, "bim": {}, "pgd": {}, "deepfool": {}}, x, y, ids):
        assert np.allclose(clean, net.margin(x), rtol=0, atol=1e-12) and np.allclose(adv, expected[attack], rtol=0, atol=1e-9)
    assert n_asked[1] < 0.75 * n_asked[0]


def test_the_gradients_of_blocks_add_up():
    """Masks are drawn for all rows at once, and threads do not change the sums."""
    net, rng = N.Network.build("mlp", 5, seed=2), np.random.default_rng(3)
    x, y, w = rng.random((700, 5)), rng.integers(0, 2, 700), rng.random(700)
    masks = net.masks(700, np.random.default_rng(9))
    z, caches = net.run(x, masks)
    q = N.softmax(z)
    q[np.arange(700), y] -= 1
    whole = net.pull(caches, q * (w / w.sum())[:, None])[1]
    with ThreadPoolExecutor(3) as pool:
        results = [N.loss_and_gradients(net, x, y, w, np.random.default_rng(9), each) for each in (map, pool.map)]
    for i, p in enumerate(net.weights):
        for k in p:
            assert np.allclose(results[0][1][i][k], whole[i][k], rtol=0, atol=1e-12) and (results[0][1][i][k] == results[1][1][i][k]).all()
    assert results[0][0] == results[1][0]


def test_cells_in_one_pass(spark):
    net = N.Network.build("mlp", 3, [N.Dense(4), N.Relu(), N.Dense(2)], seed=1)
    df = spark.createDataFrame([(i, [i / 50, 0.5, 1 - i / 50], i % 2, "c") for i in range(50)] + [(50, None, 1, "c"), (51, [0.1, 0.2, 0.3], None, "c")], "id long, x array<double>, y int, attack string")
    rows = N.perturbation_cells(df, {"a": net, "b": net}, {"fgsm": {}, "deepfool": {}}, "id", "x", "y").collect()
    assert len(rows) == 200 and {(r.attack, r.model) for r in rows} == {(a, m) for a in ("fgsm", "deepfool") for m in "ab"}
    assert N.perturbation_cells(df.limit(0), {"a": net}, {"fgsm": {}}, "id", "x", "y").count() == 0
