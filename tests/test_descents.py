from dataclasses import replace

import numpy as np
import pytest

from flowsight.models import descents, outliers
from flowsight.models.settings import PRESETS

QUICK = PRESETS["quick"]


def exact_boundary(z, nu):
    """The one-class SVM's dual, solved by moving weight between pairs of rows until none gains."""
    n = len(z)
    weight, most = np.full(n, 1.0 / n), 1.0 / (nu * n)
    products = z @ z.T
    for _ in range(200_000):
        slope = products @ weight
        to = np.argmin(np.where(weight < most - 1e-15, slope, np.inf))
        source = np.argmax(np.where(weight > 1e-15, slope, -np.inf))
        if slope[source] - slope[to] < 1e-10:
            break
        bend = products[to, to] + products[source, source] - 2 * products[to, source]
        moved = min(weight[source], most - weight[to], (slope[source] - slope[to]) / max(bend, 1e-12))
        weight[to] += moved
        weight[source] -= moved
    return weight @ z


def frame(spark, data, partitions=4):
    names = [f"x{i}" for i in range(data.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, ", ".join(["i int", *[f"{c} double" for c in names]])).repartition(partitions), names


def test_gradient_is_that_of_the_loss():
    rng, sizes = np.random.default_rng(1), (3, 5, 2, 3)
    x, weights = rng.normal(size=(20, 3)), descents.start_weights((3, 5, 2, 3), 7)
    sums = descents.network_sums(x, descents.layers_of(weights, sizes))
    assert sums[0] == pytest.approx(0.5 * descents.reconstruction_errors(x, descents.layers_of(weights, sizes)).sum())
    for i in rng.choice(len(weights), 25, replace=False):
        step = np.zeros(len(weights))
        step[i] = 1e-6
        up, down = (descents.network_sums(x, descents.layers_of(weights + s, sizes))[0] for s in (step, -step))
        assert sums[1 + i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_shortest_mix_of_atoms():
    atoms = np.array([[1.0, 2.0], [3.0, -2.0], [4.0, 4.0]])
    mix = descents.shortest_mix(atoms, np.array([1.0, 0.0, 0.0]))
    across = atoms[1] - atoms[0]
    share = -(atoms[0] @ across) / (across @ across)
    assert np.allclose(mix, [1 - share, share, 0.0])


@pytest.mark.parametrize("nu", [0.05, 0.1, 0.3])
def test_boundary_equals_the_exact_one_and_its_share_is_nu(spark, nu):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=(400, 3)), rng.normal(size=(200, 3)) * 0.3 + [3, 3, 0]])
    df, names = frame(spark, data)
    settings = replace(QUICK, contamination=nu, descent_passes=40, isolation_trees=5)
    fitted = outliers.fit_detectors(df, names, ("i",), settings)
    z = descents.features_of((data - fitted.mean) / fitted.scale, fitted.directions, fitted.phases)
    exact = exact_boundary(z, nu)
    assert fitted.boundary @ fitted.boundary == pytest.approx(exact @ exact, rel=0.02)
    assert np.linalg.norm(fitted.boundary - exact) <= 0.12 * np.linalg.norm(exact)
    scored = outliers.score_outliers(df, fitted).toPandas()
    assert (scored["kernel_score"] > 0).mean() == pytest.approx(nu, abs=0.01)
    flagged = outliers.flag_outliers(outliers.score_outliers(df, fitted), settings).toPandas()
    assert (flagged["kernel_score_flag"] == (flagged["kernel_score"] > 0)).all()


def test_network_finds_outliers_that_a_projection_misses(spark):
    """Every column and every pair of columns of the planted rows looks usual; only the curve they leave tells."""
    rng = np.random.default_rng(4)
    turn = rng.uniform(-1, 1, 1500)
    data = np.column_stack([turn, turn**2, np.sin(3 * turn), np.cos(3 * turn)]) + rng.normal(size=(1500, 4)) * 0.02
    planted = np.arange(30)
    data[planted] = np.column_stack([rng.permutation(data[100:130, i]) for i in range(4)])
    df, names = frame(spark, data)
    settings = replace(QUICK, network_layers=(16, 2, 16), descent_passes=80, isolation_trees=5)
    scored = outliers.score_outliers(df, outliers.fit_detectors(df, names, ("i",), settings)).toPandas().set_index("i")
    x = (data - data.mean(axis=0)) / data.std(axis=0)
    axis = np.linalg.svd(x, full_matrices=False)[2][:2]
    projected = ((x - x @ axis.T @ axis) ** 2).mean(axis=1)

    def found(error):
        return np.isin(np.argsort(-error)[:30], planted).mean()

    network = found(scored["autoencoder_error"].sort_index().to_numpy())
    assert network >= 0.8 and network >= found(projected) + 0.3
    assert scored["autoencoder_error"].mean() < 0.5 * projected.mean()


def test_fit_does_not_depend_on_the_split(spark):
    data = np.random.default_rng(5).normal(size=(300, 3))
    fits = []
    for partitions in (1, 7, descents.GROUPS + 9):
        df, names = frame(spark, data, partitions)
        fits.append(outliers.fit_detectors(df, names, ("i",), replace(QUICK, isolation_trees=5, descent_passes=8)))
    for other in fits[1:]:
        assert np.allclose(fits[0].boundary, other.boundary, atol=1e-9)
        assert np.allclose(fits[0].network, other.network, atol=1e-7)
        assert fits[0].rho == pytest.approx(other.rho, abs=1e-9)


def test_quick_features_equal_the_exact_ones():
    rng = np.random.default_rng(6)
    x, directions, phases = rng.normal(size=(100, 4)) * 50, rng.normal(size=(4, 16)), rng.uniform(0, 6, 16)
    quick = descents.quick_features_of(x, directions / (2 * np.pi), phases / (2 * np.pi))
    assert np.allclose(quick, descents.features_of(x, directions, phases), atol=1e-6, rtol=0)
