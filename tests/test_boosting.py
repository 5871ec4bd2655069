"""Boosting by histograms against an exhaustive search, and the estimator around it."""

import itertools
import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorekit.functions import losses
from scorekit.plans import boosting, folds, histograms
from scorekit.plans.histograms import UNIT, Growth
from scorekit.sources import tables


def _data(n=240, features=4, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.integers(0, 2, n), np.full(n, 3.0)])[:, :features]
    y = ((x[:, 0] + 2 * x[:, 2] + rng.normal(size=n)) > 5).astype(float)
    return x, y, rng.integers(0, 3, n)


def _rows(spark, x, y, fold, weight=None):
    weight = np.ones(len(y)) if weight is None else weight
    rows = [(float(a), float(w), int(f), [float(v) for v in r]) for r, a, f, w in zip(x, y, fold, weight)]
    return spark.createDataFrame(rows, "y double, weight double, fold int, x array<double>").repartition(3)


def _exhaustive(x, y, weight, growth: Growth):
    """Trees by trying every cut of every node, with sums over the rows themselves."""
    cuts = []
    for f in range(x.shape[1]):
        v = np.sort(x[:, f])
        at = [v[i * len(v) // growth.bins] for i in range(1, growth.bins)]
        cuts.append(sorted({c for c in at if c < v[-1]}))
    margin = np.full(len(y), growth.start)
    ridge = lambda h: max(h + growth.l2 * UNIT, 1.0)
    for _ in range(growth.rounds):
        g, h = growth.derivatives(y, margin)
        g, h = np.floor(g * weight + 0.5), np.floor(h * weight + 0.5)
        value = np.zeros(len(y))
        nodes = [np.arange(len(y))]
        for level in range(growth.depth + 1):
            deeper = []
            for rows in nodes:
                best = None
                if level < growth.depth:
                    whole = g[rows].sum() ** 2 / ridge(h[rows].sum())
                    for f in range(x.shape[1]):
                        for c in cuts[f]:
                            left = rows[x[rows, f] <= c]
                            right = rows[x[rows, f] > c]
                            if min(len(left), len(right)) < growth.least_rows:
                                continue
                            gain = g[left].sum() ** 2 / ridge(h[left].sum()) + g[right].sum() ** 2 / ridge(h[right].sum()) - whole
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, left, right)
                if best:
                    deeper += [best[1], best[2]]
                else:
                    value[rows] = -growth.step * g[rows].sum() / ridge(h[rows].sum())
            nodes = deeper
        margin = margin + value
    return margin


SETTINGS = [
    Growth(rounds=4, depth=3, bins=16, step=0.3),
    Growth("focal_loss", rounds=3, depth=2, bins=5, step=0.5, l2=0.0, least_rows=7),
    Growth("focal_loss_scaled", {"gamma": 1.0}, rounds=2, depth=4, bins=256, start=0.2),
    Growth("weighted_log_loss", {"pos_weight": 2.5}, rounds=6, depth=1, bins=2),
]


@pytest.mark.parametrize("growth", SETTINGS, ids=lambda g: g.loss)
@pytest.mark.parametrize("cut_every", [2, 100])
def test_trees_equal_an_exhaustive_search(spark, growth, cut_every):
    x, y, fold = _data()
    weight = np.where(np.arange(len(y)) % 4 == 0, 2.5, 1.0)
    found = histograms.grow(_rows(spark, x, y, fold, weight), "x", x.shape[1], growth, models=2, cut_every=cut_every)
    for m, ensemble in enumerate(found):
        seen = fold != m
        # Bins are those of all rows; the models differ in the rows whose gradients count.
        assert len(ensemble.trees) == growth.rounds
        alone = histograms.grow(_rows(spark, x, y, np.where(seen, -1, 0), weight), "x", x.shape[1], growth)
        assert np.array_equal(alone[0].margins(x), ensemble.margins(x))
    whole = histograms.grow(_rows(spark, x, y, np.full(len(y), -1), weight), "x", x.shape[1], growth, cut_every=cut_every)
    assert np.allclose(whole[0].margins(x), _exhaustive(x, y, weight, growth), rtol=1e-12, atol=1e-12)


def test_dealing_of_rows_and_scans_change_nothing(spark, monkeypatch):
    x, y, fold = _data()
    rows = _rows(spark, x, y, fold)
    once = histograms.grow(rows, "x", 4, SETTINGS[0], models=3)
    monkeypatch.setattr(histograms, "CELLS_AT_ONCE", 1)
    monkeypatch.setattr(histograms, "ADDED_HERE", 0)
    again = histograms.grow(rows.repartition(11, "x"), "x", 4, SETTINGS[0], models=3)
    assert [[t.as_lists() for t in e.trees] for e in once] == [[t.as_lists() for t in e.trees] for e in again]


@pytest.mark.parametrize("name, options", [("weighted_log_loss", {"pos_weight": 3.0}), ("focal_loss", {}), ("focal_loss_scaled", {"alpha": 0.7})])
def test_losses_of_arrays_equal_those_of_columns(spark, name, options):
    grid = list(itertools.product([0.0, 1.0], np.linspace(-40, 40, 41)))
    g, h = getattr(losses, name)(F.col("y"), F.col("m"), **options)
    rows = spark.createDataFrame([(a, float(b)) for a, b in grid], "y double, m double").select("y", "m", g.alias("g"), h.alias("h")).collect()
    y, m = np.array([r["y"] for r in rows]), np.array([r["m"] for r in rows])
    found = histograms.LOSSES[name](y, m, **options)
    assert np.allclose(found[0], [r["g"] for r in rows], rtol=1e-9, atol=1e-15)
    assert np.allclose(found[1], [r["h"] for r in rows], rtol=1e-9, atol=1e-15)


def test_edges_of_few_values_of_a_sample_and_of_nothing(spark):
    rows = spark.range(1000).select(F.array((F.col("id") % 3).cast("double"), F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    few, many, one = histograms.fit_edges(rows, "x", 3, 4)
    assert few.tolist() == [0.0, 1.0] and many.tolist() == [250.0, 500.0, 750.0] and one.tolist() == []
    _, sampled, _ = histograms.fit_edges(rows, "x", 3, 4, sample_values=900)
    assert len(sampled) == 3 and np.allclose(sampled, [250, 500, 750], atol=120)
    assert [e.tolist() for e in histograms.fit_edges(rows.limit(0), "x", 3, 4)] == [[], [], []]
    assert histograms.codes_of(np.array([[-5.0, 250.0, 2.0], [9.0, 251.0, 0.0]]), [few, many, one]).tolist() == [[0, 0, 0], [2, 1, 0]]


@pytest.fixture(scope="module")
def vectors(spark):
    x, y, fold = _data(400)
    rows = [(i, int(a), int(f), *map(float, r)) for i, (r, a, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "ID long, label int, fold int, a double, b double, c double, d double").cache()


def _probability(model, df):
    return [r["p"] for r in model.transform(df).orderBy("ID").select(vector_to_array("probability")[1].alias("p")).collect()]


def test_a_saved_booster_scores_alike(spark, vectors, tmp_path):
    assembled = folds.assemble(vectors, ["a", "b", "c", "d"], ["ID", "label"])
    booster = boosting.NewtonBooster(loss="focal_loss", lossParams=json.dumps({"gamma": 1.5}), rounds=3, depth=2)
    booster.write().save(f"{tmp_path}/booster")
    again = boosting.NewtonBooster.load(f"{tmp_path}/booster")
    assert again.growth() == booster.growth() and again.growth().rounds == 3
    model = booster.fit(assembled)
    path = tables.write_model(model, str(tmp_path), "focal")
    loaded = boosting.NewtonBoosterModel.load(path)
    assert _probability(loaded, assembled) == _probability(model, assembled)
    assert loaded.featureImportances == model.featureImportances and loaded.growth() == model.growth()
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances[0] > 0.3
    tables.write_model(loaded, str(tmp_path), "focal")  # overwrites


def test_folds_side_by_side_equal_folds_one_by_one(vectors):
    learner = boosting.NewtonBooster(rounds=3, depth=2, loss="focal_loss")
    scores = folds.out_of_fold(vectors, ["a", "b", "c", "d"], {"n": learner}, k=3, test=vectors, pos_weight=4.0, arithmetic_folds=True)
    assert [type(m) for m in scores.models["n"]] == [boosting.NewtonBoosterModel] * 3
    assembled = folds.assemble(vectors, ["a", "b", "c", "d"], ["ID"])
    each = [_probability(m, assembled) for m in scores.models["n"]]
    for r in scores.train.collect():
        assert r["n"] == pytest.approx(each[r["fold"]][r["ID"]], abs=1e-12)
    for r in scores.test.collect():
        assert r["n"] == pytest.approx(np.mean([p[r["ID"]] for p in each]), abs=1e-12)
    report = folds.fold_importances(scores, "n")
    assert report.count() == 12 and report.agg(F.sum("importance")).first()[0] == pytest.approx(3)


def test_no_rows_and_one_class(spark, vectors):
    empty = folds.assemble(vectors.limit(0), ["a"], ["ID", "label"])
    model = boosting.NewtonBooster(start=0.0).fit(empty)
    assert _probability(model, folds.assemble(vectors.limit(3), ["a"], ["ID"])) == [0.5] * 3
    one = folds.assemble(vectors.filter("label = 1"), ["a"], ["ID", "label"])
    assert min(_probability(boosting.NewtonBooster(rounds=5).fit(one), one)) > 0.5


def test_settings_are_checked():
    with pytest.raises(ValueError):
        boosting.NewtonBooster(loss="other").growth()
    with pytest.raises(ValueError):
        boosting.NewtonBooster(bins=257).growth()


def test_rows_are_stored_in_blocks(spark):
    x, y, fold = _data(5000)
    edges = histograms.fit_edges(_rows(spark, x, y, fold), "x", 4, 16)
    blocks = histograms.code_rows(_rows(spark, x, y, fold).coalesce(1), "x", edges, 2, 0.5).collect()
    assert sum(r["n"] for r in blocks) == 5000 and len(blocks) <= 3
    codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(4, -1) for r in blocks], axis=1)
    assert sorted(map(tuple, codes.T.tolist())) == sorted(map(tuple, histograms.codes_of(x, edges).tolist()))
    assert {len(r["margins"]) // r["n"] for r in blocks} == {16}


@pytest.mark.parametrize("slots", [1, 3])
@pytest.mark.parametrize("scale", [5, 1 << 40])
def test_features_counted_together_give_the_sums_of_each(slots, scale):
    rng = np.random.default_rng(slots)
    held, n = [32, 3, 1, 32, 40, 5], 700
    columns = np.array([rng.integers(0, k, n) for k in held], np.uint8)
    use = np.flatnonzero(rng.random(n) < 0.8)
    slot, g, h = rng.integers(0, slots, len(use)), rng.integers(-scale, scale, len(use)).astype(float), rng.integers(0, scale, len(use)).astype(float)
    joint = histograms._joint(held)
    assert sorted(f for own in joint for f in own) == list(range(6)) and len(joint) < 6
    total, want = np.zeros((slots, 6, 64, 3), np.int64), np.zeros((slots, 6, 64, 3), np.int64)
    histograms._add_cells(total, [(own, histograms._numbers(columns, own, held)) for own in joint], held, slot, use, g, h)
    for s, row, a, b in zip(slot, use, g, h, strict=True):
        for f in range(6):
            want[s, f, columns[f, row]] += [int(a), int(b), 1]
    assert np.array_equal(total, want)


def test_learners_with_the_same_bins_share_scans_and_trees_stay_the_same(spark, vectors, monkeypatch):
    scans, sums = [], histograms._sums
    monkeypatch.setattr(histograms, "_sums", lambda *args: scans.append(args[3]) or sums(*args))
    data = folds.assemble(vectors, ["a", "b", "c", "d"], ["ID", "label", "fold"])
    learners = {
        "flat": boosting.NewtonBooster(rounds=7, depth=1, start=0.5),
        "deep": boosting.NewtonBooster(rounds=6, depth=4, step=0.4, l2=0.0),
        "fine": boosting.NewtonBooster(rounds=2, depth=2, bins=64),
    }
    alone = {n: [m.ensemble for m in learner.fit_folds(data, 3, "fold")] for n, learner in learners.items()}
    apart, before = len(scans), scans.clear()
    models = folds.fit_folds(data, learners, 3)
    assert before is None and list(models) == list(learners) and len(scans) < apart
    shown = lambda e: (e.start, [t.as_lists() for t in e.trees])
    for n in learners:
        assert [shown(m.ensemble) for m in models[n]] == [shown(e) for e in alone[n]]
        assert all(len(m.trees) == learners[n].growth().rounds and m.growth() == learners[n].growth() for m in models[n])
    # The root of both learners in one scan, the levels below only of the deeper one.
    assert {m // 3 for m, _ in scans[0]} == {0, 1} and {m // 3 for m, _ in scans[1]} == {1}


def test_counts_of_several_chunks_add_up(monkeypatch):
    rng = np.random.default_rng(5)
    held, n = [32, 40, 3, 17], 1000
    columns = np.array([rng.integers(0, k, n) for k in held], np.uint8)
    slot, g, h = rng.integers(0, 2, n), rng.integers(-9, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
    joint = histograms._joint(held)
    kept, whole, total = histograms._no_cells(joint, held, 2), np.zeros((2, 4, 64, 3), np.int64), np.zeros((2, 4, 64, 3), np.int64)
    for part in (slice(0, 600), slice(600, n)):
        counted = [histograms._numbers(columns[:, part], own, held) for own in joint]
        histograms._count(kept, counted, slot[part], np.arange(len(g[part])), g[part], h[part])
    histograms._spread(total, kept, joint, held)
    histograms._add_cells(whole, [(own, histograms._numbers(columns, own, held)) for own in joint], held, slot, np.arange(n), g, h)
    assert np.array_equal(total, whole) and total[..., 2].sum() == 4 * n
    assert histograms._scans([0, 1, 3], [Growth(depth=d) for d in (2, 5, 2, 2)], histograms.CELLS_AT_ONCE // 8) == [[0], [1], [3]]


@pytest.mark.parametrize("bounds, ordered", [(1024, 1 << 20), (4, 10), (2, 0)])
@pytest.mark.parametrize("sample", [1, 700, 1 << 20])
def test_edges_are_those_of_all_rows_whatever_the_sample(spark, monkeypatch, sample, bounds, ordered):
    rng = np.random.default_rng(3)
    n = 2003
    x = np.stack([
        rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
        np.where(rng.random(n) < 0.9, 7.0, rng.random(n)),
        rng.integers(0, 3, n) - 1.0,
        np.where(np.arange(n) % 5 == 0, -np.inf, np.where(np.arange(n) % 5 == 1, np.inf, rng.random(n))),
        np.where(np.arange(n) % 2 == 0, 0.0, -0.0),
        np.where(np.arange(n) == 77, np.nan, rng.random(n)),
        np.sort(rng.random(n)),
    ], axis=1)
    monkeypatch.setattr(histograms, "BOUNDS", bounds)
    monkeypatch.setattr(histograms, "ORDERED_VALUES", ordered)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    found = histograms.fit_edges(rows, "x", x.shape[1], 16, sample_values=sample)
    for f, edges in enumerate(found):
        v = np.sort(x[:, f])
        at = v[np.arange(1, 16) * n // 16]
        assert edges.tolist() == np.unique(at[at < v[-1]]).tolist()


def test_blocks_and_row_groups_are_bounded_by_bytes(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.lit(1.0).alias("y"), F.lit(1.0).alias("weight"), F.lit(0).alias("fold"), F.array(F.rand(1), F.rand(2)).alias("x")
    )
    blocks = histograms.code_rows(rows.coalesce(1), "x", [np.array([0.5])] * 2, 90, 0.0)
    blocks.write.options(**histograms.GROUPS).parquet(f"{tmp_path}/blocks")
    sizes = [r["n"] * (22 + 90 * 8) for r in spark.read.parquet(f"{tmp_path}/blocks").collect()]
    assert sum(sizes) == 40_000 * 742 and max(sizes) <= histograms.BLOCK_BYTES
    for file in tmp_path.glob("blocks/*.parquet"):
        found = pq.ParquetFile(file).metadata
        assert max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) < 16 << 20 and found.num_row_groups > 1


def test_a_fit_computes_its_rows_once(spark, vectors):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = vectors.select("ID", "label", "a", "b").mapInArrow(counted, "ID long, label int, a double, b double")
    boosting.NewtonBooster(rounds=2, depth=2).fit(folds.assemble(rows, ["a", "b"], ["ID", "label"]))
    assert seen.value == vectors.count()
