"""The registered training queries do the whole job; training itself is left out here."""

import pytest

from catalog import queries
from scorekit.plans import boosting, folds

SMOKE = "/root/testdata/sf0.001"
ON_FEATURES = (
    "cv_scores_a", "cv_scores_b", "cv_weighted", "stack_lr", "stack_gbt", "stack_single", "vote_single", "vote_two",
    "cv_importance", "cv_focal", "newton_boost", "newton_boost_focal",
)


class Asked(Exception):
    pass


@pytest.fixture(scope="module")
def built():
    return {}


@pytest.fixture
def ask(spark, monkeypatch, built):
    """What a query asks for: table, features, learners and options. The feature table is built once."""
    build = queries.build_feature_table

    def once(train, test, labels):
        key = tuple(train.columns)
        if key not in built:
            built[key] = build(train, test, labels)
        return built[key]

    def stop(train, features, learners, **options):
        raise Asked(train, list(features), list(learners.values()), options)

    def alone(booster, vectors):
        raise Asked(None, None, [booster], {})

    monkeypatch.setattr(queries, "build_feature_table", once)
    monkeypatch.setattr(folds, "out_of_fold", stop)
    monkeypatch.setattr(boosting.NewtonBooster, "fit", alone)

    def run(name):
        with pytest.raises(Asked) as e:
            queries.REGISTRY[name](spark, SMOKE)
        return e.value.args

    return run


@pytest.mark.parametrize("name", ON_FEATURES)
def test_models_train_on_the_feature_table_at_full_size(ask, name):
    train, features, learners, options = ask(name)
    if name.startswith("newton"):
        assert [b.growth().rounds for b in learners] == [100]
        return
    assert {"count_cross_B2_and_A2", "ratio_click_of_A2", "A2", "E14", "hour"} <= set(features)
    assert not [f for f in features if "A3" in f] and not {"ID", "label", "is_test"} & set(features)
    assert {"ID", "label", *features} == set(train.columns)
    assert options["k"] == 10 and all(b.growth().rounds >= 20 for b in learners)
    assert len(learners) == (2 if name in ("stack_lr", "stack_gbt", "stack_single", "vote_single", "vote_two", "cv_importance") else 1)


def test_rated_documents_train_at_full_size(ask):
    _, _, learners, options = ask("rated_documents_cv")
    assert options["k"] == 10 and [b.growth().rounds for b in learners] == [20]
