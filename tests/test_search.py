"""The trial table: a run that is killed and resumed gives the same trials; bad trials stop early; the sampler finds the good region."""

import json

import pytest


def space():
    from hearth.operators.search import Space

    return Space({"depth": (3, 12, "int"), "rate": (0.005, 0.3, "log"), "share": (0.5, 1.0, "float")})


def cost(params, fold):
    return (params["depth"] - 6) ** 2 / 10 + (params["share"] - 0.8) ** 2 * 10 + abs(params["rate"] - 0.05) * 5 + fold * 0.01


def test_a_killed_run_resumes_with_the_same_trials(spark, tmp_path):
    from hearth.operators.search import read_trials, search

    folds = [0, 1, 2]
    whole = [tuple(r) for r in search(spark, f"{tmp_path}/a", space(), cost, folds, 16, 7).collect()]
    calls = []

    def dies(params, fold):
        calls.append(1)
        if len(calls) > 29:
            raise KeyboardInterrupt
        return cost(params, fold)

    with pytest.raises(KeyboardInterrupt):
        search(spark, f"{tmp_path}/b", space(), dies, folds, 16, 7)
    before = sum(len(s) for _, s in read_trials(spark, f"{tmp_path}/b").values())
    assert 20 <= before <= 29
    again = []
    rest = [tuple(r) for r in search(spark, f"{tmp_path}/b", space(), lambda p, f: again.append(1) or cost(p, f), folds, 16, 7).collect()]
    assert rest == whole
    assert len(again) + before == sum(len(r[3]) for r in whole)  # nothing is scored twice
    assert any(r[4] for r in whole) and all(len(r[3]) < 3 for r in whole if r[4])


def test_the_sampler_prefers_what_was_good():
    from hearth.operators.search import suggest

    s, history = space(), []
    for t in range(60):
        p = suggest(s, history, t, 3)
        assert 3 <= p["depth"] <= 12 and 0.005 <= p["rate"] <= 0.3 and 0.5 <= p["share"] <= 1.0
        history.append((p, cost(p, 0)))
    mean = lambda h: sum(c for _, c in h) / len(h)
    assert mean(history[40:]) < 0.6 * mean(history[:10])
    assert suggest(s, history, 60, 3) == suggest(s, history, 60, 3) and json.dumps(history[0][0])
    for p, _ in history:
        back = s.values(s.unit(p))
        assert back["depth"] == p["depth"] and abs(back["rate"] - p["rate"]) < 1e-9 and abs(back["share"] - p["share"]) < 1e-9
