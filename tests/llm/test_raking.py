import pytest

from framewright.llm import mixing


def raked(rows, source, lang, **limits):
    weight = {r[:3]: r[3] for r in rows}
    found = mixing.rake_driver(rows, [source, lang, {"t": 1.0}], limits.get("rounds"), 1e-9)
    total = sum(weight.values())
    return {k: v * weight[k] / total for k, v in found.items()}


def test_raking_goes_on_until_the_targets_are_met():
    rows = [("a", "x", "t", 100), ("a", "y", "t", 100), ("b", "y", "t", 100)]
    source, lang = {"a": 0.51, "b": 0.49}, {"x": 0.5, "y": 0.5}
    got = raked(rows, source, lang)
    assert abs(got["a", "y", "t"] - 0.01) < 1e-6
    with pytest.warns(UserWarning, match="off its target after 50 rounds"):
        got = raked(rows, source, lang, rounds=50)
    assert abs(got["a", "y", "t"] - 0.01) > 1e-4


def test_raking_without_a_solution_says_so():
    with pytest.warns(UserWarning, match="0.4 off its target"):
        raked([("a", "x", "t", 5), ("b", "y", "t", 5)], {"a": 0.5, "b": 0.5}, {"x": 0.9, "y": 0.1})
