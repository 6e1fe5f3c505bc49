import pytest

from viewgraph.plans import hooks


def test_names_are_resolved():
    from viewgraph.operators.graph import pair_id

    assert hooks.resolve("viewgraph.operators.graph.pair_id") is pair_id
    assert hooks.resolve("viewgraph.operators.graph:pair_id") is pair_id
    assert hooks.resolve("collections.OrderedDict.fromkeys")([1]) == {1: None}
    with pytest.raises(AttributeError):
        hooks.resolve("viewgraph.operators.graph.no_such_name")
    with pytest.raises(ModuleNotFoundError):
        hooks.resolve("no_such_package.name")
    with pytest.raises(TypeError):
        hooks.resolve("viewgraph.operators.graph.MIN_MATCHES")


def test_configurations_are_called_with_those_they_hold():
    config = {"_target_": "builtins.dict", "a": 1, "b": {"_target_": "builtins.list"}, "c": {"plain": 2}}
    assert hooks.call(config, a=3) == {"a": 3, "b": [], "c": {"plain": 2}}
    assert hooks.call({"x": 1}, default="builtins.dict") == {"x": 1}
    with pytest.raises(ValueError):
        hooks.call({"x": 1})
