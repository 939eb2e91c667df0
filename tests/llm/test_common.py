from quotemill.llm import common as C


def test_what_another_operator_left_goes():
    tables = {"a": {1: 2}, "b": {3: 4}}
    C.resident("a", tables["a"].clear)
    C.resident("a", tables["a"].clear)
    assert tables["a"]
    C.resident("b", tables["b"].clear)
    assert not tables["a"] and tables["b"]
    mine = {5: 6}
    assert list(C.forgetting(iter([1, 2]), mine)) == [1, 2]
    assert not tables["b"] and not mine


def test_a_task_that_ends_or_breaks_off_leaves_nothing():
    left = {1: 2}
    assert list(C.leaving(iter([1, 2]), left.clear)) == [1, 2] and not left
    left[3], batches = 4, C.leaving(iter([1, 2]), left.clear)
    assert next(batches) == 1 and left
    batches.close()
    assert not left
