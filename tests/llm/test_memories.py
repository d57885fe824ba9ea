from strandline.llm.memories import held


def test_a_worker_remembers_for_one_key():
    first = held("a", dict)
    first["x"] = 1
    assert held("a", dict) is first
    assert held("b", dict) == {} and held("a", dict) == {}
