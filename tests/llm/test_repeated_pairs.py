from tidewire.llm import decontamination


def test_a_repeated_pair_is_not_taken_for_a_copy(monkeypatch):
    """Texts that repeat a pair of an item's words hold few of its different pairs: no distance is worked out for them."""
    asked, plain = [], decontamination.best_stretch
    monkeypatch.setattr(decontamination, "best_stretch", lambda *a: asked.append(a) or plain(*a))
    words = [f"w{i}" for i in range(30)]
    items = decontamination.Items([(1, " ".join(words)), (2, "on and on and on and on and on and on")])
    assert items.search(["w3 w4 " * 200, " ".join(words[:9]) * 2]) == [[], []] and not asked
    changed = " ".join(["x", *words[:5], "x", *words[6:20], "x x", *words[21:], "y"])
    assert items.search([changed, "on and on and on and on and on and up", "and on " * 40]) == [[(1, 1, 3, 30)], [(2, 0, 1, 11)], [(2, 1, 0, 11)]]
