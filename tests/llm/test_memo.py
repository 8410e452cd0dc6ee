"""The memory of words: same values with and without forgetting, bounded growth."""

from marketreach.llm.memo import look_up


def test_values_and_bound():
    held, asked = {}, []

    def learn(new):
        asked.append(set(new))
        held.update((w, w.upper().encode()) for w in new)

    lists = [[f"w{i}", "", "w0", f"w{i // 2}"] for i in range(200)]
    for at in range(0, 200, 20):
        part = lists[at : at + 20]
        want = ["".join(p).upper().encode() for p in part]
        assert look_up(part, held, 50, learn) == want
        assert len(held) <= 50 + 41
    assert "w0" in held and sum("w0" in a for a in asked) == 1  # the first words stay


def test_nothing_to_look_up():
    assert look_up([], {}, 5, None) == []
    assert look_up([[], ["a"]], {"a": b""}, 5, None) == [b"", b""]
