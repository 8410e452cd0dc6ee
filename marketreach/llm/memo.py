"""What a task remembers of the words it has met."""

from __future__ import annotations

from collections.abc import Callable


def look_up(
    parts: list[list[str]], held: dict[str, bytes], most: int, learn: Callable[[set[str]], None]
) -> list[bytes]:
    """Values of each list of words, joined; `learn` puts those of new words into `held`.

    Before that, a memory of over `most` words drops all but half as many: those met last, as common
    words are met first. It then grows by the new words of one call at most.
    """
    if len(held) > most:
        while len(held) > most // 2:
            held.popitem()
    found = [list(map(held.get, words)) for words in parts]
    gaps = [
        (values, i, words[i])
        for words, values in zip(parts, found)
        if None in values
        for i, value in enumerate(values)
        if value is None
    ]
    if gaps:
        learn({word for _, _, word in gaps})
        for values, i, word in gaps:
            values[i] = held[word]
    return list(map(b"".join, found))
