"""Plain-loop counterpart of the near-copy query."""

import re

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id to (number of shingles, smallest id reachable)."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(a), find(i)) for i, a in sets}
