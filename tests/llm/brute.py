"""Plain versions that more than one test uses."""

from __future__ import annotations


def brute_near(texts: dict[int, str]) -> list[int]:
    def grams(t):
        p = t.lower().split()
        k = min(5, len(p))
        return {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if p else set()

    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in texts if find(i) == i)
