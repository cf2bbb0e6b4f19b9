from __future__ import annotations

import random
import re


def make_text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


def brute_groups(rows, n=5, threshold=0.8):
    """Links, least id of the linked group and least id of the copies, for each document."""

    def grams(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()

    sets = {i: grams(t) for i, t in rows}
    copies = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    kinds = set(sets.values())
    near = {a: {b for b in kinds if a != b and a and b and len(a & b) >= threshold * len(a | b) - 1e-9} for a in kinds}
    label = {a: min(i for i in sets if sets[i] == a) for a in kinds}
    moved = True
    while moved:
        moved = False
        for a in kinds:
            low = min([label[a], *(label[b] for b in near[a])])
            if low < label[a]:
                label[a], moved = low, True
    return {i: len(near[s]) for i, s in sets.items()}, {i: label[s] for i, s in sets.items()}, copies
