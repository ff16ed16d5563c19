"""Plain versions of operators that several tests hold results against."""

import numpy as np
from test_decontaminate import words
from test_raking import plain_fit



def contaminated_plain(text, items):
    mine, hit = words(text), set()
    windows = set()
    for body in items:
        other = words(body)
        n = min(13, len(other))
        windows |= {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
    for n in {len(w) for w in windows}:
        for j in range(len(mine) - n + 1):
            if tuple(mine[j : j + n]) in windows:
                hit.update(range(j, j + n))
    return len(hit) > 0 and 20 * len(hit) >= len(mine)


def raked_plain(rows, share):
    names, ratio, scale = plain_fit(rows, share, (0.5, 0.5, 1.0))
    places = [tuple(n.index(x) for n, x in zip(names, r, strict=False)) for r in rows]
    return [float(np.minimum(1, scale * ratio[p])) for p in places]
