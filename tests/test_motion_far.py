"""The motion search with its full windows against brute force."""

import numpy as np

from rasterloom.operators import motion


def brute(prev, cur, rect):
    """Vertical by growing distance, up first; left; right; then columns from 0 outwards, each up and then down."""
    x1, y1, x2, y2 = rect
    h, w = prev.shape
    order = [(0, s * k) for k in range(1, 257) for s in (-1, 1) if s * k < 256] + [(-k, 0) for k in range(1, 257)] + [(k, 0) for k in range(1, 256)]
    order += [(dx, dy) for dx in [*range(0, -9, -1), *range(1, 8)] for dy in [*range(0, -9, -1), *range(1, 8)] if (dx, dy) != (0, 0)]
    for dx, dy in order:
        if x1 + dx >= 0 and y1 + dy >= 0 and x2 + dx <= w and y2 + dy <= h and (prev[y1 + dy : y2 + dy, x1 + dx : x2 + dx] == cur[y1:y2, x1:x2]).all():
            return dx, dy
    return None


def test_full_windows_match_brute_force():
    """Blocks moved by up to a whole frame, diagonally within and beyond the near window, and not at all."""
    r = np.random.default_rng(5)
    prev, seen = r.integers(0, 3, (38, 50)), set()
    for k in range(300):
        cur, (x1, y1) = r.integers(0, 3, prev.shape), (int(r.integers(0, 47)), int(r.integers(0, 35)))
        x2, y2 = x1 + int(r.integers(1, 4)), y1 + int(r.integers(1, 4))
        sx, sy = (x1, int(r.integers(0, 35))) if k % 3 == 0 else (int(r.integers(0, 47)), y1) if k % 3 == 1 else (max(0, x1 - 7), max(0, y1 - 7))
        cur[y1:y2, x1:x2] = prev[sy : sy + y2 - y1, sx : sx + x2 - x1]
        got = motion.find_vector(prev, cur, (x1, y1, x2, y2))
        assert got == brute(prev, cur, (x1, y1, x2, y2))
        seen.add(got)
    assert max(abs(v[0]) for v in seen if v) > 16 and max(abs(v[1]) for v in seen if v) > 16
