"""Members of one variant at an odd radius, where the first is too far from one of each two."""

import numpy as np

from terrane.llm import simhash


def test_odd_radius_links_members_that_the_first_is_too_far_from():
    heads = [v | 3 << (10 + 2 * k) for k, v in enumerate((1, 2, 4, 3, 5, 6))]  # one for each variant that 0 and 7 share
    fps = np.array([*heads, 0, 7], np.uint64)
    a, b = simhash._meet(0, fps, 4, 2, 3)
    root = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist()):
        root = [min(root[x], root[y]) if r in (root[x], root[y]) else r for r in root]
    assert root[6] == root[7]
