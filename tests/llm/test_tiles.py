import tracemalloc

import numpy as np

from quernstone.llm import jaccard


def test_tiles_are_searched_in_bounded_memory():
    r = np.random.default_rng(4)
    for rows, groups in ((900, 64), (600, 1024)):
        common = r.poisson(2, groups)
        points = (common + r.poisson(1, (rows, groups))).astype(np.uint8)
        points[1::7] = points[::7][: len(points[1::7])]
        points[2::7, :4] += 1
        points[3::5] = r.poisson(3, (len(points[3::5]), groups))
        sizes = points.sum(1, dtype=np.int64)
        tree = jaccard.CountTree(points, sizes)
        tracemalloc.start()
        got = {(int(i), int(j)) for x, y in tree.pairs(points, sizes, 80, 100) for i, j in zip(x, y, strict=True)}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        least = jaccard.least_overlap(sizes[:, None], sizes[None], 80, 100)
        want = {(i, j) for i in range(rows) for j in np.flatnonzero(np.minimum(points[i], points).sum(1, dtype=np.int64) >= least[i]).tolist()}
        assert got == want and len(want) > rows
        assert peak < 16 << 20
