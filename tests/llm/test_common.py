import random

from foliant.llm.common import connected
from tests.llm.brute import components


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(9)
    graphs = [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(59 - i, i) for i in range(25)] + [(i, 60 + i) for i in range(60)],
              [(rng.randrange(120), rng.randrange(120)) for _ in range(70)], [(3, 3)], []]
    for links in graphs:
        got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
        n = 1 + max([0, *(x for l in links for x in l)])
        roots, least = components(n, links), {}
        for i, r in enumerate(roots):
            least[r] = min(least.get(r, i), i)
        assert got == {i: least[r] for i, r in enumerate(roots) if any(i in l and l[0] != l[1] for l in links)}
