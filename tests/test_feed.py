import random

import pytest

from corvane.operators.diversify import capped_feed


def fold(rows, caps, most):
    used, out = {}, []
    for item, provider, domain, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        groups = [("provider", provider), ("domain", domain)]
        if len(out) < most and all(used.get(g, 0) < caps[g[0]] for g in groups):
            out.append((item, len(out) + 1))
            for g in groups:
                used[g] = used.get(g, 0) + 1
    return out


def skewed():
    """Every provider's 60 best rows lie in one full domain, the rows that fill the feed come after them."""
    return [(f"i{p:02}{k:03}", f"p{p}", "d0" if k < 80 else f"d{1 + k % 3}", 1000.0 - k) for p in range(30) for k in range(90)]


def mixed():
    rng = random.Random(4)
    return [(f"i{k:04}", f"p{rng.randrange(25)}", rng.choice("aaaaaabcd"), float(rng.randrange(50))) for k in range(2000)]


@pytest.mark.parametrize("make", [skewed, mixed])
def test_feed_equals_fold_of_all_rows(spark, make):
    rows, caps = make(), {"provider": 4, "domain": 15}
    found = capped_feed(spark.createDataFrame(rows, "item_id string, provider string, domain string, rank_score double"), caps, 60)
    assert sorted(tuple(r) for r in found.collect()) == sorted(fold(rows, caps, 60))
