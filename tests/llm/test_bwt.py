import random
from collections import Counter

import numpy as np
import pytest

from perigee.llm import bwt


@pytest.mark.parametrize("seed", range(30))
def test_merge_is_the_transform_of_all(seed):
    r = random.Random(seed)
    texts = [bytes(r.choices(b"abc", k=r.randint(0, 12))) for _ in range(r.randint(1, 9))]
    texts += r.sample(texts, len(texts) // 2)
    cut = sorted(r.randint(0, len(texts)) for _ in range(2))
    shards = [texts[: cut[0]], texts[cut[0] : cut[1]], texts[cut[1] :]]
    merged, common = bwt.merge([bwt.of_shard(s, f) for s, f in zip(shards, (0, *cut), strict=True)])
    whole = bwt.of_shard(texts)
    assert merged.text.tolist() == whole.text.tolist() and merged.start.tolist() == whole.start.tolist()
    assert merged.symbol.tolist() == whole.symbol.tolist()
    suffix = [texts[t][i:] for t, i in zip(whole.text, whole.start, strict=True)]
    lcp = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(suffix, suffix[1:], strict=False)]
    assert common.tolist() == lcp


@pytest.mark.parametrize("seed", range(10))
def test_repeated_starts(seed):
    r = random.Random(100 + seed)
    texts = [bytes(r.choices(b"ab", k=r.randint(0, 30))) for _ in range(8)]
    k = r.randint(2, 9)
    seen = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    want = {(n, i) for n, t in enumerate(texts) for i in range(len(t) - k + 1) if seen[t[i : i + k]] > 1}
    assert bwt.repeated_starts(texts, k, shards=3) == want


def test_nothing():
    merged, common = bwt.merge([])
    assert not len(merged.symbol) and not len(common)
    assert bwt.repeated_starts([b"", b""], 3) == set()
    assert np.array_equal(bwt.of_shard([b""]).symbol, [0])
