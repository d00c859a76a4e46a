"""Near duplicates at limits other than that of op8."""

import random

import pytest

import brute
from boxmill.llm import minmax


def test_bands_follow_the_limit():
    for percent in (50, 70, 80, 85, 95):
        n, alike = minmax.bands_for(percent), (percent / 100) ** 6
        assert (1 - alike) ** n <= minmax.MISSED < (1 - alike) ** (n - 1)
    assert minmax.bands_for(85) == minmax.BANDS and minmax.bands_for(80) == 50 and minmax.bands_for(100) == 1
    with pytest.raises(ValueError):
        minmax.bands_for(0)


@pytest.mark.parametrize("percent", [80, 97])
def test_near_duplicates_at_another_limit(spark, percent):
    rng = random.Random(percent)
    rows = [(1000, None), (1001, ""), (1002, "few words")]
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(120)]
        rows.append((2 * k, " ".join(words)))
        # the tail is another one: a similarity around the limits
        cut = rng.randrange(1, 25)
        rows.append((2 * k + 1, " ".join(words[:-cut] + [f"n{k}x{i}" for i in range(cut)])))
    want = brute.near_classes(rows, percent)
    assert want != brute.near_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(docs, percent=percent).collect()} == want
