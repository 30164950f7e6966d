from __future__ import annotations

import itertools
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tintero.llm.packing import containers, fill_summary, fullest, pack


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(12, 30))
def test_fullest_is_the_best_combination(counts, capacity):
    chosen = fullest(counts, capacity)
    assert all(0 < n <= counts[x] for x, n in chosen.items()) and max(counts) in chosen
    first = max(counts)
    left = dict(counts) | {first: counts[first] - 1}
    best = max(s for n in itertools.product(*[range(left[x] + 1) for x in left]) if (s := sum(a * x for a, x in zip(n, left, strict=True))) <= capacity - first)
    assert sum(x * n for x, n in chosen.items()) == first + best


@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 25))
def test_nothing_is_lost_or_split_without_need(sizes, capacity):
    out = pack(sizes, capacity)
    total: dict[int, int] = {}
    for content in out:
        assert 0 < sum(n for _, n in content) <= capacity
        for k, n in content:
            total[k] = total.get(k, 0) + n
    assert total == {k: s for k, s in enumerate(sizes) if s}
    parts = [k for content in out for k, _ in content]
    assert all(parts.count(k) == max(1, math.ceil(s / capacity)) for k, s in enumerate(sizes) if s)


def test_little_is_wasted():
    sizes = [(k * 37) % 97 + 3 for k in range(2000)]
    assert len(pack(sizes, 128)) <= math.ceil(sum(sizes) / 128) + 1
    with pytest.raises(ValueError):
        pack([1], 0)


def test_operator(spark):
    items = spark.createDataFrame([(k, s, "x") for k, s in enumerate([5, 5, 5, 0, None, 23, 5])] + [(0, 5, "x")], "doc_id long, n long, shard string")
    budgets = spark.createDataFrame([(1, 10, "t"), (2, 100, "t")], "budget_id int, capacity_tokens int, tokenizer string")
    rows = containers(items, budgets, "doc_id", "n").collect()
    for b, c, most in ((1, 10, 5), (2, 100, 1)):
        mine = [r for r in rows if r.budget_id == b]
        fill: dict = {}
        for r in mine:
            if r.container is not None:
                fill[r.shard, r.container] = fill.get((r.shard, r.container), 0) + r.n_tokens
        assert max(fill.values()) <= c and sum(fill.values()) == 48 and len(fill) <= most
        assert sorted(r.id for r in mine if r.container is None) == [3, 4]
    assert containers(items.limit(0), budgets, "doc_id", "n").count() == 0
    small = containers(items, budgets, "doc_id", "n", shard_containers=1).collect()
    assert sum(r.n_tokens for r in small) == 96


@pytest.mark.parametrize("n", [0, 101])
def test_no_budgets_and_too_many_tokenizers(spark, tmp_path, n):
    from tintero.llm import queries as Q

    spark.createDataFrame([(k, 10, f"t{k}") for k in range(n)], "budget_id int, capacity_tokens int, tokenizer string").write.parquet(f"{tmp_path}/token_budgets.parquet")
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    if n:
        with pytest.raises(ValueError, match="too many tokenizers"):
            Q.p7_containers(spark, str(tmp_path))
    else:
        packed = Q.p7_containers(spark, str(tmp_path))
        assert packed.count() == 0 and packed.columns == ["budget_id", "shard", "container", "doc_id", "part", "n_tokens"]


def test_the_packing_depends_on_the_items_alone(spark):
    rows = [(None if k % 3 == 0 else k, 1 + k * 37 % 90) for k in range(900)]
    budgets = spark.createDataFrame([(1, 100, "t"), (2, 40, "t")], "budget_id int, capacity_tokens int, tokenizer string")
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    one, other = (sorted(map(repr, containers(sizes.repartition(n), budgets, "doc_id", "n_tokens", 20, 100).collect())) for n in (2, 5))
    assert sum("id=None" in r for r in one) >= 600 and one == other and len({r.split("shard=")[1].split(",")[0] for r in one}) > 5


def test_summary(spark):
    sizes = spark.createDataFrame([(1, 60), (2, 40), (3, 250), (4, 0), (5, 30)], "doc_id long, n_tokens long")
    budgets = spark.createDataFrame([(1, 100, "t"), (2, 1000, "t")], "budget_id int, capacity_tokens int, tokenizer string")
    got = {r.budget_id: tuple(r)[1:] for r in fill_summary(containers(sizes, budgets, "doc_id", "n_tokens"), budgets).collect()}
    assert got[1][:5] == (100, 4, 380, 4, 4) and abs(got[1][5] - 0.05) < 1e-9 and got[2][:5] == (1000, 4, 380, 1, 1)
    none = fill_summary(containers(sizes.limit(0), budgets, "doc_id", "n_tokens"), budgets).collect()
    assert [tuple(r)[2:] for r in none] == [(0, 0, 0, 0, None)] * 2
