from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import packing as p


def check(rows, sizes, capacities):
    by, docs = defaultdict(int), defaultdict(int)
    for r in rows:
        by[r.capacity_id, r.container_id] += r.n_tokens
        docs[r.capacity_id, r.doc_id] += r.n_tokens
        if sizes[r.doc_id] <= capacities[r.capacity_id]:
            assert r.n_tokens == sizes[r.doc_id]
    assert all(n <= capacities[c] for (c, _), n in by.items())
    assert docs == {(c, d): n for c in capacities for d, n in sizes.items() if n}
    return by


def test_packs_everything_once(spark, monkeypatch):
    monkeypatch.setattr(p, "PART_ROWS", 100)
    sizes = {i: 7 if i % 3 == 0 else (i * 37) % 300 for i in range(3000)}  # one size holds a third
    sizes[9000] = 5000
    caps = {1: 64, 2: 1000}
    s = spark.createDataFrame([*sizes.items(), (9999, 0), (9998, None)], "doc_id long, n_tokens long")
    c = spark.createDataFrame([*caps.items()], "capacity_id int, capacity_tokens int")
    rows = p.pack(s, c).collect()
    by = check(rows, sizes, caps)
    for cid, cap in caps.items():
        n, fewest = sum(k[0] == cid for k in by), -(-sum(sizes.values()) // cap)
        assert n <= fewest * 1.1 + 1
        # containers are numbered without gaps
        assert {k[1] for k in by if k[0] == cid} == set(range(n))
    groups = defaultdict(int)
    for r in rows:
        if r.capacity_id == 1:
            groups[r.step_group] += r.n_tokens
    assert max(groups.values()) <= 1.2 * min(groups.values())
    rep = {r.capacity_id: r for r in p.report(p.pack(s, c), c).collect()}
    assert rep[2].tokens == sum(sizes.values())


def test_empty(spark):
    s = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert p.pack(s, spark.createDataFrame([(1, 8)], "capacity_id int, capacity_tokens int")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=25))
def test_histogram(counts):
    used = defaultdict(int)
    for tier, items, times in p.pack_histogram(counts, 50):
        assert times > 0 and tier == p.tier_of(items[0][0], 50) and sum(s * n for s, n in items) <= 50
        for s, n in items:
            used[s] += n * times
    assert used == counts


def test_nearly_perfect_fills():
    assert sum(t for *_, t in p.pack_histogram({6: 10, 4: 10, 5: 10}, 10)) == 15
    assert sum(t for *_, t in p.pack_histogram({6: 10, 4: 10, 5: 10, 3: 10, 2: 10}, 10)) <= 21


def test_tiers_fill_the_gaps_of_longer_ones():
    plan = p.pack_histogram({60: 2, 30: 3, 10: 3}, 100)
    assert plan == [(0, ((60, 1), (30, 1), (10, 1)), 2), (1, ((30, 1), (10, 1)), 1)]


def test_every_pair_of_sizes_is_seen():
    counts = {1000: 1, **{s: 1 for s in range(401, 500)}, 10: 1, 389: 1}
    # the gap of 399 is filled by the two smallest sizes alone
    assert p.pack_histogram(counts, 1399)[0] == (0, ((1000, 1), (389, 1), (10, 1)), 1)


def test_step_groups_have_nearly_the_same_tokens(spark):
    s = spark.createDataFrame([(i, 1 + (i * i) % 97) for i in range(4000)], "doc_id long, n_tokens long")
    sums = defaultdict(int)
    for r in p.pack(s, spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")).collect():
        sums[r.step_group] += r.n_tokens
    assert len(sums) > 20 and max(sums.values()) <= 1.05 * min(sums.values())
