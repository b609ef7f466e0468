"""Complete linkage by rounds and over classes of copies, against the sequential greedy on all pairs of rows."""

import random

import pytest

from heliograph.operators import groups, linkage, similarity
from heliograph.operators.similarity import class_links, class_links_brute, pairs_brute, signature_classes

SIGNED = "id long, phash array<long>"


@pytest.fixture(autouse=True)
def few_jobs(spark):
    """One job a step and two tasks a shuffle, as there are very many steps over a few rows."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def least_turn(x, y, turns):
    return min((x[t] ^ y[0]).bit_count() for t in range(turns))


def sequential(rows, threshold, turns):
    """Groups of rows (id, phash of one word a turn) by every pair of ids."""
    sign = dict(rows)
    ids = sorted(sign)
    pairs = [(a, b, d) for k, a in enumerate(ids) for b in ids[k + 1 :] if (d := least_turn(sign[a], sign[b], turns)) <= threshold]
    found = groups.greedy_cliques(pairs, lambda m, c: least_turn(sign[m], sign[c], turns) <= threshold)
    return sorted(tuple(g) for g in found), pairs


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.key, []).append(r.image_id)
    assert all(key == min(ids) for key, ids in out.items())
    return sorted(tuple(sorted(g)) for g in out.values())


def scattered(seed, n, bits, turns=4, copies=0):
    """Rows with ids in no order; some share a signature, and some others its upright turn only."""
    rng = random.Random(seed)
    signs = [[rng.getrandbits(bits) for _ in range(turns)] for _ in range(n)]
    for _ in range(copies):
        base = rng.choice(signs)
        kind = rng.random()
        signs.append(list(base) if kind < 0.6 else [base[0], *[rng.getrandbits(bits) for _ in range(turns - 1)]] if kind < 0.8 else base[1:] + base[:1])
    ids = rng.sample(range(-50, 400), len(signs))
    return list(zip(ids, signs))


@pytest.mark.parametrize("turns, leaves", [(1, 64), (1, 2)])
def test_rounds_decide_what_the_sequence_decides(spark, turns, leaves):
    rows = scattered(101, 12, 6)
    df = spark.createDataFrame(rows, SIGNED)
    want, _ = sequential(rows, 1, turns)
    got = groups.cliques(pairs_brute(df, 1, 1, turns == 4), df, 1, 1, turns == 4, 0, leaves)
    assert gathered(got) == want and want


@pytest.mark.parametrize("seed, bits, threshold, turns, small, leaves", [(201, 9, 1, 4, linkage.SMALL, 64), (202, 8, 1, 1, 3, 2), (206, 5, 1, 4, 0, 64)])
def test_classes_give_the_groups_of_their_rows(spark, seed, bits, threshold, turns, small, leaves):
    rows = scattered(seed, 24 if small > 3 else 5, bits, copies=36 if small > 3 else 6)
    df = spark.createDataFrame([*rows, (9999, None)], SIGNED)
    want, _ = sequential(rows, threshold, turns)
    assert gathered(groups.variant_groups(df, threshold, 1, 56, turns == 4, small, leaves)) == want


def test_being_within_one_way_only_occurs_in_these_cases(spark):
    """The cases above hold components with it, classes that turns make equal, and both at once."""
    one_way = loose = 0
    for seed, bits, threshold in [(201, 9, 1), (202, 8, 1), (203, 12, 2)]:
        signs = {tuple(s) for _, s in scattered(seed, 24, bits, copies=36)}
        d = {(x, y): least_turn(x, y, 4) for x in signs for y in signs if x != y}
        one_way += sum(v <= threshold < d[y, x] for (x, y), v in d.items())
        loose += sum(v == 0 and d[y, x] > threshold for (x, y), v in d.items())
    assert one_way and loose


def test_a_class_costs_its_rows(spark):
    """3,000 copies of one signature and 2,000 of one near it are one group, by one edge."""
    rows = [(k, [5] * 4) for k in range(0, 6000, 2)] + [(k, [7] * 4) for k in range(1, 4000, 2)] + [(9000, [1 << 20] * 4)]
    df = spark.createDataFrame(rows, SIGNED)
    members, classes = signature_classes(df, 1)
    assert members.count() == len(rows) and classes.count() == 3 and class_links(classes, 2, 1, 56).count() == 2
    assert [len(g) for g in gathered(groups.variant_groups(df, 2, 1, 56))] == [5000]


def test_a_star_of_equal_distances_takes_few_rounds(spark, monkeypatch):
    """All within each other at one distance: the least row is the hub, and a round takes as many as it may."""
    rounds = []
    real = linkage._stars
    monkeypatch.setattr(linkage, "_stars", lambda *a: rounds.append(1) or real(*a))
    rows = [(k, [(1 << k) | (1 << 50)]) for k in range(40)]
    df = spark.createDataFrame(rows, SIGNED)
    assert gathered(groups.variant_groups(df, 2, 1, 56, False, small=0)) == [tuple(range(40))]
    assert len(rounds) == 1


def test_classes_of_any_threshold(spark):
    rows = scattered(301, 40, 12, copies=10)
    _, classes = signature_classes(spark.createDataFrame(rows, SIGNED), 1)
    signs = {r.c: r.phash for r in classes.collect()}
    want = {(x, y, d) for x in signs for y in signs if x != y and (d := least_turn(signs[x], signs[y], 4)) <= 3}
    assert {tuple(r) for r in class_links(classes, 3, 1, 56).collect()} == want
    assert {tuple(r) for r in class_links_brute(classes, 3, 1).collect()} == want


def far_apart(rng, threshold):
    """Signatures of 272 bits in four turns at random, and for each one that differs from a turn of it by some bits."""
    mask = (1 << 64) - 1
    signed = lambda x: [w - (1 << 64) if w >> 63 else w for w in (x >> 64 * k & mask for k in range(5))]
    base = [[rng.getrandbits(272) for _ in range(4)] for _ in range(12)]
    near = []
    for k, turns in enumerate(base):
        x = turns[k % 4]
        for bit in rng.sample(range(272), threshold - 2 + k % 5):
            x ^= 1 << bit
        near.append([x, *[rng.getrandbits(272) for _ in range(3)]])
    return [[w for turn in turns for w in signed(turn)] for turns in base + near]


@pytest.mark.parametrize("threshold, rows, flips", [(16, 10, 0), (20, 10**5, 1), (44, 10**5, 2), (44, 10, 0), (30, 10**7, 2)])
def test_wide_bands_find_what_brute_force_finds(spark, monkeypatch, threshold, rows, flips):
    real = similarity.band_plan
    assert real(threshold, 272, rows)[0] == flips
    monkeypatch.setattr(similarity, "band_plan", lambda t, bits, _: real(t, bits, rows))
    signs = far_apart(random.Random(600 + threshold), threshold)
    _, classes = signature_classes(spark.createDataFrame(list(enumerate(signs)), SIGNED))
    want = {tuple(r) for r in class_links_brute(classes, threshold).collect()}
    assert want and {tuple(r) for r in class_links(classes, threshold).collect()} == want


@pytest.mark.parametrize("threshold", range(0, 60, 3))
@pytest.mark.parametrize("bits", [24, 56, 64, 272])
def test_radii_cover_the_threshold(threshold, bits):
    if threshold >= bits:
        return
    for rows in (1, 10**4, 10**8):
        flips, layout = similarity.band_plan(threshold, bits, rows)
        assert sum(radius + 1 for *_, radius in layout) == threshold + 1 and all(0 <= radius <= flips and 0 < width <= similarity.BAND_BITS for _, width, radius in layout)
        assert all(a + w <= b for (a, w, _), (b, _, _) in zip(layout, layout[1:])) and layout[-1][0] + layout[-1][1] <= bits


@pytest.mark.parametrize("cap", [0, 7, 120, 500, None])
def test_cap_takes_the_nearest(spark, monkeypatch, cap):
    monkeypatch.setattr(groups, "SORTED", 3)
    monkeypatch.setattr(groups, "RANGES", 4)
    rng = random.Random(401)
    ids = [-(1 << 62), -5, *range(20), 1 << 40, (1 << 62) + 3]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(400)})
    pairs = [(a, b, rng.choice((0, 3, 3, 3, 9))) for a, b in pairs]
    got, more = groups.capped(spark.createDataFrame(pairs, "a long, b long, distance int"), cap)
    first = sorted(pairs, key=lambda p: (p[2], p[0], p[1]))[:cap]
    assert sorted(tuple(r) for r in got.collect()) == sorted(first) and more == (len(first) < len(pairs))


def plain_cover(spec):
    """Ids of groups (id, kind, members) that no stronger group holds."""
    strength = {"exact": 0, "burst": 1, "variant": 2}
    return sorted(i for i, kind, own in spec if not any(set(own) <= set(other) and (strength[k], j) < (strength[kind], i) for j, k, other in spec if j != i))


def tables(spark, spec):
    heads = spark.createDataFrame([(i, kind, "") for i, kind, _ in spec], "id long, kind string, similarity string")
    return heads, spark.createDataFrame([(i, m, False) for i, _, own in spec for m in own], "group_id long, image_id long, is_keeper boolean")


@pytest.mark.parametrize("seed, pool, most", [(501, 6, 3), (503, 12, 4)])
def test_reconcile_is_subset_cover(spark, seed, pool, most):
    rng = random.Random(seed)
    spec = [(k, rng.choice(("exact", "burst", "variant")), rng.sample(range(pool), rng.randint(2, most))) for k in rng.sample(range(1000), 90)]
    kept, members = groups.reconcile(*tables(spark, spec))
    want = plain_cover(spec)
    assert sorted(r.id for r in kept.collect()) == want
    assert {r.group_id for r in members.collect()} == set(want)
    assert members.count() == sum(len(own) for i, _, own in spec if i in want)


def test_reconcile_probes_the_rarest_member(spark, monkeypatch):
    """One row in all of 900 groups, two in a row the same: candidates are the groups of each one's other row."""
    asked = []
    real = groups._held
    monkeypatch.setattr(groups, "_held", lambda pairs, known: asked.append(pairs.count()) or real(pairs, known))
    spec = [(k, "burst" if k % 2 else "variant", [0, 1 + k // 2]) for k in range(900)]
    kept, _ = groups.reconcile(*tables(spark, spec))
    assert sorted(r.id for r in kept.collect()) == list(range(1, 900, 2))
    assert asked == [450, 0]


def test_groups_started_before_edges():
    found = linkage.greedy([(4, 9, (0, 4, 9)), (9, 11, (2, 9, 11))], lambda m, c: (m, c) != (4, 11), started=(9,))
    assert found == [[4, 9]]


def test_size_estimates_do_not_grow_from_round_to_round(spark):
    """The driver's memory went into their digits."""
    from heliograph.operators.groups import cliques

    rows = spark.createDataFrame([(k, [k // 3]) for k in range(24)], "id long, phash array<long>")
    pairs = spark.createDataFrame([(a, b, 0 if a // 3 == b // 3 else 1) for a in range(24) for b in range(a + 1, min(a + 4, 24))], "a long, b long, distance int")
    out = cliques(pairs, rows, 1, 1, False, small=0, leaves=2)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


def test_detection_makes_its_pairs_and_members_once(spark, monkeypatch):
    from heliograph.plans import queries

    made = {}

    def counted(name):
        rows, of = spark.sparkContext.accumulator(0), getattr(groups, name)

        def run(*args):
            out = of(*args)

            def each(batches):
                for batch in batches:
                    rows.add(batch.num_rows)
                    yield batch

            made[name] = rows, of(*args).count()
            return out.mapInArrow(each, out.schema)

        monkeypatch.setattr(groups, name, run)

    for name in ("burst_pairs", "exact_members"):
        counted(name)
    assert queries.detection(spark, "/root/testdata/sf0.001").count() > 0
    assert all(n > 0 and rows.value == n for rows, n in made.values()), {k: (r.value, n) for k, (r, n) in made.items()}


def test_first_edges_decide_what_the_sequence_decides(spark, monkeypatch):
    """A component over the limit takes steps over its first edges, not rounds of single decisions."""
    taken = []
    real = linkage._first_edges
    monkeypatch.setattr(linkage, "FEW", 1)
    monkeypatch.setattr(linkage, "_first_edges", lambda *a: taken.append(a[1]) or real(*a))
    monkeypatch.setattr(linkage, "_stars", lambda *a: pytest.fail("a round"))
    rows = scattered(202, 30, 7, copies=8)
    want, _ = sequential(rows, 1, 1)
    got = groups.variant_groups(spark.createDataFrame(rows, SIGNED), 1, 1, 56, False, 8)
    assert gathered(got) == want and 1 < len(taken) < 12


def test_blocks_compare_every_pair_of_classes(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 9)
    monkeypatch.setattr(similarity, "STRIP", 4)
    signs = far_apart(random.Random(77), 20)
    _, classes = signature_classes(spark.createDataFrame(list(enumerate(signs)), SIGNED))
    turned = {r.c: r.phash for r in classes.collect()}
    far = lambda x, y: min(sum(((x[t * 5 + k] ^ y[k]) & (1 << 64) - 1).bit_count() for k in range(5)) for t in range(4))
    want = {(x, y, d) for x in turned for y in turned if x != y and (d := far(turned[x], turned[y])) <= 20}
    assert want and sorted(tuple(r) for r in class_links_brute(classes, 20).collect()) == sorted(want)
