import random

import pytest

from headmint.operators import keys, report, subset

TARGETS = "name string, ratio double, total_emails bigint, include array<string>, exclude array<string>, prefer array<string>, min_evidence int, cap int, width int, directional boolean"


def instance(spark, seed, n, width, directional=False):
    rng = random.Random(seed)
    names = [f"k{chr(97 + i)}" for i in range(n)]
    sets = {k: ({rng.randrange(40) for _ in range(rng.randrange(12))}, {rng.randrange(40) for _ in range(rng.randrange(12))}) for k in names}
    total, ratio = rng.randrange(10, 60), rng.choice([0.5, 1.0, 1.7])
    targets = spark.createDataFrame([("t", ratio, total, ["k"], [], [], 0, n, width, directional)], TARGETS)
    cands = spark.createDataFrame([("t", k, i, n, min(n, width)) for i, k in enumerate(names)], "name string, search_key string, position int, n int, width int")
    pairs = spark.createDataFrame([(k, side, i) for k in names for side, ids in zip((keys.SENT, keys.RECEIVED), sets[k]) for i in ids], "search_key string, side string, id bigint")
    return names, sets, total, ratio, targets, cands, pairs


def picked(mask, names):
    return tuple(k for i, k in enumerate(names) if mask >> (len(names) - 1 - i) & 1)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("method", ["join", "kernel", "auto"])
def test_best_subset_equals_enumeration(spark, seed, method):
    names, sets, total, ratio, *frames = instance(spark, seed, 7, 4)
    r = subset.best_subset(*frames, method=method).first()
    assert (picked(r["picked"], names), r["sent"], r["received"], pytest.approx(r["score"])) == subset.brute_force(sets, names, 4, total, ratio)


def test_no_received_id_gives_no_row(spark):
    targets = spark.createDataFrame([("t", 1.0, 5, ["k"], [], [], 0, 9, 3, False)], TARGETS)
    cands = spark.createDataFrame([("t", "ka", 0, 1, 1)], "name string, search_key string, position int, n int, width int")
    pairs = spark.createDataFrame([("ka", keys.SENT, 1)], "search_key string, side string, id bigint")
    for method in ("join", "kernel"):
        best = subset.best_subset(targets, cands, pairs, method)
        assert best.count() == 0
        row = report.match_report(targets, subset.directional_best(targets, cands, pairs, best), cands).first()
        assert row["name"] == "t" and row["person_error"] is None and row["matched_total"] is None


@pytest.mark.parametrize("seed", range(3))
def test_directional_pass_equals_enumeration(spark, seed):
    from itertools import combinations
    from math import log

    names, sets, total, ratio, targets, cands, pairs = instance(spark, seed, 6, 2, True)
    base = subset.best_subset(targets, cands, pairs, "kernel")
    shared, sent, received, score = subset.brute_force(sets, names, 2, total, ratio)
    best = (shared, (), (), sent, received, score)
    rest = [k for k in names if k not in shared]
    extras = [c for w in range(4) for c in combinations(rest, w)]
    union = lambda ks, side: len(set().union(*(sets[k][side] for k in ks)))
    for a in extras:
        for b in extras:
            s, r = union(shared + a, 0), union(shared + b, 1)
            if (a or b) and r:
                x = round(abs(s + r - total) / total + abs(log((s / r + 1e-9) / ratio)), 9)
                if x < best[5]:
                    best = (shared, a, b, s, r, x)
    got = subset.directional_best(targets, cands, pairs, base).first()
    assert tuple(picked(got[c], names) for c in ("picked", "sender_extras", "recipient_extras")) + (got["sent"], got["received"], pytest.approx(got["score"])) == best
    text = report.match_report(targets, subset.directional_best(targets, cands, pairs, base), cands).first()["picked_keys"]
    if best[1] or best[2]:
        assert text == ", ".join([f"shared: {', '.join(best[0])}", *(f"from+: {k}" for k in best[1]), *(f"to+: {k}" for k in best[2])])
    else:
        assert text == ", ".join(best[0])


def test_kernel_counts_unions():
    import numpy as np

    rng = np.random.default_rng(3)
    masks, ids = rng.integers(1, 32, 9), rng.integers(1, 5, 9).astype(float)
    got = subset.hits(masks, ids, 5)
    assert got.tolist() == [int(ids[(masks & g) != 0].sum()) for g in range(32)]


def test_large_search_goes_to_the_kernel(spark):
    names, sets, total, ratio, *frames = instance(spark, 9, 14, 3)
    r = subset.best_subset(*frames).first()
    assert (picked(r["picked"], names), r["sent"], r["received"], pytest.approx(r["score"])) == subset.brute_force(sets, names, 3, total, ratio)


def test_candidate_order_cap_and_evidence(spark):
    stats = spark.createDataFrame([("abx", 5, 1, 0), ("aby", 9, 1, 1), ("abz", 9, 1, 1), ("abw", 99, 0, 0), ("cab", 7, 4, 4), ("zzz", 50, 9, 9)], "search_key string, len bigint, sender_count bigint, recipient_count bigint")
    targets = spark.createDataFrame([("t", 1.0, 9, ["ab"], ["c"], ["abw", "none"], 1, 2, 5, False), ("u", 1.0, 9, [], [], [], 0, 9, 5, False)], TARGETS)
    got = [(r["name"], r["search_key"], r["position"], r["n"], r["width"]) for r in keys.candidates(stats, targets).orderBy("name", "position").collect()]
    assert got == [("t", "abw", 0, 2, 2), ("t", "aby", 1, 2, 2)]


def test_target_without_rules_fails(spark):
    targets = spark.createDataFrame([("t", 1.0), ("u", 2.0)], "name string, ratio double")
    rules = spark.createDataFrame([("t", ["a"])], "name string, include array<string>")
    assert keys.targets_with_rules(targets.filter("name = 't'"), rules).count() == 1
    with pytest.raises(Exception, match="no rules for target u"):
        keys.targets_with_rules(targets, rules).collect()


def test_two_rule_sets_fail(spark):
    t = spark.createDataFrame([("a", 1.0, 5, ["x"], [], [], 0, 5, 3, False)], TARGETS)
    rules = t.drop("ratio", "total_emails")
    goals = t.select("name", "ratio", "total_emails")
    assert keys.targets_with_rules(goals, rules).count() == 1
    with pytest.raises(Exception, match="several rule sets for target a"):
        keys.targets_with_rules(goals, rules.unionByName(rules)).collect()


def test_focus_and_exchange(spark):
    rows = [(1, "sender", "f@x.org", "f"), (1, "to_recipients", "a@x.org", "a"), (2, "sender", "a@x.org", "a"), (2, "cc_recipients", None, "alias"), (2, "to_recipients", "b@x.org", None), (3, "sender", "b@x.org", "b"), (4, "account_email", "f@x.org", "f")]
    k = spark.createDataFrame(rows, "id bigint, address_role string, email string, search_key string")
    focus = keys.focus_ids(k, ["f@x.org"], ["alias"])
    assert sorted(tuple(r) for r in focus.collect()) == [(1, True, False), (2, False, True)]
    pairs = keys.exchanged(k, focus)
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "received", 1), ("a", "sent", 2)]
    assert sorted(tuple(r) for r in keys.key_stats(k, pairs).collect()) == [("a", 2, 1, 1), ("alias", 1, 0, 0), ("b", 1, 0, 0), ("f", 2, 0, 0)]
