"""Operators against hand-made results and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinix.functions.maths import cosine, interpolated, normal_cdf, rounded_binary
from affinix.functions.windows import average_percent_rank, hazen
from affinix.operators import cooccurrence, ease, evaluation, metrics, recommend, scores, statistics, store
from affinix.sources import tables


def test_hazen_ties_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 2.0), (1, 5.0), (1, None), (2, 3.0)], "k int, v double")
    got = [(r.k, r.v, r.p) for r in df.select("k", "v", hazen("v", "k").alias("p")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0.0, None), (1, None, None), (1, 2.0, 1 / 3), (1, 2.0, 1 / 3), (1, 5.0, 2.5 / 3), (2, 3.0, 0.5)], key=str)
    assert [r.p for r in df.where("k = 2").select(average_percent_rank("v", "k").alias("p")).collect()] == [1.0]


def test_normal_cdf_and_interpolation(spark):
    from math import erf, sqrt

    z = [-5.0, -1.3, 0.0, 0.4, 2.2]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [(1 + erf(x / sqrt(2))) / 2 for x in z], atol=1e-7)
    grid, levels = [1.0, 2.0, 2.0, 6.0], [0.0, 0.3, 0.6, 1.0]
    x = [0.5, 1.5, 2.0, 3.0, 9.0]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(interpolated(F.col("x"), F.array(*map(F.lit, grid)), F.array(*map(F.lit, levels))).alias("y")).collect()]
    assert np.allclose(got, [0.0, 0.15, 0.6, 0.7, 1.0])


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0, 1.0], [2.0, 2.0], 1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)], "a array<double>, b array<double>, c double")
    assert all(abs(r.c - r.y) < 1e-12 for r in df.select("c", cosine(F.col("a"), F.col("b")).alias("y")).collect())


@pytest.fixture(scope="module")
def inter(spark):
    draw = np.random.default_rng(4)
    rows = []
    for u in range(30):
        for i in draw.choice(12, draw.integers(3, 9), replace=False):
            total = [0, 5, 10][i % 3]
            un = int(draw.integers(0, total + 1)) if total else 0
            first = None if draw.random() < 0.3 else int(draw.integers(1, 10**6))
            rows.append((u, int(i), float(draw.integers(0, 6) * 10), un if total else None, total, first, None if first is None else first + int(draw.integers(0, 10**7)), 0 if first is None else int(draw.integers(1, 4)), None if draw.random() < 0.3 else float(draw.random()), None if draw.random() < 0.3 else float(draw.random() * 100), un / total if total else None))
    return spark.createDataFrame(rows, "user_id long, item_id long, playtime double, ach_unlocked long, ach_total long, unlock_first long, unlock_last long, n_unlocks long, mean_surprisal double, min_pct double, completion double").cache()


def test_every_score_has_one_row_per_pair_and_is_not_negative(spark, inter):
    n = inter.count()
    for name in scores.REGISTRY:
        out = scores.compute(name, inter).toPandas()
        assert list(out.columns) == ["user_id", "item_id", "s"] and (out["s"] >= 0).all() and out["s"].notna().all(), name
        assert len(out) == n or name == "random_support", name
        assert not out.duplicated(["user_id", "item_id"]).any()


def test_scores_of_an_empty_frame(spark, inter):
    for name in scores.REGISTRY:
        assert scores.compute(name, inter.limit(0)).count() == 0, name


def test_review_scores_modes(spark):
    df = spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 0, 9.0), (1, 3, 0, 1.0), (2, 1, 0, 3.0)], "item_id long, user_id long, voted int, playtime double")
    linear = {(r.item_id, r.user_id): r for r in scores.review_scores(df).collect()}
    fixed = {(r.item_id, r.user_id): r for r in scores.review_scores(df, mode="fixed").collect()}
    assert linear[1, 2].s_round10 == 10 and linear[1, 2].vote_factor == 0.5 and linear[1, 3].vote_factor == 1.0 and fixed[1, 3].vote_factor == 0.5
    assert linear[1, 1].s_round10_rec == 5 * 1.3 and linear[2, 1].ptile == 1.0


def test_metrics_by_hand(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "user_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (2, 5)], "user_id long, item_id long")
    got = {r.user_id: r for r in metrics.ranking_metrics(recs, truth, 2).collect()}
    assert got[1].recall == pytest.approx(1 / 3) and got[1].precision == 0.5 and got[1].ndcg == pytest.approx(1 / (1 + 1 / np.log2(3)))
    assert got[2].recall == 0 and got[2].ndcg == 0
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])], "item_id long, v array<double>")
    ild = {r.user_id: r.ild for r in metrics.intra_list_diversity(recs, vectors).collect()}
    assert ild[1] == pytest.approx(2 / 3) and ild[2] == 0
    pop = spark.createDataFrame([(i, 10.0) for i in (10, 11, 12, 13)], "item_id long, popularity double")
    assert {r.user_id: r.novelty for r in metrics.novelty(recs, pop).collect()} == {1: 2.0, 2: 2.0}
    assert metrics.gini(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "value double")).first().gini == pytest.approx(0)
    assert metrics.gini(spark.createDataFrame([(0.0,), (0.0,), (3.0,)], "value double")).first().gini == pytest.approx(2 / 3)
    assert metrics.gini(spark.createDataFrame([], "value double")).first().gini == 0
    popular = spark.createDataFrame([(10,)], "item_id long")
    assert {r.user_id: round(r.serendipity, 6) for r in metrics.serendipity(recs, truth, popular).collect()} == {1: 0.333333, 2: 0.0}


@pytest.mark.parametrize("item_side", [0, 4096])
def test_ease_matches_a_dense_solution(spark, item_side, monkeypatch, tmp_path):
    """By the users' inverse, in row blocks and slabs of columns, and by the items' own."""
    monkeypatch.setattr(ease, "STEP", 3)
    draw = np.random.default_rng(7)
    rows = [(u, 10 + int(i), float(draw.uniform(0.1, 1))) for u in range(30) for i in draw.choice(12, draw.integers(3, 8), replace=False)]
    s = spark.createDataFrame(rows, "user_id long, item_id long, s double")
    model = ease.fit(s, ease.graph_users(s, least=1), lam=10.0, item_side=item_side)
    assert (model.p is None) == (item_side == 0)
    dense = np.zeros((30, 12))
    for u, i, w in rows:
        dense[u, i - 10] = w
    p = np.linalg.inv(dense.T @ dense + 10 * np.eye(12))
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0)
    full = ease.weights(model, k=12, item_block=5, slab=60).toPandas()
    got = np.zeros((12, 12))
    got[full["i"] - 10, full["j"] - 10] = full["sim"]
    assert np.allclose(got, b, atol=1e-5) and (got < 0).any() and len(full) == 12 * 11
    for slab, folder in ((10**6, None), (60, str(tmp_path / "slabs"))):
        cut = ease.weights(model, k=4, item_block=5, slab=slab, folder=folder).toPandas()
        assert len(cut) == 48
        for i, g in cut.groupby("i"):
            assert np.allclose(sorted(abs(g["sim"])), sorted(np.abs(b[i - 10]))[-4:], atol=1e-5)
            assert np.allclose(b[i - 10][g["j"] - 10], g["sim"], atol=1e-5)
    profile = draw.random(12)
    profile[3] = 0
    asked = spark.createDataFrame([(1, 10 + i, float(w)) for i, w in enumerate(profile) if w], "user_id long, item_id long, w double")
    scored = {r.item_id - 10: r.score for r in ease.exact_scores(model, asked).collect()}
    assert np.allclose([scored[i] for i in range(12)], profile @ b, rtol=1e-3, atol=1e-4)
    with pytest.raises(ValueError):
        ease.fit(s, ease.graph_users(s, least=1), max_side=5)


def test_ease_skips_columns_that_cannot_be_among_the_largest(spark, monkeypatch):
    """Items of which a few are strong and shared, most rare: few of all entries are made, and the largest are right."""
    monkeypatch.setattr(ease, "STEP", 16)
    draw = np.random.default_rng(1)
    rows = [(u, int(i), 1.0) for u in range(60) for i in draw.choice(20, 8, replace=False)]
    rows += [(int(draw.integers(0, 60)), 20 + i, 0.01) for i in range(400)]
    s = spark.createDataFrame(rows, "user_id long, item_id long, s double")
    model = ease.fit(s, ease.graph_users(s, least=1), lam=5.0, item_side=0)
    x = np.zeros((60, 420))
    for u, i, w in rows:
        x[u, i] = w
    p = np.linalg.inv(x.T @ x + 5 * np.eye(420))
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0)
    got = ease.weights(model, k=5, item_block=64).toPandas()
    for i, g in got.groupby("i"):
        assert np.allclose(sorted(abs(g["sim"])), sorted(np.abs(b[i]))[-len(g) :], atol=1e-5)
    assert ease.compared_share(model, k=5, item_block=64) < 0.5


def test_ease_of_many_users_is_solved_without_their_square(spark, monkeypatch):
    """What is sent to tasks is the scores alone; solutions are right for rows of several pieces, repeated scores and users without any."""
    draw = np.random.default_rng(3)
    u, at = draw.integers(0, 300, 4000).astype(np.int32), np.minimum(draw.integers(0, 60, 4000), draw.integers(0, 60, 4000)).astype(np.int32)
    u[u == 7] = 8
    s = draw.uniform(0.1, 1, 4000).astype(np.float32)
    dense = np.zeros((300, 60))
    np.add.at(dense, (u, at), s)
    right = draw.random((300, 5)).astype(np.float32)
    right[:, 2] = 0
    assert np.bincount(at).max() > ease._Rows.PIECE
    got = ease.Sampled(u, at, s, 300, 60).solved(right, 0.5)
    assert np.allclose(got, np.linalg.solve(dense @ dense.T + 0.5 * np.eye(300), right), atol=1e-4)
    rows = spark.createDataFrame([(user, user % 50, 0.5) for user in range(300)], "user_id long, item_id long, s double")
    model = ease.fit(rows, ease.graph_users(rows, least=1), item_side=0)
    held = [len(v) if np.ndim(v) else 1 for v in vars(model.x).values()]
    assert max(held) == 300 and all(np.ndim(v) < 2 for v in vars(model.x).values())


def test_places_with_ties_and_nulls(spark):
    from affinix.functions.windows import ordinal_percent, placed

    draw = np.random.default_rng(2)
    rows = [(i, None if i % 50 == 0 else float(draw.integers(0, 5)) if i % 2 else float(draw.normal())) for i in range(3000)]
    got = {r.i: (r.place, r.n_rows) for r in placed(spark.createDataFrame(rows, "i long, v double").repartition(5), "v", "i", parts=8).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
    assert got == {i: (k, 3000) for k, (i, _) in enumerate(want)}
    same = ordinal_percent(spark.range(101).select("id", F.lit(1.0).alias("v")), "v", "id")
    assert {r.id: r.pct for r in same.collect()} == {i: i / 100 for i in range(101)}
    assert ordinal_percent(spark.createDataFrame([(1, 2.0)], "i long, v double"), "v", "i").first().pct == 0


def test_gram_of_a_heavy_user(spark):
    rows = spark.createDataFrame([(1, i, 1.0) for i in range(50)] + [(2, 3, 2.0), (2, 4, 0.5)], "user_id long, item_id long, s double")
    got = {(r.i, r.j): r.c for r in ease.gram(rows, block=8).collect()}
    assert len(got) == 50 * 51 // 2 and got[3, 4] == 2.0 and got[3, 3] == 5.0 and got[0, 49] == 1.0


def test_cooccurrence_and_containment(spark):
    rows = spark.createDataFrame([(u, i) for u in range(5) for i in (1, 2)] + [(9, 3), (9, 1)], "user_id long, item_id long")
    assert {(r.i, r.j, r.c) for r in cooccurrence.pair_counts(rows).collect()} == {(1, 2, 5), (1, 3, 1)}
    assert {(r.i, r.j) for r in cooccurrence.containment_pairs(rows).collect()} == {(1, 2), (2, 1)}


def test_relaxation_and_fallback(spark):
    assert recommend.relaxed({"coop": True, "max_price": 10}) == ({"coop": True, "max_price": 15.0}, "looser max_price")
    assert recommend.relaxed({"max_price": 0, "korean": True}) == ({"max_price": 0.0, "korean": True}, "looser max_price")
    assert recommend.relaxed({"coop": True, "free": None}) == ({"free": None}, "without coop")
    assert recommend.relaxed({}) == ({}, None)
    cat = spark.createDataFrame([(1, True, False, 5.0, "KRW"), (2, False, False, 50.0, "KRW")], "item_id long, coop boolean, is_free boolean, price double, currency string").withColumns({c: F.lit(False) for c in ("multiplayer", "single_player", "korean")}).withColumn("release", F.lit(None).cast("string"))
    cands = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "user_id long, item_id long")
    kept, done = recommend.filtered_or_relaxed(cands, cat, {"coop": True, "max_price": 3}, 1)
    assert {r.item_id for r in kept.collect()} == {1, 2, 3} or done  # relaxed at most twice
    kept, done = recommend.filtered_or_relaxed(cands, cat, {"coop": True}, 2)
    assert done == ["without coop"] and {r.item_id for r in kept.collect()} == {1, 2}  # 3 has no metadata
    kept, done = recommend.filtered_or_relaxed(cands, cat, {"coop": True}, 2, refilter_last=False)
    assert done == ["without coop"] and {r.item_id for r in kept.collect()} == {1}


def test_routes():
    assert recommend.route({"request_type": "library", "constraints": {"coop": True, "free": False, "max_price": None}}, True, False) == {"request_type": "library", "constraints": {"coop": True}, "seed_titles": []}
    assert recommend.route(None, True, False)["request_type"] == "library"
    assert recommend.route({"request_type": "anonymous"}, True, False)["request_type"] == "explore"
    assert recommend.route({"request_type": "multi_entity"}, False, False)["request_type"] == "anonymous"


def test_order_interleave_and_gate(spark):
    lists = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1), (2, 7, 2)], "list long, item_id long, pos int")
    assert [r.item_id for r in recommend.interleaved(lists, 9).orderBy("rank").collect()] == [5, 6, 7]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, v string")
    assert [r.v for r in recommend.in_given_order([2, 9, 1], rows).collect()] == ["b", None, "a"]


def test_statistics(spark):
    a = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id long, x double")
    b = a.withColumn("x", F.col("x") + 1)
    r = statistics.bootstrap_ci(a, "x", "id", 300).first()
    assert r.low < r.mean < r.high and r.n == 200
    p = statistics.paired_bootstrap(a, b, "id", "x", 200).first()
    assert p.significant and p.mean == 1
    assert statistics.wilcoxon(a, a, "id", "x").first().p is None
    assert statistics.wilcoxon(a, b, "id", "x").first().p < 1e-6
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: round(r.q, 6) for r in statistics.benjamini_hochberg(tests).collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_verdicts(spark):
    anchors = {"random": 0.01, "popularity": 0.1, "oracle": 1.0, "oracle_drop5": 0.9, "oracle_drop10": 0.8}

    def verdict(real, **other):
        rows = [*(anchors | other).items(), *real.items()]
        return evaluation.verdicts(spark.createDataFrame(rows, "system string, recall double"), list(real)).first()

    assert verdict({"x": 0.3, "y": 0.2}).verdict == "USE"
    assert verdict({"x": 0.3, "y": 0.2}, popularity=0.2).verdict == "USE+DEBIAS"
    assert verdict({"x": 0.3}).verdict == "WEAK"
    last = verdict({}, oracle=0.5)
    assert last.verdict == "DEMOTE" and last.spread == 0
    assert "oracle" in evaluation.report(anchors, last.asDict())


def test_cold_fill_gates_and_steered_fallback(spark):
    warm = spark.createDataFrame([(1, 10, 5.0, 1)], "user_id long, item_id long, score double, rank int")
    sims = spark.createDataFrame([(1, 20, 0.9), (1, 21, 0.8), (1, 22, 0.7), (2, 22, 0.6), (2, 23, 0.0)], "user_id long, item_id long, sim double")
    pool = spark.createDataFrame([(i,) for i in (10, 20, 21, 22, 23)], "item_id long")
    none = spark.createDataFrame([], "user_id long, item_id long")
    cat = spark.createDataFrame([(20, False, None), (21, False, 5.0), (22, True, 0.0)], "item_id long, is_free boolean, price double")
    signals = spark.createDataFrame([(21, None, 0.1, 0.5)], "item_id long, metacritic double, quality_pct double, pop_pct double")
    got = recommend.cold_filled(warm, sims, pool, none, 2, cat, signals)
    assert sorted((r.user_id, r.item_id, r.source) for r in got.collect()) == [(1, 10, "cf"), (1, 22, "cold"), (2, 22, "cold")]
    steered = recommend.steered_list(warm, sims, 1.0, 5, signals, got)
    assert sorted((r.user_id, r.item_id, r.source) for r in steered.collect()) == [(1, 10, "steer"), (2, 22, "cold")]


def test_group_plan_relaxes_each_group_on_its_own(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "group_id long, user_id long")
    scores = spark.createDataFrame([(1, 5, 3.0), (1, 6, 2.0), (1, 9, 1.0), (2, 7, 4.0), (2, 5, 1.0), (3, 5, 1.0), (3, 6, 0.5), (3, 7, -1.0)], "user_id long, item_id long, score double")
    seen = spark.createDataFrame([(2, 9)], "user_id long, item_id long")
    cat = spark.createDataFrame([(5, True, False), (6, False, True), (7, True, True)], "item_id long, coop boolean, korean boolean").withColumns({c: F.lit(False) for c in ("multiplayer", "single_player", "is_free")})
    got = recommend.group_plan(members, scores, seen, cat, {"coop": True, "korean": False}, 2)
    assert [(r.group_id, r.item_id, r.level) for r in got.orderBy("group_id", "rank").collect()] == [(1, 5, 0), (1, 7, 0), (2, 5, 1), (2, 6, 1)]
    low = recommend.group_plan(members, scores, seen, cat, {}, 3, "min")
    assert {r.item_id for r in low.where("group_id = 1").collect()} == {5}
    assert [(r.user_id, r.item_id) for r in recommend.plain_plan(scores, seen, cat, {"coop": True}, 5, window=2).orderBy("user_id", "rank").collect()] == [(1, 5), (2, 7), (2, 5), (3, 5)]



def test_oracle_lists(spark):
    truth = spark.createDataFrame([(1, i, i) for i in range(1, 9)], "user_id long, item_id long, pos int")
    pool = spark.range(1, 40).withColumnRenamed("id", "item_id")
    got = evaluation.oracle_lists(truth, pool, 3).collect()
    assert len(got) == 8 and sum(r.item_id <= 8 for r in got) == 5 and sorted(r["rank"] for r in got) == list(range(1, 9))


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 0), (3, "C", 5)], "k long, v string, t long")
    assert {(r.k, r.v) for r in store.latest(old, new, ["k"], "t").collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {(r.k, r.v) for r in store.inserted(old, new, ["k"], "t").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    names = spark.createDataFrame([("x", str(i)) for i in range(50)], "g string, n string")
    first = store.interned(spark.createDataFrame([], "g string, n string, id long"), names.limit(20), ["g", "n"])
    both = store.interned(first, names, ["g", "n"])
    assert sorted(r.id for r in both.collect()) == list(range(1, 51))
    assert first.join(both, ["g", "n", "id"]).count() == 20


def test_parsed_item(spark):
    doc = '{"name":"N","type":"game","is_free":false,"price_overview":{"currency":"KRW","final":1999},"metacritic":{"score":80},"release_date":{"coming_soon":false,"date":"Jan 1, 2020"},"categories":[{"description":"Co-op"}],"developers":["A","B"]}'
    r = spark.createDataFrame([(doc,), ("junk",)], "j string").select(store.parsed_item(F.col("j")).alias("p")).collect()
    assert r[0].p.price_final == 1999 and r[0].p.developers == "A, B" and r[0].p.coming_soon == 0 and r[1].p.name is None


def test_column_wise_merge(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "k long, v string, w long")
    new = spark.createDataFrame([(1, None, 10, 1), (2, "b", None, 1), (2, "B", None, 2), (2, None, None, 3), (4, "d", None, 1)], "k long, v string, x long, t long")
    got = {r.k: (r.v, r.w, r.x) for r in store.merged(old, new, ["k"], "t").collect()}
    assert got == {1: ("a", 1, 10), 2: ("B", 2, None), 3: ("c", 3, None), 4: ("d", None, None)}
    queue = store.enqueued(spark.createDataFrame([(7, 0, 1)], "user_id long, depth int, seq long"), spark.createDataFrame([(7,), (8,), (8,), (None,), (9,)], "user_id long"), 1)
    assert sorted((r.user_id, r.depth) for r in queue.collect()) == [(7, 0), (8, 1), (9, 1)] and {r.seq for r in queue.collect()} == {1, 2, 3}


def test_rounding_of_binary_halves(spark):
    draw = np.random.default_rng(3)
    x = [float(v) for v in draw.uniform(-50, 50, 3000)] + [float(k) / 32 for k in range(-4000, 4000)] + [round(float(v), 5) for v in draw.uniform(-3, 3, 4000)]
    x += [0.0, -0.0, 1e-9, -3e-5, 2.5e-5, 5e-5, 0.00005, 0.00015, 2.00005, 123456.78905, 2.0**39, 2.0**39 - 2.0**-13, 1e300, 5e-324, 0.99995, 1.00005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(-1, None), (-2, float("nan")), (-3, float("inf"))], "i long, x double")
    got = {r.i: r.y for r in df.select("i", rounded_binary(F.col("x"), 4).alias("y")).collect()}
    assert [got[i] for i in range(len(x))] == [round(v, 4) for v in x]
    assert got[-1] is None and np.isnan(got[-2]) and got[-3] == float("inf")


def test_scans_over_ranges(spark):
    from affinix.functions.windows import scanned

    draw = np.random.default_rng(5)
    rows = [(i, None if i % 40 == 0 else float(draw.integers(0, 6)) if i % 2 else float(draw.normal()), int(draw.integers(0, 9))) for i in range(1500)]
    got = {r.i: (r.upto, r.low) for r in scanned(spark.createDataFrame(rows, "i long, v double, c long").repartition(4), "v", "i", {"upto": "c"}, {"low": "c"}, parts=8).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
    total, sums = 0, {}
    for i, _, c in want:
        total += c
        sums[i] = total
    lows, low = {}, 10
    for i, _, c in reversed(want):
        low = min(low, c)
        lows[i] = low
    assert got == {i: (sums[i], lows[i]) for i in sums}


def test_item_pairs_of_heavy_users(spark):
    draw = np.random.default_rng(6)
    rows = [(1, i, float(i)) for i in range(60)] + [(u, int(i), float(draw.integers(1, 9))) for u in range(2, 12) for i in draw.choice(60, 20, replace=False)]
    want = {}
    for u in {r[0] for r in rows}:
        mine = sorted((i, w) for v, i, w in rows if v == u)
        for k, (i, w) in enumerate(mine):
            for j, x in mine[k + 1 :]:
                want[i, j] = want.get((i, j), 0) + w * x
    got = {(r.i, r.j): r.c for r in cooccurrence.pair_counts(spark.createDataFrame(rows, "user_id long, item_id long, s double"), "s", block=8).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [0.3, 0.75, 0.98, 1.0])
def test_containment_by_prefixes(spark, threshold):
    draw = np.random.default_rng(8)
    owners = [set(draw.choice(40, draw.integers(2, 30), replace=False).tolist()) for _ in range(12)]
    owners += [set(list(o)[: max(3, len(o) - 1)]) for o in owners[:6]] + [set(owners[0])]
    rows = [(int(u), i) for i, o in enumerate(owners) for u in o]
    want = {(i, j) for i, a in enumerate(owners) for j, b in enumerate(owners) if i != j and min(len(a), len(b)) >= 3 and len(a & b) >= threshold * min(len(a), len(b))}
    got = cooccurrence.containment_pairs(spark.createDataFrame(rows, "user_id long, item_id long"), threshold, block=4).collect()
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)


def test_nearest_vectors_against_all_pairs(spark):
    from affinix.operators import vector_search

    draw = np.random.default_rng(9)
    centres = draw.normal(size=(12, 16))
    v = np.concatenate((centres[draw.integers(0, 12, 3000)] + 0.05 * draw.normal(size=(3000, 16)), np.repeat(centres[:1], 200, 0), np.zeros((3, 16)), -centres[:4]))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(None, [1.0] * 16), (9999, None)], "id long, v array<double>")
    length = np.sqrt((v * v).sum(1))
    unit = v / np.where(length > 0, length, 1)[:, None]
    sim = np.round(unit @ unit.T, 9)
    seeds = [0, 5, 77, 3000, 3100, 3200, 3202, 3204]

    def nearest(i, k, own):
        order = sorted((j for j in range(len(v)) if own or j != i), key=lambda j: (-sim[i, j], j))
        return [(j, sim[i, j]) for j in order[:k]]

    for own in (False, True):
        got = vector_search.nearest_vectors(df, spark.createDataFrame([(s,) for s in seeds], "id long"), 7, own, index=(i := vector_search.VectorIndex(df, 8, 16))).collect()
        assert len(i.cells) > 8
        for s in seeds:
            mine = [(r.id, r.sim) for r in sorted((r for r in got if r.seed == s), key=lambda r: r.rank)]
            assert [j for j, _ in mine] == [j for j, _ in nearest(s, 7, own)] and np.allclose([x for _, x in mine], [x for _, x in nearest(s, 7, own)])
    shares = vector_search.compared_pairs(df, spark.createDataFrame([(s,) for s in (0, 5, 77, 3000)], "id long"), 7).first()
    assert shares.n_pairs == 4 * len(v) and shares.share < 0.7
    assert vector_search.nearest_vectors(df.limit(0), df, 3).count() == 0


def test_binary_rounding_agrees_with_exact_decimals_and_uses_none(spark):
    """Halves, their neighbours, and numbers of all sizes against Python's exact decimals; the plan has no decimals, which take most of the time."""
    from decimal import ROUND_HALF_EVEN, Decimal

    draw = np.random.default_rng(8)
    xs = np.concatenate((draw.integers(1, 2**40, 3000) / 2.0**5, (2 * draw.integers(0, 10**6, 3000) + 1) / 20000, draw.uniform(0, 1, 2000) * 10.0 ** draw.integers(-5, 11, 2000)))
    xs = np.concatenate((xs, np.nextafter(xs, 0), np.nextafter(xs, np.inf)))
    xs = np.concatenate((xs, -xs))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", rounded_binary(F.col("x"), 4).alias("y"))
    for r in df.collect():
        assert r.y == float(Decimal(r.x).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))
    assert "decimal" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_vectors_of_every_vector_in_slabs(spark, monkeypatch):
    """Several slabs and chunks, ties and a zero vector; a few answers for each seed and slab leave the tasks."""
    from affinix.operators import vector_search

    monkeypatch.setattr(vector_search, "SLAB", 300)
    monkeypatch.setattr(vector_search, "BLOCK", 64)
    monkeypatch.setattr(vector_search, "CHUNK", 100)
    v = np.random.default_rng(4).normal(size=(900, 8))
    v[100:140], v[500] = v[7], 0
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    unit = v / np.where((v * v).sum(1) > 0, np.sqrt((v * v).sum(1)), 1)[:, None]
    sim = np.round(unit @ unit.T, 9)
    want = {i: sorted(range(900), key=lambda j: (-sim[i, j], j))[:5] for i in range(900)}  # noqa: B023
    got: dict = {}
    for r in vector_search.nearest_vectors(df, df, 5, True).orderBy("seed", "rank").collect():
        got.setdefault(r.seed, []).append(r.id)
    assert got == want
    index = vector_search.VectorIndex(df)
    found, chunks = vector_search._searched(index, df, 5, True)
    assert chunks.count() > 4 and found.where("id is not null").count() == 3 * 900 * 5


def test_titles_are_found_without_all_pairs(spark):
    from affinix.functions.text import titles_match
    from affinix.operators.catalogue import title_matches

    titles = ["Dark Souls", "DARK SOULS: REMASTERED", "Dark Souls III", "Souls", "Ori", "The Witcher 2", "The Witcher: Enhanced", "Witch", "Go", "Let's go", "A", "", None, "abcd", "xabcdx", "dark", "Dark Souls"]
    wanted = ["dark souls", "Dark Souls II", "the witcher 3: wild hunt", "go", "or", "a", "", None, " Witch ", "abcd", "zabcdz", "no such title", "dark souls"]
    t, w = spark.createDataFrame([(x,) for x in titles], "title string"), spark.createDataFrame([(x,) for x in wanted], "wanted string")
    every = w.distinct().crossJoin(t.distinct()).where(titles_match(F.col("wanted"), F.col("title"))).collect()
    got = title_matches(w, t).collect()
    # An empty title is part of nothing here: it has fewer than four characters.
    assert {tuple(r) for r in got} == {tuple(r) for r in every} and len(got) == len(every)


def test_samples(spark):
    from affinix.operators import sampling

    users = spark.createDataFrame([(u, 1, int(u % 2 == 0)) for u in range(50)], "user_id long, public int, complete int")
    owned = spark.createDataFrame([(u, i, float(i % 3)) for u in range(50) for i in range(u)], "user_id long, item_id long, playtime double")
    pool = spark.range(30).withColumnRenamed("id", "item_id")
    got = sampling.example_library(users, owned, pool, 8).collect()
    assert len({r.user_id for r in got}) == 1 and len(got) >= 8 and got[0].user_id % 2 == 0 and all(r.playtime > 0 for r in got)
    assert sampling.example_library(users, owned, pool, 31).count() == 0
    drawn = sampling.unscreened(spark, users, 40, 0, 100).collect()
    assert len(drawn) == 40 and all(50 <= r.user_id <= 100 for r in drawn)
    assert sampling.unscreened(spark, users, 10, -1, 50).count() == 0
    rows = spark.createDataFrame([(k, s) for s, k in enumerate([5, None, 5, 9, 1, 9, 7])], "k long, s long")
    assert {r.k for r in sampling.first_seen(rows, "k", "s", 3).collect()} == {5, 9, 1}
    a, b = rows.limit(4), rows.subtract(rows.limit(4))
    whole = {r.k for r in sampling.bottom_k(rows, "k", 2).collect()}
    parts = sampling.bottom_k(a, "k", 2).unionByName(sampling.bottom_k(b, "k", 2))
    assert {r.k for r in sampling.bottom_k(parts, "k", 2).collect()} == whole


def test_routes(spark):
    import itertools

    kinds = ["library", "explore", "multi_entity", "anonymous", "seed", None]
    rows = [(k, *facts) for k in kinds for facts in itertools.product([True, False], repeat=3)]
    df = spark.createDataFrame(rows, "request_type string, has_library boolean, has_friend boolean, failed boolean")
    got = {(r.request_type, r.has_library, r.has_friend, r.failed): r.kind for r in recommend.routed(df).collect()}
    for kind, library, friend, failed in rows:
        want = kind or "anonymous"
        if want == "multi_entity" and not friend:
            want = "library"
        if want in ("library", "explore") and not library:
            want = "anonymous"
        if want == "anonymous" and library:
            want = "library" if failed else "explore"
        assert got[kind, library, friend, failed] == want, (kind, library, friend, failed)


def test_small_helpers(spark):
    from affinix.functions import text
    from affinix.operators import content

    wanted = spark.createDataFrame([(" Co Op ",), ("RPG",), ("none",)], "name string")
    assert {r.tag for r in content.resolved_tags(wanted, spark.createDataFrame([("co-op",), ("rpg",)], "tag string")).collect()} == {"co-op", "rpg"}
    assert spark.range(1).select(text.joined(F.array(F.lit("a"), F.lit("b"))).alias("x")).first().x == "a, b"
    labels = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (5, 50)], "seed_item long, seed_support long")
    stats = evaluation.label_stats(labels).first()
    assert stats.n_labels == 5 and stats.support_quartiles == [10, 20, 30, 40, 50]
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "user_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 11)], "user_id long, item_id long")
    assert {r.k: r.recall for r in evaluation.per_seed(recs, truth, [1, 2]).collect()} == {1: 0.0, 2: 1.0}
    votes = '{"name":"N","positive":7,"negative":"x","score_rank":"","tags":{"RPG":5}}'
    r = spark.createDataFrame([(votes,)], "j string").select(store.parsed_votes(F.col("j")).alias("p"), store.today_utc().alias("d"), store.now_iso().alias("t")).first()
    assert r.p.positive == 7 and r.p.negative is None and r.p.score_rank is None and r.p.tags_json == '{"RPG":5}'
    assert len(r.d) == 10 and r.t.startswith(r.d[:8]) and r.t.endswith("+00:00")


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_containment_moves_lists_not_pairs(spark, threshold):
    """Many owners of many items: candidates need common owners, and the answer is that of counting all pairs."""
    draw = np.random.default_rng(12)
    owns = {u: set(draw.choice(60, draw.integers(1, 30), replace=False).tolist()) for u in range(200)}
    owns |= {u: {70, 71} for u in range(200, 206)} | {206: {70}}
    rows = [(u, int(i)) for u, o in owns.items() for i in o]
    of = {i: {u for u, o in owns.items() if i in o} for i in range(72)}
    want = {(i, j) for i in of for j in of if i != j and min(len(of[i]), len(of[j])) >= 3 and len(of[i] & of[j]) >= threshold * min(len(of[i]), len(of[j]))}
    df = cooccurrence.containment_pairs(spark.createDataFrame(rows, "user_id long, item_id long"), threshold, block=8)
    assert {(r.i, r.j) for r in df.collect()} == want and (70, 71) in want
    assert cooccurrence.MET > 1


def test_split_takes_decimal_shares(spark):
    """0.7 * 45 is 31.5, which goes to 32; as binary numbers it is a little less."""
    rows = spark.range(45).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("item_id"))
    assert evaluation.split_by_hash(rows).where("train").count() == 32


def test_rounding_of_scaled_numbers(spark):
    from affinix.functions.maths import rounded_scaled

    values = [0.15625, 1.005, -1.005, 2.5, -2.5, 0.285]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded_scaled(F.col("v"), 2).alias("v")).collect()]
    assert got == [0.16, 1.0, -1.0, 2.5, -2.5, 0.28]


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    from affinix.functions import windows

    monkeypatch.setattr(windows, "SPREAD", 100)
    df = windows.spread(spark.range(3000).select((F.col("id") % 500).alias("k"), "id"), "k", 3000)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 300


def test_many_lines_meet_orders_in_bounded_tasks(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    few = tables.lines(spark, folder)
    monkeypatch.setattr(tables, "JOINED", 100, raising=False)
    many = tables.lines(spark, folder)
    rows = many.count()
    sizes = [n for n in many.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]]
    assert len(sizes) > rows / 200 and max(sizes) < 300
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_interactions_are_dealt_into_bounded_tasks(spark, monkeypatch):
    """Rarity and items are met in tasks of bounded size, which windows by item keep: no other shuffle of the rows follows."""
    from affinix.functions import windows
    from affinix.operators import features

    lines = spark.range(4000).selectExpr("id % 97 user_id", "id % 200 item_id", "cast(id % 3 as int) ach_id", "double(id % 11) playtime", "if(id % 2 = 0, 'A', 'N') flag", "1 progress", "id unlock_time")
    items = spark.range(200).selectExpr("id item_id", "5L ach_total")
    monkeypatch.setattr(windows, "SPREAD", 100)
    inter = features.interactions(lines, items)
    made = scores.rarity_depth_blend(inter)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == inter.count() and len(sizes) > 20 and max(sizes) < 400
    capped = scores.per_user_cap(inter, rows=4000)
    assert max(r["count"] for r in capped.groupBy(F.spark_partition_id()).count().collect()) < 400


def test_rarity_counts_repeated_unlocks_and_not_rows_without_a_user(spark):
    from math import log

    from affinix.operators import features

    rows = [(1, 7, 1, "A"), (1, 7, 1, "A"), (1, 7, 2, "A"), (2, 7, 1, "A"), (3, 7, 1, "N"), (4, 7, None, "A"), (None, 7, 2, "A")]
    lines = spark.createDataFrame([(u, i, a, 1.0, f, 1, 0) for u, i, a, f in rows], "user_id long, item_id long, ach_id int, playtime double, flag string, progress int, unlock_time long")
    got = {r.user_id: (r.mean_surprisal, r.min_pct) for r in features.interactions(lines, spark.createDataFrame([(7, 5)], "item_id long, ach_total long")).collect()}
    assert got[3] == got[4] == got[None] == (None, None) and got[2] == (-log(0.4), 40.0)
    assert got[1][1] == 40.0 and abs(got[1][0] + log(0.4)) < 1e-12


def test_plays_are_the_interactions_playing_times(spark):
    from affinix.operators import features

    lines = spark.createDataFrame([(1, 7, 1, 2.0, "A", 1, 0), (1, 7, 2, 3.0, "N", 1, 0), (2, 7, 1, None, "A", 1, 0), (None, 8, 1, 4.0, "N", 1, 0)], "user_id long, item_id long, ach_id int, playtime double, flag string, progress int, unlock_time long")
    items = spark.createDataFrame([(7, 5)], "item_id long, ach_total long")
    want = sorted(map(tuple, features.interactions(lines, items).select("user_id", "item_id", "playtime").collect()), key=str)
    for rows in (None, 4):
        assert sorted(map(tuple, features.plays(lines, rows).collect()), key=str) == want


def test_liked_reads_scores_once_and_cosines_count_pairs_once(spark, tmp_path):
    rows = [(u, i, 0.9) for u in range(6) for i in range(4) if (u + i) % 5] + [(9, 1, 0.9), (None, 1, 0.9), (None, 2, 0.9)]
    spark.createDataFrame(rows, "user_id long, item_id long, s double").write.parquet(f"{tmp_path}/s")
    liked = cooccurrence.liked(spark.read.parquet(f"{tmp_path}/s"))
    assert {(r.user_id, r.item_id) for r in liked.collect()} == {(u, i) for u, i, _ in rows if u not in (9, None)}
    assert liked._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    cosines = cooccurrence.conditional_cosine(liked, 2)
    got = {(r.i, r.j): r.c for r in cosines.collect()}
    assert got and all(got[j, i] == c for (i, j), c in got.items())
    assert cosines._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [i#") == 1


def test_validation_by_places_is_that_of_lists(spark):
    """Lists of all users and places of truth's items give what lists made for each user give."""
    truth = spark.createDataFrame([(u, i) for u in range(5) for i in range(12) if (u * 7 + i * 3) % 4], "user_id long, item_id long").selectExpr("*", "row_number() over (partition by user_id order by item_id) pos")
    pool = spark.range(15).selectExpr("id item_id")
    first = spark.createDataFrame([(4, 1), (2, 2), (14, 3), (7, 4)], "item_id long, rank int")
    users = truth.select("user_id").distinct()
    lists = {"random": evaluation.random_lists(users, pool, 6), "one": users.crossJoin(first), "oracle": evaluation.oracle_lists(truth, pool), "dropped": evaluation.oracle_lists(truth, pool, 3)}
    sized = evaluation.sized(truth)
    found = {"random": evaluation.random_places(truth, pool, 6), "oracle": evaluation.oracle_kept(sized), "dropped": evaluation.oracle_kept(sized, 3)}
    values = lambda d: {r.system: (round(r.recall, 12), round(r.ndcg, 12)) for r in d.collect()}
    for k in (3, 6):
        assert values(evaluation.validation(lists, truth, k)) == values(evaluation.validation({}, truth, k, {"one": first}, found)) == values(evaluation.validation({"one": lists["one"]}, truth, k, None, found))


def test_graph_users_are_not_sampled(spark):
    """All users with enough positive scores are in the model, however many."""
    rows = spark.range(12_500).withColumnRenamed("id", "user_id").crossJoin(spark.range(5).withColumnRenamed("id", "item_id")).withColumn("s", F.lit(0.5))
    few = spark.createDataFrame([(-1, 0, 0.5)], "user_id long, item_id long, s double")
    assert ease.graph_users(rows.union(few)).count() == 12_500
    assert ease.graph_users(rows, cap=100).count() == 100


def test_class_recommendations_come_from_all_users():
    from affinix.plans import recommending

    assert "LIMIT" not in recommending.SQL["ease_class_recommend"] and "LIMIT 12000)" in recommending.SQL["ease_class_weights"]


def test_content_scores_and_steered_lists_are_made_for_all_users(spark):
    import __spark_entry__ as entry

    for name, some in (("content_scores", False), ("steered_gated", False), ("hybrid_gated", True)):
        assert ("user_id % 100 = 0" in entry.oracle_sql()[name]) == some
    for name in ("content_scores", "steered_gated"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").where("user_id % 100 <> 0").count() > 0


def test_playtime_grid_has_the_doubles_of_sql(spark):
    """Also where neighbours are equal, and a quantile is a bit off them."""
    import duckdb

    from affinix.operators import features

    draw = np.random.default_rng(4)
    rows = [(i, float(v)) for i in range(300) for v in ((62, 62) if i == 0 else draw.integers(0, 8 + i, draw.integers(1, 9)))]
    inter = spark.createDataFrame(rows, "item_id long, playtime double")
    got = {r.item_id: r.grid for r in features.playtime_grid(inter, inter.where("playtime > 0").select("item_id").distinct()).collect()}
    con = duckdb.connect()
    con.execute("create table inter (item_id bigint, playtime double)")
    con.executemany("insert into inter values (?, ?)", rows)
    want = con.execute(f"select item_id, quantile_cont(playtime, {[k / 20 for k in range(21)]}) from inter where playtime > 0 group by 1").fetchall()
    assert got == dict(want) and got[0][6] != 62.0
    flat = F.array(*map(F.lit, [1.0, 3.0, 3.0, 3.0000000000000004, 4.0]))
    y = spark.range(1).select(interpolated(F.lit(3.0), flat, F.array(*map(F.lit, [0.0, 0.25, 0.5, 0.75, 1.0]))).alias("y"), interpolated(F.lit(3.0), F.array(*map(F.lit, [1.0, 3.0000000000000004, 3.0, 3.0, 4.0])), flat).alias("n")).first()
    assert y.y == 0.5 and np.isnan(y.n)


def test_ease_solves_components_by_themselves(spark, monkeypatch):
    """Items that no chain of users connects are numbered, sent and solved apart, in batches of whole components; B is that of all."""
    draw = np.random.default_rng(9)
    sizes = ((0, 10, 0, 8), (10, 30, 8, 20), (30, 33, 20, 21), (33, 48, 21, 35))  # users and items of each
    rows = [(u, 100 + 8 * int(i) % 35, float(draw.uniform(0.1, 1))) for a, b, low, high in sizes for u in range(a, b) for i in draw.permutation(np.arange(low, high))[: draw.integers(2, 6)]]
    s = spark.createDataFrame(rows, "user_id long, item_id long, s double").repartition(3)
    x = np.zeros((48, 35))
    for u, i, w in rows:
        x[u, i - 100] = w
    p = np.linalg.inv(x.T @ x + 10 * np.eye(35))
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0)
    one = ease.fit(s, ease.graph_users(s, least=1), lam=10.0, item_side=0)
    assert one.batches == 1 and len(one.x.first_items) >= 4
    near, item, user = one.x.around(int(one.x.first_items[1]), int(one.x.first_items[1]))
    assert near.items < 35 and near.users < 48 and len(near.s) < len(rows) and (near.u >= 0).all() and (near.u < near.users).all()
    monkeypatch.setattr(ease, "SLAB", 60)
    some = ease.fit(s, ease.graph_users(s, least=1), lam=10.0, item_side=0)
    assert some.batches > 1 and some.x is None
    asked = spark.createDataFrame([(1, 100 + i, 1.0) for i in range(35)], "user_id long, item_id long, w double")
    for model in (one, some):
        got = np.zeros((35, 35))
        for r in ease.weights(model, k=35, item_block=5).collect():
            got[r.i - 100, r.j - 100] = r.sim
        assert np.allclose(got, b, atol=1e-5)
    scored = {r.item_id - 100: r.score for r in ease.exact_scores(some, asked).collect()}
    assert np.allclose([scored.get(i, 0) for i in range(35)], b.sum(axis=0), rtol=1e-3, atol=1e-4)


def test_ease_best_scores_are_those_of_all_pairs(spark, monkeypatch):
    """Slabs of columns and chunks of users give what scores of all pairs of users and items give, for users of several components too."""
    monkeypatch.setattr(ease, "ENTRIES", 40)
    monkeypatch.setattr(ease, "HELD", 30)
    draw = np.random.default_rng(5)
    rows = [(u, 20 * (u % 3) + int(i), float(draw.uniform(0.1, 1))) for u in range(60) for i in draw.choice(20, draw.integers(5, 9), replace=False)]
    s = spark.createDataFrame(rows, "user_id long, item_id long, s double")
    model = ease.fit(s, ease.graph_users(s), lam=10.0, item_side=0)
    asked = s.withColumnRenamed("s", "w").union(spark.createDataFrame([(99, 3, 1.0), (99, 30, 0.5), (98, 777, 1.0)], "user_id long, item_id long, w double"))
    b = spark.createDataFrame(ease.weights(model, 6).toPandas())
    want = recommend.ranked(ease.model_scores(asked, b), 4, asked).select("user_id", "item_id", "rank", F.round("score", 9)).collect()
    got = ease.best_scores(model, asked, b, 4, 6).select("user_id", "item_id", "rank", F.round("score", 9)).collect()
    assert len(want) > 230 and sorted(got) == sorted(want) and model.kept.select("c").distinct().count() == 3
