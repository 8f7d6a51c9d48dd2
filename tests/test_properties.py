"""Properties of fits, selections and synthetic tables."""

import math

import pytest
from pyspark.sql import functions as F

from catalog.base import ITEM_DOMAIN, ITEM_RULE, ORDER_DOMAIN, ORDER_RULE, items, orders
from margrid.domain import Constraint, Domain, validate_domain
from margrid.operators import ci as C
from margrid.operators import distance as D
from margrid.operators import encode as E
from margrid.operators import factors as K
from margrid.operators import fit as T
from margrid.operators import marginals as M
from margrid.operators import noise as G
from margrid.operators import repair as R
from margrid.operators import select as S
from margrid.plans import sampling as N
from margrid.plans import synthesis as Y

TOY = Domain.of({"a": 2, "b": 3, "c": 4, "d": 5})


@pytest.fixture(scope="module")
def toy(spark):
    """A chain a-b-c-d on 2x3x4x5 codes."""
    i = F.col("id")
    a = (i % 2).cast("int")
    b = ((i % 7 + a) % 3).cast("int")
    c = ((i % 11 + b) % 4).cast("int")
    return spark.range(3000).select("id", a.alias("a"), b.alias("b"), c.alias("c"), ((i % 13 + c) % 5).cast("int").alias("d")).cache()


def _value(df, col=0):
    return df.first()[col]


# ---------------------------------------------------------------- domains and marginals


def test_domain_rules():
    with pytest.raises(ValueError):
        Domain(("a", "a"), (2, 2))
    with pytest.raises(ValueError):
        TOY.guard(max_cells=10)
    assert TOY.size() == 120 and TOY.strides(("a", "c", "d")) == [("a", 20), ("c", 5), ("d", 1)]


def test_cell_numbers_round_trip(toy):
    rows = toy.select(*TOY.attrs, TOY.cell(TOY.attrs).alias("cell"))
    back = rows.select(*[F.col(a).alias(f"x_{a}") for a in TOY.attrs], *TOY.decode(TOY.attrs))
    assert back.where(" or ".join(f"x_{a} <> {a}" for a in TOY.attrs)).count() == 0


def test_metadata_round_trip(toy):
    assert Domain.from_metadata(TOY.annotate(toy)) == TOY


def test_marginals_sum_to_rows(toy):
    m = M.all_marginals(toy, TOY, 2)
    sums = {r["clique"]: r["s"] for r in m.groupBy("clique").agg(F.sum("value").alias("s")).collect()}
    assert len(sums) == 6 and set(sums.values()) == {3000.0}
    assert m.count() == sum(TOY.size(c) for c in M.workload(TOY, 2))


def test_large_joint_counts_rows_directly(toy, monkeypatch):
    want = M.clique_marginals(toy, TOY, [("a", "d"), ("b",)]).collect()
    monkeypatch.setattr(M, "MAX_JOINT", 1)
    got = M.clique_marginals(toy, TOY, [("a", "d"), ("b",)]).collect()
    assert sorted(got) == sorted(want)


def test_out_of_domain_rows(toy):
    small = Domain.of({"a": 2, "d": 3})
    bad = {r["attr"]: r["bad_rows"] for r in validate_domain(toy, small).collect()}
    assert bad["a"] == 0 and bad["d"] == toy.where("d > 2").count()
    assert _value(M.marginal(toy, small, ["a", "d"]).agg(F.sum("value"))) == toy.where("d <= 2").count()


# ---------------------------------------------------------------- elimination against the full joint


def _edges(toy):
    count = lambda x, y: toy.groupBy(x, y).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return [(count("a", "b"), ("a", "b")), (count("b", "c"), ("b", "c")), (count("c", "d"), ("c", "d"))]


@pytest.mark.parametrize("keep", [("a", "d"), ("a", "c"), ("d",), ("b", "d")])
def test_elimination_equals_brute_force(toy, keep):
    got = K.query_unmeasured_marginal(_edges(toy), keep, TOY)
    want = K.factor_project(K.full_joint(_edges(toy), TOY), list(keep)).withColumnRenamed("value", "want")
    both = got.join(want, list(keep))
    assert both.count() == got.count()
    assert both.where(F.abs(F.col("value") - F.col("want")) > 1e-6).count() == 0


# ---------------------------------------------------------------- independence


def test_projection_removes_dependence(spark, sf):
    df = items(spark, sf)
    fixed = R.ci_projection(df, ITEM_RULE)
    assert _value(C.cmi_plain(fixed, ITEM_RULE, weight="value")) == pytest.approx(0, abs=1e-9)
    weighted = R.repair_weights(df, ITEM_RULE)
    assert _value(C.cmi_plain(weighted, ITEM_RULE, weight="repaired_weights")) == pytest.approx(0, abs=1e-9)


def test_three_forms_of_the_measure_agree(spark, sf):
    df = items(spark, sf)
    a = _value(C.cmi(df, ITEM_RULE))
    b = _value(C.cmi_plain(df, ITEM_RULE))
    c = _value(C.cmi_entropy(df, ITEM_RULE), "cmi")
    assert a >= 0 and a == pytest.approx(b, abs=1e-8) == pytest.approx(c, abs=1e-8)


def test_no_conditioning_columns(spark, sf):
    rule = Constraint.of("flag", "status")
    assert _value(C.cmi_plain(items(spark, sf), rule)) >= 0


def test_permuted_rows_keep_margins(spark, sf):
    o = orders(spark, sf).select("id", "status", "prio", "yr")
    p = C.permute_within_strata(o, ["prio"], ["yr"], "id", "t")
    assert p.count() == o.count()
    same = lambda d, *c: {tuple(r) for r in d.groupBy(*c).count().collect()}
    assert same(p, "yr", "prio") == same(o, "yr", "prio") and same(p, "yr", "status") == same(o, "yr", "status")


def test_permutation_p_values(spark):
    """Independent columns are not rejected, a copied column is."""
    df = spark.range(2000).select((F.col("id") % 3).alias("x"), (F.floor(F.col("id") / 6) % 2).alias("y"), (F.col("id") % 2).alias("z"))
    row = C.permutation_test(df, Constraint.of("x", "y", "z"), 60, "p").first()
    assert row["p_value"] > 0.05 and row["null_min"] <= row["null_mean"] <= row["null_max"]
    copied = df.withColumn("y", F.col("x"))
    assert C.permutation_test(copied, Constraint.of("x", "y", "z"), 60, "p").first()["p_value"] == pytest.approx(1 / 61)


# ---------------------------------------------------------------- distances


def test_distance_bounds(spark, sf):
    df = items(spark, sf)
    cols = list(ITEM_DOMAIN.attrs)
    same = D.pair_of(df, df, cols)
    assert _value(D.tvd(same)) == 0 and _value(D.kl(same)) == 0
    apart = D.pair_of(df.where("flag = 0"), df.where("flag = 1"), cols)
    assert _value(D.tvd(apart)) == pytest.approx(1.0)
    assert _value(D.wasserstein_1d(df, df, ["qty"]), "w1") == 0


def test_sinkhorn_meets_its_margins(spark):
    """Two points far apart: all mass has to travel the whole (scaled) way."""
    d = Domain.of({"v": 3})
    pq = spark.createDataFrame([(0, 1.0, 0.0), (2, 0.0, 1.0)], "v int, p double, q double")
    assert _value(D.sinkhorn(pq, d, max_rounds=200)) == pytest.approx(1.0, abs=1e-3)


# ---------------------------------------------------------------- fits


def test_ipf_meets_margins(toy):
    table = toy.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("value"))
    ta = toy.sparkSession.createDataFrame([(0, 30.0), (1, 70.0)], "a int, target double")
    tb = toy.sparkSession.createDataFrame([(0, 20.0), (1, 30.0), (2, 50.0)], "b int, target double")
    fitted = T.ipf(table, [ta, tb], 8)
    for keys, target in ((["a"], ta), (["b"], tb)):
        sums = K.factor_project(fitted, keys).join(target, keys)
        assert sums.where(F.abs(F.col("value") - F.col("target")) > 1e-4).count() == 0


def test_tree_without_noise_is_exact(toy):
    edges = [("a", "b"), ("b", "c"), ("c", "d")]
    model = Y.exact_tree(toy, TOY, edges)
    want = S.pair_counts(toy, TOY, edges)
    both = model.pairs.join(want, ["a", "b", "ca", "cb"], "left")
    assert both.where(F.abs(F.col("value") - F.coalesce("n", F.lit(0.0))) > 1e-6).count() == 0


@pytest.mark.parametrize("method", ["sample", "round"])
def test_tree_samples_follow_the_tree(toy, method):
    model = Y.exact_tree(toy, TOY, [("a", "b"), ("b", "c"), ("c", "d")])
    rows = N.sample_tree(model, 3000, "t", method)
    assert rows.count() == 3000 and rows.dropna().count() == 3000
    error = _value(D.mean_error(D.workload_error(toy, rows, TOY, [("a", "b"), ("b", "c"), ("c", "d")])))
    assert error < (0.002 if method == "round" else 0.06)


def test_multiplicative_weights_reduce_the_error(toy):
    cliques = [("a", "b"), ("b", "c"), ("d",)]
    m = G.gaussian_measure(M.clique_marginals(toy, TOY, cliques), 1.0, {"a,b": 1.0, "b,c": 1.0, "d": 1.0}, "t")
    loss = []
    for rounds in (1, 6):
        state = T.multiplicative_weights(m, TOY, cliques, 3000.0, rounds)
        assert {round(r["s"], 9) for r in state.groupBy("grp").agg(F.sum("value").alias("s")).collect()} == {1.0}
        model = Y.GroupedModel(TOY, T.connected_groups(cliques, TOY), state, 3000.0)
        loss.append(_value(D.measurement_loss(model.answers(toy.sparkSession, cliques), m)))
    assert loss[1] < loss[0]


def test_reweighting_reduces_the_error(toy):
    cliques = [("a", "b"), ("c",)]
    m = G.gaussian_measure(M.clique_marginals(toy, TOY, cliques), 1.0, {"a,b": 1.0, "c": 1.0}, "t")
    out = T.reweight_public(toy.where("id % 3 = 0"), TOY, m, cliques, 3000.0, 6)
    assert _value(out.agg(F.sum("weight"))) == pytest.approx(3000.0, rel=1e-6)
    after = M.clique_sums(out, TOY, cliques, "weight")
    before = M.clique_sums(out.withColumn("w", F.col("n") * 3), TOY, cliques, "w")
    assert _value(D.measurement_loss(after, m)) < _value(D.measurement_loss(before, m))


def test_counting_numbers():
    numbers = T.counting_numbers([("a", "b"), ("b", "c"), ("c", "d")], TOY)
    assert numbers == {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("b",): -1, ("c",): -1}
    assert T.connected_groups([("a", "b"), ("c",), ("b", "d")], TOY) == [("c",), ("a", "b", "d")]


# ---------------------------------------------------------------- trees of attributes


def test_forest_path_rule():
    f = S.Forest(["p", "z", "w", "y"], [("p", "w")])
    assert f.leaks(("w", "y"), ["p"], ["y"], ["z"])
    assert not f.leaks(("z", "y"), ["p"], ["y"], ["z"])
    assert S.Forest(["p", "z", "y"], [("p", "z")]).leaks(("z", "y"), ["p"], ["y"], ["z"]) is False


def test_selected_trees_span(toy):
    ones = S.single_counts(toy, TOY).withColumnRenamed("n", "value")
    scores = S.pair_scores(S.pair_counts(toy, TOY), ones)
    edges = S.select_tree(scores, TOY, 1.0, "t")
    assert len(edges) == 3 and S.Forest(TOY.attrs, edges).components() == 1
    given = S.select_tree(scores, TOY, 1.0, "t", given=[("a", "d")])
    assert ("a", "d") in given and len(given) == 3
    hard = S.select_tree_hard_constraint(scores, TOY, ["a"], ["d"], ["c"])
    free = S.Forest(["a", "b", "d"], [e for e in hard if "c" not in e])
    assert free.label["a"] != free.label["d"]
    fair = S.select_tree_fair_greedy(scores, TOY, ["d"], ["c"])
    assert all(not ("d" in e and "c" not in e) for e in fair)


def test_strong_budget_picks_the_largest_edges(toy):
    ones = S.single_counts(toy, TOY).withColumnRenamed("n", "value")
    scores = S.pair_scores(S.pair_counts(toy, TOY), ones)
    assert sorted(S.select_tree(scores, TOY, 1e9, "t")) == sorted(S.select_tree_fair_greedy(scores, TOY, [], TOY.attrs))


# ---------------------------------------------------------------- encoders and releases


def test_folds_partition_the_rows(spark, sf):
    o = orders(spark, sf)
    folded = G.stratified_kfold(o, "status", "id", 5, "t")
    assert folded.count() == o.count()
    sizes = [r["count"] for r in folded.groupBy("status", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= max(2, 0.2 * max(sizes))
    per = folded.groupBy("status").pivot("fold").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in per)


def test_compression_keeps_supported_codes(spark, sf):
    o = orders(spark, sf).withColumn("price", F.when(F.col("id") % 97 == 0, 4).otherwise(F.least("price", F.lit(1))))
    ones = Y.measure_ones(M.joint_counts(o, ORDER_DOMAIN), ORDER_DOMAIN, 5.0, "t")
    packed = Y.compress_domain(ones, ORDER_DOMAIN)
    assert packed.small["price"] < ORDER_DOMAIN["price"]
    back = packed.restore(packed.apply(o), "id", "t")
    kept = back.join(o.select("id", F.col("price").alias("old")), "id").where("old < 2")
    assert kept.where("price <> old").count() == 0


def test_scaling_round_trip(spark, sf):
    t = items(spark, sf).select("weight", "line")
    back = E.unscale(E.scale_by_std(t, ["weight", "line"]), t, ["weight", "line"])
    assert back.select("weight", "line").exceptAll(t.select("weight", F.col("line").cast("double"))).count() == 0


def test_release_spends_its_budget(spark, sf):
    release = Y.tree_release(orders(spark, sf), ORDER_DOMAIN, 1.0, 1e-9, "t")
    assert release.rho == pytest.approx(G.zcdp_rho(1.0, 1e-9))
    assert len(release.model.edges) == len(ORDER_DOMAIN.attrs) - 1


def test_blending_lowers_dependence(toy):
    """The dependence of the blended table falls with the strength and ends at 0."""
    rule = Constraint.of("b", "d", "a")
    joint = toy.groupBy("a", "b", "d").agg(F.count(F.lit(1)).cast("double").alias("value"))
    values = [
        _value(C.cmi_plain(T.blend_ci(joint, rule.x, rule.y, rule.z, s), rule, weight="value")) for s in (0.0, 0.5, 1.0)
    ]
    assert values[0] > values[1] > values[2] and values[2] == pytest.approx(0, abs=1e-9)


def test_blended_release_keeps_domain_and_rows(spark, sf):
    rows = Y.ci_blend_synthesize(orders(spark, sf), ORDER_DOMAIN, ORDER_RULE, 10.0, 1e-9, 1.0, "t", n=4000)
    assert rows.count() == 4000
    bad = validate_domain(rows, ORDER_DOMAIN).agg(F.sum("bad_rows")).first()[0]
    assert bad == 0


def test_satisfied_rule_keeps_every_edge(spark):
    """x and y independent, w = 2x + y: the constraint's columns are drawn first and no edge is lost."""
    i = F.col("id")
    code = lambda c: c.cast("int")
    df = spark.range(8000).select(
        "id", code(i % 2).alias("x"), code(F.floor(i / 2) % 2).alias("y"), code(F.floor(i / 4) % 3).alias("z")
    ).withColumn("w", F.col("x") * 2 + F.col("y"))
    domain = Domain.of({"x": 2, "y": 2, "z": 3, "w": 4})
    for strength in (0.0, 1.0):
        rows = Y.ci_blend_synthesize(df, domain, Constraint.of("x", "y", "z"), 1000.0, 1e-9, strength, "t")
        assert rows.where("w <> 2 * x + y").count() < 0.01 * rows.count()
        assert _value(D.mean_error(D.workload_error(df, rows, domain, [("x", "w"), ("y", "w")]))) < 0.05


def test_drawn_attributes_bound_the_next_one(spark):
    """Between two drawn ends of a chain, the middle follows P(b, c | a, d)."""
    df = spark.range(16_000).select(
        "id", (F.col("id") % 2).cast("int").alias("a"), (F.floor(F.col("id") / 2) % 4).cast("int").alias("k")
    )
    df = df.withColumn("b", F.when(F.col("k") == 0, 1 - F.col("a")).otherwise(F.col("a")))
    df = df.withColumn("c", F.col("b")).withColumn("d", F.col("c")).drop("k")
    domain = Domain.of({"a": 2, "b": 2, "c": 2, "d": 2})
    model = Y.exact_tree(df, domain, [("a", "b"), ("b", "c"), ("c", "d")])
    rows = N.sample_tree(model, 16_000, "t", start=df.select("id", "a", "d"))
    assert rows.where("b <> d or c <> d").count() == 0


def test_private_parents_follow_a_large_budget(toy):
    want = Y.greedy_parents(toy, TOY)
    assert Y.greedy_parents(toy, TOY, 1e7, "t") == want
    loose = {tuple(Y.greedy_parents(toy, TOY, 1e-6, f"t{i}")) for i in range(6)}
    assert len(loose) > 1 and all(len(n) == 4 for n in loose)


def test_precise_measurements_pull_harder(toy):
    """Two contradicting answers pull to shares 0.97 and 0.03; alike they would meet at a half."""
    rows = [("a", 0, 2900.0, 1.0), ("a", 1, 100.0, 1.0), ("a,b", 0, 100.0, 50.0), ("a,b", 5, 2900.0, 50.0)]
    rows += [("a,b", c, 0.0, 50.0) for c in range(1, 5)]
    m = toy.sparkSession.createDataFrame(rows, "clique string, cell long, noisy double, stddev double")
    state = T.multiplicative_weights(m, TOY, [("a",), ("a", "b")], 3000.0, 8)
    table = T.group_table(state, TOY, ("a", "b")).groupBy("a").agg(F.sum("value").alias("p"))
    assert {r["a"]: r["p"] for r in table.collect()}[0] > 0.8


def test_kernel_distance_takes_any_domain(spark):
    """Three cells in a domain of 64 million: the work follows the support."""
    d = Domain.of({"a": 400, "b": 400, "c": 400})
    pq = spark.createDataFrame(
        [(0, 0, 0, 0.5, 0.0), (1, 0, 0, 0.5, 0.2), (399, 5, 2, 0.0, 0.8)], "a int, b int, c int, p double, q double"
    )
    want = math.sqrt(0.5**2 + 0.3**2 + 0.8**2 + 2 * 0.5 * 0.3 * math.exp(-1))
    assert _value(D.mmd_rbf(pq, d)) == pytest.approx(want, abs=1e-9)


def test_overlaps_agree_after_averaging(toy):
    cliques = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    noisy = Y.answer_workload_gaussian(toy, TOY, cliques, 1.0, 1e-9, "t")
    agreed = Y.average_overlaps(noisy, TOY, cliques)
    assert D.marginal_consistency(agreed, TOY, cliques).agg(F.max("disagreement")).first()[0] < 1e-6


def test_missing_share_is_exact(spark, sf):
    o = orders(spark, sf).select("id", "prio")
    gone = G.inject_missing(o, "prio", "id", 0.25, "t").where("prio is null").count()
    assert gone == math.floor(o.count() * 0.25)


def test_checkpoints_use_the_cluster_folder(spark):
    from margrid.session import cut, ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    where = spark.sparkContext.getCheckpointDir()
    assert where
    cut(spark.range(3))
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == where
