"""Regressions against explicit numpy solutions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.stats import distributions as dist
from panelspark.stats import tables
from panelspark.stats.absorb import absorb, absorb_in_turns
from panelspark.stats.effect_graph import parts
from panelspark.stats.event_study import event_study
from panelspark.stats.many import Model, wls_many
from panelspark.stats.terms import expand_terms
from panelspark.stats import wls as plain
from panelspark.stats.grouped import grouped_wls
from panelspark.stats.wls import coefficient_table, joint_test, stat_table, wls


def make(seed=0, n=400, regions=5, days=40):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"region": rng.integers(0, regions, n), "day": rng.integers(0, days, n)})
    pdf["x"] = rng.normal(size=n) + pdf.region
    pdf["z"] = rng.normal(size=n) * 10
    pdf["w"] = rng.integers(1, 5, n).astype(float)
    pdf["y"] = 2 + 3 * pdf.x - 0.1 * pdf.z + pdf.region**2 + 0.05 * pdf.day + rng.normal(size=n)
    return pdf


def dense(x, y, w, groups=None, k_extra=0):
    """WLS with weights summing to n, by lstsq; classic or cluster-robust covariance."""
    n = len(y)
    w = w * n / w.sum()
    gram = x.T @ (x * w[:, None])
    inverse = np.linalg.pinv(gram)
    b = inverse @ (x.T @ (w * y))
    e = y - x @ b
    k = np.linalg.matrix_rank(x) + k_extra
    if groups is None:
        return b, inverse * (w * e * e).sum() / (n - k)
    labels = np.unique(groups)
    scores = np.array([(x * (w * e)[:, None])[groups == g].sum(axis=0) for g in labels])
    factor = len(labels) / (len(labels) - 1) * (n - 1) / (n - k)
    return b, factor * inverse @ scores.T @ scores @ inverse


def test_terms():
    assert [t.name for t in expand_terms("a*b*c")] == ["a", "b", "c", "a#b", "a#c", "b#c", "a#b#c"]
    assert [t.name for t in expand_terms("x + x^2 + a:b + b:a")] == ["x", "x#x", "a#b"]
    assert expand_terms("") == []


@pytest.mark.parametrize("wide", [0, 1000])
@pytest.mark.parametrize("cluster", [None, "region"])
def test_wls_equals_numpy(spark, cluster, wide):
    pdf = make()
    fit = wls(spark.createDataFrame(pdf), "y", "x + z + z^2", "w", cluster, wide=wide)
    x = np.column_stack([pdf.x, pdf.z, pdf.z**2, np.ones(len(pdf))])
    b, v = dense(x, pdf.y.to_numpy(), pdf.w.to_numpy(), pdf.region.to_numpy() if cluster else None)
    np.testing.assert_allclose(fit.coef, b, rtol=1e-9)
    np.testing.assert_allclose(fit.cov, v, rtol=1e-7)
    assert fit.df_resid == (4 if cluster else len(pdf) - 4)


def test_wls_statistics(spark):
    pdf = make()
    fit = wls(spark.createDataFrame(pdf), "y", "x + z", "w")
    x = np.column_stack([pdf.x, pdf.z, np.ones(len(pdf))])
    b, _ = dense(x, pdf.y.to_numpy(), pdf.w.to_numpy())
    w = pdf.w * len(pdf) / pdf.w.sum()
    rss = (w * (pdf.y - x @ b) ** 2).sum()
    tss = (w * (pdf.y - np.average(pdf.y, weights=w)) ** 2).sum()
    assert fit.stats["r2"] == pytest.approx(1 - rss / tss)
    assert fit.stats["r2_a"] == pytest.approx(1 - (rss / (len(pdf) - 3)) / (tss / (len(pdf) - 1)))
    assert fit.stats["rmse"] == pytest.approx(math.sqrt(rss / (len(pdf) - 3)))


def test_rows_with_missing_values_or_no_weight_drop_out(spark):
    pdf = make()
    df = spark.createDataFrame(pdf)
    broken = df.withColumn("x", F.when(F.col("z") > 0, F.col("x"))).withColumn("w", F.when(F.col("day") > 5, F.col("w")).otherwise(0.0))
    kept = pdf[(pdf.z > 0) & (pdf.day > 5)]  # x is missing elsewhere
    assert wls(broken, "y", "x", "w").stats["n"] == len(kept)


def test_collinear_terms_are_left_out(spark):
    df = spark.createDataFrame(make()).withColumn("x2", F.col("x") * 2)
    fit = wls(df, "y", "x + x2 + z", "w")
    assert math.isnan(fit.coef[1]) and not math.isnan(fit.coef[0])
    np.testing.assert_allclose(fit.coef[0], wls(df, "y", "x + z", "w").coef[0], rtol=1e-8)


def test_grouped_fits_equal_separate_ones(spark):
    pdf = make()
    fits = wls(spark.createDataFrame(pdf), "y", "x", "w", by=["region"])
    for (region,), fit in fits.items():
        part = pdf[pdf.region == region]
        b, _ = dense(np.column_stack([part.x, np.ones(len(part))]), part.y.to_numpy(), part.w.to_numpy())
        np.testing.assert_allclose(fit.coef, b, rtol=1e-8)


@pytest.mark.parametrize("broadcast", [True, False])
def test_models_of_groups_on_the_executors(spark, monkeypatch, broadcast):
    monkeypatch.setattr("panelspark.stats.grouped.fits_broadcast", lambda df: broadcast)
    pdf = make().assign(x=lambda d: d.x + 1e6)
    df = spark.createDataFrame(pdf).withColumn("x2", F.col("x") * 2)
    df = df.withColumn("region", F.when(F.col("region") != pdf.region.iloc[0], F.col("region")))
    rows = grouped_wls(df, "y", "x + x2 + z", ["region"], "w").collect()
    for key in {r.region for r in rows}:
        part = df.where(F.col("region").eqNullSafe(F.lit(key)))
        fit = wls(part, "y", "x + x2 + z", "w")
        own = {r.term: r for r in rows if r.region == key}
        assert own["x2"].coef is None and own["x2"].se is None
        for name, b, se in zip(fit.names, fit.coef, fit.se):
            if name != "x2":
                assert own[name].coef == pytest.approx(b, rel=1e-6) and own[name].se == pytest.approx(se, rel=1e-6)
                assert own[name].ci_low < own[name].coef < own[name].ci_high
        assert (own["x"].n, own["x"].df_resid) == (fit.stats["n"], fit.df_resid)
        assert own["x"].r2 == pytest.approx(fit.stats["r2"]) and own["x"].rmse == pytest.approx(fit.stats["rmse"])


def test_groups_too_small_to_fit(spark):
    rows = [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 4.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.g, r.term): r for r in grouped_wls(df, "y", "x", ["g"]).collect()}
    assert {g for g, _ in got} == {"one", "two", "flat"}
    assert got["one", "x"].coef is None and got["one", "_cons"].coef == 2 and got["one", "_cons"].se is None
    assert got["two", "x"].coef == pytest.approx(2) and got["two", "x"].se is None
    assert got["flat", "x"].coef is None and got["flat", "_cons"].coef == pytest.approx(1.5)
    assert grouped_wls(df.limit(0), "y", "x", ["g"]).count() == 0


def test_many_groups_do_not_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(plain, "FEW_GROUPS", 2)
    with pytest.raises(ValueError, match="grouped_wls"):
        wls(spark.createDataFrame(make()), "y", "x", "w", by=["region"])


def test_constraints_are_dropped_in_order(spark):
    fit = wls(spark.createDataFrame(make()), "y", "x + z", "w")
    fit.cov = np.array([[2.0, 2.0, 0.0], [2.0, 2.0, 0.0], [0.0, 0.0, 1.0]])
    fit.coef = np.array([3.0, 5.0, 1.0])
    assert joint_test(fit, ["x", "z", "_cons"], dropped=True)["f"] == pytest.approx((9 / 2 + 1) / 2)
    assert joint_test(fit, ["z", "x", "_cons"], dropped=True)["f"] == pytest.approx((25 / 2 + 1) / 2)
    fit.stats["clusters"] = 2
    out = joint_test(fit, ["z", "_cons"], dropped=True)
    assert (out["f"], out["df1"]) == (pytest.approx(25 / 2), 1)


def dummies(values, drop_first=True):
    return pd.get_dummies(values, drop_first=drop_first).to_numpy(float)


@pytest.mark.parametrize("cluster", [None, "region", "z_group"])
def test_absorb_equals_explicit_dummies(spark, cluster):
    pdf = make().assign(z_group=lambda d: (d.z // 5).astype(int) % 6)
    fit = absorb(spark.createDataFrame(pdf), "y", "x + z", ("region", "day"), "w", cluster)
    x = np.column_stack([pdf.x, pdf.z, np.ones(len(pdf)), dummies(pdf.region), dummies(pdf.day)])
    groups = pdf[cluster].to_numpy() if cluster else None
    # an effect nested in the clusters costs no degrees of freedom
    free = -(pdf.region.nunique() - 1) if cluster == "region" else 0
    b, v = dense(x, pdf.y.to_numpy(), pdf.w.to_numpy(), groups, free)
    np.testing.assert_allclose(fit.coef[:2], b[:2], rtol=1e-8)
    np.testing.assert_allclose(fit.cov[:2, :2], v[:2, :2], rtol=1e-6)
    w = pdf.w
    mean = {c: np.average(pdf[c], weights=w) for c in "xyz"}
    assert fit.coef[2] == pytest.approx(mean["y"] - b[0] * mean["x"] - b[1] * mean["z"])


def test_absorb_r2(spark):
    pdf = make()
    fit = absorb(spark.createDataFrame(pdf), "y", "x + z", ("day", "region"), "w")
    fe = np.column_stack([np.ones(len(pdf)), dummies(pdf.region), dummies(pdf.day)])
    x = np.column_stack([pdf.x, pdf.z, fe])
    w, y = pdf.w.to_numpy(), pdf.y.to_numpy()

    def rss(m):
        b, _ = dense(m, y, w)
        return (w * (y - m @ b) ** 2).sum()

    tss = (w * (y - np.average(y, weights=w)) ** 2).sum()
    assert fit.stats["r2"] == pytest.approx(1 - rss(x) / tss)
    assert fit.stats["r2_within"] == pytest.approx(1 - rss(x) / rss(fe))


def test_absorb_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(make())
    first = absorb(df.repartition(1), "y", "x", ("region", "day"), "w", "region")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        second = absorb(df.repartition(9), "y", "x", ("region", "day"), "w", "region")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    np.testing.assert_allclose(first.coef, second.coef, rtol=1e-10)
    np.testing.assert_allclose(first.cov, second.cov, rtol=1e-7)


def test_absorb_in_turns_agrees(spark):
    df = spark.createDataFrame(make(n=300))
    exact = absorb(df, "y", "x + z", ("region", "day"), "w", "z")
    turns = absorb(df, "y", "x + z", ("region", "day"), "w", max_levels=2)
    np.testing.assert_allclose(turns.coef, exact.coef, rtol=1e-6)
    plain = absorb(df, "y", "x + z", ("region", "day"), "w")
    np.testing.assert_allclose(turns.se[:2], plain.se[:2], rtol=1e-5)


def event_panel():
    pdf = make(3, 600, 4, 30)
    pdf["days"] = pdf.day - 15
    pdf["time"] = np.where(pdf.region > 0, pdf.days, np.nan)
    return pdf


def test_event_study_equals_explicit_dummies(spark):
    pdf = event_panel()
    df = spark.createDataFrame(pdf)
    fit = event_study(df, "y", "x", F.when(F.col("region") > 0, F.col("days")), ("region", "day"), "w", "region")
    times = sorted(t for t in pdf.time.dropna().unique() if t != -1)
    events = np.column_stack([(pdf.time == t).to_numpy(float) for t in times])
    x = np.column_stack([pdf.x, events, np.ones(len(pdf)), dummies(pdf.region), dummies(pdf.day)])
    b, v = dense(x, pdf.y.to_numpy(), pdf.w.to_numpy(), pdf.region.to_numpy(), -(4 - 1))
    k = 1 + len(times)
    assert fit.names[1] == "lead15" and "lead1" not in fit.names and "lag0" in fit.names
    np.testing.assert_allclose(fit.coef[:k], b[:k], rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(fit.cov[:k, :k], v[:k, :k], rtol=1e-4, atol=1e-8)
    # four clusters leave three directions to test
    assert (fit.stats["leads_df1"], fit.stats["leads_df2"]) == (3, 3)
    at = list(range(1, 15))
    sub = v[np.ix_(at, at)]
    values, vectors = np.linalg.eigh(sub)
    top = np.argsort(values)[::-1][:3]
    want = ((vectors[:, top].T @ b[at]) ** 2 / values[top]).sum() / 3
    assert fit.stats["leads_f"] == pytest.approx(want, rel=1e-3)


def test_joint_test_full_rank(spark):
    pdf = make()
    fit = wls(spark.createDataFrame(pdf), "y", "x + z", "w")
    out = joint_test(fit, ["x", "z"])
    b, v = fit.coef[:2], fit.cov[:2, :2]
    assert out["f"] == pytest.approx(b @ np.linalg.inv(v) @ b / 2)
    assert out["df1"] == 2 and 0 <= out["p"] < 1e-6


def test_tail_probabilities():
    # textbook values
    assert dist.t_two_sided(2.776, 4) == pytest.approx(0.05, abs=2e-4)
    assert dist.t_two_sided(0, 7) == pytest.approx(1)
    assert dist.f_upper(6.388, 4, 4) == pytest.approx(0.05, abs=2e-4)
    assert dist.f_upper(11.9827, 4, 4) == pytest.approx(0.0169, abs=1e-4)
    assert dist.f_upper(4.8427, 4, 4) == pytest.approx(0.0779, abs=1e-4)
    assert dist.t_quantile(0.95, 4) == pytest.approx(2.776445, abs=1e-5)


def test_result_tables(spark):
    pdf = make()
    df = spark.createDataFrame(pdf)
    fits = {"a": wls(df, "y", "x", "w"), "b": wls(df, "y", "x + z", "w")}
    assert coefficient_table(spark, fits).count() == 5
    assert stat_table(spark, fits).where("stat = 'r2'").count() == 2
    wide = {r["row"]: r for r in tables.model_table(spark, fits).collect()}
    assert wide["z"]["a"] is None and "***" in wide["x"]["b"]
    marks = spark.createDataFrame([(p,) for p in (0.0005, 0.005, 0.03, 0.2, None)], "p double")
    assert [r[0] for r in marks.select(tables.stars("p")).collect()] == ["***", "**", "*", "", ""]


@pytest.mark.parametrize("cluster", [None, "g", "many"])
def test_both_routes_of_absorb_agree(spark, cluster):
    rng = np.random.default_rng(11)
    n = 3000
    a, b = rng.integers(0, 60, n), rng.integers(0, 25, n)
    x = rng.normal(size=n) + a / 20
    pdf = pd.DataFrame({"a": a, "b": b, "x": x, "g": a // 4, "many": np.arange(n) // 2, "w": rng.uniform(0.5, 2, n)})
    pdf["y"] = 2 * x + a / 7 - b / 5 + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    one = absorb(df, "y", "x", ("a", "b"), "w", cluster)
    other = absorb(df, "y", "x", ("a", "b"), "w", cluster, max_levels=10)
    np.testing.assert_allclose(one.coef, other.coef, rtol=1e-6)
    np.testing.assert_allclose(one.se, other.se, rtol=1e-6)
    assert one.df_resid == other.df_resid and set(one.stats) == set(other.stats)
    for name, value in one.stats.items():
        np.testing.assert_allclose(value, other.stats[name], rtol=1e-6, err_msg=name)


def test_more_clusters_than_levels_may_be(spark):
    rng = np.random.default_rng(12)
    n = 6000
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n), "b": rng.integers(0, 8, n), "x": rng.normal(size=n), "c": np.arange(n) // 2})
    pdf["y"] = pdf.x + rng.normal(size=n)
    fit = absorb(spark.createDataFrame(pdf), "y", "x", ("a", "b"), cluster="c", max_levels=50)
    assert fit.stats["clusters"] == 3000 and fit.df_resid == 2999 and 0 < fit.se[0] < 1


def test_regressors_far_from_zero_keep_the_constant(spark):
    rng = np.random.default_rng(13)
    x = 1e7 + rng.normal(size=4000)
    y = 3 + 2 * (x - 1e7) + rng.normal(size=4000)
    fit = wls(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "g": np.arange(4000) % 50})), "y", "x", cluster="g")
    slope, constant = np.polyfit(x - 1e7, y, 1)
    assert fit.coef[0] == pytest.approx(slope, rel=1e-9)
    assert fit.coef[1] == pytest.approx(constant - slope * 1e7, rel=1e-9)


def in_parts(n=1600, parts=4, levels=48, seed=21):
    """Two effects that fall into parts, with controls, event time and weights."""
    rng = np.random.default_rng(seed)
    part = rng.integers(0, parts, n)
    each = levels // parts
    a, b = part * each + rng.integers(0, each, n), part * each + rng.integers(0, each, n)
    pdf = pd.DataFrame({"a": a, "b": b, "x": rng.normal(size=n) + a / 9, "z": rng.normal(size=n) - b / 7, "w": rng.uniform(0.5, 2, n), "g": a % 13, "h": np.arange(n) % 17})
    pdf["time"] = np.where(rng.random(n) < 0.5, rng.integers(-2, 3, n), np.nan)
    pdf["y"] = 2 * pdf.x - pdf.z + a / 3 - b / 5 + pdf.time.fillna(0) + rng.normal(size=n)
    return pdf


@pytest.mark.parametrize("event,cluster", [(False, None), (True, "g"), (True, "h")])
def test_graph_route_equals_explicit_dummies_on_effects_in_parts(spark, event, cluster):
    pdf = in_parts()
    df = spark.createDataFrame(pdf).withColumn("t", F.when(~F.isnan("time"), F.col("time")).cast("int"))
    fits = [absorb(df, "y", "x + z", ("a", "b"), "w", cluster, event="t" if event else None, max_levels=m) for m in (2000, 5)]
    times = [-2, 0, 1, 2] if event else []
    shown = np.column_stack([pdf.x, pdf.z, *[(pdf.time == t).to_numpy(float) for t in times]])
    whole = np.column_stack([shown, dummies(pdf.a, False), dummies(pdf.b, False)])
    w = pdf.w.to_numpy() * len(pdf) / pdf.w.sum()
    inverse = np.linalg.pinv(whole.T @ (whole * w[:, None]))
    coef = inverse @ whole.T @ (w * pdf.y.to_numpy())
    e = pdf.y.to_numpy() - whole @ coef
    k, rank, n = shown.shape[1], np.linalg.matrix_rank(whole), len(pdf)
    absorbed = rank - k - 1
    if cluster == "g":  # every level of a lies in one
        absorbed -= pdf.a.nunique() - 1
    if cluster:
        score = pd.DataFrame(whole * (w * e)[:, None]).groupby(pdf[cluster]).sum().to_numpy()
        groups = len(score)
        cov = groups / (groups - 1) * (n - 1) / (n - k - 1 - absorbed) * inverse @ score.T @ score @ inverse
    else:
        cov = inverse * (w * e * e).sum() / (n - rank)
    for fit in fits:
        np.testing.assert_allclose(fit.coef[:k], coef[:k], rtol=1e-8)
        np.testing.assert_allclose(fit.se[:k], np.sqrt(np.diag(cov))[:k], rtol=1e-7)
        assert fit.stats["absorbed"] == absorbed
    one, other = fits
    assert one.names == other.names and one.df_resid == other.df_resid and set(one.stats) == set(other.stats)
    np.testing.assert_allclose(other.cov, one.cov, rtol=1e-6, atol=1e-12)
    for name, value in one.stats.items():
        np.testing.assert_allclose(other.stats[name], value, rtol=1e-8, err_msg=name)


def test_parts_of_chains_stars_and_pairs(spark):
    chain = [(i // 2, (i + 1) // 2) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(50)]
    pairs = [(2000 + i, 2000 + i) for i in range(7)]
    assert parts(spark.createDataFrame(chain + star + pairs + star, "_big int, _small int")) == 9
    assert parts(spark.createDataFrame([], "_big int, _small int")) == 0


def test_a_regressor_the_effects_explain_is_left_out_on_both_routes(spark):
    pdf = in_parts(600).assign(u=lambda d: d.a * 2.0 + d.b, g=1)
    df = spark.createDataFrame(pdf)
    for limit in (2000, 5):
        fit = absorb(df, "y", "x + u", ("a", "b"), "w", max_levels=limit)
        assert math.isnan(fit.coef[1]) and fit.stats["df_m"] == 1
        plain = absorb(df, "y", "x", ("a", "b"), "w", max_levels=limit)
        assert fit.coef[0] == pytest.approx(plain.coef[0], rel=1e-9) and fit.se[0] == pytest.approx(plain.se[0], rel=1e-9)


@pytest.mark.parametrize("cluster", [None, "region"])
def test_many_models_equal_each_alone(spark, cluster):
    pdf = make(31, 500).assign(far=lambda d: d.z + 1e6, hole=lambda d: d.x.where(d.day % 3 > 0), same=lambda d: d.x * 2)
    df = spark.createDataFrame(pdf).withColumn("hole", F.when(~F.isnan("hole"), F.col("hole")))
    models = {
        "plain": Model("y", "x"),
        "wide": Model("y", "x*z + far + day^2"),
        "hole": Model("y", "x + hole"),
        "late": Model("x", "z + far", "day > 20"),
        "none_missing": Model("hole", "z", "day <= 20 OR hole IS NULL"),
        "same": Model("y", "x + same"),
    }
    got = wls_many(df, models, "w", cluster)
    assert list(got) == list(models)
    for name, model in models.items():
        rows = df if model.sample is None else df.where(model.sample)
        one = wls(rows, model.y, model.formula, "w", cluster)
        assert got[name].names == one.names and got[name].df_resid == one.df_resid
        np.testing.assert_allclose(got[name].coef, one.coef, rtol=1e-7, err_msg=name)
        np.testing.assert_allclose(got[name].se, one.se, rtol=1e-6, err_msg=name)
        for stat, value in one.stats.items():
            assert got[name].stats[stat] == pytest.approx(value, rel=1e-7), (name, stat)
    with pytest.raises(ValueError, match="no complete rows to fit empty"):
        wls_many(df, {"empty": Model("y", "x", "day < 0")}, "w")


def test_turns_work_on_cells_and_graphs_on_few_links(spark, monkeypatch):
    """Rounds never rewrite the rows; a graph of two columns is counted by the links of one of them."""
    from panelspark.stats import absorb as absorb_module
    from panelspark.stats import effect_graph

    df = spark.range(2000).select((F.col("id") % 2).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") ** 2 % 101 + 1e7).alias("x"), (F.col("id") % 3 + 1.0).alias("w"))
    kept, sizes = absorb_module.checkpointed, []
    monkeypatch.setattr(absorb_module, "checkpointed", lambda d: (sizes.append((out := kept(d)).count()), out)[1])
    flat = absorb_module.demean_in_turns(df, ["x"], ("a", "b"), "w")
    assert flat.columns == df.columns and flat.count() == 2000 and max(sizes) <= 14
    for fe in ("a", "b"):
        assert all(abs(r[1]) < 1e-6 for r in flat.groupBy(fe).agg(F.sum(F.col("x") * F.col("w")) / F.sum("w")).collect())

    kept_written, named = effect_graph.written, {}
    monkeypatch.setattr(effect_graph, "written", lambda d, name: (named.setdefault(name, (out := kept_written(d, name)).count()), out)[1])
    cells = spark.range(3000).select(F.col("id").alias("_big"), F.expr("id div 100").alias("_small"))
    cells = cells.unionByName(cells.where("_small % 3 = 0").withColumn("_small", F.col("_small") + 1))
    assert effect_graph.parts(cells) == 20
    assert named["edges"] == 10
    assert effect_graph._Gradients(cells.withColumn("w", F.lit(1.0)), False).product.count() == 50
