"""Known values, invariants and odd inputs of the time-series operators."""

import json
import math
import random

import light_curves as simulate
import pytest
from pyspark.sql import functions as F

from tarnfield.functions import physics
from tarnfield.operators import detectors, domain, evidence, features, inject, metrics, models, ordered, protocol, quality, ranking, resampling
from tarnfield.plans import chain, search, serve
from tarnfield.sources import alerts, tables

OBS = "object_id long, mjd double, passband int, flux double, flux_err double, detected_bool int"


def obs(spark, flux, band=2, err=1.0, det=1, times=None, oid=1):
    return spark.createDataFrame([(oid, float(times[i] if times else i), band, float(f), float(err), det) for i, f in enumerate(flux)], OBS)


def one(df):
    return df.first()


def test_distances_and_magnitudes(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "z double").select(physics.comoving_distance(F.col("z")).alias("d"), physics.distance_modulus(F.col("z")).alias("mu")).collect()
    for r, d, mu in zip(df, (418.5, 1888.6, 3301.0), (38.31, 42.27, 44.09)):
        assert abs(r.d - d) / d < 0.02 and abs(r.mu - mu) < 0.02
    m = spark.createDataFrame([(1.0,), (10.0,), (1000.0,), (0.0,), (-1.0,)], "f double").select(physics.magnitude(F.col("f")).alias("m")).collect()
    assert [r.m and round(r.m, 6) for r in m] == [27.5, 25.0, 20.0, None, None]


def test_galactic_coordinates(spark):
    l, b = physics.galactic(F.col("ra"), F.col("dec"))
    r = spark.createDataFrame([(266.417, -28.983), (10.684, 41.269)], "ra double, dec double").select(l.alias("l"), b.alias("b")).collect()
    assert min(r[0].l, 360 - r[0].l) < 0.1 and abs(r[0].b) < 0.1
    assert abs(r[1].l - 121.2) < 0.3 and abs(r[1].b + 21.6) < 0.3


def test_reliability(spark):
    rows = [(0.0, 0.0, -1), (1.0, 0.9, 0), (0.4, 0.2, 1), (0.5, 0.2, -1)]
    got = [r.r for r in spark.createDataFrame(rows, "z double, e double, f int").select(physics.reliability(F.col("z"), F.col("e"), F.col("f")).alias("r")).collect()]
    assert got[0] == 1 and got[1] < 0.05 and got[2] >= 0.9 and got[3] == 0


def same_time(spark, seed):
    """Thirty observations of one band, time and flux, and a fainter one, in an order by the seed."""
    rows = [(1, 5.0, 2, 9.0, float(e), int(e % 2)) for e in range(1, 31)] + [(1, 7.0, 2, 1.0, 1.0, 1)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, OBS).coalesce(1)


def test_peaks_of_one_time_in_any_order(spark):
    assert {one(features.band_statistics(same_time(spark, seed))).peak_snr for seed in range(4)} == {9.0}


def test_corruptions_of_one_time_in_any_order(spark):
    found = {n: set() for n in inject.INJECTORS}
    for seed in range(4):
        for r in inject.scenarios(same_time(spark, seed), inject.INJECTORS).groupBy("scenario").agg(F.sum("flux"), F.sum("flux_err"), F.sum(F.col("flux") * F.col("flux_err"))).collect():
            found[r[0]].add(tuple(r)[1:])
    assert all(len(v) == 1 for v in found.values())


def test_only_unseen_objects_are_varied(spark):
    given = []

    def vary(rows):
        given.extend(r[0] for r in rows.select("object_id").distinct().collect())
        return rows.withColumn("days", F.lit(0))

    sf_dir = "/root/testdata/sf0.001"
    chain.sides(spark, sf_dir, vary, "days", (0,))
    unseen = chain._truth(spark, sf_dir).filter("NOT fits").select("object_id").collect()
    assert given and sorted(given) == sorted(r[0] for r in unseen)


def test_shape_statistics(spark):
    b = one(features.band_statistics(obs(spark, [3 + 2 * x - 0.5 * x * x for x in range(6)])))
    assert abs(b.curvature + 0.5) < 1e-9
    b = one(features.band_statistics(obs(spark, [1 + 0.7 * x for x in range(8)])))
    assert abs(b.slope - 0.7) < 1e-9 and b.resid_std < 1e-6
    b = one(features.band_statistics(obs(spark, [10, 1000, 100])))
    assert abs(b.peak_mag - 20.0) < 1e-9
    b = one(features.band_statistics(obs(spark, [5])))
    assert b.flux_std is None and b.slope == 0 and b.gap_max is None and b.flux_skew == 0
    b = one(features.band_statistics(obs(spark, [7, 9, 9, 1])))
    assert b.t_peak == 1.0  # the first of equal peaks
    b = one(features.band_statistics(obs(spark, [1, 2], det=0)))
    assert b.dflux_max is None and b.dpeak_time is None and b.n_det == 0


def test_absent_bands_are_null_and_their_shape_zero(spark):
    w = one(features.wide(features.band_statistics(obs(spark, [1, 2, 3])), ("n_obs", "flux_max", "slope")))
    assert (w.r_n_obs, w.u_n_obs, w.u_flux_max, w.u_slope) == (3, None, None, 0.0)


def test_quality_statistics(spark):
    q = one(features.quality_features(obs(spark, [100] * 5 + [-100] * 5)))
    assert q.q_neg_flux_frac == 0.5
    q = one(features.quality_features(obs(spark, [1] * 6, times=[0, 0, 0, 1, 2, 3])))
    assert q.q_duplicate_epochs == 3
    two = obs(spark, [20] * 5).unionByName(obs(spark, [0.1] * 95, det=0, times=range(10, 105)))
    assert one(features.quality_features(two)).q_det_snr_median == 20
    c = features.colour_features(features.band_peaks(obs(spark, [100], band=1).unionByName(obs(spark, [100], band=2))))
    assert one(c).col_gmr == 0


def test_quality_falls_with_corruption_and_is_bounded(spark):
    clean = simulate.light_curves(spark, 9)
    q = lambda o: {r.object_id: r.quality for r in quality.quality(features.quality_features(o)).collect()}
    before = q(clean)
    for name in inject.INJECTORS:
        after = q(inject.corrupted(clean, name))
        assert all(0 <= v <= 1 for v in after.values())
        if name in ("error_bar_corruption", "negative_flux_heavy", "incomplete_band_coverage"):
            assert sum(after.values()) <= sum(before.values()) + 1e-9


def test_features_do_not_depend_on_order_or_partitions(spark):
    o = simulate.light_curves(spark, 12)
    a = features.band_statistics(o.repartition(1)).orderBy("object_id", "passband").collect()
    b = features.band_statistics(o.orderBy(F.desc("flux")).repartition(17)).orderBy("object_id", "passband").collect()
    for x, y in zip(a, b):
        assert all(p == q or math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6) for p, q in zip(x, y))
    part = features.band_statistics(o.filter("object_id = 1003")).orderBy("passband").collect()
    assert [r.flux_max for r in part] == [r.flux_max for r in a if r.object_id == 1003]


def test_textbook_metrics(spark):
    rows = spark.createDataFrame([(i, y, float(8 - i)) for i, y in enumerate([1, 0, 1, 0, 0, 1, 0, 0])], "object_id long, y int, score double")
    m = one(metrics.auc_and_ap(rows))
    assert math.isclose(m.roc_auc, 11 / 15) and math.isclose(m.average_precision, (1 + 2 / 3 + 1 / 2) / 3)
    k = one(metrics.at_k(rows, (3,)))
    assert (k.precision, k.recall) == (2 / 3, 2 / 3) and math.isclose(k.lift, 16 / 9)
    assert one(metrics.auc_and_ap(rows.filter("y = 1"))).roc_auc is None
    tied = rows.withColumn("score", F.lit(1.0))
    assert one(metrics.auc_and_ap(tied)).roc_auc == 0.5


def test_base_rate_weight_moves_the_share_to_the_target(spark):
    for base, target in ((0.1, 0.01), (0.027, 0.001)):
        w = metrics.negative_weight(base, target)
        assert math.isclose(base / (base + w * (1 - base)), target)
        assert math.isclose(metrics.negative_weight(base, target, inverted=True), 1 / w)
    rows = spark.createDataFrame([(i, int(i % 3 == 0), float(100 - i)) for i in range(100)], "object_id long, y int, score double")
    p = {r.target: r.p_at_30 for r in metrics.stress(rows, (0.3, 0.1, 0.01, 0.9), (30,), draws=20).collect()}
    assert set(p) == {0.3, 0.1, 0.01} and p[0.3] > p[0.1] > p[0.01]  # mixed top: it falls with the base rate


def test_enrichment(spark):
    rows = spark.createDataFrame([(i, 0, float(100 - i), "a" if i < 50 else "b") for i in range(100)], "object_id long, y int, score double, grp string")
    r = {x.grp: x for x in metrics.per_class(rows, 50).collect()}
    assert (r["a"].recall, r["a"].enrichment, r["b"].in_top) == (1, 2, 0)


def test_simplex_channels(spark):
    from tarnfield.schema import KNOWN

    k = len(KNOWN)
    peak = [0.7, 0.2, 0.1] + [1e-12] * (k - 3)
    rows = spark.createDataFrame([(1, 0, peak), (2, 1, [1 / k] * k)], "object_id long, label int, p array<double>")
    got = {r.object_id: r for r in evidence.simplex_channels(rows, evidence.centroids(rows)).collect()}
    assert math.isclose(got[1].taxonomy_gap, 0.3, abs_tol=1e-9) and math.isclose(got[1].novelty_gap, 0.5, abs_tol=1e-9)
    assert math.isclose(got[2].prior_entropy, 1.0) and got[1].best_fit_code == KNOWN[0]
    assert got[1].simplex_novelty < 1e-9


def test_ranking_rules(spark):
    rows = [(i, 0.5, 0.5, 0.5, q, u, 1.0) for i, (q, u) in enumerate([(1.0, 0.1), (0.5, 0.1), (0.2, 0.1), (1.0, 0.1), (1.0, 0.9)])]
    e = spark.createDataFrame(rows, "object_id long, taxonomy_gap double, simplex_novelty double, novelty_gap double, quality double, uncertainty double, reliability double")
    r = {x.object_id: x for x in ranking.rank(ranking.scores(e)).collect()}
    assert r[0].score > r[1].score > r[2].score and r[0].rank == 1 and r[3].rank == 2
    assert r[2].abstain and r[2].abstain_reason.startswith("low data quality")
    assert r[0].tier == "critical" and r[0].normalised_score == 1 and r[0].agreement == 1
    frozen = {x.object_id: x.tier for x in ranking.rank(ranking.scores(e), reference_max=10.0, uncertainty_cut=1.0).collect()}
    assert frozen[0] == "routine"
    with pytest.raises(ValueError):
        ranking.normalised({"a": 0.0})
    page, total = serve.candidates(ranking.rank(ranking.scores(e)).withColumn("best_fit_code", F.lit(90)), limit=2, offset=1, family="extragalactic")
    assert [x.rank for x in page.collect()] == [2, 3] and one(total).total == 5
    assert one(serve.summary(ranking.rank(ranking.scores(e)))).n == 5


def test_drift(spark):
    r = spark.range(2000).select(F.col("id").alias("object_id"), (F.col("id") % 997).cast("double").alias("x"))
    t = r.withColumn("x", F.col("x") + 600)
    same = domain.long_form(r, ["x"], "reference").unionByName(domain.long_form(r, ["x"], "target"))
    moved = domain.long_form(r, ["x"], "reference").unionByName(domain.long_form(t, ["x"], "target"))
    assert one(domain.psi(same)).psi < 1e-9 and one(domain.ks(same)).ks == 0
    assert one(domain.psi(moved)).psi > 0.25 and one(domain.ks(moved)).ks > 0.5
    assert one(domain.match(domain.psi(same))).status == "matched" and one(domain.match(domain.psi(moved))).status == "abstain"
    flat = domain.long_form(r.withColumn("x", F.lit(1.0)), ["x"], "reference").unionByName(domain.long_form(r.withColumn("x", F.lit(1.0)), ["x"], "target"))
    assert one(domain.psi(flat)).psi == 0
    w = domain.stratified_weights(r, t, ["x"])
    assert w.count() == 2000 and one(w.agg(F.max("weight").alias("m"))).m <= 5.0
    assert one(domain.effective_size(w)).ess < 2000


def test_splits_and_guard(spark):
    ids = spark.range(500).select(F.col("id").alias("object_id"), (F.col("id") % 3).alias("label"))
    m = protocol.split(ids, {"fit": 0.6, "test": 0.4}, "x")
    assert protocol.overlaps(m).count() == 0
    assert m.orderBy("object_id").collect() == protocol.split(ids.repartition(9), {"fit": 0.6, "test": 0.4}, "x").orderBy("object_id").collect()
    text = protocol.manifest(m, "m", "x", "test")
    assert protocol.verify(m, text)
    assert not protocol.verify(m, text.replace('"locked": "test"', '"locked": "fit"'))
    assert not protocol.verify(m.filter("object_id <> 3"), text)
    guard = protocol.LeakageGuard(m, "test")
    with pytest.raises(ValueError):
        guard.violations()
    guard.saw("fit", m.filter("split = 'fit'"))
    assert guard.violations().count() == 0
    guard.saw("bad", ids)
    assert [r.stage for r in guard.violations().collect()] == ["bad"]
    sub = protocol.rare_preserving(spark.range(5047).select(F.col("id").alias("object_id"), F.when(F.col("id") < 5000, "a").when(F.col("id") < 5040, "b").otherwise("c").alias("label")), "label", 1000, 50, "s")
    n = {r["label"]: r["count"] for r in sub.groupBy("label").count().collect()}
    assert (n["b"], n["c"]) == (40, 7) and n["a"] <= 1000 - 47


def test_alerts_isolate_bad_lines(spark, tmp_path):
    ztf = {"candid": "c1", "objectId": "ZTF1", "candidate": {"jd": 2460001.5, "fid": 1, "flux": 10.0, "fluxerr": 1.0, "isdiffpos": "t", "drb": 0.9}, "prv_candidates": [{"jd": 2460000.5, "fid": 2, "flux": 5.0, "fluxerr": 1.0, "isdiffpos": "f"}, {"jd": None, "fid": 2, "flux": 5.0, "fluxerr": 1.0}, {"jd": 2460000.5, "fid": 9, "flux": 5.0, "fluxerr": 1.0}, {"jd": 2460000.5, "fid": 1, "flux": 5.0, "fluxerr": 0.0}]}
    rubin = {"alertId": "a1", "diaSource": {"diaSourceId": "d", "midPointTai": 60000.0, "band": "r", "psfFlux": -3.0, "psfFluxErr": 1.0}, "diaSourceHistory": [{"midPointTai": 59999.0, "band": "y", "psfFlux": 4.0, "psfFluxErr": 1.0}], "diaObject": {"diaObjectId": "o1", "zphot": 0.1, "zphotErr": 0.01}}
    path = tmp_path / "alerts.jsonl"
    path.write_text("\n".join([json.dumps(ztf), "{not json at all", json.dumps(rubin), json.dumps({"other": 1})]))
    p = alerts.read_packets(spark, str(path))
    report = one(alerts.replay_report(p))
    assert (report.n, report.ok, report.failed) == (4, 2, 2)
    pts = {(r.passband, r.mjd): r.detected_bool for r in alerts.to_photometry(p).collect()}
    assert pts == {(1, 60001.0): 1, (2, 60000.0): 0, (2, 60000.0): 0} | {(5, 59999.0): 1}
    import hashlib

    assert {r.object_id for r in p.filter("shape is not null").collect()} == {int(hashlib.sha256(x).hexdigest()[:8], 16) % (2**31 - 1) for x in (b"ZTF1", b"o1")}


def test_alert_stream_equals_batch(spark, tmp_path):
    from tarnfield.streaming import replay

    folder = tmp_path / "in"
    folder.mkdir()
    lines = [r.value for r in alerts.write_packets(simulate.light_curves(spark, 6)).select("value").collect()]
    for k in range(3):
        (folder / f"{k}.jsonl").write_text("\n".join(lines[k::3] + ["{broken"]))
    replay.replay(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).count()
    assert got == alerts.to_photometry(alerts.read_packets(spark, str(folder))).count() > 0
    assert spark.read.parquet(str(tmp_path / "out_errors")).count() == 3


def test_tables(spark, tmp_path):
    o = simulate.light_curves(spark, 5)
    csv = str(tmp_path / "lc.csv")
    o.select(F.col("object_id").cast("int"), F.col("mjd").cast("float"), F.col("passband").cast("byte"), F.when(F.col("epoch") == 1, float("nan")).otherwise(F.col("flux")).cast("float").alias("flux") if "epoch" in o.columns else F.col("flux").cast("float"), F.col("flux_err").cast("float"), F.col("detected_bool").cast("byte")).write.option("header", True).option("compression", "gzip").csv(csv)
    back = tables.read_photometry(spark, csv)
    assert back.count() == o.count()
    ids = spark.createDataFrame([(1001,), (1003,)], "object_id int")
    counts = one(tables.harvest(back, ids, str(tmp_path / "cache")))
    assert (counts.rows, counts.objects) == (288, 2)
    curve = tables.light_curve(spark, str(tmp_path / "cache"), 1001).collect()
    assert len(curve) == 144 and [r.mjd for r in curve] == sorted(r.mjd for r in curve)
    with pytest.raises(ValueError):
        tables.harvest(back, spark.createDataFrame([(1,)], "object_id int"), str(tmp_path / "none"))
    meta = str(tmp_path / "meta.csv")
    spark.createDataFrame([(1, 1.0, 0), (2, None, 0)], "object_id int, ra float, true_target int").coalesce(1).write.option("header", True).csv(meta)
    assert tables.read_metadata(spark, meta).count() == 2
    with pytest.raises(ValueError):
        tables.read_metadata(spark, meta, label="true_target")
    f = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 5.0)], "object_id long, a double, b double")
    assert tables.fill(f, tables.learn_fill(f)).filter("object_id = 1").first().b == 5.0
    tables.append_feedback(spark, str(tmp_path / "fb"), 1, "novel", "x" * 3000)
    assert len(tables.feedback_tail(spark, str(tmp_path / "fb")).first().note) == 2000
    with pytest.raises(ValueError):
        tables.append_feedback(spark, str(tmp_path / "fb"), 1, "great")


def test_search_and_models(spark):
    rows = [(i, int(i % 7 == 0), (i % 7 == 0) * 0.5 + (i * 37 % 50) / 100, *((i * k % 31) / 31 for k in (3, 5, 11, 13)), (i * 17 % 23) / 23) for i in range(300)]
    e = spark.createDataFrame(rows, "object_id long, y int, taxonomy_gap double, simplex_novelty double, novelty_gap double, prior_entropy double, neighbor_entropy double, cc_weighted double")
    s = search.search(e)
    assert s.count() == 216
    assert one(search.best(s)).combo == 0  # the only informative channel alone
    a = {r.variant: r.roc_auc for r in search.ablation(e, ranking.BASELINE).collect()}
    assert a["only_taxonomy_gap"] >= a["full"] > a["only_novelty_gap"]
    v = spark.range(300).select(F.col("id").alias("object_id"), (F.col("id") % 3).cast("int").alias("label"), ((F.col("id") % 3) * 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    assert one(models.Prior(["a", "b"], trees=10).fit(v).accuracy()).accuracy > 0.95
    u = models.bootstrap_uncertainty(v, v, ["a", "b"])
    assert one(u.agg(F.max("uncertainty").alias("m"))).m <= 1
    d = models.AnomalyEnsemble(["a", "b"]).fit(v).distances(v.unionByName(spark.createDataFrame([(999, 0, 50.0, 50.0)], v.schema)))
    assert one(d.orderBy(F.desc("mahalanobis"))).object_id == 999
    same = one(models.adversarial_validation(v.filter("object_id % 2 = 0"), v.filter("object_id % 2 = 1"), ["b"]))
    far = one(models.adversarial_validation(v.filter("label = 0"), v.filter("label = 2"), ["a"]))
    assert same.roc_auc < 0.65 and far.roc_auc > 0.95


def test_detectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) @ np.array([[1.0, 0.4, 0.0], [0.0, 1.0, 0.2], [0.0, 0.0, 0.5]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "object_id long, a double, b double, c double")
    fitted = detectors.DetectorEnsemble(["a", "b", "c"], components=2).fit(v)
    odd = spark.createDataFrame([(999, 20.0, -20.0, 20.0), (1000, None, None, None)], v.schema)
    got = {r.object_id: r for r in fitted.score(v.unionByName(odd)).collect()}
    assert len(got) == 402 and all(0 <= r.anomaly_score <= 1 for r in got.values())
    assert max(got.values(), key=lambda r: r.anomaly_score).object_id == 999 and got[1000].anomaly_score < 0.5
    alone = one(fitted.score(v.filter("object_id = 7")))  # a row's score does not depend on its batch
    assert alone == got[7]
    # by plain matrices
    centre, width = np.quantile(x, 0.5, axis=0), np.quantile(x, models.SIGMA_HIGH, axis=0) - np.quantile(x, models.SIGMA_LOW, axis=0)
    z = (x - centre) / width
    cov = np.cov(z.T)
    d = z - z.mean(axis=0)
    far = np.sqrt(np.einsum("ni,ij,nj->n", d, np.linalg.pinv(cov + 1e-6 * np.eye(3)), d))
    _, axes = np.linalg.eigh(cov)
    left = np.abs(d @ axes[:, 0])
    for i in (0, 7, 399):
        assert abs(got[i].mahalanobis - far[i]) < 1e-6 and abs(got[i].pca_residual - left[i]) < 1e-6
        isolated = np.array([got[k].isolation for k in range(400)])
        rank = np.mean([((m < m[i]).sum() + (m == m[i]).sum() / 2) / 400 for m in (far, left, isolated)])
        assert abs(got[i].anomaly_score - rank) < 1e-9
    packed = v.selectExpr("object_id", "0 AS label", "array(a, b, c) AS x")
    near = evidence.neighbours(packed, packed, 5)
    third = fitted.score(v, near, near).filter("object_id = 7").first()
    brute = np.sort(np.sqrt(((x - x[7]) ** 2).sum(axis=1)))[1:6].mean()
    assert abs(third.knn_distance - brute) < 1e-6
    with pytest.raises(ValueError):
        detectors.DetectorEnsemble(["a", "b"]).fit(v.filter("false"))


def test_ordered_scans(spark):
    """Ranks, running totals and quantiles over ranges equal those of one list, with ties, skew and nulls."""
    import random

    import numpy as np

    r = random.Random(1)
    rows = [(i, r.choice("ab"), r.choice([0.0, 1.0, r.gauss(0, 1), r.gauss(0, 1)])) for i in range(3000)]
    df = spark.createDataFrame([*rows, (5000, "c", 2.0)], "object_id long, g string, v double")
    got = {x.object_id: x.n for x in ordered.numbered(df, F.col("v"), [F.col("v"), F.col("object_id")], "n").collect()}
    assert got == {o[0]: k + 1 for k, o in enumerate(sorted([*rows, (5000, "c", 2.0)], key=lambda o: (o[2], o[0])))}
    ranged = ordered.by_ranges(df, F.col("v"))
    assert ranged.select("_range").distinct().count() > 200
    run = ordered.running(ranged, [F.col("v"), F.col("object_id")], {"s": F.col("object_id")}, ["g"], totals=True).collect()
    for g in "abc":
        own, total = sorted((x.v, x.object_id, x.s, x.all_s) for x in run if x.g == g), 0
        for v, i, s, whole in own:
            total += i
            assert s == total
        assert {o[3] for o in own} == {total}
    q = ordered.quantiles(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"], [0.0, 0.1, 0.5, 0.97, 1.0])
    assert np.allclose(q["v"], np.quantile([*(o[2] for o in rows), 2.0], [0.0, 0.1, 0.5, 0.97, 1.0])) and "w" not in q
    assert ordered.quantiles(df.filter("false"), ["v"], [0.5]) == {} and ordered.numbered(df.filter("false"), F.col("v"), [F.col("v")], "n").count() == 0


def test_ties_are_split(spark):
    """A value that most rows have goes over many ranges of the tie-breaker."""
    df = spark.range(20_000).select(F.col("id").alias("object_id"), F.when(F.col("id") % 10 == 0, F.rand(1)).otherwise(0.0).alias("v"))
    ranged = ordered.by_ranges(df, -F.col("v"), F.col("object_id"))
    assert ranged.groupBy("_range").count().agg(F.max("count")).first()[0] < 700
    got = ordered.numbered(df, -F.col("v"), [F.desc("v"), F.col("object_id")], "n", tie=F.col("object_id")).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 20_001))
    assert [(-r.v, r.object_id) for r in got] == sorted((-r.v, r.object_id) for r in got)


def test_abstention_policy(spark):
    rows = [(0.2, 0.95, 0.0, "abstain"), (0.9, 0.95, 0.0, "abstain"), (0.9, 0.1, 0.0, "abstain"), (0.9, 0.1, 0.5, "abstain"), (0.9, 0.1, 0.5, "degraded"), (0.9, 0.1, 0.5, "matched")]
    df = spark.createDataFrame(rows, "quality double, uncertainty double, reliability double, domain_status string")
    got = ranking.decisions(df)
    assert [(r.abstain, r.reason) for r in got.collect()] == [(True, ranking.LOW_QUALITY), (True, ranking.UNCERTAIN), (True, ranking.UNPLACED), (True, ranking.FOREIGN), (False, ranking.DEGRADED), (False, "")]
    whole = ranking.abstentions(got).first()
    assert (whole.n, whole.n_abstained, round(whole.mean_confidence_kept, 9)) == (6, 4, 0.81) and whole.reasons == dict.fromkeys((ranking.LOW_QUALITY, ranking.UNCERTAIN, ranking.UNPLACED, ranking.FOREIGN), 1)
    assert not any(r.abstain for r in ranking.decisions(df, enabled=False).collect())
    empty = ranking.abstentions(ranking.decisions(df.filter("false"))).first()
    assert (empty.n, empty.abstention_rate, empty.mean_confidence_kept, empty.reasons) == (0, 0.0, None, {})


@pytest.mark.parametrize("kind", ["distinct", "ties", "one class", "empty"])
def test_bootstrap_equals_the_exploded_form(spark, kind):
    import numpy as np

    from tarnfield.operators import resampling

    r = np.random.default_rng(7)
    n = 0 if kind == "empty" else 400
    score = r.normal(size=n) if kind == "distinct" else r.integers(0, 4, n).astype(float)
    y = np.zeros(n, int) if kind == "one class" else (r.random(n) < 0.2).astype(int)
    df = spark.createDataFrame([(k, int(y[k]), float(score[k])) for k in range(n)], "object_id long, y int, score double").repartition(3)
    draws = 40
    w = resampling.weights([str(k) for k in range(n)], draws, 42)
    assert n == 0 or (abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1)
    got = resampling.draw_metrics(df, draws, ks=(10, 50), scales=(1.0, 9.0))
    order = np.lexsort((np.arange(n), -score))
    for d in range(draws):
        full = np.repeat(order, w[order, d]) if n else np.zeros(0, int)  # the resample, best first
        pos, s = y[full] == 1, score[full]
        if not pos.any() or pos.all():
            assert all(np.isnan(v[d]) for v in got.values())
            continue
        diff = s[pos][:, None] - s[~pos][None, :]
        assert np.isclose(got["roc_auc"][d], ((diff > 0) + 0.5 * (diff == 0)).mean())
        for scale in (1.0, 9.0):
            tp, fp = (np.array([((s >= v) & m).sum() for v in s[pos]]) for m in (pos, ~pos))
            assert np.isclose(got[f"average_precision_{scale!r}"][d], (tp / (tp + scale * fp)).mean())
        for k in (10, 50):
            assert np.isclose(got[f"p_at_{k}"][d], pos[:k].mean())
    table = resampling.intervals(df, 30, ks=(10,)).collect()
    assert [t.metric for t in table] == ["roc_auc", "average_precision", "p_at_10"] and all(t.small_n == (kind in ("one class", "empty")) for t in table)


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[50:60] = x[40]
    df = spark.createDataFrame([(i, i % 3, list(map(float, v))) for i, v in enumerate(x)], "object_id long, label int, x array<double>")
    got = {}
    for r in evidence.neighbours(df.filter("object_id % 7 = 0"), df, 6).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.object_id, r.label)
    for q in range(0, 300, 7):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((d[i], i) for i in range(300) if i != q)[:6]
        assert [got[q][k + 1] for k in range(6)] == [(i, i % 3) for _, i in best]


def test_channels_and_blocks(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0, [0.5, 0.5]), (2, 4.0, None, [0.1, 0.9])], "object_id long, a double, b double, p array<double>")
    stats = spark.createDataFrame([(0, "a", 0.0, 1.0), (0, "b", 0.0, 2.0), (1, "a", 4.0, 2.0), (1, "b", 1.0, 0.0)], "label int, feature string, mean double, sd double")
    got = {r.object_id: r for r in evidence.physics_channels(rows, stats, ["a", "b"]).collect()}
    assert (got[1].physics_gap, got[1].nearest_class, got[1].cc_weighted) == (0.5, 0, 0.5 * 0.5 + 0.5 * 2.0)
    assert (got[2].physics_gap, got[2].nearest_class) == (0.0, 1) and abs(got[2].cc_weighted - 0.1 * 8.0) < 1e-12
    assert [r.mapped for r in evidence.rank01(spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "object_id long, v double"), "v").orderBy("object_id").collect()] == [0.5, 0.0, 1.0]
    a = features.aligned(rows, ["b", "z"])
    assert a.columns == ["b", "z"] and a.first().z == 0.0
    assert rows.select(features.reliability_of(rows).alias("r")).first().r == 1.0
    flux = spark.range(1).select(physics.magnitude_error(F.lit(100.0), F.lit(10.0)).alias("e"), physics.luminosity_proxy(F.lit(1.0), F.lit(40.0)).alias("l"), physics.feature_reliability(F.lit(None).cast("double"), F.lit(1.0)).alias("r")).first()
    assert abs(flux.e - 0.108574) < 1e-5 and flux.l == -12.5 and abs(flux.r - 0.135335) < 1e-5


def test_packets_of_json_files_and_problems(spark, tmp_path):
    packet = '{"candid": 1, "objectId": "x", "candidate": {"jd": 2460000.5, "fid": 1, "flux": 5.0, "fluxerr": 1.0, "isdiffpos": "t"}}'
    (tmp_path / "many.json").write_text("[" + packet + ", " + packet.replace('"x"', '"y"') + "]")
    (tmp_path / "one.json").write_text(packet)
    (tmp_path / "lines.jsonl").write_text(packet + "\n\n{not json\n")
    assert alerts.read_packets(spark, str(tmp_path / "many.json")).filter("size(errors) = 0").count() == 2
    only = alerts.read_packets(spark, str(tmp_path / "one.json")).collect()
    assert len(only) == 1 and only[0].provenance["survey"] == "ztf" and only[0].provenance["alert_id"] == "1"
    lines = alerts.read_packets(spark, str(tmp_path / "lines.jsonl"))
    assert one(alerts.replay_report(lines)) == (2, 1, 1) and one(alerts.failures(lines)).error == "not JSON"
    point = "array(named_struct('mjd', {m}, 'passband', {b}, 'flux', {f}, 'flux_err', {e}))"
    for values, text in ((dict(m=1.0, b=9, f=1.0, e=1.0), "passband outside 0..5"), (dict(m=1.0, b=1, f="double('NaN')", e=1.0), "non-finite flux"), (dict(m=1.0, b=1, f=1.0, e=0.0), "non-positive flux_err"), (dict(m="double('Infinity')", b=1, f=1.0, e=1.0), "non-finite mjd")):
        df = spark.range(1).selectExpr(point.format(**values) + " AS points")
        assert df.select(alerts.problems(F.col("points")).alias("p")).first().p == [text]


def test_serving_and_stores(spark, tmp_path):
    obs = spark.createDataFrame([(1, 2.0, 0, 5.0, 1.0, 1), (1, 1.0, 1, 6.0, 1.0, 0), (2, 3.0, 0, 7.0, 1.0, 1)], "object_id int, mjd double, passband int, flux double, flux_err double, detected_bool int")
    curve = one(serve.light_curve(obs, 1))
    assert (curve.n_points, curve.n_detections, curve.mjd_range) == (2, 1, [1.0, 2.0]) and curve.points[0].mjd == 1.0
    path = str(tmp_path / "curves")
    tables.write_light_curves(obs, path)
    assert tables.light_curves(spark, path, [2]).count() == 1 and tables.known_ids(spark, path).count() == 2
    with pytest.raises(KeyError):
        tables.light_curves(spark, path, [2, 9])
    kept = one(tables.stored(spark, path))
    assert kept.rows == 3 and kept.bytes > 0
    feats = spark.createDataFrame([(1, 0.5, 2.0)], "object_id long, a double, b double")
    tables.write_features(feats, str(tmp_path / "f"))
    assert one(tables.read_features(spark, str(tmp_path / "f"), ["b", "z"])) == (1, 2.0, 0.0)
    with pytest.raises(LookupError):
        serve.evaluation(None)
    state = one(serve.health(spark, feats, None, obs))
    assert (state.status, state.candidates, state.metrics, state.light_curves) == ("ok", 1, False, True)
    protocol.write_manifest("{}", str(tmp_path / "m.json"))
    with pytest.raises(FileExistsError):
        protocol.write_manifest("{}", str(tmp_path / "m.json"))
    doc = serve.documents(spark.createDataFrame([(1, float("nan"))], "object_id long, v double")).first().document
    assert "NaN" not in doc
    ref = spark.createDataFrame([(float(i),) for i in range(300)], "a double")
    monitor = domain.ShiftMonitor(["a"]).fit(ref)
    assert one(monitor.status(monitor.health(ref))).status == "matched"
    assert one(monitor.status(monitor.health(ref.selectExpr("a + 1000 AS a")))).status == "abstain"


def test_report_is_one_document(spark):
    import json

    rows = [(i, (i * 37 % 101) / 101, i % 5 == 0, "ab"[i % 2], 0.9, 0.1, i % 7 == 0, "high" if i % 3 else "routine", (i % 11) / 11) for i in range(200)]
    df = spark.createDataFrame([(i, s, int(y), g, q, u, a, t, c) for i, s, y, g, q, u, a, t, c in rows], "object_id long, score double, y int, grp string, quality double, uncertainty double, abstain boolean, tier string, gap double")
    doc = json.loads(serve.report(df, "test", ["gap"]).first().document)
    assert doc["metrics"][0]["n_objects"] == 200 and {t["tier"] for t in doc["tiers"]} == {"high", "routine"} and doc["channels"][0]["channel"] == "gap"


def test_gated_prior(spark):
    v = spark.range(400).select(F.col("id").alias("object_id"), (F.col("id") % 4).cast("int").alias("label"), ((F.col("id") % 4) * 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    m = models.GatedPrior(["a", "b"], (0, 1), n_folds=2, trees=8).fit(v)
    got = m.probabilities(v).join(v, "object_id").collect()
    assert len(got) == 400 and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert sum(max(range(4), key=lambda i: r.p[i]) == r.label for r in got) > 380
    flat = {r.object_id: r.p for r in models.Prior.probabilities(m, v).collect()}
    assert sum(sum(r.p[:2]) if r.label < 2 else sum(r.p[2:]) for r in got) >= sum(sum(flat[r.object_id][:2]) if r.label < 2 else sum(flat[r.object_id][2:]) for r in got)
    with pytest.raises(ValueError):
        m.fit(v.filter("label < 2"))


def test_optimism_and_budgets(spark):
    rows = [(i, int(i % 7 == 0), (i % 7 == 0) * 0.5 + (i * 37 % 50) / 100, (i * 5 % 31) / 31) for i in range(300)]
    e = spark.createDataFrame(rows, "object_id long, y int, taxonomy_gap double, novelty_gap double")
    grid = {"taxonomy_gap": (1.0,), "novelty_gap": (0.0, 0.5)}
    got = search.optimism(e, grid).collect()
    assert len(got) == 5 and all(r.combo == 0 and abs(r.optimism - (r.ap_select - r.ap_report)) < 1e-12 for r in got)
    assert search.optimism(e.filter("y = 0"), grid).count() == 0
    s = e.select("object_id", "y", F.col("taxonomy_gap").alias("score"))
    b = {r.budget: r for r in metrics.review_budget(s, 0.01, (10, 1000)).collect()}
    assert abs(b[1000].precision - 0.01) < 1e-9 and abs(b[1000].lift - 1) < 1e-6 and b[10].precision > b[1000].precision
    q = spark.createDataFrame([(1, 0.8, 0.5), (2, 0.8, None), (3, 0.8, 7.0), (4, 0.8, float("nan"))], "object_id long, quality double, realbogus double")
    assert [r.quality for r in quality.with_survey_score(q).orderBy("object_id").collect()] == [0.4, 0.8, 0.8, 0.8]
    assert quality.with_survey_score(q.drop("realbogus")).columns == ["object_id", "quality"]


def test_k_correction(spark):
    k = physics.k_correction(F.col("z"), F.col("b"))
    r = spark.createDataFrame([(0.5, 0), (0.5, 5), (0.0, 2)], "z double, b int").select(k.alias("k")).collect()
    assert abs(r[0].k - 0.5 * 640 / 367) < 1e-12 and r[1].k < r[0].k and r[2].k == 0
    m = physics.absolute_magnitude(F.lit(20.0), F.lit(15.0), F.lit(0.5), F.lit(0.25))
    assert one(spark.range(1).select(m.alias("m"))).m == 4.25


def test_report_has_points_within_their_intervals(spark):
    """One row of metrics and ends; few rows are flagged; one class or no rows leave nulls."""
    r = random.Random(12)
    rows = [(i, int(r.random() < 0.3), round(r.random(), 1)) for i in range(200)]
    frame = spark.createDataFrame(rows, "object_id long, y int, score double")
    one = resampling.report(frame, draws=200, precision_k=(10, 20), recall_k=(50,)).first()
    many = {x.metric: x for x in resampling.intervals(frame, draws=200, ks=(10, 20)).collect()}
    for m, x in many.items():
        assert (one[m], one[f"{m}_low"], one[f"{m}_high"]) == (x.point, x.low, x.high)
        assert x.low <= x.point <= x.high
    assert one.n_objects == 200 and one.n_novel == sum(y for _, y, _ in rows) and one.draws == 200 and not one.small_n
    single = resampling.report(frame.filter("y = 0"), draws=20).first()
    assert single.small_n and single.draws == 0 and single.roc_auc is None and single.p_at_10_low is None
    none = resampling.report(frame.filter("false"), draws=20).first()
    assert none.n_objects == 0 and none.small_n and none.roc_auc is None and none.roc_auc_high is None
