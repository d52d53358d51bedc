"""Snapshots, feedback, buckets, the fitted drift state, the exact split, replays."""

import json

import light_curves as simulate
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.operators import domain, features, protocol
from tarnfield.sources import alerts, store, tables
from tarnfield.streaming import replay


def failing(spark):
    return spark.range(10).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    out = str(tmp_path / "t")
    store.replace(spark.range(3), out)
    with pytest.raises(Exception, match="broken"):
        store.replace(failing(spark), out)
    assert spark.read.parquet(out).count() == 3 and len(list(tmp_path.iterdir())) == 1
    store.replace(spark.read.parquet(out).union(spark.range(5)), out)  # reads what it replaces
    assert spark.read.parquet(out).count() == 8


def test_snapshots(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        s.read()
    assert s.publish(spark.range(3), {"by": "test"}) == 1
    with pytest.raises(Exception, match="broken"):
        s.publish(failing(spark))
    assert s.versions() == [1] and s.read().count() == 3 and s.note() == {"by": "test"}
    assert s.publish(spark.range(4)) == 2 and s.read().count() == 4 and s.read(1).count() == 3
    s.publish(spark.range(5))
    s.prune(1)
    assert s.versions() == [3] and s.read().count() == 5 and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("data-")]) == 1


def test_feedback_is_compacted(spark, tmp_path):
    log = store.FeedbackLog(spark, str(tmp_path / "f"))
    assert log.read().count() == 0
    log.compact()
    for k in range(3):
        log.append(k, "novel", f"note {k}")
    log.compact()
    assert log.read().count() == 3 and not [p for p in (tmp_path / "f" / "log").iterdir() if p.suffix == ".parquet"]
    log.append(9, "known")
    assert {r.object_id for r in log.read().collect()} == {0, 1, 2, 9} and log.tail(1).first().object_id == 9
    # files whose deletion failed are not read twice
    done = log._open()
    log.whole.publish(log.read(), {"files": done})
    assert log.read().count() == 4
    with pytest.raises(ValueError):
        log.append(1, "great")


def test_buckets_need_no_exchange_and_a_lookup_reads_one(spark, tmp_path):
    obs = simulate.light_curves(spark, 40).select("object_id", "mjd", "passband", "flux", "flux_err", "detected_bool")
    s = store.LightCurveStore(spark, str(tmp_path / "lc"))
    with pytest.raises(FileNotFoundError):
        s.read()
    s.write(obs, 8)
    back = s.read()
    assert back.count() == obs.count()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(features.band_statistics(back)) and "Exchange" in plan(features.band_statistics(obs))
    assert "Exchange" not in plan(features.quality_features(back))
    one = back.select("object_id").first()[0]
    own = back.filter(F.col("object_id") == one).select("_metadata.file_name").distinct().collect()
    spoilt = [p for p in (tmp_path / "lc").glob("data-*/*.parquet") if p.name != own[0][0]]
    whole = {p: p.read_bytes() for p in spoilt}
    for p in spoilt:  # a look-up opens the file of its bucket alone
        p.write_bytes(b"no parquet")
    assert len(own) == 1 and len(spoilt) >= 6 and s.light_curve(one).count() > 0
    for p, raw in whole.items():
        p.write_bytes(raw)
    assert [r.mjd for r in s.light_curve(one).collect()] == [r.mjd for r in obs.filter(F.col("object_id") == one).orderBy("mjd").collect()]
    meta = obs.select("object_id").distinct().select("object_id", *(F.lit(0.5).alias(c) for c in ("ra", "decl", "hostgal_specz", "hostgal_photoz", "hostgal_photoz_err", "distmod", "mwebv")), F.lit(0).alias("ddf_bool"))
    stored_meta = str(tmp_path / "meta")
    meta.write.parquet(stored_meta)
    meta = spark.read.parquet(stored_meta)
    text = plan(features.feature_matrix(back, meta, dealt=True))
    assert "Exchange hashpartitioning" not in text  # metadata is broadcast, observations stay where they are
    columns = ["object_id", "lc_flux_max", "r_slope", "q_n_obs"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(features.feature_matrix(back, meta, dealt=True)) == rows(features.feature_matrix(obs, meta))
    s.write(obs.limit(10), 4)
    assert s.read().count() == 10


def test_harvest_counts_while_it_writes(spark, tmp_path):
    obs = simulate.light_curves(spark, 6)
    ids = obs.select("object_id").distinct().limit(2)
    out = str(tmp_path / "h")
    counts = tables.harvest(obs, ids, out).first()
    back = spark.read.parquet(out)
    assert (counts.rows, counts.objects) == (back.count(), 2) and "_first" not in back.columns


def psi(r, t, bins=10):
    edges = np.unique(np.quantile(r, np.linspace(0, 1, bins + 1)))
    if len(edges) < 3:
        return 0.0
    cut = lambda x: np.maximum(np.bincount(np.searchsorted(edges[1:-1], x, "right"), minlength=len(edges) - 1) / len(x), 1e-6)
    p, q = cut(r), cut(t)
    return float(((q - p) * np.log(q / p)).sum())


def test_drift_state_is_stored_merged_and_equal_to_raw_values(spark, tmp_path):
    r = np.random.default_rng(3)
    a, b, t = r.normal(size=400), np.round(r.normal(size=300), 1), r.normal(0.5, 1.2, 500)
    frame = lambda x: spark.createDataFrame([(float(v), None if k % 7 == 0 else float(v) * 2, 1.0) for k, v in enumerate(x)], "a double, b double, c double")
    monitor = domain.ShiftMonitor(["a", "b", "c", "absent"]).fit(frame(a)).merge(frame(b))
    version = monitor.save(str(tmp_path / "m"))
    again = domain.ShiftMonitor.load(spark, str(tmp_path / "m"), version)
    assert again.fitted == monitor.fitted and again.covariates == ["a", "b", "c", "absent"]
    got = {h.covariate: h for h in again.health(frame(t)).collect()}
    assert set(got) == {"a", "b", "c"}
    missing = lambda x: np.where(np.arange(len(x)) % 7 == 0, 0.0, 2 * x)
    for c, ref, new in (("a", np.concatenate([a, b]), t), ("b", np.concatenate([missing(a), missing(b)]), missing(t)), ("c", np.ones(700), np.ones(500))):
        low, high = np.quantile(ref, [0.005, 0.995])
        every = np.concatenate([ref, new])
        ks = max(abs((ref <= v).mean() - (new <= v).mean()) for v in every)
        expect = (psi(ref, new), ks, ((new < low) | (new > high)).mean(), low, high, np.median(new), np.median(ref))
        assert np.allclose(got[c][1:], expect), c
    state = monitor.status(monitor.health(frame(t))).first()
    assert state.status == ("matched" if state.worst_psi < 0.1 else "abstain" if state.worst_psi > 0.25 else "degraded")
    nothing = domain.ShiftMonitor(["z"]).fit(frame(a))
    assert nothing.status(nothing.health(frame(t))).first().status == "matched"


def test_split_equals_one_generator_on_a_million_ids(spark):
    ids = np.random.default_rng(1).permutation(3_000_000)[:1_000_000] - 1_000_000
    frame = spark.createDataFrame(__import__("pandas").DataFrame({"object_id": np.concatenate([ids, ids[:10]])}))
    got = protocol.exact_split(frame, {"fit": 0.6, "validation": 0.2, "test": 0.2}, 42).toPandas().sort_values("object_id")
    u = np.random.default_rng(42).random(1_000_000)
    assert (got["object_id"].to_numpy() == np.sort(ids)).all() and (got["u"].to_numpy() == u).all()
    assert (got["split"].to_numpy() == np.where(u < 0.6, "fit", np.where(u < 0.8, "validation", "test"))).all()


def test_guard_raises(spark):
    members = spark.createDataFrame([(1, "fit"), (2, "test")], "object_id long, split string")
    guard = protocol.LeakageGuard(members, "test")
    guard.saw("fit", members.filter("object_id = 1"))
    guard.assert_clean()
    guard.saw("select", members)
    with pytest.raises(protocol.LeakageError, match="select"):
        guard.assert_clean()


def test_replay_reports_and_scores(spark, tmp_path):
    lines = [r.value for r in alerts.write_packets(simulate.light_curves(spark, 6)).select("value").collect()]
    ids = [json.loads(x)["candid"] for x in lines]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*lines, "{broken"]))

    def score(packets):  # one packet's score is missing
        return packets.select("alert_id", F.when(F.col("alert_id") != ids[0], F.size("points") * 1.0).alias("score"))

    rows, report = replay.replay_file(spark, str(tmp_path / "in" / "a.jsonl"), score)
    r = report.first()
    assert (r.n_packets, r.n_succeeded, r.n_failed) == (len(lines) + 1, len(lines) - 1, 2) and r.throughput > 0 and r.elapsed_s > 0
    assert {(f.alert_id, f.error) for f in r.first_failures} == {("unknown", "not JSON"), (ids[0], "scoring failed")}
    assert rows.filter("score IS NOT NULL").count() == len(lines) - 1
    assert replay.replay_file(spark, str(tmp_path / "in" / "a.jsonl"), limit=3)[1].first().n_packets == 3
    replay.replay(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), score).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out_scores")).count() == len(lines) - 1
    assert spark.read.parquet(str(tmp_path / "out_report")).agg(F.sum("n_failed")).first()[0] == 2
