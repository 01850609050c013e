"""Driver-side parts, identities and small tables."""

import csv
import math

import pytest
from pyspark.sql import functions as F

from querymill import shipping
from querymill.operators import answer as ans
from querymill.operators import catalogue as cat
from querymill.operators import encode as enc
from querymill.operators import evolve as ev
from querymill.operators import metrics, privacy, projection
from querymill.operators import workload as wl
from querymill.operators.predicates import between, eq, ge, holds, le
from querymill.operators.schema import TableSchema
from querymill.plans import engine
from querymill.sources import config as cfg
from querymill.sources import tables


def test_scalars_and_overrides():
    assert [cfg.parse_scalar(x) for x in ("true", "None", "3", "1e-3", "a.b", "x")] == [True, None, 3, 0.001, "a.b", "x"]
    out = cfg.apply_overrides({"a": 1}, ["--a.b", "2", "--c=x"])
    assert out == {"a": {"b": 2}, "c": "x"}
    assert cfg.apply_overrides({}, ["--a", "--b"]) == {"a": "--b"}
    for bad in (["stray"], ["--k"]):
        with pytest.raises(ValueError):
            cfg.apply_overrides({}, bad)
    with pytest.raises(KeyError):
        cfg.require({}, "a.b")


def test_yaml_and_json(tmp_path):
    p = str(tmp_path / "x" / "c.yaml")
    cfg.save_yaml({"b": 1, "a": [1, 2]}, p)
    assert cfg.load_yaml(p) == {"b": 1, "a": [1, 2]}
    (tmp_path / "e.yaml").write_text("")
    assert cfg.load_yaml(str(tmp_path / "e.yaml")) == {}
    (tmp_path / "l.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        cfg.load_yaml(str(tmp_path / "l.yaml"))


def test_accounting():
    assert privacy.zcdp_epsilon(0, 1e-9) == 0
    assert abs(privacy.zcdp_epsilon(1.0, 1e-9) - 10.1046) < 1e-4
    assert privacy.sigma_from_rho(2.0) == 0.5
    with pytest.raises(ValueError):
        privacy.sigma_from_rho(0)
    assert metrics.rms_standardized_residual(8.0, 4) == 2.0


def test_small_answers(spark):
    rows = spark.createDataFrame([(0, 1, 2), (1, 0, 3), (2, 1, 4), (3, 1, 1)], "row_id long, c0 int, c1 int")
    b = cat.QueryBuilder()
    assert b.add([eq(0, 1)], "q0", "g", "f") and b.add([le(1, 2)], "q1", "g", "f") and b.add([eq(0, 1), between(1, 1, 3)], "q2", "g", "f")
    assert not b.add([between(1, 1, 3), eq(0, 1)], "again", "g", "f") and not b.add([], "empty", "g", "f")
    assert b.add([ge(1, 9)], "none", "g", "f")
    queries = b.build(spark)
    by_cuboid = {r["qid"]: r["answer"] for r in ans.answer(rows, queries, [2, 5]).collect()}
    by_count = {r["qid"]: r["answer"] for r in ans.answer(rows, queries, [2, 5], most_cells=0).collect()}
    assert by_cuboid == by_count == {0: 3, 1: 2, 2: 2, 3: 0}
    again = cat.from_json(spark, cat.to_json(queries))
    assert again.collect() == queries.collect()


def test_simplex_sums_to_the_total(spark):
    y = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((5, -3, 2, 2, 0))], "gid int, qid int, noisy double")
    z = [r["projected"] for r in projection.project_simplex(y, 6.0).collect()]
    assert min(z) >= 0 and math.isclose(sum(z), 6.0)


def test_admission_skips_what_does_not_fit():
    got = wl.admitted_pairs([10, 10, 2], 40, 0)
    assert {(a, b) for _, a, b in got} == {(0, 2), (1, 2)}


def test_schema_round_trip_and_missing(spark):
    df = spark.createDataFrame([("a", "1"), ("b", None), (None, "2"), ("?", "x")], "k string, v string")
    schema = enc.fit_schema(df, ["k", "v"], numerical=("v",), categorical=("k",))
    assert TableSchema.from_json(schema.to_json()) == schema
    assert schema.attributes[0].categories == ("__MISSING__", "a", "b")
    assert schema.attributes[1].representatives == ("1.0", "2.0", "__MISSING__")


def test_whole_run(spark, tmp_path):
    from querymill.cli import SMOKE, smoke_table

    config = cfg.apply_overrides(SMOKE, ["--run.output_dir", str(tmp_path), "--evolve.max_iters", "2", "--evolve.lambda_cost", "0.0", "--evolve.candidate_backend", "fused", "--evolve.returned", "50"])
    report = engine.run(spark, config, smoke_table(spark, 120))
    assert report["final_incremental_answer_drift"] == 0 and report["final_measured_loss"] <= report["initial_measured_loss"]
    assert report["true_query_mae"] == report["final_true_query_mae"] and report["heldout_num_queries"] > 0
    assert report["loss_reduction"] == report["initial_measured_loss"] - report["final_measured_loss"]
    with open(tmp_path / "metrics_timeseries.csv", newline="") as f:
        series = list(csv.DictReader(f))
    assert len(series) == report["num_iterations"] == 2 and len(series[0]) == 23
    for r in series:
        got, asked = int(r["candidates_scored_this_iter"]), int(r["requested_candidates"])
        assert int(r["directed_candidates"]) + int(r["random_candidates"]) == got and int(r["candidate_shortfall"]) == asked - got
        assert int(r["accepted_edits"]) <= int(r["selected_nonconflicting"]) <= int(r["num_candidates"]) <= 50
    assert float(series[-1]["measured_loss"]) == pytest.approx(report["final_measured_loss"])
    runtime = cfg.read_json(str(tmp_path / "runtime.json"))
    funnel = [runtime["candidate_funnel"][k] for k in ("requested", "scored", "returned_to_cpu", "positive_returned", "selected_nonconflicting", "accepted")]
    assert funnel == sorted(funnel, reverse=True) and funnel[-1] == report["num_accepted_edits"]
    work = cfg.read_json(str(tmp_path / "workload_summary.json"))
    assert sum(work["num_queries_by_family"].values()) == work["total_queries"] == report["num_queries"]
    assert sum(work["num_groups_by_family"].values()) == report["num_measurement_groups"]
    held = cfg.read_json(str(tmp_path / "metrics_holdout.json"))
    by_family = cfg.read_json(str(tmp_path / "metrics_by_family_holdout.json"))
    assert sum(v["num_queries"] for v in by_family.values()) == held["num_queries"] == len(cfg.read_json(str(tmp_path / "queries_holdout.json"))["queries"])
    assert max(v["final_true_query_max_error"] for v in by_family.values()) == held["final_true_query_max_error"]
    assert "iteration 2" in (tmp_path / "logs.txt").read_text()
    assert "true_answer" not in (tmp_path / "measurements.json").read_text()
    for name in ("config_resolved.yaml", "schema.json", "queries.json", "metrics_final.json", "runtime.json", "synthetic.csv", "metrics_by_family.json", "workload_summary_holdout.json"):
        assert (tmp_path / name).exists()
    with pytest.raises(ValueError):
        engine.ablation(config, "nothing")


def test_shipping_once(spark):
    shipping.ship(spark)
    shipping.ship(spark)


def test_csv_with_line_breaks(spark, tmp_path):
    text = 'a,b\n1,"two\nlines, and ""quotes"""\nNA, x \n'
    (tmp_path / "t.csv").write_text(text)
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.csv"), multiline=True).collect()]
    assert got == [("1", 'two\nlines, and "quotes"'), (None, " x ")]
    assert tables.read_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]


CARDS = [4, 8, 8]


def repaired(spark, terms, codes=(1, 3, 5)):
    """Codes after an enter and an exit for one query, drawn with 20 salts."""
    q = cat.QueryBuilder()
    assert q.add(terms, "q", "g", "f")
    rows = q.build(spark).select("qid", "terms").withColumn("row_id", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("codes", F.array(*map(F.lit, codes)))
    rows = ev.with_exit(ev.with_enter(rows, CARDS, "t/enter", "qid", "row_id"), CARDS, "t/exit", "qid", "row_id")
    return rows.select("terms", "codes", "entered", "left", holds("entered", "terms").alias("in_"), holds("left", "terms").alias("out_"), holds("codes", "terms").alias("was")).collect()


@pytest.mark.parametrize("terms", [[eq(0, 2)], [le(1, 2)], [ge(2, 6)], [between(1, 5, 6)], [eq(0, 3), between(2, 0, 2)]])
def test_an_enter_holds_and_stays_in_the_domain(spark, terms):
    for r in repaired(spark, terms):
        assert r["in_"] and all(0 <= x < k for x, k in zip(r["entered"], CARDS))
        touched = {t["attr"] for t in r["terms"]}
        assert all(a == b for i, (a, b) in enumerate(zip(r["codes"], r["entered"])) if i not in touched)


@pytest.mark.parametrize("terms", [[eq(0, 1)], [le(1, 3)], [ge(2, 5)], [between(1, 2, 4)], [eq(0, 1), between(2, 4, 6)]])
def test_an_exit_breaks_one_term(spark, terms):
    for r in repaired(spark, terms):
        assert r["was"] and not r["out_"] and all(0 <= x < k for x, k in zip(r["left"], CARDS))
        assert sum(a != b for a, b in zip(r["codes"], r["left"])) == 1


def test_an_exit_without_a_way_out_mutates(spark):
    for r in repaired(spark, [le(1, 7)]):
        assert r["out_"] is True and sum(a != b for a, b in zip(r["codes"], r["left"])) == 1


def transported(spark):
    """Two edits that each help alone and harm together, and a third for another query."""
    state = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.0)], "qid int, residual double, inv_variance double")
    selected = spark.createDataFrame([(10, 1, 0, 0.1, 0.5), (11, 2, 1, 0.1, 0.4), (12, 3, 2, 0.1, 1.4)], "cand_id long, rank int, row_id long, edit_cost double, advantage double")
    delta = spark.createDataFrame([(10, 0, 1), (11, 0, 1), (12, 1, 1)], "cand_id long, qid int, delta int")
    return state, selected, delta


def test_prefixes_count_interaction(spark):
    state, selected, delta = transported(spark)
    got = [r["prefix_advantage"] for r in ev.prefix_advantages(selected, delta, state, 0.1).orderBy("rank").collect()]
    assert got == pytest.approx([0.5 - 0.01, 0.0 - 0.02, 1.5 - 0.03])
    assert ev.batch_advantage(selected, delta, state, 0.1).first()["advantage"] == pytest.approx(got[-1])


def test_prefix_strategies(spark):
    state, selected, delta = transported(spark)
    assert ev.choose_prefix(selected, delta, state, 0.1, "largest_positive").count() == 3
    short = selected.where("rank < 3")
    assert [r["cand_id"] for r in ev.choose_prefix(short, delta, state, 0.1, "best_advantage").collect()] == [10]
    assert ev.choose_prefix(selected, delta, state, 100.0).count() == 0
    with pytest.raises(ValueError):
        ev.choose_prefix(selected, delta, state, 0.1, "none")


def test_best_scored_breaks_ties_by_id(spark):
    s = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 0.5), (4, 2.0)], "cand_id long, advantage double")
    assert [r["cand_id"] for r in ev.top_scored(s, 3).collect()] == [4, 1, 3]
    assert ev.top_scored(s, 0).count() == 0
