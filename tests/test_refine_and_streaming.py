"""The refinement loop with stand-ins for its models, and arriving layers."""

import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import refine
from glyphgrid.sources.bindings import relation
from glyphgrid.streaming import arrivals


def test_loop_settles_on_a_map_that_does_not_change(spark):
    g = spark.range(32 * 32).select(F.lit("s").alias("seg_id"), (F.col("id") / 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"), F.lit(0.0).alias("p"))
    out = refine.refine(spark, g, 32, seg_id="s", config=refine.RefinementConfig(enhance=None))
    assert len(out.log) == 1 and out.log[0]["mean_abs_diff"] == 0 and out.log[0]["n_candidates"] == 0


def test_loop_blends_by_its_schedule(spark, sf_dir):
    prob = relation(spark, sf_dir, "prob")
    seen = []
    cfg = refine.RefinementConfig(max_iterations=2, level=0.5, min_area=3, enhance=None, settled=0.0, train=lambda step, labels: seen.append((step, labels.count())))
    out = refine.refine(spark, prob, 64, seg_id="A", config=cfg)
    assert [e["alpha"] for e in out.log] == [0.3, 0.4] and [s for s, _ in seen] == [1, 2]
    assert out.labels.agg(F.min("p"), F.max("p")).first()[1] <= 1.0
    assert out.labels.count() == prob.where("seg_id = 'A'").count()
    assert all(0 <= e["pixels_unchanged_pct"] <= 100 for e in out.log)


def test_refinement_step_matches_letters(spark, sf_dir, monkeypatch):
    from glyphgrid.operators import match
    from glyphgrid.plans import text
    from glyphgrid.plans.catalog import Tables

    given, real = [], refine.refine
    monkeypatch.setattr(text.refine, "refine", lambda spark, labels, width, **k: given.append(k) or refine.RefinementResult(labels))
    text._refined(Tables(spark, sf_dir))
    # a ring around a hole: one medium candidate, without gaps beside it
    cells = [("s", y, x, 0.6 if 4 <= y < 20 and 6 <= x < 22 and not (8 <= y < 16 and 10 <= x < 18) else 0.0) for y in range(32) for x in range(32)]
    prob = spark.createDataFrame(cells, "seg_id string, y int, x int, p double")
    found, labelled = refine.letter_candidates(prob, 32, level=0.5, min_area=4, max_area=800)
    patch = match.described(match.candidate_patches(found, labelled, 16), "id", "cand", 16).collect()
    # at half its size, 8 x 8 without 4 x 4, whose four corners the closing has filled
    assert [r["holes"] for r in patch] == [1] and sum(patch[0]["cand"]) == 64 - 16 + 4
    letters = given[0]["match"](found, labelled).orderBy("rank").collect()
    assert [r["rank"] for r in letters] == [1, 2, 3] and letters[0]["score"] >= letters[2]["score"] > 0
    cfg = refine.RefinementConfig(max_iterations=1, level=0.5, min_area=4, max_area=800, enhance=None)
    assert real(spark, prob, 32, seg_id="s", config=cfg, complete=given[0]["complete"], match=given[0]["match"]).log[0]["n_llm_results"] == 1


def test_layers_that_arrive(spark, tmp_path):
    src, done = str(tmp_path / "in"), []
    rows = [("s", z, y, 0, y, f"2024-01-01 00:0{z}:00") for z in range(4) for y in range(5)]
    spark.createDataFrame(rows, "seg_id string, z int, y int, x int, v int, t string").selectExpr("seg_id", "z", "y", "x", "v", "timestamp(t) AS arrived").write.parquet(src)
    q = arrivals.each_batch(arrivals.arriving(spark, src), lambda df, k: done.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sum(done) == 20
    q = arrivals.layer_counts(arrivals.arriving(spark, src)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 20


def test_template_banks_are_bounded(spark):
    from glyphgrid.operators import match

    assert match.letter_table(spark).count() == 24
    with pytest.raises(ValueError):
        match.with_bank(spark.range(1), spark.range(match.MAX_TEMPLATES + 1).withColumnRenamed("id", "t"))
