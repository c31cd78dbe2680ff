"""Sources, projections, filters and aggregations over volumes and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import augment, block_stencil, metrics, reduce
from ..session import work_path
from ..sources import raster, strips
from .catalog import query

R = lambda c, n=6: F.round(c, n)


@query("SELECT seg_id, z, y, x, v FROM voxels", uses="voxels")
def s2_layers_as_bytes(t):
    """Odd layers are stored with 16 bits, even ones with 8; both come out as bytes."""
    bits = F.when(F.col("z") % 2 == 1, 16).otherwise(8)
    stored = t.voxels.select("seg_id", "z", "y", "x", F.when(bits == 16, F.col("v") * 257).otherwise(F.col("v")).alias("v"), bits.alias("bits"))
    return stored.withColumn("v", S.wide_to_byte(F.col("v"), F.col("bits"))).drop("bits")


@query(""", r AS (SELECT * FROM voxels WHERE z >= 2 AND z < 5), s AS (SELECT seg_id, min(v) AS lo, max(v) AS hi FROM r GROUP BY seg_id)
SELECT seg_id, z, y, x, round(CASE WHEN hi > lo THEN (v - lo) / cast(hi - lo AS double) ELSE cast(v AS double) END, 6) AS v FROM r JOIN s USING (seg_id)""", uses="voxels")
def s3_min_max_volume(t):
    return reduce.min_max_normalised(t.voxels, 2, 5).withColumn("v", R("v"))


@query("SELECT seg_id, y, x, round(lbl / cast(255 AS double), 6) AS t FROM voxels WHERE z = 0", uses="voxels")
def s4_pseudo_label(t):
    return t.voxels.where("z = 0").select("seg_id", "y", "x", R(F.col("lbl") / 255.0).alias("t"))


@query(""", m AS (SELECT seg_id, y, x, v > 127 AS mask FROM voxels WHERE z = 1 AND y < 32)
SELECT a.seg_id, a.y, a.x, a.lbl > 127 AS label, coalesce(m.mask, true) AS mask
FROM voxels a LEFT JOIN m ON a.seg_id = m.seg_id AND a.y = m.y AND a.x = m.x WHERE a.z = 0""", uses="voxels")
def s5_binary_label_and_mask(t):
    mask = t.voxels.where("z = 1 and y < 32").select("seg_id", "y", "x", (F.col("v") > 127).alias("mask"))
    return reduce.with_mask(t.voxels.where("z = 0").select("seg_id", "y", "x", (F.col("lbl") > 127).alias("label")), mask)


@query(""", s AS (SELECT seg_id, max(v) AS top FROM voxels WHERE z = 0 GROUP BY seg_id)
SELECT seg_id, y, x, round(least(greatest(CASE WHEN top > 1.5 THEN v / cast(255 AS double) ELSE v END, 0), 1), 6) AS p FROM voxels JOIN s USING (seg_id) WHERE z = 0""", uses="voxels")
def s6_scaled_map(t):
    return reduce.scaled_map(t.voxels.where("z = 0"), "v").withColumn("p", R("p"))


@query(""", q AS (SELECT seg_id, y, x, CASE seg_id WHEN 'A' THEN v / cast(100 AS double) WHEN 'N' THEN v / cast(200 AS double) ELSE v - cast(20 AS double) END AS v FROM voxels WHERE z = 0),
s AS (SELECT seg_id, max(v) AS top FROM q GROUP BY seg_id)
SELECT seg_id, y, x, round(CASE WHEN top > 1.5 THEN v / 255 ELSE v END, 6) AS unclipped, round(least(greatest(CASE WHEN top > 1.0 THEN v / 255 ELSE v END, 0), 1), 6) AS above_one FROM q JOIN s USING (seg_id)""", uses="voxels")
def s7_s8_other_scalings(t):
    """A map with values beyond [0, 1] that isn't clipped, and the rule that divides from a maximum above 1.0 on; the segments'
    maxima are 2.55, 1.275 and 235 at most."""
    seg, v = F.col("seg_id"), F.col("v")
    q = t.voxels.where("z = 0").select("seg_id", "y", "x", F.when(seg == "A", v / 100.0).when(seg == "N", v / 200.0).otherwise(v - 20.0).alias("v"))
    plain = reduce.scaled_map(q, "v", clipped=False).select("seg_id", "y", "x", R("p").alias("unclipped"))
    return plain.join(reduce.scaled_map(q, "v", above=1.0).select("seg_id", "y", "x", R("p").alias("above_one")), ["seg_id", "y", "x"])


@query("SELECT seg_id, count(*) AS layers, cast(sum(n_px) AS bigint) AS px FROM manifest GROUP BY seg_id", uses="manifest")
def s10_metadata(t):
    """Metadata of each segment, written as JSON over several lines and read again."""
    path = work_path(t.spark, "metadata")
    m = raster.inventory(t.manifest.select("seg_id", "z", F.col("n_px").alias("length")))
    text = F.format_string('{\n  "seg_id": "%s",\n  "layers": %d,\n  "px": %d\n}', "seg_id", "layers", "bytes")
    m.select(text.alias("value"), "seg_id").write.partitionBy("seg_id").text(path)  # a file for each segment
    return raster.read_metadata(t.spark, path).select("seg_id", "layers", "px")


@query("SELECT seg_id, y, x, v FROM voxels WHERE z = 3", uses="voxels")
def s9_layer_scan(t):
    return t.voxels.where("z = 3").select("seg_id", "y", "x", "v")


@query("SELECT seg_id, count(*) AS layers, cast(sum(n_px) AS bigint) AS bytes FROM manifest GROUP BY seg_id", uses="manifest")
def s11_segment_inventory(t):
    return raster.inventory(t.manifest.select("seg_id", "z", F.col("n_px").alias("length")))


@query("""SELECT seg_id FROM manifest GROUP BY seg_id HAVING count(*) = 7 AND min(n_px) > 100
AND seg_id IN (SELECT seg_id FROM voxels WHERE lbl > 0)""", uses="manifest")
def s12_complete_segments(t):
    files = t.manifest.select("seg_id", F.col("n_px").alias("length"))
    return raster.complete_segments(files, t.voxels.where("lbl > 0"), layers=7, least=100)


@query("SELECT seg_id, y, x, cast(trunc(p * 255) AS int) AS byte FROM prob", uses="prob")
def s15_map_bytes(t):
    return t.prob.select("seg_id", "y", "x", S.truncated_byte(F.col("p")).alias("byte"))


@query("SELECT seg_id, y, x, cast(trunc(p * 255) AS int) AS byte FROM prob WHERE trunc(p * 255) > 0", uses="prob")
def s16_map_images(t):
    """Maps as PNG images, and the places above 0 that the images hold."""
    pictures = raster.images(t.prob, raster.encode_png, "image")
    return raster.image_pixels(pictures, "image").where("v > 0").select("seg_id", "y", "x", F.col("v").cast("int").alias("byte"))


@query("SELECT seg_id, y, x, cast(trunc(p * 255) AS int) AS byte FROM prob WHERE trunc(p * 255) > 0", uses="prob")
def s16_strip_images(t):
    """Maps as TIFF files, put together from strips that tasks compress, and read again as layers."""
    path = work_path(t.spark, "images")
    strips.write_files(strips.tiff_pieces(block_stencil.map_blocks(t.prob, 16), 16), path).write.format("noop").mode("overwrite").save()
    files = t.spark.read.format("binaryFile").load(path)
    seg = F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("seg_id")
    return raster.image_pixels(files.select(seg, "content"), "content").where("v > 0").select("seg_id", "y", "x", F.col("v").cast("int").alias("byte"))


@query("""SELECT user_id % 20 AS run, max(value) AS best_score, arg_max(event_id, struct_pack(v := value, o := -event_id)) AS best, max(event_id) AS last FROM events GROUP BY user_id % 20""")
def s19_best_and_last_checkpoint(t):
    h = t.events.select((F.col("user_id") % 20).alias("run"), "event_id", "value")
    return metrics.best_and_last(h, "event_id", "value", ["run"])


@query("SELECT user_id % 20 AS run, event_id AS epoch, round(value, 6) AS val_f05 FROM events")
def s20_history_table(t):
    """The history of runs, added epoch by epoch in two goes, and read again."""
    path = work_path(t.spark, "history")
    h = t.events.select((F.col("user_id") % 20).alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("val_f05"))
    for half in (0, 1):
        metrics.append_history(h.where(F.col("epoch") % 2 == half), path)
    return metrics.read_history(t.spark, path, "run long, epoch long, val_f05 double").withColumn("val_f05", R("val_f05"))


@query("SELECT seg_id, y, x, max(v) > 0 AS mask FROM voxels GROUP BY seg_id, y, x", uses="voxels")
def p1_derived_mask(t):
    return reduce.derive_mask(t.voxels)


@query("SELECT seg_id, cast(y - 8 AS int) AS y, cast(x - 16 AS int) AS x, p FROM prob WHERE y >= 8 AND y < 40 AND x >= 16 AND x < 48", uses="prob")
def p2_f23_crop(t):
    return reduce.crop(t.prob, *reduce.parse_crop("8,40,16,48"))


@query(""", b AS (SELECT seg_id, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM prob WHERE p > 0.97 GROUP BY seg_id)
SELECT p.* FROM prob p JOIN b USING (seg_id) WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1""", uses="prob")
def p3_crop_to_mask(t):
    return reduce.crop_to_mask(t.prob, F.col("p") > 0.97)


@query("""SELECT seg_id, count(*) FILTER (p > 0.40) AS above_40, count(*) FILTER (p > 0.45) AS above_45, count(*) FILTER (p >= 0.5) AS from_50, count(*) FILTER (p > 0.5) AS above_50
FROM prob GROUP BY seg_id""", uses="prob")
def p4_p5_thresholds(t):
    n = lambda c: F.count_if(c)
    p = F.col("p")
    return t.prob.groupBy("seg_id").agg(n(p > 0.40).alias("above_40"), n(p > 0.45).alias("above_45"), n(p >= 0.5).alias("from_50"), n(p > 0.5).alias("above_50"))


@query("SELECT seg_id, y, x, t FROM labels_map WHERE t < 0.4 OR t > 0.6", uses="labels_map")
def p6_ignore_band(t):
    return t.labels_map.where(metrics.supervised(F.col("t")))


@query("SELECT id, area FROM candidates WHERE area BETWEEN 50 AND 8000", uses="candidates")
def p7_area_filter(t):
    return t.candidates.where(F.col("area").between(50, 8000)).select("id", "area")


@query("SELECT id, CASE WHEN mean_prob > 0.70 THEN 'HIGH' WHEN mean_prob >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM candidates", uses="candidates")
def p8_confidence_tier(t):
    return reduce.candidate_tiers(t.candidates).select("id", "tier")


@query("SELECT id FROM candidates WHERE mean_prob >= 0.45", uses="candidates")
def p9_matched_candidates(t):
    return reduce.candidate_tiers(t.candidates).where("tier <> 'LOW'").select("id")


@query("SELECT seg_id, y // 4 AS y, x // 4 AS x, p FROM prob WHERE y % 4 = 0 AND x % 4 = 0", uses="prob")
def p12_strided_map(t):
    return reduce.strided(t.prob, 4)


@query("SELECT seg_id, z // 2 AS z, y, x, v FROM voxels WHERE z >= 0 AND z < 6 AND z % 2 = 0", uses="voxels")
def p13_layer_range_and_step(t):
    return reduce.strided(t.voxels.where("z >= 0 and z < 6").select("seg_id", "z", "y", "x", "v"), 2, ("z",))


@query("""SELECT o.seg_id, o.y, o.x, round(least(greatest(0.3 * cast(n.p AS double) + 0.7 * o.p, 0), 1), 6) AS p
FROM prob o JOIN prob_next n ON o.seg_id = n.seg_id AND o.y = n.y AND o.x = n.x""", uses="prob prob_next")
def p14_p15_j10_blend(t):
    return reduce.blend(t.prob, t.prob_next, 0.3).withColumn("p", R("p"))


@query("""SELECT o.seg_id, o.y, o.x, round(0.7 * n.p + 0.3 * o.p, 6) AS soft, CASE WHEN m.mask THEN o.p ELSE 0 END AS masked, greatest(o.p, CASE WHEN n.p > 0.5 THEN 1 ELSE 0 END) AS overlay,
round(least(greatest(o.p + n.p * 0.65, 0), 1), 6) AS red, round(least(greatest(o.p - n.p * 0.30, 0), 1), 6) AS green, round(least(greatest(o.p - n.p * 0.30, 0), 1), 6) AS blue
FROM prob o JOIN prob_next n ON o.seg_id = n.seg_id AND o.y = n.y AND o.x = n.x
JOIN (SELECT seg_id, y, x, max(v) > 200 AS mask FROM voxels GROUP BY ALL) m ON m.seg_id = o.seg_id AND m.y = o.y AND m.x = o.x""", uses="prob prob_next")
def p16_p17_p18_composites(t):
    key = ["seg_id", "y", "x"]
    m = t.voxels.groupBy(*key).agg((F.max("v") > 200).alias("mask"))
    both = t.prob.join(t.prob_next.withColumnRenamed("p", "q"), key).join(m, key)
    return both.select(*key, R(0.7 * F.col("q") + 0.3 * F.col("p")).alias("soft"), F.when(F.col("mask"), F.col("p")).otherwise(0.0).alias("masked"), F.greatest("p", F.when(F.col("q") > 0.5, 1.0).otherwise(0.0)).alias("overlay"), *(R(c).alias(n) for n, c in reduce.tinted(F.col("p"), F.col("q")).items()))


@query("""SELECT 'axial' AS axis, seg_id, y AS a, x AS b, max(v) AS top, round(avg(v), 6) AS mean FROM voxels GROUP BY seg_id, y, x
UNION ALL SELECT 'coronal', seg_id, z, x, max(v), round(avg(v), 6) FROM voxels GROUP BY seg_id, z, x
UNION ALL SELECT 'sagittal', seg_id, z, y, max(v), round(avg(v), 6) FROM voxels GROUP BY seg_id, z, y""", uses="voxels")
def a1_projections(t):
    return reduce.projections(t.voxels).withColumn("mean", R("mean"))


@query(""", m AS (SELECT seg_id, y, x, max(v) AS mip, arg_max(z, v * 100 - z) AS depth FROM voxels GROUP BY seg_id, y, x),
c AS (SELECT seg_id, quantile_cont(mip, 0.8) AS cut FROM m GROUP BY seg_id)
SELECT seg_id, y, x, mip, CASE WHEN mip > cut THEN depth ELSE -1 END AS depth FROM m JOIN c USING (seg_id)""", uses="voxels")
def a2_depth_map(t):
    return reduce.depth_map(t.voxels).withColumn("depth", F.coalesce("depth", F.lit(-1)))


@query("SELECT seg_id, z, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS lo, max(v) AS hi FROM voxels GROUP BY seg_id, z", uses="voxels")
def a3_layer_stats(t):
    return reduce.layer_stats(t.voxels).withColumns({"mean": R("mean"), "std": R("std")})


@query(""", c AS (SELECT seg_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM voxels WHERE z = 0 GROUP BY seg_id)
SELECT seg_id, y, x, round(least(greatest((v - lo) / (hi - lo + 1e-8), 0), 1), 6) AS p FROM voxels JOIN c USING (seg_id) WHERE z = 0""", uses="voxels")
def a4_percentile_normalised(t):
    return reduce.percentile_normalised(t.voxels.where("z = 0").select("seg_id", "y", "x", "v"), "v").select("seg_id", "y", "x", R("p").alias("p"))


@query("SELECT seg_id, cast(least(floor((v - 0) / (255 / cast(64 AS double))), 63) AS int) AS bin, count(*) AS n FROM voxels GROUP BY ALL", uses="voxels")
def a5_histogram(t):
    return reduce.histogram(t.voxels, "v", 64, 0.0, 255.0)


@query("""SELECT seg_id, max(y) + 1 AS height, max(x) + 1 AS width, count(*) FILTER (v > 0) AS valid_px, round(count(*) FILTER (v > 0) / cast(count(*) AS double) * 100, 6) AS coverage_pct,
round(avg(v) FILTER (v > 0), 6) AS mean, round(stddev_pop(v) FILTER (v > 0), 6) AS std FROM voxels WHERE z = 3 GROUP BY seg_id""", uses="voxels")
def a6_segment_summary(t):
    return reduce.segment_summary(t.voxels, 3).withColumns({c: R(c) for c in ("coverage_pct", "mean", "std")})


@query(""", l AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS level)
SELECT seg_id, cast(level AS double) AS level, count(*) FILTER (p > level) AS n, round(count(*) FILTER (p > level) / cast(count(*) AS double) * 100, 6) AS pct FROM prob, l GROUP BY ALL""", uses="prob")
def a7_threshold_coverage(t):
    return reduce.threshold_coverage(t.prob).withColumn("pct", R("pct"))


@query("""SELECT 'row' AS axis, seg_id, y AS at, round(avg(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 6) AS density FROM prob GROUP BY seg_id, y
UNION ALL SELECT 'column', seg_id, x, round(avg(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 6) FROM prob GROUP BY seg_id, x""", uses="prob")
def a8_density(t):
    return reduce.density(t.prob).withColumn("density", R("density"))


@query("""SELECT a.seg_id, round(a.pct, 6) AS before_pct, round(b.pct, 6) AS after_pct
FROM (SELECT seg_id, avg(CASE WHEN p > 0.4 THEN 1 ELSE 0 END) * 100 AS pct FROM prob GROUP BY seg_id) a JOIN (SELECT seg_id, avg(CASE WHEN p > 0.4 THEN 1 ELSE 0 END) * 100 AS pct FROM prob_next GROUP BY seg_id) b USING (seg_id)""", uses="prob prob_next")
def a9_coverage_before_after(t):
    a, b = reduce.ink_coverage(t.prob, 0.4), reduce.ink_coverage(t.prob_next, 0.4)
    return a.select("seg_id", R("pct").alias("before_pct")).join(b.select("seg_id", R("pct").alias("after_pct")), "seg_id")


@query(""", d AS (SELECT o.seg_id, n.p - o.p AS d FROM prob o JOIN prob_next n ON o.seg_id = n.seg_id AND o.y = n.y AND o.x = n.x)
SELECT seg_id, round(avg(abs(d)), 6) AS mean_abs_diff, round(max(abs(d)), 6) AS max_abs_diff, round(sqrt(avg(d * d)), 6) AS rms_diff, round(avg(CASE WHEN d > 0.05 THEN 1 ELSE 0 END) * 100, 6) AS pixels_increased_pct,
round(avg(CASE WHEN d < -0.05 THEN 1 ELSE 0 END) * 100, 6) AS pixels_decreased_pct, round(avg(CASE WHEN abs(d) <= 0.05 THEN 1 ELSE 0 END) * 100, 6) AS pixels_unchanged_pct FROM d GROUP BY seg_id""", uses="prob prob_next")
def a10_j10_diff_stats(t):
    d = reduce.diff_stats(t.prob, t.prob_next)
    return d.select("seg_id", *(R(c).alias(c) for c in d.columns[1:]))


def _pixels(t):
    j = t.prob.join(t.labels_map, ["seg_id", "y", "x"]).join(reduce.derive_mask(t.voxels), ["seg_id", "y", "x"])
    return j.select("seg_id", "y", "x", "p", "t", "mask", S.logit(F.col("p")).alias("logit"), F.floor(F.col("y") / 16).cast("int").alias("batch"))


_PX = """, mk AS (SELECT seg_id, y, x, max(v) > 0 AS mask FROM voxels GROUP BY seg_id, y, x),
px AS (SELECT seg_id, y, x, p, t, mask, ln(q / (1 - q)) AS logit, 1 / (1 + exp(-ln(q / (1 - q)))) AS sg, y // 16 AS batch
  FROM (SELECT *, least(greatest(p, cast(0.01 AS double)), cast(0.99 AS double)) AS q FROM prob JOIN labels_map USING (seg_id, y, x) JOIN mk USING (seg_id, y, x)))
"""
_FB = """, c AS (SELECT {by} count(*) FILTER (p > {level} AND t > 0.5 AND {m}) AS tp, count(*) FILTER (p > {level} AND NOT t > 0.5 AND {m}) AS fp, count(*) FILTER (NOT p > {level} AND t > 0.5 AND {m}) AS fn FROM px {group}),
f AS (SELECT *, tp / (tp + fp + 1e-6) AS pr, tp / (tp + fn + 1e-6) AS re FROM c), g AS (SELECT *, 1.25 * pr * re / (0.25 * pr + re + 1e-6) AS fb FROM f)
"""


@query(_PX + _FB.format(by="seg_id, batch,", level=0.4, m="mask", group="GROUP BY seg_id, batch") + "SELECT seg_id, round(avg(fb), 6) AS f_beta, count(*) AS n FROM g GROUP BY seg_id", uses="prob labels_map")
def a11_f_beta_of_batches(t):
    f = metrics.f_beta(_pixels(t), ["seg_id", "batch"], F.col("p"), F.col("t"), mask=F.col("mask"))
    return metrics.mean_f_beta(f, ["seg_id"]).withColumn("f_beta", R("f_beta"))


@query(_PX + _FB.format(by="seg_id,", level=0.45, m="true", group="GROUP BY seg_id") + "SELECT seg_id, tp, fp, fn, round(fb, 6) AS f_beta FROM g", uses="prob labels_map")
def a12_f_beta_pooled(t):
    f = metrics.f_beta(_pixels(t), ["seg_id"], F.col("p"), F.col("t"), level=0.45)
    return f.select("seg_id", "tp", "fp", "fn", R("f_beta").alias("f_beta"))


_SUP = """, s AS (SELECT *, mask AND (t < 0.4 OR t > 0.6) AS m, greatest(logit, 0) - logit * t + ln(1 + exp(-abs(logit))) AS bce FROM px)
"""
_DICE = "(1 - (2 * sum(CASE WHEN m THEN sg * t ELSE 0 END) + 1e-6) / (sum(CASE WHEN m THEN sg ELSE 0 END) + sum(CASE WHEN m THEN t ELSE 0 END) + 1e-6))"


@query(_PX + _SUP + f"SELECT seg_id, count(*) FILTER (m) AS n, round(0.5 * avg(bce) FILTER (m) + 0.5 * {_DICE}, 6) AS loss FROM s GROUP BY seg_id", uses="prob labels_map")
def a13_masked_soft_loss(t):
    return metrics.masked_soft_loss(_pixels(t), ["seg_id"], F.col("logit"), F.col("t"), F.col("mask")).withColumn("loss", R("loss"))


@query(_PX + "SELECT seg_id, round(0.5 * avg(greatest(logit, 0) - logit * t + ln(1 + exp(-abs(logit)))) + 0.5 * (1 - (2 * sum(sg * t) + 1) / (sum(sg) + sum(t) + 1)), 6) AS loss FROM px GROUP BY seg_id", uses="prob labels_map")
def a14_hard_label_loss(t):
    return metrics.hard_loss(_pixels(t), ["seg_id"], F.col("logit"), F.col("t")).withColumn("loss", R("loss"))


@query(_PX + _SUP + f"""SELECT seg_id, count(*) FILTER (m) AS n, round(0.5 * avg((0.75 * t + 0.25 * (1 - t)) * pow(1 - (sg * t + (1 - sg) * (1 - t)), 2) * bce) FILTER (m) + 0.5 * {_DICE}, 6) AS loss FROM s GROUP BY seg_id""", uses="prob labels_map")
def a15_focal_loss(t):
    return metrics.masked_soft_loss(_pixels(t), ["seg_id"], F.col("logit"), F.col("t"), F.col("mask"), focal=True).withColumn("loss", R("loss"))


@query("SELECT c_nationkey AS line_id, median(h) AS median_h, median(w) AS median_w, count(*) AS n FROM (SELECT *, (cy - id % 7) // 20 AS c_nationkey FROM candidates) GROUP BY 1", uses="candidates")
def a17_median_sizes(t):
    c = t.candidates.withColumn("line_id", ((F.col("cy") - F.col("id") % 7) / 20).cast("long"))
    return c.groupBy("line_id").agg(F.median("h").alias("median_h"), F.median("w").alias("median_w"), F.count("*").alias("n"))


@query(""", c AS (SELECT CASE WHEN mean_prob > 0.70 THEN 'HIGH' WHEN mean_prob >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM candidates)
SELECT tier, count(*) AS n, round(count(*) / cast((SELECT count(*) FROM c) AS double) * 100, 6) AS pct FROM c GROUP BY tier""", uses="candidates")
def a18_tier_breakdown(t):
    return reduce.tier_breakdown(t.candidates).withColumn("pct", R("pct"))


@query("SELECT seg_id, y, cast(count(*) FILTER (p > 0.45) AS bigint) AS ink FROM prob GROUP BY seg_id, y", uses="prob")
def a22_row_profile(t):
    return reduce.row_profile(t.prob, 0.45)


@query("SELECT seg_id, y, x, round(avg(v), 6) AS mean, max(v) AS top, round(stddev_pop(v), 6) AS std FROM voxels GROUP BY seg_id, y, x", uses="voxels")
def a24_collapsed_layers(t):
    return reduce.collapse_layers(t.voxels).withColumns({"mean": R("mean"), "std": R("std")})


@query(_PX + _FB.format(by="seg_id,", level=0.4, m="mask", group="GROUP BY seg_id") + "SELECT round(avg(fb), 6) AS f_beta, count(*) AS n FROM g", uses="prob labels_map")
def a25_cross_segment_score(t):
    f = metrics.f_beta(_pixels(t), ["seg_id"], F.col("p"), F.col("t"), mask=F.col("mask"))
    return metrics.mean_f_beta(f, []).withColumn("f_beta", R("f_beta"))


@query(""", r AS (SELECT seg_id, list_sort(list(DISTINCT y)) AS ys FROM voxels WHERE v > 0 GROUP BY seg_id)
SELECT v.seg_id, z, x, v FROM voxels v JOIN r ON v.seg_id = r.seg_id AND v.y = r.ys[len(r.ys) // 2 + 1]""", uses="voxels")
def f29_middle_section(t):
    rows = reduce.middle_valid_row(t.voxels)
    return t.voxels.join(rows, ["seg_id", "y"]).select("seg_id", "z", "x", "v")


@query("""SELECT 'xz' AS plane, seg_id, z, x AS at, v FROM voxels WHERE y = 12 UNION ALL SELECT 'yz', seg_id, z, y, v FROM voxels WHERE x = 40""", uses="voxels")
def f29_cross_sections(t):
    xz = reduce.cross_section(t.voxels, y=12).select(F.lit("xz").alias("plane"), "seg_id", "z", F.col("x").alias("at"), "v")
    return xz.unionByName(reduce.cross_section(t.voxels, x=40).select(F.lit("yz").alias("plane"), "seg_id", "z", F.col("y").alias("at"), "v"))


@query(""", e AS (SELECT unnest(range(0, 60)) AS epoch)
SELECT epoch, round(CASE WHEN epoch < 5 THEN 0.001 * (epoch + 1) / 5 ELSE 0.001 * 0.5 * (1 + cos(3.141592653589793 * (epoch - 5) / 55)) END, 12) AS lr FROM e""".replace(", e AS", "WITH e AS", 1))
def w18_learning_rate(t):
    return t.spark.range(60).select(F.col("id").alias("epoch"), R(S.learning_rate(F.col("id")), 12).alias("lr"))


@query("""SELECT user_id % 20 AS run, event_id, value, value > coalesce(max(value) OVER (PARTITION BY user_id % 20 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_best FROM events""")
def w19_best_so_far(t):
    h = t.events.select((F.col("user_id") % 20).alias("run"), "event_id", "value")
    return metrics.best_so_far(h, "event_id", "value", ["run"])


@query(""", a AS (SELECT seg_id, y, x FROM prob WHERE p > 0.6), b AS (SELECT seg_id, y, x FROM prob_next WHERE p > 0.6),
i AS (SELECT * FROM a INTERSECT SELECT * FROM b), u AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT seg_id, (SELECT count(*) FROM i WHERE i.seg_id = u.seg_id) AS inter, count(*) AS union_px, round((SELECT count(*) FROM i WHERE i.seg_id = u.seg_id) / (count(*) + 1e-8), 6) AS iou FROM u GROUP BY seg_id""", uses="prob prob_next")
def u3_u6_pixel_set_iou(t):
    return metrics.set_iou(t.prob.where("p > 0.6"), t.prob_next.where("p > 0.6")).withColumn("iou", R("iou"))


@query("""SELECT seg_id, y, x, round(sum(e * v) / sum(e), 6) AS p FROM (SELECT *, exp(v / cast(64 AS double) - max(v / cast(64 AS double)) OVER (PARTITION BY seg_id, y, x)) AS e FROM voxels) GROUP BY seg_id, y, x""", uses="voxels")
def m8_attention_pool(t):
    return augment.attention_pool(t.voxels, F.col("v") / 64.0).withColumn("p", R("p"))


@query("SELECT user_id % 20 AS run, event_id, round(avg(value) OVER (PARTITION BY user_id % 20 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-9, 6) AS running_mean FROM events")
def t3_running_mean(t):
    h = t.events.select((F.col("user_id") % 20).alias("run"), "event_id", "value")
    return augment.running_mean(h, "event_id", "value", ["run"]).select("run", "event_id", R(F.col("running_mean") + 1e-9).alias("running_mean"))  # no ties to round


@query("SELECT seg_id, y, x, round(1 / (1 + exp(-(v - 128) / cast(32 AS double))), 6) AS p FROM voxels WHERE z = 0", uses="voxels")
def f1_sigmoid_map(t):
    return t.voxels.where("z = 0").select("seg_id", "y", "x", R(S.sigmoid((F.col("v") - 128) / 32.0)).alias("p"))


@query()
def f15_noisy_volume(t):
    v = t.voxels.select("seg_id", "z", "y", "x", (F.col("v") / 255.0).alias("v"))
    return augment.noisy(v, ["seg_id"]).withColumn("v", R("v"))
