"""Template matching, top-k, text lines and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import augment, bank_match, letterforms, lines, match
from ..session import written
from ..sources import raster
from .catalog import query

R = lambda c, n=6: F.round(c, n)
_SIDE = 8

_INKED = """, pt AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN cast(1 AS double) ELSE cast(0 AS double) END) AS c FROM patches),
tp AS (SELECT letter, list_transform(tpl, lambda v: CASE WHEN v > 0 THEN cast(1 AS double) ELSE cast(0 AS double) END) AS t FROM templates),
sums AS (SELECT id, letter, c, t, list_sum(c) AS sc, list_sum(t) AS st, list_inner_product(c, t) AS ct, len(c) AS n FROM pt, tp)
"""


def _patches(t):
    return t.patches.select(F.col("vec_id").alias("id"), S.ink(F.col("embedding")).alias("cand"))


def _bank(t):
    return t.templates.select(F.col("letter").cast("int").alias("ord"), "letter", S.ink(F.col("tpl")).alias("tpl"))


_CLI = _INKED + """, sc AS (SELECT id, letter, cast(0.5 AS double) * (ct - sc * st / n) / ((sqrt(greatest(sc - sc * sc / n, 0)) + 1e-6) * (sqrt(greatest(st - st * st / n, 0)) + 1e-6)) + cast(0.5 AS double) * ct / (sc + st - ct + 1e-6) AS score FROM sums)
"""


@query(_CLI + "SELECT id, letter, round(score, 6) AS score FROM sc", uses="patches templates")
def j3_f3_f4_f8_simple_scores(t):
    return match.simple_scores(_patches(t), _bank(t)).withColumn("score", R("score"))


@query(_CLI + """, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, letter) AS rank FROM sc), t5 AS (SELECT *, exp(10 * (score - max(score) OVER (PARTITION BY id))) AS e FROM k WHERE rank <= 5)
SELECT id, letter, cast(rank AS int) AS rank, round(e / (sum(e) OVER (PARTITION BY id) + 1e-9), 5) AS prob FROM t5""", uses="patches templates")
def o3_f2_softmax_top_letters(t):
    s = match.simple_scores(_patches(t), _bank(t))
    return match.softmax_top(s, "id", "letter", "score").withColumn("prob", R("prob", 5))


_DT = """, cellp AS (SELECT id, i, c[i + 1] AS v FROM pt, range(64) r(i)),
dtp AS (SELECT a.id, a.i, sqrt(min(pow(a.i // 8 - b.i // 8, 2) + pow(a.i % 8 - b.i % 8, 2))) AS d FROM cellp a JOIN cellp b ON a.id = b.id AND b.v > 0.5 GROUP BY ALL),
cellt AS (SELECT letter, i, t[i + 1] AS v FROM tp, range(64) r(i)),
dtt AS (SELECT a.letter, a.i, sqrt(min(pow(a.i // 8 - b.i // 8, 2) + pow(a.i % 8 - b.i % 8, 2))) AS d FROM cellt a JOIN cellt b ON a.letter = b.letter AND b.v > 0.5 GROUP BY ALL)
"""


@query(_INKED + _DT + "SELECT id, cast(i AS int) AS cell, round(d, 6) AS d FROM dtp", uses="patches templates")
def w10_distance_transform(t):
    d = match.distance_transform(_patches(t), "cand", _SIDE)
    return d.select("id", F.posexplode("dt").alias("cell", "d")).withColumn("d", R("d"))


def _hu(t):
    cells = match.patch_cells(_patches(t), "id", "cand", _SIDE)
    return match.hu_moments(cells, ["id"])


_POWERS = [(p, q) for p in range(4) for q in range(4) if p + q <= 3]
_HU = """, {n}ce AS (SELECT {key} AS k, cast(i // 8 AS double) AS y, cast(i % 8 AS double) AS x FROM {src} WHERE v > 0.5),
{n}m AS (SELECT k, """ + ", ".join(f"sum(pow(y, {p}) * pow(x, {q})) AS m{p}{q}" for p, q in _POWERS) + """ FROM {n}ce GROUP BY k),
{n}c AS (SELECT *, m10 / m00 AS cy, m01 / m00 AS cx FROM {n}m),
{n}e AS (SELECT k, (m20 - cy * m10) / pow(m00, 2.0) AS e20, (m02 - cx * m01) / pow(m00, 2.0) AS e02, (m11 - cx * m10) / pow(m00, 2.0) AS e11,
 (m30 - 3 * cy * m20 + 2 * cy * cy * m10) / pow(m00, 2.5) AS e30, (m03 - 3 * cx * m02 + 2 * cx * cx * m01) / pow(m00, 2.5) AS e03,
 (m21 - 2 * cy * m11 - cx * m20 + 2 * cy * cy * m01) / pow(m00, 2.5) AS e21, (m12 - 2 * cx * m11 - cy * m02 + 2 * cx * cx * m10) / pow(m00, 2.5) AS e12 FROM {n}c),
{n}a AS (SELECT *, e30 + e12 AS a, e21 + e03 AS b, e30 - 3 * e12 AS d, 3 * e21 - e03 AS f, e20 - e02 AS s FROM {n}e),
{n}h AS (SELECT k, [e20 + e02, s * s + 4 * e11 * e11, d * d + f * f, a * a + b * b, d * a * (a * a - 3 * b * b) + f * b * (3 * a * a - b * b), s * (a * a - b * b) + 4 * e11 * a * b,
 f * a * (a * a - 3 * b * b) - d * b * (3 * a * a - b * b)] AS h FROM {n}a),
{n}hu AS (SELECT k, list_transform(h, lambda z: -sign(z) * log10(abs(z) + 1e-15)) AS hu FROM {n}h)
"""
_HOLES = """, {n}ic AS (SELECT {key} AS k, i, i // 8 AS y, i % 8 AS x FROM {src} WHERE v > 0.5),
{n}ho AS (SELECT a.k, greatest(0, 1 - (count(*) - count(r.k) - count(d.k) + count(CASE WHEN r.k IS NOT NULL AND d.k IS NOT NULL THEN o.k END))) AS holes
 FROM {n}ic a LEFT JOIN {n}ic r ON r.k = a.k AND r.y = a.y AND r.x = a.x + 1 LEFT JOIN {n}ic d ON d.k = a.k AND d.y = a.y + 1 AND d.x = a.x LEFT JOIN {n}ic o ON o.k = a.k AND o.y = a.y + 1 AND o.x = a.x + 1 GROUP BY a.k)
"""


@query(_INKED + _DT + _HU.format(key="id", src="cellp", n="") + "SELECT k AS id, " + ", ".join(f"round(hu[{i}], 4) + 0.0 AS hu{i}" for i in range(1, 8)) + " FROM hu", uses="patches templates")
def a23_hu_moments(t):
    h = _hu(t)
    return h.select("id", *((R(f"hu{i}", 4) + 0.0).alias(f"hu{i}") for i in range(1, 8)))


def _matched(t, k: int):
    """Patches and templates by what they measure; expected holes are a table beside the bank, 0 where it has no row."""
    p = match.described(_patches(t), "id", "cand", _SIDE)
    b = match.described(_bank(t), "ord", "tpl", _SIDE)
    expected = b.where("holes > 0").select("letter", F.col("holes").alias("expected"))
    bank = match.with_expected(b.drop("holes"), expected)
    return match.match_letters(p, bank, _SIDE, k)


_ENSEMBLE = _INKED + _DT + _HU.format(key="id", src="cellp", n="p") + _HU.format(key="letter", src="cellt", n="t") + _HOLES.format(key="id", src="cellp", n="p") + _HOLES.format(key="letter", src="cellt", n="t") + """, fw AS (SELECT p.id, d.letter, avg(d.d) AS f FROM cellp p JOIN dtt d ON d.i = p.i WHERE p.v > 0.5 GROUP BY ALL), bw AS (SELECT d.id, c.letter, avg(d.d) AS b FROM cellt c JOIN dtp d ON d.i = c.i WHERE c.v > 0.5 GROUP BY ALL),
en AS (SELECT id, letter, (f + b) / (8 * cast(1.41421 AS double)) / 2 AS chamfer, (ct - sc * st / n) / (sqrt((sc - sc * sc / n) * (st - st * st / n)) + 1e-8) * 0.5 + 0.5 AS ncc, ct / (sc + st - ct + 1e-8) AS iou,
 list_sum(list_transform(range(1, 8), lambda i: abs(phu.hu[i] - thu.hu[i]))) / 7 AS hu_dist, pho.holes AS holes, tho.holes AS expected
 FROM sums JOIN fw USING (id, letter) JOIN bw USING (id, letter) JOIN phu ON phu.k = id JOIN thu ON thu.k = letter JOIN pho ON pho.k = id JOIN tho ON tho.k = letter),
es AS (SELECT *, cast(0.40 AS double) * greatest(0, 1 - least(chamfer, 0.5) * 2) + cast(0.35 AS double) * ncc + cast(0.25 AS double) * iou + CASE WHEN abs(holes - expected) <= 1 THEN cast(0.06 AS double) ELSE 0 END AS score FROM en),
er AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, letter) AS rank FROM es)
"""


@query(_ENSEMBLE + "SELECT id, letter, cast(rank AS int) AS rank, round(score, 6) AS score, round(chamfer, 6) AS chamfer, round(ncc, 6) AS ncc, round(iou, 6) AS iou, round(hu_dist, 4) AS hu_dist FROM er WHERE rank <= 3", uses="patches templates")
def x1_f5_f6_f7_j9_o2_ensemble_matcher(t):
    return _matched(t, 3).select("id", "letter", "rank", *(R(c).alias(c) for c in ("score", "chamfer", "ncc", "iou")), R("hu_dist", 4).alias("hu_dist"))


@query()
def x1_f11_j9_rendered_letters(t):
    """The three best letters of each patch among templates drawn from strokes in three sizes and three styles."""
    # a patch is small beside the work on it, so patches are dealt out, however few files hold them
    dealt = _patches(t).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "id")
    p = dealt.withColumns({"h": F.lit(_SIDE), "w": F.lit(_SIDE)})
    found = bank_match.match_patches(p, written(letterforms.bank(t.spark), "bank"), 3)
    return found.select("id", "letter", "rank", "size", "style", *(R(c).alias(c) for c in ("score", "chamfer", "ncc", "iou")), R("hu_dist", 4).alias("hu_dist"))


@query("SELECT id, area FROM candidates ORDER BY area DESC, id LIMIT 60", uses="candidates")
def o1_largest_candidates(t):
    return t.candidates.select("id", "area").orderBy(F.desc("area"), "id").limit(60)


@query("""SELECT seg_id, size_gb FROM (SELECT seg_id, round(sum(n_px) / 1e9, 9) AS size_gb FROM manifest GROUP BY seg_id) ORDER BY size_gb, seg_id LIMIT 2""", uses="manifest")
def o8_smallest_segments(t):
    return t.manifest.groupBy("seg_id").agg(R(S.gigabytes(F.sum("n_px")), 9).alias("size_gb")).orderBy("size_gb", "seg_id").limit(2)


@query("SELECT seg_id, max(z) AS version FROM manifest GROUP BY seg_id", uses="manifest")
def o9_latest_version(t):
    return raster.latest_version(t.manifest.withColumnRenamed("z", "version"))


_LINES = """, md AS (SELECT median(h) AS mh FROM candidates), yy AS (SELECT cast(cy AS double) AS y, row_number() OVER (ORDER BY cy) AS n FROM (SELECT DISTINCT cy FROM candidates)),
fold AS (SELECT n, y, y AS anchor, 0 AS line_id FROM yy WHERE n = 1 UNION ALL SELECT yy.n, yy.y, CASE WHEN yy.y - f.anchor > 1.5 * mh THEN yy.y ELSE f.anchor END, CASE WHEN yy.y - f.anchor > 1.5 * mh THEN f.line_id + 1 ELSE f.line_id END FROM fold f JOIN yy ON yy.n = f.n + 1, md),
ln AS (SELECT c.*, f.line_id, row_number() OVER (PARTITION BY f.line_id ORDER BY cx, id) AS pos_in_line FROM candidates c JOIN fold f ON f.y = c.cy)
"""


def _lined(t):
    return lines.text_lines(t.candidates)


@query(_LINES + "SELECT id, line_id, cast(pos_in_line AS int) AS pos_in_line FROM ln", uses="candidates", recursive=True)
def w11_w14_o4_text_lines(t):
    return _lined(t).select("id", "line_id", "pos_in_line")


_GAPS = _LINES + """, wd AS (SELECT line_id, median(w) AS mw FROM ln GROUP BY line_id), pv AS (SELECT *, lag(cx) OVER (PARTITION BY line_id ORDER BY cx, id) AS prev_x FROM ln),
gp AS (SELECT line_id, id, prev_x, cx, cx - prev_x AS gap, greatest(1, cast(round_even((cx - prev_x) / mw, 0) AS int) - 1) AS missing FROM pv JOIN wd USING (line_id) WHERE cx - prev_x > 2.5 * mw)
"""


@query(_GAPS + "SELECT * FROM gp", uses="candidates", recursive=True)
def w12_gaps(t):
    return lines.gaps(_lined(t))


@query(_GAPS + """, m AS (SELECT line_id, bool_or(mean_prob >= 0.45 AND mean_prob <= 0.70) AS medium FROM ln GROUP BY line_id)
SELECT line_id, medium, line_id IN (SELECT line_id FROM gp) AS gap FROM m WHERE medium OR line_id IN (SELECT line_id FROM gp)""", uses="candidates", recursive=True)
def p10_active_lines(t):
    return lines.active_lines(_lined(t))


@query(_LINES + ", n AS (SELECT line_id, count(*) AS n FROM ln GROUP BY line_id) SELECT min(n) AS least, median(n) AS median, max(n) AS most, count(*) AS lines FROM n", uses="candidates", recursive=True)
def a19_candidates_per_line(t):
    return lines.line_size_summary(_lined(t))


@query(_LINES + "SELECT line_id, cast((row_number() OVER (ORDER BY line_id) - 1) // 5 AS int) AS batch FROM (SELECT DISTINCT line_id FROM ln)", uses="candidates", recursive=True)
def o7_line_batches(t):
    return lines.batches(_lined(t).select("line_id").distinct())


@query(_LINES + "SELECT id, line_id, round(cx / cast(1000 AS double), 6) AS pos FROM ln WHERE line_id < 3", uses="candidates", recursive=True)
def o5_f24_first_lines(t):
    return _lined(t).where("line_id < 3").select("id", "line_id", R(F.col("cx") / F.greatest(F.lit(1000), F.lit(1))).alias("pos"))


@query(""", r AS (SELECT c.id, c.area, row_number() OVER (PARTITION BY c.id ORDER BY l) AS k, l, (c.id % 7 + l) / cast(10 AS double) AS p FROM candidates c, range(3) t(l) WHERE c.id % 4 <> l)
SELECT id, area, id % 50 AS y0, id % 50 AS x0, id % 50 + 8 AS y1, id % 50 + 8 AS x1, """ + ", ".join(f"coalesce(max('L' || l) FILTER (k = {i}), '') AS top{i}_letter, coalesce(max(printf('%.3f', p)) FILTER (k = {i}), '') AS top{i}_conf" for i in (1, 2, 3)) + " FROM r GROUP BY id, area", uses="candidates")
def s17_candidates_table(t):
    c = t.candidates
    y = F.col("id") % 50
    of = F.filter(F.array(*(F.when(F.col("id") % 4 != l, F.struct(F.lit(f"L{l}").alias("letter"), ((F.col("id") % 7 + l) / 10.0).alias("prob"))) for l in range(3))), lambda m: m.isNotNull())  # noqa: E741
    return raster.candidates_wide(c.select("id", "area", y.alias("y0"), y.alias("x0"), (y + 8).alias("y1"), (y + 8).alias("x1"), of.alias("matches")), 3)


@query()
def w9_f9_f10_normalised_patches(t):
    """Stroke-normalised patches, fitted to 16 x 16 squares, and the same cut to their middle 10 x 10; the ink of each."""
    fit = match.patch_udf(lambda img: match.fitted(match.stroke_normalised(img), 16), 16)
    cut = match.patch_udf(lambda img: match.centre_crop(img, 10), 10)
    p = _patches(t).withColumn("fitted", fit("cand", F.lit(_SIDE), F.lit(_SIDE))).withColumn("middle", cut("fitted", F.lit(16), F.lit(16)))
    return p.select("id", S.array_sum(F.col("fitted")).alias("ink"), S.array_sum(F.col("middle")).alias("middle_ink"))


@query(_INKED + "SELECT id, CASE WHEN j // 12 BETWEEN 2 AND 9 AND j % 12 BETWEEN 2 AND 9 THEN c[(j // 12 - 2) * 8 + j % 12 - 1] ELSE 0 END AS padded, CASE WHEN j < 25 THEN c[(j // 5 + 1) * 8 + j % 5 + 2] END AS cut, cast(j AS int) AS cell FROM pt, range(144) r(j)", uses="patches templates")
def f10_centred_patches(t):
    """8 x 8 patches padded to 12 x 12 and cut to 5 x 5, the middle kept."""
    to = lambda n: match.patch_udf(lambda img: match.centre_crop(img, n), n)
    p = _patches(t).select("id", to(12)("cand", F.lit(_SIDE), F.lit(_SIDE)).alias("wide"), to(5)("cand", F.lit(_SIDE), F.lit(_SIDE)).alias("small"))
    return p.select("id", "small", F.posexplode("wide").alias("cell", "padded")).select("id", "cell", "padded", F.when(F.col("cell") < 25, F.get("small", F.col("cell"))).alias("cut"))


@query(_LINES + "SELECT line_id, round(avg(cy), 6) AS line_y, median(h) AS median_h, median(w) AS median_w, count(*) AS n FROM ln GROUP BY line_id", uses="candidates", recursive=True)
def a17_line_stats(t):
    return lines.line_stats(_lined(t)).withColumn("line_y", R("line_y"))


@query()
def f16_f17_changed_patches(t):
    """Patches bent, moved, blurred and holed, and the sum of each."""
    change = augment.patch_change(augment.elastic, augment.moved, lambda img, _: augment.blurred(img), augment.holes)
    p = _patches(t).withColumn("new", change("cand", F.lit(_SIDE), F.lit(_SIDE), F.col("id")))
    return p.select("id", R(S.array_sum(F.col("new"))).alias("total"))
