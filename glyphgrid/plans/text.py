"""Prompts, answers, predictions and the whole refinement step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lines, match, refine, responses
from ..session import work_path, written
from ..sources import raster
from .catalog import query
from .letters import _GAPS, _LINES, _SIDE, _bank, _lined

R = lambda c, n=6: F.round(c, n)


def _preds(t):
    return t.predictions.select(F.col("event_id").alias("pid"), "line_id", "pos", "conf", "source")


@query("SELECT source, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM predictions GROUP BY source", uses="predictions")
def a20_result_counters(t):
    return responses.result_counters(t.predictions).withColumn("mean_conf", R("mean_conf"))


@query(_GAPS + """SELECT line_id, cast(pos_in_line * 2 - 1 AS int) AS ord, printf('  pos %.3f: GAP  (~%d char missing)', (g.prev_x + g.cx) / cast(2 AS double) / 1000, missing) AS entry FROM gp g JOIN (SELECT id, pos_in_line FROM ln) USING (id)""", uses="candidates", recursive=True)
def f18_gap_entries(t):
    return lines.prompt_entries(_lined(t), None, 1000)


_MATCHES = """, mt AS (SELECT id, k + 1 AS rank, 'L' || ((id + k) % 24) AS letter, (id % 5 + 3 - k) / cast(10 AS double) AS score FROM candidates, range(3) r(k)),
sm AS (SELECT *, exp(8 * (score - max(score) OVER (PARTITION BY id))) AS e FROM mt), pb AS (SELECT *, e / (sum(e) OVER (PARTITION BY id) + 1e-9) AS pr FROM sm),
ch AS (SELECT id, string_agg(letter || ' ' || printf('%.2f', pr), ' | ' ORDER BY rank) AS choices, max(letter) FILTER (rank = 1) AS top, max(score) FILTER (rank = 1) AS top_score FROM pb GROUP BY id),
en AS (SELECT line_id, pos_in_line * 2 - 1 AS ord, printf('  pos %.3f: GAP  (~%d char missing)', (g.prev_x + g.cx) / cast(2 AS double) / 1000, missing) AS entry FROM gp g JOIN (SELECT id, pos_in_line FROM ln) USING (id)
 UNION ALL SELECT line_id, pos_in_line * 2, CASE WHEN mean_prob > 0.70 THEN printf('  pos %.3f: HIGH → %s  (score %.2f)', cx / cast(1000 AS double), top, top_score) ELSE printf('  pos %.3f: MED  → %s', cx / cast(1000 AS double), choices) END FROM ln JOIN ch USING (id) WHERE mean_prob >= 0.45),
pm AS (SELECT line_id, 'Line ' || line_id || ':' || chr(10) || string_agg(entry, chr(10) ORDER BY ord) AS prompt FROM en GROUP BY line_id)
"""


def _matches(t):
    c = t.candidates.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return c.select("id", (F.col("k") + 1).alias("rank"), F.concat(F.lit("L"), ((F.col("id") + F.col("k")) % 24).cast("string")).alias("letter"), ((F.col("id") % 5 + 3 - F.col("k")) / 10.0).alias("score"))


@query(_GAPS + _MATCHES + "SELECT line_id, prompt FROM pm", uses="candidates", recursive=True)
def f18_line_prompts(t):
    return lines.line_prompts(lines.prompt_entries(_lined(t), _matches(t), 1000))


@query(_GAPS + _MATCHES + ", b AS (SELECT *, (row_number() OVER (ORDER BY line_id) - 1) // 5 AS batch FROM pm) SELECT cast(batch AS int) AS batch, string_agg(prompt, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY line_id) AS message FROM b GROUP BY batch", uses="candidates", recursive=True)
def o7_f18_batch_messages(t):
    return lines.batch_prompts(lines.line_prompts(lines.prompt_entries(_lined(t), _matches(t), 1000))).select("batch", "message")


def _answers(t):
    """One answer for every five lines, with fewer blocks than lines in each third and more in each fourth."""
    p = t.predictions.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("event_id", R("pos", 3).alias("pos"), R("conf", 3).alias("conf"), "source"))).alias("ps"))
    one = F.transform("ps", lambda q: F.format_string('{"pos": %s, "char": "x", "conf": %s, "source": "%s"}', S.fixed(q["pos"], 3), S.fixed(q["conf"], 3), q["source"]))
    b = p.select("line_id", F.concat(F.lit('```json\n{"line_id": '), F.col("line_id").cast("string"), F.lit(', "positions": ['), F.array_join(one, ", "), F.lit("]}\n```")).alias("block"))
    g = b.withColumn("batch", F.floor(F.col("line_id") / 5).cast("int")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("line_id", "block"))).alias("bs"))
    blocks = F.transform("bs", lambda x: x["block"])
    cut = F.when(F.col("batch") % 3 == 2, F.slice(blocks, 1, 3)).when(F.col("batch") % 4 == 1, F.concat(blocks, F.array(F.lit("surplus")))).otherwise(blocks)
    return g.select("batch", F.transform("bs", lambda x: x["line_id"]).alias("line_ids"), F.array_join(cut, "\n---\n").alias("raw"), F.lit(None).cast("string").alias("error"))


@query(""", p AS (SELECT line_id, count(*) AS n, round(sum(round(pos, 3)), 3) AS pos FROM predictions GROUP BY line_id),
o AS (SELECT *, row_number() OVER (PARTITION BY line_id // 5 ORDER BY line_id) AS k FROM p)
SELECT line_id, n, pos FROM o WHERE (line_id // 5) % 3 <> 2 OR k <= 3""", uses="predictions")
def j5_j6_f19_f20_parsed_answers(t):
    preds = responses.predictions(responses.blocks(_answers(t)))
    return preds.groupBy("line_id").agg(F.count("*").alias("n"), R(F.sum("pos"), 3).alias("pos"))


def _moody():
    """Stands in for a language model that fails on every third batch."""

    def ask(message: str) -> str:
        if int(message) % 3 == 2:
            raise TimeoutError(f"no answer to {message}")
        return '{"positions": []}'

    return ask


@query("""SELECT batch, line_id, CASE WHEN batch % 3 = 2 THEN 'no answer to ' || batch END AS error, CASE WHEN batch % 3 <> 2 THEN CASE WHEN line_id % 5 = 0 THEN '{"positions": []}' ELSE '{}' END END AS block
FROM (SELECT DISTINCT line_id, line_id // 5 AS batch FROM predictions)""", uses="predictions")
def x3_answers_and_errors(t):
    """A completer's errors stay with their lines; the others go on, and lines without a block of their own get {}."""
    b = t.predictions.select("line_id", F.floor(F.col("line_id") / 5).cast("int").alias("batch")).distinct().groupBy("batch").agg(F.array_sort(F.collect_list("line_id")).alias("line_ids"))
    got = responses.complete(b.select("batch", "line_ids", F.col("batch").cast("string").alias("message")), _moody)
    return responses.blocks(got).select(F.floor(F.col("line_id") / 5).cast("int").alias("batch"), "line_id", "error", "block")


@query("SELECT doc_id, 0 AS n FROM documents")
def f20_malformed_answers(t):
    return t.documents.select("doc_id", F.size(responses.positions(F.col("text"))).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(pos, 3) ELSE 0 END AS pos, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '?' END AS "char",
CASE WHEN event_id % 5 = 0 THEN round(conf, 3) ELSE 0.5 END AS conf, CASE WHEN event_id % 7 = 0 THEN source ELSE 'llm_gap' END AS source FROM predictions""", uses="predictions")
def f21_defaults_of_fields(t):
    """Answers of one position each, which lack some of their fields."""
    has = lambda n: F.col("event_id") % n == 0
    fields = F.concat_ws(
        ", ",
        F.when(has(2), F.format_string('"pos": %s', S.fixed(R("pos", 3), 3))), F.when(has(3), F.lit('"char": "x"')),
        F.when(has(5), F.format_string('"conf": %s', S.fixed(R("conf", 3), 3))), F.when(has(7), F.format_string('"source": "%s"', F.col("source"))),
    )
    one = t.predictions.select(F.col("event_id").alias("line_id"), F.concat(F.lit('{"positions": [{'), fields, F.lit("}]}")).alias("block"))
    return responses.predictions(one).select(F.col("line_id").alias("event_id"), "pos", "char", "conf", "source")


_NEAR = _LINES + """, st AS (SELECT line_id, avg(cy) AS line_y, median(h) AS char_h FROM ln GROUP BY line_id),
un AS (SELECT line_id, cx, min(id) AS ord, max(id) AS id FROM ln GROUP BY line_id, cx),
pr AS (SELECT event_id AS pid, line_id, pos, conf, source FROM predictions),
mt AS (SELECT pid, un.id AS cand_id, abs(un.cx / cast(1000 AS double) - pos) * 1000 AS d, ord FROM pr JOIN un USING (line_id) JOIN st USING (line_id) WHERE abs(un.cx / cast(1000 AS double) - pos) * 1000 < char_h * 0.6),
bs AS (SELECT pid, cand_id, d FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, ord) AS k FROM mt) WHERE k = 1)
"""


@query(_NEAR + "SELECT pr.pid, pr.line_id, round(pos * 1000, 4) AS pos_x, round(line_y, 4) AS pos_y, coalesce(cand_id, -1) AS cand_id, coalesce(round(d, 4), -1) AS distance FROM pr JOIN st USING (line_id) LEFT JOIN bs USING (pid)", uses="candidates predictions", recursive=True)
def j4_nearest_candidates(t):
    n = responses.nearest_candidates(_preds(t), _lined(t), 1000)
    return n.select("pid", "line_id", R("pos_x", 4).alias("pos_x"), R("pos_y", 4).alias("pos_y"), F.coalesce("cand_id", F.lit(-1)).alias("cand_id"), F.coalesce(R("distance", 4), F.lit(-1.0)).alias("distance"))


_PAINT = """, pr AS (SELECT event_id, source, conf, CASE WHEN source = 'llm_med' AND event_id % 3 = 0 THEN true ELSE false END AS boxed,
 cast(least(greatest(round_even(event_id % 1300 / cast(20 AS double), 0), 0), 63) AS int) AS cy, cast(least(greatest(round_even(pos * 64, 0), 0), 63) AS int) AS cx, CASE cast(event_id % 3 AS int) WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS seg_id
 FROM predictions WHERE source <> 'anchor'),
px AS (SELECT pr.seg_id, cy + dy AS y, cx + dx AS x, exp(-(dy * dy + dx * dx) / (2 * pow(12 / cast(2.5 AS double), 2))) * conf * 0.75 AS v FROM pr, range(-12, 13) a(dy), range(-12, 13) b(dx) WHERE NOT boxed
 UNION ALL SELECT pr.seg_id, y, x, least(0.90, conf) FROM pr, range(64) a(y), range(64) b(x) WHERE boxed AND y >= cy - 3 AND y < cy + 4 AND x >= cx - 2 AND x < cx + 3),
mx AS (SELECT seg_id, y, x, max(v) AS v FROM px GROUP BY ALL)
SELECT p.seg_id, p.y, p.x, round(least(greatest(greatest(p.p, coalesce(mx.v, p.p)), 0), 1), 6) AS p FROM prob p LEFT JOIN mx ON mx.seg_id = p.seg_id AND mx.y = p.y AND mx.x = p.x"""


@query(_PAINT, uses="prob predictions")
def j8_f12_f13_f26_painted_map(t):
    p = t.predictions.withColumn("seg_id", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("event_id") % 3 + 1).cast("int")))
    p = p.withColumns({"pos_y": F.col("event_id") % 1300 / 20.0, "pos_x": F.col("pos") * 64})
    cy, cx = S.clamp_pixel(F.col("pos_y"), 64), S.clamp_pixel(F.col("pos_x"), 64)
    box = F.col("event_id") % 3 == 0
    p = p.select("seg_id", "pos_y", "pos_x", "conf", "source", *(F.when(box, c).alias(n) for n, c in (("y0", cy - 3), ("x0", cx - 2), ("y1", cy + 4), ("x1", cx + 3))))
    return responses.paint(t.prob, p).withColumn("p", R("p"))


def _first_choice():
    """Stands in for a language model: answers each line with its first gap."""

    def ask(message: str) -> str:
        import json
        import re

        out = []
        for block in message.split("\n\n---\n\n"):
            found = re.search(r"pos (\d\.\d+): GAP", block)
            out.append(json.dumps({"positions": [{"pos": float(found[1]), "char": "?", "conf": 0.6, "source": "llm_gap"}] if found else []}))
        return "\n---\n".join(out)

    return ask


def _matcher(t, size: int = 16, k: int = 3):
    """Matches candidates with the bank of templates, fitted like them; the holes expected are those of each template."""
    fit = match.patch_udf(lambda img: match.fitted(img, size), size)
    bank = _bank(t).select("ord", F.col("letter").cast("string").alias("letter"), fit("tpl", F.lit(_SIDE), F.lit(_SIDE)).alias("tpl"))
    bank = written(match.described(bank, "ord", "tpl", size).withColumnRenamed("holes", "expected"), "bank")

    def find(candidates: DataFrame, labelled: DataFrame) -> DataFrame:
        cut = match.candidate_patches(candidates, labelled, size).select(F.concat_ws(":", "seg_id", "id").alias("id"), "cand")
        found = match.match_letters(match.described(written(cut, "patches"), "id", "cand", size), bank, size, k)
        part = lambda n: F.regexp_extract("id", r"(?s)^(.*):(\d+)$", n)
        return found.withColumn("seg_id", part(1)).withColumn("id", part(2).cast("long"))

    return find


def _refined(t, steps: int = 1):
    """The loop over all segments, letters matched and gaps filled; its maps and its log are written and read again."""
    cfg = refine.RefinementConfig(max_iterations=steps, level=0.5, min_area=4, max_area=800)
    maps, log = work_path(t.spark, "maps"), work_path(t.spark, "log")
    out = refine.refine(t.spark, t.prob, 64, config=cfg, complete=_first_choice, match=_matcher(t), maps=maps, log=log)
    return out, maps, log


@query()
def t5_s15_refinement_step(t):
    """One step of the loop on all segments at once; the newest maps, as they are stored."""
    _, maps, _ = _refined(t)
    stored = raster.read_versions(t.spark, maps)
    newest = raster.latest_version(stored.select("seg_id", "version"))
    return stored.join(newest, ["seg_id", "version"]).select("seg_id", "y", "x", R("p").alias("p"))


@query("SELECT seg_id, 1 AS iteration, cast(0.3 AS double) AS alpha, true AS stamped FROM prob GROUP BY seg_id", uses="prob")
def s18_f25_refinement_log(t):
    """The entries of the loop's log, read again, with whether each has a time in UTC."""
    _, _, log = _refined(t)
    got = raster.read_log(t.spark, log, "iteration int, seg_id string, alpha double, timestamp string")
    return got.select("seg_id", "iteration", "alpha", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))
