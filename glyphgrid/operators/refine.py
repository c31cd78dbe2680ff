"""The label refinement loop: filter, find letters, fill gaps, blend, measure, until the map settles."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written
from ..sources import raster
from . import graph, lines, reduce, responses, stencil


@dataclass(frozen=True)
class RefinementConfig:
    """Parameters of the loop. compare_previous: measure change against the map of one step before (True), or, from the second
    step on, of two steps before."""

    max_iterations: int = 4
    alphas: tuple[float, ...] = (0.3, 0.4, 0.5, 0.5)
    level: float = 0.40
    min_area: int = 50
    max_area: int = 8000
    median_radius: int = 1
    batch_size: int = 5
    settled: float = 0.01
    time_budget_s: float | None = None
    compare_previous: bool = False
    enhance: Callable[[DataFrame], DataFrame] | None = stencil.equalised
    train: Callable[[int, DataFrame], None] | None = None


@dataclass
class RefinementResult:
    labels: DataFrame
    log: list[dict] = field(default_factory=list)


def letter_candidates(prob: DataFrame, width: int, *, level: float, min_area: int, max_area: int, close: int = 2) -> tuple[DataFrame, DataFrame]:
    """(candidates, labelled pixels): closed ink above the level, 4-connected, of a permitted area."""
    ext = stencil.extents(prob)
    ink = stencil.closing(prob.where(F.col("p") > level), ext, close)
    labelled = graph.remove_small(graph.label_components(ink, width), min_area)
    props = graph.component_properties(labelled, prob).where(F.col("area") <= max_area)
    c = props.select("seg_id", F.col("label").alias("id"), "area", "y0", "x0", "y1", "x1", F.col("cy"), F.col("cx"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"), "mean_prob")
    return c, labelled


_PAGE = ["seg_id"]


def _step(now: DataFrame, width: int, step: int, cfg: RefinementConfig, complete, match) -> tuple[DataFrame, dict[str, dict]]:
    """The blended maps of all segments after one step, and of each segment its counts."""
    alpha = cfg.alphas[min(step - 1, len(cfg.alphas) - 1)]
    clean = written(stencil.filtered(now, radius=cfg.median_radius, level=cfg.level, enhance=cfg.enhance), f"filtered-{step}")
    cands, labelled = letter_candidates(clean, width, level=cfg.level, min_area=cfg.min_area, max_area=cfg.max_area)
    cands = written(cands, f"candidates-{step}")
    lined = lines.text_lines(cands, _PAGE)
    counts = lined.groupBy("seg_id").agg(F.count("*").alias("n_candidates"), F.countDistinct("line_id").alias("n_lines"), F.lit(0).cast("long").alias("n_llm_results"))
    updated = clean
    if complete is not None:
        letters = match(cands.where(S.tier(F.col("mean_prob")) != "LOW"), labelled) if match else None
        active = lines.active_lines(lined, _PAGE).select("seg_id", "line_id")
        prompts = lines.line_prompts(lines.prompt_entries(lined, letters, width, _PAGE), _PAGE).join(active, ["seg_id", "line_id"])
        answers = written(responses.complete(lines.batch_prompts(prompts, cfg.batch_size, _PAGE), complete, _PAGE), f"answers-{step}")
        blocks = responses.blocks(answers, _PAGE)
        counts = counts.drop("n_llm_results").join(blocks.groupBy("seg_id").agg(F.count("*").alias("n_llm_results")), "seg_id", "left")
        preds = responses.predictions(blocks.where("error is null"), by=_PAGE).withColumn("pid", F.concat_ws(":", "line_id", "ord"))
        near = responses.nearest_candidates(preds, lined, width, by=_PAGE)
        box = cands.select("seg_id", F.col("id").alias("cand_id"), "y0", "x0", "y1", "x1")
        updated = responses.paint(clean, near.join(box, ["seg_id", "cand_id"], "left").select("seg_id", "pos_y", "pos_x", "conf", "source", "y0", "x0", "y1", "x1"))
    blended = written(reduce.blend(now, updated, alpha), f"labels-{step}")
    found = {r["seg_id"]: r.asDict() for r in counts.na.fill(0).collect()}  # a row for each segment
    return blended, {s: {"alpha": alpha, **{k: r[k] for k in ("n_candidates", "n_lines", "n_llm_results")}} for s, r in found.items()}


def refine(spark: SparkSession, labels: DataFrame, width: int, *, seg_id: str | None = None, config: RefinementConfig | None = None, complete: Callable[[], Callable[[str], str]] | None = None, match: Callable[[DataFrame, DataFrame], DataFrame] | None = None, maps: str | None = None, log: str | None = None) -> RefinementResult:
    """Refines the maps (seg_id, y, x, p) of all segments, or of one, in steps that take all of them at once; a segment whose
    map has settled takes no further part.

    complete: loads a text completer; without one, no gaps are filled. match: letters of candidates of medium or high
    confidence, (candidates, labelled) to (seg_id, id, letter, rank, score). maps, log: where each step's maps, by version,
    and its log entries are added. Every step's maps are also written to the shared folder.
    """
    cfg = config or RefinementConfig()
    began = time.monotonic()
    own = labels if seg_id is None else labels.where(F.col("seg_id") == seg_id)
    now = written(own.select("seg_id", "y", "x", "p"), "labels-0")
    before, settled = now, []
    out = RefinementResult(now)
    for step in range(1, cfg.max_iterations + 1):
        blended, counts = _step(now, width, step, cfg, complete, match)
        stats = [r.asDict() for r in reduce.diff_stats(now if cfg.compare_previous else before, blended).orderBy("seg_id").collect()]  # a row for each segment
        none = {"alpha": cfg.alphas[min(step - 1, len(cfg.alphas) - 1)], "n_candidates": 0, "n_lines": 0, "n_llm_results": 0}
        entries = [{"iteration": step, "seg_id": r["seg_id"], **counts.get(r["seg_id"], none), **{k: v for k, v in r.items() if k != "seg_id"}} for r in stats]
        out.log += entries
        if maps is not None:
            raster.write_map(blended, maps, step)
        if log is not None:
            raster.append_log(spark, log, entries)
        if cfg.train is not None:
            cfg.train(step, blended)
        calm = [r["seg_id"] for r in stats if r["mean_abs_diff"] < cfg.settled]
        late = cfg.time_budget_s is not None and time.monotonic() - began > cfg.time_budget_s
        if late or len(calm) == len(stats) or step == cfg.max_iterations:
            settled.append(blended)
            break
        if calm:
            settled.append(blended.where(F.col("seg_id").isin(calm)))
            now, blended = (x.where(~F.col("seg_id").isin(calm)) for x in (now, blended))
        before, now = now, blended
    out.labels = functools.reduce(DataFrame.unionByName, settled) if settled else now
    return out
