"""Answers of a language model: the client boundary, parsing, and mapping onto candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gaussian, half_even

POSITION = "struct<pos:double,`char`:string,conf:double,source:string>"
ANSWER = f"positions array<{POSITION}>"


def complete(messages: DataFrame, load: Callable[[], Callable[[str], str]], by: list[str] | None = None) -> DataFrame:
    """Runs a text completer over (by..., batch, line_ids, message), by being text columns: adds raw and error. `load` is called once in each worker; an
    exception becomes the row's error and the others go on."""

    page = by or []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for p in parts:
            raw, error = [], []
            for m in p["message"]:
                try:
                    raw.append(ask(m)), error.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None), error.append(str(e))
            yield p.assign(raw=raw, error=error)[[*page, "batch", "line_ids", "raw", "error"]]

    return messages.mapInPandas(run, "".join(f"`{c}` string, " for c in page) + "batch int, line_ids array<int>, raw string, error string")


def blocks(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., line_id, block, error) of (by..., batch, line_ids, raw, error): an answer is cut at ---, one block for each line in order;
    missing blocks are {}, surplus ones are dropped."""
    cut = F.transform(F.split("raw", "---"), lambda b: F.trim(b, F.lit(" \t\n\r")))
    lines = answers.select(*(by or []), "raw", "error", cut.alias("cut"), F.posexplode("line_ids").alias("at", "line_id"))
    return lines.select(*(by or []), "line_id", F.when(F.col("error").isNull(), F.coalesce(F.get("cut", F.col("at")), F.lit("{}"))).alias("block"), "error")


def without_fences(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: ~F.ltrim(l).startswith("```")), "\n")


def positions(text: Column) -> Column:
    """The positions of an answer: parsed as it is, else its outermost braces, else none."""
    clean = without_fences(text)
    whole = F.from_json(clean, ANSWER)
    inner = F.from_json(F.regexp_extract(clean, "(?s)(\\{.*\\})", 1), ANSWER)
    return F.coalesce(whole["positions"], inner["positions"], F.array().cast(f"array<{POSITION}>"))


def predictions(parsed: DataFrame, column: str = "block", by: list[str] | None = None) -> DataFrame:
    """One row for each position, with defaults for what it lacks: by..., line_id, ord, pos, char, conf, source."""
    p = parsed.select(*(by or []), "line_id", F.posexplode(positions(F.col(column))).alias("ord", "q"))
    return p.select(*(by or []), "line_id", "ord", F.coalesce("q.pos", F.lit(0.0)).alias("pos"), F.coalesce("q.char", F.lit("?")).alias("char"), F.coalesce("q.conf", F.lit(0.5)).alias("conf"), F.coalesce("q.source", F.lit("llm_gap")).alias("source"))


def nearest_candidates(preds: DataFrame, lined: DataFrame, width: int, reach: float = 0.6, by: list[str] | None = None) -> DataFrame:
    """Each prediction with the bounding box of the nearest candidate of its line within `reach` median heights, or none.

    preds: (by..., pid, line_id, pos, ...); lined: (by..., id, line_id, cx, cy, h, w). Candidates of one x count once, the last of them
    serving. Candidates are put in cells as wide as the reach, so a prediction meets those of three cells only."""
    line = [*(by or []), "line_id"]
    stats = lined.groupBy(*line).agg(F.avg("cy").alias("line_y"), F.median("h").alias("char_h"))
    c = lined.groupBy(*line, "cx").agg(F.min("id").alias("_ord"), F.max_by(F.struct(*(F.col(k) for k in ("id", "cy", "h", "w"))), "id").alias("box")).join(stats, line)
    cell = F.greatest(F.col("char_h") * reach, F.lit(1.0))
    c = c.withColumn("cell", F.explode(F.array(*(F.floor(F.col("cx") / cell) + k for k in (-1, 0, 1))))).select(*line, "cell", "cx", "_ord", "box")
    p = preds.join(stats, line).withColumn("cell", F.floor(F.col("pos") * width / cell))
    met = p.join(c, [*line, "cell"], "left")
    d = F.abs(F.col("cx") / F.greatest(F.lit(width), F.lit(1)) - F.col("pos")) * width
    met = met.withColumn("d", F.when(d < F.col("char_h") * reach, d))
    best = F.min_by(F.struct("d", "box"), F.when(F.col("d").isNotNull(), F.struct("d", "_ord"))).alias("b")
    g = met.groupBy(*preds.columns).agg(F.first("line_y").alias("pos_y"), best)
    return g.select(*preds.columns, (F.col("pos") * width).alias("pos_x"), "pos_y", F.col("b.box.id").alias("cand_id"), F.col("b.box.cy").alias("cand_cy"), F.col("b.d").alias("distance"))


def result_counters(results: DataFrame) -> DataFrame:
    """Predictions by source."""
    return results.groupBy("source").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"))


def paint(prob: DataFrame, preds: DataFrame, *, radius: int = 12, discount: float = 0.75, most: float = 0.90) -> DataFrame:
    """Writes predictions into a map: boxes of medium ones are raised to min(`most`, conf), other places get a Gaussian blob.

    preds: (seg_id, pos_y, pos_x, conf, source, y0, x0, y1, x1; the box null without a candidate). The pixels of each
    prediction are generated and joined to the map; where several meet, the largest value counts."""
    ext = prob.groupBy("seg_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    p = preds.where("source <> 'anchor'").join(ext, "seg_id")
    fit = lambda c, n: F.least(F.greatest(half_even(c), F.lit(0.0)), F.col(n) - F.lit(1.0)).cast("int")
    p = p.withColumns({"cy": fit(F.col("pos_y"), "h"), "cx": fit(F.col("pos_x"), "w"), "boxed": (F.col("source") == "llm_med") & F.col("y0").isNotNull()})
    p = p.withColumns({c: F.when(F.col("boxed"), F.col(c)) for c in ("y0", "x0", "y1", "x1")} | {c: F.when(~F.col("boxed"), F.col(c)) for c in ("cy", "cx")})
    # of predictions that paint the same place, the surest alone shows
    p = p.groupBy("seg_id", "boxed", "cy", "cx", "y0", "x0", "y1", "x1", "h", "w").agg(F.max("conf").alias("conf"))
    span = lambda a, b: F.when(a < b, F.sequence(a.cast("int"), (b - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    side = lambda lo, hi, c, n: F.when(F.col("boxed"), span(F.greatest(F.lit(0), F.col(lo)), F.least(F.col(n), F.col(hi)))).otherwise(span(F.greatest(F.lit(0), F.col(c) - radius), F.least(F.col(n), F.col(c) + radius + 1)))
    px = p.withColumn("y", F.explode(side("y0", "y1", "cy", "h"))).withColumn("x", F.explode(side("x0", "x1", "cx", "w")))
    blob = gaussian(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"), radius) * F.col("conf") * discount
    value = F.when(F.col("boxed"), F.least(F.lit(most), F.col("conf"))).otherwise(blob)
    best = px.select("seg_id", "y", "x", value.alias("_v")).groupBy("seg_id", "y", "x").agg(F.max("_v").alias("_v"))
    new = F.greatest("p", F.coalesce("_v", F.col("p")))
    return prob.join(best, ["seg_id", "y", "x"], "left").select("seg_id", "y", "x", F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0)).alias("p"))


def transcribe(images: DataFrame, load: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """Reads (seg_id, tiff) images as text by an injected reader: seg_id, text, error. An exception stays with its row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for p in parts:
            text, error = [], []
            for data in p["tiff"]:
                try:
                    text.append(read(bytes(data))), error.append(None)
                except Exception as e:  # noqa: BLE001
                    text.append(None), error.append(str(e))
            yield pd.DataFrame({"seg_id": p["seg_id"], "text": text, "error": error})

    return images.mapInPandas(run, "seg_id string, text string, error string")
