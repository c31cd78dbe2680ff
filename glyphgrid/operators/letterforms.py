"""Templates of the alphabet as vectors: strokes of polylines and arcs in a table, rasterised in expressions.

No font is needed. A letter's strokes lie in the unit square, y upwards; a cell is ink if its middle lies within half a
pen's width of a stroke. The strokes are drawn so that every letter has the holes that `match.LETTER_HOLES` states for it: the
bar of Θ touches its ring on one side only, and the feet of Ω meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import match

#: Strokes by form: lines as x y x y ..., arcs of ellipses as @ x y rx ry and the degrees where they begin and end.
STROKES = {
    "Α": "0.05 0 0.5 1 0.95 0; 0.2 0.33 0.8 0.33",
    "Β": "0.1 0 0.1 1; 0.1 1 0.5 1; @ 0.5 0.76 0.35 0.24 90 -90; 0.5 0.52 0.1 0.52; @ 0.5 0.26 0.42 0.26 90 -90; 0.5 0 0.1 0",
    "Γ": "0.15 0 0.15 1 0.85 1",
    "Δ": "0.05 0 0.5 1 0.95 0 0.05 0",
    "Ε": "0.85 1 0.15 1 0.15 0 0.85 0; 0.15 0.5 0.7 0.5",
    "Ζ": "0.1 1 0.9 1 0.1 0 0.9 0",
    "Η": "0.1 0 0.1 1; 0.9 0 0.9 1; 0.1 0.5 0.9 0.5",
    "Θ": "@ 0.5 0.5 0.45 0.5 0 360; 0.05 0.5 0.6 0.5",
    "Ι": "0.5 0 0.5 1",
    "Κ": "0.15 0 0.15 1; 0.85 1 0.15 0.42; 0.38 0.61 0.9 0",
    "Λ": "0.05 0 0.5 1 0.95 0",
    "Μ": "0.05 0 0.05 1 0.5 0.25 0.95 1 0.95 0",
    "Ν": "0.1 0 0.1 1 0.9 0 0.9 1",
    "Ξ": "0.1 1 0.9 1; 0.2 0.5 0.8 0.5; 0.1 0 0.9 0",
    "Ο": "@ 0.5 0.5 0.45 0.5 0 360",
    "Π": "0.1 0 0.1 1 0.9 1 0.9 0",
    "Ρ": "0.1 0 0.1 1; 0.1 1 0.5 1; @ 0.5 0.74 0.38 0.26 90 -90; 0.5 0.48 0.1 0.48",
    "Σ": "0.9 1 0.1 1 0.55 0.5 0.1 0 0.9 0",
    "Ϲ": "@ 0.55 0.5 0.45 0.5 45 315",
    "Τ": "0.05 1 0.95 1; 0.5 1 0.5 0",
    "Υ": "0.05 1 0.5 0.5 0.95 1; 0.5 0.5 0.5 0",
    "Φ": "@ 0.5 0.5 0.45 0.3 0 360; 0.5 0 0.5 1",
    "Χ": "0.05 0 0.95 1; 0.05 1 0.95 0",
    "Ψ": "@ 0.5 0.95 0.43 0.5 180 360; 0.5 0 0.5 1",
    "Ω": "@ 0.5 0.55 0.45 0.45 -60 240; 0.275 0.16 0.275 0; 0.725 0.16 0.725 0; 0.05 0 0.95 0",
}
#: By style: height of a letter and width of the pen as shares of the square, half a serif's length, whether older forms are taken.
STYLES = {"serif": (0.72, 0.09, 0.07, False), "uncial": (0.82, 0.125, 0.0, True), "skeleton": (0.72, 0.0, 0.0, False)}
#: The pen's least width in cells.
THIN = 2.2
ARC_PIECES = 32


def segments(strokes: DataFrame) -> DataFrame:
    """(form, x0, y0, x1, y1, end0, end1) of (form, stroke): lines between the points of a stroke, in the unit square. end: whether the
    stroke ends there on the base line or the top one, where a serif may stand."""
    numbers = F.split(F.trim(F.regexp_replace("stroke", "^@", "")), " +").cast("array<double>")
    strokes = strokes.select("form", F.col("stroke").startswith("@").alias("arc"), numbers.alias("n"))
    n = F.col("n")
    turn = lambda i: F.radians(n[4] + (n[5] - n[4]) * i / ARC_PIECES)
    on_arc = F.transform(F.sequence(F.lit(0), F.lit(ARC_PIECES)), lambda i: F.struct((n[0] + n[2] * F.cos(turn(i))).alias("x"), (n[1] + n[3] * F.sin(turn(i))).alias("y")))
    on_line = F.transform(F.sequence(F.lit(0), (F.size(n) / 2 - 1).cast("int")), lambda i: F.struct(F.get(n, i * 2).alias("x"), F.get(n, i * 2 + 1).alias("y")))
    p = strokes.select("form", "arc", F.when(F.col("arc"), on_arc).otherwise(on_line).alias("p")).withColumn("last", F.size("p") - 1)
    at = p.select("*", F.posexplode(F.slice("p", 1, F.col("last"))).alias("i", "a")).withColumn("b", F.get("p", F.col("i") + 1))
    stands = lambda c, first: ~F.col("arc") & first & F.col(c)["y"].isin(0.0, 1.0)
    return at.select("form", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), stands("a", F.col("i") == 0).alias("end0"), stands("b", F.col("i") == F.col("last") - 1).alias("end1"))


def rasterised(lines: DataFrame, key: list[str]) -> DataFrame:
    """The ink cells (key, size, y, x) of lines (key, size, x0, y0, x1, y1, pen) in cells of a square: those whose middle is within half
    a pen of a line. Only cells around a line are tried."""
    reach = F.col("pen") / 2
    low = lambda a, b: F.greatest(F.lit(0), F.floor(F.least(a, b) - reach - 0.5).cast("int"))
    high = lambda a, b: F.least(F.col("size") - 1, F.ceil(F.greatest(a, b) + reach).cast("int"))
    span = lambda a, b: F.when(low(a, b) <= high(a, b), F.sequence(low(a, b), high(a, b)))
    near = lines.withColumn("y", F.explode(span("y0", "y1"))).withColumn("x", F.explode(span("x0", "x1")))
    py, px = F.col("y") + 0.5 - F.col("y0"), F.col("x") + 0.5 - F.col("x0")
    dy, dx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    length = dy * dy + dx * dx
    along = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.greatest((py * dy + px * dx) / length, F.lit(0.0)), F.lit(1.0)))
    off = F.pow(py - along * dy, F.lit(2)) + F.pow(px - along * dx, F.lit(2))
    return near.where(off <= reach * reach).select(*key, "size", "y", "x").distinct()


def rendered(spark: SparkSession, sizes: tuple[int, ...] = match.TEMPLATE_SIZES, styles: tuple[str, ...] = match.TEMPLATE_STYLES) -> DataFrame:
    """The ink cells of each letter in each size and style: ord, letter, style, size, y, x. ord numbers templates by size, style and letter."""
    kinds = [(i * len(styles) + j, size, style, *STYLES[style]) for i, size in enumerate(sizes) for j, style in enumerate(styles)]
    kind = spark.createDataFrame(kinds, "kind int, size int, style string, height double, pen double, serif double, older boolean")
    strokes = spark.createDataFrame([(form, s.strip()) for form, given in STROKES.items() for s in given.split(";")], "form string, stroke string")
    letters = match.letter_table(spark).crossJoin(F.broadcast(kind))  # the alphabet by a few kinds
    number = (F.col("kind") * len(match.ALPHABET) + F.col("ord")).alias("ord")
    form = F.when(F.col("older"), F.col("form")).otherwise(F.col("letter"))
    asked = letters.select(number, "letter", "style", "size", "height", "pen", "serif", form.alias("form"))
    drawn = asked.join(segments(strokes), "form")
    bar = lambda x, y: F.struct((F.col(x) - F.col("serif")).alias("x0"), F.col(y).alias("y0"), (F.col(x) + F.col("serif")).alias("x1"), F.col(y).alias("y1"))
    own = F.struct(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    parts = F.filter(F.array(own, F.when(F.col("end0") & (F.col("serif") > 0), bar("x0", "y0")), F.when(F.col("end1") & (F.col("serif") > 0), bar("x1", "y1"))), lambda s: s.isNotNull())
    cell = lambda c, up: (F.col("size") / 2 + (F.col(f"s.{c}") - 0.5) * F.col("height") * F.col("size") * (-1 if up else 1)).alias(c)
    pen = F.greatest(F.col("pen") * F.col("size"), F.lit(THIN)).alias("pen")
    key = ["ord", "letter", "style"]
    lines = drawn.select(*key, "size", "height", pen, F.explode(parts).alias("s")).select(*key, "size", "pen", cell("x0", False), cell("y0", True), cell("x1", False), cell("y1", True))
    return rasterised(lines, key)


def bank(spark: SparkSession, sizes: tuple[int, ...] = match.TEMPLATE_SIZES, styles: tuple[str, ...] = match.TEMPLATE_STYLES) -> DataFrame:
    """The rendered templates with the holes that their letters should have: ord, letter, style, size, tpl, expected."""
    ink = rendered(spark, sizes, styles).groupBy("ord", "letter", "style", "size").agg(F.collect_set(F.col("y") * F.col("size") + F.col("x")).alias("ink"))
    cells = F.sequence(F.lit(0), F.col("size") * F.col("size") - 1)
    tpl = F.transform(cells, lambda i: F.when(F.array_contains("ink", i), 1.0).otherwise(0.0))
    expected = match.letter_table(spark).select("letter", F.col("holes").alias("expected"))
    return match.with_expected(ink.select("ord", "letter", "style", "size", tpl.alias("tpl")), expected)
