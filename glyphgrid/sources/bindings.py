"""Relations of the data model, bound to the tables that tests and benchmarks run on.

Each is SQL that Spark and other engines read alike; names in braces are base tables. `relation` gives it as a DataFrame,
`with_clause` as common table expressions for an SQL counterpart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_D255 = "cast(255 AS double)"
RELATIONS: dict[str, str] = {
    # stack of layers: one value for each cell; rows of one cell are summed modulo 256
    "voxels": """SELECT l_returnflag AS seg_id, cast(l_linenumber - 1 AS int) AS z, cast(l_partkey % 64 AS int) AS y, cast(l_orderkey % 64 AS int) AS x,
       cast(sum(cast(floor(l_quantity * 5.1) AS int)) % 256 AS int) AS v, cast(sum(cast(round(l_discount * 2550) AS int)) % 256 AS int) AS lbl
FROM {lineitem} GROUP BY l_returnflag, cast(l_linenumber - 1 AS int), cast(l_partkey % 64 AS int), cast(l_orderkey % 64 AS int)""",
    "prob": f"SELECT seg_id, y, x, v / {_D255} AS p FROM {{voxels}} WHERE z = 0",
    "labels_map": f"SELECT seg_id, y, x, lbl / {_D255} AS t FROM {{voxels}} WHERE z = 0",
    "prob_next": f"SELECT seg_id, y, x, v / {_D255} AS p FROM {{voxels}} WHERE z = 1",
    "candidates": """SELECT cast(c_custkey AS bigint) AS id, cast(c_nationkey * 20 + c_custkey % 7 AS int) AS cy, cast((c_custkey * 37) % 1000 AS int) AS cx, cast(6 + c_custkey % 5 AS int) AS h, cast(5 + c_custkey % 6 AS int) AS w,
       cast(40 + (c_custkey * 53) % 9000 AS int) AS area, least(greatest((c_acctbal + 1000) / 11000, 0), 1) AS mean_prob
FROM {customer}""",
    "predictions": """SELECT event_id, cast(user_id % 25 AS int) AS line_id, (event_id % 997) / cast(997 AS double) AS pos, least(value / 500, 1) AS conf,
       CASE event_type WHEN 'signup' THEN 'anchor' WHEN 'click' THEN 'llm_med' ELSE 'llm_gap' END AS source
FROM {events}""",
    "patches": "SELECT vec_id, label, embedding FROM {embeddings}",
    "templates": "SELECT label AS letter, min_by(embedding, vec_id) AS tpl FROM {embeddings} GROUP BY label",
    "manifest": "SELECT seg_id, z, count(*) AS n_px FROM {voxels} GROUP BY seg_id, z",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation `name` over the tables in `sf_dir`."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = RELATIONS[name]
    return spark.sql(sql, **{x: relation(spark, sf_dir, x) for x in re.findall(r"\{(\w+)\}", sql)})


def with_clause(*names: str, recursive: bool = False) -> str:
    """`WITH ...` that defines the relations and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in RELATIONS and name not in order:
            for x in re.findall(r"\{(\w+)\}", RELATIONS[name]):
                need(x)
            order.append(name)

    for n in names:
        need(n)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS (\n{RELATIONS[n].format_map(_Plain())}\n)" for n in order)


class _Plain(dict):
    def __missing__(self, key: str) -> str:
        return key
