"""The jobs as registered queries: each runs twice into one new folder of the shared checkpoint folder, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orbweave.functions import steps
from orbweave.functions.geometry import morton
from orbweave.operators.surface import COVARIANCE, FIT
from orbweave.tables import shared_folder

from . import text_styles, tile_map


def _twice(job, spark: SparkSession, d: str, name: str) -> DataFrame:
    output = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    job.run(spark, d, output)
    return job.run(spark, d, output)


def job1_tile_map(spark: SparkSession, d: str) -> DataFrame:
    rounded = (f"round({c}, {k}) + 0e0 AS {c}" for c, k in (("x", 9), ("y", 9), ("z", 9), ("nx", 4), ("ny", 4), ("nz", 4)))
    return _twice(tile_map, spark, d, "tile-map").selectExpr("cloud_id", "tile", "code", "n", *rounded, "planar")


def job2_text_styles(spark: SparkSession, d: str) -> DataFrame:
    return _twice(text_styles, spark, d, "text-styles").selectExpr("lang", "source", "`like`", "round(distance, 6) + 0e0 AS distance", "round(confidence, 6) + 0e0 AS confidence")


_C, _T = tile_map.CONFIG, text_styles.CONFIG
_LOW = ", ".join(f"min({c}) OVER (PARTITION BY cloud_id) AS m{c}" for c in "xyz")
_CELL = ", ".join(f"CAST(floor(({c} - m{c}) / {_C['voxel']!r} + 0.5e0) AS BIGINT) AS {k}" for c, k in zip("xyz", "ijk", strict=True))
_FITTED = steps.sql(f"(SELECT cloud_id, tile, {', '.join(f'{text} AS {name}' for name, text in COVARIANCE.items())} FROM cells GROUP BY cloud_id, tile)", FIT)
SQL = {
    "job1_tile_map": f"""WITH points AS (SELECT {_C['cloud_id']} AS cloud_id, x, y, z FROM {steps.sql('events', _C['levels'])} AS p),
voxels AS (SELECT cloud_id, i, j, k, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT cloud_id, x, y, z, {_CELL} FROM (SELECT *, {_LOW} FROM points) AS q) AS r GROUP BY cloud_id, i, j, k),
cells AS MATERIALIZED (SELECT cloud_id, CAST({morton('ti', 'tj', 'tk', spark=False)} AS BIGINT) AS tile, CAST({morton('i', 'j', 'k', spark=False)} AS BIGINT) AS code, x, y, z, n FROM (SELECT *, i // {_C['tile']} AS ti, j // {_C['tile']} AS tj, k // {_C['tile']} AS tk FROM voxels) AS t),
planes AS (SELECT cloud_id, tile, CASE WHEN n >= 3 THEN nx ELSE 0e0 END AS nx, CASE WHEN n >= 3 THEN ny ELSE 0e0 END AS ny, CASE WHEN n >= 3 THEN nz ELSE 1e0 END AS nz, n >= 3 AND l3 <= {_C['thickness']!r} * {_C['thickness']!r} AS planar FROM {_FITTED} AS f)
SELECT cloud_id, tile, code, CAST(n AS BIGINT) AS n, round(x, 9) + 0e0 AS x, round(y, 9) + 0e0 AS y, round(z, 9) + 0e0 AS z, round(nx, 4) + 0e0 AS nx, round(ny, 4) + 0e0 AS ny, round(nz, 4) + 0e0 AS nz, planar FROM cells JOIN planes USING (cloud_id, tile)""",
    "job2_text_styles": rf"""WITH words AS (SELECT coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT lang, source, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS many FROM words),
bins AS (SELECT lang, source, (least(length(word), {_T['lengths']}) - 1) * {_T['places']} + (i * {_T['places']}) // many AS bin, count(*) AS n FROM places GROUP BY ALL),
hist AS MATERIALIZED (SELECT lang, source, bin, n / sum(n) OVER (PARTITION BY lang, source) AS mass FROM bins),
ids AS (SELECT DISTINCT lang, source FROM hist),
apart AS MATERIALIZED (SELECT g.lang, g.s, g.t, sum((coalesce(a.mass, 0) - coalesce(b.mass, 0)) * (coalesce(a.mass, 0) - coalesce(b.mass, 0)) / nullif(coalesce(a.mass, 0) + coalesce(b.mass, 0), 0)) AS d
 FROM (SELECT a.lang, a.source AS s, b.source AS t, bin FROM ids a JOIN ids b ON a.lang = b.lang AND a.source <> b.source, (SELECT DISTINCT bin FROM hist) AS every) AS g
 LEFT JOIN hist a ON a.lang = g.lang AND a.source = g.s AND a.bin = g.bin LEFT JOIN hist b ON b.lang = g.lang AND b.source = g.t AND b.bin = g.bin GROUP BY g.lang, g.s, g.t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, s ORDER BY d, t) AS r, row_number() OVER (PARTITION BY lang, t ORDER BY d, s) AS c FROM apart),
best AS (SELECT lang, s, t, d, least(2, coalesce((SELECT min(x.d) FROM ranked x WHERE x.lang = b.lang AND x.s = b.s AND x.r = 2), 2)) AS ds, least(2, coalesce((SELECT min(x.d) FROM ranked x WHERE x.lang = b.lang AND x.t = b.t AND x.c = 2), 2)) AS dt FROM ranked b WHERE r = 1 AND c = 1 AND s < t)
SELECT lang, s AS source, t AS "like", round(d, 6) + 0e0 AS distance, round(CASE WHEN ds = 0 OR dt = 0 THEN 0 ELSE sqrt((1 - d / ds) * (1 - d / dt)) END, 6) + 0e0 AS confidence FROM best""",
}
QUERIES = {"job1_tile_map": job1_tile_map, "job2_text_styles": job2_text_styles}
