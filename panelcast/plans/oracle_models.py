"""DuckDB statements for the linear-model queries.

A statement fits one ridge model a *case* (a training set and an alpha): features are
standardised, their products summed, and the normal equations solved by
elimination, one column a recursion step.
"""

from __future__ import annotations

from panelcast.plans import oracle_base as ob
from panelcast.spec import DEFAULT_SPEC, MODEL_FEATURES

T = DEFAULT_SPEC.target
BUCKET = ("('0x' || substr(md5(CAST(player_id AS VARCHAR) || '|' || CAST(season AS VARCHAR)), 1, 8))::BIGINT % 100")

ROWS = f"""
rows_ AS (
  SELECT row_number() OVER () AS rid, player_id, season, is_starter, b AS bucket, b % 5 AS fold,
         CASE WHEN b < 20 THEN 'test' ELSE 'train' END AS split, CAST({T} AS DOUBLE) AS y,
         [{", ".join(f"CAST({f} AS DOUBLE)" for f in MODEL_FEATURES)}] AS x
  FROM (SELECT *, {BUCKET} AS b FROM panel)
  WHERE {T} IS NOT NULL AND {" AND ".join(f"{f} IS NOT NULL" for f in MODEL_FEATURES)}
)"""

METRICS = """count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
       1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0) AS r2, avg(y) AS mean_actual"""


def ridge_ctes(cases: str, train: str, score: str, width: int = len(MODEL_FEATURES)) -> str:
    """``pred`` (cid, rid, y, p): ``cases`` lists cid, alpha and more; ``train`` and
    ``score`` are conditions over a case and a row."""
    return f"""{ROWS.strip()},
cases AS ({cases}),
long_ AS (
  SELECT cid, rid, unnest(list_append(x, y)) AS v, unnest(range(1, {width} + 2)) AS j FROM cases JOIN rows_ ON {train}),
stats AS (SELECT cid, j, avg(v) AS m, CASE WHEN stddev_samp(v) > 1e-12 * greatest(1, abs(avg(v))) THEN stddev_samp(v) END AS s
          FROM long_ GROUP BY cid, j),
z AS (SELECT cid, rid, j, CASE WHEN j > {width} THEN v - m ELSE coalesce((v - m) / s, 0) END AS z FROM long_ JOIN stats USING (cid, j)),
gram AS (SELECT a.cid, a.j AS i, b.j AS j, sum(a.z * b.z) AS g
         FROM z a JOIN z b ON a.cid = b.cid AND a.rid = b.rid WHERE a.j <= {width} GROUP BY a.cid, a.j, b.j),
augmented AS (
  SELECT cid, list(r ORDER BY i) AS a FROM (
    SELECT gram.cid, i, list(g + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS r
    FROM gram JOIN cases ON cases.cid = gram.cid GROUP BY gram.cid, i) GROUP BY cid),
solved(cid, k, a) AS (
  SELECT cid, 1, a FROM augmented
  UNION ALL
  SELECT cid, k + 1, list_transform(a, lambda r, i: CASE WHEN i = k THEN lead_ ELSE list_transform(r, lambda v, t: v - r[k] * lead_[t]) END)
  FROM (SELECT cid, k, a, list_transform(a[k], lambda v: v / a[k][k]) AS lead_ FROM solved WHERE k <= {width})),
weights AS (SELECT cid, unnest(list_transform(a, lambda r: r[{width} + 1])) AS w, unnest(range(1, {width} + 1)) AS j FROM solved WHERE k = {width} + 1),
lines AS (
  SELECT weights.cid, list(coalesce(w / s, 0) ORDER BY weights.j) AS ws, sum(coalesce(w / s, 0) * m) AS shift
  FROM weights JOIN stats ON stats.cid = weights.cid AND stats.j = weights.j GROUP BY weights.cid),
pred AS (
  SELECT cases.*, rows_.* EXCLUDE (x), lines.ws, m - shift + list_dot_product(x, lines.ws) AS p
  FROM cases JOIN lines ON lines.cid = cases.cid JOIN stats ON stats.cid = cases.cid AND stats.j = {width} + 1 JOIN rows_ ON {score})"""


def ridge_query(cases: str, train: str, score: str, select: str, keep: tuple[str, ...] = (), extra: str = "") -> str:
    ctes = ridge_ctes(cases, train, score) + (",\n" + extra.strip() if extra else "")
    return ob.panel_query(select, keep=keep, extra_ctes=ctes).replace("WITH ", "WITH RECURSIVE ", 1)


ALPHA_SWEEP = ridge_query(
    "SELECT unnest([0.1, 0.5, 1.0, 2.0, 5.0, 10.0])::DOUBLE AS alpha, unnest(range(6)) AS cid", "split = 'train'", "split = 'test'",
    """SELECT *, CAST(row_number() OVER (ORDER BY mae, alpha) = 1 AS INTEGER) AS is_best
       FROM (SELECT 'ridge' AS model, alpha, """ + METRICS + " FROM pred GROUP BY alpha)", keep=("model",))

SEGMENTS = ridge_query(
    "SELECT unnest([0, 1]) AS cid, 0.5::DOUBLE AS alpha", "split = 'train' AND is_starter = cid", "split = 'test' AND is_starter = cases.cid",
    f"""SELECT 'is_starter=' || is_starter AS segment, {METRICS} FROM pred GROUP BY is_starter
        UNION ALL SELECT 'segmented', {METRICS} FROM pred HAVING count(*) > 0""", keep=("segment",))

CROSS_VALIDATION = ridge_query(
    "SELECT unnest(range(5)) AS cid, 0.5::DOUBLE AS alpha", "fold <> cid", "true",
    """SELECT part, metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
              CASE WHEN metric <> 'r2' THEN NULL WHEN stddev_pop(value) < 0.05 THEN 'very stable'
                   WHEN stddev_pop(value) < 0.1 THEN 'stable' ELSE 'variable' END AS stability
       FROM long_metrics GROUP BY part, metric""", keep=("part", "metric", "stability"),
    extra=f"""per_fold AS (SELECT cid, CASE WHEN fold = cid THEN 'test' ELSE 'train' END AS part, {METRICS} FROM pred GROUP BY ALL),
long_metrics AS (UNPIVOT (SELECT cid, part, mae, rmse, r2 FROM per_fold) ON mae, rmse, r2 INTO NAME metric VALUE value)""")

LEARNING_CURVE = ridge_query(
    "SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS share, 1.0::DOUBLE AS alpha, unnest(range(6)) AS cid",
    "bucket >= 20 AND bucket < 20 + share * 80", "split = 'test'",
    """SELECT n, mae, rmse, r2, mean_actual, 'ridge' AS model, share AS train_share, train_rows, mae_decrease, improvement_pct, improvement_pct_per_100,
              """ + ", ".join(f"CASE WHEN {goal} > have AND rate IS NOT NULL THEN final * (1 - rate * ({goal} - have) / 100 / 100) END AS projected_mae_at_{goal}"
                              for goal in (500, 1000, 2000)) + """,
              CASE WHEN last < first THEN 'diminishing' ELSE 'stable' END AS returns
       FROM steps, (SELECT avg(improvement_pct_per_100) AS rate, max_by(mae, share) AS final,
                           min_by(mae_decrease, share) FILTER (mae_decrease IS NOT NULL) AS first, max_by(mae_decrease, share) AS last,
                           (SELECT count(*) FROM rows_) AS have FROM steps)""", keep=("model", "returns"),
    extra=f"""sizes AS (SELECT cases.cid, count(*) AS train_rows FROM cases JOIN rows_ ON bucket >= 20 AND bucket < 20 + share * 80 GROUP BY cases.cid),
measured AS (SELECT share, train_rows, m.* EXCLUDE (share) FROM (SELECT cid, share, {METRICS} FROM pred GROUP BY cid, share) m JOIN sizes USING (cid)),
steps AS (
  SELECT *, lag(mae) OVER w - mae AS mae_decrease, (lag(mae) OVER w - mae) / nullif(lag(mae) OVER w, 0) * 100 AS improvement_pct,
         (lag(mae) OVER w - mae) / nullif(lag(mae) OVER w, 0) * 100 / nullif(train_rows - lag(train_rows) OVER w, 0) * 100 AS improvement_pct_per_100
  FROM measured WINDOW w AS (ORDER BY share))""")

PERSISTENCE = ob.panel_query("SELECT count(*) AS rows, 0.0::DOUBLE AS max_abs_diff FROM rows_ WHERE split = 'test'", extra_ctes=ROWS)
