"""Change log queries."""

import datetime as dt

from pyspark.sql import functions as F

from polisframe.operators import changelog as cl
from polisframe.plans.registry import query

_LOG = "SELECT id, feature_id, transaction_type FROM feature_changelog WHERE {}"
_A, _U = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12)


def _q(name, where, **filters):
    query(name, _LOG.format(where))(lambda m: cl.changes(m, **filters).select("id", "feature_id", "transaction_type"))


_q("changes_bbox", "xmin <= 900 AND xmax >= 400 AND ymin <= 900 AND ymax >= 400", bbox=(400, 400, 900, 900))
_q("changes_bbox_contains", "xmin <= 510 AND xmax >= 511 AND ymin <= 1000.5 AND ymax >= 1000.75",
   bbox=(510, 1000.5, 511, 1000.75), bbox_mode="contains")
_q("changes_bbox_contains_some", "xmin <= 1941.5 AND xmax >= 1942 AND ymin <= 798.5 AND ymax >= 799",
   bbox=(1941.5, 798.5, 1942, 799), bbox_mode="contains")
_q("changes_type", "objectclass_id = 10", feature_types=["Customer"])
_q("changes_type_exact", "objectclass_id = 2", feature_types=["AbstractParty"])
_q("changes_transaction", "transaction_type IN ('insert', 'delete')", transaction_types=["insert", "delete"])
_q("changes_window", "transaction_date > TIMESTAMP '2024-01-05' AND transaction_date <= TIMESTAMP '2024-01-12'",
   after=_A, until=_U)
_q("changes_objectid", "objectid IN ('C_7', 'C_11')", objectids=["C_7", "C_11"])
_q("changes_user", "db_user = 'u3'", users=["u3"])
_q("changes_reason", "reason_for_update IN ('r0', 'r2')", reasons=["r0", "r2"])
_q("changes_combined", """db_user IN ('u1', 'u2') AND transaction_type = 'update' AND xmin <= 1500 AND xmax >= 200
   AND ymin <= 1500 AND ymax >= 200 AND transaction_date > TIMESTAMP '2024-01-05'""", users=["u1", "u2"],
   transaction_types=["update"], bbox=(200, 200, 1500, 1500), after=_A)
_q("changes_sql", "id IN (SELECT id FROM feature_changelog WHERE reason_for_update IS NULL) AND db_user = 'u0'",
   users=["u0"], sql="select id from feature_changelog where reason_for_update is null")
query("changes_latest_first", """SELECT id, feature_id FROM feature_changelog ORDER BY transaction_date DESC, id LIMIT 250""")(
    lambda m: cl.changes(m, order="latest_first", limit=250).select("id", "feature_id"))
query("changes_oldest_first", """SELECT id, feature_id FROM feature_changelog WHERE transaction_type = 'terminate'
    ORDER BY transaction_date, id LIMIT 99""")(
    lambda m: cl.changes(m, order="oldest_first", limit=99, transaction_types=["terminate"]).select("id", "feature_id"))
query("changes_early_stop", "SELECT count(*) AS n FROM (SELECT * FROM feature_changelog LIMIT 500)")(
    lambda m: cl.changes(m, limit=500).agg(F.count("*").alias("n")))
query("change_counts", """SELECT transaction_type, date_trunc('day', transaction_date)::DATE::VARCHAR AS day, count(*) AS n
    FROM feature_changelog GROUP BY 1, 2""")(
    lambda m: m.feature_changelog.groupBy("transaction_type", F.to_date("transaction_date").cast("string").alias("day"))
    .agg(F.count("*").alias("n")))

# pairs are found on a coarse grid, labels spread along them, and areas come from each cluster's own coordinates
_CLUSTERS = """WITH b AS (SELECT id, xmin, ymin, xmax, ymax FROM feature_changelog WHERE xmin IS NOT NULL{where}),
  cells AS (SELECT *, unnest(range(CAST(floor(xmin / 64) AS BIGINT), CAST(floor(xmax / 64) AS BIGINT) + 1)) AS cx,
    CAST(floor(ymin / 64) AS BIGINT) AS cy0, CAST(floor(ymax / 64) AS BIGINT) AS cy1 FROM b),
  grid AS (SELECT *, unnest(range(cy0, cy1 + 1)) AS cy FROM cells),
  pairs AS (SELECT DISTINCT p.id AS a, q.id AS b, least(p.xmax, q.xmax) > greatest(p.xmin, q.xmin)
      OR least(p.ymax, q.ymax) > greatest(p.ymin, q.ymin) AS solid
    FROM grid p JOIN grid q ON p.cx = q.cx AND p.cy = q.cy AND p.id <> q.id
      AND p.xmin <= q.xmax AND p.xmax >= q.xmin AND p.ymin <= q.ymax AND p.ymax >= q.ymin),
  walk AS (SELECT id, id AS label FROM b UNION SELECT pairs.b, label FROM walk JOIN pairs ON pairs.a = walk.id
    WHERE pairs.b > label),
  cluster AS (SELECT id, min(label) AS cluster_id FROM walk GROUP BY 1),
  walk2 AS (SELECT id, id AS label FROM b UNION SELECT pairs.b, label FROM walk2 JOIN pairs ON pairs.a = walk2.id
    WHERE pairs.b > label AND solid),
  region AS (SELECT id, min(label) AS region_id FROM walk2 GROUP BY 1)"""
_RECT = """, xs AS (SELECT region_id, x, lead(x) OVER (PARTITION BY region_id ORDER BY x) AS x2 FROM (
      SELECT region_id, xmin AS x FROM b JOIN region USING (id) UNION SELECT region_id, xmax FROM b JOIN region USING (id))),
  ys AS (SELECT region_id, y, lead(y) OVER (PARTITION BY region_id ORDER BY y) AS y2 FROM (
      SELECT region_id, ymin AS y FROM b JOIN region USING (id) UNION SELECT region_id, ymax FROM b JOIN region USING (id))),
  rect AS (SELECT DISTINCT xs.region_id, x, x2, y, y2 FROM xs JOIN ys ON ys.region_id = xs.region_id
      AND x2 IS NOT NULL AND y2 IS NOT NULL
    JOIN region ON region.region_id = xs.region_id JOIN b ON b.id = region.id
      AND b.xmin <= x AND b.xmax >= x2 AND b.ymin <= y AND b.ymax >= y2)"""
_SOME = " AND transaction_type IN ('update', 'insert')"
query("change_clusters", _CLUSTERS.format(where=_SOME) + """
    SELECT id, cluster_id, region_id FROM cluster JOIN region USING (id)""", recursive=True)(
    lambda m: cl.change_clusters(m, transaction_types=["update", "insert"])[0])
query("change_regions", _CLUSTERS.format(where="") + _RECT + """
    SELECT region_id, min(cluster_id) AS cluster_id, count(*) AS changes, min(xmin) AS xmin, min(ymin) AS ymin,
      max(xmax) AS xmax, max(ymax) AS ymax, (SELECT sum((x2 - x) * (y2 - y)) FROM rect r WHERE r.region_id = g.region_id)
      AS area
    FROM region g JOIN cluster USING (id) JOIN b USING (id) GROUP BY 1""", recursive=True)(lambda m: cl.change_regions(m))
query("region_pieces", _CLUSTERS.format(where="") + _RECT + """
    SELECT region_id, sum((x2 - x) * (y2 - y)) AS area, min(x) AS left_, max(y2) AS top FROM rect GROUP BY 1""",
      recursive=True)(
    lambda m: cl.region_pieces(m).groupBy("region_id").agg(
        F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("area"),
        F.min("xmin").alias("left_"), F.max("ymax").alias("top")))

# borders are the sides of elementary rectangles that occur once; holes follow from corners, sides and rectangles (Euler)
query("region_outlines", _CLUSTERS.format(where="") + _RECT + """,
  sides AS (SELECT region_id, x AS ax, y AS ay, x2 AS bx, y AS by_ FROM rect UNION ALL SELECT region_id, x, y2, x2, y2 FROM rect
    UNION ALL SELECT region_id, x, y, x, y2 FROM rect UNION ALL SELECT region_id, x2, y, x2, y2 FROM rect),
  counted AS (SELECT region_id, bx - ax + by_ - ay AS length, count(*) AS n FROM sides GROUP BY region_id, ax, ay, bx, by_),
  border AS (SELECT region_id, sum(length) FILTER (n = 1) AS length, count(*) AS e FROM counted GROUP BY 1),
  corners AS (SELECT region_id, count(*) AS v FROM (SELECT region_id, x, y FROM rect UNION SELECT region_id, x2, y FROM rect
    UNION SELECT region_id, x, y2 FROM rect UNION SELECT region_id, x2, y2 FROM rect) GROUP BY 1),
  least AS (SELECT region_id, min([x, y]) AS first FROM rect GROUP BY 1),
  faces AS (SELECT region_id, count(*) AS f, sum((x2 - x) * (y2 - y)) AS size FROM rect GROUP BY 1)
  SELECT region_id, size, length, CAST(1 - v + e - f AS INTEGER) AS holes, CAST(2 - v + e - f AS INTEGER) AS rings, first[1] AS first_x, first[2] AS first_y
  FROM faces JOIN border USING (region_id) JOIN corners USING (region_id) JOIN least USING (region_id)""", recursive=True)(
    lambda m: cl.region_outlines(m).select("region_id", "size", "length", "holes", F.size("rings").alias("rings"),
                                           F.col("rings")[0][0][0].alias("first_x"), F.col("rings")[0][0][1].alias("first_y")))
_PAIRS = """SELECT f.id AS feature_id, c.id AS change_id FROM feature f JOIN feature_changelog c
    ON f.xmin <= c.xmax + {d} AND f.xmax >= c.xmin - {d} AND f.ymin <= c.ymax + {d} AND f.ymax >= c.ymin - {d} WHERE f.objectclass_id = 20{near}"""
query("spatial_join", _PAIRS.format(d=0, near=""))(lambda m: cl.changes_near(m, m.feature.where("objectclass_id = 20")))
query("spatial_join_near", _PAIRS.format(d=2.5, near=""" AND c.transaction_type = 'delete'
    AND pow(greatest(f.xmin - c.xmax, c.xmin - f.xmax, 0), 2) + pow(greatest(f.ymin - c.ymax, c.ymin - f.ymax, 0), 2) <= 6.25"""))(
    lambda m: cl.changes_near(m, m.feature.where("objectclass_id = 20"), 2.5, transaction_types=["delete"]))
