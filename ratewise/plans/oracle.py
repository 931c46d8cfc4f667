"""DuckDB SQL text for the oracle side of the registered queries.

The stand-in views are spelled out as CTEs so each oracle query is
self-contained over the driver's pre-registered tables.
"""

from __future__ import annotations

BUCKET = "CAST('0x' || substr(md5(review_id),1,8) AS BIGINT) % 100"

RATINGS = f"""ratings AS (
  WITH j AS (SELECT l_orderkey, l_linenumber, o_custkey AS u, l_partkey AS p, l_suppkey AS s,
                    CAST(l_quantity AS INT) AS q
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  h AS (SELECT *, concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
                            CAST(p AS STRING), CAST(s AS STRING)) AS review_id,
          6 + (u % 3 - 1) + (p % 3 - 1)
            + 2 * (CASE WHEN u % 6 >= 3 THEN -1 ELSE 1 END) * (CASE WHEN p % 6 >= 3 THEN -1 ELSE 1 END)
            + (q % 3 - 1) AS half FROM j)
  SELECT review_id, concat('u', CAST(u AS STRING)) AS user_id, concat('b', CAST(p AS STRING)) AS business_id,
         CAST(greatest(2, least(10, half)) AS DOUBLE) / CAST(2 AS DOUBLE) AS stars,
         ({BUCKET} >= 80 OR u % 17 = 0 OR p % 19 = 0) AS is_test
  FROM h)"""

BUSINESS = """business AS (
  SELECT concat('b', CAST(p_partkey AS STRING)) AS business_id, p_name AS name,
         CASE WHEN p_partkey % 5 = 0 THEN 'Toronto' ELSE 'Montreal' END AS city, p_type AS category, cid AS plant,
         CAST(clon AS DOUBLE) + CAST(CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) % 11 - 5 AS DOUBLE) * CAST(0.0005 AS DOUBLE) AS longitude,
         CAST(clat AS DOUBLE) + CAST(CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) % 7 - 3 AS DOUBLE) * CAST(0.0005 AS DOUBLE) AS latitude
  FROM part JOIN (VALUES (0, -73.56367802, 45.50491004), (1, -73.7983471, 45.4606171), (2, -73.59808861, 45.51945735),
    (3, -73.61925182, 45.46908932), (4, -73.68637631, 45.49730413), (5, -73.5579598, 45.55922568),
    (6, -73.57986258, 45.48856344), (7, -73.5460882, 45.3927622)) AS c(cid, clon, clat) ON p_partkey % 8 = cid)"""

BIAS = """train AS (SELECT * FROM ratings WHERE NOT is_test),
test AS (SELECT * FROM ratings WHERE is_test),
um AS (SELECT user_id, avg(stars) AS user_mean, count(*) AS user_count FROM train GROUP BY user_id),
bm AS (SELECT business_id, avg(stars) AS business_mean, count(*) AS business_count FROM train GROUP BY business_id),
g AS (SELECT avg(stars) AS mu FROM train),
scored AS (
  SELECT t.review_id, t.user_id, t.business_id, t.stars,
         coalesce(um.user_mean, g.mu) AS user_mean, coalesce(bm.business_mean, g.mu) AS business_mean,
         coalesce(um.user_count, 0) AS user_count, coalesce(bm.business_count, 0) AS business_count,
         g.mu AS mu, 0.0 + coalesce(um.user_mean, g.mu) + coalesce(bm.business_mean, g.mu) - g.mu AS final_rating
  FROM test t LEFT JOIN um USING (user_id) LEFT JOIN bm USING (business_id) CROSS JOIN g)"""

CITY = """city_biz AS (SELECT * FROM business WHERE city = 'Montreal' AND name <> 'small ring')"""


def with_views(body: str, *ctes: str) -> str:
    parts = [RATINGS, BUSINESS] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body


def bias_sql(body: str, *extra: str) -> str:
    return with_views(body, BIAS, *extra)
