"""Queries of loops by search and of pitch drift, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonefold.operators import drift as D
from tonefold.operators import loops as L
from tonefold.plans import views as V
from tonefold.plans.analysis import TRACKS_SQL, tracks
from tonefold.plans.queries import add, on_signals, r6

MATCHES_SQL = """, c AS (SELECT path, frame // 3 AS chunk, frame, sum(abs(value)) AS m, max(value) FILTER (channel = 0) AS s FROM e GROUP BY ALL),
    z AS (SELECT path, chunk, arg_min({'f': frame, 's': s}, {'m': m, 'f': frame}) AS b FROM c GROUP BY ALL), p AS (SELECT path, chunk, b.f AS frame FROM z WHERE abs(b.s) < 0.1),
    q AS (SELECT a.path, a.frame AS start, b.frame AS stop FROM p a JOIN p b ON a.path = b.path AND b.chunk > a.chunk JOIN (SELECT DISTINCT path AS of, nf FROM e) n ON n.of = a.path WHERE b.frame + 3 <= nf AND b.frame - a.frame >= 3 // 4),
    t AS (SELECT q.path, start, stop, x.frame - start AS k, x.channel, abs(x.value - y.value) AS d FROM q JOIN e x ON x.path = q.path AND x.frame BETWEEN start AND start + 2 JOIN e y ON y.path = q.path AND y.channel = x.channel AND y.frame = stop + x.frame - start),
    g AS (SELECT path, start, stop AS "end", count(*) FILTER (d < 0.07) / count(*) * 100 AS match FROM t GROUP BY path, start, stop HAVING bool_and(d < 0.025) FILTER (k = 0 AND channel = 0))"""


def loops() -> None:
    on_signals("loop_matches", lambda df: L.loop_matches(df).select("path", "start", "end", r6("match").alias("match")), MATCHES_SQL + ' SELECT path, start, "end", round(match, 6) + 0.0 AS match FROM g', 2)
    on_signals("seamless_loop", lambda df: L.best_loop(L.loop_matches(df)).select("path", "start", "end", r6("match").alias("match")), MATCHES_SQL + """,
        b AS (SELECT path, arg_max({'s': start, 'e': "end", 'm': match}, {'o': CASE WHEN match > 99 THEN 101 ELSE match END, 'l': CASE WHEN match > 99 THEN "end" - start ELSE 0 END, 's': -start, 'e': -"end"}) AS b FROM g GROUP BY path)
        SELECT path, b.s AS start, b.e AS "end", round(b.m, 6) + 0.0 AS match FROM b WHERE b.m >= 70""", 2)  # fmt: skip


OUTLIERS_SQL = f"""{TRACKS_SQL}, q AS (SELECT path, chunk, hz, count(*) OVER (PARTITION BY path) AS n, count(*) FILTER (hz <> 0) OVER (PARTITION BY path) AS voiced FROM k),
    u AS (SELECT path, chunk, hz, lag(hz) OVER (PARTITION BY path ORDER BY chunk) AS before FROM q WHERE n >= 3 AND voiced >= 0.5 * n),
    j AS (SELECT *, CASE WHEN hz <> 0 AND before <> 0 THEN 1200 * log2(hz / before) END AS jump FROM u), m AS (SELECT path, (round(jump / 10) * 10)::INT AS band, count(*) AS n, avg(abs(jump)) AS mean FROM j WHERE jump IS NOT NULL GROUP BY ALL),
    f AS (SELECT path, least(arg_max(mean, {{'n': n, 'b': -band}}) * 5, 50) AS far FROM m GROUP BY path),
    b AS (SELECT j.*, hz = 0 OR (chunk > 0 AND CASE WHEN before = 0 THEN 0 WHEN hz = 0 THEN 1e9 ELSE abs(jump) END >= far) AS bad FROM j JOIN f USING (path)),
    o AS (SELECT path, chunk, hz, bad OR (chunk = 0 AND coalesce(lead(bad) OVER (PARTITION BY path ORDER BY chunk), false)) AS outlier FROM b)"""
IGNORED_SQL = f"""{OUTLIERS_SQL}, d AS (SELECT path, chunk, CASE WHEN chunk - lag(chunk) OVER w - 1 < 7 THEN 0 ELSE 1 END AS new FROM o WHERE outlier WINDOW w AS (PARTITION BY path ORDER BY chunk)),
    r AS (SELECT path, chunk, sum(new) OVER (PARTITION BY path ORDER BY chunk) AS region FROM d),
    s AS (SELECT path, CASE WHEN region = 1 AND min(chunk) < 7 THEN 0 ELSE min(chunk) END AS a, max(chunk) AS z FROM r GROUP BY path, region),
    i AS (SELECT o.*, EXISTS (SELECT 1 FROM s WHERE s.path = o.path AND chunk BETWEEN a AND z AND z + 1 - a >= 3) AS ignored FROM o)"""


def drift() -> None:
    # Half of a signal's chunks voiced are enough here, so that most of the users' tracks count.
    chunks = lambda spark, d: tracks(spark, d).withColumns({"n": F.count(F.lit(1)).over(D.W.partitionBy("path")), "v": F.count_if(F.col("hz") != 0).over(D.W.partitionBy("path"))}).filter("n >= 3 AND v >= 0.5 * n").select("path", "chunk", "hz")
    add("drift_outliers", lambda spark, d: D.with_outliers(chunks(spark, d)).select("path", "chunk", "outlier"), f"WITH {OUTLIERS_SQL} SELECT path, chunk, outlier FROM o")
    add("drift_ignored", lambda spark, d: D.with_ignored(D.with_outliers(chunks(spark, d))).select("path", "chunk", "ignored"), f"WITH {IGNORED_SQL} SELECT path, chunk, ignored FROM i")
    marked = lambda spark, d: chunks(spark, d).withColumns({"outlier": F.col("hz") == 0, "ignored": F.pmod(F.floor(F.col("chunk") / 9), F.lit(3)) == 1})
    targets = f"""{TRACKS_SQL}, q AS (SELECT path, chunk, hz, count(*) OVER (PARTITION BY path) AS n, count(*) FILTER (hz <> 0) OVER (PARTITION BY path) AS voiced FROM k),
        i AS (SELECT path, chunk, hz, hz = 0 AS outlier, chunk // 9 % 3 = 1 AS ignored, (chunk // 9 + 1) // 3 AS run FROM q WHERE n >= 3 AND voiced >= 0.5 * n),
        b AS (SELECT path, run, (round(1200 * log2(hz) / 3) * 3)::INT AS band, count(*) AS n, avg(hz) AS mean FROM i WHERE NOT ignored AND hz <> 0 GROUP BY ALL), t AS (SELECT path, run, arg_max(mean, {{'n': n, 'b': -band}}) AS target FROM b GROUP BY ALL),
        a AS (SELECT path, run, CASE WHEN 1200 * log2(max(target) OVER p / min(target) OVER p) <= 30 THEN avg(target) OVER p ELSE target END AS target FROM t WINDOW p AS (PARTITION BY path))"""
    add("drift_targets", lambda spark, d: D.with_targets(marked(spark, d)).select("path", "chunk", r6("target").alias("target")), f"WITH {targets} SELECT path, chunk, CASE WHEN NOT ignored THEN round(target, 6) + 0.0 END AS target FROM i LEFT JOIN a USING (path, run)")
    add("drift_csv", lambda spark, d: D.as_csv(D.with_targets(marked(spark, d))), f"""WITH {targets}
        SELECT path, chunk, printf('%7.2f,%d,%d,%7.2f', hz, outlier::INT, ignored::INT, CASE WHEN NOT ignored THEN coalesce(target, 0) ELSE 0::DOUBLE END) AS line FROM i LEFT JOIN a USING (path, run)""")  # fmt: skip


for part in (loops, drift):
    part()
