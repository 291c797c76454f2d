"""One query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold.functions import scalars as S
from tonefold.operators import sets as G
from tonefold.operators import signals as O
from tonefold.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LONG = "path, frame, channel, round(value, 6) + 0.0 AS value"


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def samples(df: DataFrame) -> DataFrame:
    return df.select("path", "frame", "channel", r6("value").alias("value"))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def on_signals(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None, channels: int = 1) -> None:
    """f over the signals; sql reads e(path, frame, channel, value, nf)."""
    add(name, lambda spark, d: f(V.signals(spark, d, channels)), sql and f"WITH RECURSIVE {V.signals_sql(channels)}{sql if sql[:1] == ',' else ' ' + sql}")


def fades() -> None:
    curves = {
        "linear": "x", "sine": "sin(x * pi() / 2)", "scurve": "(1 - cos(x * pi())) / 2", "exp": "pow(0.5, (1 - x) * 5)",
        "log": "CASE WHEN 20 * log10(x) < -30 THEN x ELSE (20 * log10(x) + 30) / 30 END", "sqrt": "sqrt(x)",
    }
    for shape, curve in curves.items():
        sql = f"""SELECT path, frame, channel, round(CASE WHEN frame = 0 THEN 0 WHEN frame < 16 THEN value * ({curve.replace("log10(x)", "log10(greatest(x, 1e-300))")}) ELSE value END, 6) + 0.0 AS value
            FROM (SELECT *, frame / 16.0 AS x FROM e)"""
        on_signals(f"fade_in_{shape}", lambda df, s=shape: samples(O.fade_in(df, "0.25s", s)), sql)
    on_signals("fade_out_sine", lambda df: samples(O.fade_out(df, "16")), """SELECT path, frame, channel,
        round(CASE WHEN frame = nf - 1 THEN 0 WHEN frame > nf - 17 THEN value * sin((nf - 1 - frame) / 16.0 * pi() / 2) ELSE value END, 6) + 0.0 AS value FROM e""")  # fmt: skip


def levels() -> None:
    on_signals("print_info_core", lambda df: O.levels(df, "path").select("path", "frames", r6(S.amp_to_db(F.col("rms"))).alias("rms_db"), r6(S.amp_to_db(F.col("peak"))).alias("peak_db"), "peak_frame", r6(F.col("peak") / F.col("rms")).alias("crest_factor")),
        """SELECT path, count(*) AS frames, round(20 * log10(sqrt(avg(value * value))), 6) + 0.0 AS rms_db, round(20 * log10(max(abs(value))), 6) + 0.0 AS peak_db,
        arg_max(frame, {'a': abs(value), 'f': -frame}) AS peak_frame, round(max(abs(value)) / sqrt(avg(value * value)), 6) + 0.0 AS crest_factor FROM e GROUP BY path""")  # fmt: skip
    on_signals("rms", lambda df: O.levels(df, "path").select("path", r6("rms").alias("rms")), "SELECT path, round(sqrt(avg(value * value)), 6) + 0.0 AS rms FROM e GROUP BY path")
    on_signals("peak", lambda df: O.levels(df, "path", "channel").select("path", "channel", r6("peak").alias("peak"), "peak_frame"),
        "SELECT path, channel, round(max(abs(value)), 6) + 0.0 AS peak, arg_max(frame, {'a': abs(value), 'f': -frame}) AS peak_frame FROM e GROUP BY ALL", 2)
    on_signals("is_silent", O.silent, "SELECT path, max(abs(value)) = 0 AS silent FROM e GROUP BY path")
    amp = lambda db: 10 ** (db / 20)
    common = "SELECT path, frame, channel, round(value * g, 6) + 0.0 AS value FROM e, (SELECT {} AS g FROM {})"
    by_channel = "(SELECT channel, sum(value * value) AS ss, count(*) AS n FROM e GROUP BY channel)"
    on_signals("norm_peak_common", lambda df: samples(O.normalise(df, -3)), common.format(f"{amp(-3)!r} / max(abs(value))", "e"))
    on_signals("norm_rms_common", lambda df: samples(O.normalise(df, -12, "rms")), common.format(f"min(sqrt(n * {amp(-12) ** 2!r} / ss))", by_channel), 2)
    on_signals("norm_energy_common", lambda df: samples(O.normalise(df, -12, "energy")), common.format(f"min(sqrt(n * {amp(-12)!r} / ss))", by_channel), 2)
    on_signals("norm_mix50", lambda df: samples(O.normalise(df, -3, mix=50)), common.format(f"sqrt({amp(-3)!r} / max(abs(value)))", "e"))
    on_signals("norm_peak_independent", lambda df: samples(O.normalise(df, -3, independently=True)), f"SELECT path, frame, channel, round(value * {amp(-3)!r} / max(abs(value)) OVER (PARTITION BY path), 6) + 0.0 AS value FROM e")
    on_signals("norm_independent_channels", lambda df: samples(O.normalise(df, -3, independently=True, channel_mix=100)),
        f"SELECT path, frame, channel, round(value * {amp(-3)!r} / max(abs(value)) OVER (PARTITION BY path, channel), 6) + 0.0 AS value FROM e", 2)
    on_signals("norm_crest", lambda df: samples(O.normalise(df, -3, independently=True, crest_scaling=100)), f"""SELECT path, frame, channel, round(value * {amp(-3)!r} / p * pow(10, (1 - (least(p / r, 200) - 1) / 199) * -12 / 20), 6) + 0.0 AS value
        FROM (SELECT *, max(abs(value)) OVER (PARTITION BY path) AS p, sqrt(avg(value * value) OVER (PARTITION BY path)) AS r FROM e)""")  # fmt: skip
    add("cents_diff", lambda spark, d: V.table(spark, d, "part").select("p_partkey", r6(S.cents_between(F.lit(440.0), F.col("p_retailprice"))).alias("cents")),
        "SELECT p_partkey, round(1200 * log2(p_retailprice / 440.0), 6) + 0.0 AS cents FROM part")


def pointwise() -> None:
    on_signals("gain_db", lambda df: samples(O.gain(df, "-3db")), f"SELECT path, frame, channel, round(value * {10 ** (-3 / 20)!r}, 6) + 0.0 AS value FROM e")
    on_signals("gain_pct", lambda df: samples(O.gain(df, "50%")), "SELECT path, frame, channel, round(value * 0.5, 6) + 0.0 AS value FROM e")
    a = 0.75 * math.pi / 4
    left, right = ((math.cos(a) + s * math.sin(a)) * math.sqrt(2) / 2 for s in (1, -1))
    on_signals("pan_left75", lambda df: samples(O.pan(df, "75L")), f"SELECT path, frame, channel, round(value * CASE channel WHEN 0 THEN {left!r} ELSE {right!r} END, 6) + 0.0 AS value FROM e", 2)
    on_signals("reverse", lambda df: samples(O.reverse(df)), "SELECT path, nf - 1 - frame AS frame, channel, round(value, 6) + 0.0 AS value FROM e")
    on_signals("reverse_stereo_swap", lambda df: samples(O.reverse(df)), "SELECT path, nf - 1 - frame AS frame, 1 - channel AS channel, round(value, 6) + 0.0 AS value FROM e", 2)
    on_signals("trim_start_end", lambda df: samples(O.trim(df, "0.125s", "10%")), "SELECT path, frame - 8 AS frame, channel, round(value, 6) + 0.0 AS value FROM e WHERE frame >= 8 AND frame < nf - 6")
    on_signals("mono_mix", lambda df: samples(O.mono(df)), "SELECT path, frame, 0::BIGINT AS channel, round(sum(value), 6) + 0.0 AS value FROM e GROUP BY path, frame", 2)
    on_signals("mix_add", lambda df: samples(O.mixed(df, O.trim(df, "8"))), """SELECT path, frame, channel, round(sum(value), 6) + 0.0 AS value
        FROM (SELECT path, frame, channel, value FROM e UNION ALL SELECT path, frame - 8, channel, value FROM e WHERE frame >= 8) GROUP BY ALL""")  # fmt: skip
    peak = "greatest(max(abs(value)) OVER (PARTITION BY path), 1)"
    for bits in (8, 16, 24):
        v = "value" if bits == 24 else f"value / {peak}"
        top = 1 << (bits - 1)
        level = "trunc((v + 1) / 2 * 255)::BIGINT" if bits == 8 else f"round(CASE WHEN v < 0 THEN v * {top} ELSE v * {top - 1} END)::BIGINT"
        on_signals(f"quantise_{bits}", lambda df, b=bits: O.quantised(df, b).select("path", "frame", "channel", "level"), f"SELECT path, frame, channel, {level} AS level FROM (SELECT *, {v} AS v FROM e)")
    n0 = "(SELECT path, min(frame) FILTER (abs(value) > {t}) AS a, max(frame) FILTER (abs(value) > {t}) AS b, any_value(nf) AS n FROM {src} GROUP BY path)"
    trimmed = "SELECT e.path, frame - coalesce(greatest(0, a - 4), 0) AS frame, channel, round(value, 6) + 0.0 AS value FROM e JOIN {} k USING (path) WHERE frame >= coalesce(greatest(0, a - 4), 0) AND frame < coalesce(least(n, b + 5), n)"
    on_signals("trim_silence_abs", lambda df: samples(O.trim_silence(df, -12)), trimmed.format(n0.format(t=repr(10 ** (-12 / 20)), src="e")))
    on_signals("trim_silence_peak_rel", lambda df: samples(O.trim_silence(df, -2, True)), trimmed.format(n0.format(t=f"p * {10 ** (-2 / 20)!r}", src="(SELECT *, max(abs(value)) OVER (PARTITION BY path) AS p FROM e)")))
    fours = lambda df: df.select("path").distinct().select("path", F.floor(F.col("path") / 4).alias("set_key"), (F.col("path") - F.col("path") % 4).alias("authority"))
    ends = n0.format(t=repr(10 ** (-12 / 20)), src="e")
    on_signals("trim_silence_sets", lambda df: samples(O.trim_silence(df, -12, sets=fours(df))), f""", q AS {ends}, r AS (SELECT path AS lead, coalesce(greatest(0, a - 4), 0) AS a, coalesce(least(n, b + 5), n) AS b FROM q)
        SELECT path, frame - a AS frame, channel, round(value, 6) + 0.0 AS value FROM e JOIN r ON lead = path - path % 4 WHERE frame >= a AND frame < b""")
    cross = "(SELECT path, arg_min(frame, {'m': m, 'f': frame}) AS o FROM (SELECT path, frame, sum(abs(value)) AS m FROM e WHERE frame < 16 GROUP BY ALL) GROUP BY path)"
    on_signals("zcross_offset", lambda df: samples(O.zcross_offset(df, "16")), f"SELECT path, frame - o AS frame, channel, round(value, 6) + 0.0 AS value FROM e JOIN {cross} USING (path) WHERE frame >= o", 2)
    on_signals("zcross_append", lambda df: samples(O.zcross_offset(df, "16smp", True)), f"SELECT path, (frame - o + nf) % nf AS frame, channel, round(value, 6) + 0.0 AS value FROM e JOIN {cross} USING (path)", 2)
    on_signals("xfade_loop", lambda df: samples(O.crossfade_loop(df, 25)), """SELECT path, CASE WHEN frame < 16 THEN nf - 32 + frame ELSE frame - 16 END AS frame, channel, round(sum(v), 6) + 0.0 AS value
        FROM (SELECT *, value * CASE WHEN frame < 16 THEN sin(frame / 16.0 * pi() / 2) WHEN nf - 1 - frame < 16 THEN sin((nf - 1 - frame) / 16.0 * pi() / 2) ELSE 1 END AS v FROM e) GROUP BY ALL""")  # fmt: skip


def neighbours() -> None:
    d2 = """d AS (SELECT *, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d2, lag(value, 1) OVER w AS before FROM e WINDOW w AS (PARTITION BY path, channel ORDER BY frame)),
        s AS (SELECT *, abs(d2 - avg(d2) OVER p) AS deviation, stddev_samp(d2) OVER p AS sd FROM d WINDOW p AS (PARTITION BY path, channel)),
        o AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY path, channel ORDER BY frame) <= 1 THEN 0 ELSE 1 END AS new FROM s WHERE deviation > 2 * greatest(sd, 1e-5){}),
        c AS (SELECT *, sum(new) OVER (PARTITION BY path, channel ORDER BY frame) AS cluster FROM o),
        b AS (SELECT path, channel, arg_max(frame, {{'d': deviation, 'f': -frame}}) AS frame, max(deviation) AS deviation FROM c GROUP BY path, channel, cluster)"""
    out = " SELECT path, channel, frame, round(deviation, 6) + 0.0 AS deviation FROM b"
    pick = lambda df: df.select("path", "channel", "frame", r6("deviation").alias("deviation"))
    on_signals("detect_pops", lambda df: pick(O.pops(df, 2)), "," + d2.format("") + out)
    # Every third frame silent, so that some pops stand on a zero.
    gated = """, z AS (SELECT path, frame, channel, CASE WHEN frame % 3 = 1 THEN 0 ELSE value END AS value, nf FROM e), """
    on_signals("detect_pops_zero_only", lambda df: pick(O.pops(df.withColumn("value", F.when(F.col("frame") % 3 == 1, F.lit(0.0)).otherwise(F.col("value"))), 2, True)),
        gated + d2.format(" AND abs(before) <= 1e-4").replace("FROM e WINDOW", "FROM z WINDOW") + out)
    # Recursive over a path's repairs in order of frames, with the two repairs before.
    on_signals("pop_repair", lambda df: samples(O.repair_pops(df, O.pops(df, 2))), "," + d2.format("") + """, x AS (SELECT DISTINCT path, frame - 1 AS f FROM b),
        n AS (SELECT *, lag(value, 2) OVER w AS m2, lag(value, 1) OVER w AS m1, lead(value, 1) OVER w AS p1, lead(value, 2) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY path, channel ORDER BY frame)),
        k AS (SELECT n.*, row_number() OVER (PARTITION BY n.path ORDER BY frame) AS k FROM n JOIN x ON n.path = x.path AND n.frame = x.f WHERE frame >= 2 AND frame < nf - 2),
        r AS (SELECT path, k, frame, (9 * (m1 + p1) - m2 - p2) / 16 AS v, -9::BIGINT AS frame1, 0::DOUBLE AS v1 FROM k WHERE k = 1
            UNION ALL SELECT k.path, k.k, k.frame, (9 * (CASE WHEN r.frame = k.frame - 1 THEN r.v ELSE k.m1 END + k.p1)
                - CASE WHEN r.frame = k.frame - 2 THEN r.v WHEN r.frame1 = k.frame - 2 THEN r.v1 ELSE k.m2 END - k.p2) / 16, r.frame, r.v FROM r JOIN k ON k.path = r.path AND k.k = r.k + 1)
        SELECT e.path, e.frame, channel, round(coalesce(v, value), 6) + 0.0 AS value FROM e LEFT JOIN r ON r.path = e.path AND r.frame = e.frame""")  # fmt: skip
    on_signals("envelope", lambda df: O.envelope(df, 10).select("path", F.col("bucket").cast("long").alias("bucket"), r6("rms").alias("rms")), """SELECT path, frame // each AS bucket, round(sqrt(avg(m * m)), 6) + 0.0 AS rms
        FROM (SELECT path, frame, avg(value) AS m, greatest(1, any_value(nf) // 10) AS each FROM e GROUP BY path, frame) WHERE frame // each < 10 GROUP BY ALL""", 2)  # fmt: skip
    on_signals("chunk_grid", lambda df: O.chunk_levels(df, 0.25).select("path", F.col("chunk").cast("long").alias("chunk"), r6("at_seconds").alias("at_seconds"), r6("rms").alias("rms")), """, m AS (SELECT path, frame, sum(value) AS v FROM e GROUP BY ALL),
        n AS (SELECT path, frame, v / max(abs(v)) OVER (PARTITION BY path) AS v FROM m)
        SELECT path, frame // 16 AS chunk, round((min(frame) + count(*) / 2) / 64.0, 6) + 0.0 AS at_seconds, round(sqrt(avg(v * v)), 6) + 0.0 AS rms FROM n GROUP BY ALL""", 2)  # fmt: skip
    on_signals("phase_corr", lambda df: O.phase_correlation(df).select("path", r6("correlation").alias("correlation")), """SELECT path, round(sum(l * r) / sqrt(sum(l * l) * sum(r * r)), 6) + 0.0 AS correlation
        FROM (SELECT path, frame, max(value) FILTER (channel = 0) AS l, max(value) FILTER (channel = 1) AS r FROM e GROUP BY ALL) GROUP BY path""", 2)  # fmt: skip
    for kind, sign in (("low", -1), ("high", 1)):
        w = 2 * math.pi * 8 / 64
        c, alpha = math.cos(w), math.sin(w) / (2 * O.FILTER_Q)
        b0 = (1 + sign * c) / 2
        b1, a0, a1, a2 = -sign * 2 * b0, 1 + alpha, -2 * c, 1 - alpha
        coeffs = [x / a0 for x in (b0, b1, b0, a1, a2)]
        k = dict(zip(("b0", "b1", "b2", "a1", "a2"), map(repr, coeffs)))
        sql = f"""WITH RECURSIVE {V.signals_sql(1)}, f AS (SELECT path, 0::BIGINT AS frame, value * {k["b0"]} AS y, 0::DOUBLE AS y1, value AS x, 0::DOUBLE AS x1 FROM e WHERE frame = 0
            UNION ALL SELECT e.path, e.frame, {k["b0"]} * e.value + {k["b1"]} * f.x + {k["b2"]} * f.x1 - {k["a1"]} * f.y - {k["a2"]} * f.y1, f.y, e.value, f.x FROM f JOIN e ON e.path = f.path AND e.frame = f.frame + 1)
            SELECT path, frame, 0::BIGINT AS channel, round(y, 6) + 0.0 AS value FROM f"""
        add(f"{kind}pass", lambda spark, d, kind=kind: samples(O.pass_filter(V.signals(spark, d), kind, 8)), sql)
    ratio = 2 ** (-700 / 1200)
    add("tune_samples", lambda spark, d: O.tuned(V.signals(spark, d), 700).select("path", "frame", "channel", (F.round("value", 4) + F.lit(0.0)).alias("value")), tuned_sql(ratio))
    add("tune_length", lambda spark, d: O.tuned_length(V.signals(spark, d), 700), f"WITH {V.signals_sql(1)} SELECT path, trunc(any_value(nf) * {ratio!r})::BIGINT AS frames FROM e GROUP BY path")
    # A set of one file is a search in its own frames only: no frame means no change.
    on_signals("zcross_no_search", lambda df: samples(O.zcross_offset(df, "0")), "SELECT path, frame, channel, round(value, 6) + 0.0 AS value FROM e")
    on_signals("xfade_loop_too_short", lambda df: samples(O.crossfade_loop(df, 1)), "SELECT path, frame, channel, round(value, 6) + 0.0 AS value FROM e")
    for kind, b, a in FILTERS:
        k = dict(zip(("b0", "b1", "b2", "a1", "a2"), map(repr, (*b, *a))))
        sql = f"""WITH RECURSIVE {V.signals_sql(1)}, f AS (SELECT path, 0::BIGINT AS frame, value * {k["b0"]} AS y, 0::DOUBLE AS y1, value AS x, 0::DOUBLE AS x1 FROM e WHERE frame = 0
            UNION ALL SELECT e.path, e.frame, {k["b0"]} * e.value + {k["b1"]} * f.x + {k["b2"]} * f.x1 - {k["a1"]} * f.y - {k["a2"]} * f.y1, f.y, e.value, f.x FROM f JOIN e ON e.path = f.path AND e.frame = f.frame + 1)
            SELECT path, frame, 0::BIGINT AS channel, round(y, 6) + 0.0 AS value FROM f"""
        add(f"filter_{kind}", lambda spark, d, kind=kind: samples(O.filtered(V.signals(spark, d), kind, 8, gain_db=6)), sql)


def tuned_sql(ratio: float) -> str:
    """The 64 frames of each signal read off at every 1 / ratio, by the continuous Kaiser-windowed sinc that the resampler's stages amount to.

    Its cut lies in the middle of the last 2 % of the lower rate's band, its length is Kaiser's for 183 dB over that transition, and I0 is a sum.
    """
    attenuation = 183.0
    beta, half, cut = 0.1102 * (attenuation - 8.7), math.ceil((attenuation - 7.95) / (2.285 * math.pi * 0.02) / 2), 0.99 * min(1.0, ratio)
    half = math.ceil(half / min(1.0, ratio))
    bessel = "list_sum(list_transform(range(0, 70), lambda i: exp(2 * (i * ln(greatest({0}, 1e-300) / 2) - lgamma(i + 1)))))"
    return f"""WITH {V.signals_sql(1)}, t AS (SELECT m.k AS m, j.k AS j, m.k / {ratio!r} - j.k AS d FROM (SELECT unnest(range({int(64 * ratio)})) AS k) m, (SELECT unnest(range(64)) AS k) j),
        h AS (SELECT m, j, {cut!r} * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * {cut!r} * d) / (pi() * {cut!r} * d) END * {bessel.format(f"({beta!r} * sqrt(1 - d * d / {float(half * half)!r}))")} / {bessel.format(f"{beta!r}::DOUBLE")} AS w FROM t)
        SELECT path, m AS frame, 0::BIGINT AS channel, round(sum(value * w), 4) + 0.0 AS value FROM e JOIN h ON j = frame GROUP BY path, m"""


#: Second-order filters at 8 of 64 Hz, Q 0.70710678118, 6 dB: kind, b and a as worked out apart from the operator.
_W, _A = 2 * math.pi * 8 / 64, 10 ** (6 / 40)
_C, _L = math.cos(_W), math.sin(_W) / (2 * 0.70710678118)
_R = 2 * math.sqrt(_A) * _L
_LOW, _HIGH = _A + 1 + (_A - 1) * _C + _R, _A + 1 - (_A - 1) * _C + _R
FILTERS = [
    ("band", (_L / (1 + _L), 0.0, -_L / (1 + _L)), (-2 * _C / (1 + _L), (1 - _L) / (1 + _L))),
    ("band_skirt", (math.sin(_W) / 2 / (1 + _L), 0.0, -math.sin(_W) / 2 / (1 + _L)), (-2 * _C / (1 + _L), (1 - _L) / (1 + _L))),
    ("notch", (1 / (1 + _L), -2 * _C / (1 + _L), 1 / (1 + _L)), (-2 * _C / (1 + _L), (1 - _L) / (1 + _L))),
    ("all", ((1 - _L) / (1 + _L), -2 * _C / (1 + _L), 1.0), (-2 * _C / (1 + _L), (1 - _L) / (1 + _L))),
    ("peak", ((1 + _L * _A) / (1 + _L / _A), -2 * _C / (1 + _L / _A), (1 - _L * _A) / (1 + _L / _A)), (-2 * _C / (1 + _L / _A), (1 - _L / _A) / (1 + _L / _A))),
    (
        "low_shelf", (_A * (_A + 1 - (_A - 1) * _C + _R) / _LOW, 2 * _A * (_A - 1 - (_A + 1) * _C) / _LOW, _A * (_A + 1 - (_A - 1) * _C - _R) / _LOW),
        (-2 * (_A - 1 + (_A + 1) * _C) / _LOW, (_A + 1 + (_A - 1) * _C - _R) / _LOW),
    ),
    (
        "high_shelf", (_A * (_A + 1 + (_A - 1) * _C + _R) / _HIGH, -2 * _A * (_A - 1 + (_A + 1) * _C) / _HIGH, _A * (_A + 1 + (_A - 1) * _C - _R) / _HIGH),
        (2 * (_A - 1 - (_A + 1) * _C) / _HIGH, (_A + 1 - (_A - 1) * _C - _R) / _HIGH),
    ),
]


def grouped() -> None:
    add("automap_ranges", lambda spark, d: G.key_ranges(V.roots(spark, d)).select("folder", "root", "low", "high"), f"""WITH {V.ROOTS_SQL} SELECT folder, root,
        coalesce(lag(root) OVER w + (root - lag(root) OVER w) // 2 + 1, 0) AS low, coalesce(root + (lead(root) OVER w - root) // 2, 127) AS high FROM r WINDOW w AS (PARTITION BY folder ORDER BY root, file)""")  # fmt: skip
    add("blend_plan", lambda spark, d: G.blend_plan(V.roots(spark, d), 1).select("folder", "lower", "upper", "note", r6("lower_weight").alias("lower_weight"), r6("upper_weight").alias("upper_weight")),
        f"""WITH {V.ROOTS_SQL}, p AS (SELECT folder, root AS lower, lead(root) OVER (PARTITION BY folder ORDER BY root, file) AS upper FROM r), n AS (SELECT *, unnest(range(lower + 1, upper)) AS note FROM p WHERE lower + 1 < upper)
        SELECT *, round(1 - (note - lower) / (upper - lower)::DOUBLE, 6) + 0.0 AS lower_weight, round(1 - (upper - note) / (upper - lower)::DOUBLE, 6) + 0.0 AS upper_weight FROM n""")  # fmt: skip
    add("blend_pairs", lambda spark, d: G.blend_plan(V.roots(spark, d), 1).select("folder", "lower_file", "upper_file").distinct(),
        f"WITH {V.ROOTS_SQL} SELECT folder, file AS lower_file, f2 AS upper_file FROM (SELECT *, lead(root) OVER w AS r2, lead(file) OVER w AS f2 FROM r WINDOW w AS (PARTITION BY folder ORDER BY root, file)) WHERE root + 1 < r2")
    add("sample_sets_apply", lambda spark, d: G.sample_sets(V.takes(spark, d), "men-take[0-9]+-([a-z]+)", "en").filter("authority IS NOT NULL").select("path", "set_key", "authority"),
        f"WITH {V.TAKES_SQL} SELECT t.path, t.set_key, a.path AS authority FROM t JOIN (SELECT set_key, min(path) AS path FROM t WHERE lang = 'en' GROUP BY set_key) a ON a.set_key = t.set_key")
    add("authority_file", lambda spark, d: G.sample_sets(V.takes(spark, d), "(.*)", "men-take1-en").select("path", "set_key", "authority"),
        f"WITH {V.TAKES_SQL} SELECT path, '*' AS set_key, (SELECT min(path) FROM t WHERE stem = 'men-take1-en') AS authority FROM t")
    add("set_mismatch_anti", lambda spark, d: G.sets_without_authority(V.takes(spark, d), "men-take[0-9]+-([a-z]+)", "es"),
        f"WITH {V.TAKES_SQL} SELECT DISTINCT set_key FROM t WHERE set_key NOT IN (SELECT set_key FROM t WHERE lang = 'es')")
    midi = "m AS (SELECT n AS note, round(440 * pow(2, (n - 69) / 12.0), 2) AS p FROM (SELECT unnest(range(128)) AS n))"
    hz = "p_retailprice * 4"
    add("nearest_midi", lambda spark, d: V.table(spark, d, "part").select("p_partkey", S.nearest_note(F.col("p_retailprice") * 4).cast("long").alias("note"), S.note_name(S.nearest_note(F.col("p_retailprice") * 4)).alias("name")),
        f"""WITH {midi} SELECT p_partkey, note, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][note % 12 + 1] || (note // 12 - 1) AS name
        FROM (SELECT p_partkey, arg_min(note, {{'d': abs({hz} - p), 'n': note}}) AS note FROM part, m GROUP BY p_partkey)""")  # fmt: skip
    add("middle_c", lambda spark, d: V.table(spark, d, "part").select("p_partkey", S.octave_near_middle_c(F.col("p_size")).cast("long").alias("note")),
        "SELECT p_partkey, (CASE WHEN p_size % 12 < 6 THEN 60 + p_size % 12 ELSE 48 + p_size % 12 END)::BIGINT AS note FROM part")


def named() -> None:
    f = lambda name, run, sql: add(name, lambda spark, d: run(V.files(spark, d)), f"WITH {V.FILES_SQL} {sql}")
    f("exclude_glob", lambda x: G.excluded(x, "src1*/**", "*/en-*.wav").select("path"), "SELECT path FROM f WHERE NOT regexp_full_match(path, 'src1[^/]*/.*') AND NOT regexp_full_match(path, '[^/]*/en-[^/]*[.]wav')")
    f("audio_filter", lambda x: G.audio_only(x).select("path"), "SELECT path FROM f WHERE doc_id % 11 <> 0")
    f("path_conflicts", lambda x: G.conflicts(x.select(F.concat_ws("/", "folder", "lang").alias("path"))), "SELECT folder || '/' || lang AS path, count(*) AS files FROM f GROUP BY 1 HAVING count(*) > 1")
    f("output_folder_map", lambda x: x.select("path", G.output_path(F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("../")).otherwise(F.lit("")), "path"), "out").alias("new_path")),
        "SELECT path, 'out/' || CASE WHEN doc_id % 5 = 0 THEN regexp_extract(path, '([^/]*)$', 1) ELSE path END AS new_path FROM f")
    f("rename_prefix_suffix", lambda x: x.select("path", F.concat(F.lit("pre_"), "stem", F.lit("_suf")).alias("name")), "SELECT path, 'pre_' || stem || '_suf' AS name FROM f")
    f("rename_regex_groups", lambda x: x.select("path", G.renamed_by_regex(F.col("stem"), "([a-z]+)-([0-9]*)5", "<2>_<1>_<0>").alias("name")),
        "SELECT path, CASE WHEN doc_id % 10 = 5 THEN left((doc_id::VARCHAR), length(doc_id::VARCHAR) - 1) || '_' || lang || '_' || stem ELSE stem END AS name FROM f")
    f("folderise", lambda x: G.folderised(x, "(en|de)-([0-9]).*", "<1><2>").select("path", "new_path"),
        "SELECT path, CASE WHEN lang IN ('en', 'de') THEN lang || left(doc_id::VARCHAR, 1) || '/' || regexp_extract(path, '([^/]*)$', 1) ELSE path END AS new_path FROM f")
    f("move_plan", lambda x: x.select("path", F.concat(F.lit("dest/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("new_path")), "SELECT path, 'dest/' || regexp_extract(path, '([^/]*)$', 1) AS new_path FROM f")
    f("rename_counter", lambda x: G.counted(x).select("path", F.col("counter").cast("long").alias("counter")), "SELECT path, row_number() OVER (ORDER BY folder, path) - 1 AS counter FROM f")
    f("rename_alpha_counter", lambda x: G.counted(x).select("path", S.alpha_id(F.col("counter")).alias("id")),
        "SELECT path, CASE WHEN n < 17576 THEN chr((97 + n // 676)::INT) || chr((97 + n // 26 % 26)::INT) || chr((97 + n % 26)::INT) ELSE n::VARCHAR END AS id FROM (SELECT path, row_number() OVER (ORDER BY folder, path) - 1 AS n FROM f)")
    # Two notes in a name, the second one twice.
    low = lambda: F.element_at(F.array(*[F.lit(x) for x in ("c", "D#", "Gb", "a")]), (F.col("doc_id") % 4 + 1).cast("int"))
    note = lambda: F.concat(F.lit("take_"), low(), (F.col("doc_id") % 7).cast("string"), F.lit("_F"), (F.col("doc_id") % 3).cast("string"), F.lit(" x-F"), (F.col("doc_id") % 3).cast("string"))
    f("note_to_midi", lambda x: x.select("path", G.note_to_midi(note()).alias("name")), """SELECT path, 'take_' || CASE doc_id % 4 WHEN 0 THEN (12 * (doc_id % 7 + 1))::VARCHAR WHEN 1 THEN (12 * (doc_id % 7 + 1) + 3)::VARCHAR
        WHEN 3 THEN (12 * (doc_id % 7 + 1) + 9)::VARCHAR ELSE 'Gb' || (doc_id % 7) END || '_' || (12 * (doc_id % 3 + 1) + 5) || ' x-' || (12 * (doc_id % 3 + 1) + 5) AS name FROM f""")  # fmt: skip
    c = lambda name, run, sql: add(name, lambda spark, d: run(V.table(spark, d, "part")), sql)
    c("snake_camel", lambda x: x.select("p_partkey", S.snake_case(F.col("p_type")).alias("snake"), S.camel_case(F.lower("p_type")).alias("camel")),
        "SELECT p_partkey, replace(replace(lower(p_type), ' ', '_'), '-', '_') AS snake, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(left(w, 1)) || w[2:]), '') AS camel FROM part")


def nested() -> None:
    def on_regions(name: str, change: Callable[[], Column], sql: str) -> None:
        run = lambda spark, d: V.regions(spark, d).select("path", F.inline(change())).select("path", "start_frame", "num_frames")
        add(name, run, f"WITH {V.REGIONS_SQL} SELECT path, {sql}")

    on_regions("md_trim_start", lambda: G.cut_start(F.col("regions"), F.lit(2)), "s - 2 AS start_frame, n AS num_frames FROM g WHERE s >= 2")
    on_regions("md_trim_end", lambda: G.cut_end(F.col("regions"), F.lit(30)), "s AS start_frame, n AS num_frames FROM g WHERE s + n <= 30")
    on_regions("md_stretch", lambda: G.stretched(F.col("regions"), 1.7), "trunc(s * 1.7::DOUBLE)::BIGINT AS start_frame, trunc(n * 1.7::DOUBLE)::BIGINT AS num_frames FROM g")
    on_regions("md_reverse", lambda: G.reversed_items(F.col("regions"), F.lit(100)), "100 - s - n AS start_frame, n AS num_frames FROM g")

    def entries(spark: SparkSession, d: str) -> DataFrame:
        return V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_shipdate").cast("date").cast("string").alias("metadata"), F.col("l_linenumber").alias("line"))

    def orders(spark: SparkSession, d: str) -> DataFrame:
        return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("metadata"))

    add("import_by_path", lambda spark, d: G.imported(orders(spark, d), entries(spark, d)), """SELECT o_orderkey AS path, CASE WHEN m IS NULL THEN o_orderpriority ELSE m END AS metadata FROM orders
        LEFT JOIN (SELECT l_orderkey, arg_max(l_shipdate::DATE::VARCHAR, {'l': l_linenumber, 'm': l_shipdate::DATE::VARCHAR}) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")  # fmt: skip
    add("import_broadcast", lambda spark, d: G.imported_for_all(orders(spark, d), entries(spark, d).filter("path = 3").orderBy("line", "metadata").limit(1)), """SELECT o_orderkey AS path,
        (SELECT arg_min(l_shipdate::DATE::VARCHAR, {'l': l_linenumber, 'm': l_shipdate::DATE::VARCHAR}) FROM lineitem WHERE l_orderkey = 3) AS metadata FROM orders""")  # fmt: skip

    def chunks(spark: SparkSession, d: str) -> DataFrame:
        kind = F.element_at(F.array(F.lit("inst"), F.lit("smpl"), F.lit("acid")), (F.col("l_linenumber") % 3 + 1).cast("int"))
        return V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path"), kind.alias("chunk")).agg(F.min("l_quantity").cast("long").alias("note")).withColumn("valid", (F.col("chunk") != "acid") | (F.col("note") % 2 == 0))

    add("root_note_precedence", lambda spark, d: G.root_note(chunks(spark, d)), """SELECT path, coalesce(max(note) FILTER (k = 0), max(note) FILTER (k = 1), max(note) FILTER (k = 2 AND note % 2 = 0)) AS root
        FROM (SELECT l_orderkey AS path, l_linenumber % 3 AS k, min(l_quantity)::BIGINT AS note FROM lineitem GROUP BY ALL) GROUP BY path""")  # fmt: skip
    add("metadata_export_json", lambda spark, d: orders(spark, d).select(F.to_json(F.struct("metadata", "path"), {"ignoreNullFields": "false"}).alias("line")),
        """SELECT '{"metadata":"' || o_orderpriority || '","path":' || o_orderkey || '}' AS line FROM orders""")  # fmt: skip


for part in (fades, levels, pointwise, neighbours, grouped, named, nested):
    part()
