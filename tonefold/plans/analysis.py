"""Queries of reports, spectra, pitch and WAV files, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonefold.operators import metadata as M
from tonefold.operators import pitch as P
from tonefold.operators import reports as R
from tonefold.operators import signals as O
from tonefold.operators import spectra as X
from tonefold.plans import views as V
from tonefold.plans.queries import add, on_signals, r6, samples
from tonefold.plans.records import NOTES_SQL
from tonefold.sources import wav

LEVELS_SQL = "v AS (SELECT path, count(*) // 2 AS frames, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, arg_max(frame, {'a': abs(value), 'f': -frame}) AS peak_frame FROM e GROUP BY path)"


def about(spark: SparkSession, d: str) -> DataFrame:
    """Depth and record of each embedding's file; every third has none."""
    root = M.with_sampler(F.lit(None).cast(M.METADATA), F.col("label") + 60)
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.lit(24).alias("bits_per_sample"), F.when(F.col("vec_id") % 3 > 0, root).alias("metadata"))


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Events as chunks of their user's pitch track, a tenth of a second each: whole hertz near 200, every fourth unvoiced."""
    e = V.table(spark, d, "events").select(F.col("user_id").alias("path"), "event_id", "value")
    chunk = (F.row_number().over(W.partitionBy("path").orderBy("event_id")) - 1).cast("long")
    rows = e.withColumns({"chunk": chunk, "n": F.count(F.lit(1)).over(W.partitionBy("path"))})
    hz = F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(200 + F.floor(F.col("value")) % 6)
    return rows.select("path", "chunk", ((F.col("chunk") + 0.5) / 10).alias("at_seconds"), hz.cast("double").alias("hz"), (F.col("value") / 500).alias("rms"), (F.col("n") / 10).alias("total_seconds"))


TRACKS_SQL = """k AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS chunk, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 200 + floor(value)::BIGINT % 6 END::DOUBLE AS hz,
    value / 500 AS rms, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def reports() -> None:
    shown = ("bit_depth", "channels", "frames", "peak_frame", "sample_rate", "length_seconds")
    rounded = ("rms_db", "peak_db", "crest_factor", "crest_factor_db")
    full = lambda spark, d: R.info(V.signals(spark, d, 2), about(spark, d))
    add("print_info_full", lambda spark, d: full(spark, d).select("path", *shown, *[r6(c).alias(c) for c in rounded], F.col("metadata.midi_mapping.root_midi_note").alias("root")), f"""WITH {V.signals_sql(2)}, {LEVELS_SQL}
        SELECT path, 24 AS bit_depth, 2::BIGINT AS channels, frames, peak_frame, 64::BIGINT AS sample_rate, frames / 64 AS length_seconds, round(20 * log10(rms), 6) + 0.0 AS rms_db, round(20 * log10(peak), 6) + 0.0 AS peak_db,
        round(peak / rms, 6) + 0.0 AS crest_factor, round(20 * log10(peak / rms), 6) + 0.0 AS crest_factor_db, CASE WHEN path % 3 > 0 THEN label + 60 END AS root FROM v JOIN embeddings ON vec_id = path""")  # fmt: skip
    some = lambda spark, d: R.picked(full(spark, d), "^(frames|bit_|peak_f|meta)")
    record = """CASE WHEN path % 3 = 0 THEN 'null' ELSE '{"midi_mapping":{"root_midi_note":' || (label + 60) || ',"sampler_mapping":{"fine_tune_cents":0,"gain_db":0,"low_note":0,"high_note":127,"low_velocity":1,"high_velocity":127}},'
        || '"timing_info":null,"loops":null,"markers":null,"regions":null}' END"""
    rows = f"WITH {V.signals_sql(2)}, {LEVELS_SQL}, m AS (SELECT v.*, label, {record} AS metadata FROM v JOIN embeddings ON vec_id = path) "
    add("report_json", lambda spark, d: R.as_json(some(spark, d)), rows + """SELECT path, '{"bit_depth":24,"frames":' || frames || ',"metadata":' || metadata || ',"path":"' || path || '","peak_frame":' || peak_frame || '}' AS json FROM m""")
    add("report_path_as_key", lambda spark, d: R.as_json(some(spark, d), path_as_key=True), rows + """SELECT path, '{"' || path || '":{"bit_depth":24,"frames":' || frames || ',"metadata":' || metadata || ',"peak_frame":' || peak_frame || '}}' AS json FROM m""")
    add("report_lua", lambda spark, d: R.as_lua(some(spark, d)), rows + """SELECT path, replace('{@    bit_depth = 24,@    frames = ' || frames || CASE WHEN path % 3 = 0 THEN '' ELSE ',@    metadata = {@      midi_mapping = {@        root_midi_note = ' || (label + 60)
        || ',@        sampler_mapping = {@          fine_tune_cents = 0,@          gain_db = 0,@          high_note = 127,@          high_velocity = 127,@          low_note = 0,@          low_velocity = 1@        }@      }@    }' END
        || ',@    path = "' || path || '",@    peak_frame = ' || peak_frame || '@  }', '@', chr(10)) AS lua FROM m""")  # fmt: skip
    on_signals("detect_pops_report", lambda df: R.pop_lines(O.pops(df, 2)), """, d AS (SELECT *, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d2 FROM e WINDOW w AS (PARTITION BY path, channel ORDER BY frame)),
        s AS (SELECT *, abs(d2 - avg(d2) OVER p) AS deviation, stddev_samp(d2) OVER p AS sd FROM d WINDOW p AS (PARTITION BY path, channel)),
        o AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY path, channel ORDER BY frame) <= 1 THEN 0 ELSE 1 END AS new FROM s WHERE deviation > 2 * greatest(sd, 1e-5)),
        c AS (SELECT *, sum(new) OVER (PARTITION BY path, channel ORDER BY frame) AS cluster FROM o), b AS (SELECT path, channel, arg_max(frame, {'d': deviation, 'f': -frame}) AS frame FROM c GROUP BY path, channel, cluster)
        SELECT path, channel, CASE channel WHEN 0 THEN 'L' ELSE 'R' END AS side, string_agg(frame::VARCHAR, ', ' ORDER BY frame) AS frames, count(*) AS pops FROM b GROUP BY path, channel""", 2)  # fmt: skip
    on_signals("scale_to_peak", lambda df: samples(O.scaled_to(df, 0.5)), "SELECT path, frame, channel, round(value * 0.5 / max(abs(value)) OVER (PARTITION BY path), 6) + 0.0 AS value FROM e", 2)


def wav_files() -> None:
    def there_and_back(spark: SparkSession, d: str) -> DataFrame:
        """Every embedding at every depth, twice as loud as it is."""
        rows = wav.in_rows(V.signals(spark, d, 2)).withColumn("samples", F.transform("samples", lambda x: x * 2)).withColumn("bits", F.explode(F.array(*[F.lit(b) for b in wav.DEPTHS])))
        files = wav.with_content(rows.withColumn("path", F.concat_ws(":", F.col("bits").cast("string"), F.col("path").cast("string"))), F.col("bits"))
        back = wav.signals(wav.read(files))
        return back.select(F.split("path", ":")[0].cast("long").alias("bits"), F.split("path", ":")[1].cast("long").alias("path"), "frame", "channel", (F.round("value", 4) + F.lit(0.0)).alias("value"))

    # What clips at 24 bits, which isn't scaled down, goes round.
    level = lambda bits: f"round(CASE WHEN s < 0 THEN s * {1 << (bits - 1)} ELSE s * {(1 << (bits - 1)) - 1} END)::BIGINT"
    whole = lambda bits: f"((({level(bits)} + {1 << (bits - 1)}) % {1 << bits} + {1 << bits}) % {1 << bits} - {1 << (bits - 1)}) / {1 << (bits - 1)}"
    add("wav_roundtrip", there_and_back, f"""WITH {V.signals_sql(2)}, p AS (SELECT *, 2 * value AS loud, greatest(1, max(abs(2 * value)) OVER (PARTITION BY path)) AS peak FROM e),
        b AS (SELECT p.*, bits, CASE WHEN bits IN (8, 16) THEN loud * (1 / peak) ELSE loud END AS s FROM p, (SELECT unnest([8, 16, 24, 32, 64])::BIGINT AS bits))
        SELECT bits, path, frame, channel, round(CASE bits WHEN 8 THEN trunc((s + 1) / 2 * 255) * (2 / 255.0::DOUBLE) - 1 WHEN 16 THEN {whole(16)} WHEN 24 THEN {whole(24)} ELSE s END::FLOAT::DOUBLE, 4) + 0.0 AS value FROM b""")  # fmt: skip


def spectra() -> None:
    size = 16
    add("spectrum", lambda spark, d: X.magnitudes(V.signals(spark, d, 2), size).select("path", "bin", r6("magnitude").alias("magnitude")), f"""WITH {V.signals_sql(2)}, m AS (SELECT path, frame, sum(value) / 2 AS v FROM e GROUP BY ALL),
        h AS (SELECT n, 0.5 * (1 - cos(2 * pi() * n / {size - 1})) AS w FROM (SELECT unnest(range({size})) AS n)),
        t AS (SELECT path, win, k, sum(v * w * cos(2 * pi() * k * n / {size})) AS re, sum(v * w * sin(2 * pi() * k * n / {size})) AS im FROM m JOIN (SELECT unnest(range(3)) AS win) ON true
            JOIN h ON frame = win * {size // 2} + n JOIN (SELECT unnest(range({size // 2 + 1})) AS k) ON true GROUP BY ALL)
        SELECT path, k AS bin, round(avg(sqrt(re * re + im * im)) * 2 / (SELECT sum(w) FROM h), 6) + 0.0 AS magnitude FROM t GROUP BY path, k""")  # fmt: skip
    bins = lambda spark, d: V.table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("bin", "m"))
    spectrum = lambda spark, d: bins(spark, d).filter("bin <= 32").select("path", F.col("bin").cast("long").alias("bin"), F.abs("m").cast("double").alias("magnitude"), F.lit(44_100).cast("long").alias("sample_rate"))
    per_bin, edge = 44_100 / 64, "20.0::DOUBLE * pow(22050 / 20.0::DOUBLE, {} / 32::DOUBLE)"
    add("spectrum_bands", lambda spark, d: X.bands(spectrum(spark, d), size=64).select("path", "band", r6("db").alias("db")), f"""WITH b AS (SELECT n AS band, greatest(1, floor({edge.format("n")} / {per_bin!r})) AS lo, least(33, ceil({edge.format("(n + 1)")} / {per_bin!r}) + 1) AS hi
            FROM (SELECT unnest(range(32)) AS n)), s AS (SELECT vec_id AS path, unnest(range(len(embedding))) AS bin, abs(unnest(embedding)::DOUBLE) AS m FROM embeddings)
        SELECT path, band::INT AS band, round(20 * log10(sqrt(avg(m * m))), 6) + 0.0 AS db FROM s JOIN b ON bin >= lo AND bin < hi WHERE bin <= 32 GROUP BY path, band""")  # fmt: skip
    add("track_columns", lambda spark, d: X.track_columns(tracks(spark, d), 96), f"""WITH {TRACKS_SQL}, c AS (SELECT *, least(95, floor((chunk + 0.5::DOUBLE) / 10 / (n / 10 / 96))) AS col FROM k),
        g AS (SELECT path, col, list_sort(list(hz) FILTER (hz > 0)) AS voiced, arg_max(hz, chunk) AS late FROM c GROUP BY ALL), f AS (SELECT path, arg_min(hz, chunk) AS early FROM k GROUP BY path),
        x AS (SELECT path, early, col FROM f, (SELECT unnest(range(96))::DOUBLE AS col))
        SELECT x.path, x.col::INT AS column, CASE WHEN g.col = x.col THEN voiced[len(voiced) // 2 + 1] ELSE nullif(coalesce(late, early), 0) END AS hz FROM x ASOF LEFT JOIN g ON g.path = x.path AND g.col <= x.col""")  # fmt: skip


def pitches() -> None:
    weight = "sum(CASE WHEN b.hz > 0 THEN 10 * exp(-pow(b.hz - a.hz, 2) / (2 * 0.81)) ELSE 0 END)"
    add("chunk_agreement", lambda spark, d: P.best_chunk(tracks(spark, d), "path"), f"""WITH {TRACKS_SQL}, w AS (SELECT a.path, a.chunk, a.hz, a.rms, {weight} AS agreed FROM k a JOIN k b ON a.path = b.path GROUP BY ALL),
        l AS (SELECT *, agreed * CASE WHEN max(rms) OVER p > min(rms) OVER p THEN 1 + 1.5 * sin((rms - min(rms) OVER p) / (max(rms) OVER p - min(rms) OVER p) * pi() / 2) ELSE 1 END AS weight FROM w WINDOW p AS (PARTITION BY path))
        SELECT path, nullif(arg_max(hz, {{'w': weight, 'c': -chunk}}), 0) AS hz FROM l GROUP BY path""")  # fmt: skip
    # Four pitches for each part: octaves of its size, some off by more than agrees, some missing.
    cents = lambda: F.explode(F.array(*[F.lit(c) for c in P.OCTAVES]))
    shift = lambda: F.pow(F.lit(2.0), F.col("cents") / 1200)
    off = lambda: F.when((F.col("p_partkey") + F.col("cents") / 600) % 3 == 0, 4.0).otherwise(0.0)
    hz = lambda: F.when((F.col("p_partkey") + F.col("cents") / 1200) % 5 > 0, (100.0 + F.col("p_size")) * shift() + off())
    octaves = lambda spark, d: V.table(spark, d, "part").select("*", cents().alias("cents")).select(F.col("p_partkey").alias("path"), "cents", hz().alias("hz"))
    octaves_sql = """s AS (SELECT p_partkey AS path, c AS cents, CASE WHEN (p_partkey + c // 1200) % 5 > 0 THEN (100.0::DOUBLE + p_size) * pow(2, c / 1200) + CASE WHEN (p_partkey + c // 600) % 3 = 0 THEN 4 ELSE 0 END END AS hz
        FROM part, (SELECT unnest([-2400, -1200, 0, 1200]) AS c))"""
    add("pitch_vote", lambda spark, d: P.octave_vote(octaves(spark, d)).select("path", r6("hz").alias("hz"), r6("confidence").alias("confidence")), f"""WITH {octaves_sql},
        v AS (SELECT a.path, a.cents, a.hz, count(*) FILTER (a.hz IS NOT NULL AND b.hz IS NOT NULL AND abs(a.hz * pow(2, (b.cents - a.cents) / 1200) - b.hz) < 1.5) AS votes FROM s a JOIN s b ON a.path = b.path GROUP BY ALL),
        t AS (SELECT path, arg_max({{'c': cents, 'h': hz, 'v': votes}}, {{'v': votes, 'c': -cents}}) AS b FROM v GROUP BY path)
        SELECT path, round(b.h * pow(2, -b.c / 1200), 6) + 0.0 AS hz, CASE WHEN b.h IS NOT NULL THEN round(greatest(0, (b.v - 1) / 3), 6) + 0.0 END AS confidence FROM t""")  # fmt: skip
    found = lambda spark, d: V.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice") / 3).alias("hz"))
    expected = lambda spark, d: V.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 128).cast("int")).alias("expected"))
    add("auto_tune_plan", lambda spark, d: P.tuning(found(spark, d), expected(spark, d)).select("path", F.col("note").cast("long").alias("note"), r6("cents").alias("cents")), f"""WITH {NOTES_SQL},
        q AS (SELECT p_partkey AS path, p_retailprice / 3 AS hz FROM part WHERE p_partkey % 9 > 0),
        b AS (SELECT path, hz, arg_min({{'n': note, 'p': pitch}}, {{'d': abs(hz - pitch), 'n': note}}) AS m FROM q, notes GROUP BY ALL), c AS (SELECT path, m.n AS note, 1200 * log2(m.p / hz) AS cents FROM b)
        SELECT p_partkey AS path, note, CASE WHEN note IS NOT NULL AND (p_partkey % 2 = 1 OR (p_partkey % 128 - note) % 12 = 0) THEN CASE WHEN abs(cents) < 1 THEN 0 ELSE round(cents, 6) + 0.0 END END AS cents
        FROM part LEFT JOIN c ON path = p_partkey""")  # fmt: skip
    add("mir_report", lambda spark, d: R.mir(V.signals(spark, d, 2), P.detected(V.signals(spark, d, 2)), P.track(V.signals(spark, d, 2)), size=16))
    add("pitch_track", lambda spark, d: P.track(V.signals(spark, d), 0.5))
    add("detect_pitch", lambda spark, d: P.detected(V.signals(spark, d)))
    roots = lambda spark, d: V.table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.floor(F.col("vec_id") / 8).alias("folder"), (F.col("vec_id") % 8 * 3 + 40).alias("root"))
    add("blend_samples", lambda spark, d: P.blended(V.signals(spark, d), roots(spark, d), 1))


for part in (reports, wav_files, spectra, pitches):
    part()
