"""Queries of names, metadata records and files, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold.operators import conversion as C
from tonefold.operators import metadata as M
from tonefold.operators import naming as N
from tonefold.operators import sets as G
from tonefold.plans import views as V
from tonefold.plans.queries import add

NOTES_SQL = "notes AS (SELECT n AS note, round(440 * pow(2, (n - 69) / 12.0), 2) AS pitch, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][n % 12 + 1] || (n // 12 - 1) AS name FROM (SELECT unnest(range(128)) AS n))"


# Files that the tables stand for
def tones(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files brand/tone-<size>-v<key>.wav; the root is the size."""
    p = V.table(spark, d, "part")
    stem = F.concat(F.lit("tone-"), F.col("p_size").cast("string"), F.lit("-v"), F.col("p_partkey").cast("string"))
    return p.select(F.concat("p_brand", F.lit("/"), stem, F.lit(".wav")).alias("path"), F.col("p_brand").alias("folder"), stem.alias("stem"), "p_partkey", "p_size")


TONES_SQL = """t AS (SELECT p_brand || '/tone-' || p_size || '-v' || p_partkey || '.wav' AS path, p_brand AS folder, 'tone-' || p_size || '-v' || p_partkey AS stem, p_partkey, p_size FROM part)"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of 1,000 to 50,000 frames: path, stem, folder, num_frames, sample_rate, and a record whose loops and markers are the order's lines."""
    line = F.struct(
        F.when(F.col("k") % 2 == 0, F.col("l_returnflag")).alias("name"), (F.col("k") % 3).cast("int").alias("type"), (F.col("k") * 100).cast("long").alias("start_frame"),
        F.col("l_quantity").cast("long").alias("num_frames"), F.col("k").cast("int").alias("num_times_to_loop"),
    )
    loops = V.lines(spark, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("x")))).alias("s")).select("l_orderkey", F.transform("s", lambda s: s["x"]).alias("loops"))
    o = V.table(spark, d, "orders").join(loops, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    mapping = F.struct((F.col("o_custkey") % 140).cast("int").alias("root_midi_note"), F.lit(None).cast(M.SAMPLER).alias("sampler_mapping"))
    markers = F.transform("loops", lambda x: F.struct(x["name"].alias("name"), x["start_frame"].alias("start_frame")))
    record = F.struct(
        F.when(F.col("o_orderkey") % 3 > 0, mapping).alias("midi_mapping"), F.lit(None).cast(M.TIMING).alias("timing_info"), F.coalesce("loops", F.array().cast(M.METADATA["loops"].dataType)).alias("loops"),
        F.coalesce(markers, F.array().cast(M.METADATA["markers"].dataType)).alias("markers"), F.array().cast(M.METADATA["regions"].dataType).alias("regions"),
    ).cast(M.METADATA)
    stem = F.concat_ws("_", F.lit("s"), (F.col("o_custkey") % 128).cast("string"), (F.col("o_orderkey") % 127 + 1).cast("string"))
    return o.select(F.col("o_orderkey").alias("path"), stem.alias("stem"), F.col("o_orderstatus").alias("folder"), (F.col("o_orderkey") % 49_001 + 1000).alias("num_frames"), F.lit(44_100).cast("long").alias("sample_rate"), record.alias("metadata"))


ORDERS_SQL = f"""{V.LINES_SQL}, l AS (SELECT l_orderkey, CASE WHEN k % 2 = 0 THEN l_returnflag END AS name, (k % 3)::INT AS type, (k * 100)::BIGINT AS start_frame, l_quantity::BIGINT AS num_frames, k::INT AS times FROM li),
    f AS (SELECT o_orderkey AS path, o_orderstatus AS folder, o_custkey % 128 AS a, o_orderkey % 127 + 1 AS b, o_orderkey % 49001 + 1000 AS nf, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 140 END AS root FROM orders)"""


def names() -> None:
    add("automap_rename", lambda spark, d: N.renamed(tones(spark, d), N.AutoMap("([a-z]+)-([0-9]+)-v([0-9]+)", 2, "<1>_<lo>_<root>_<hi>_<3>")).select("path", "new_path"), f"""WITH {TONES_SQL},
        w AS (SELECT *, lag(p_size) OVER w AS before, lead(p_size) OVER w AS after FROM t WINDOW w AS (PARTITION BY folder ORDER BY p_size, path))
        SELECT path, folder || '/tone_' || coalesce(before + (p_size - before) // 2 + 1, 0) || '_' || p_size || '_' || coalesce(p_size + (after - p_size) // 2, 127) || '_' || p_partkey || '.wav' AS new_path FROM w""")  # fmt: skip
    add("automap_problems", lambda spark, d: N.unmappable(tones(spark, d), N.AutoMap("([a-z]+)-([0-9]+)-v([0-9]+)", 3, "<3>")), f"WITH {TONES_SQL} SELECT path, 'no root note from 0 to 127' AS problem FROM t WHERE p_partkey > 127")
    hz = lambda: (F.col("doc_id") % 900 + 60).cast("double").alias("hz")
    given = "<parent-folder-snake>_<detected-note>_<detected-midi-note-octave-plus-1>_<detected-midi-note-octave-nearest-to-middle-c>_<detected-pitch>_<counter>_<alpha-counter>_"
    add("rename_variables", lambda spark, d: N.renamed(V.files(spark, d), prefix=given, pitch=V.files(spark, d).select("path", hz())).select("path", "new_path"), f"""WITH {V.FILES_SQL}, {NOTES_SQL},
        c AS (SELECT *, row_number() OVER (ORDER BY folder, path) - 1 AS n FROM f),
        p AS (SELECT h, arg_min(note, {{'d': abs(h - pitch), 'n': note}}) AS note FROM (SELECT DISTINCT doc_id % 900 + 60 AS h FROM f), notes GROUP BY h)
        SELECT path, folder || '/' || replace(replace(lower(folder), ' ', '_'), '-', '_') || '_' || name || '_' || (p.note + 12) || '_' || CASE WHEN p.note % 12 < 6 THEN 60 + p.note % 12 ELSE 48 + p.note % 12 END || '_' || round_even(pitch, 0)::INT || '_' || n || '_'
            || CASE WHEN n < 17576 THEN chr((97 + n // 676)::INT) || chr((97 + n // 26 % 26)::INT) || chr((97 + n % 26)::INT) ELSE n::VARCHAR END || '_' || stem || '.' || regexp_extract(path, '([a-z]*)$', 1) AS new_path
        FROM c JOIN p ON p.h = doc_id % 900 + 60 JOIN notes ON notes.note = p.note""")  # fmt: skip
    add("rename_problems", lambda spark, d: N.problems_of(N.renamed(V.files(spark, d), prefix="<detected-note><nonsense>")), f"""WITH {V.FILES_SQL}
        SELECT path, 'no value for <detected-note>' AS problem FROM f""")  # fmt: skip
    add("rename_order", lambda spark, d: N.renamed(V.files(spark, d), regex=("([a-z]+)-([0-9]*)7", "<2>-<1>"), prefix="c4-", suffix=".take", notes=True).select("path", "name", "new_path"), f"""WITH {V.FILES_SQL},
        n AS (SELECT *, '60-' || CASE WHEN doc_id % 10 = 7 THEN left(doc_id::VARCHAR, length(doc_id::VARCHAR) - 1) || '-' || lang ELSE stem END AS m FROM f)
        SELECT path, m || '.take' AS name, folder || '/' || m || '.' || regexp_extract(path, '([a-z]*)$', 1) AS new_path FROM n""")  # fmt: skip
    add("expected_note", lambda spark, d: N.expected_note(tones(spark, d), "tone-([0-9]+)-.*", 0).select("path", "expected", "expected_hz"), f"""WITH {TONES_SQL}, {NOTES_SQL}
        SELECT path, note AS expected, pitch AS expected_hz FROM t LEFT JOIN notes ON note = p_size + 12""")  # fmt: skip


    add("blend_problems", lambda spark, d: G.unblendable(tones(spark, d), root="p_size"), f"""WITH {TONES_SQL}, s AS (SELECT folder, count(*) AS n, count(DISTINCT p_size) AS roots FROM t GROUP BY folder)
        SELECT folder AS path, 'fewer than two files' AS problem FROM s WHERE n < 2 UNION ALL SELECT folder, 'two files have one root' FROM s WHERE roots < n""")  # fmt: skip
    add("folderise_problems", lambda spark, d: G.unmoved(G.folderised(V.files(spark, d), "(fr|xx)-.*", "<1>").withColumn("new_path", F.regexp_replace("new_path", "[0-9](?=[.])", ""))), f"""WITH {V.FILES_SQL},
        n AS (SELECT regexp_replace(CASE WHEN lang = 'fr' THEN 'fr/' || regexp_extract(path, '([^/]*)$', 1) ELSE path END, '[0-9]([.](?:wav|flac))$', '\\1') AS p FROM f)
        SELECT p AS path, 'more than one file would have this path' AS problem FROM n GROUP BY p HAVING count(*) > 1""")  # fmt: skip


def records() -> None:
    sampler = lambda f, *fields: f.select("path", *[F.col(f"metadata.midi_mapping.sampler_mapping.{c}").alias(c) for c in fields])
    add("sampler_root_regex", lambda spark, d: M.embed_root(orders(spark, d), "s_([0-9]+)_.*").select("path", F.col("metadata.midi_mapping.root_midi_note").alias("root"), F.col("metadata.midi_mapping.sampler_mapping.high_note").alias("high_note"), F.size("metadata.loops").alias("loops")),
        f"WITH {ORDERS_SQL} SELECT path, a::INT AS root, 127 AS high_note, (SELECT count(*) FROM l WHERE l_orderkey = path)::INT AS loops FROM f")
    add("sampler_velocity", lambda spark, d: sampler(M.embed_velocity_range(orders(spark, d), "s_[0-9]+_([0-9]+)", "unchanged"), "low_velocity", "high_velocity", "low_note"), f"WITH {ORDERS_SQL} SELECT path, b::INT AS low_velocity, 127 AS high_velocity, 0 AS low_note FROM f")
    add("sampler_note_range", lambda spark, d: sampler(M.embed_note_range(orders(spark, d), "12", "s_([0-9]+)_.*"), "low_note", "high_note"), f"WITH {ORDERS_SQL} SELECT path, 12 AS low_note, a::INT AS high_note FROM f")
    brands = lambda spark, d: V.roots(spark, d).select(F.concat("folder", F.lit("/"), F.lpad(F.col("file").cast("string"), 10, "0")).alias("path"), "folder", F.lit("x").alias("stem"), M.with_sampler(F.lit(None).cast(M.METADATA), F.col("root")).alias("metadata"))
    add("sampler_automap", lambda spark, d: sampler(M.embed_mapped_ranges(brands(spark, d)), "low_note", "high_note"), f"""WITH {V.ROOTS_SQL} SELECT folder || '/' || lpad(file::VARCHAR, 10, '0') AS path,
        coalesce(lag(root) OVER w + (root - lag(root) OVER w) // 2 + 1, 0)::INT AS low_note, coalesce(root + (lead(root) OVER w - root) // 2, 127)::INT AS high_note FROM r WINDOW w AS (PARTITION BY folder ORDER BY root, file)""")  # fmt: skip
    add("sampler_remove", lambda spark, d: M.without_sampler(orders(spark, d)).select("path", F.col("metadata.midi_mapping").isNull().alias("gone"), F.size("metadata.markers").alias("markers")),
        f"WITH {ORDERS_SQL} SELECT path, true AS gone, (SELECT count(*) FROM l WHERE l_orderkey = path)::INT AS markers FROM f")
    add("sampler_limits", lambda spark, d: orders(spark, d).select("path", M.within_limits(F.col("metadata"))["midi_mapping"]["root_midi_note"].alias("root")), f"WITH {ORDERS_SQL} SELECT path, CASE WHEN root IS NOT NULL THEN least(root, 127) END::INT AS root FROM f")
    last = lambda c: F.get("metadata.loops", F.size("metadata.loops") - 1)[c].alias(c)
    add("add_loop_points", lambda spark, d: M.add_loop(orders(spark, d), "-25%", "0", name="end", kind="PingPong", times=3).select("path", F.size("metadata.loops").alias("loops"), last("name"), last("type"), last("start_frame"), last("num_frames"), F.col("metadata.timing_info.playback_type").alias("playback_type")),
        f"""WITH {ORDERS_SQL} SELECT path, (1 + (SELECT count(*) FROM l WHERE l_orderkey = path))::INT AS loops, 'end' AS name, 2 AS type, nf - trunc(0.25::DOUBLE * nf)::BIGINT AS start_frame, trunc(0.25::DOUBLE * nf)::BIGINT AS num_frames, 1 AS playback_type FROM f""")
    add("add_loop_problems", lambda spark, d: M.unloopable(M.loop_points(orders(spark, d), "0.05s", length="500ms")), f"""WITH {ORDERS_SQL}
        SELECT path::VARCHAR AS path, 'the loop is empty or leaves the signal' AS problem FROM f WHERE least(2205, nf) + least(22050, nf) > nf""")  # fmt: skip
    loop = "{'name': name, 'type': type, 'start_frame': start_frame, 'num_frames': num_frames, 'num_times_to_loop': times}"
    add("metadata_export_nested", lambda spark, d: M.exported(orders(spark, d)), f"""WITH {ORDERS_SQL},
        g AS (SELECT l_orderkey, list({loop} ORDER BY times) AS loops, list({{'name': name, 'start_frame': start_frame}} ORDER BY times) AS markers FROM l GROUP BY 1),
        j AS (SELECT path, root, coalesce(to_json(loops)::VARCHAR, '[]') AS loops, coalesce(to_json(markers)::VARCHAR, '[]') AS markers FROM f LEFT JOIN g ON l_orderkey = path)
        SELECT '{{"metadata":' || CASE WHEN root IS NULL AND loops = '[]' THEN 'null' ELSE '{{"midi_mapping":' || CASE WHEN root IS NULL THEN 'null' ELSE '{{"root_midi_note":' || root || ',"sampler_mapping":null}}' END
            || ',"timing_info":null,"loops":' || loops || ',"markers":' || markers || ',"regions":[]}}' END || ',"path":"' || path || '"}}' AS line FROM j""")  # fmt: skip

    def lines(spark: SparkSession, d: str) -> DataFrame:
        """An event's record as an older version wrote it, one in a line or in an array of one."""
        e = V.table(spark, d, "events")
        one = F.format_string('{"path": "e%d", "metadata": {"midi_mapping": {"nullopt": %s, "data": {"root_midi_note": %d, "sampler_mapping": {"nullopt": true}}}, "markers": [{"name": {"nullopt": %s, "data": "%s"}, "start_frame": %d}]}}',
            F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.col("user_id") % 128, F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.col("event_type"), F.col("user_id"))
        return e.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("[ "), one, F.lit("]"))).otherwise(F.concat(one, F.lit("  "))).alias("value"), F.col("event_id").alias("line"))

    mark = lambda c: F.get("metadata.markers", F.lit(0))[c].alias(c)
    add("legacy_optional_migrate", lambda spark, d: M.entries(lines(spark, d)).select("path", F.col("metadata.midi_mapping.root_midi_note").alias("root"), mark("name"), mark("start_frame")),
        "SELECT 'e' || event_id AS path, CASE WHEN event_id % 2 <> 0 THEN user_id % 128 END::INT AS root, CASE WHEN event_id % 3 <> 0 THEN event_type END AS name, user_id AS start_frame FROM events")
    stretch = lambda spark, d: orders(spark, d).select("path", F.posexplode(M.stretched_record(F.col("metadata"), F.lit(2.5))["loops"]).alias("place", "x"))
    add("record_stretch", lambda spark, d: stretch(spark, d).select("path", "place", "x.start_frame", "x.num_frames"), f"""WITH {ORDERS_SQL} SELECT path, (row_number() OVER (PARTITION BY path ORDER BY times) - 1)::INT AS place,
        trunc(start_frame * 2.5::DOUBLE)::BIGINT AS start_frame, trunc(num_frames * 2.5::DOUBLE)::BIGINT AS num_frames FROM f JOIN l ON l_orderkey = path""")  # fmt: skip
    cut = lambda spark, d: orders(spark, d).select("path", F.explode(M.cut_record(F.col("metadata"), F.lit(150), F.lit(320))["loops"]).alias("x"))
    add("record_cut", lambda spark, d: cut(spark, d).select("path", "x.start_frame", "x.num_frames"), f"WITH {ORDERS_SQL} SELECT path, start_frame - 150 AS start_frame, num_frames FROM f JOIN l ON l_orderkey = path WHERE start_frame + num_frames <= 320 AND start_frame >= 150")


def chunk_tables() -> None:
    """Lines as cues, and as the loops and regions that use them; labels twice or more for a cue, some empty."""
    line = lambda spark, d: V.lines(spark, d).withColumnRenamed("l_orderkey", "path").withColumn("cue_id", F.col("k") % 4)
    first = lambda spark, d: line(spark, d).filter("k <= 4")
    cues = lambda spark, d: first(spark, d).select("path", "cue_id", F.col("l_quantity").cast("long").alias("position"))
    labels = lambda spark, d: line(spark, d).select("path", "cue_id", F.col("k").alias("place"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat("l_returnflag", F.col("k").cast("string"))).alias("text"))
    loops = lambda spark, d: first(spark, d).select("path", "cue_id", F.col("k").alias("place"), (F.col("k") % 3).alias("type"), F.col("l_quantity").cast("long").alias("first"), (F.col("l_quantity").cast("long") + F.col("k") * 3).alias("last"), F.col("k").alias("plays"))
    regions = lambda spark, d: first(spark, d).select("path", "cue_id", F.col("k").alias("place"), F.when(F.col("k") % 2 == 0, F.col("l_linestatus")).otherwise("").alias("name"), (F.col("k") * 3).cast("long").alias("length"))
    ends = lambda spark, d: V.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 60 + 5).alias("num_frames"))
    sql = f"WITH {V.LINES_SQL}" + """, a AS (SELECT l_orderkey AS path, k, k % 4 AS cue_id, l_quantity::BIGINT AS q, CASE WHEN k % 5 = 0 THEN '' ELSE l_returnflag || k END AS text, l_linestatus AS st FROM li),
        n AS (SELECT path, cue_id, arg_min(text, k) AS early, arg_max(text, k) AS late FROM a WHERE text <> '' GROUP BY ALL), c AS (SELECT a.*, o_orderkey % 60 + 5 AS nf, early, late FROM a JOIN orders ON o_orderkey = a.path LEFT JOIN n USING (path, cue_id) WHERE k <= 4) """
    add("cue_label_join", lambda spark, d: M.named_loops(loops(spark, d), labels(spark, d), ends(spark, d)), sql + "SELECT path, k AS place, late AS name, CASE k % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS type, q AS start_frame, k * 3 + 1 AS num_frames, k AS num_times_to_loop FROM c WHERE q < nf AND q + k * 3 < nf")
    add("cue_markers", lambda spark, d: M.named_markers(cues(spark, d), labels(spark, d), ends(spark, d)), sql + "SELECT path, cue_id, early AS name, q AS start_frame FROM c WHERE q <= nf")
    add("cue_regions", lambda spark, d: M.named_regions(regions(spark, d), cues(spark, d), labels(spark, d), ends(spark, d)),
        sql + "SELECT path, k AS place, late AS initial_marker_name, CASE WHEN k % 2 = 0 THEN st END AS name, q AS start_frame, (k * 3)::BIGINT AS num_frames FROM c WHERE q < nf AND q + k * 3 <= nf")
    add("cue_ids", lambda spark, d: M.cues_of(orders(spark, d)), f"""WITH {ORDERS_SQL}, i AS (SELECT l_orderkey AS path, 0 AS kind, times, name, start_frame FROM l UNION ALL SELECT l_orderkey, 2, times, name, start_frame FROM l)
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY kind, times) - 1 AS cue_id, name, start_frame AS position FROM i WHERE path IN (SELECT o_orderkey FROM orders)""")  # fmt: skip


def files() -> None:
    def some(spark: SparkSession, d: str) -> DataFrame:
        bits = F.element_at(F.array(*[F.lit(b) for b in (8, 16, 20, 24, 32)]), (F.col("p_size") % 5 + 1).cast("int"))
        return V.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 2 == 0, "wav").otherwise("flac").alias("format"), bits.alias("bits_per_sample"), F.lit(48_000).alias("sample_rate"), (F.col("p_size") * 1000).cast("long").alias("num_frames"))

    part = "SELECT p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'wav' ELSE 'flac' END AS format, [8, 16, 20, 24, 32][p_size % 5 + 1] AS bits, p_size * 1000 AS n FROM part"
    add("convert_plan", lambda spark, d: C.conversion(some(spark, d), rate=44_100, kind="flac"), f"SELECT path, 'flac' AS format, bits AS bits_per_sample, 44100 AS sample_rate, trunc(n * (44100 / 48000::DOUBLE))::BIGINT AS num_frames, true AS edited FROM ({part})")
    add("convert_format", lambda spark, d: C.conversion(some(spark, d), kind="wav").select("path", "edited"), f"SELECT path, format <> 'wav' AS edited FROM ({part})")
    add("convert_refused", lambda spark, d: C.inconvertible(some(spark, d), kind="flac"), f"SELECT path::VARCHAR AS path, 'flac files can''t have ' || bits || ' bits' AS problem FROM ({part}) WHERE bits = 32")
    states = lambda spark, d: V.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).alias("new_path"), (F.col("o_custkey") % 2 == 0).alias("data_changed"), (F.col("o_custkey") % 5 == 0).alias("format_changed"))
    add("write_plan", lambda spark, d: C.write_plan(states(spark, d)), """SELECT path, new_path, action FROM (SELECT o_orderkey AS path, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS new_path,
        CASE WHEN o_custkey % 5 = 0 OR (o_custkey % 2 = 0 AND o_custkey % 3 = 0) THEN 'create and delete' WHEN o_custkey % 2 = 0 THEN 'overwrite' WHEN o_custkey % 3 = 0 THEN 'move' END AS action FROM orders) WHERE action IS NOT NULL""")  # fmt: skip
    old = lambda spark, d: V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = lambda spark, d: old(spark, d).filter("o_custkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_custkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")))
    add("edit_counts", lambda spark, d: C.edits(old(spark, d), new(spark, d), ["o_orderkey"], ["o_orderstatus"]), "SELECT count(*) FILTER (o_custkey % 7 <> 0 AND o_custkey % 4 = 0) AS changed, 0::BIGINT AS added, count(*) FILTER (o_custkey % 7 = 0) AS gone FROM orders")
    log = lambda spark, d: V.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.element_at(F.array(F.lit("create"), F.lit("move"), F.lit("overwrite")), (F.col("user_id") % 3 + 1).cast("int")).alias("action"), F.col("event_type").alias("path"), F.lit("old").alias("from_path"), F.lit("kept").alias("copy"))
    add("undo_plan", lambda spark, d: C.undo_plan(log(spark, d)).select("step.kind", "step.place", "action", "path", "from_path"), """SELECT (user_id % 3)::INT AS kind, -event_id AS place, ['delete', 'move', 'restore'][user_id % 3 + 1] AS action,
        CASE WHEN user_id % 3 = 1 THEN 'old' ELSE event_type END AS path, CASE user_id % 3 WHEN 1 THEN event_type WHEN 2 THEN 'kept' END AS from_path FROM events""")  # fmt: skip
    sized = lambda spark, d: G.sample_sets(V.takes(spark, d), "men-take[0-9]+-([a-z]+)", "en").join(V.table(spark, d, "documents").select(F.concat(F.lit("room"), F.col("doc_id").cast("string")).alias("room"), (F.col("n_chars") % 3).alias("num_frames")), F.split("path", "/")[0] == F.col("room"))
    add("uneven_sets", lambda spark, d: G.uneven_sets(sized(spark, d)), "SELECT 'men-take' || doc_id // 8 || '-*' AS set_key, min(n_chars % 3) AS shortest, max(n_chars % 3) AS longest FROM documents GROUP BY doc_id // 8 HAVING shortest <> longest")


for part in (names, records, chunk_tables, files):
    part()
