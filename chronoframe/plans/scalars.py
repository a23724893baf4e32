"""Queries over scalar functions, filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import responses, text, vector
from ..operators import annotate, embed, gate, retrieve, sampling, split
from ..sources import bindings as b
from ..sources.media import FORMATS, accepted, frames_between
from .registry import query

SAMPLE, GAP = 43_200.0, 64_800.0
BLANK = r"[ \t\n\r\f\x0B]+"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".mp4")).alias("name"))


@query("SELECT doc_id, substring(md5(source || '.mp4'), 1, 8) AS video_id FROM documents")
def f01_video_id(spark, d):
    return _sources(spark, d).select("doc_id", text.video_id(F.concat(F.lit("/uploads/"), "name")).alias("video_id"))


@query("SELECT vec_id, printf('%d_%06d', label, vec_id) AS id, printf('%d_%06d', label, vec_id * 1000003) AS long_id FROM embeddings")
def f02_node_id(spark, d):
    e = b.table(spark, d, "embeddings")
    return e.select("vec_id", text.node_id(F.col("label"), F.col("vec_id")).alias("id"), text.node_id(F.col("label"), F.col("vec_id") * 1000003).alias("long_id"))


@query("SELECT frame_number, printf('%02d:%02d', floor(timestamp / 60)::BIGINT, floor(timestamp % 60)::BIGINT) AS clock FROM frames", "frames")
def f03_format_timestamp(spark, d):
    return b.frames(spark, d).select("frame_number", text.minutes_seconds(F.col("timestamp")).alias("clock"))


@query("""SELECT vec_id AS b, before AS a, round(list_cosine_similarity(own, prior), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS own, lag(vec_id) OVER w AS before,
    lag(embedding::DOUBLE[]) OVER w AS prior FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE before IS NOT NULL""")
def f04_cosine_pairs(spark, d):
    """Every vector with the one before it in its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = b.table(spark, d, "embeddings").select("vec_id", "label", vector.doubles(F.col("embedding")).alias("own"))
    both = v.select(F.col("vec_id").alias("b"), F.lag("vec_id").over(w).alias("a"), "own", F.lag("own").over(w).alias("prior"))
    return both.where("a IS NOT NULL").select("b", "a", r6(vector.cosine(F.col("own"), F.col("prior"))).alias("cosine"))


@query()
def f05_text_ratio(spark, d):
    w = Window.partitionBy("video_id").orderBy("turn")
    s = b.segments(spark, d).withColumn("before", F.coalesce(F.lag("text").over(w), F.lit("")))
    return s.select("video_id", "turn", r6(text.text_ratio(F.col("text"), F.col("before"))).alias("ratio"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(lower(text), '{BLANK}', ' ', 'g')) AS folded FROM conversations")
def f06_normalize(spark, d):
    return b.table(spark, d, "conversations").select("conv_id", "turn", text.normalized(F.col("text")).alias("folded"))


@query(f"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '{BLANK}'), lambda w: w <> ''))::INT AS words FROM conversations")
def f07_word_count(spark, d):
    return b.table(spark, d, "conversations").select("conv_id", "turn", text.word_count(F.col("text")).alias("words"))


@query("SELECT source, target, round(weight, 6) AS weight, temporal_distance FROM sem WHERE same_video", "sem")
def f08_decay_weight(spark, d):
    from ..operators.graph import semantic_edges

    return semantic_edges(b.vectors(spark, d), 0.3).where("same_video").select("source", "target", r6("weight").alias("weight"), "temporal_distance")


def _query_vector(spark, d) -> list[float]:
    return list(b.table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()[0])  # one row


Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT id, round(1 - pow(list_distance(embedding, {Q0}), 2), 6) AS similarity FROM vectors", "vectors")
def f09_similarity(spark, d):
    return b.vectors(spark, d).select("id", r6(1 - retrieve.distance(F.col("embedding"), _query_vector(spark, d))).alias("similarity"))


@query(f"SELECT id, round(0.7 * (1 - pow(list_distance(embedding, {Q0}), 2)) + 0.3 * 0.5, 6) AS score FROM vectors", "vectors")
def f10_hybrid_score(spark, d):
    hits = b.vectors(spark, d).withColumn("distance", retrieve.distance(F.col("embedding"), _query_vector(spark, d)))
    none = hits.where("false").select("id", F.lit(0.0).alias("importance"))
    return retrieve.rescored(hits, none).select("id", r6("score").alias("score"))


@query("""SELECT frame_number, CASE WHEN outcome = 'json' THEN event_type END AS main_subject, CASE WHEN outcome = 'json' THEN extracted_text END AS found_text,
    (outcome = 'json') AS is_json FROM responses""", "responses")
def f11_json_extract(spark, d):
    found = responses.json_text(F.col("content"))
    own = b.responses(spark, d).withColumn("json", found)
    rec = F.from_json("json", "main_subject string, extracted_text string")
    return own.select("frame_number", rec["main_subject"].alias("main_subject"), rec["extracted_text"].alias("found_text"), F.col("json").isNotNull().alias("is_json"))


@query("""SELECT frame_number, 'Video frame at ' || printf('%.1f', round(timestamp, 1)) || 's | Scene: ' || scene_type || ' | Content: ' || main_subject
    || CASE WHEN is_fallback THEN ' | People: Person 1: Individual present in frame, visible in scene' WHEN one_person THEN ' | People: Person 1: p' || (frame_number % 7) || ', walks' ELSE '' END
    || CASE WHEN is_fallback THEN ' | Actions: present in scene' WHEN two_actions THEN ' | Actions: x, y' ELSE '' END
    || CASE WHEN is_fallback THEN ' | Objects: scene elements' ELSE '' END
    || CASE WHEN said_text <> '' THEN ' | Text: ' || said_text ELSE '' END AS prompt FROM semantic""", "semantic")
def f12_embedding_prompt(spark, d):
    own = annotate.annotated(b.responses(spark, d)).withColumn("audio_text", F.lit(""))
    return annotate.prompted(own).select("frame_number", "prompt")


@query("""SELECT frame_number, CASE WHEN is_fallback THEN 'Person 1: Individual present in frame, visible in scene' WHEN one_person THEN 'Person 1: p' || (frame_number % 7) || ', walks' ELSE '' END AS people FROM semantic""", "semantic")
def f13_people_text(spark, d):
    own = annotate.annotated(b.responses(spark, d))
    return own.select("frame_number", responses.people_text(F.col("semantic.people")).alias("people"))


def _users(spark, d) -> DataFrame:
    """Ten-bin histograms of a user's values by event type view and click, side by side."""
    f = b.frames(spark, d).where("event_type IN ('view', 'click')").withColumn("bin", F.least(F.floor(F.col("value") / 20), F.lit(9)))
    n = f.groupBy("video_id").agg(*(F.count_if((F.col("event_type") == t) & (F.col("bin") == i)).cast("double").alias(f"{t}{i}") for t in ("view", "click") for i in range(10)))
    return n.select("video_id", *(F.array(*(F.col(f"{t}{i}") for i in range(10))).alias(t) for t in ("view", "click")))


_BINS = """(SELECT video_id, b.i, sum(CASE WHEN event_type = 'view' AND bin = i THEN 1 ELSE 0 END)::DOUBLE AS x, sum(CASE WHEN event_type = 'click' AND bin = i THEN 1 ELSE 0 END)::DOUBLE AS y
    FROM (SELECT *, least(floor(value / 20), 9) AS bin FROM frames WHERE event_type IN ('view', 'click')) f CROSS JOIN range(10) b(i) GROUP BY video_id, b.i)"""


@query(f"SELECT video_id, round(coalesce(CASE WHEN isnan(corr(x, y)) THEN 1.0 ELSE corr(x, y) END, 1.0), 6) + 0.0 AS correlation FROM {_BINS} GROUP BY video_id", "frames")
def f14_hist_corr(spark, d):
    return _users(spark, d).select("video_id", (r6(vector.correlation(F.col("view"), F.col("click"))) + 0.0).alias("correlation"))


@query("SELECT event_id, round(bit_count(xor(event_id * 7919, event_id * 104729)) / 64.0, 6) AS distance FROM events")
def f16_hamming(spark, d):
    e = b.table(spark, d, "events")
    return e.select("event_id", r6(vector.hash_distance(F.col("event_id") * 7919, F.col("event_id") * 104729)).alias("distance"))


@query("""SELECT frame_number, round(s, 6) AS score, CASE WHEN s > 0.6 THEN 'major_scene_cut' WHEN s > 0.45 THEN 'scene_change' WHEN s > 0.3 THEN 'moderate_change' ELSE 'minor_change' END AS label,
    s > 0.3 AS is_change FROM (SELECT frame_number, pixel_pct * 0.8 + least(value / 200, 1.0) * 0.2 AS s FROM frames)""", "frames")
def f17_scene_label(spark, d):
    own = b.frames(spark, d).withColumn("s", vector.scene_score(F.col("pixel_pct"), F.least(F.col("value") / 200, F.lit(1.0))))
    return own.select("frame_number", r6("s").alias("score"), vector.scene_label(F.col("s")).alias("label"), (F.col("s") > 0.3).alias("is_change"))


@query("""SELECT * FROM (SELECT id, round(1 - list_cosine_similarity(embedding, lag(embedding) OVER w), 6) AS dissimilarity
    FROM vectors WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)) WHERE dissimilarity IS NOT NULL""", "vectors")
def f18_dissimilarity(spark, d):
    w = Window.partitionBy("video_id").orderBy("frame_number")
    v = b.vectors(spark, d).select("id", "embedding", F.lag("embedding").over(w).alias("before")).where("before IS NOT NULL")
    return v.select("id", r6(1 - vector.cosine(F.col("embedding"), F.col("before"))).alias("dissimilarity"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8), 6) AS first,
    round(embedding[64]::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8), 6) AS last FROM embeddings""")
def f19_unit_norm(spark, d):
    v = b.table(spark, d, "embeddings").select("vec_id", vector.unit(vector.doubles(F.col("embedding"))).alias("u"))
    return v.select("vec_id", r6(F.col("u")[0]).alias("first"), r6(F.element_at("u", -1)).alias("last"))


@query("""SELECT frame_number, CASE change_type WHEN 'initial' THEN 'Initial frame' WHEN 'text_appeared' THEN 'Text appeared' WHEN 'text_disappeared' THEN 'Text disappeared'
    WHEN 'text_changed' THEN 'Text changed (sim: 0.00)' ELSE printf('%.1f', round(pixel_pct * 100, 1)) || '% pixels changed' END AS reason FROM keyframes""", "keyframes")
def f21_reason_text(spark, d):
    k = _keyframes(spark, d)
    score = F.when(F.col("change_type") == "visual_change", F.col("pixel_pct")).otherwise(1.0)
    return k.select("frame_number", text.change_reason(F.col("change_type"), score).alias("reason"))


@query("SELECT conv_id, turn, upper(role) AS upper_role, trim(text) AS stripped, contains(lower(text), 'en') AS has_en FROM conversations")
def f22_trim_case(spark, d):
    c = b.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.upper("role").alias("upper_role"), F.trim("text").alias("stripped"), text.contains_any(F.col("text"), ("en",)).alias("has_en"))


def _keyframes(spark, d) -> DataFrame:
    return gate.text_changes(b.frames(spark, d)).where("change_type IS NOT NULL")


@query("SELECT video_id, frame_number, timestamp, pixel_pct AS scene_change_score, pixel_pct AS motion_score, change_type, extracted_text FROM keyframes", "keyframes")
def p01_record_projection(spark, d):
    k = _keyframes(spark, d).withColumn("scene_change_score", F.col("pixel_pct"))
    return annotate.records(k).select("video_id", "frame_number", "timestamp", "scene_change_score", "motion_score", "change_type", "extracted_text")


@query("SELECT frame_number, main_subject, scene_type, said_text AS text_content FROM semantic", "semantic")
def p02_metadata_flatten(spark, d):
    own = annotate.annotated(b.responses(spark, d))
    return own.select("frame_number", "semantic.main_subject", "semantic.scene_type", "semantic.text_content")


@query("SELECT id, timestamp, frame_number, video_id, coalesce(source, 'unknown') AS video_name FROM vectors", "vectors")
def p03_node_projection(spark, d):
    return b.vectors(spark, d, documents=True).select("id", "timestamp", "frame_number", "video_id", F.coalesce("source", F.lit("unknown")).alias("video_name"))


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_number) AS rn FROM frames),
    s AS (SELECT video_id, frame_number, timestamp, {SAMPLE}::DOUBLE AS due FROM f WHERE rn = 1
    UNION ALL SELECT s.video_id, arg_min(f.frame_number, f.timestamp), min(f.timestamp), min(f.timestamp) + {SAMPLE}::DOUBLE FROM s JOIN f ON f.video_id = s.video_id AND f.rn > 1 AND f.timestamp >= s.due GROUP BY s.video_id)
    SELECT video_id, frame_number, round(timestamp, 6) AS timestamp FROM s""", "frames")
def p04_time_sampler(spark, d):
    return sampling.sampled(b.frames(spark, d), SAMPLE).select("video_id", "frame_number", r6("timestamp").alias("timestamp"))


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_number) AS rn FROM frames),
    s AS (SELECT video_id, frame_number, timestamp, {SAMPLE}::DOUBLE AS due FROM f WHERE rn = 1
    UNION ALL SELECT s.video_id, arg_min(f.frame_number, f.timestamp), min(f.timestamp), min(f.timestamp) + {SAMPLE}::DOUBLE FROM s JOIN f ON f.video_id = s.video_id AND f.rn > 1 AND f.timestamp >= s.due GROUP BY s.video_id)
    SELECT video_id, frame_number, round(timestamp, 6) AS timestamp FROM s""", "frames")
def p04_split_sampler(spark, d):
    return split.sampled(b.frames(spark, d), SAMPLE).select("video_id", "frame_number", r6("timestamp").alias("timestamp"))


@query("""SELECT frame_number, CASE WHEN now <> '' AND coalesce(prior, '') <> '' THEN now <> prior ELSE now <> coalesce(prior, '') END AS differs
    FROM (SELECT frame_number, lower(extracted_text) AS now, lag(lower(extracted_text)) OVER (PARTITION BY video_id ORDER BY timestamp, frame_number) AS prior FROM frames)""", "frames")
def p05_text_differs(spark, d):
    prior = F.coalesce(F.lag(text.normalized(F.col("extracted_text"))).over(gate.in_time()), F.lit(""))
    return b.frames(spark, d).select("frame_number", (text.normalized(F.col("extracted_text")) != prior).alias("differs"))


@query("SELECT frame_number, change_type FROM changes", "changes")
def p06_change_type(spark, d):
    return gate.text_changes(b.frames(spark, d)).select("frame_number", "change_type")


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_number) AS rn FROM frames),
    s AS (SELECT video_id, frame_number, timestamp FROM f WHERE rn = 1
    UNION ALL SELECT s.video_id, arg_min(f.frame_number, f.timestamp), min(f.timestamp) FROM s JOIN f ON f.video_id = s.video_id AND f.timestamp - s.timestamp >= {GAP} GROUP BY s.video_id)
    SELECT video_id, frame_number, round(timestamp, 6) AS timestamp FROM s""", "frames")
def p08_min_gap(spark, d):
    return sampling.spaced(b.frames(spark, d), GAP).select("video_id", "frame_number", r6("timestamp").alias("timestamp"))


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_number) AS rn FROM frames),
    s AS (SELECT video_id, frame_number, timestamp FROM f WHERE rn = 1
    UNION ALL SELECT s.video_id, arg_min(f.frame_number, f.timestamp), min(f.timestamp) FROM s JOIN f ON f.video_id = s.video_id AND f.timestamp - s.timestamp >= {GAP} GROUP BY s.video_id)
    SELECT video_id, frame_number, round(timestamp, 6) AS timestamp FROM s""", "frames")
def p08_split_gap(spark, d):
    return split.spaced(b.frames(spark, d), GAP).select("video_id", "frame_number", r6("timestamp").alias("timestamp"))


@query("""SELECT frame_number, t <> '' AND (coalesce(t = lag(t, 1) OVER w, false) OR coalesce(t = lag(t, 2) OVER w, false) OR coalesce(t = lag(t, 3) OVER w, false)) AS flicker
    FROM (SELECT *, lower(extracted_text) AS t FROM frames) WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, frame_number)""", "frames")
def p09_flicker_exact(spark, d):
    return gate.flicker_exact(b.frames(spark, d)).select("frame_number", "flicker")


@query("SELECT frame_number, CASE WHEN event_type = 'purchase' THEN 'Total ' || (frame_number % 10) ELSE '' END AS recognized FROM frames", "frames")
def p10_ocr_sentinel(spark, d):
    return b.recognitions(spark, d).select("frame_number", text.recognized(F.col("content")).alias("recognized"))


@query("SELECT frame_number, event_type = 'error' AS refused FROM frames", "frames")
def p11_refusal(spark, d):
    return b.recognitions(spark, d).select("frame_number", text.refused(F.col("content")).alias("refused"))


@query("""SELECT frame_number, extracted_text AS text, CASE WHEN extracted_text = '' THEN 0 ELSE 1 END AS words, CASE WHEN extracted_text = '' THEN 0.0 ELSE 95.0 END::DOUBLE AS confidence FROM frames""", "frames")
def p12_no_text(spark, d):
    said = F.when((F.col("extracted_text") == "") & (F.col("frame_number") % 2 == 0), "NO_TEXT").otherwise(F.col("extracted_text"))
    own = b.frames(spark, d).withColumn("r", responses.ocr_record(said))
    return own.select("frame_number", F.col("r.text").alias("text"), F.col("r.word_count").alias("words"), F.col("r.confidence").alias("confidence"))


@query("SELECT frame_number, CASE WHEN frame_number % 3 = 0 THEN 0 WHEN frame_number % 3 = 1 THEN 2 ELSE 0 END::INT AS people_count, CASE WHEN frame_number % 3 = 1 THEN true ELSE false END AS has_people FROM frames", "frames")
def p13_list_guard(spark, d):
    k = F.col("frame_number") % 3
    content = F.when(k == 0, '{"main_subject": "a", "people": "x"}').when(k == 1, '{"people": [{"description": "d"}, {"action": "e"}]}').otherwise("{}")
    own = annotate.annotated(b.frames(spark, d).withColumn("content", content))
    return own.select("frame_number", "semantic.people_count", "semantic.has_people")


@query("""SELECT frame_number, CASE WHEN frame_number % 2 = 0 THEN 's' ELSE 'Video content' END AS main_subject, CASE WHEN frame_number % 2 = 0 THEN 'other' ELSE 'vlog' END AS scene_type, 'medium' AS info_density, 0::INT AS objects, false AS has_code FROM frames""", "frames")
def p14_defaults(spark, d):
    content = F.when(F.col("frame_number") % 2 == 0, '{"main_subject": "s"}').otherwise('{"scene_type": "vlog"}')
    s = annotate.annotated(b.frames(spark, d).withColumn("content", content))
    return s.select("frame_number", "semantic.main_subject", "semantic.scene_type", "semantic.info_density", F.size("semantic.key_objects").alias("objects"), F.col("semantic.technical_content.has_code").alias("has_code"))


@query("""SELECT frame_number, people_count > 0 AS has_people, people_count::INT AS people_count, has_actions, CASE WHEN said_text = '' THEN 0 ELSE 1 END::INT AS ocr_word_count,
    CASE WHEN said_text = '' THEN 0.0 ELSE 95.0 END::DOUBLE AS ocr_confidence FROM semantic""", "semantic")
def p15_flags(spark, d):
    return annotate.annotated(b.responses(spark, d)).select("frame_number", "semantic.has_people", "semantic.people_count", "semantic.has_actions", "semantic.ocr_word_count", "semantic.ocr_confidence")


@query("SELECT source, target, round(similarity, 6) AS similarity FROM pairs", "pairs")
def p16_threshold(spark, d):
    from ..operators.graph import similar_pairs

    return similar_pairs(b.vectors(spark, d), 0.3).select("source", "target", r6("similarity").alias("similarity"))


@query("""SELECT frame_number, greatest(0.0, timestamp - 2.5) AS chunk_start, timestamp + 2.5 AS chunk_end, timestamp + 2.5 - greatest(0.0, timestamp - 2.5) AS chunk_duration FROM nodes""", "nodes")
def p19_chunk_bounds(spark, d):
    return retrieve.with_chunk(b.nodes(spark, d)).select("frame_number", "chunk_start", "chunk_end", "chunk_duration")


@query("SELECT frame_number, is_fallback, main_subject, people_count::INT AS people_count FROM semantic", "semantic")
def p22_fallback(spark, d):
    return annotate.annotated(b.responses(spark, d)).select("frame_number", "semantic.is_fallback", "semantic.main_subject", "semantic.people_count")


@query("SELECT name, min(doc_id) AS doc_id FROM (SELECT doc_id, source || '.mp4' AS name FROM documents) WHERE name = 'src3.mp4' GROUP BY name")
def p23_pick_video(spark, d):
    return _sources(spark, d).where("name = 'src3.mp4'").groupBy("name").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, name, lower(split_part(name, '.', 2)) IN ('mp4', 'avi', 'mov', 'mkv', 'webm') AS accepted FROM (SELECT doc_id, source || '.' || CASE doc_id % 4 WHEN 0 THEN 'MP4' WHEN 1 THEN 'webm' WHEN 2 THEN 'txt' ELSE 'mkv' END AS name FROM documents)")
def s02_formats(spark, d):
    assert len(FORMATS) == 5
    k = F.col("doc_id") % 4
    name = F.concat("source", F.when(k == 0, ".MP4").when(k == 1, ".webm").when(k == 2, ".txt").otherwise(".mkv"))
    return b.table(spark, d, "documents").select("doc_id", name.alias("name")).withColumn("accepted", accepted("name"))


@query("SELECT video_id, frame_number, round(timestamp, 6) AS timestamp FROM frames WHERE timestamp >= 86400 AND timestamp < 172800", "frames")
def s05_chunk_frames(spark, d):
    return frames_between(b.frames(spark, d), 86_400, 172_800).select("video_id", "frame_number", r6("timestamp").alias("timestamp"))


@query("SELECT frame_number, printf('%d_frame_%06d.jpg', video_id, floor(timestamp * 1000)::BIGINT) AS file FROM nodes", "nodes")
def s13_frame_names(spark, d):
    return b.nodes(spark, d).select("frame_number", text.frame_file(F.col("video_id"), F.col("timestamp")).alias("file"))


@query("SELECT frame_number, printf('%d_chunk_%d_%d.mp4', video_id, floor(greatest(0.0, timestamp - 2.5))::BIGINT, floor(timestamp + 2.5)::BIGINT) AS file FROM nodes", "nodes")
def s14_chunk_names(spark, d):
    return retrieve.with_chunk(b.nodes(spark, d)).select("frame_number", text.chunk_file(F.col("video_id"), F.col("chunk_start"), F.col("chunk_end")).alias("file"))


_REVERSE = "SELECT substring(md5(name), 1, 8) AS video_id, min('/uploads/' || name) AS path FROM (SELECT DISTINCT source || '.mp4' AS name FROM documents) GROUP BY 1"


@query(_REVERSE)
def s15_reverse_lookup(spark, d):
    files = _sources(spark, d).select(F.concat(F.lit("/uploads/"), "name").alias("path")).distinct()
    return files.groupBy(text.video_id(F.col("path")).alias("video_id")).agg(F.min("path").alias("path"))


@query(_REVERSE.replace("min('/uploads/' || name) AS path", "count(*) AS files"))
def j11_path_lookup(spark, d):
    files = _sources(spark, d).select(F.concat(F.lit("/uploads/"), "name").alias("path")).distinct().withColumn("video_id", text.video_id(F.col("path")))
    ids = files.select("video_id").distinct()
    return ids.join(files, "video_id").groupBy("video_id").agg(F.count("*").alias("files"))


@query("SELECT vec_id, substring(document, 1, 400) AS prompt_text, CASE WHEN length(document) > 100 THEN substring(document, 1, 100) || '...' ELSE document END AS preview FROM (SELECT frame_number AS vec_id, document FROM vectors)", "vectors")
def t06_truncate(spark, d):
    v = b.vectors(spark, d, documents=True)
    return v.select(F.col("frame_number").alias("vec_id"), text.truncated(F.col("document"), 400).alias("prompt_text"), text.preview(F.col("document"), 100).alias("preview"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot FROM embeddings""")
def a16_vector_norm(spark, d):
    v = b.table(spark, d, "embeddings").select("vec_id", vector.doubles(F.col("embedding")).alias("v"))
    return v.select("vec_id", r6(vector.norm(F.col("v"))).alias("norm"), r6(vector.dot(F.col("v"), F.col("v"))).alias("dot"))


_DIFF = """SELECT id, CASE WHEN lag(embedding) OVER w IS NULL THEN 0.0 ELSE list_distance(embedding, lag(embedding) OVER w) END AS dn,
    CASE WHEN lag(embedding) OVER w IS NULL THEN 0.0 ELSE embedding[1] - (lag(embedding) OVER w)[1] END AS d1 FROM vectors WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)"""


@query(f"SELECT id, round(dn, 6) AS differential_norm, round(d1, 6) AS first FROM ({_DIFF})", "vectors")
def w01_diff_embedding_norm(spark, d):
    v = embed.differential(b.vectors(spark, d).select("id", "video_id", "frame_number", "embedding"))
    return v.select("id", r6("differential_norm").alias("differential_norm"), r6(F.col("differential")[0]).alias("first"))


@query(f"SELECT round(sum(dn), 4) AS total_norm, count(*) AS n FROM ({_DIFF})", "vectors")
def w02_diff_norm(spark, d):
    v = embed.differential(b.vectors(spark, d).select("id", "video_id", "frame_number", "embedding"))
    return v.agg(F.round(F.sum("differential_norm"), 4).alias("total_norm"), F.count("*").alias("n"))


@query("SELECT id, lead(timestamp) OVER (PARTITION BY video_id ORDER BY frame_number) - timestamp AS time_gap FROM nodes", "nodes")
def w03_time_gap(spark, d):
    w = Window.partitionBy("video_id").orderBy("frame_number")
    return b.nodes(spark, d).select("id", (F.lead("timestamp").over(w) - F.col("timestamp")).alias("time_gap"))


@query("""SELECT frame_number, coalesce(array_to_string(list(extracted_text) OVER (PARTITION BY video_id ORDER BY timestamp, frame_number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS recent FROM frames""", "frames")
def w04_last3(spark, d):
    w = gate.in_time().rowsBetween(-3, -1)
    return b.frames(spark, d).select("frame_number", F.array_join(F.collect_list("extracted_text").over(w), "|").alias("recent"))


@query("""SELECT frame_number, video_id, row_number() OVER w AS rank, ((row_number() OVER w - 1) % 4)::INT AS gallery_column FROM nodes WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)""", "nodes")
def w06_ranks(spark, d):
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number"))
    return b.nodes(spark, d).select("frame_number", "video_id", rank.cast("bigint").alias("rank"), F.pmod(rank - 1, F.lit(4)).alias("gallery_column"))


@query("SELECT video_id, arg_min(coalesce(source, 'unknown'), frame_number) AS video_name, min(frame_number) AS first_frame FROM vectors GROUP BY video_id", "vectors")
def w07_first_in_video(spark, d):
    v = b.vectors(spark, d, documents=True)
    return v.groupBy("video_id").agg(F.min_by(F.coalesce("source", F.lit("unknown")), "frame_number").alias("video_name"), F.min("frame_number").alias("first_frame"))
