"""Scalar function groups over whole tables."""

from pyspark.sql import functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.functions import query_text as Q, text as X, vectors as V
from vigilgrid.sources.standin import AS_OF_MS


@query("F1", "searches", """SELECT query_id, lower(trim(query_text)) AS folded, contains(query_text, 'jacket') AS has_jacket, starts_with(query_text, 'show') AS is_show,
 substring(query_text, 1, 8) AS head, concat_ws('/', 'q', CAST(user_id AS VARCHAR)) AS path, lpad(CAST(user_id AS VARCHAR), 3, '0') AS padded FROM searches""")
def text_basics(t):
    q = F.col("query_text")
    return t.searches.select("query_id", F.lower(F.trim(q)).alias("folded"), q.contains("jacket").alias("has_jacket"), q.startswith("show").alias("is_show"),
                             F.substring(q, 1, 8).alias("head"), F.concat_ws("/", F.lit("q"), F.col("user_id")).alias("path"),
                             F.lpad(F.col("user_id").cast("string"), 3, "0").alias("padded"))


@query("F2", "", """SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS words, length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS squeezed FROM documents""")
def tokenised_documents(t):
    return t.raw("documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("words"),
                                     F.length(X.collapse_spaces(F.col("text"))).cast("long").alias("squeezed"))


KNOWN = str(Q.KNOWN_CLASSES)
BASE = "MAP " + str({k: v for k, v in Q.BASE_OF_PLURAL.items()})
CLASS_SQL = (f"CASE WHEN list_contains({KNOWN}, w) THEN w WHEN list_contains({KNOWN}, s) THEN s ELSE coalesce({BASE}[w], {BASE}[s]) END")
WORDS = """wd AS (SELECT query_id, w, CASE WHEN ends_with(w, 's') AND length(w) > 1 THEN w[:-2] ELSE w END AS s FROM
 (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[\\p{L}\\p{N}_]+')) AS w FROM searches))"""


@query("F3", "searches", f"SELECT query_id, w AS word, {CLASS_SQL} AS class_label FROM wd WHERE {CLASS_SQL} IS NOT NULL", WORDS)
def normalised_classes(t):
    words = t.searches.select("query_id", F.explode(X.tokens(F.col("query_text"))).alias("word"))
    return words.withColumn("class_label", Q.normal_class(F.col("word"))).where(F.col("class_label").isNotNull())


@query("F4", "", "SELECT doc_id, sha256(text) AS content_key, 'intent:' || substring(sha256(trim(lower(text))), 1, 16) AS intent_key FROM documents")
def content_keys(t):
    return t.raw("documents").select("doc_id", X.content_key(F.col("text")).alias("content_key"), X.intent_key(F.col("text")).alias("intent_key"))


@query("F4", "searches", """SELECT query_id, 'search:' || md5('q:' || lower(trim(query_text)) || '|f:{"user": ' || user_id || '}|c:' || array_to_string(list_sort(['cam_' || (user_id % 3), 'cam_1']), ',')
 || '|l:10|cur:' || CASE WHEN results_count = 0 THEN 'MTA=' ELSE '' END) AS cache_key FROM searches""")
def search_keys(t):
    cams = F.array(F.concat(F.lit("cam_"), F.col("user_id") % 3), F.lit("cam_1"))
    filters = F.concat(F.lit('{"user": '), F.col("user_id"), F.lit("}"))
    return t.searches.select("query_id", X.search_key(F.col("query_text"), filters, cams, F.lit(10),
                                                      F.when(F.col("results_count") == 0, "MTA=")).alias("cache_key"))


@query("F5", "alerts", "SELECT id, to_base64(CAST(k AS VARCHAR)::BLOB) AS cursor, k AS decoded, CAST(0 AS BIGINT) AS malformed FROM alerts")
def cursor_codec(t):
    c = X.cursor_of(F.col("k"))
    return t.alerts.select("id", c.alias("cursor"), X.offset_of(c).alias("decoded"), X.offset_of(F.concat(F.lit("?"), F.col("event_type"))).alias("malformed"))


@query("F6", "searches", """SELECT query_id, round(coalesce(len(list_intersect(q, d)) / nullif(len(q), 0), 0), 6) AS share FROM (SELECT query_id,
 list_distinct(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda x: x <> '')) AS q,
 ['a','cropped','object','of','class','car','spotted','show','the','jacket','last'] AS d FROM searches)""")
def token_shares(t):
    doc = F.lit("A cropped object of class car spotted show the jacket last")
    return t.searches.select("query_id", F.round(X.token_share(F.col("query_text"), doc), 6).alias("share"))


@query("F6")
def text_similarities(t):
    doc = F.concat(F.lit("A cropped object of class car spotted on camera "), F.col("user_id").cast("string"), F.lit("."))
    return t.searches.select("query_id", F.round(X.text_similarity(F.col("query_text"), doc), 6).alias("similarity"))


@query("F8", "detections", "SELECT det_id, segment_start + to_milliseconds(timestamp_ms) AS seen_at, epoch_us(segment_start) // 1000 + timestamp_ms AS seen_ms FROM detections")
def absolute_times(t):
    at = F.col("segment_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("timestamp_ms") / 1000).cast("decimal(18,6)"))
    return t.detections.select("det_id", at.alias("seen_at"), (F.unix_millis(F.col("segment_start").cast("timestamp")) + F.col("timestamp_ms")).alias("seen_ms"))


AGE = f"""CASE WHEN {AS_OF_MS} - start_ms < 60000 THEN 'Just now' WHEN {AS_OF_MS} - start_ms < 3600000 THEN ({AS_OF_MS} - start_ms) // 60000 || ' min ago'
 WHEN start_time::DATE = DATE '2024-01-31' THEN 'Today ' || strftime(start_time, '%-I:%M %p') WHEN start_time::DATE = DATE '2024-01-30' THEN 'Yesterday ' || strftime(start_time, '%-I:%M %p')
 ELSE strftime(start_time, '%-d %b') END"""


@query("F9", "alerts", f"SELECT id, {AGE} AS age FROM alerts")
def age_labels(t):
    return t.alerts.select("id", X.age_label(F.col("start_ms"), F.lit(AS_OF_MS)).alias("age"))


@query("F10", "alerts", """SELECT id, round(exp(-0.693 * k / 24), 8) AS decay, round(cos(radians(180 - k)), 8) AS cosine, round(1 / (1 + exp(-(k / 50))), 8) AS sigmoid,
 round(exp(k / 10 - greatest(k / 10, 5, value / 50)) / (exp(k / 10 - greatest(k / 10, 5, value / 50)) + exp(5 - greatest(k / 10, 5, value / 50)) + exp(value / 50 - greatest(k / 10, 5, value / 50))), 8) AS p0 FROM alerts""")
def numeric_functions(t):
    k = F.col("k")
    p = V.softmax(F.array(k / 10, F.lit(5.0), F.col("value") / 50))
    return t.alerts.select("id", F.round(F.exp(-0.693 * k / 24), 8).alias("decay"), F.round(F.cos(F.radians(180 - k)), 8).alias("cosine"),
                           F.round(1 / (1 + F.exp(-(k / 50))), 8).alias("sigmoid"), F.round(p[0], 8).alias("p0"))


@query("F12", "alerts", """SELECT id, json_exists(metadata, '$.k') AS has_k, json_exists(metadata, '$.z') AS has_z, json_extract_string(metadata, '$.k') AS k_text,
 '{"alert":' || id || ',"meta":{"k":' || k || '}}' AS nested FROM alerts""")
def json_functions(t):
    keys = F.json_object_keys("metadata")
    return t.alerts.select("id", F.array_contains(keys, "k").alias("has_k"), F.array_contains(keys, "z").alias("has_z"),
                           F.get_json_object("metadata", "$.k").alias("k_text"),
                           F.to_json(F.struct(F.col("id").alias("alert"), F.struct("k").alias("meta"))).alias("nested"))


COLOUR = """CASE WHEN v < 50 THEN 'black' WHEN s < 30 AND v > 200 THEN 'white' WHEN s < 40 AND v <= 200 THEN 'grey' WHEN h BETWEEN 10 AND 20 AND s > 80 AND v < 150 THEN 'brown'
 WHEN h <= 10 OR h BETWEEN 170 AND 180 THEN 'red' WHEN h < 25 THEN 'orange' WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green' WHEN h < 100 THEN 'cyan' WHEN h < 130 THEN 'blue'
 WHEN h < 145 THEN 'purple' WHEN h < 170 THEN 'pink' ELSE 'grey' END"""


@query("F13", "", f"SELECT colour, count(*) AS n FROM (SELECT {COLOUR} AS colour FROM (SELECT l_partkey % 186 AS h, l_suppkey * 37 % 256 AS s, l_orderkey % 256 AS v FROM lineitem)) GROUP BY 1")
def colour_names(t):
    li = t.raw("lineitem")
    name = X.colour_name(F.col("l_partkey") % 186, F.col("l_suppkey") * 37 % 256, F.col("l_orderkey") % 256)
    return li.groupBy(name.alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query("F14 F11 A26", "detections", """SELECT segment_id, 'Frame contains: ' || string_agg(CASE class_label WHEN 'person' THEN 'person wearing ' || gender_estimate ELSE upper_colour || ' ' || class_label END, ', ' ORDER BY det_id) AS description
 FROM detections GROUP BY 1""")
def scene_descriptions(t):
    det = F.struct("det_id", F.col("class_label").alias("label"), F.col("upper_colour").alias("color"), F.col("gender_estimate").alias("clothing"))
    frames = t.detections.groupBy("segment_id").agg(F.array_sort(F.collect_list(det)).alias("dets"))
    return frames.select("segment_id", X.scene_description(F.col("dets")).alias("description"))


@query("F15", "alerts", """SELECT id, CASE WHEN k % 3 = 0 THEN trim('An event of type ' || event_type || ' with severity ' || severity || '. ' || CASE WHEN k % 2 = 0 THEN 'seen twice' ELSE '' END)
 WHEN k % 3 = 1 THEN 'A cropped object of class ' || event_type || ' spotted on camera ' || camera_id || '.'
 WHEN k % 2 = 0 THEN 'A frame on camera ' || camera_id || ' showing: seen twice' WHEN k % 5 = 0 THEN 'A frame on camera ' || camera_id || ' containing: car, bus.'
 WHEN k % 7 = 0 THEN 'A frame on camera ' || camera_id || ' showing: ' || event_type || '.' ELSE 'A video frame recorded on camera ' || camera_id || '.' END AS document FROM alerts""")
def result_documents(t):
    k = F.col("k")
    kind = F.when(k % 3 == 0, "event").when(k % 3 == 1, "object").otherwise("frame")
    none = F.array().cast("array<string>")
    doc = X.document_text(kind, F.col("camera_id").cast("string"), F.col("event_type"), F.col("severity"), F.when(k % 2 == 0, "seen twice"),
                          F.when(k % 7 == 0, F.array("event_type")).otherwise(none), F.when(k % 5 == 0, F.array(F.lit("car"), F.lit("bus"))).otherwise(none))
    return t.alerts.select("id", doc.alias("document"))


@query("F16", "", """SELECT doc_id, round(n_chars * 4 / 1000.0::DOUBLE * i + length(source) / 1000.0::DOUBLE * o, 6) AS cost FROM (SELECT *, CASE lang WHEN 'en' THEN 0.0025 WHEN 'fr' THEN 0.00025 ELSE 0 END::DOUBLE AS i,
 CASE lang WHEN 'en' THEN 0.01 WHEN 'fr' THEN 0.00125 ELSE 0 END::DOUBLE AS o FROM documents)""")
def token_costs(t):
    model = F.when(F.col("lang") == "en", "gpt-4o").when(F.col("lang") == "fr", "claude-3-haiku-20240307").otherwise("unknown")
    return t.raw("documents").select("doc_id", X.token_cost(model, F.col("n_chars") * 4, F.length("source")).alias("cost"))
