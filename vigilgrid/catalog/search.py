"""Search: annotations of query texts, scoring and the hybrid plan."""

from pyspark.sql import functions as F

from vigilgrid.catalog.identity import CENTROIDS, centroids
from vigilgrid.catalog.registry import query
from vigilgrid.functions import query_text as Q
from vigilgrid.plans import search as S
from vigilgrid.sources.standin import AS_OF_MS

TOK = "tk AS (SELECT query_id, query_text, trim(lower(query_text)) AS q, regexp_extract_all(trim(lower(query_text)), '[\\p{L}\\p{N}_]+') AS w FROM searches)"


def _last(values):
    return f"list_filter(w, lambda x: list_contains({list(values)}, x))[-1]"


INTENT_SQL = f"""it AS (SELECT query_id, CASE WHEN {' OR '.join(f"contains(q, '{p}')" for p in Q.TRACKING_PHRASES)} THEN 'cross_camera_track' ELSE 'object_search' END AS intent_type,
 {_last(Q.COLOURS)} AS color, upper({_last(Q.VEHICLE_STYLES)}) AS vehicle_style, {_last(['man', 'woman', 'child'])} AS gender, {_last(Q.ACTIONS)} AS action,
 list_has_any(w, {sorted((set(Q.PERSON_WORDS) | {a for a in Q.PERSON_ATTRIBUTES if a.isalpha()}) - {'backpack'})}) AS ctx,
 CASE WHEN regexp_matches(q, 'zone[-_\\s]([a-b])') THEN 'zone_' || regexp_extract(q, 'zone[-_\\s]([a-b])', 1) END AS spatial_zone,
 CASE WHEN regexp_matches(q, 'last\\s+(\\d+)\\s+hours?') THEN CAST(regexp_extract(q, 'last\\s+(\\d+)\\s+hours?', 1) AS DOUBLE) WHEN contains(q, 'last hour') OR contains(q, 'past hour') THEN 1 WHEN contains(q, 'today') THEN 24 END AS time_range_hours,
 list_sort(list_distinct(list_concat(list_filter(w, lambda x: list_contains({[a for a in Q.PERSON_ATTRIBUTES if a.isalpha()]}, x)),
  CASE WHEN contains(q, 'hard hat') THEN ['hard hat'] ELSE [] END, CASE WHEN contains(q, 'hi-vis') OR contains(q, 'safety vest') THEN ['hi-vis vest'] ELSE [] END))) AS attrs, w FROM tk)"""
CLASS_MAP = "MAP " + str({**{c: c for c in Q.OBJECT_CLASSES}, **Q.CLASS_OF_WORD})


@query("V15", "searches", f"""SELECT query_id, intent_type, color, vehicle_style, gender, spatial_zone, time_range_hours, action, array_to_string(attrs, '|') AS attributes,
 CASE WHEN c = 'backpack' AND len(list_filter(attrs, lambda a: a <> 'backpack')) > 0 THEN 'person' WHEN c IS NOT NULL THEN c WHEN list_has_any(attrs, {Q.WORN_OR_CARRIED}) THEN 'person'
 WHEN vehicle_style IS NOT NULL THEN 'car' END AS object_class FROM (SELECT *, {CLASS_MAP}[list_filter(w, lambda x: {CLASS_MAP}[x] IS NOT NULL AND NOT (x = 'backpack' AND ctx))[-1]] AS c FROM it)""",
       f"{TOK}, {INTENT_SQL}")
def query_intents(t):
    i = t.searches.select("query_id", Q.search_intent(F.col("query_text")).alias("i")).select("query_id", "i.*")
    return i.select("query_id", "intent_type", "color", "vehicle_style", "gender", "spatial_zone", "time_range_hours", "action",
                    F.array_join("attributes", "|").alias("attributes"), "object_class")


def _class_of(w, s):
    from vigilgrid.catalog.scalars import BASE, KNOWN
    return f"CASE WHEN list_contains({KNOWN}, {w}) THEN {w} WHEN list_contains({KNOWN}, {s}) THEN {s} ELSE coalesce({BASE}[{w}], {BASE}[{s}]) END"


SING = "CASE WHEN ends_with({0}, 's') AND length({0}) > 1 THEN {0}[:-2] ELSE {0} END"
CLS = "list_sort(list_distinct(list_filter(list_transform({0}, lambda x: " + _class_of("lower(x)", SING.format("lower(x)")) + "), lambda c: c IS NOT NULL)))"
LAST = "(?i)\\blast\\s+\\d+\\s*(?:hours?|h|minutes?|mins?|m)\\b"
FT = f"""f1 AS (SELECT query_id, regexp_extract_all(trim(query_text), '(?i)\\b(?:cam|camera):([\\w\\-]+)', 1) AS cams, regexp_replace(trim(query_text), '(?i)\\b(?:on\\s+)?(?:cam|camera):[\\w\\-]+', '', 'g') AS x FROM searches),
 f2 AS (SELECT query_id, cams, nullif(regexp_extract(x, '(?i)\\bzone:([\\w\\-]+)', 1), '') AS z1, nullif(regexp_extract(x, '(?i)\\bin zone\\s+([\\w\\-]+)', 1), '') AS z2,
  CASE WHEN regexp_matches(x, '(?i)\\bzone:([\\w\\-]+)') THEN regexp_replace(x, '(?i)\\bzone:[\\w\\-]+', '', 'g') ELSE regexp_replace(x, '(?i)\\bin zone\\s+[\\w\\-]+', '', 'g') END AS x FROM f1),
 f3 AS (SELECT query_id, cams, coalesce(z1, z2) AS zone, {CLS.replace("{0}", "list_concat(regexp_extract_all(x, '(?i)\\b(?:but\\s+)?not\\s+(\\w+s?)', 1), regexp_extract_all(x, '(?i)\\bexcept\\s+(\\w+s?)', 1), regexp_extract_all(x, '(?i)\\bno\\s+(\\w+s?)', 1))")} AS excl,
  regexp_replace(regexp_replace(regexp_replace(x, '(?i)\\b(?:but\\s+)?not\\s+\\w+s?', '', 'g'), '(?i)\\bexcept\\s+\\w+s?', '', 'g'), '(?i)\\bno\\s+\\w+s?', '', 'g') AS x FROM f2),
 f3b AS (SELECT * EXCLUDE (x), trim(regexp_replace(CASE WHEN regexp_matches(x, '{LAST}') THEN regexp_replace(x, '{LAST}', '', 'g') WHEN regexp_matches(x, '(?i)\\btoday\\b')
  THEN regexp_replace(x, '(?i)\\btoday\\b', '', 'g') ELSE regexp_replace(x, '(?i)\\byesterday\\b', '', 'g') END, '\\s+', ' ', 'g')) AS sem FROM f3),
 f4 AS (SELECT *, list_sort(list_filter({CLS.replace("{0}", "regexp_extract_all(lower(sem), '[\\p{L}\\p{N}_]+')")}, lambda c: NOT list_contains(excl, c))) AS wanted FROM f3b)"""


@query("V15 F2 U4", "searches", "SELECT query_id, array_to_string(cams, ',') AS cameras, zone AS spatial_zone, array_to_string(wanted, ',') AS classes, array_to_string(excl, ',') AS excluded, sem AS semantic_query FROM f4", FT)
def query_filter_terms(t):
    f = t.searches.select("query_id", Q.filter_terms(F.col("query_text")).alias("f")).select("query_id", "f.*")
    return f.select("query_id", F.array_join("camera_ids", ",").alias("cameras"), "spatial_zone", F.array_join("classes", ",").alias("classes"),
                    F.array_join("excluded_classes", ",").alias("excluded"), "semantic_query")


@query("V13 U5", "searches", """SELECT f4.query_id, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS synonyms FROM f4 LEFT JOIN (SELECT query_id, s FROM (SELECT query_id, unnest(wanted) AS c FROM f4)
 JOIN syn USING (c) WHERE s <> c) x USING (query_id) GROUP BY 1""", FT + ", syn AS (SELECT c, unnest(l) AS s FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in Q.SYNONYMS.items()) + ") v(c, l))")
def query_synonyms(t):
    classes = t.searches.select("query_id", Q.filter_terms(F.col("query_text"))["classes"].alias("classes"))
    return classes.select("query_id", F.array_join(Q.synonyms_of(F.col("classes")), ",").alias("synonyms"))


def _any(words):
    return " OR ".join(f"contains(q, '{w}')" for w in words)


@query("V15", "searches", f"""SELECT query_id, CASE WHEN {_any(Q.COUNT_WORDS)} THEN 'statistical_query' WHEN {_any(Q.COMPARE_WORDS)} THEN 'comparison' WHEN {_any(Q.EVENT_WORDS)} THEN 'event_search'
 ELSE 'object_search' END AS intent_type, array_to_string(list_transform(regexp_extract_all(q, '\\bcam(?:era)?[-_\\s]?(\\d+)\\b', 1), lambda n: 'cam-' || lpad(n, greatest(3, length(n))::INT, '0')), ',') AS cameras FROM tk""", TOK)
def question_types(t):
    q = F.col("query_text")
    return t.searches.select("query_id", Q.question_type(q).alias("intent_type"), F.array_join(Q.camera_mentions(q), ",").alias("cameras"))


def _found(terms, phrases=()):
    listed = f"list_filter(w, lambda x: list_contains({list(terms)}, x))"
    more = f"list_filter({list(phrases)}, lambda p: contains(q, p))" if phrases else "[]"
    return f"list_sort(list_distinct(list_concat({listed}, {more})))"


ENT = f"""ent AS (SELECT query_id, q, {_found(Q.ENTITY_COLOURS, Q.COLOUR_PHRASES)} AS colors, {_found(Q.CLOTHING, Q.CLOTHING_PHRASES)} AS clothing,
 {_found(Q.VEHICLE_KINDS, Q.VEHICLE_PHRASES)} AS vehicles, {_found(Q.BEHAVIOURS)} AS behaviors, {_found(Q.ENTITY_CLASSES)} AS classes, regexp_extract_all(q, '{Q.QUANTITY}', 1) AS quantities
 FROM (SELECT query_id, lower(query_text) AS q, regexp_extract_all(lower(query_text), '{Q.ENTITY_WORD}') AS w FROM searches))"""


@query("V15", "searches", """SELECT query_id, array_to_string(colors, '|') AS colors, array_to_string(clothing, '|') AS clothing, array_to_string(vehicles, '|') AS vehicle_types,
 array_to_string(behaviors, '|') AS behaviors, array_to_string(classes, '|') AS object_classes, array_to_string(quantities, '|') AS quantities,
 coalesce(nullif(concat_ws('; ', 'Objects: ' || nullif(array_to_string(classes, ', '), ''), 'Colors: ' || nullif(array_to_string(colors, ', '), ''), 'Clothing: ' || nullif(array_to_string(clothing, ', '), ''),
  'Vehicle types: ' || nullif(array_to_string(vehicles, ', '), ''), 'Behaviors: ' || nullif(array_to_string(behaviors, ', '), ''), 'Quantities: ' || nullif(array_to_string(quantities, ', '), '')), ''),
  'No specific entities detected.') AS summary FROM ent""", ENT)
def query_entities(t):
    e = t.searches.select("query_id", Q.entities(F.col("query_text")).alias("e"))
    lists = ["colors", "clothing", "vehicle_types", "behaviors", "object_classes", "quantities"]
    return e.select("query_id", *[F.array_join(F.col(f"e.{c}").cast("array<string>"), "|").alias(c) for c in lists], Q.entity_summary(F.col("e")).alias("summary"))


@query("V15", "searches", f"""SELECT query_id, CASE classes[1] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.CLASS_OF_ENTITY.items())} ELSE coalesce(classes[1], CASE WHEN len(vehicles) > 0 THEN 'car' END) END AS object_class,
 colors[1] AS color, array_to_string(list_concat(list_concat(clothing, behaviors), vehicles), '|') AS attributes,
 array_to_string(list_filter(list_transform(regexp_extract_all(trim(q), '{Q.NEGATION}', 1), lambda n: trim(n)), lambda n: n <> ''), '|') AS negations, nullif(trim(regexp_extract(q, '{Q.PLACE}', 1)), '') AS spatial_zone,
 CASE WHEN NOT ({_any(Q.COUNT_WORDS + Q.COMPARE_WORDS)}) THEN CASE {' '.join(f"WHEN contains(q, '{w}') THEN '{w}'" for w in Q.EVENT_WORDS)} END END AS event_type FROM ent""", ENT)
def query_plain_intents(t):
    i = t.searches.select("query_id", Q.plain_intent(F.col("query_text")).alias("i")).select("query_id", "i.*")
    return i.select("query_id", "object_class", "color", F.array_join("attributes", "|").alias("attributes"), F.array_join("negations", "|").alias("negations"),
                    "spatial_zone", "event_type")


LASTRE = "'\\blast\\s+(\\d+)\\s*(hours?|h|minutes?|mins?|m|seconds?|secs?|s|days?|d)\\b'"
BETW = "'\\bbetween\\s+(\\d{1,2})(?::(\\d{2}))?\\s*(am|pm)\\s+and\\s+(\\d{1,2})(?::(\\d{2}))?\\s*(am|pm)\\b'"


def _clock(i):
    h, m, p = (f"regexp_extract(q, {BETW}, {j})" for j in (i, i + 1, i + 2))
    return (f"day + (CASE WHEN {p} = 'pm' AND {h} <> '12' THEN CAST(nullif({h}, '') AS BIGINT) + 12 WHEN {p} = 'am' AND {h} = '12' THEN 0 ELSE CAST(nullif({h}, '') AS BIGINT) END) * 3600000 "
            f"+ CAST(coalesce(nullif({m}, ''), '0') AS BIGINT) * 60000")


def _period(word, base, plain_end):
    p = f"regexp_extract(q, '\\b{word}\\s+(morning|afternoon|evening|night)\\b', 1)"
    start = f"CASE {p} " + " ".join(f"WHEN '{n}' THEN {base} + {a} * 3600000" for n, (a, b) in Q.HOURS_OF_PERIOD.items()) + f" ELSE {base} END"
    end = f"CASE {p} " + " ".join(f"WHEN '{n}' THEN {base} + {b + (24 if b <= a else 0)} * 3600000" for n, (a, b) in Q.HOURS_OF_PERIOD.items()) + f" ELSE {plain_end} END"
    return start, end


TODAY, YEST = _period("today", "day", "now"), _period("yesterday", "(day - 86400000)", "day - 1")
RANGES = [(f"regexp_matches(q, {LASTRE})", f"now - CAST(nullif(regexp_extract(q, {LASTRE}, 1), '') AS BIGINT) * CASE regexp_extract(q, {LASTRE}, 2)[1] WHEN 'h' THEN 3600 WHEN 'm' THEN 60 WHEN 's' THEN 1 ELSE 86400 END * 1000", "now"),
          (f"regexp_matches(q, {BETW})", _clock(1), _clock(4)), ("regexp_matches(q, '\\btoday\\b')", *TODAY), ("regexp_matches(q, '\\byesterday\\b')", *YEST),
          ("regexp_matches(q, '\\bthis\\s+week\\b')", "epoch_us(date_trunc('week', created_at)) // 1000", "now")]


@query("V16 F8", "searches", "SELECT query_id, CAST(CASE " + " ".join(f"WHEN {c} THEN {s}" for c, s, _ in RANGES) + " END AS BIGINT) AS start_ms, CAST(CASE " + " ".join(f"WHEN {c} THEN {e}" for c, _, e in RANGES)
       + " END AS BIGINT) AS end_ms FROM (SELECT query_id, created_at, trim(lower(query_text)) AS q, epoch_us(created_at) // 1000 AS now, epoch_us(date_trunc('day', created_at)) // 1000 AS day FROM searches)")
def query_time_ranges(t):
    return t.searches.select("query_id", Q.time_range(F.col("query_text"), F.col("created_at").cast("timestamp")).alias("r")).select("query_id", "r.*")


INTENT = {"object_class": "car", "color": "red", "vehicle_style": "SUV", "attributes": ["backpack"], "gender": "man"}
CARRY = "CASE WHEN {0} % 3 = 0 THEN {1}('backpack') ELSE {1}('phone', 'hat') END"
RR = f"""rr AS (SELECT det_id, segment_id, track_id, confidence, least(greatest(confidence * 1.2::DOUBLE - 0.1::DOUBLE, 0), 1) AS semantic_score,
 (CASE WHEN class_label IN ('car', 'vehicle', 'automobile') THEN 1 ELSE 0 END + CASE WHEN 'red' IN (coalesce(lower(dominant_colour), ''), lower(upper_colour), lower(lower_colour)) THEN 1 ELSE 0 END
 + CASE WHEN lower(vehicle_type) = 'suv' THEN 1 ELSE 0 END + CASE WHEN gallery_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN gender_estimate = 'man' THEN 1 ELSE 0 END) / 5.0::DOUBLE AS metadata_score,
 exp(-0.693 * abs({AS_OF_MS} - time_ms) / 3600000.0::DOUBLE / 24) AS temporal_decay FROM (SELECT *, {AS_OF_MS} - timestamp_ms * 10000 AS time_ms FROM detections))"""


def _hits(t):
    carried = F.expr(CARRY.format("gallery_id", "array"))
    return (t.detections.withColumn("score", F.col("confidence") * 1.2 - 0.1).withColumn("carried_items", carried)
            .withColumn("time_ms", F.lit(AS_OF_MS) - F.col("timestamp_ms") * 10000))


@query("V9 F10", "detections", """SELECT det_id, round(semantic_score, 6) AS semantic_score, metadata_score, round(temporal_decay, 6) AS temporal_decay,
 round(0.4 * semantic_score + 0.4 * metadata_score + 0.2 * temporal_decay, 6) AS rerank_score FROM rr""", RR)
def reranked_hits(t):
    r = S.rerank(_hits(t), INTENT, AS_OF_MS)
    return r.select("det_id", F.round("semantic_score", 6).alias("semantic_score"), "metadata_score", F.round("temporal_decay", 6).alias("temporal_decay"),
                    F.round("rerank_score", 6).alias("rerank_score"))


@query("V10 F6 F15")
def text_reranked_hits(t):
    hits = t.searches.select("query_id", "query_text", "user_id", (F.col("latency_ms") / 97).alias("score"))
    doc = F.concat(F.lit("A cropped object of class truck spotted on camera "), F.col("user_id").cast("string"), F.lit("."))
    return S.rerank_by_text(hits, F.col("query_text"), doc).select("query_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("V11", "", """SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN m > 0 THEN round(least(0.95, 0.5 + m * 0.1), 3) END AS score FROM (SELECT doc_id,
 CASE WHEN lang = 'en' THEN 0.5 WHEN contains(lower(text || ' ' || lang || ' ' || source || ' ' || source), 'en') THEN 0.2 ELSE 0 END
 + CASE WHEN contains(lower(text || ' ' || lang || ' ' || source || ' ' || source), 'tion') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(text || ' ' || lang || ' ' || source || ' ' || source), 'the') THEN 0.3 ELSE 0 END::DOUBLE AS m FROM documents)) WHERE score IS NOT NULL""".replace("0.95, 0.5 +", "0.95::DOUBLE, 0.5::DOUBLE +").replace("* 0.1)", "* 0.1::DOUBLE)"))
def keyword_scores(t):
    d = t.raw("documents")
    score = S.keyword_score("the tion of", ["en"], F.array("lang", "source"), F.col("text"), F.col("source"))
    return d.select("doc_id", score.alias("score")).where(F.col("score").isNotNull())


@query("V12 O6", "crops", """SELECT frame_id, round(greatest(coalesce(best, -1), 0) * 0.6 + greatest(fs, 0) * 0.4 + CASE WHEN present THEN 0.15 ELSE 0 END + CASE WHEN named THEN 0.2 ELSE 0 END + CASE WHEN m >= 2 THEN 0.25 ELSE 0 END, 6) AS score
 FROM (SELECT frame_id, max(s) AS best, count(*) FILTER (s > 0.22 AND kind = 'car') AS m, coalesce(bool_or(s > 0.22 AND kind = 'car' AND (col = 'red' OR clo = 'hat')), false) AS named, bool_or(kind = 'car') AS present, max(s) FILTER (crop_id % 10 = 0) AS fs
 FROM (SELECT crop_id, frame_id, list_dot_product(embedding::DOUBLE[], pv.e) AS s, CASE label % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'person' ELSE 'bus' END AS kind,
  CASE crop_id % 2 WHEN 0 THEN 'red' ELSE 'blue' END AS col, CASE crop_id % 3 WHEN 0 THEN 'hat' ELSE 'vest' END AS clo FROM crops, pv) GROUP BY 1)""",
       f"{CENTROIDS}, pv AS (SELECT list_transform(e, lambda x: x * 6::DOUBLE) AS e FROM cen WHERE label = (SELECT min(label) FROM cen))")
def frame_scores(t):
    k, c = F.col("label") % 3, F.col("crop_id")
    probe = centroids(t).orderBy("label").limit(1).select(F.transform("embedding", lambda x: x * 6.0).alias("probe"))
    crops = t.crops.withColumn("_one", F.lit(1)).join(probe.withColumn("_one", F.lit(1)), "_one")
    crops = crops.select("frame_id", "crop_id", F.when(k == 0, "car").when(k == 1, "person").otherwise("bus").alias("label"), F.when(c % 2 == 0, "red").otherwise("blue").alias("color"),
                         F.when(c % 3 == 0, "hat").otherwise("vest").alias("clothing"), "embedding", "probe")
    frames = crops.where(c % 10 == 0).select("frame_id", "embedding", "probe")
    return S.frame_scores(crops, frames, F.col("probe"), "two red cars and a hat", "car").select("frame_id", F.round("score", 6).alias("score"))


@query("V18 J20 W7 W8", "detections", """SELECT det_id, event_start_ms, event_end_ms FROM (SELECT h.det_id, row_number() OVER (PARTITION BY h.segment_id, h.t ORDER BY h.confidence DESC, h.det_id) AS r, d.* FROM
 (SELECT *, track_id % 3 AS t FROM detections WHERE confidence >= 0.6) h JOIN (SELECT segment_id, t, event_start_ms, event_end_ms FROM (SELECT segment_id, t, count(*) AS n, arg_min(cx, o) AS fx, arg_min(cy, o) AS fy, arg_max(cx, o) AS lx, arg_max(cy, o) AS ly,
 arg_min(timestamp_ms, o) AS event_start_ms, arg_max(timestamp_ms, o) AS event_end_ms FROM (SELECT *, track_id % 3 AS t, bbox_x + bbox_w / 2 AS cx, bbox_y + bbox_h / 2 AS cy, (frame_number, det_id) AS o FROM detections) GROUP BY 1, 2)
 WHERE n >= 3 AND sqrt((lx - fx)^2 + (ly - fy)^2) >= 0.05) d ON d.segment_id = h.segment_id AND d.t = h.t) WHERE r = 1""")
def moving_hits(t):
    d = t.detections.withColumn("track_id", F.col("track_id") % 3)
    hits = d.where(F.col("confidence") >= 0.6)
    return S.moving_hits(hits, d, "reversing", "car", "confidence").select("det_id", "event_start_ms", "event_end_ms")


HYBRID_RR = RR.replace("rr AS", "scored AS").replace("confidence * 1.2::DOUBLE - 0.1::DOUBLE", "coalesce(sc, 0.5)").replace(
    "FROM (SELECT *,", "FROM (SELECT d.*, sc, src, ").replace("AS time_ms FROM detections)", "AS time_ms FROM picked JOIN detections d USING (det_id))").replace("SELECT det_id,", "SELECT det_id, src,", 1)


@query("V8 U1 J1 O4", "detections segments", """SELECT det_id, s.camera_id, round(0.4 * semantic_score + 0.4 * metadata_score + 0.2 * temporal_decay, 6) AS rerank_score, src AS search_source FROM scored JOIN segments s USING (segment_id)
 ORDER BY 0.4 * semantic_score + 0.4 * metadata_score + 0.2 * temporal_decay DESC, det_id LIMIT 150 OFFSET 50""", """
 meta AS (SELECT det_id, confidence FROM detections WHERE class_label IN ('car', 'vehicle') AND lower(dominant_colour) = 'red' AND lower(vehicle_type) = 'suv' AND gallery_id % 3 = 0 AND gender_estimate = 'man'
  AND segment_start >= TIMESTAMP '1996-01-01'), strict AS (SELECT det_id FROM meta ORDER BY confidence DESC, det_id LIMIT 200),
 sem AS (SELECT det_id, confidence * 0.9::DOUBLE AS sc FROM detections WHERE class_label = 'car' AND gender_estimate = 'man' AND gallery_id % 3 = 0 ORDER BY 2 DESC, 1 LIMIT 2 * (200 - (SELECT count(*) FROM strict))),
 picked AS (SELECT det_id, NULL::DOUBLE AS sc, 'metadata' AS src FROM strict UNION ALL SELECT det_id, sc, 'semantic' FROM sem WHERE det_id NOT IN (SELECT det_id FROM strict)), """ + HYBRID_RR)
def hybrid_search(t):
    d = _hits(t).drop("score")
    sem = d.where((F.col("class_label") == "car") & (F.col("gender_estimate") == "man") & (F.col("gallery_id") % 3 == 0)).withColumn("score", F.col("confidence") * 0.9)
    out = S.hybrid_search(d, t.segments, sem, INTENT, AS_OF_MS, limit=150, start="1996-01-01 00:00:00", offset=50)
    return out.select("det_id", "camera_id", F.round("rerank_score", 6).alias("rerank_score"), "search_source")


@query("V8 V18")
def hybrid_action_search(t):
    d = _hits(t).drop("score").withColumn("track_id", F.col("track_id") % 3)
    sem = d.where(F.col("class_label") == "truck").withColumn("score", F.col("confidence") * 0.9)
    out = S.hybrid_search(d, t.segments, sem, {"object_class": "truck", "action": "reversing"}, AS_OF_MS, limit=100)
    return out.select("det_id", "camera_id", "event_start_ms", "event_end_ms", "action_status", F.round("rerank_score", 6).alias("rerank_score"))
