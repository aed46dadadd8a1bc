"""Vectors and identities."""

from pyspark.sql import functions as F

from vigilgrid.catalog.registry import query
from vigilgrid.functions import vectors as V
from vigilgrid.operators import inverted
from vigilgrid.operators.nearest import nearest
from vigilgrid.plans import evaluation as E, identity as I
from vigilgrid.session import scratch_path

THRESHOLDS = {"person": 0.18, "vehicle": 0.15}


def centroids(t):
    """Mean vector per label of all crops: the stand-in gallery and label vocabulary."""
    parts = t.crops.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select(
        F.col("label").cast("long").alias("label"), F.col("p.v").alias("embedding"))


CENTROIDS = """cen AS (SELECT label, list(v ORDER BY i) AS e FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM crops, range(1, 65) g(i) GROUP BY ALL) GROUP BY 1)"""
PAIRS = f"""{CENTROIDS}, pairs AS (SELECT c.label AS probe_id, x.crop_id AS candidate_id, list_cosine_similarity(c.e, x.embedding::DOUBLE[]) AS s FROM cen c, crops x),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY s DESC, candidate_id) AS r FROM pairs)"""


def _probes(t):
    return centroids(t).withColumnRenamed("label", "probe_id")


def _candidates(t):
    return t.crops.select(F.col("crop_id").alias("candidate_id"), "camera_id", "embedding")


#: The stated query set: crops whose id is divisible by 100, against all crops.
ASKED = """pairs AS (SELECT p.crop_id AS probe_id, x.crop_id AS candidate_id, x.camera_id, list_cosine_similarity(p.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS s FROM crops p, crops x WHERE p.crop_id % 100 = 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(s, 9) DESC, candidate_id) AS r FROM pairs)"""


def _asked(t):
    return t.crops.where(F.col("crop_id") % 100 == 0).select(F.col("crop_id").alias("probe_id"), "embedding")


@query("O2 V2 V6", "crops", "SELECT probe_id, candidate_id, round(s, 6) AS similarity, r AS rank FROM ranked WHERE r <= 10", ASKED)
def vector_top_k(t):
    top = nearest(_asked(t), _candidates(t), 10)
    return top.select("probe_id", "candidate_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("V6 P9 O2", "crops", """SELECT probe_id, candidate_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(s, 9) DESC, candidate_id) AS r2
 FROM pairs WHERE camera_id IN (1, 3)) WHERE r2 <= 5""", ASKED)
def filtered_vector_top_k(t):
    top = nearest(_asked(t), _candidates(t).where(F.col("camera_id").isin(1, 3)), 5)
    return top.select("probe_id", "candidate_id", F.round("similarity", 6).alias("similarity"))


def _index(t):
    return inverted.build(_candidates(t), scratch_path(t.spark, "inverted"))


@query("V7")
def approximate_top_k(t):
    top = inverted.search(_index(t), _asked(t), 10)
    return top.select("probe_id", "candidate_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("E4 V7", "crops", "SELECT true AS reached, count(*) AS neighbours FROM ranked WHERE r <= 10", ASKED)
def approximate_recall(t):
    """Whether the index finds nine tenths of the exact neighbours of the query set."""
    found = E.neighbour_recall(inverted.search(_index(t), _asked(t), 10), nearest(_asked(t), _candidates(t), 10))
    return found.select((F.col("recall") >= 0.9).alias("reached"), "neighbours")


@query("V1", "crops", """SELECT crop_id, round(list_dot_product(list_transform(s, lambda x: x / n), list_transform(s, lambda x: x / n)), 8) AS norm2, round(s[1] / n, 6) AS first FROM
 (SELECT crop_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 0.1::DOUBLE) AS s, sqrt(list_dot_product(s, s)) AS n FROM crops)""")
def normalised_embeddings(t):
    u = V.normalise(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3 + 0.1))
    return t.crops.select("crop_id", F.round(V.dot(u, u), 8).alias("norm2"), F.round(u[0], 6).alias("first"))


@query("V3")
def projected_embeddings(t):
    return t.crops.select("crop_id", V.project(64, 32)("embedding").alias("projected")).select("crop_id", F.size("projected").alias("dim"), F.round(V.norm(F.col("projected")), 3).alias("norm"))


@query("V4", "crops", """SELECT crop_id, CAST(label AS VARCHAR) AS label, round(s, 6) AS similarity, round(1 / total, 6) AS confidence, many AS labels FROM
 (SELECT crop_id, arg_max(label, (s, label)) AS label, max(s) AS s, sum(exp(s * 100 - top * 100)) AS total, count(*) FILTER (s > 0.25) AS many FROM
 (SELECT candidate_id AS crop_id, CAST(probe_id AS VARCHAR) AS label, s, max(s) OVER (PARTITION BY candidate_id) AS top FROM pairs) GROUP BY 1)""", PAIRS)
def zero_shot_labels(t):
    labels = centroids(t).select(F.col("label").cast("string").alias("label"), "embedding")
    out = I.zero_shot(t.crops, labels, "crop_id")
    return out.select("crop_id", "label", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"), F.size("labels").cast("long").alias("labels"))


@query("V5 F4", "", "SELECT DISTINCT sha256(text) AS content_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def texts_to_embed(t):
    d = t.raw("documents")
    stored = d.join(t.raw("labels"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("content_key"))
    return I.unembedded(d, stored, "text").select("content_key")


@query("R3 V5")
def embedded_texts(t):
    d = I.unembedded(t.raw("documents"), t.raw("documents").limit(0).select(F.lit("").alias("content_key")), "text")
    out = d.select("content_key", V.embedder(V.hashing_encoder(32))("text").alias("embedding"), F.lit("hashing-32").alias("model_version"))
    return out.select("content_key", "model_version", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


SIGHT = """sg AS (SELECT crop_id AS det_id, org_id, CASE WHEN label % 2 = 0 THEN 'person' ELSE 'vehicle' END AS object_type, embedding::DOUBLE[] AS e FROM crops),
 gal AS (SELECT label AS gallery_id, o.org_id, CASE WHEN label % 2 = 0 THEN 'person' ELSE 'vehicle' END AS object_type, e FROM cen, (SELECT DISTINCT org_id FROM crops) o),
 m AS (SELECT det_id, gallery_id, s, object_type FROM (SELECT s.det_id, g.gallery_id, s.object_type, list_cosine_similarity(s.e, g.e) AS s, row_number() OVER (PARTITION BY s.det_id ORDER BY
  list_cosine_similarity(s.e, g.e) DESC, g.gallery_id) AS r FROM sg s JOIN gal g USING (org_id, object_type)) WHERE r = 1 AND s >= CASE object_type WHEN 'person' THEN 0.18 ELSE 0.15 END)"""


def _sightings(t):
    kind = F.when(F.col("label") % 2 == 0, "person").otherwise("vehicle")
    return t.crops.select(F.col("crop_id").alias("det_id"), "org_id", kind.alias("object_type"), "camera_id", (F.col("frame_id") * 1000).alias("seen_ms"), "embedding")


def _gallery(t):
    kind = F.when(F.col("label") % 2 == 0, "person").otherwise("vehicle")
    orgs = t.crops.select("org_id").distinct()
    cen = centroids(t)
    return cen.select(F.col("label").alias("gallery_id"), kind.alias("object_type"), "embedding", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("org_id")).join(orgs, "org_id")


@query("J6 V2", "crops", "SELECT det_id, CAST(gallery_id AS BIGINT) AS gallery_id, round(s, 6) AS similarity FROM m", f"{CENTROIDS}, {SIGHT}")
def gallery_matches(t):
    return I.match_gallery(_sightings(t), _gallery(t), THRESHOLDS).withColumn("similarity", F.round("similarity", 6))


ASSIGNED = f"""{CENTROIDS}, {SIGHT}, rest AS (SELECT * FROM sg WHERE det_id NOT IN (SELECT det_id FROM m)),
 ln AS (SELECT a, b FROM (SELECT x.det_id AS a, y.det_id AS b, x.object_type, list_cosine_similarity(x.e, y.e) AS s, row_number() OVER (PARTITION BY x.det_id ORDER BY list_cosine_similarity(x.e, y.e) DESC, y.det_id) AS r
  FROM rest x JOIN rest y ON x.org_id = y.org_id AND x.object_type = y.object_type AND y.det_id < x.det_id) WHERE r = 1 AND s >= CASE object_type WHEN 'person' THEN 0.18 ELSE 0.15 END),
 roots AS (SELECT det_id AS a, det_id AS root FROM rest WHERE det_id NOT IN (SELECT a FROM ln) UNION ALL SELECT ln.a, roots.root FROM roots JOIN ln ON ln.b = roots.a),
 asg AS (SELECT det_id, gallery_id, false AS is_new FROM m UNION ALL SELECT a, root, true FROM roots)"""


@query("V19 J6 G10", "crops", "SELECT det_id, CAST(gallery_id AS BIGINT) AS gallery_id, is_new FROM asg", ASSIGNED)
def assigned_identities(t):
    return I.assign_identities(_sightings(t), _gallery(t), THRESHOLDS)


@query("V19", "crops", """SELECT CAST(gallery_id AS BIGINT) AS gallery_id, is_new, min(frame_id * 1000) AS first_seen_ms, max(frame_id * 1000) AS last_seen_ms, array_to_string(list_sort(list(DISTINCT camera_id)), ',') AS cameras,
 count(*) AS sightings FROM asg JOIN crops ON crop_id = det_id GROUP BY 1, 2""", ASSIGNED)
def profile_updates(t):
    s = _sightings(t)
    out = I.profile_updates(I.assign_identities(s, _gallery(t), THRESHOLDS), s)
    return out.select("gallery_id", "is_new", "first_seen_ms", "last_seen_ms", F.array_join("cameras_seen", ",").alias("cameras"), "sightings")


PROBE = "pv AS (SELECT e FROM cen WHERE label = (SELECT min(label) FROM cen))"


def _first_probe(t):
    return _probes(t).orderBy("probe_id").limit(1)


@query("J7 O1", "crops", f"""SELECT x.crop_id AS det_id, CAST(x.label AS BIGINT) AS gallery_id, round(g.s, 6) AS score FROM (SELECT crop_id, label, frame_id FROM crops) x JOIN
 (SELECT label, list_cosine_similarity(c.e, pv.e) AS s FROM cen c, pv WHERE list_cosine_similarity(c.e, pv.e) >= 0.05 ORDER BY 2 DESC, 1 LIMIT 3) g ON g.label = x.label
 ORDER BY x.frame_id DESC, x.crop_id LIMIT 40""", f"{CENTROIDS}, {PROBE}")
def searched_by_embedding(t):
    gallery = centroids(t).withColumnRenamed("label", "gallery_id")
    rows = t.crops.select(F.col("crop_id").alias("det_id"), F.col("track_id").alias("gallery_id"), F.col("frame_id").alias("seen_ms"), "embedding")
    return I.search_by_embedding(_first_probe(t), gallery, rows, 0.05, 3, 40).select("det_id", "gallery_id", F.round("score", 6).alias("score"))


@query("J8", "crops", """SELECT crop_id AS det_id, CAST(label AS BIGINT) AS gallery_id, round(list_cosine_similarity(embedding::DOUBLE[], pv.e), 6) AS score, 'reid_direct' AS search_source FROM crops, pv
 WHERE list_cosine_similarity(embedding::DOUBLE[], pv.e) >= 0.2 ORDER BY list_cosine_similarity(embedding::DOUBLE[], pv.e) DESC, 1 LIMIT 40""", f"{CENTROIDS}, {PROBE}")
def searched_directly(t):
    gallery = centroids(t).where(F.col("label") < 0).withColumnRenamed("label", "gallery_id")
    rows = t.crops.select(F.col("crop_id").alias("det_id"), F.col("track_id").alias("gallery_id"), F.col("frame_id").alias("seen_ms"), "embedding")
    return I.search_by_embedding(_first_probe(t), gallery, rows, 0.2, 3, 40).select("det_id", "gallery_id", F.round("score", 6).alias("score"), "search_source")


LEGS = """legs AS (SELECT gallery_id, camera_id, row_number() OVER (PARTITION BY gallery_id ORDER BY f, a, camera_id) - 1 AS sequence_index, f + a AS entry_ms, l + z AS exit_ms, greatest(0, l + z - f - a) AS dwell_time_ms
 FROM (SELECT gallery_id, s.camera_id, min(epoch_us(segment_start) // 1000) AS f, max(epoch_us(segment_start) // 1000) AS l, min(timestamp_ms) AS a, max(timestamp_ms) AS z
 FROM detections d JOIN segments s USING (segment_id) GROUP BY 1, 2))"""


def _legs(t):
    d = t.detections.join(t.segments.select("segment_id", "camera_id"), "segment_id")
    return I.camera_legs(d.select("gallery_id", "camera_id", "segment_start", "timestamp_ms"))


@query("A18 W6 J3 F8", "detections segments", "SELECT * FROM legs", LEGS)
def camera_legs(t):
    return _legs(t)


@query("A19", "detections segments", "SELECT gallery_id, camera_id, CAST(sum(dwell_time_ms) AS BIGINT) AS dwell_time_ms FROM legs GROUP BY 1, 2", LEGS)
def dwell_by_camera(t):
    return I.dwell_by_camera(_legs(t))


@query("A20", "detections segments", "SELECT *, round(dwell_time_ms / 60000.0::DOUBLE, 2) AS dwell_time_minutes FROM legs WHERE dwell_time_ms >= 3400000 * 60000.0::DOUBLE", LEGS)
def dwell_anomalies(t):
    return I.dwell_anomalies(_legs(t), 3_400_000)


@query("V17", "detections segments", """SELECT DISTINCT a.gallery_id FROM legs a JOIN legs b ON b.gallery_id = a.gallery_id AND b.sequence_index > a.sequence_index
 JOIN legs c ON c.gallery_id = a.gallery_id AND c.sequence_index > b.sequence_index WHERE a.camera_id = 3 AND b.camera_id = 7 AND c.camera_id = 1""", LEGS)
def followed_paths(t):
    return I.followed_path(_legs(t), [3, 7, 1])


@query("V14 O5 O7 W6", "detections", """SELECT det_id, gallery_id, segment_start FROM detections WHERE gallery_id = (SELECT gallery_id FROM detections WHERE class_label <> 'person' GROUP BY 1 ORDER BY max(created_at) DESC, 1 LIMIT 1)
 ORDER BY segment_start, timestamp_ms, det_id LIMIT 200""")
def newest_vehicle_path(t):
    d = t.detections
    gallery = d.where(F.col("class_label") != "person").groupBy("gallery_id").agg(F.max("created_at").alias("created_at")).withColumn("object_type", F.lit("vehicle"))
    return I.track_newest(gallery, d, "car", 200).select("det_id", "gallery_id", "segment_start")
