"""Hand-made rows for search, identity, evaluation and governance."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vigilgrid.functions import query_text as Q, text as X
from vigilgrid.plans import evaluation as E, governance as D, identity as I, search as S

NOW = 1_700_000_000_000
HOUR = 3_600_000


def intent(spark, text):
    return spark.createDataFrame([(text,)], "q string").select(Q.search_intent(F.col("q")).alias("i")).first().i


def test_query_intents(spark):
    i = intent(spark, "Find red SUV in zone-a last 2 hours")
    assert (i.object_class, i.color, i.vehicle_style, i.spatial_zone, i.time_range_hours) == ("car", "red", "SUV", "zone_a", 2.0)
    i = intent(spark, "man with backpack running")
    assert (i.object_class, i.gender, i.attributes, i.action, i.is_action_query) == ("person", "man", ["backpack"], "running", True)
    assert intent(spark, "backpack").object_class == "backpack"
    assert intent(spark, "worker in hard hat").attributes == ["hard hat", "hat"]
    assert intent(spark, "track the same car").intent_type == "cross_camera_track"


def test_filter_terms_and_synonyms(spark):
    f = spark.createDataFrame([("vehicles on camera:cam_1 but not trucks in zone yard-2 last 3 hours",)], "q string").select(
        Q.filter_terms(F.col("q")).alias("f")).first().f
    assert (f.camera_ids, f.spatial_zone, f.classes, f.excluded_classes) == (["cam_1"], "yard-2", ["vehicle"], ["truck"])
    syn = spark.createDataFrame([(["car"],)], "c array<string>").select(Q.synonyms_of(F.col("c")).alias("s")).first().s
    assert syn == sorted(["vehicle", "automobile", "motorcar", "sedan", "suv"])


def test_entities_and_plain_intent(spark):
    texts = ["Find 3 people and 12 cars with a T-shirt, hard hat, neon green vest and e-scooter running near the loading dock",
             "2 trucks not red cars in zone b without hats", "police car loitering without any driver at the server room a", None, "  ",
             "how many dogs except cats", "fighting near cam 7", "count 99999999999999999999 cars"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, q string").select("i", Q.entities(F.col("q")).alias("e"), Q.plain_intent(F.col("q")).alias("p"),
                                                                                Q.entity_summary(Q.entities(F.col("q"))).alias("s")).orderBy("i").collect()
    e, p = rows[0].e, rows[0].p
    assert (e.colors, e.clothing, e.vehicle_types, e.behaviors) == (["green", "neon", "neon green"], ["hard hat", "hat", "t-shirt", "vest"], ["e-scooter"], ["running"])
    assert (e.object_classes, e.quantities, p.object_class, p.color, p.spatial_zone) == (["people"], [3, 12], "person", "green", "loading dock")
    assert p.attributes == ["hard hat", "hat", "t-shirt", "vest", "running", "e-scooter"] and p.intent_type == "object_search" and p.event_type is None
    assert (rows[1].p.negations, rows[1].p.spatial_zone, rows[1].p.color, rows[1].e.quantities) == (["red cars", "hats"], "zone b w", "red", [2])
    assert (rows[2].p.object_class, rows[2].p.event_type, rows[2].p.negations, rows[2].p.spatial_zone) == ("car", "loitering", ["any driver"], "server room a")
    for r in rows[3:5]:
        assert r.s == "No specific entities detected." and r.p.object_class is None and r.p.negations == [] and r.p.spatial_zone is None
    assert (rows[5].p.intent_type, rows[5].p.negations) == ("statistical_query", ["cats"]) and rows[6].p.camera_ids == ["cam-007"]
    assert rows[1].s == "Colors: red; Quantities: 2" and rows[7].e.quantities == [None]


def test_metric_report(spark):
    kind = "query_id long, category string, precision double, recall double, f1 double, latency_ms double, error string"
    rows = [(1, "a", 1.0, 1.0, 1.0, 10.0, None), (2, "a", 0.5, 1.0, 0.6667, 30.0, None), (3, "b", 0.0, 0.0, 0.0, 99.0, "broken")]
    got = {(r.kind, r.query_id, r.category): r for r in E.metric_report(spark.createDataFrame(rows, kind)).collect()}
    whole = got["overall", None, None]
    assert len(got) == 6 and (whole.queries, whole.errors, whole.avg_precision, whole.avg_latency_ms, whole.verdict) == (3, 1, 0.75, 20.0, "FAIL")
    assert got["category", None, "a"].avg_f1 == 0.8334 and got["category", None, "b"].avg_precision is None and got["query", 3, "b"].verdict is None
    assert E.metric_report(spark.createDataFrame(rows, kind), 0.75).where("kind = 'overall'").first().verdict == "PASS"
    assert E.metric_report(spark.createDataFrame([], kind)).collect() == []


def test_time_ranges(spark):
    at = dt.datetime(2024, 1, 10, 15, 30)
    ms = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)
    cases = {"last 2 hours": (ms(2024, 1, 10, 13, 30), ms(2024, 1, 10, 15, 30)), "between 9am and 5:30pm": (ms(2024, 1, 10, 9), ms(2024, 1, 10, 17, 30)),
             "today night": (ms(2024, 1, 10, 21), ms(2024, 1, 11, 6)), "yesterday": (ms(2024, 1, 9), ms(2024, 1, 10) - 1),
             "this week": (ms(2024, 1, 8), ms(2024, 1, 10, 15, 30)), "nothing": (None, None)}
    df = spark.createDataFrame([(k, at) for k in cases], "q string, at timestamp")
    got = {r.q: (r.r.start_ms, r.r.end_ms) for r in df.select("q", Q.time_range(F.col("q"), F.col("at")).alias("r")).collect()}
    assert got == cases


def test_rerank_order_and_range(spark):
    rows = [(i, "car", "red", 0.8, NOW - h * HOUR) for i, h in ((3, 48.0), (1, 1 / 6), (2, 12.0))]
    df = spark.createDataFrame([(a, b, c, d, int(e)) for a, b, c, d, e in rows], "id int, class_label string, dominant_colour string, score double, time_ms bigint")
    out = S.rerank(df, {"object_class": "car", "color": "red"}, NOW).orderBy(F.desc("rerank_score")).collect()
    assert [r.id for r in out] == [1, 2, 3] and all(0 <= r.rerank_score <= 1 for r in out)
    expected = 0.4 * 0.8 + 0.4 + 0.2 * np.exp(-0.693 * 12 / 24)
    assert abs(out[1].rerank_score - expected) < 1e-9


def test_text_similarity_matches_difflib(spark):
    import difflib

    q, d = "red car", "A cropped object of class car spotted on camera 7."
    got = spark.createDataFrame([(q, d)], "q string, d string").select(X.text_similarity(F.col("q"), F.col("d")).alias("s")).first().s
    want = 0.4 * difflib.SequenceMatcher(None, q, d.lower()).ratio() + 0.6 * 0.5
    assert abs(got - want) < 1e-12


def test_paths(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("g", "A", t0, 0), ("g", "A", t0, 2000), ("g", "B", t0 + dt.timedelta(minutes=1), 0), ("g", "B", t0 + dt.timedelta(minutes=1), 10_000),
            ("g", "C", t0 + dt.timedelta(minutes=9), 5), ("h", "C", t0, 0), ("h", "A", t0 + dt.timedelta(minutes=1), 0)]
    legs = I.camera_legs(spark.createDataFrame(rows, "gallery_id string, camera_id string, segment_start timestamp, timestamp_ms bigint"))
    got = {(r.gallery_id, r.camera_id): (r.sequence_index, r.dwell_time_ms) for r in legs.collect()}
    assert got[("g", "A")] == (0, 2000) and got[("g", "B")] == (1, 10_000) and got[("g", "C")] == (2, 0)
    assert [r.gallery_id for r in I.followed_path(legs, ["A", "C"]).collect()] == ["g"]
    assert I.followed_path(legs, ["A"]).count() == 0
    assert I.dwell_anomalies(legs, 10_000 / 60_000).count() == 1


def test_assignment_matches_sequential_reading(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 16))
    vecs = [base[i % 4] + 0.15 * rng.standard_normal(16) for i in range(40)]
    vecs = [v / np.linalg.norm(v) for v in vecs]
    rows = [(i, 1, "person", [float(x) for x in v]) for i, v in enumerate(vecs)]
    s = spark.createDataFrame(rows, "det_id bigint, org_id bigint, object_type string, embedding array<double>")
    g = spark.createDataFrame([(900, 1, "person", [float(x) for x in base[0]])], "gallery_id bigint, org_id bigint, object_type string, embedding array<double>")
    got = {r.det_id: r.gallery_id for r in I.assign_identities(s, g).collect()}
    want, minted = {}, []
    for i, v in enumerate(vecs):
        if v @ base[0] / np.linalg.norm(base[0]) >= 0.82:
            want[i] = 900
            continue
        best = max(minted, key=lambda j: v @ vecs[j], default=None)
        want[i] = want[best] if best is not None and v @ vecs[best] >= 0.82 else i
        minted.append(i)
    assert got == want and len(set(got.values())) == 4


def test_ranked_metrics(spark):
    returned = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("r", 1, "z")], "query_id string, rank int, doc_id string")
    truth = spark.createDataFrame([("q", "b"), ("q", "c")], "query_id string, doc_id string")
    queries = spark.createDataFrame([("q", "colour"), ("r", "colour")], "query_id string, category string")
    got = {r.query_id: (r.p_at_1, r.p_at_5, r.mrr) for r in E.ranked_metrics(returned, truth, queries).collect()}
    assert got == {"q": (0.0, 0.2, 0.5), "r": (0.0, 0.0, 0.0)}


def test_deidentify_is_idempotent(spark):
    df = spark.createDataFrame([(1, "u", "find me", dt.datetime(2024, 1, 29)), (2, "u", "find you", dt.datetime(2023, 12, 27))],
                               "id int, user_id string, query_text string, created_at timestamp_ntz")
    once = D.deidentify(df, "2024-01-31 00:00:00")
    assert {r.id: (r.query_text, r.user_id, r.redacted_now) for r in once.collect()} == {
        1: ("find me", "u", False), 2: ("[REDACTED]", D.NOBODY, True)}
    again = D.deidentify(once.drop("redacted_now"), "2024-01-31 00:00:00")
    assert again.where("redacted_now").count() == 0


def test_scrub(spark):
    cases = {"card 1234-5678-9012-3456 here": "card [CARD] here", "ssn 123-45-6789": "ssn [SSN]", "call 555-123-4567": "call [PHONE]",
             "mail a.b@c.org now": "mail [EMAIL] now", "DROP table; x": "table x"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r.q: r.s for r in df.select("q", Q.scrub(F.col("q")).alias("s")).collect()} == cases


def test_cursor_round_trip(spark):
    r = spark.createDataFrame([(10,)], "n int").select(X.next_cursor(F.col("n"), 10, F.lit("MTA=")).alias("a"), X.next_cursor(F.lit(3), 10, F.lit(None).cast("string")).alias("b"),
                                                      X.offset_of(F.lit("not base64 !")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("MjA=", None, 0)
