"""Explicit schemas of the domain tables; nothing is inferred on read."""

from __future__ import annotations

STAMPS = "created_at timestamp, updated_at timestamp, deleted_at timestamp"
_BOX = "bbox_x double, bbox_y double, bbox_w double, bbox_h double"

TABLES: dict[str, str] = {
    "organizations": f"id string, name string, {STAMPS}",
    "users": f"id string, org_id string, email string, hashed_password string, is_active boolean, {STAMPS}",
    "roles": f"id string, org_id string, name string, description string, {STAMPS}",
    "permissions": f"id string, name string, description string, {STAMPS}",
    "user_roles": "user_id string, role_id string",
    "role_permissions": "role_id string, permission_id string",
    "cameras": f"id string, org_id string, name string, location string, rtsp_url binary, status string, {STAMPS}",
    "video_segments": "id string, org_id string, camera_id string, s3_key string, start_time timestamp, end_time timestamp, "
                      f"duration_ms int, fps int, resolution string, file_size_bytes bigint, processing_status string, {STAMPS}",
    "identity_gallery": f"id string, org_id string, object_type string, reid_embedding array<float>, metadata string, {STAMPS}",
    "detected_objects": "id string, org_id string, segment_id string, segment_start_time timestamp, frame_number int, "
                        f"timestamp_ms bigint, class_label string, confidence double, {_BOX}, track_id int, "
                        "dominant_colour string, colour_confidence double, vehicle_type string, vehicle_type_confidence double, "
                        "upper_colour string, upper_colour_conf double, lower_colour string, lower_colour_conf double, "
                        "carried_items array<string>, gender_estimate string, attributes_extracted boolean, "
                        f"reid_embedding array<float>, gallery_id string, {STAMPS}",
    "events": "id string, org_id string, camera_id string, event_type string, severity string, start_time timestamp, "
              f"end_time timestamp, metadata string, thumbnail_s3_key string, {STAMPS}",
    "search_queries": "id string, org_id string, user_id string, query_text string, query_embedding array<float>, "
                      f"results_count int, latency_ms double, {STAMPS}",
    "audit_log": "id string, org_id string, table_name string, action string, old_data string, new_data string, "
                 "query_text string, user_id string, ip_address string, created_at timestamp",
    "camera_assignments": f"user_id string, camera_id string, {STAMPS}",
    "api_keys": f"id string, org_id string, name string, key_hash string, scopes string, is_active boolean, expires_at timestamp, {STAMPS}",
    "camera_health_logs": "id string, org_id string, camera_id string, timestamp timestamp, uptime_status string, "
                          f"frame_drop_rate double, detection_latency_ms double, {STAMPS}",
}

COLLECTIONS: dict[str, str] = {
    "frame_embeddings": "id string, camera_id string, segment_id string, frame_number bigint, timestamp_ms bigint, "
                        "embedding array<float>, object_classes array<string>, raw_labels string",
    "object_embeddings": "id string, track_id bigint, class_label string, embedding array<float>, first_seen bigint, "
                         "last_seen bigint, camera_id string",
    "event_embeddings": "id string, event_id string, event_type string, severity string, start_time bigint, end_time bigint, "
                        "embedding array<float>, metadata string",
}

DETECTION = ("struct<track_id:bigint,class_id:int,class_label:string,confidence:double,"
             "bbox:struct<x1:double,y1:double,x2:double,y2:double>>")
FRAME_MESSAGE = f"camera_id string, frame_id bigint, timestamp_ms bigint, fps double, detections array<{DETECTION}>"
