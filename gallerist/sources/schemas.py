"""Explicit schemas of the files read and written."""

ENTRY = "image string, label string, condition string, session_id string, subject_id string"
MANIFEST = f"split string, gallery array<struct<image:string, label:string, session_id:string, subject_id:string>>, probes array<struct<image:string, label:string, condition:string, session_id:string, subject_id:string>>"
PAIRS = "split string, pairs array<struct<left_image:string, right_image:string, left_subject_id:string, right_subject_id:string, left_session_id:string, right_session_id:string, genuine:boolean>>"
FACE = "struct<track_id:int, box:array<int>, state:string, name:string, person_id:string, distance:double, quality:struct<accepted:boolean, focus_score:double>, single_frame:struct<state:string, name:string, distance:double>>"
VIDEO = f"type string, schema string, video string, fps double, every int, threshold double, margin double, engine string, frame int, timestamp double, processing_ms double, faces array<{FACE}>, decoded_frames bigint, analyzed_frames bigint"
TRUTH = "split string, session_id string, frames array<struct<frame:int, faces:array<struct<subject:string, label:string, box:array<double>>>>>"
GALLERY = "schema_version int, feature_signature string, people array<struct<id:string, name:string, created_at:string, samples:array<struct<id:string, created_at:string, feature:array<double>, quality:string>>>>"
CAPTURE = "subject_id string, role string, split string, condition string, session_id string, image string, consent_confirmed string, captured_at_utc string"
EVENT = "timestamp string, event string, fields map<string,string>"
