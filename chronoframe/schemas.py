"""Schemas of the engine's entities."""

from __future__ import annotations

VIDEOS = "video_id string, video_name string, path string, fps double, total_frames bigint, duration double"
FRAMES = "video_id string, frame_number bigint, timestamp double, extracted_text string, thumb binary, pixel_pct double"
KEYFRAMES = (
    "video_id string, video_name string, frame_number bigint, timestamp double, frame_path string, scene_change_score double,"
    " change_type string, detection_reasons array<string>, extracted_text string"
)
SEGMENTS = "video_id string, start double, end double, text string"
PERSON = "struct<description:string,clothing:string,action:string,expression:string,position:string>"
TECHNICAL = "struct<has_code:boolean,programming_language:string,has_terminal:boolean,has_diagram:boolean,has_ui_elements:boolean>"
#: What a description model returns; unknown keys are ignored, wrong types become null.
RESPONSE = (
    f"main_subject string, scene_type string, extracted_text string, people array<{PERSON}>, actions array<string>,"
    f" visual_elements array<string>, key_objects array<string>, info_density string, technical_content {TECHNICAL}"
)
VECTORS = (
    "id string, embedding array<float>, document string, frame_number bigint, timestamp double, frame_path string, scene_change_score double,"
    " main_subject string, scene_type string, text_content string, audio_context string, differential_norm double, video_id string"
)
REPORTS = (
    "name string, keyframes bigint, text_based_count bigint, visual_based_count bigint, frames_with_people bigint, frames_with_text bigint,"
    " frames_with_actions bigint, video_id string"
)
NODES = "id string, video_id string, video_name string, frame_number bigint, timestamp double, scene_change_score double, ord bigint"
EDGES = (
    "source string, target string, weight double, edge_type string, same_video boolean, similarity double,"
    " temporal_distance bigint, time_gap double"
)
#: change types that the gate emits
CHANGE_TYPES = ("initial", "text_appeared", "text_disappeared", "text_changed", "visual_change")
