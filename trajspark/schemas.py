"""Explicit schemas of every entity, as DDL. Sources never infer."""

from __future__ import annotations

ACTION = "action:STRING, x:DOUBLE, y:DOUBLE, element_id:INT, mark:INT, text:STRING, app_name:STRING, direction:STRING"
RAW_ACTION = "action_type:STRING, app_name:STRING, direction:STRING, text:STRING, x:DOUBLE, y:DOUBLE"
MESSAGES = "ARRAY<STRUCT<role:STRING, content:ARRAY<STRUCT<type:STRING, text:STRING>>>>"
NODE = "id:INT, bbox:ARRAY<DOUBLE>, text:STRING, content_description:STRING, view_id_resource_name:STRING, class_name:STRING, is_clickable:BOOLEAN, is_long_clickable:BOOLEAN, is_editable:BOOLEAN, depth:INT"
RAW_NODE = "unique_id:INT, bounds:STRUCT<left:INT, top:INT, right:INT, bottom:INT>, text:STRING, content_description:STRING, view_id_resource_name:STRING, class_name:STRING, is_clickable:BOOLEAN, is_long_clickable:BOOLEAN, is_editable:BOOLEAN, is_visible_to_user:BOOLEAN, depth:INT"
ELEMENT = "id:INT, bbox:ARRAY<DOUBLE>, label:STRING"

EPISODE = f"episode_id BIGINT, goal STRING, screens ARRAY<STRUCT<path:STRING, w:INT, h:INT>>, actions ARRAY<STRUCT<{RAW_ACTION}>>, step_instructions ARRAY<STRING>"
FEATURES = "MAP<STRING, STRUCT<bytes_list:ARRAY<BINARY>, float_list:ARRAY<FLOAT>, int64_list:ARRAY<BIGINT>>>"
STEP = f"messages {MESSAGES}, episode_id BIGINT, step_index INT, total_steps INT, granularity STRING, image STRING, image_w INT, image_h INT, goal STRING, a11y ARRAY<STRUCT<{NODE}>>"
NATIVE_STEP = f"messages {MESSAGES}, episode_id BIGINT, step_index INT, total_steps INT, granularity STRING, image STRING, goal STRING, elements ARRAY<STRUCT<{ELEMENT}>>, gt_xy ARRAY<DOUBLE>"
PREDICTION = f"episode_id BIGINT, step_index INT, granularity STRING, image STRING, user_text STRING, gt STRUCT<{ACTION}>, gt_xy ARRAY<DOUBLE>, pred_raw STRING, pred STRUCT<{ACTION}, _resolved_x:DOUBLE, _resolved_y:DOUBLE>, pred_parsed STRUCT<{ACTION}>, n_elements INT, ok BOOLEAN"
METRICS = "n:BIGINT, parse_rate:DOUBLE, action_type_accuracy:DOUBLE, full_match:DOUBLE, per_type:MAP<STRING, STRUCT<n:BIGINT, correct:BIGINT, accuracy:DOUBLE>>, confusion:MAP<STRING, MAP<STRING, BIGINT>>"
EVAL_FILE = "metrics STRUCT<" + METRICS + ">, failures ARRAY<STRING>, all_predictions ARRAY<STRUCT<" + PREDICTION.replace(" BIGINT", ":BIGINT").replace(" INT", ":INT").replace(" STRING,", ":STRING,").replace(" STRUCT", ":STRUCT").replace(" ARRAY", ":ARRAY").replace(" BOOLEAN", ":BOOLEAN") + ">>"
SPLITS = "train ARRAY<BIGINT>, validation ARRAY<BIGINT>, test ARRAY<BIGINT>"
AGENT_EPISODE = "task_template STRING, is_successful DOUBLE, exception_info STRING, run_time DOUBLE, episode_length INT, episode_data STRUCT<action_output:ARRAY<STRING>, action_output_json:ARRAY<STRUCT<action_type:STRING, goal_status:STRING>>>"
