"""Shared SQL: the clean views of ``chronolens.sources.domain`` for DuckDB."""

from chronolens.plans.upkeep import _INSTANT


def _one(key: str, columns: str) -> str:
    """One whole row a key: the least by its columns, nulls first."""
    order = ", ".join(f"{c} NULLS FIRST" for c in columns.split())
    return f"WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


VIEWS = {
    "fr": f"""fr AS (SELECT frame_id, utc_us AS us, device_name, monitor_id, image_path, video_chunk_id, offset_index, app, win AS "window", own_app
        FROM ({_INSTANT.format(rows="SELECT frame_id, timestamp AS raw, device_name AS dev, device_name, monitor_id, image_path, video_chunk_id, offset_index, trim(focused_app_name) AS app, focused_window_name AS win, trim(app_name) AS own_app FROM frames")})
        {_one("frame_id", "utc_us device_name monitor_id image_path video_chunk_id offset_index app win own_app")})""",
    "su": f"""su AS (SELECT sub_frame_id, utc_us AS us, device_name, app, window_name, window_chunk_id, offset_index
        FROM ({_INSTANT.format(rows="SELECT sub_frame_id, timestamp AS raw, device_name AS dev, device_name, lower(trim(app_name)) AS app, window_name, window_chunk_id, offset_index FROM sub_frames")})
        {_one("sub_frame_id", "utc_us device_name app window_name window_chunk_id offset_index")})""",
    "ma": "ma AS (SELECT DISTINCT lower(trim(frame_id)) AS frame_id, lower(trim(sub_frame_id)) AS sub_frame_id FROM frame_subframe_mapping WHERE trim(frame_id) <> '' AND trim(sub_frame_id) <> '')",
    "tx": f"""tx AS (SELECT * FROM (SELECT id, frame_id, sub_frame_id, text, confidence, length(text) AS n, lower(ocr_engine) AS engine, epoch_us(created_at) AS created_us FROM ocr_text)
        {_one("id", "frame_id sub_frame_id text confidence n engine created_us")})""",
    "asg": """asg AS (SELECT sub_frame_id, epoch_us(cluster_updated_at) AS updated_us, lower(trim(activity_label)) AS label, activity_cluster_id AS cluster_id, lower(cluster_status) AS status, epoch_us(timestamp) AS us, lower(trim(app_name)) AS app, pending_group_id AS group_id, lower(trim(provisional_label)) AS provisional
        FROM activity_assignments WHERE sub_frame_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY sub_frame_id ORDER BY cluster_updated_at DESC NULLS LAST, lower(trim(activity_label)) DESC NULLS LAST, activity_cluster_id DESC NULLS LAST, lower(cluster_status) DESC NULLS LAST, timestamp DESC NULLS LAST, lower(trim(app_name)) DESC NULLS LAST, pending_group_id DESC NULLS LAST) = 1)""",
    "cl": "cl AS (SELECT id, lower(trim(app_name)) AS app, lower(trim(label)) AS label, lower(cluster_status) AS status, frame_count, centroid, representative_frame_ids FROM activity_clusters)",
    "ve": f"""ve AS (SELECT key, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vector, app
        FROM (SELECT frame_id AS key, embedding::DOUBLE[] AS v, lower(trim(app_name)) AS app FROM sub_frame_data WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) {_one("key", "v app")})""",
}


def sql(views: str, body: str) -> str:
    """``body`` after the named views (space separated) and any views of its own before ``;;``."""
    own, _, rest = body.rpartition(";;")
    parts = [VIEWS[v] for v in views.split()] + ([own.strip()] if own.strip() else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + rest.strip()
