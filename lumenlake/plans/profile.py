"""The indexing profile: a digest of all settings that change what indexing yields."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Mapping

VERSION = 6

#: Fixed order and names of the digested fields; those that end in ``_bits`` are single-precision numbers by their bits.
FIELDS = (
    "version", "processing_workflows_hash", "photo_metadata_version", "clip_model_name", "vector_size", "visual_embedding_enabled",
    "visual_embedding_backend", "visual_embedding_model_path", "visual_embedding_preprocessor_path", "visual_embedding_vector_size",
    "visual_embedding_batch_size", "face_analysis_enabled", "face_detection_model_path", "face_embedding_model_path",
    "face_embedding_vector_size", "face_detection_min_confidence_bits", "face_cluster_threshold_bits", "face_min_cluster_images",
    "face_max_frames_per_media", "gif_sample_frames", "gif_max_decode_frames", "gif_preview_frames", "gif_default_frame_delay_ms",
    "gif_motion_weight_bits", "video_frame_stride", "video_max_frames", "pdf_render_dpi", "pdf_max_pages", "pdf_summary_pages",
    "audio_transcription_enabled", "audio_transcription_model", "audio_transcription_language", "audio_transcription_threads",
    "ocr_enabled", "ocr_command", "ocr_language", "ocr_max_frames",
)


def indexing_profile(settings: Mapping[str, object]) -> str:
    """``v6:`` and the SHA-256 of the settings as compact JSON; a constant column of a run's rows.

    Settings are named as the fields, without ``_bits``; one that is missing counts as null.
    """
    fixed = {"version": VERSION, "photo_metadata_version": "photo-metadata-v1"}

    def value(field: str):
        if field in fixed:
            return fixed[field]
        found = settings.get(field.removesuffix("_bits"))
        if found is not None and field.endswith("_bits"):
            return struct.unpack("<I", struct.pack("<f", float(found)))[0]
        return found

    encoded = json.dumps({f: value(f) for f in FIELDS}, separators=(",", ":"), ensure_ascii=False)
    return f"v{VERSION}:{hashlib.sha256(encoded.encode()).hexdigest()}"
