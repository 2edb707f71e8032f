"""Settings of the drawing operators, with overrides from the environment (SHEETWEAVE_<NAME>)."""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class Settings:
    canvas_width: int = 4096
    canvas_height: int = 2896
    tile_size: int = 1024
    tile_overlap: int = 128
    max_pages: int = 10
    detector_conf: float = 0.25
    line_conf: float = 0.30
    ocr_conf: float = 0.30
    seam_margin: int = 48
    endpoint_tol: float = 24.0
    line_dist_tol: float = 6.0
    angle_tol_deg: float = 5.0
    overlap_iou: float = 0.5
    min_visible: float = 0.3
    min_text_visible: float = 0.9
    min_segment: float = 10.0
    psi_threshold: float = 0.25
    shift_limit: float = 1.0
    drop_limit: float = 0.15
    rolling_window: int = 50
    max_upload_mb: int = 50
    pdf_dpi: int = 300
    detector_backend: str = "auto"
    line_backend: str = "auto"
    ocr_backend: str = "auto"
    merge_backend: str = "heuristic"
    prompt_version: str = "v1"
    llm_url: str = ""
    llm_model: str = ""
    llm_key: str = dataclasses.field(default="", repr=False)
    llm_timeout: float = 60.0

    @classmethod
    def from_env(cls) -> Settings:
        found = {}
        for f in dataclasses.fields(cls):
            value = os.environ.get(f"SHEETWEAVE_{f.name.upper()}")
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)
