"""Input limits and options passed to the operators (bounded, validated)."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


def _check(name: str, value: float, low: float | None = None, high: float | None = None) -> None:
    if low is not None and value < low:
        raise ValueError(f"{name} must be >= {low}")
    if high is not None and value > high:
        raise ValueError(f"{name} must be <= {high}")


@dataclass(frozen=True)
class Limits:
    """Guard limits.  Defaults and ranges follow the record contract."""

    max_file_bytes: int = 15_728_640
    max_pages: int = 10
    max_image_pixels: int = 25_000_000
    max_tabular_rows: int = 10_000
    max_tabular_columns: int = 100
    max_cell_chars: int = 4_096
    max_tabular_chars: int = 200_000
    max_sheets: int = 20
    max_xlsx_zip_entries: int = 1_000
    max_xlsx_uncompressed_bytes: int = 52_428_800
    render_dpi: int = 144
    request_timeout_seconds: float = 120.0
    max_request_bytes: int = 16_777_216
    max_concurrent_requests: int = 2
    api_timeout_seconds: float = 130.0

    def __post_init__(self) -> None:
        _check("max_file_bytes", self.max_file_bytes, 1)
        _check("max_pages", self.max_pages, 1, 100)
        _check("max_image_pixels", self.max_image_pixels, 1)
        _check("max_tabular_rows", self.max_tabular_rows, 1, 1_000_000)
        _check("max_tabular_columns", self.max_tabular_columns, 1, 10_000)
        _check("max_cell_chars", self.max_cell_chars, 1)
        _check("max_tabular_chars", self.max_tabular_chars, 1)
        _check("max_sheets", self.max_sheets, 1, 1_000)
        _check("max_xlsx_zip_entries", self.max_xlsx_zip_entries, 1, 100_000)
        _check("max_xlsx_uncompressed_bytes", self.max_xlsx_uncompressed_bytes, 1)
        _check("render_dpi", self.render_dpi, 72, 300)
        _check("request_timeout_seconds", self.request_timeout_seconds, 1e-9, 600)
        _check("max_request_bytes", self.max_request_bytes, 1)
        _check("max_concurrent_requests", self.max_concurrent_requests, 1, 128)
        _check("api_timeout_seconds", self.api_timeout_seconds, 1e-9, 900)


DEFAULT_LIMITS = Limits()
TOLERANCE = Decimal("0.01")
