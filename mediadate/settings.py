"""Fixed values and default parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Starting confidence of each date source.
BASE_CONFIDENCE = {
    "exif_gps": 98,
    "exif_original": 95,
    "exif_digitized": 85,
    "tiff_datetime": 90,
    "xmp_create_date": 80,
    "ocr_corner_stamp": 60,
    "filesystem_fallback": 30,
    "xmp_modify_date": 20,
}

# How each date source is named in an explanation.
SOURCE_LABELS = {
    "exif_gps": "EXIF GPS timestamp",
    "exif_original": "EXIF (DateTimeOriginal)",
    "exif_digitized": "EXIF (DateTimeDigitized)",
    "tiff_datetime": "TIFF DateTime tag",
    "xmp_create_date": "XMP creation date",
    "ocr_corner_stamp": "OCR corner date stamp",
    "xmp_modify_date": "XMP modify date",
    "filesystem_fallback": "filesystem creation date",
}

# Confidence arithmetic.
AGREEMENT_BONUS = 5
MISMATCH_PENALTY = 25
IMPLAUSIBLE_CAP = 5
UNCERTAIN_BELOW = 50
EARLIEST_PLAUSIBLE = "1972-07-26 00:00:00"

# Explanation texts.
REASON_NO_EVIDENCE = "No date evidence available (no EXIF, no filesystem date)"
REASON_CONFIRMED = " -- confirmed by "
REASON_DISAGREES = " -- disagrees with "
REASON_IMPLAUSIBLE = " -- date is implausible (before cameras existed, or in the future)"

# Which date signals a file type can carry.
JPEG_TYPES = (".jpg", ".jpeg", ".thm")
TIFF_TYPES = (".tif", ".tiff")

# Acceptance of a printed date stamp.
STAMP_MIN_CONFIDENCE = 40.0
STAMP_MIN_CONFIDENCE_BARE = 65.0
STAMP_EARLIEST_YEAR = 1900

# The file inside an archive root that is not an archived file.
CATALOG_FILE_NAME = "archive_database.db"

REVIEW_FOLDER = "_review_needed"

# Confidence from which an archived date may date another copy of the same bytes.
TRUSTED_CONFIDENCE = 90

# Base confidence of the sources that a caller may add to the standard eight.
EXTRA_CONFIDENCE = {
    "hash_twin": 97,
    "takeout_json": 96,
    "sidecar_xmp": 88,
    "sidecar_thm": 90,
    "filename_pattern": 75,
    "folder_pattern": 40,
    "sequence_neighbor": 45,
}
EXTRA_LABELS = {
    "hash_twin": "identical file already dated",
    "takeout_json": "Takeout sidecar",
    "sidecar_xmp": "XMP sidecar",
    "sidecar_thm": "THM sidecar",
    "filename_pattern": "date in file name",
    "folder_pattern": "date in folder name",
    "sequence_neighbor": "numbered neighbor",
}


def dotted(extensions) -> list[str]:
    """Extension names in the form the tables hold them: lower case, leading dot."""
    return [e.lower() if e.startswith(".") else "." + e.lower() for e in extensions]


@dataclass(frozen=True)
class ImportFilters:
    """Rules a file must pass before it is imported; 0 or None switches a size rule off."""

    min_file_size: int = 0
    max_file_size: int | None = None
    exclude_path_contains: tuple[str, ...] = ()
    exclude_thumbnails: bool = True
    thumbnail_extensions: tuple[str, ...] = ("thm",)
    require_exif: bool = False


@dataclass(frozen=True)
class ImportSettings:
    """Everything an import run can be told."""

    extensions: tuple[str, ...]
    archive_root: str
    filters: ImportFilters = ImportFilters()
    threshold_days: int = 1
    review_folder: str = REVIEW_FOLDER
    try_ocr: bool = False

# Fields of the reports.
ARCHIVE_ROOT_FIELD = "archive_root"
MISPLACED_COLUMNS = ("expected_folder", "actual_folder")
