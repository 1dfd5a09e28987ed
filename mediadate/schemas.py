"""Declared schemas of the tables the operators exchange."""

LOCATED_FILES = """
    id long, file_path string, file_extension string, file_size long,
    creation_date timestamp_ntz, modification_date timestamp_ntz,
    status string, file_hash string
"""

ARCHIVE_FILES = """
    id long, archive_path string, source_path string, file_extension string, file_size long,
    date_taken timestamp_ntz, date_source string, filesystem_creation_date timestamp_ntz,
    date_uncertain int, date_added timestamp_ntz,
    camera_make string, camera_model string, gps_latitude double, gps_longitude double,
    aperture string, iso_speed string, focal_length_mm string,
    confidence int, date_reason string, file_hash string,
    user_corrected_date timestamp_ntz, corrected_at timestamp_ntz
"""

MANIFEST = "path string, file_size long, creation_date timestamp_ntz, modification_date timestamp_ntz"

EVIDENCE_TAGS = """
    has_exif boolean, date_time_original string, date_time_digitized string,
    gps_date_stamp string, gps_time_stamp array<double>,
    gps_lat array<double>, gps_lat_ref string, gps_lon array<double>, gps_lon_ref string,
    tiff_datetime string,
    xmp_create_date string, photoshop_date_created string, xmp_modify_date string,
    make string, model string, aperture string, iso_speed string, focal_length_mm string
"""

SIGNAL = "struct<seq:int, source:string, date:timestamp_ntz, base_confidence:int>"

OCR_ATTEMPTS = """
    file_id long, attempt_seq long, corner string, rotation int, variant string,
    raw_text string, ocr_confidence double
"""

CORRECTIONS = "seq long, file_id long, corrected_date timestamp_ntz"
