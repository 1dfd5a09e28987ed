"""The registered queries once more, as DuckDB SQL over the same tables."""

from __future__ import annotations

from mediadate import settings
from mediadate.operators.review import FILE_GONE, NOT_ELIGIBLE, NOT_UNCERTAIN, UNKNOWN_ID
from mediadate.plans import standins
from mediadate.plans.queries import FILTERS

AS_OF = f"timestamp '{standins.AS_OF}'"
ADDED_AT = f"timestamp '{standins.ADDED_AT}'"


def over(*views: str) -> str:
    """WITH clause of stand-in views."""
    return "with " + ",\n".join(f"{v} as ({standins.oracle_view(v)})" for v in views)


def _map(values: dict) -> str:
    def text(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "case source " + " ".join(f"when '{k}' then {text(v)}" for k, v in values.items()) + " end"


BASE = _map(settings.BASE_CONFIDENCE)
SUFFIX = r"regexp_extract({0}, '^.+(\.[^.]+)$', 1)"
NAME = "regexp_extract({0}, '([^/]*)$', 1)"


def suffix(path):
    return SUFFIX.format(NAME.format(path))


KIND = f"coalesce(nullif(file_type, ''), lower({suffix('path')}))"
JPEG = f"{KIND} in ('.jpg', '.jpeg', '.thm')"
TIFF = f"{KIND} in ('.tif', '.tiff')"

PARSED = f"""parsed as (select *, {JPEG} as jpeg, {TIFF} as tiff,
    try_strptime(date_time_original, '%Y:%m:%d %H:%M:%S') as original,
    try_strptime(date_time_digitized, '%Y:%m:%d %H:%M:%S') as digitized,
    try_strptime(gps_date_stamp, '%Y:%m:%d') + coalesce(
        to_hours(cast(trunc(gps_hour) as bigint)) + to_minutes(cast(trunc(gps_minute) as bigint)) + to_seconds(trunc(gps_second)),
        interval 0 second) as gps,
    coalesce(try_cast(substr(xmp_create_date, 1, 19) as timestamp), try_cast(photoshop_date_created as timestamp)) as created,
    try_cast(substr(xmp_modify_date, 1, 19) as timestamp) as modified,
    try_strptime(tiff_datetime, '%Y:%m:%d %H:%M:%S') as tiff_date from photos)"""

SIGNALS = f"""signals as (select file_id, seq, source, date, {BASE} as base_confidence from (
    select file_id, 1 as seq, 'exif_gps' as source, gps as date from parsed where jpeg
    union all select file_id, 2, case when original is null then 'exif_digitized' else 'exif_original' end, coalesce(original, digitized) from parsed where jpeg
    union all select file_id, 3, case when created is null then 'xmp_modify_date' else 'xmp_create_date' end, coalesce(created, modified) from parsed where jpeg
    union all select file_id, 4, 'tiff_datetime', tiff_date from parsed where tiff
    union all select file_id, 6, 'filesystem_fallback', creation_date from parsed) where date is not null)"""


def scored(signals="signals", files="photos", days=1, labels=None, extra=""):
    """Conclusion per file from a long signal relation."""
    label = f"coalesce({_map(labels or settings.SOURCE_LABELS)}, source)"
    return f"""ranked as (select *, {label} as label, row_number() over (partition by file_id order by base_confidence desc, seq) as rn from {signals}),
    prim as (select * from ranked where rn = 1),
    others as (select r.*, abs(floor((epoch_us(r.date) - epoch_us(p.date)) / 86400000000.0)) <= {days} as agrees
        from ranked r join prim p using (file_id) where r.rn > 1),
    sums as (select file_id, count(*) filter (agrees) as a, count(*) filter (not agrees) as d,
        string_agg(label, ', ' order by seq) filter (agrees) as al, string_agg(label, ', ' order by seq) filter (not agrees) as dl from others group by 1),
    fs as (select file_id, date from {signals} where source = 'filesystem_fallback'),
    scored as (select f.file_id{extra}, p.date as date_taken, p.source as date_source, fs.date as filesystem_creation_date,
        cast(case when p.file_id is null then 0 else least(case when p.date < timestamp '1972-07-26' or p.date > {AS_OF} then 5 else 100 end,
            greatest(0, least(100, p.base_confidence + 5 * coalesce(a, 0) - 25 * coalesce(d, 0)))) end as integer) as confidence,
        case when p.file_id is null then '{settings.REASON_NO_EVIDENCE}' else p.label || coalesce(' -- confirmed by ' || al, '') || coalesce(' -- disagrees with ' || dl, '')
            || case when p.date < timestamp '1972-07-26' or p.date > {AS_OF} then '{settings.REASON_IMPLAUSIBLE}' else '' end end as date_reason
        from {files} f left join prim p using (file_id) left join sums using (file_id) left join fs using (file_id))"""


UNCERTAIN = "cast(confidence < 50 as integer) as date_uncertain"
CONCLUSION = f"date_taken, date_source, filesystem_creation_date, confidence, date_reason, {UNCERTAIN}"
SCORED = f"{over('photos')}, {PARSED}, {SIGNALS}, {scored()}"


def size_text(n):
    units = ["B", "KB", "MB", "GB", "TB"]
    cases = " ".join(
        f"when {n} < {1024.0 ** (i + 1)} then printf('%.1f', {n} / {1024.0**i}) || '{u}'" for i, u in enumerate(units)
    )
    return f"case {cases} else printf('%.1f', {n} / {1024.0**5}) || 'PB' end"


REASON = f"""case when file_size < {FILTERS.min_file_size} then 'below min size (' || {size_text('file_size')} || ' < 2.0KB)'
    when file_size > {FILTERS.max_file_size} then 'above max size (' || {size_text('file_size')} || ' > 175.8KB)'
    when contains(path, '/u13/') then 'path contains excluded term ''/u13/'''
    when contains(path, '/IMG_42') then 'path contains excluded term ''/IMG_42'''
    when lower({suffix('path')}) = '.thm' then 'thumbnail file (.thm)'
    when not coalesce(has_exif, false) then 'no EXIF data found' end"""

ELIGIBLE = f"status <> 'imported' and lower({suffix('path')}) in ('.jpg', '.jpeg', '.tif', '.mp4')"
OUTCOMES = f"""{SCORED}, flagged as (select *, {REASON} as why, event_type <> 'click' or k >= 10 as there from photos where {ELIGIBLE}),
    outcomes as (select f.file_id as id, path as source_path, lower({suffix('path')}) as file_extension, file_size, k, user_id, event_type, gps_minute, gps_second, value, case when not there then 'missing' when why is not null then 'excluded' else 'planned' end as outcome,
        case when there then why end as exclude_reason, s.date_taken, s.date_source, s.filesystem_creation_date, s.confidence, s.date_reason, cast(s.confidence < 50 as integer) as date_uncertain,
        '/archive/' || case when s.confidence < 50 then '_review_needed' else strftime(s.date_taken, '%Y/%m/%d') end as folder, {NAME.format('path')} as name
        from flagged f join scored s using (file_id))"""
PLANNED_ONLY = ", ".join(
    f"case when outcome = 'planned' then {c} end as {c}"
    for c in ("folder", "name", "date_taken", "date_source", "filesystem_creation_date", "confidence", "date_reason", "date_uncertain")
)
LATITUDE = "(cast(k as double) + gps_minute / 60.0 + gps_second / 3600.0)"
PLACED = """placed as (select *, row_number() over (partition by folder, name order by id) - 1 as place from outcomes where outcome = 'planned'),
    named as (select *, case when place = 0 then name else regexp_extract(name, '^(.+)\\.[^.]+$', 1) || ' (' || place || ')' || regexp_extract(name, '^.+(\\.[^.]+)$', 1) end as dest_name from placed)"""

LISTING = "listing as (select * from archived where on_disk)"
CATALOG = "catalog as (select id, path as archive_path, file_size, date_taken, user_corrected_date, date_uncertain, confidence, date_added, cast(null as timestamp) as corrected_at from archived where in_catalog)"
ARCHIVE = f"{over('archived')}, {LISTING}, {CATALOG}"
ACTUAL = r"case when regexp_matches({0}, '^/archive/[^/]+/[^/]+/[^/]+/') then regexp_extract({0}, '^/archive/([^/]+/[^/]+/[^/]+)/', 1) end"
DAY = "strftime({0}, '%Y/%m/%d')"
PLACE = ACTUAL.format("path")
EFFECTIVE = "coalesce(user_corrected_date, date_taken)"
EXIF_DAY = "coalesce(try_strptime(date_time_original, '%Y:%m:%d %H:%M:%S'), try_strptime(date_time_digitized, '%Y:%m:%d %H:%M:%S'))"


def summary(effective):
    wrong = f"""coalesce(strftime(case when in_catalog then {effective} else coalesce({EXIF_DAY}, creation_date) end, '%Y/%m/%d') <> {PLACE}, false)"""
    return f"""select *, undocumented_count + missing_count + misplaced_count + undocumented_misplaced_count = 0 as in_sync from (
        select count(*) filter (on_disk) as on_disk, count(*) filter (in_catalog) as in_database, count(*) filter (on_disk and not in_catalog) as undocumented_count,
        count(*) filter (in_catalog and not on_disk) as missing_count, count(*) filter (on_disk and in_catalog and wrong) as misplaced_count,
        count(*) filter (on_disk and not in_catalog and wrong) as undocumented_misplaced_count from (select *, {wrong} as wrong from archived))"""


MISPLACED = f"""misplaced as (select path as archive_path, {DAY.format(EFFECTIVE)} || '/' || {NAME.format('path')} as expected_relative_path, {PLACE} as actual_folder,
    {DAY.format(EFFECTIVE)} as expected_folder, {EFFECTIVE} as date_taken, case when user_corrected_date is null then 'original' else 'user_corrected' end as date_source
    from archived where in_catalog and on_disk and {DAY.format(EFFECTIVE)} <> {PLACE})"""

ENTRIES = f"""{over('texts')}, entries as (select path, case when labeled and quality = 1 then case when toxic = 0 then file_size end
        when labeled then coalesce(case when toxic = 0 then nullif(file_size, 0) end, file_size) else file_size end as file_size,
    sha256(text) as file_hash, labeled as documented,
    case when quality = 1 then 'cached' when labeled then 'newly_hashed' else 'undocumented' end as origin from texts)"""
GROUPS = """grouped as (select file_hash, arg_min_null(file_size, path) as file_size, count(*) as count, min(path) as first_path from entries group by 1 having count(*) > 1),
    dups as (select *, coalesce(file_size, 0) * (count - 1) as wasted_bytes from grouped)"""
TEXT_CATALOG = """held as (select id, path as archive_path, sha256(text) as file_hash, quality, timestamp '2020-01-01 00:00:00' + interval 1 day * id as date_taken,
    case when toxic = 1 then timestamp '2010-01-01 00:00:00' + interval 1 day * id end as user_corrected_date, case when length(text) > 500 then 95 else 30 end as confidence
    from texts where labeled)"""

LOCATED = "select *, archive_path as absolute_path, exists (select 1 from listing l where l.path = archive_path) as file_exists from catalog where "

def quoted(text):
    return "'" + text.replace("'", "''") + "'"


UNCERTAIN = f"{quoted(NOT_UNCERTAIN[0])} || c.file_id || {quoted(NOT_UNCERTAIN[1])} || a.date_uncertain || {quoted(NOT_UNCERTAIN[2] + NOT_ELIGIBLE)}"
GUARD = f"""{ARCHIVE.replace('with ', 'with recursive corrections as (' + standins.oracle_view('corrections') + '), ', 1)},
    guarded as (select c.seq, c.file_id, c.corrected_date, a.archive_path, case when a.id is null then {quoted(UNKNOWN_ID[0])} || c.file_id || {quoted(UNKNOWN_ID[1])}
        when not (a.date_uncertain = 1 or a.user_corrected_date is not null) then {UNCERTAIN}
        when l.path is null then {quoted(FILE_GONE)} || a.archive_path end as error
        from corrections c left join catalog a on a.id = c.file_id left join listing l on l.path = a.archive_path)"""


def corrected_one_by_one(fails):
    """Each file's corrections one after the other; in these tables only a file's own name can be in its way."""
    wanted = f"'/archive/' || strftime(s.corrected_date, '%Y/%m/%d') || '/' || {NAME.format('w.path')}"
    new = rf"case when {wanted} = w.path then regexp_replace(w.path, '(\.[^./]+)$', ' (1)\1') else {wanted} end"
    return f"""{GUARD}, steps as (select *, row_number() over (partition by file_id order by seq) as turn from guarded where error is null),
    walk as (select distinct file_id, cast(0 as bigint) as turn, archive_path as path, cast(null as bigint) as seq, cast(null as timestamp) as corrected_date, cast(null as varchar) as new_archive_path, false as failed from steps
        union all select s.file_id, s.turn, case when {fails} then w.path else {new} end, s.seq, s.corrected_date, {new}, {fails} from walk w join steps s on s.file_id = w.file_id and s.turn = w.turn + 1),
    results as (select g.seq, g.file_id, g.error is null and not w.failed as success, case when not w.failed then w.new_archive_path end as new_archive_path,
        coalesce(g.error, case when w.failed then 'No space left on device' end) as error from guarded g left join walk w on w.seq = g.seq),
    moves as (select file_id, arg_max(new_archive_path, seq) as new_archive_path, arg_max(corrected_date, seq) as corrected_date from walk where seq is not null and not failed group by file_id)"""


RESULTS = "select seq, file_id, coalesce(success, false) as success, new_archive_path, error from results"
CORRECTED = f"""select c.id, coalesce(m.new_archive_path, c.archive_path) as archive_path, c.file_size, c.date_taken, coalesce(m.corrected_date, c.user_corrected_date) as user_corrected_date,
        cast(case when m.file_id is null then c.date_uncertain else 0 end as integer) as date_uncertain, c.confidence, c.date_added, case when m.file_id is not null then {ADDED_AT} end as corrected_at
        from catalog c left join moves m on m.file_id = c.id"""
FULL_DISK = "s.seq % 7 = 0"

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
STRICT = "^[0-9]{4}:[0-9]{1,2}:[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"


def strict(text):
    return rf"case when regexp_matches({text}, '{STRICT}') then try_strptime(regexp_replace({text}, ' +', ' '), '%Y:%m:%d %H:%M:%S') end"


STAMP_FORMS = [
    (r"'?(\d{4}|\d{2})[\s\-\./](\d{1,2})[\s\-\./](\d{1,2})\b", (1, 2, 3)),
    (r"\b(\d{1,2})[\s\-\./](\d{1,2})[\s\-\./]'?(\d{4}|\d{2})\b", (3, 1, 2)),
    (r"\b(\d{1,2})[\s\-\./](\d{1,2})[\s\-\./]'?(\d{4}|\d{2})\b", (3, 2, 1)),
]


def _stamps():
    fields, tried = [], []
    for i, (pattern, (y, m, d)) in enumerate(STAMP_FORMS):
        quoted = pattern.replace("'", "''")
        part = "try_cast(regexp_extract(raw_text, '{0}', {1}) as integer)"
        year = part.format(quoted, y)
        fields.append(
            f"try_cast(printf('%04d-%02d-%02d', case when {year} < 31 then {year} + 2000 when {year} < 100 then {year} + 1900 else {year} end, "
            f"{part.format(quoted, m)}, {part.format(quoted, d)}) as timestamp) as d{i}, regexp_extract(raw_text, '{quoted}', 0) as m{i}"
        )
        tried.append(i)
    return f"""tried as (select *, {', '.join(fields)} from attempts),
    first_read as (select *, coalesce(d0, d1, d2) as found, case when d0 is not null then m0 when d1 is not null then m1 else m2 end as matched from tried),
    readings as (select file_id, attempt_seq, corner, rotation, variant, raw_text, ocr_confidence,
        case when year(found) >= 1900 and found <= {AS_OF} then found end as stamp_date,
        coalesce(year(found) >= 1900 and found <= {AS_OF} and regexp_matches(matched, '[-./'']'), false) as punctuated from first_read),
    stamped as (select *, coalesce(stamp_date is not null and ocr_confidence >= case when punctuated then 40 else 65 end, false) as accepted from readings)"""


STAMPED = f"{over('attempts')}, {_stamps()}"
STOPS = "stops as (select file_id, min(attempt_seq) filter (accepted) as stop from stamped group by 1)"
ROUNDED = "round_even(ocr_confidence, 1) as ocr_confidence"

SQL = {
    "inventory_scan": f"""{over('photos')} select path as file_path, lower({suffix('path')}) as file_extension, file_size, creation_date, modification_date
        from photos where lower({suffix('path')}) in ('.jpg', '.jpeg', '.tif')""",
    "archive_listing": f"{over('site_files')} select path, file_size from site_files where {NAME.format('path')} <> 'archive_database.db'",
    "archive_listing_typed": f"{over('site_files')} select path, file_size from site_files where lower({suffix('path')}) in ('.html', '.gz')",
    "inventory_append": f"""{over('texts')} select path as file_path, '.txt' as file_extension, file_size, cast(null as timestamp) as creation_date,
        cast(null as timestamp) as modification_date, 'located' as status from texts where not labeled""",
    "inventory_stream_step": f"""{over('texts')} select path as file_path, '.txt' as file_extension, file_size, cast(null as timestamp) as creation_date,
        cast(null as timestamp) as modification_date, 'located' as status, (select coalesce(max(id), 0) from texts where labeled) + row_number() over (order by path) as id from texts where not labeled""",
    "inventory_append_counts": f"{over('texts')} select count(*) as found, count(*) filter (not labeled) as inserted, count(*) filter (labeled) as skipped from texts",
    "gather_signals": f"{over('photos')}, {PARSED}, {SIGNALS} select * from signals",
    "score_dates": f"{SCORED} select file_id, {CONCLUSION} from scored",
    "score_dates_long": f"{over('photos')}, {PARSED}, {SIGNALS}, {scored(days=3)} select file_id, {CONCLUSION} from scored",
    "score_with_ocr": f"""{STAMPED}, {STOPS}, ocr as (select s.file_id, stamp_date as ocr_date from stamped s join stops t on s.file_id = t.file_id and attempt_seq = stop),
        {over('photos')[5:]}, {PARSED}, {SIGNALS}, more as (select * from signals union all select p.file_id, 5, 'ocr_corner_stamp', ocr_date, 60 from parsed p join ocr using (file_id) where jpeg or tiff),
        {scored('more')} select file_id, {CONCLUSION} from scored""",
    "archive_plan": f"""{SCORED} select file_id, '/archive/' || case when confidence < 50 then '_review_needed' else strftime(date_taken, '%Y/%m/%d') end as archive_folder from scored""",
    "eligible_files": f"{over('photos')} select file_id as id, path as file_path from photos where {ELIGIBLE}",
    "filter_cascade": f"{over('photos')} select file_id, {REASON} as exclude_reason, {REASON} is null as passes from photos",
    "import_outcomes": f"{OUTCOMES} select id, outcome, exclude_reason, {PLANNED_ONLY} from outcomes",
    "unique_destination": f"{OUTCOMES}, {PLACED} select id, folder, dest_name from named",
    "unique_destination_existing": f"""{OUTCOMES}, taken as (select distinct k, user_id % 9 as number from photos),
        placed as (select *, row_number() over (partition by folder, name order by id) - case when folder = '/archive/_review_needed' and name = 'IMG_' || k || '.jpg'
            and exists (select 1 from taken t where t.k = outcomes.k and number = 0) then 0 else 1 end as place from outcomes where outcome = 'planned'),
        numbers as (select k, n, row_number() over (partition by k order by n) as nth from (select distinct k from photos) u, range(1, (select count(*) + max(user_id % 9) + 2 from photos)) r(n)
            where not exists (select 1 from taken t where t.k = u.k and t.number = r.n)),
        picked as (select p.id, p.folder, p.name, p.place, case when p.folder = '/archive/_review_needed' and p.name = 'IMG_' || p.k || '.jpg' then n.n else p.place end as number
            from placed p left join numbers n on n.k = p.k and n.nth = p.place)
        select id, folder, case when place = 0 then name else regexp_extract(name, '^(.+)\\.[^.]+$', 1) || ' (' || number || ')' || regexp_extract(name, '^.+(\\.[^.]+)$', 1) end as dest_name from picked""",
    "unique_destination_numbered": f"""with recursive {over('photos')[5:]}, requests as (select file_id as id, '/archive/' || event_type as folder, k, 'IMG_' || k || case when value > 40 then ' (' || user_id || ')' else '' end as stem from photos),
        asked as (select *, row_number() over (partition by folder, k order by id) as step from requests),
        picks as (select distinct folder, k, cast(0 as bigint) as step, cast([] as varchar[]) as taken, cast(null as bigint) as id from requests
            union all select a.folder, a.k, a.step, list_append(p.taken, case when not list_contains(p.taken, a.stem) then a.stem
                else a.stem || ' (' || list_filter(range(1, len(p.taken) + 2), lambda n: not list_contains(p.taken, a.stem || ' (' || n || ')'))[1] || ')' end), a.id
            from picks p join asked a on a.folder = p.folder and a.k = p.k and a.step = p.step + 1)
        select id, folder, taken[-1] || '.jpg' as dest_name from picks where id is not null""",
    "import_records": f"""{OUTCOMES}, {PLACED} select id, folder || '/' || dest_name as archive_path, source_path, file_extension, file_size, date_taken, date_source, filesystem_creation_date,
        date_uncertain, {ADDED_AT} as date_added, 'Maker' || user_id as camera_make, case when k > 10 then event_type end as camera_model, cast(null as varchar) as aperture,
        cast(k as varchar) as iso_speed, cast(null as varchar) as focal_length_mm, case when k % 2 = 0 then -{LATITUDE} else {LATITUDE} end as gps_latitude, case when value > 20 then -(cast(k as double) + gps_minute / 60.0 + 0.0 / 3600.0) end as gps_longitude, confidence, date_reason from named where confidence <> 98""",
    "copy_outcomes": f"""{OUTCOMES} select file_id as id, path as file_path, case when outcome = 'planned' and file_id % 9 <> 0 then 'imported' when outcome = 'excluded' then 'excluded' else status end as status
        from photos left join outcomes on id = file_id""",
    "status_update": f"""{OUTCOMES} select file_id as id, path as file_path, case outcome when 'planned' then 'imported' when 'excluded' then 'excluded' else status end as status
        from photos left join outcomes on id = file_id""",
    "import_summary": f"""{OUTCOMES} select count(*) filter (outcome = 'planned' and id % 9 <> 0) as copied, count(*) filter (outcome = 'planned' and id % 9 <> 0 and date_uncertain = 1) as review,
        count(*) filter (outcome = 'excluded') as excluded, count(*) filter (outcome = 'planned' and id % 9 = 0) as failed, count(*) filter (outcome = 'missing') as missing, count(*) as total from outcomes""",
    "audit_classify": f"""{over('archived')} select path, case when on_disk and in_catalog then 'matched' when on_disk then 'undocumented' else 'missing' end as section
        from archived where on_disk or in_catalog order by path""",
    "audit_missing": f"{ARCHIVE} select * from catalog where archive_path not in (select path from listing)",
    "audit_misplaced": f"{over('archived')}, {MISPLACED} select * from misplaced",
    "audit_undocumented": f"""{over('archived')}, judged as (select *, {EXIF_DAY} as exif, {PLACE} as actual, coalesce(strftime(coalesce({EXIF_DAY}, creation_date), '%Y/%m/%d') <> {PLACE}, false) as wrong
        from archived where on_disk and not in_catalog) select path, file_size, modification_date as modified_date, case when exif is null then 'filesystem_fallback' else 'exif' end as date_source,
        not wrong as correctly_placed, case when wrong then strftime(coalesce(exif, creation_date), '%Y/%m/%d') end as expected_folder, case when wrong then actual end as actual_folder from judged""",
    "audit_summary": f"{over('archived')} {summary(EFFECTIVE)}",
    "audit_report": f"""{over('archived')}, {MISPLACED}, entries as (select 'undocumented_files' as section, path from archived where on_disk and not in_catalog
        union all select 'missing_files', path from archived where in_catalog and not on_disk union all select 'misplaced_files', archive_path from misplaced)
        select section, path, row_number() over (order by section, path) - 1 as place from entries""",
    "dup_report": f"""{ENTRIES}, {GROUPS}, lines as (select wasted_bytes, first_path, 0 as step, null as path from dups
        union all select d.wasted_bytes, d.first_path, 1, e.path from entries e join dups d using (file_hash))
        select *, row_number() over (order by wasted_bytes desc, first_path, step, path) - 1 as place from lines""",
    "audit_diff": f"""{over('archived')}, b as ({summary('date_taken')}), a as ({summary(EFFECTIVE)}),
        pairs as (select 'misplaced_count' as metric, b.misplaced_count as before, a.misplaced_count as after from a, b
            union all select 'in_sync', cast(b.in_sync as bigint), cast(a.in_sync as bigint) from a, b) select * from pairs where before <> after""",
    "effective_date": f"""{over('archived')} select id, coalesce(user_corrected_date, case when o_totalprice >= 50000 then date_taken end) as effective_date from archived""",
    "folder_parts": f"""{over('archived')} select id, {PLACE} as actual_folder, {DAY.format('date_taken')} as expected_folder, {DAY.format('date_taken')} || '/' || {NAME.format('path')} as expected_relative_path from archived""",
    "content_hash": f"{over('texts')} select id, sha256(text) as file_hash from texts",
    "hash_cache_fill": f"{over('texts')} select path as file_path, sha256(text) as file_hash from texts where labeled",
    "audit_hash_fill": f"{over('texts')} select path as archive_path, sha256(text) as file_hash from texts where labeled and lang <> 'fr'",
    "dup_archive_entries": f"{ENTRIES} select * from entries",
    "dup_source_entries": f"{over('texts')} select id as position, path, file_size, sha256(text) as file_hash, true as documented from texts where status = 'located'",
    "dup_groups": f"{ENTRIES}, {GROUPS} select * from dups order by wasted_bytes desc, first_path",
    "dup_members": f"{ENTRIES}, {GROUPS} select e.file_hash, e.path, e.file_size, e.documented, d.count from entries e join dups d using (file_hash)",
    "dup_summary": f"""{ENTRIES}, {GROUPS} select (select count(*) from entries) as files_checked, count(*) as duplicate_groups, cast(sum(count) as bigint) as duplicate_files,
        cast(sum(wasted_bytes) as bigint) as wasted_bytes from dups""",
    "dup_cache_counters": f"""{ENTRIES} select count(*) filter (origin = 'cached') as documented_cached, count(*) filter (origin = 'newly_hashed') as documented_newly_hashed,
        count(*) filter (origin = 'undocumented') as undocumented_hashed from entries""",
    "dup_cache_counters_source": f"""{over('texts')} select count(*) filter (lang <> 'de' and quality = 1) as already_hashed, count(*) filter (lang <> 'de' and coalesce(quality, 0) = 0) as newly_hashed,
        count(*) filter (lang = 'de') as missing from texts where status in ('located', 'imported')""",
    "review_queue": f"{ARCHIVE} {LOCATED} date_uncertain = 1 order by date_added desc, id",
    "review_top_n": f"{ARCHIVE} {LOCATED} date_uncertain = 1 order by date_added desc, id limit 25",
    "file_details": f"{ARCHIVE} {LOCATED} id = 78",
    "correction_guard": f"{GUARD} select seq, file_id, error, error is null and seq < max(case when error is null then seq end) over (partition by file_id) as superseded from guarded",
    "correction_results": f"{corrected_one_by_one('false')} {RESULTS}",
    "correction_moves": f"{corrected_one_by_one(FULL_DISK)} {RESULTS}",
    "apply_moved_corrections": f"{corrected_one_by_one(FULL_DISK)} {CORRECTED}",
    "apply_corrections": f"{corrected_one_by_one('false')} {CORRECTED}",
    "exif_dates": f"""{over('date_texts')}, p as (select *, {strict('original')} as a, {strict('digitized')} as b from date_texts)
        select {KEYS}, coalesce(a, b) as date, case when a is not null then 'exif_original' when b is not null then 'exif_digitized' end as source from p""",
    "tiff_dates": f"{over('date_texts')} select {KEYS}, {strict('original')} as date from date_texts",
    "gps_dates": f"""{over('date_texts')} select {KEYS}, case when l_linenumber in (6, 7) then null when l_returnflag = 'A' then date_trunc('day', moment)
        when hour_part < 24 and minute_part < 60 and second_part < 60 then date_trunc('day', moment) + to_hours(cast(trunc(hour_part) as bigint)) + to_minutes(cast(trunc(minute_part) as bigint)) + to_seconds(trunc(second_part)) end as date from date_texts""",
    "xmp_dates": f"""{over('date_texts')} select {KEYS}, case l_linenumber when 1 then moment when 2 then moment + interval 250 millisecond when 3 then date_trunc('day', moment)
        when 4 then date_trunc('day', moment) when 5 then null when 6 then date_trunc('minute', moment) else date_trunc('day', moment) end as date from date_texts""",
    "iso_dates": """select event_id, case when event_type = 'view' or microsecond(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as iso from events""",
    "gps_decimal": f"""{over('date_texts')}, p as (select *, l_quantity + hour_part / 60.0 + second_part / 3600.0 as x from date_texts)
        select {KEYS}, case l_returnflag when 'A' then -x when 'N' then x end as degrees from p""",
    "camera_info": """select p_partkey, case when p_size > 3 then p_brand end as camera_make, p_type as camera_model, 'f/' || printf('%.1f', p_retailprice / 4) as aperture,
        cast(p_size as varchar) as iso_speed, printf('%.1f', p_retailprice / 8) || 'mm' as focal_length_mm from part""",
    "format_size": f"{over('date_texts')}, p as (select *, floor(pow(l_quantity, l_linenumber) * 256) as bytes from date_texts) select {KEYS}, {size_text('bytes')} as size from p",
    "path_parts": f"""{over('site_files')}, p as (select page_id, path, {NAME.format('path')} as name from site_files)
        select page_id, name, {SUFFIX.format('name')} as suffix, left(name, length(name) - length({SUFFIX.format('name')})) as stem, lower({SUFFIX.format('name')}) as extension, substr(path, 10) as relative from p""",
    "ocr_text_date": f"{STAMPED} select attempt_seq, stamp_date, punctuated, accepted from stamped",
    "ocr_attempt_text": f"""{over('words')} select file_id, attempt_seq, coalesce(string_agg(text, ' ' order by word_seq, text) filter (trim(text) <> ''), '') as raw_text,
        coalesce(avg(conf) filter (trim(text) <> '' and conf >= 0), 0.0) as ocr_confidence from words group by 1, 2""",
    "ocr_first_accepted": f"""{STAMPED}, {STOPS}, looked as (select s.file_id, count(*) as checked from stamped s join stops t using (file_id) where stop is null or attempt_seq <= stop group by 1)
        select t.file_id, s.attempt_seq, s.stamp_date as ocr_date, corner, rotation, variant, raw_text, {ROUNDED}, checked
        from stops t join looked using (file_id) left join stamped s on s.file_id = t.file_id and s.attempt_seq = t.stop""",
    "ocr_checked": f"""{STAMPED}, {STOPS} select s.file_id, attempt_seq, corner, rotation, variant, raw_text, {ROUNDED} from stamped s join stops t using (file_id) where stop is null or attempt_seq <= stop""",
    "xmp_signal": f"""{over('archived')} select id, case when o_orderstatus = 'P' then date_taken when o_totalprice > 300000 then date_added when o_totalprice > 100000 then creation_date end as date,
        case when o_orderstatus = 'P' or o_totalprice > 300000 then 'xmp_create_date' when o_totalprice > 100000 then 'xmp_modify_date' end as source from archived""",
    "metadata_extract": f"""{over('photos')}, p as (select *, event_type not in ('error', 'purchase') as ok, replace(substr(cast(ts as varchar), 1, 19), '-', ':') as d from photos)
        select file_id, path, ok as has_exif, case when ok then d end as date_time_original, cast(null as varchar) as date_time_digitized, case when event_type <> 'error' then d end as tiff_datetime,
        case when ok then replace(substr(cast(ts as varchar), 1, 19), ' ', 'T') end as xmp_create_date, cast(null as varchar) as xmp_modify_date,
        case when ok then 'Maker' || lpad(cast(k as varchar), 10, '0') end as make, cast(null as varchar) as model, case when ok then 'f/2.8' end as aperture,
        case when ok then cast(user_id as varchar) end as iso_speed, case when ok then '50.5mm' end as focal_length_mm, cast(null as varchar) as error from p""",
    "hash_twin_signal": f"""{over('texts')}, {TEXT_CATALOG}, best as (select file_hash, coalesce(user_corrected_date, date_taken) as date, row_number() over (partition by file_hash
            order by user_corrected_date is not null desc, confidence desc, id) as rn from held where (user_corrected_date is not null or confidence >= 90) and quality = 1)
        select t.id as file_id, 10 as seq, 'hash_twin' as source, b.date, 97 as base_confidence from texts t join best b on b.file_hash = sha256(t.text) and rn = 1""",
    "filename_signal": f"""{over('archived')} select id as file_id, 14 as seq, 'filename_pattern' as source, case when o_orderstatus = 'P' then date_taken else date_trunc('day', date_taken) end as date,
        75 as base_confidence from archived where o_orderstatus in ('P', 'F')""",
    "folder_signal": f"""{over('archived')} select id as file_id, 15 as seq, 'folder_pattern' as source, strptime(substr(path, 10, 10), '%Y/%m/%d') as date, 40 as base_confidence
        from archived where o_orderpriority <> '1-URGENT'""",
    "sidecar_signal": f"""{over('photos')} select file_id, 11 as seq, 'takeout_json' as source, timestamp '1970-01-01' + to_seconds(floor(value * 1000000)) as date, 96 as base_confidence from photos where k < 50
        union all select file_id, 12, 'sidecar_xmp', try_cast(substr(xmp_create_date, 1, 19) as timestamp), 88 from photos where k >= 40 and xmp_create_date is not null
        union all select file_id, 13, 'sidecar_thm', try_strptime(tiff_datetime, '%Y:%m:%d %H:%M:%S'), 90 from photos where event_type = 'error'""",
    "sequence_signal": f"""{over('archived')}, f as (select id, substr(o_orderpriority, 1, 1) as p, case when o_orderstatus <> 'P' then timestamp '2020-01-01 00:00:00' + interval 1 hour * id end as d from archived),
        w as (select *, last_value(d ignore nulls) over (partition by p order by id rows between unbounded preceding and 1 preceding) as b,
            first_value(d ignore nulls) over (partition by p order by id rows between 1 following and unbounded following) as a from f)
        select id as file_id, 16 as seq, 'sequence_neighbor' as source, b as date, 45 as base_confidence from w where d is null and cast(a as date) = cast(b as date)""",
    "dup_date_conflicts": f"""{ENTRIES}, p as (select file_hash, {PLACE} as folder from entries) select file_hash, count(*) as files, count(distinct folder) as folders, min(folder) as first_folder,
        max(folder) as last_folder from p where folder is not null group by 1 having count(distinct folder) > 1""",
    "audit_fix_plan": f"""{over('archived')}, {MISPLACED} select case when on_disk then 'add_to_catalog' else 'drop_from_catalog' end as action, path, cast(null as varchar) as target
        from archived where on_disk <> in_catalog union all select 'move', archive_path, '/archive/' || expected_relative_path from misplaced""",
    "import_skip_dupes": f"""{over('texts')} select arg_min(id, path) as file_id, min(path) as path from texts where sha256(text) not in (select sha256(text) from texts where quality = 1)
        group by sha256(text)""",
    "rescore_uncertain": f"""{SCORED}, unsure as (select file_id from scored where confidence < 50), more as (select * from (select * from signals
            union all select file_id, 14, 'filename_pattern', date_trunc('day', ts), 75 from photos) where file_id in (select file_id from unsure)),
        """
    + scored("more", "unsure", labels={**settings.SOURCE_LABELS, **settings.EXTRA_LABELS})
    .replace("ranked", "ranked2").replace("prim ", "prim2 ").replace("others", "others2").replace("sums", "sums2").replace("fs as", "fs2 as")
    .replace("left join fs ", "left join fs2 fs ").replace("scored as", "scored2 as")
    + f" select file_id, {CONCLUSION} from scored2",
    "label_search": f"""{ARCHIVE}, links as (select distinct l_orderkey, case when l_returnflag = 'A' then 'ai' else 'user' end as label_source from lineitem join part on l_partkey = p_partkey where p_type = 'ECONOMY')
        select id, archive_path, 'ECONOMY' as label_name, 'thing' as category, label_source from catalog join links on l_orderkey = id""",
}
