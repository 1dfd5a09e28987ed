"""Archive tables derived from general-purpose tables.

Every view is SQL that Spark and DuckDB read alike, with table names in braces. The rows of the given
tables become files, tags, catalog rows and so on; no row is left out.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediadate.sources.contents import content_hash

ARCHIVE_ROOT = "/archive"
AS_OF = "2024-06-15 12:00:00"
ADDED_AT = "2024-06-15 12:30:00"

CAMERA_TEXT = "replace(substr(cast({0} as string), 1, 19), '-', ':')"
DAY_TEXT = "replace(substr(cast({0} as string), 1, 10), '-', '{1}')"


def _camera(expression: str) -> str:
    return CAMERA_TEXT.replace("{0}", expression)


def _day(expression: str, separator: str) -> str:
    return DAY_TEXT.replace("{0}", expression).replace("{1}", separator)


VIEWS = {}

# One media file per event: tags as text, some missing, broken or implausible; some files' type is told
# otherwise than by their suffix.
VIEWS["photos"] = f"""
select event_id as file_id, k, user_id, event_type, value, ts,
  case when k = 3 then '.tif' when k = 4 then '.jpg' when k = 5 then '' when k = 6 then '.mp4' end as file_type,
  concat('/camera/u', user_id, '/', event_id, '/IMG_', k, ext) as path,
  cast(floor(value * 1000) as bigint) as file_size,
  case when k <> 7 then ts end as creation_date,
  ts + interval '1' hour * k as modification_date,
  case when value > 200 then 'imported' when value > 100 then 'excluded' else 'located' end as status,
  value >= 10 and event_type <> 'error' as has_exif,
  case when value < 10 then null when value < 12 then 'not a date'
       when k = 0 then '1960:05:05 10:00:00' when k = 1 then '2031:01:02 03:04:05'
       else {_camera("ts + interval '1' hour * (k - 50)")} end as date_time_original,
  case when value < 11 then {_camera("ts + interval '1' hour * (k - 60)")} end as date_time_digitized,
  case when value > 60 then {_day("ts - interval '1' hour * k", ":")} end as gps_date_stamp,
  case when value > 90 then cast(k / 5 as double) end as gps_hour,
  cast(k / 2 as double) as gps_minute, cast(k as double) * 0.5 as gps_second,
  {_camera("ts - interval '1' minute * k * k")} as tiff_datetime,
  case when value > 30 and value < 80
       then concat(replace(substr(cast(ts + interval '1' hour * (k - 40) as string), 1, 19), ' ', 'T'), '+09:00') end
       as xmp_create_date,
  case when value > 70 and value < 75 then {_day("ts", "-")} end as photoshop_date_created,
  case when value > 5 and value < 35 then concat(replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z') end
       as xmp_modify_date
from (
  select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
    case event_type when 'view' then '.jpg' when 'click' then '.JPEG' when 'purchase' then '.tif'
                    when 'signup' then '.thm' else '.mp4' end as ext
  from {{events}}) as e
"""

# Archived files, one per order. Pending orders are not in the catalog; expensive finished ones are
# no longer on disk. Medium-priority files lie one day off, urgent ones wait for review.
VIEWS["archived"] = f"""
select o_orderkey as id, o_orderstatus, o_orderpriority, o_custkey, o_totalprice,
  case when o_orderpriority = '1-URGENT' then concat('/archive/_review_needed/IMG_', o_orderkey, '.jpg')
       when o_orderpriority = '3-MEDIUM' then concat('/archive/', {_day("o_orderdate + interval '1' day", "/")}, '/IMG_', o_orderkey, '.jpg')
       else concat('/archive/', {_day("o_orderdate", "/")}, '/IMG_', o_orderkey, '.tar.JPG') end as path,
  o_orderstatus <> 'P' as in_catalog,
  o_orderstatus <> 'F' or o_totalprice < 400000 as on_disk,
  cast(floor(o_totalprice) as bigint) as file_size,
  o_orderdate + interval '1' second * o_custkey as date_taken,
  case when o_orderpriority = '2-HIGH' and o_totalprice > 250000 then o_orderdate + interval '1' day end as user_corrected_date,
  case when o_orderpriority = '1-URGENT' then 1 else 0 end as date_uncertain,
  case when o_orderpriority = '1-URGENT' then 30 else 95 end as confidence,
  o_orderdate + interval '10' day as date_added,
  o_orderdate + interval '36' hour as creation_date,
  o_orderdate + interval '40' hour as modification_date,
  case when o_totalprice > 100000 then {_camera("o_orderdate")} end as date_time_original,
  case when o_totalprice > 90000 then {_camera("o_orderdate + interval '1' day")} end as date_time_digitized
from {{orders}}
"""

# Files with text content, one per document; labeled ones are in the catalog, those of good quality
# with a hash.
VIEWS["texts"] = """
select d.doc_id as id, concat('/archive/', d.source, '/', d.lang, '/', substr(d.source, 4, 2), '/doc_', d.doc_id, '.txt') as path,
  d.source, d.lang, d.text, d.n_chars as file_size, l.quality, l.toxic, l.doc_id is not null as labeled,
  case when l.toxic = 1 then 'excluded' when l.quality = 0 then 'imported' else 'located' end as status
from {documents} as d left join {labels} as l on d.doc_id = l.doc_id
"""

# Corrections a person asks for, some of unknown files. Household files are corrected four times: to
# another day, to the same day again (where their own name is taken), and back to the day they left.
VIEWS["corrections"] = """
select c_custkey + 1000000000 * cast(again as bigint) as seq, c_custkey * 7 as file_id,
  case when again in (1, 2) then timestamp '2003-01-01 00:00:00' else timestamp '2002-01-01 00:00:00' end
    + interval '1' day * c_nationkey as corrected_date
from {customer}
cross join (select 0 as again union all select 1 union all select 2 union all select 3) as times
where again = 0 or c_mktsegment = 'HOUSEHOLD'
"""

# Date texts, one per line item, in good and bad forms.
VIEWS["date_texts"] = f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when l_linenumber = 1 then {_camera("moment")}
       when l_linenumber = 2 then replace({_camera("moment")}, ' ', '  ')
       when l_linenumber = 3 then concat({_camera("moment")}, ' ')
       when l_linenumber = 4 then substr({_camera("moment")}, 1, 16)
       when l_linenumber = 5 then replace({_camera("moment")}, ':0', ':')
       when l_linenumber = 6 then replace({_camera("moment")}, ':0', ':3')
       else '' end as original,
  case when l_returnflag = 'A' then {_camera("moment + interval '1' hour")} end as digitized,
  case when l_linenumber = 1 then replace(substr(cast(moment as string), 1, 19), ' ', 'T')
       when l_linenumber = 2 then concat(replace(substr(cast(moment as string), 1, 19), ' ', 'T'), '.25-03:30')
       when l_linenumber = 3 then concat('  ', substr(cast(moment as string), 1, 10), ' ')
       when l_linenumber = 4 then {_day("moment", "")}
       when l_linenumber = 5 then substr(cast(moment as string), 1, 7)
       when l_linenumber = 6 then concat(replace(substr(cast(moment as string), 1, 16), ' ', 'T'), 'Z')
       else replace(substr(cast(moment as string), 1, 10), '-0', '-') end as iso,
  case when l_linenumber = 7 then {_day("moment", "-")} when l_linenumber = 6 then concat({_day("moment", ":")}, ':1')
       else {_day("moment", ":")} end as gps_stamp,
  l_linenumber as n, l_quantity as hour_part, l_discount * 400 as minute_part, l_tax * 700 as second_part,
  l_returnflag, l_linestatus, l_quantity, l_extendedprice, moment
from (select *, l_shipdate + interval '1' second * (l_partkey * 43 + l_suppkey) as moment from {{lineitem}}) as l
"""

# OCR attempts, one per order, several per customer.
VIEWS["attempts"] = f"""
select o_custkey as file_id, o_orderkey as attempt_seq,
  case o_orderstatus when 'P' then 'bottom_right' when 'F' then 'bottom_left' else 'top_right' end as corner,
  cast(o_custkey % 4 * 90 as int) as rotation, case when o_orderstatus = 'P' then 'raw' else 'otsu' end as variant,
  case substr(o_orderpriority, 1, 1)
       when '1' then concat(substr(cast(o_orderdate as string), 6, 2), '.', substr(cast(o_orderdate as string), 9, 2), '.', substr(cast(o_orderdate as string), 1, 4))
       when '2' then concat('''', substr(cast(o_orderdate as string), 3, 2), ' ', substr(cast(o_orderdate as string), 6, 2), ' ', substr(cast(o_orderdate as string), 9, 2))
       when '3' then concat('10:02 ', substr(cast(o_orderdate as string), 9, 2), '/', substr(cast(o_orderdate as string), 6, 2), '/', substr(cast(o_orderdate as string), 3, 2))
       when '4' then concat(substr(cast(o_orderdate as string), 9, 2), ' ', substr(cast(o_orderdate as string), 6, 2), ' ', substr(cast(o_orderdate as string), 1, 4))
       else concat('1', substr(cast(o_orderdate as string), 2, 9)) end as raw_text,
  floor(o_totalprice / 100) / 50 as ocr_confidence
from {{orders}}
"""

# OCR words, one per line item.
VIEWS["words"] = """
select l_orderkey as file_id, l_linenumber as attempt_seq, l_suppkey * 1000000 + l_partkey as word_seq,
  case when l_returnflag = 'R' and l_linestatus = 'F' then '  ' else concat(substr(cast(l_shipdate as string), 6, 5), '.', l_partkey) end as text,
  case when l_discount > 0.08 then cast(-1 as double) else l_quantity end as conf
from {lineitem}
"""

# Web pages as files of an archive folder.
VIEWS["site_files"] = """
select page_id, concat('/archive/', regexp_extract(url, '^https?://([^/]+)', 1), '/', page_id, '/',
    case when url like '%.html' then 'Index.HTML' when url like '%utm_source%' then 'archive_database.db'
         when url like '%#top' then '.htm' when url like '%?page%' then 'page.' else 'a.tar.gz' end) as path,
  cast(length(html) as bigint) as file_size
from {pages}
"""

TABLES = sorted({name for view in VIEWS.values() for name in re.findall(r"\{(\w+)\}", view)})


def oracle_view(name: str) -> str:
    """View text over tables of their own names."""
    return VIEWS[name].format(**{table: table for table in TABLES})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame over the tables of one folder."""
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    text = VIEWS[name].replace("timestamp '", "timestamp_ntz '")
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """``photos`` with all evidence columns."""
    clock = F.array("gps_hour", "gps_minute", "gps_second")
    none = F.lit(None)
    return view(spark, folder, "photos").withColumns(
        {
            "gps_time_stamp": F.when(F.col("gps_hour").isNotNull(), clock),
            "gps_lat": F.array(F.col("k").cast("double"), F.col("gps_minute"), F.col("gps_second")),
            "gps_lat_ref": F.when(F.col("k") % 2 == 0, "S").otherwise("N"),
            "gps_lon": F.when(F.col("value") > 20, F.array(F.col("k").cast("double"), F.col("gps_minute"), F.lit(0.0))),
            "gps_lon_ref": F.lit("W"),
            "make": F.concat(F.lit(" Maker"), F.col("user_id")),
            "model": F.when(F.col("k") > 10, F.col("event_type")),
            "aperture": none.cast("string"),
            "iso_speed": F.col("k").cast("string"),
            "focal_length_mm": none.cast("string"),
        }
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows of ``archived``."""
    rows = view(spark, folder, "archived").filter("in_catalog")
    return rows.select(
        "id", F.col("path").alias("archive_path"), "file_size", "date_taken", "user_corrected_date", "date_uncertain",
        "confidence", "date_added", F.lit(None).cast("timestamp_ntz").alias("corrected_at"),
    )


def archive_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Disk listing of ``archived``, with the tags a fresh look at the files would give."""
    rows = view(spark, folder, "archived").filter("on_disk")
    return rows.select("path", "file_size", "creation_date", "modification_date", "date_time_original", "date_time_digitized")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``texts`` with the hash the catalog holds: filled for good quality, empty for bad."""
    rows = view(spark, folder, "texts")
    stored = F.when(F.col("quality") == 1, content_hash(F.col("text"))).when(F.col("quality") == 0, "")
    return rows.withColumn("file_hash", stored)


def text_hashes(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "path") -> DataFrame:
    """Freshly computed hashes of the wanted paths; only path and digest leave the scan."""
    rows = view(spark, folder, "texts").join(wanted, "path", "left_semi")
    return rows.select(F.col("path").alias(key), content_hash(F.col("text")).alias("new_hash"))


def _hex(text: Column) -> Column:
    return F.hex(F.encode(text, "US-ASCII"))


def jpeg_bytes(camera_date: Column, maker: Column, iso: Column, packet: Column, packet_length: int) -> Column:
    """A small JPEG with EXIF and XMP segments; ``maker`` has 15 characters, ``camera_date`` 19, ``iso`` 32 bits."""

    def entry(tag, kind, count, value):
        return struct.pack(">HHII", tag, kind, count, value).hex()

    main, nested, data = 8, 8 + 2 + 3 * 12 + 4, 8 + 2 + 3 * 12 + 4 + 2 + 4 * 12 + 4
    maker_at, date_at, f_at = data, data + 16, data + 36
    directory = struct.pack(">H", 3).hex() + entry(0x010F, 2, 16, maker_at) + entry(0x0132, 2, 20, date_at)
    directory += entry(0x8769, 4, 1, nested) + "00000000"
    details = struct.pack(">H", 4).hex() + entry(0x829D, 5, 1, f_at) + struct.pack(">HHI", 0x8827, 4, 1).hex()
    rest = entry(0x9003, 2, 20, date_at) + entry(0x920A, 5, 1, f_at + 8) + "00000000"
    tiff = b"MM\x00*".hex() + struct.pack(">I", main).hex()
    exif_size = 2 + 6 + data + 16 + 20 + 16
    head = "ffd8ffe1" + struct.pack(">H", exif_size).hex() + b"Exif\x00\x00".hex() + tiff + directory + details
    name = b"http://ns.adobe.com/xap/1.0/\x00"
    xmp_head = "ffe1" + struct.pack(">H", 2 + len(name) + packet_length).hex() + name.hex()
    iso_hex = F.lpad(F.hex(iso.cast("long")), 8, "0")
    rationals = struct.pack(">IIII", 28, 10, 505, 10).hex()
    pieces = [
        F.lit(head), iso_hex, F.lit(rest), _hex(maker), F.lit("00"), _hex(camera_date), F.lit("00"), F.lit(rationals),
        F.lit(xmp_head), _hex(packet), F.lit("ffda0002ffd9"),
    ]
    return F.unhex(F.concat(*pieces))


PACKET = (
    '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    '<rdf:Description xmlns:{0}="http://ns.adobe.com/xap/1.0/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/">'
    "{1}</rdf:Description></rdf:RDF></x:xmpmeta>"
)
