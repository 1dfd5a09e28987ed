import base64
import hashlib
import io
from collections import Counter

import pyarrow as pa
import pytest
from mediadate.llm import registry, warc


def brute(pages, least=0):
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    rows = []
    for page, _, html in pages:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        low = first.get(html or "")
        again = page is not None and page != low and len(payload) >= least
        rows.append((page, len(payload), digest, "revisit" if again else "response", low if again else None))
    return Counter(rows)


def test_query(spark, folder):
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    got = registry.op7_warc(spark, folder).collect()
    assert Counter(tuple(r[n] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == brute(pages)


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_every_record_has_one_reader(spark, split):
    pages = [(k, f"http://h/{k}", f"page {k} " * (k * 37 % 400)) for k in range(150)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(frame, least_bytes=10)
    records = warc.read_archives(archives, split_bytes=split, payloads=True).collect()
    assert Counter(int(r["page"]) for r in records) == Counter(range(150))
    assert all(r["intact"] for r in records) and len({(r["path"], r["offset"]) for r in records}) == 150
    text = {r["page"]: bytes(r["payload"]).decode() for r in records if r["record_type"] == "response"}
    assert all(text[str(k)] == html for k, _, html in pages if str(k) in text)
    assert {r["uri"] for r in records} == {url for _, url, _ in pages}


def test_false_magic_and_damage_are_passed_over():
    good = [warc.pack_record(k, None, f"text {k}".encode() * 50) for k in range(3)]
    inner = warc.MAGIC + b"no member" + warc.MAGIC
    damaged = bytearray(good[1])
    damaged[len(damaged) // 2] ^= 0xFF
    data = inner + good[0] + inner + bytes(damaged) + good[2] + inner
    for end in range(1, len(data), 13):
        pages = []
        for start in range(0, len(data), end):
            reader = warc.RangeReader(pa.PythonFile(io.BytesIO(data), "r"), start, start + end)
            pages += [warc.parse_record(record)["page"] for _, record in reader]
        assert pages == ["0", "2"]


def test_long_headers_and_clashing_columns(spark):
    pages = [(0, "http://h/0", "<p>a</p>", 1), (1, "http://h/" + "x" * (2 << 20), "<p>b</p>", 2), (2, None, "y" * 300_000, 3), (2, None, "y" * 300_000, 3)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, first int")
    frame = frame.withColumns({"digest": frame["first"], "path": frame["first"], "records": frame["first"]})
    records = warc.read_whole(warc.write_archives(frame), split_bytes=1 << 16, payloads=True).collect()
    assert sorted(r["page"] for r in records) == ["0", "1", "2", "2"]
    assert {r["page"]: r["uri"] for r in records}["1"] == pages[1][1] and all(r["intact"] for r in records)


def test_missing_records_are_an_error(spark):
    frame = spark.createDataFrame([(k, None, f"page {k}" * 50) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(frame)
    system, path = warc.file_system(archives.first()["path"])
    with system.open_input_file(path) as source:
        data = bytearray(source.read())
    data[data.index(warc.MAGIC, 200) + 40] ^= 0xFF
    with system.open_output_stream(path, compression=None) as out:
        out.write(bytes(data))
    with pytest.raises(ValueError, match="20 records, but 19"):
        warc.read_whole(archives)


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_whole(warc.write_archives(frame)).collect() == []
