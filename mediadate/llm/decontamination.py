"""Benchmark decontamination with an Aho-Corasick automaton over the items' word windows.

Item and document texts are normalised byte by byte (A-Z lower-cased, other ASCII than digits and
letters to spaces), so a place in the normalised text is a place in the original. A window is 13
consecutive words of an item, or the whole item if it has fewer. The distinct windows, joined by
single spaces and enclosed in spaces, are the automaton's patterns; each document is scanned once.

The patterns are read by the driver and broadcast, in chunks of at most ``CHUNK`` patterns (some
100 MB as an automaton). A set with more is scanned chunk after chunk, one automaton at a time.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mediadate.llm.common import LOWER, UPPER, worker_cache

WORDS = 13
CHUNK = 200_000
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
NORMAL = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b in _KEPT else 0x20 for b in range(256)
)
RUN = re.compile(rb"[^ ]+")
FOUND = "array<struct<start:int,end:int,items:array<string>>>"
SCHEMA = f"n_words long, n_hit long, items array<string>, spans {FOUND}"


def normal_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)


def item_windows(text: str | None, words: int = WORDS) -> set[bytes]:
    own = normal_bytes(text).split(b" ")
    own = [word for word in own if word]
    if not own:
        return set()
    return {b" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))}


def window_table(items: DataFrame, words: int = WORDS) -> DataFrame:
    """``window`` and the ids of the items that have it; ids as strings, null ids as an empty one."""

    def work(batches):
        for batch in batches:
            pairs = [
                (window, name or "")
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for window in item_windows(text, words)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())], ["window", "item"]
            )

    named = items.select(F.col("item_id").cast("string").alias("item"), "text")
    rows = named.mapInArrow(work, "window binary, item string")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def broadcast_windows(spark: SparkSession, items: DataFrame, words: int = WORDS) -> list:
    """The windows in chunks of bounded size, one broadcast each."""
    chunks, chunk = [], []
    for row in window_table(items, words).toLocalIterator():
        chunk.append((bytes(row["window"]), sorted(row["items"])))
        if len(chunk) == CHUNK:
            chunks.append(chunk)
            chunk = []
    return [spark.sparkContext.broadcast((uuid.uuid4().hex, part)) for part in [*chunks, chunk] if part]


def _automaton(chunk) -> ahocorasick.Automaton:
    """The automaton of a chunk; a worker keeps the latest one only."""
    name, windows = chunk.value
    built = worker_cache().setdefault("automaton", {})
    if built.get("name") != name:
        automaton = ahocorasick.Automaton()
        for window, items in windows:
            spaced = f" {window.decode('latin-1')} "
            automaton.add_word(spaced, (len(spaced), window.count(b" ") + 1, items))
        automaton.make_automaton()
        built.clear()
        built.update(name=name, automaton=automaton)
    return built["automaton"]


class Scanned:
    """A document's words and what occurs in them."""

    def __init__(self, text: str | None):
        self.normal = normal_bytes(text)
        words = [word for word in self.normal.split(b" ") if word]
        self.n_words = len(words)
        self.joined = f" {b' '.join(words).decode('latin-1')} "
        self.hits: list[tuple[int, int, list[str]]] = []

    def scan(self, automaton) -> None:
        found = [(end, size, count, items) for end, (size, count, items) in automaton.iter(self.joined)]
        if found:
            before = np.cumsum(np.frombuffer(self.joined.encode("latin-1"), np.uint8) == 0x20) - 1
            for end, size, count, items in found:
                first = int(before[end - size + 1])
                self.hits.append((first, first + count, items))

    def result(self) -> tuple[int, int, list[str], list[dict]]:
        """Words, words hit, items, and spans in code points of the original text."""
        if not self.hits:
            return self.n_words, 0, [], []
        covered = np.zeros(self.n_words + 1, np.int64)
        for first, end, _ in self.hits:
            covered[first] += 1
            covered[end] -= 1
        n_hit = int((np.cumsum(covered) > 0).sum())
        places = [match.span() for match in RUN.finditer(self.normal)]
        # continuation bytes of UTF-8 are no code points of their own
        points = np.cumsum((np.frombuffer(self.normal, np.uint8) & 0xC0) != 0x80)
        spans = []
        for first, end, items in sorted(self.hits):
            start, stop = places[first][0], places[end - 1][1]
            spans.append({"start": int(points[start]) - 1, "end": int(points[stop - 1]), "items": items})
        return self.n_words, n_hit, sorted({item for hit in self.hits for item in hit[2]}), spans


def scan_documents(docs: DataFrame, items: DataFrame, words: int = WORDS, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, items (ids as strings) and spans.

    A word inside any occurrence of a window is hit. Spans are code points of the original text.
    All columns of ``docs`` pass through; the four are named with ``prefix`` before, and columns of
    ``docs`` that have their names are replaced. Null and
    empty texts have no words and no hits, items without words no windows; without items nothing is
    hit. Very long texts are scanned whole. Repeated rows get equal results; an empty table gives an empty result.
    """
    chunks = broadcast_windows(docs.sparkSession, items, words)
    added = [StructField(prefix + field.name, field.dataType) for field in StructType.fromDDL(SCHEMA).fields]
    names = [field.name for field in added]
    docs = docs.drop(*names)

    def work(batches):
        for batch in batches:
            scanned = [Scanned(text) for text in batch.column("text").to_pylist()]
            for chunk in chunks:
                automaton = _automaton(chunk)
                for one in scanned:
                    one.scan(automaton)
            columns = list(zip(*(one.result() for one in scanned))) or [[], [], [], []]
            kinds = (
                pa.int64(), pa.int64(), pa.list_(pa.string()),
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("items", pa.list_(pa.string()))])),
            )
            found = [pa.array(list(column), kind) for column, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *names])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, *added]))


def contaminated(prefix: str = ""):
    """At least one word hit in twenty."""
    n_hit, n_words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep_clean(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    scanned = scan_documents(docs, items, words, prefix="_scan_")
    return scanned.where(~contaminated("_scan_")).select(*docs.columns)
