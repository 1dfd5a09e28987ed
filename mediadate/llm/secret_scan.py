"""Secret scans with multipart credential linking, in DataFrame expressions only.

Base kinds are found in every text. Weak candidates (a bare key-like string, a user or client name,
the address of a service) prove nothing alone: identifiers and secrets are reported if one of the
other class lies within ``REACH`` characters, addresses if a linked pair does. The parts are
intervals of code points and meet in an interval join: cells of a grid of ``REACH`` characters,
then the distance itself. It is a semi-join, so that no pairs come out, however dense a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import settle

# Fixed patterns of the base kinds; ASCII letters of the names in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak candidates: a name given by assignment; a run of 16 or more with a digit and a letter; a URI.
KEY_RUN = "[A-Za-z0-9+/_=-]"
IDENTIFIER = r"""(?i:client_?id|user_?name|user|login|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
SECRET = rf"(?<!{KEY_RUN})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){KEY_RUN}{{16,}}+"
ENDPOINT = r"""(?i:https?|ftp|ssh|amqp|redis|mysql|postgres(?:ql)?|mongodb)://[^\x20\x09-\x0D"'<>]+"""

KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
REACH = 200
CHUNK = 256


def _once(value: Column, use) -> Column:
    """Name a value inside an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, kind: int, kept=None) -> Column:
    """Places of a pattern's matches: array of (start, kind, end), in code points, end exclusive.

    The pieces between matches and the matches alternate, so their lengths add up to the places.
    They are added in chunks, so that the cost is linear in the number of matches.
    """
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    wanted = kept(text) if kept else F.transform(hits, lambda _: F.lit(True))

    def placed(parts):
        def step(state, chunk):
            inner = F.aggregate(
                chunk, F.struct(state["at"].alias("at"), F.array().cast(SPANS).alias("spans")),
                lambda s, p: F.struct(
                    (s["at"] + p["gap"] + p["hit"]).alias("at"),
                    F.when(p["wanted"], F.array_append(s["spans"], F.struct((s["at"] + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (s["at"] + p["gap"] + p["hit"]).alias("end")))).otherwise(s["spans"]).alias("spans"),
                ),
            )
            return _once(inner, lambda one: F.struct(one["at"].alias("at"), F.array_append(state["lists"], one["spans"]).alias("lists")))

        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(CHUNK)), lambda k: F.slice(parts, k, CHUNK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("lists"))
        return F.aggregate(chunks, start, step, lambda state: F.flatten(state["lists"]))

    parts = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), wanted.alias("wanted")),
        lambda p: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), p["wanted"].alias("wanted")),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), _once(parts, placed)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, key (one per distinct row) and the spans of base kinds and of weak candidates."""
    text = F.col("text")
    none = F.array().cast(SPANS)
    long_value = lambda t: F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.hex(F.xxhash64("text"))).alias("key"),
        matches(text, ASSIGN, 0, long_value).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, 1)).otherwise(none).alias("access"),
        matches(text, HEX, 2).alias("hex"),
        matches(text, IDENTIFIER, 3).alias("identifier"),
        matches(text, SECRET, 4).alias("secret"),
        F.when(F.contains(text, F.lit("://")), matches(text, ENDPOINT, 5)).otherwise(none).alias("endpoint"),
    )
    base = F.concat("assign", "access", "hex")
    apart = lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    weak = F.filter(F.concat("identifier", "secret", "endpoint"), apart)
    return rows.select("doc_id", "key", "assign", "access", "hex", weak.alias("weak"))


def _near(parts: DataFrame, others: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The parts that have one of the others, equal in ``keys``, within ``reach`` characters."""
    cells = lambda start, end: F.explode(F.sequence(F.floor(start / reach), F.floor(end / reach)))
    left = parts.withColumn("cell", cells(F.col("start") - reach, F.col("end") + reach))
    right = others.select(*keys, F.col("start").alias("_start"), F.col("end").alias("_end"))
    right = right.withColumn("cell", cells(F.col("_start"), F.col("_end") - 1))
    conditions = [left[k] == right[k] for k in [*keys, "cell"]]
    conditions += [right["_start"] < left["end"] + reach, right["_end"] > left["start"] - reach]
    return left.join(right, conditions, "left_semi").drop("cell").distinct()


def link_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``key`` and the weak spans that complementary parts confirm.

    Only texts with a weak candidate take part.
    """
    spans = F.concat("assign", "access", "hex", "weak")
    rows = found.where(F.size("weak") > 0).select("key", F.explode(spans).alias("span")).select("key", "span.*")
    side = F.when(F.col("kind").isin(1, 3), "identifier").when(F.col("kind") == 5, "endpoint").otherwise("secret")
    parts = settle(rows.distinct().withColumn("side", side))
    pair = parts.where("side <> 'endpoint'")
    other = F.when(F.col("side") == "secret", "identifier").otherwise("secret")
    linked = settle(_near(pair, pair.withColumn("side", other), ["key", "side"], reach))
    endpoints = _near(parts.where("side = 'endpoint'"), linked, ["key"], reach)
    weak = linked.where(F.col("kind") >= 3).unionByName(endpoints)
    return weak.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def describe(spans: Column) -> Column:
    """kind:start:end of every span, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.concat_ws(",", text)


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row: doc_id, the base spans by kind (assign, access, hex) and the ``linked`` weak spans.

    A null text is empty; a very long one is searched whole. Rows that repeat doc_id and text get the same result each. Weak candidates
    that overlap a base span are part of it and not listed again. An empty table gives an empty
    result. Other columns are not read.
    """
    found = settle(find_parts(docs))
    linked = link_parts(found, reach)
    none = F.array().cast(SPANS)
    joined = found.join(settle(linked), "key", "left")
    return joined.select("doc_id", "assign", "access", "hex", F.coalesce("linked", none).alias("linked"))
