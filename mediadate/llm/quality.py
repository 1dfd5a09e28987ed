"""Quality rules with host verdicts, in DataFrame expressions only.

A document fails the base rule for good. Softer rules (symbols, repeated lines, word length) only
count against a document if its host is poor. A host's failure rate, over base and soft rules, is
shrunk by a beta prior whose mean and strength come from the rates of all hosts (moments of the
beta-binomial), so a host of a few documents is judged by what is usual, not by its few failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediadate.llm.common import WHITE, join_lookup, settle, word_list

SYMBOLS = "#*$%&|<>"
POOR_RATE = 0.5
LEAST_PRIOR = 5.0


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words that lie in 3-word windows found at least twice.

    ``hashes`` are the windows' 64-bit hashes in order. Sorted by hash, a repeated window has an
    equal neighbor; the positions found are sorted again and each adds its words up to the next.
    """
    count = F.size(hashes)
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs):
        hash_at = lambda j: F.get(pairs, j)["h"]
        alike = lambda j, k: F.coalesce(hash_at(j) == hash_at(k), F.lit(False))
        found = F.filter(F.sequence(F.lit(0), count - 1), lambda j: alike(j, j - 1) | alike(j, j + 1))
        return F.sort_array(F.transform(found, lambda j: F.get(pairs, j)["i"]))

    def covered(starts):
        steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    # transform over one element names a value, so that it is computed once
    named = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    repeats = F.size(F.array_distinct(hashes)) < count
    return F.when(repeats, named(ordered, lambda pairs: named(repeated(pairs), covered))).otherwise(0).cast("long")


def measure_documents(docs: DataFrame, host: str = "source", carry: bool = False) -> DataFrame:
    """Counts per document: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Null texts have no words, characters or lines; null hosts are one host. Rows are independent.
    With ``carry`` the row itself comes along as ``_row``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: _length_without(line, WHITE) > 0)
    row = [F.struct(*(docs[name] for name in docs.columns)).alias("_row")] if carry else []
    base = docs.select("doc_id", *row, F.col(host).alias("host"), text.alias("text"), word_list(text).alias("words"), lines.alias("lines"))
    windows = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("hashes", windows)
    as_long = lambda value, name: value.cast("long").alias(name)
    return base.select(
        "doc_id",
        *(["_row"] if carry else []),
        "host",
        as_long(F.size("words"), "n_words"),
        as_long(_length_without(F.col("text"), WHITE), "word_chars"),
        as_long(F.length("text") - _length_without(F.col("text"), SYMBOLS), "n_symbols"),
        as_long(F.size("lines"), "n_lines"),
        as_long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    """More than one symbol in three words, three repeated lines in ten, or words of odd length."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return (
        (3 * F.col("n_symbols") > words)
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
        | (chars < 2 * words)
        | (chars > 15 * words)
    )


def host_verdicts(measured: DataFrame, poor_rate: float = POOR_RATE) -> DataFrame:
    """Per host: documents, failed, the shrunk rate and whether the host is poor.

    Prior by moments: with mean m over all documents and the variance between hosts beyond what
    chance explains, v, the prior counts as m(1-m)/v - 1 documents. The driver gets one row of sums.
    """
    hosts = settle(
        measured.groupBy("host_key").agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"),
        )
    )
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("documents").alias("documents"),
        F.sum("failed").alias("failed"),
        F.sum(F.col("failed") * F.col("failed") / F.col("documents")).alias("rates"),
        F.sum(F.col("documents").cast("double") * F.col("documents")).alias("squares"),
    ).first()
    mean, strength = beta_prior(sums["hosts"], sums["documents"] or 0, sums["failed"] or 0, sums["rates"] or 0.0, sums["squares"] or 0.0)
    rate = (F.col("failed") + mean * strength) / (F.col("documents") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_poor", rate > poor_rate)


def beta_prior(hosts: int, documents: int, failed: int, rates: float, squares: float) -> tuple[float, float]:
    """Mean and strength of the prior over host rates; it counts as 5 to 1,000,000 documents."""
    if not documents:
        return 0.0, LEAST_PRIOR
    mean = failed / documents
    spread = mean * (1 - mean)
    scale = documents - squares / documents
    if hosts < 2 or spread == 0 or scale <= 0:
        return mean, 1e6 if hosts > 1 else LEAST_PRIOR
    between = (rates - documents * mean * mean - (hosts - 1) * spread) / scale
    return mean, max(LEAST_PRIOR, min(1e6, spread / between - 1 if between > 0 else 1e6))


def judge_documents(docs: DataFrame, host: str = "source", poor_rate: float = POOR_RATE, carry: bool = False) -> DataFrame:
    """Counts, verdicts and host rates per row of ``docs``: ``kept`` is the verdict.

    Kept is a document that passes the base rule and, if its host is poor, the soft rules, too.
    The expensive counts are written once as a narrow table; hosts are counted with partial sums
    and joined back by broadcast or, beyond 100,000 hosts, with salted keys. Repeated rows get the
    same verdict each; very long texts are measured whole; an empty table gives an empty result.
    """
    measured = measure_documents(docs, host, carry)
    key = F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit(""))
    judged = measured.withColumn("host_key", key).withColumn("base_failed", base_failed())
    judged = settle(judged.withColumn("soft_failed", soft_failed()))
    joined = join_lookup(judged, host_verdicts(judged, poor_rate), ["host_key"], "doc_id")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_poor") & F.col("soft_failed"))).drop("host_key")


def keep_good(docs: DataFrame, host: str = "source", poor_rate: float = POOR_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are written along with their counts, once, so that texts need no shuffle to meet verdicts.
    """
    return judge_documents(docs, host, poor_rate, carry=True).where("kept").select("_row.*")
