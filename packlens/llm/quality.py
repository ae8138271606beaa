"""Quality rules: statistics of a text, and lines that too many documents of a host share.

Only DataFrame functions; every statistic of a text stays in the row, so the scan is read without a shuffle of texts.
Cross-document line frequency: each document emits the hashes of its normalised lines; distinct documents are
counted per host and line, first by (host, line, document) and then by (host, line), so that a line which a
third of all rows carry is counted in parts. Lines above the limits are taken out of their documents, and documents
left with too little are rejected.

Defined results: a document is told by doc_id and text, so rows that repeat count once and copies under other ids count each; a null
text counts as an empty one, a null source is a host of its own, rows that repeat are judged alike, an empty table gives an empty table, further columns pass through (names
starting with ``_q_`` are reserved); columns named as a result of ``judge`` (``RESULTS``) are replaced by it, while ``clean`` hands them on as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stash, whole_text

WORD = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]+"


#: The columns that ``judge`` adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "n_words_removed", "kept")


@dataclass(frozen=True)
class Limits:
    """A line is above the limits if at least ``min_docs`` distinct documents of a host have it, and more than ``percent`` % of them."""

    min_docs: int = 20
    percent: int = 8
    #: Documents are depleted with fewer words than this, or if more than this share of their word characters went.
    min_words: int = 20
    max_removed_percent: int = 60


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed (boolean)."""
    text, n = whole_text(), F.size("_q_words")
    # one hash for each window of words, in order of place
    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice("_q_words", i, window)))
    df = docs.withColumn("_q_words", words_of(text)).withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "_q_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
            "_q_hashes": F.when(n >= window, hashes).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # few texts repeat a window; only these sort them: equal hashes then are neighbours
    repeated = F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes")
    pairs = F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_q_order", F.when(repeated, F.array_sort(pairs)))
    near = lambda x, k: F.coalesce(F.get("_q_order", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_q_order", lambda x, k: near(x, k - 1) | near(x, k + 1))
    df = df.withColumn("_q_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.transform(
        "_q_starts", lambda i, k: F.least(F.lit(window), F.coalesce(F.get("_q_starts", k + 1) - i, F.lit(window)))
    )
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    made = {
        "n_words": F.col("n_words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": n_repeat,
    }
    # a generator of one row: a later filter on the statistics stays above it, so nothing is computed anew for each element
    row = F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items()))))
    kept = [F.col(c) for c in docs.columns if c not in made]
    df = df.select(*kept, row.alias("_q_made")).select(*kept, "_q_made.*")
    return df.withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


def normal_line(line: Column) -> Column:
    """A line for counting: lower case A-Z, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SPACE, " "))


def _document() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), whole_text())


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: host, document, text and line hashes, place and the line itself."""
    text = whole_text()
    out = docs.select(
        F.col("source").alias("_q_host"), _document().alias("_q_doc"), F.xxhash64(text).alias("_q_text"), F.posexplode(F.split(text, "\n", -1))
    ).where(F.col("col").rlike(WORD))
    return out.select(
        "_q_host", "_q_doc", "_q_text", F.col("pos").alias("_q_pos"), F.xxhash64(normal_line(F.col("col"))).alias("_q_line"), "col"
    )


def frequent_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(_q_host, _q_line, n_docs) of the lines above the limits."""
    often = (
        _lines(docs)
        .groupBy("_q_host", "_q_line")
        .agg(F.count_distinct("_q_doc").alias("n_docs"))
        .where(F.col("n_docs") >= limits.min_docs)
    )
    hosts = docs.groupBy(F.col("source").alias("_q_host2")).agg(F.count_distinct(_document()).alias("_q_of"))
    above = F.col("_q_host").eqNullSafe(F.col("_q_host2")) & (100 * F.col("n_docs") > limits.percent * F.col("_q_of"))
    return often.join(hosts, above).select("_q_host", "_q_line", "n_docs")


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds the statistics, n_lines_removed, n_words_removed (long), kept (boolean) and _q_gone, the hashes of the
    lines to remove (null if none). The text moves only if the frequent lines' matches exceed the broadcast bound and
    a later step asks for it.
    """
    docs = docs.drop(*RESULTS)
    frequent = small(stash(frequent_lines(docs, limits).select("_q_host", "_q_line"), "lines"))
    frequent = frequent.withColumnsRenamed({"_q_host": "_q_host2", "_q_line": "_q_line2"})
    match = F.col("_q_host").eqNullSafe(F.col("_q_host2")) & (F.col("_q_line") == F.col("_q_line2"))
    hits = (
        _lines(docs)
        .join(frequent, match)
        .select("_q_host", "_q_text", "_q_pos", "_q_line", F.size(words_of(F.col("col"))).alias("_q_n"))
        .distinct()  # copies of a text within a host count once
        .groupBy("_q_host", "_q_text")
        .agg(
            F.count("*").alias("n_lines_removed"),
            F.sum("_q_n").alias("n_words_removed"),
            F.collect_set("_q_line").alias("_q_gone"),
        )
    )
    hits = small(stash(hits, "hits")).withColumnsRenamed({"_q_host": "_q_host2", "_q_text": "_q_text2"})
    df = with_statistics(docs).withColumn("_q_text", F.xxhash64(whole_text()))
    same = F.col("source").eqNullSafe(F.col("_q_host2")) & (F.col("_q_text") == F.col("_q_text2"))
    left = F.col("n_words") - F.col("n_words_removed")
    depleted = (left < limits.min_words) | (100 * F.col("n_words_removed") > limits.max_removed_percent * F.col("n_words"))
    return (
        df.join(hits, same, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_lines_removed", "n_words_removed")})
        .withColumn("kept", ~F.col("base_failed") & ~((F.col("n_words_removed") > 0) & depleted))
        .drop("_q_host2", "_q_text2", "_q_text")
    )


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept documents, with the columns of ``docs``: frequent lines are taken out of the text, n_chars follows."""
    lines = F.filter(
        F.split("text", "\n", -1), lambda x: ~F.array_contains("_q_gone", F.xxhash64(normal_line(x))) | ~x.rlike(WORD)
    )
    # columns that share a result's name wait under another one
    own = {c: f"_q_own_{c}" for c in docs.columns if c.lower() in RESULTS}
    df = judge(docs.withColumnsRenamed(own), limits).where("kept").drop(*RESULTS).withColumnsRenamed({v: c for c, v in own.items()}).withColumn(
        "text", F.when(F.col("_q_gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    )
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(docs.columns)
