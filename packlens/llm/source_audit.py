"""Source divergence audit: how far the terms of a source are from those of other sources, and of all, of its language.

In-mapper stripes: each task folds whole documents into hash stripes, term to (document frequency, occurrences by source), one table for each
language, and spills them when they have ``ENTRIES`` entries. Spilled entries meet by (language, term, source) in partial aggregates and then
by (language, term); the merged stripes that reach the least document frequency are written once. All divergences come from them: terms
straight from the entries of a stripe, pairs from the pairs of entries in a stripe, combined map-side by pair of sources, so that no list of a
source's terms or of a term's documents is ever gathered.

Most terms are in few of many sources. A pair's value is therefore split, exactly: what a pair would have if no term occurred (once for all
terms); what changes where one of both has a term (by numbers of occurrences: a source has few different ones); and what changes
where both have it (from the stripe).

Shares are counted in billionths as integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) with N occurrences of V kept terms, and two shares
diverge by floor((p - q)^2 / (p + q)).

Defined results: a null text, language or source is an empty one; every row is a document, also one that repeats; a term's letters are lower-cased A-Z only and
characters beyond ASCII are letters; a language without kept terms gives pairs of value 0 and no terms; an empty table gives
an empty table; further columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stash, whole_text

#: Entries (term and source) that a task holds at most before it spills them; bytes of a text folded at once.
ENTRIES, PART = 400_000, 4_000_000
UNIT = 1_000_000_000
#: Counts below this keep a share's arithmetic within 64 bits; larger ones go by decimals.
PLAIN = 9_000_000_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Audit:
    """Terms in at least ``min_docs`` documents of a language are kept; each group shows its ``top`` terms."""

    min_docs: int = 10
    top: int = 10


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, part by part."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    start = 0
    while start < len(raw):
        end = len(raw) if start + PART >= len(raw) else raw.find(b" ", start + PART)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


class _Stripes:
    """Stripes of one task: for each language term to document frequency, and (language, source) to the term's occurrences."""

    def __init__(self) -> None:
        self.frequency: dict[str, Counter] = {}
        self.sources: dict[tuple[str, str], Counter] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: str) -> None:
        counts = Counter()
        for terms in terms_of(text):
            counts.update(terms)
        stripe = self.sources.setdefault((lang, source), Counter())
        before = len(stripe)
        stripe.update(counts)
        self.entries += len(stripe) - before
        self.frequency.setdefault(lang, Counter()).update(counts.keys())

    def spill(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n); the document frequencies have a null source, and each group a row with a null term."""
        for (lang, source), stripe in [*self.sources.items(), *(((lang, None), f) for lang, f in self.frequency.items())]:
            terms = list(stripe)
            for at in range(0, len(terms), 65_536):
                part = terms[at : at + 65_536]
                yield _rows(lang, source, pa.array(part, pa.binary()).cast(pa.string()), pa.array([stripe[t] for t in part], pa.int64()))
            if source is not None:
                yield _rows(lang, source, pa.nulls(1, pa.string()), pa.array([0], pa.int64()))
        self.__init__()


def _rows(lang: str, source: str | None, terms: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    same = lambda v: pa.array([v] * len(terms), pa.string()) if v is None else pa.repeat(pa.scalar(v, pa.string()), len(terms))
    return pa.RecordBatch.from_arrays([same(lang), same(source), terms, counts], ["lang", "source", "term", "n"])


def folded(docs: DataFrame) -> DataFrame:
    """The spilled entries of all tasks (lang, source, term, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = _Stripes()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                stripes.add(lang, source, text)
                if stripes.entries >= ENTRIES:
                    yield from stripes.spill()
        yield from stripes.spill()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), whole_text().alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n bigint")


def merged(entries: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """(lang, term, n, stripe): the kept terms with their occurrences, and these by source; rows with a null term have the sources of a language."""
    summed = entries.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    entry = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    stripes = summed.groupBy("lang", "term").agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("df"), F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).alias("n"), F.collect_list(entry).alias("stripe")
    )
    return stripes.where((F.col("df") >= audit.min_docs) | F.col("term").isNull()).select("lang", "term", "n", "stripe")


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term with ``count`` occurrences among ``total`` of ``kept`` terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    large = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(count + 2), whole(total + 2 * kept))
    plain = F.call_function("div", F.lit(UNIT) * (count + 2), total + 2 * kept)
    return 1 + F.when(count < PLAIN, plain).otherwise(large)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def groups_of(stripes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, total, zero) of every group, and (lang, kept, total) of every language; ``zero`` is the share of a term that doesn't occur."""
    langs = stripes.groupBy("lang").agg(F.count("term").alias("kept"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))), F.lit(0)).alias("total"))
    langs = stash(langs, "languages")
    each = stripes.select("lang", F.col("term").isNotNull().cast("long").alias("_t"), F.explode("stripe").alias("e"))
    totals = each.groupBy("lang", "e.source").agg(F.sum(F.col("_t") * F.col("e.n")).alias("total"))
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)
    joined = totals.join(small(langs.select("lang", "kept")), "lang")
    return stash(joined.select("lang", "source", "total", "kept", zero.alias("zero")), "groups"), langs


def entries_of(stripes: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, n, source, count, p, zero): an entry of each kept stripe with its share."""
    rows = stripes.where("term is not null").select("lang", "term", "n", F.explode("stripe").alias("e")).select("lang", "term", "n", "e.source", F.col("e.n").alias("count"))
    known = rows.join(small(groups), ["lang", "source"])
    return known.select("lang", "term", "n", "source", "count", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), "zero")


def term_part(entries: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """The terms that a source has more of than its language, with the largest divergences."""
    rows = entries.join(small(langs), "lang").withColumn("q", share(F.col("n"), F.col("total"), F.col("kept"))).where("p > q")
    made = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(made, top)


def pair_part(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The other sources of the language, by their divergence over all kept terms."""
    f = divergence
    x, y = (lambda n: F.col(f"x.{n}")), (lambda n: F.col(f"y.{n}"))
    # both have the term: from the stripe, each pair once
    entry = F.struct("source", "p", "zero")
    stripes = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    first = stripes.select("lang", "s", F.posexplode("s").alias("at", "x"))
    both = first.select("lang", "x", F.explode(F.expr("slice(s, at + 2, size(s))")).alias("y"))
    change = f(x("p"), y("p")) - f(x("p"), y("zero")) - f(x("zero"), y("p")) + f(x("zero"), y("zero"))
    both = both.groupBy("lang", x("source").alias("a"), y("source").alias("b")).agg(F.sum(change).alias("value"))
    # one of both has it: by numbers of occurrences
    numbers = entries.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("source").alias("_b"), F.col("zero").alias("_z"))
    one = numbers.join(other, "lang").where("source <> _b")
    change = F.col("terms") * (f(F.col("p"), F.col("_z")) - f(F.col("zero"), F.col("_z")))
    one = one.groupBy("lang", F.least("source", "_b").alias("a"), F.greatest("source", "_b").alias("b")).agg(F.sum(change).alias("value"))
    # neither has it: the same for all kept terms
    left = groups.select("lang", "kept", F.col("source").alias("a"), F.col("zero").alias("_z"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("_y"))
    base = left.join(right, "lang").where("a < b").select("lang", "a", "b", (F.col("kept") * f(F.col("_z"), F.col("_y"))).alias("value"))
    whole = base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    either = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(whole.select("lang", "value", either.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value"))


def audit(docs: DataFrame, settings: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language, part ``term`` a source's own terms."""
    stripes = stash(merged(folded(docs), settings), "stripes")
    groups, langs = groups_of(stripes)
    entries = stash(entries_of(stripes, groups), "entries")
    return pair_part(entries, groups).unionByName(term_part(entries, langs, settings.top)).select("lang", "source", "part", "item", "value", "rank")
