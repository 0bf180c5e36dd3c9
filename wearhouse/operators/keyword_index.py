"""Q4 through an inverted index: trigram postings instead of a scan of every item.

The keyword search compares a pattern with five text fields of every item.  The
index answers it from three tables, all derived from the snapshot's own:

* ``terms``: every distinct folded value of a field, with an id;
* ``grams``: (gram, term_id) for all runs of one, two and three characters of a
  term, laid out by gram, so that a lookup reads only its grams' row groups;
* ``postings``: (term_id, item_id), laid out by term.

A pattern is cut at its wildcards into literal runs.  Every term that can match
holds all grams of all runs; the posting lists of these grams are intersected
(a count per term), the pattern itself is then checked on the surviving terms,
and their postings give the items.  Those few items go through the search of
:mod:`wearhouse.operators.catalog`, so the rows and the values shown are the same.
Only the index is read in front of that semi join: no item, tag, category or
color is compared with the pattern unless its term survived.

An index is kept up with a change by dropping the postings of the changed items
and adding their new ones (``updated``); terms without postings stay and do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.functions.columns import like_contains
from wearhouse.operators import catalog
from wearhouse.plans.session import materialize
from wearhouse.sources.tables import Tables

#: Longest gram; shorter runs of a pattern look up grams of their own length.
GRAM = 3

# The text fields of the search: (table, column).
FIELDS = (("w_item", "item_name"), ("w_item", "size"), ("w_tag", "tag"), ("w_cat", "category"), ("w_color", "color"))


@dataclass(frozen=True)
class KeywordIndex:
    """The index tables: terms (term_id, term), grams (gram, term_id), postings
    (term_id, item_id)."""

    terms: DataFrame
    grams: DataFrame
    postings: DataFrame


def _texts(t: Tables) -> DataFrame:
    """(item_id, term): the folded values of all fields, NULL and '' left out
    (a pattern that matches '' is not looked up)."""
    parts = [t.get(table).select("item_id", F.lower(F.col(column)).alias("term")) for table, column in FIELDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("term") != "").distinct()


def _grams(term: Column, size: int) -> Column:
    """All runs of ``size`` characters of ``term``, as an array."""
    return F.when(F.length(term) >= size, F.transform(F.sequence(F.lit(1), F.length(term) - (size - 1)), lambda i: F.substring(term, i, F.lit(size))))


def _by_gram(terms: DataFrame) -> DataFrame:
    every = F.array_distinct(F.concat(*[F.coalesce(_grams(F.col("term"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]))
    return terms.select(F.explode(every).alias("gram"), "term_id")


def _term_id(term: Column) -> Column:
    """128 bits of the term's digest: a term has the same id in every build, so
    parts of an index built at different times fit together."""
    return F.substring(F.sha2(term, 256), 1, 32)


def build_index(t: Tables) -> KeywordIndex:
    """The index of all items, as lazy frames (see ``write_index``)."""
    texts = _texts(t).select("item_id", "term", _term_id(F.col("term")).alias("term_id"))
    terms = texts.select("term_id", "term").distinct()
    return KeywordIndex(terms, _by_gram(terms), texts.select("term_id", "item_id"))


_LAYOUT = {"terms": "term_id", "grams": "gram", "postings": "term_id"}


def _laid_out(df: DataFrame, key: str) -> DataFrame:
    """Ranges of the key, sorted, so that a Parquet row group spans few keys.  A
    frequent gram's list is a run of whole row groups, over several files if a
    second column splits it."""
    order = [key] + [c for c in df.columns if c != key and c != "term"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def stored(index: KeywordIndex) -> KeywordIndex:
    """The index written once into the shared checkpoint folder and read back."""
    return KeywordIndex(**{n: materialize(_laid_out(getattr(index, n), key)) for n, key in _LAYOUT.items()})


def write_index(index: KeywordIndex, root: str) -> None:
    """Writes the index under ``root``, which must not hold one yet."""
    for n, key in _LAYOUT.items():
        _laid_out(getattr(index, n), key).write.mode("errorifexists").parquet(f"{root}/{n}")


def read_index(spark: SparkSession, root: str) -> KeywordIndex:
    return KeywordIndex(**{n: spark.read.parquet(f"{root}/{n}") for n in _LAYOUT})


def updated(index: KeywordIndex, t: Tables, changed: DataFrame) -> KeywordIndex:
    """The index after the items in ``changed`` (item_id) were added, changed or
    deleted; ``t`` holds the tables as they are now.  Only the changed items'
    values are read from them."""
    keys = changed.select("item_id").distinct()
    fresh = build_index(t.only_items(keys))
    new = fresh.terms.join(index.terms.select("term_id"), "term_id", "left_anti")
    return replace(
        index,
        terms=index.terms.unionByName(new),
        grams=index.grams.unionByName(_by_gram(new)),
        postings=index.postings.join(keys, "item_id", "left_anti").select("term_id", "item_id").unionByName(fresh.postings),
    )


def pattern_grams(q: str) -> list[str]:
    """The grams that every text matching ``q`` holds: of each literal run
    between wildcards all its ``GRAM``-character runs, or the run itself where
    it is shorter."""
    out: dict[str, None] = {}
    for run in re.split("[%_]", q.lower()):
        if run:
            size = min(GRAM, len(run))
            out.update((run[i : i + size], None) for i in range(len(run) - size + 1))
    return list(out)


def matching_terms(index: KeywordIndex, q: str) -> DataFrame:
    """(term_id): the terms that match ``q``.  A pattern without any literal
    character is checked on all terms (never on the items)."""
    terms, grams = index.terms, pattern_grams(q)
    if grams:
        lists = index.grams.where(F.col("gram").isin(*grams))
        if len(grams) > 1:
            lists = lists.groupBy("term_id").agg(F.count("gram").alias("_n")).where(F.col("_n") == len(grams))
        terms = terms.join(lists.select("term_id"), "term_id", "left_semi")
    return terms.where(like_contains("term", q)).select("term_id")


def matching_items(index: KeywordIndex, q: str) -> DataFrame:
    """(item_id): the items some field of which matches ``q``, each once."""
    return index.postings.join(matching_terms(index, q), "term_id", "left_semi").select("item_id").distinct()


def search_indexed(t: Tables, index: KeywordIndex, q: str, **filters) -> DataFrame:
    """Q4 with keyword ``q``: the rows of ``catalog.search(t, q=q, **filters)``.

    Blank keywords, and keywords of '%' alone, match every item and are not
    looked up.  A missing size or list counts as '' in the search; as no other
    pattern matches '', the index need not hold it.
    """
    q = "" if q is None else str(q).strip()
    if q.strip("%"):
        t = t.only_items(matching_items(index, q))
    return catalog.search(t, q=q, **filters)
