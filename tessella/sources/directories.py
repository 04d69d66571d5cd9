"""Directory listings as RDF text: reading entries and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _ABOUT = "<DirectoryEntry>", "</DirectoryEntry>", ' rdf:about="'


def _last_name(entry: Column) -> Column:
    """What stands between the last name tags; empty without any."""
    return F.when(entry.contains("<name>"), F.substring_index(F.substring_index(entry, "<name>", -1), "</name>", 1)).otherwise("")


def parse(listings: DataFrame, strict: bool = False) -> DataFrame:
    """dir_uri, pos, name, target_uri, target_class from (dir_uri, rdf).

    An entry of a class other than Blob and Directory has a null target_uri, or
    raises an error if ``strict``.
    """
    pieces = F.split("rdf", _OPEN)
    closed = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: x.contains(_CLOSE))
    entries = listings.select("dir_uri", F.posexplode(closed).alias("pos", "piece")).select("dir_uri", "pos", F.substring_index("piece", _CLOSE, 1).alias("entry"))
    # the last name and the last target of an entry count
    parts = F.split("entry", _ABOUT)
    kind = F.when(F.size(parts) > 1, F.substring_index(F.element_at(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), -1), "<", -1)).otherwise("")
    target = F.substring_index(F.element_at(parts, -1), '"', 1)
    known = kind.isin("Blob", "Directory")
    unknown = F.raise_error(F.concat(F.lit("unknown class of entry: "), kind)).cast("string") if strict else F.lit(None).cast("string")
    return entries.select(
        "dir_uri", "pos", _last_name(F.col("entry")).alias("name"), F.when(known, target).otherwise(unknown).alias("target_uri"), kind.alias("target_class")
    )


def entry_text(name: Column, target_uri: Column, target_class: Column) -> Column:
    return F.concat(
        F.lit("<DirectoryEntry><name>"), name, F.lit("</name><target><"), target_class, F.lit(' rdf:about="'), target_uri, F.lit('"/></target></DirectoryEntry>')
    )


def build(entries: DataFrame) -> DataFrame:
    """(dir_uri, rdf) from dir_uri, pos, name, target_uri, target_class."""
    text = entry_text(F.col("name"), F.col("target_uri"), F.col("target_class"))
    rows = entries.groupBy("dir_uri").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["t"]), "\n")
    return rows.select("dir_uri", F.concat(F.lit("<RDF><Directory><entries>\n"), body, F.lit("\n</entries></Directory></RDF>\n")).alias("rdf"))
