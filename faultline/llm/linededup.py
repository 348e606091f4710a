"""Line dedup: lines that several documents hold stay in one of them.

Texts are split at line feeds. A line's key is the line without the blanks 0x20 and 0x09-0x0D at both ends and with A-Z in
lower case; a key is known by two independent 64-bit hashes of it. Keys and the documents that hold them are counted as
narrow rows (hashes, doc_id): a distinct count first deals them by key and document and then sums up, so a line that a third
of all documents hold is no group of its own anywhere. Found keys meet the lines again by equality. The COMMON keys that most
documents hold are broadcast, which is a fixed number of rows and leaves no key with more than 1/COMMON of all lines for the
join by key. What comes out are places of lines to drop per text, and a text is put together again from the others in order.

All of it is DataFrame functions; lines themselves are never moved, only their hashes and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import stored

LEAST_CHARS, LEAST_DOCS = 10, 2
#: Keys that are broadcast: those found in most documents.
COMMON = 4096
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and the empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case (lower() is right for ASCII alone)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """rec (the whole row), doc, body, and ra and rb, which name the row: equal rows share them, and their fate."""
    q = lambda c: F.col(f"`{c}`")
    return docs.select(
        F.struct(*[q(c) for c in docs.columns]).alias("rec"), q(doc).alias("doc"), q(text).alias("body"),
        F.xxhash64(q(doc), q(text)).alias("ra"), F.xxhash64(F.lit(1), q(text), q(doc)).alias("rb"),
    )


def places(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """ra, rb, doc, at (from 0), ka, kb of every line of `rows` whose key has `least_chars` code points or more."""
    line = rows.select("ra", "rb", "doc", F.posexplode(F.transform(lines_of(F.col("body")), key_of)).alias("at", "key"))
    return line.where(F.char_length("key") >= least_chars).select("ra", "rb", "doc", "at", F.xxhash64("key").alias("ka"), F.xxhash64(F.lit(1), "key").alias("kb"))


def shared_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """ka, kb, n (documents), first (the smallest doc) of the keys that `least_docs` documents or more hold.

    A document is its doc; rows without one are one document, which comes after all others.
    """
    doc = F.struct(F.col("doc").isNull().alias("none"), "doc")
    found = lines.select("ka", "kb", doc.alias("d")).groupBy("ka", "kb").agg(F.count_distinct("d").alias("n"), F.min("d").alias("low"))
    return found.where(F.col("n") >= least_docs).select("ka", "kb", "n", F.col("low.doc").alias("first"))


def dropped(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """ra, rb and gone (places of lines to drop) of the texts that lose a line."""
    lines = places(rows, least_chars)
    keys = stored(shared_keys(lines, least_docs), "line-keys")
    common = keys.orderBy(F.desc("n"), "ka", "kb").limit(COMMON)
    # the rarer keys meet their lines by a shuffle in which no key is larger than 1/COMMON of it
    common = stored(common, "line-common")
    rarer = keys.join(F.broadcast(common.select("ka", "kb")), ["ka", "kb"], "left_anti")
    meet = lambda side, k: side.join(k.select("ka", "kb", "first"), ["ka", "kb"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    hit = meet(lines, F.broadcast(common)).unionByName(meet(lines.join(F.broadcast(common.select("ka", "kb")), ["ka", "kb"], "left_anti"), rarer))
    return hit.groupBy("ra", "rb").agg(F.collect_set("at").alias("gone"))


def _kept(docs: DataFrame, doc: str, text: str, least_chars: int, least_docs: int) -> DataFrame:
    """rec, doc, body, n_lines, n_dropped of every row, body without the dropped lines."""
    rows = _rows(docs, doc, text)
    gone = dropped(rows, least_chars, least_docs)
    whole = rows.join(gone, ["ra", "rb"], "left").withColumn("parts", lines_of(F.col("body")))
    n, lost = F.size("parts"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))  # of integers: by hash, in order
    body = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("parts"), i)), "\n"))
    return whole.select("rec", "doc", body.alias("body"), n.cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped"))


def without_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of `docs`, `text` without the lines that another document holds first.

    Keys of `least_chars` code points or more that `least_docs` documents or more hold stay only in the smallest `doc`, there
    in all places. Other lines stay as they are. A null text stays null. Rows that share a `doc` are one document, rows without one
    are together one that comes last. Other columns may have any names and are handed on.
    """
    kept = _kept(docs, doc, text, least_chars, least_docs)
    return kept.select(*[F.col("body").alias(c) if c == text else F.col(f"rec.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of `docs` (doc_id, text)."""
    kept = _kept(docs.select("doc_id", "text"), "doc_id", "text", LEAST_CHARS, LEAST_DOCS)
    return kept.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("body", F.lit("")), 256).alias("kept_sha256"))
