"""Lines that many documents share, dropped from all but one.

Normalised lines are exploded with their positions and hashed to 128 bits, the
distinct documents of each hash are counted, and what lies over the threshold is
dropped by position. Only hashes and positions are shuffled to count; a text moves
once, to meet the positions it loses. Counting is two aggregates with map-side
partials, (hash, document) and then hash, so a line that a third of all documents
hold is neither gathered in one task nor paired. Everything is native Spark.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide import scratch

BLANKS = " \t\n\x0b\x0c\r"
#: Code points of a key and documents holding it from which its lines are dropped.
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # there the fast lower() does the same
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hashes(value: Column) -> list[Column]:
    """Two independent 64-bit hashes: the second starts from another seed."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def drop_shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``df``: ``id, text`` (its kept lines joined by newlines), ``n_lines, n_dropped``.

    A null or empty text is one empty line, which is too short to be dropped; a text
    that loses all its lines is empty. Rows with equal ids are one document: they
    count once and all or none of them keep a line. Rows without an id count together
    as one document, smaller than every other. Very long texts are split whole; their
    memory is that of the text. Other columns are ignored, whatever their names.
    No rows: no rows.
    """
    # a row is known by its id and text, so equal rows share one list of positions
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t1, t2 = _hashes(F.col("text"))
    rows = rows.withColumns({"t1": t1, "t2": t2})
    exploded = rows.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keyed = exploded.select("id", "t1", "t2", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    k1, k2 = _hashes(F.col("key"))
    lines = keyed.select("id", "t1", "t2", "at", k1.alias("k1"), k2.alias("k2"))
    held = lines.select("k1", "k2", "id").distinct().groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("id").alias("last"))
    shared = held.where(F.col("docs") >= min_docs).select("k1", "k2", "last")
    # as a table of its own its size is known: it is broadcast while small, else hot keys of a plain shuffle join are split
    shared = scratch.materialise(shared, "shared_lines")
    lost = lines.join(shared, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    lost = lost.groupBy("id", "t1", "t2").agg(F.array_sort(F.collect_set("at")).alias("lost"))
    lost = lost.select(F.col("id").alias("of"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "lost")
    both = rows.join(lost, F.col("id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    split = both.select("id", "text", "lost", F.split("text", "\n").alias("lines"))
    # what lies between two lost positions is kept as a whole, so time is linear in the lines
    before = F.concat(F.array(F.lit(-1)), F.col("lost"))
    after = F.concat(F.col("lost"), F.array(F.size("lines")))
    runs = F.zip_with(before, after, lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1))
    return split.select(
        "id",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def lines_sql(source: str = "documents", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    """DuckDB SQL for the digest of :func:`drop_shared_lines` over ``source(doc_id, text)``."""
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
    WITH src AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {source}),
    line AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM src),
    keyed AS MATERIALIZED (SELECT *, translate(trim(line, {blanks}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM line),
    shared AS (
      SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {min_chars} GROUP BY key
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {min_docs}),
    told AS (SELECT k.rid, k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS lost FROM keyed k LEFT JOIN shared s USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
    FROM told GROUP BY rid"""
