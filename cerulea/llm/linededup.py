"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two lines decides where a chunk ends, so inserted or removed lines shift no boundary beyond their neighbours. Chunks of two
lines or more that occur again anywhere in the corpus are removed, after their bytes were compared; the first by (doc_id, line) stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import read_table, row_key, stored

DIVISOR = 3
MIN_LINES = 2
#: Occurrences of one chunk that meet its first one in one task.
SALT_ROWS = 1000


def chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, own, start, n, chunk): the chunks of ``min_lines`` lines or more that hold more than blanks; own is the key of the row's id and text."""
    value = lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", row_key().alias("own"), F.split("text", "\n").alias("lines")).where(F.size("lines") >= min_lines)
    rows = rows.withColumn("h", F.transform("lines", value))
    ends = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == F.size("lines") - 1) | ((F.when(i > 0, F.try_element_at("h", i)).otherwise(0) * 31 + F.element_at("h", i + 1)) % divisor == 0))
    rows = rows.select("doc_id", "own", "lines", ends.alias("ends"))
    begin = lambda k: F.when(k > 0, F.try_element_at("ends", k) + 1).otherwise(0)
    parts = F.transform("ends", lambda e, k: F.struct(begin(k).alias("start"), (e - begin(k) + 1).alias("n")))
    parts = F.filter(parts, lambda c: c["n"] >= min_lines)
    found = rows.select("doc_id", "own", F.explode(F.transform(parts, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.array_join(F.transform(F.sequence(c["start"], c["start"] + c["n"] - 1), lambda i: F.get("lines", i)), "\n").alias("chunk")))).alias("c"))
    return found.select("doc_id", "own", "c.start", "c.n", "c.chunk").where(F.col("chunk").rlike(r"\S"))


def repeats(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(own, start, n) of each chunk that repeats an earlier one.

    Counting goes by a hash of the chunk with sums before the shuffle; only chunks whose hash repeats carry their text further, are grouped by their bytes,
    and are compared with the first of them byte by byte. A chunk that occurs very often meets its first occurrence in several tasks, of about 1,000 occurrences each.
    """
    found = chunks(docs, divisor, min_lines).withColumn("key", F.xxhash64("chunk", F.length("chunk")))
    again = found.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / SALT_ROWS).cast("int").alias("salts"))
    alike = stored(found.join(again, "key").withColumn("salt", F.pmod(F.xxhash64("own", "start"), F.col("salts")).cast("int")), "repeated-chunks")  # read twice; else all chunks are shuffled twice
    at = F.struct("doc_id", "own", "start")
    first = alike.groupBy("key", "chunk").agg(F.min(at).alias("first"), F.count("*").alias("m"), F.first("salts").alias("salts")).where("m > 1")
    first = first.select("key", F.col("chunk").alias("bytes"), "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return alike.join(first, ["key", "salt"]).where((F.col("chunk") == F.col("bytes")) & (at != F.col("first"))).select("own", "start", "n")


def without_repeats(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): every document with its repeated chunks gone; all documents stay, some perhaps empty.

    A null text stays null and has no lines, an empty one has one. Single lines and blank chunks are never removed. A row is its id and its text: rows with one id and
    other texts are told apart, null ids come first in the order, and rows that repeat both are one document and share one decision. An empty table gives no rows.
    """
    gone = repeats(docs, divisor, min_lines).groupBy("own").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    rows = docs.select("doc_id", "text", row_key().alias("own")).join(gone, "own", "left")
    dropped = F.flatten(F.transform("gone", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))
    # columns of their own: inside a lambda an expression would be computed for each line
    rows = rows.select("doc_id", "text", F.split("text", "\n").alias("lines"), F.when(F.col("gone").isNotNull(), dropped).alias("gone"))
    return cleaned(rows)


def pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, of, start, n, key): every two successive lines that are not both blank, and every run of blank lines with the lines beside it.

    of: a hash of the text, as rows that repeat an id may have other texts. key: the SHA-256 of the lines, which stands for their bytes, so no text is shuffled.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("of"), F.split("text", "\n").alias("lines")).where(F.size("lines") > 1)
    rows = rows.withColumn("full", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(r"\S"))).where(F.size("full") > 0)
    last = F.size("lines") - 1
    two = F.transform(F.array_distinct(F.flatten(F.transform("full", lambda i: F.array(i - 1, i)))), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))
    # blanks inside a passage go with it, and those at the ends of a text with the line beside them
    gaps = F.transform(F.sequence(F.lit(0), F.size("full")), lambda k: F.struct(F.when(k > 0, F.get("full", k - 1)).otherwise(0).alias("start"), F.when(k < F.size("full"), F.get("full", k)).otherwise(last).alias("end")))
    spans = F.concat(F.filter(two, lambda c: (c["start"] >= 0) & (c["end"] <= last)), F.filter(gaps, lambda c: c["end"] - c["start"] > 1))
    digest = lambda c: F.unhex(F.sha2(F.array_join(F.slice("lines", c["start"] + 1, c["end"] - c["start"] + 1), "\n").cast("binary"), 256))
    found = F.transform(spans, lambda c: F.struct(c["start"].alias("start"), (c["end"] - c["start"] + 1).alias("n"), digest(c).alias("key")))
    return rows.select("doc_id", "of", F.explode(found).alias("c")).select("doc_id", "of", "c.start", "c.n", "c.key")


def without_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): every document without the passages of two lines or more that stand earlier, by (doc_id, line), in the corpus.

    Each two successive lines of a repeated passage repeat, so it goes from its true first to its true last line, and an exact copy of two lines or more goes
    whole. The first occurrence of a line always stays somewhere; single lines that repeat between other lines stay too. Rows with equal ids (null is one) and
    equal texts are one document and share one decision; all rows stay, some perhaps empty. A null text stays null and has no lines, an empty one has one.
    """
    found = pairs(docs)
    at = F.struct("doc_id", "of", "start")
    first = found.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("m")).where("m > 1").select("key", "first")
    gone = found.join(first, "key").where(at != F.col("first")).groupBy("doc_id", "of").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("of").alias("g_of"), F.array_distinct(F.flatten(F.transform("spans", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))).alias("gone"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("of"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("of") == F.col("g_of")), "left")
    return cleaned(rows.select("doc_id", "text", F.split("text", "\n").alias("lines"), "gone"))


def cleaned(rows: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) from doc_id, text, lines and gone: the numbers of the lines to remove, each once, or null."""
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    clean = F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(clean).alias("text"),
    )


def op9_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op9_line_chunk_dedup": rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, lines, list_transform(lines, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT) AS h FROM l),
e AS (SELECT doc_id, lines, list_filter(range(len(lines)), lambda i: i = len(lines) - 1 OR (CASE WHEN i > 0 THEN h[i] ELSE 0 END * 31 + h[i + 1]) % {DIVISOR} = 0) AS ends FROM h),
c AS (SELECT doc_id, lines, ends, unnest(range(len(ends))) AS k FROM e),
p AS (SELECT doc_id, lines, CASE WHEN k > 0 THEN ends[k] + 1 ELSE 0 END AS start, ends[k + 1] AS last FROM c),
x AS (SELECT doc_id, start, last - start + 1 AS n, array_to_string(lines[start + 1 : last + 1], chr(10)) AS chunk FROM p WHERE last - start + 1 >= {MIN_LINES}),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) AS nth FROM x WHERE regexp_matches(chunk, '\S')),
g AS (SELECT doc_id, flatten(list(range(start, start + n))) AS gone FROM r WHERE nth > 1 GROUP BY 1)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i + 1] for i in range(len(lines)) if NOT list_contains(gone, i)], chr(10)) END AS text
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
}
