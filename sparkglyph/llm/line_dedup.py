"""Line deduplication by a tree of log templates.

A line's tokens (runs without white space) that hold a digit become the field <*>. The tree has a fixed depth: the number
of tokens, then the DEPTH leading ones. In a leaf a token counts as constant at its place if lines with it there stand in
LEAST documents (added up over the distinct lines); other tokens are fields. Lines of which ALIKE percent of the places
after the leading ones are constant belong to the template of their constants; a leaf may hold any number of templates.
A template that LEAST documents of different content share is recurring: its lines stay in the first document (smallest
doc_id, then place) and go from all others. Any line is recurring, too, if the very same tokens stand in enough documents of
different content: LEAST, for lines of LONG tokens or more 2, for lines of fewer than SHORT tokens (which have no fields)
OFTEN. Lines without tokens always stay.

Everything is DataFrame operations; no Python runs on executors. Lines are 64-bit hashes in every table but one, that of the
distinct lines in leaves that may hold a template; a line is known by its own hash and its leaf's. No group is gathered in
one place: constants, templates and first documents are aggregates.

Defined cases: null text stays null and has no lines; copies of a document count once, but lose the lines as all others do;
repeated rows are handled row by row; of equal doc_ids the first row by file and place is the first; a null doc_id comes
after all others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BROADCAST_ROWS, documents, few_bytes, few_rows, located, locator, written

DEPTH, SHORT, LEAST, ALIKE = 3, 4, 5, 70
LONG, OFTEN = 20, 20


def _lines(rows: DataFrame) -> DataFrame:
    """rows with a row for each line that has tokens: no, size, clean (the tokens, fields masked), leaf, line."""
    lines = rows.select("*", F.posexplode(F.split("text", "\n")).alias("no", "raw")).drop("text")
    spaced = F.col("raw").contains("  ")
    for space in "\t\x0b\x0c\r":
        spaced = spaced | F.col("raw").contains(space)
    lines = lines.withColumn("clean", F.trim(F.when(spaced, F.regexp_replace("raw", "[ \t\x0b\x0c\r]+", " ")).otherwise(F.col("raw")))).where("clean <> ''")
    lines = lines.withColumn("size", F.length("clean") - F.length(F.replace("clean", F.lit(" "), F.lit(""))) + 1).drop("raw")
    masked = F.regexp_replace("clean", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")
    lines = lines.withColumn("clean", F.when((F.col("size") >= SHORT) & F.col("clean").rlike("[0-9]"), masked).otherwise(F.col("clean")))
    return lines.withColumn("leaf", F.xxhash64("size", F.substring_index("clean", " ", DEPTH))).withColumn("line", F.xxhash64("clean"))


def _enough(n: Column, least: int) -> Column:
    """Documents that lines of n tokens need at least."""
    return F.when(n < SHORT, max(OFTEN, least)).when(n >= LONG, min(2, least)).otherwise(least)


def _templates(rows: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """(leaf, line, template) of the lines that belong to one. A leaf of one line has no other template than that line."""
    leaves = shared.where(F.col("size") >= SHORT).groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("most"))
    leaves = written(leaves.where((F.col("n") > 1) & (F.col("most") >= least)).select("leaf"), "leaves")
    kinds = _lines(rows.select("text")).join(few_rows(leaves), "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("clean").alias("clean"))
    kinds = written(kinds.join(shared, ["leaf", "line"]), "kinds")
    tail = F.slice(F.split("clean", " "), F.lit(DEPTH + 1), F.col("size"))
    tokens = kinds.select("leaf", "line", "size", "docs", F.posexplode(tail).alias("place", "token"))
    tokens = written(tokens.select("leaf", "line", "size", "docs", F.xxhash64("place", "token").alias("token")), "tokens")
    constant = written(tokens.groupBy("leaf", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("leaf", "token"), "constant")
    held = tokens.join(few_rows(constant, BROADCAST_ROWS // 2), ["leaf", "token"], "left_semi").groupBy("leaf", "line").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.bit_xor("token").alias("template"))
    return held.where(100 * F.col("n") >= ALIKE * (F.col("size") - DEPTH)).select("leaf", "line", "template")


def recurring_lines(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(file, row, gone): the places of lines that go from each row (id, file, row, text) that loses any."""
    lines = written(_lines(rows.select("id", "file", "row", "text", F.xxhash64("text").alias("doc"))).drop("clean"), "lines")
    pairs = lines.groupBy("leaf", "line", "doc").agg(F.max("size").alias("size"))
    shared = written(pairs.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.max("size").alias("size")), "shared")
    judged = written(_templates(rows, shared, least), "judged")
    counted = lines.select("leaf", "line", "doc").join(few_rows(judged, BROADCAST_ROWS // 2), ["leaf", "line"]).select("leaf", "template", "doc").distinct()
    recurring = counted.groupBy("leaf", "template").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("leaf", "template")
    by_template = written(judged.join(recurring, ["leaf", "template"], "left_semi").select("leaf", "line", "template"), "recurring")
    by_line = shared.where(F.col("docs") >= _enough(F.col("size"), least)).join(by_template.select("leaf", "line"), ["leaf", "line"], "left_anti")
    going = written(by_template.union(by_line.select("leaf", "line", F.col("line").alias("template"))), "going")
    hits = written(lines.join(few_rows(going, BROADCAST_ROWS // 2), ["leaf", "line"]).select("leaf", "template", "id", "file", "row", "no"), "hits")
    order = F.struct(F.col("id").isNull(), "id", "file", "row")
    first = written(hits.groupBy("leaf", "template").agg(F.min(order).alias("first")).select("leaf", "template", F.col("first.file").alias("first_file"), F.col("first.row").alias("first_row")), "firsts")
    gone = hits.join(few_rows(first, BROADCAST_ROWS // 2), ["leaf", "template"]).where("first_file <> file or first_row <> row")
    return written(gone.groupBy("file", "row").agg(F.collect_list("no").alias("gone")), "gone")


def drop_recurring_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row of docs (doc_id, text)."""
    rows = located(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *locator())
    gone = few_bytes(recurring_lines(rows, least), 24 + 4 * F.size("gone"))
    out = rows.join(gone, ["file", "row"], "left").withColumn("parts", F.split("text", "\n"))
    n, lost = F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")), F.coalesce(F.size("gone"), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"), lambda k: F.get("parts", k))
    text = F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.select(F.col("id").alias("doc_id"), text.alias("text"), n.cast("long").alias("n_lines"), F.greatest(lost, F.lit(0)).cast("long").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(documents(spark, sf_dir))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT doc_id, doc, no, trim(regexp_replace(raw, '[ \t\v\f\r]+', ' ', 'g'), ' ') AS clean FROM l
), m AS (
  SELECT doc_id, doc, no, len(string_split(clean, ' ')) AS size, CASE WHEN len(string_split(clean, ' ')) >= 4 THEN regexp_replace(clean, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE clean END AS line FROM c WHERE clean <> ''
), f AS (
  SELECT *, array_to_string(list_prepend(size::VARCHAR, string_split(line, ' ')[1:3]), ' ') AS leaf FROM m
), shared AS (
  SELECT leaf, line, any_value(size) AS size, count(DISTINCT doc) AS docs FROM f GROUP BY leaf, line
), tok AS (
  SELECT leaf, line, docs, size, unnest(string_split(line, ' ')[4:]) AS token, generate_subscripts(string_split(line, ' ')[4:], 1) AS place FROM shared WHERE size >= 4
), constant AS (
  SELECT leaf, place, token FROM tok GROUP BY ALL HAVING sum(docs) >= 5
), judged AS (
  SELECT leaf, line, 'T' || string_agg(place || ':' || token, ' ' ORDER BY place) AS template FROM tok JOIN constant USING (leaf, place, token) GROUP BY leaf, line, size HAVING 100 * count(*) >= 70 * (size - 3)
), by_template AS (
  SELECT leaf, line, template FROM judged JOIN (SELECT leaf, template FROM f JOIN judged USING (leaf, line) GROUP BY ALL HAVING count(DISTINCT doc) >= 5) USING (leaf, template)
), going AS (
  SELECT * FROM by_template UNION ALL
  SELECT leaf, line, 'L' || line FROM shared s WHERE docs >= CASE WHEN size < 4 THEN 20 WHEN size >= 20 THEN 2 ELSE 5 END AND NOT EXISTS (SELECT 1 FROM by_template b WHERE b.leaf = s.leaf AND b.line = s.line)
), hits AS (
  SELECT leaf, template, doc_id, no FROM f JOIN going USING (leaf, line)
), gone AS (
  SELECT doc_id, list(no) AS gone FROM (SELECT *, min(doc_id) OVER (PARTITION BY leaf, template) AS first FROM hits) WHERE doc_id <> first GROUP BY doc_id
)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped
FROM documents LEFT JOIN gone USING (doc_id)
"""
}
