"""Recurring lines by a log-template tree, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Leading tokens on a path of the tree, tokens of a line that is generalised, documents that make a template recur.
DEPTH, LEAST_TOKENS, LEAST_DOCS = 3, 4, 5
#: Share of a leaf's lines that must agree for a constant field, and of a template's fields that must be constant.
AGREE, CONSTANT = 0.5, 0.7
#: Leaves that are sent to all executors at most; more are joined by a shuffle.
BROADCAST = 100_000
#: Templates with this share of all (document, line) pairs or more, so 1,000 at most, are sent to all executors.
OFTEN = 1_000
ANY = "<*>"


def _masked(line: Column) -> Column:
    found = F.filter(F.split(line, r"[\t\x0B-\x0D ]+"), lambda t: t != "")
    masked = F.transform(found, lambda t: F.when(t.rlike("[0-9@]"), ANY).otherwise(t))
    return F.array_join(F.when(F.size(found) >= LEAST_TOKENS, masked).otherwise(found), " ")


def shape(line: Column) -> Column:
    """Tokens between white space, one space apart; in lines of four and more those with a digit or an @ stand for any value.

    Most lines are their own shape: plain searches tell, which cost a tenth of a pattern's time.
    """
    special = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "0123456789@\t\x0b\x0c\r":
        special = special | line.contains(c)
    return F.when(special, _masked(line)).otherwise(line)


def n_tokens(of: Column) -> Column:
    return F.when(of == "", 0).otherwise(F.octet_length(of) - F.octet_length(F.replace(of, F.lit(" "), F.lit(""))) + 1)


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a token: doc_id, shape, size, m (hash of the shape) and leaf (hash of its path in the tree; null in short ones)."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    # a generator's output is made once; as a plain column it would be made again for each use and in the filter
    lines = lines.select("doc_id", F.explode(F.array(shape(F.col("line")))).alias("shape"))
    lines = lines.withColumn("size", n_tokens(F.col("shape"))).where("size > 0")
    path = F.when(F.col("size") >= LEAST_TOKENS, F.xxhash64("size", F.substring_index("shape", " ", DEPTH)))
    return lines.select("doc_id", "shape", "size", F.xxhash64("shape").alias("m"), path.alias("leaf"))


def templates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, m, leaf; once a document) and the leaf templates that generalise some of them (m, leaf)."""
    slim = table(_lines(docs).select("doc_id", "m", "leaf").distinct(), "lines")
    by_m = slim.where("leaf IS NOT NULL").groupBy("leaf", "m").agg(F.count("*").alias("docs"))
    leaves = by_m.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).where(f"kinds > 1 AND docs >= {LEAST_DOCS}").select("leaf", "kinds")
    leaves = table(leaves, "leaves")
    few = leaves.count() <= BROADCAST
    among = _lines(docs).join(F.broadcast(leaves) if few else leaves, "leaf")
    kinds = table(among.groupBy("leaf", "m", "kinds").agg(F.split(F.first("shape"), " ").alias("tokens")), "kinds")
    fields = kinds.select("leaf", "kinds", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "kinds", "at", "token").agg(F.count("*").alias("n"))
    constant = fields.where((F.col("n") > AGREE * F.col("kinds")) & (F.col("token") != ANY)).select("leaf", "at", "token")  # at most one a field
    fixed = constant.groupBy("leaf").agg(F.count("*").alias("fixed"))
    agreed = kinds.select("leaf", "m", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token")).join(constant, ["leaf", "at", "token"])
    agreed = agreed.groupBy("leaf", "m", "size").agg(F.count("*").alias("same")).join(fixed, "leaf")
    return slim, agreed.where((F.col("same") == F.col("fixed")) & (F.col("fixed") >= CONSTANT * F.col("size"))).select("m", "leaf")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, m) of line kinds to drop: of a template in LEAST_DOCS documents or more, all but the first document's."""
    slim, general = templates(docs)
    general = general.select("m", "leaf", F.lit(True).alias("wide"))
    named = table(slim.join(general, ["m", "leaf"], "left").select("doc_id", "m", F.when(F.col("wide"), F.col("leaf")).otherwise(F.col("m")).alias("template")), "named")
    counted = named.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    recurring = table(counted.where(f"docs >= {LEAST_DOCS}"), "recurring")
    least = max(LEAST_DOCS, -(-named.count() // OFTEN))
    often = recurring.where(F.col("docs") >= least).select("template", F.col("first").alias("often"))
    seldom = recurring.where(F.col("docs") < least).select("template", "first")
    marked = named.join(F.broadcast(often), "template", "left")
    rest = marked.where("often IS NULL").join(seldom, "template").where("doc_id > first")
    return marked.where("doc_id > often").select("doc_id", "m").union(rest.select("doc_id", "m")).distinct()


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the columns n_lines and n_dropped, and their text without recurring lines.

    Lines go down a tree by their number of tokens and their first three tokens; tokens with a digit or @ are a
    variable field. Lines under four tokens aren't generalised: each is a template as it stands. In a leaf a field is constant if over half of the leaf's different lines agree on it; lines that
    agree on all constant fields, of 70 % of the line at least, share the leaf's template, all others are their own.
    A template in five documents or more recurs: it stays in the document of smallest id and is dropped from the
    others. Blank lines stay.

    Null texts stay null with 0 lines; null ids are neither counted nor changed; rows that repeat an id count once
    and are cut alike. Other columns pass through, whatever their names; an empty table gives no rows.
    """
    slim_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = dropped_lines(slim_docs).groupBy("doc_id").agg(F.collect_set("m").alias("gone")).withColumnRenamed("doc_id", "gone_id")
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("line"))
    out = whole.join(gone, F.col("id") == F.col("gone_id"), "left")
    lines = F.split("line", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains("gone", F.xxhash64(shape(x))))
    out = out.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    text = F.when(F.col("gone").isNull(), F.col("line")).otherwise(F.array_join("kept", "\n"))
    n_lines = F.when(F.col("line").isNull(), 0).otherwise(F.size(lines))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size("kept"))
    own = {"text": text, "n_lines": n_lines, "n_dropped": n_dropped}
    return out.select(*(own.get(c, F.col("whole")[c]).alias(c) for c in docs.columns), *(x.alias(c) for c, x in own.items() if c not in docs.columns))


#: The same over `documents` in DuckDB's SQL, with texts in place of hashes.
LINES_SQL = r"""
WITH l AS (SELECT doc_id, pos, line, array_to_string(list_transform(list_filter(string_split_regex(line, '[\t\x0B-\x0D ]+'), lambda t: t <> ''),
    lambda t: CASE WHEN n >= 4 AND regexp_matches(t, '[0-9@]') THEN '<*>' ELSE t END), ' ') AS shape
  FROM (SELECT *, len(list_filter(string_split_regex(line, '[\t\x0B-\x0D ]+'), lambda t: t <> '')) AS n FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)))),
s AS (SELECT DISTINCT doc_id, shape, string_split(shape, ' ') AS tokens FROM l WHERE shape <> ''),
k AS (SELECT *, CASE WHEN len(tokens) >= 4 THEN len(tokens) || '/' || array_to_string(tokens[1:3], ' ') END AS leaf FROM s),
leaves AS (SELECT leaf, count(DISTINCT shape) AS kinds FROM k WHERE leaf IS NOT NULL GROUP BY leaf HAVING count(DISTINCT shape) > 1 AND count(*) >= 5),
kinds AS (SELECT DISTINCT leaf, kinds, shape, tokens FROM k JOIN leaves USING (leaf)),
f AS (SELECT leaf, kinds, shape, len(tokens) AS size, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS token FROM kinds),
c AS (SELECT leaf, pos, token FROM f WHERE token <> '<*>' GROUP BY leaf, kinds, pos, token HAVING count(*) > 0.5 * kinds),
x AS (SELECT leaf, count(*) AS fixed FROM c GROUP BY leaf),
w AS (SELECT f.leaf, f.shape FROM f JOIN c USING (leaf, pos, token) JOIN x ON x.leaf = f.leaf GROUP BY f.leaf, f.shape, f.size, x.fixed HAVING count(*) = x.fixed AND x.fixed >= 0.7 * f.size),
n AS (SELECT k.doc_id, k.shape, CASE WHEN w.leaf IS NOT NULL THEN 'leaf ' || k.leaf ELSE 'line ' || k.shape END AS template FROM k LEFT JOIN w ON w.leaf = k.leaf AND w.shape = k.shape),
t AS (SELECT template, min(doc_id) AS first FROM n GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT DISTINCT doc_id, shape, true AS gone FROM n JOIN t USING (template) WHERE doc_id > first),
o AS (SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '') AS kept FROM l LEFT JOIN g USING (doc_id, shape) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped, md5(kept) AS kept_md5 FROM documents d LEFT JOIN o USING (doc_id)
"""
