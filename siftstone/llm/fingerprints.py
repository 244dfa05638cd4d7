"""Document fingerprints: a Merkle tree of paragraphs, sections and the document.

Sections are parted by an empty line, paragraphs by a line break. A leaf is the SHA-256 of "p:" and the paragraph, a
section that of "s:" and its leaves' hex digests, the root that of "r:" and its sections' digests. Equal roots mean
equal texts; where roots differ, only branches whose digests differ need to be opened to find the edit.

Defined cases: a null text has null digests and no branches; an empty text is one section of one empty paragraph;
texts of any length are hashed whole; repeated rows get equal trees; an empty table gives an empty table; other columns,
whatever their names, are not part of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digest(kind: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), content), 256)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root, sections array, paragraphs array of arrays): every digest of each document's tree. All in the JVM."""
    leaves = F.transform(F.split(F.col("__text"), "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: _digest("p", p)))
    trees = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).select(id_col, leaves.alias("paragraphs"))
    trees = trees.withColumn("sections", F.transform("paragraphs", lambda leaf: _digest("s", F.array_join(leaf, ""))))
    return trees.select(id_col, F.when(F.col("sections").isNotNull(), _digest("r", F.array_join("sections", ""))).alias("root"), "sections", "paragraphs")


def _common(a: Column, b: Column) -> Column:
    """Number of entries at the beginning that two arrays share."""
    differs = F.zip_with(a, b, lambda x, y: ~F.coalesce(x == y, F.lit(False)))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1).otherwise(F.size(differs)).cast("int")


def _leaves(pairs: DataFrame, id_col: str, mine: str) -> DataFrame:
    """(id, section, paragraph, digest, nth) of one side's leaves in the sections between those that both sides begin and end with; nth counts equal leaves."""
    opened = pairs.select(id_col, "head", (F.size(f"{mine}.sections") - F.col("tail")).alias("end"), F.posexplode(f"{mine}.paragraphs").alias("section", "leaves")).where("section >= head and section < end")
    leaves = opened.select(id_col, "section", F.posexplode("leaves").alias("paragraph", "digest"))
    return leaves.withColumn("nth", F.row_number().over(Window.partitionBy(id_col, "digest").orderBy("section", "paragraph")))


def edits(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, change, section, paragraph, digest) of two fingerprint tables: removed paragraphs by their place before, added and moved ones by their place after.

    Documents with equal roots are skipped without opening their trees, and so are the sections that both trees begin
    with and end with. In the branches between, the nth paragraph of a content before is the nth of that content after;
    what has no counterpart was removed or added, so that a change in how often a paragraph repeats is listed, and a
    counterpart that stands elsewhere in the order of those that stayed was moved. Where only the breaks between
    sections changed, the paragraphs whose section changed are listed as moved. A document in one table only has all its
    paragraphs listed; null texts have none. Ids must be unique in each table; null ids match nothing.
    """
    tree = F.struct("root", "sections", "paragraphs")
    pairs = before.select(id_col, tree.alias("a")).join(after.select(id_col, tree.alias("b")), id_col, "full").where(~F.col("a.root").eqNullSafe(F.col("b.root")))
    none = F.array().cast("array<string>")
    a, b = (F.coalesce(F.col(f"{x}.sections"), none) for x in "ab")
    pairs = pairs.withColumn("head", _common(a, b)).withColumn("tail", F.least(_common(F.reverse(a), F.reverse(b)), F.size(a) - F.col("head"), F.size(b) - F.col("head")))
    old, new = _leaves(pairs, id_col, "a"), _leaves(pairs, id_col, "b")
    both = old.select(id_col, "digest", "nth", F.struct("section", "paragraph").alias("x")).join(new.select(id_col, "digest", "nth", F.struct("section", "paragraph").alias("y")), [id_col, "digest", "nth"], "full")
    one = both.where("x is null or y is null").select(id_col, F.when(F.col("y").isNull(), "removed").otherwise("added").alias("change"), F.coalesce("x", "y").alias("at"), "digest")
    stayed = both.where("x is not null and y is not null")
    ranks = stayed.withColumn("i", F.row_number().over(Window.partitionBy(id_col).orderBy("x"))).withColumn("j", F.row_number().over(Window.partitionBy(id_col).orderBy("y")))
    shape = ranks.withColumn("rows", F.count(F.when(F.col("i") != F.col("j"), 1)).over(Window.partitionBy(id_col))).join(one.select(id_col).distinct().withColumn("cut", F.lit(True)), id_col, "left")
    moved = shape.where((F.col("i") != F.col("j")) | (F.col("cut").isNull() & (F.col("rows") == 0) & (F.col("x.section") != F.col("y.section"))))
    out = one.unionByName(moved.select(id_col, F.lit("moved").alias("change"), F.col("y").alias("at"), "digest"))
    return out.select(id_col, "change", "at.section", "at.paragraph", "digest")


def flat(trees: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every digest as text: sections joined by spaces, paragraphs by spaces within and bars between sections."""
    return trees.select(id_col, "root", F.array_join("sections", " ").alias("sections"), F.array_join(F.transform("paragraphs", lambda x: F.array_join(x, " ")), "|").alias("paragraphs"), F.size("sections").cast("bigint").alias("n_sections"), F.size(F.flatten("paragraphs")).cast("bigint").alias("n_paragraphs"))


ORACLE = r"""
WITH leaves AS (SELECT doc_id, list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: sha256('p:' || p))) AS paragraphs FROM documents),
sections AS (SELECT doc_id, paragraphs, list_transform(paragraphs, lambda x: sha256('s:' || array_to_string(x, ''))) AS s FROM leaves)
SELECT doc_id, sha256('r:' || array_to_string(s, '')) AS root, array_to_string(s, ' ') AS sections,
  array_to_string(list_transform(paragraphs, lambda x: array_to_string(x, ' ')), '|') AS paragraphs,
  len(s)::BIGINT AS n_sections, len(flatten(paragraphs))::BIGINT AS n_paragraphs
FROM sections
"""
