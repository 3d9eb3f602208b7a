"""Names of candidates from their résumés and addresses: one projection after another, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions import names as n


def names_in_text(texts: DataFrame) -> DataFrame:
    """The rows of texts (with column text) with name: the best guess in the first lines, or empty.

    Each guess carries the score of its origin. The best wins, ties go to the
    first by its letters. What stands before an address in a whole line counts
    only where there is no other guess. Null and empty texts have no name;
    repeated rows get the same name. Columns whose names begin with _name_ are
    the operator's own and must not be in texts.
    """
    steps = [
        ("_name_text", n.laid_out(F.col("text"))),
        ("_name_text", n.unfolded(F.col("_name_text"))),
        ("_name_lines", n.first_lines(F.col("_name_text"))),
        ("_name_lines", n.mended_lines(F.col("_name_lines"))),
        ("_name_raws", F.concat(n.labelled(F.col("_name_lines")), n.in_parts(F.col("_name_lines")), n.of_letters(F.col("_name_lines")), n.owner(F.col("_name_text")))),
        ("_name_found", n.persons(F.filter("_name_raws", lambda x: x["raw"] != ""))),
        ("_name_beside", F.when(F.size("_name_found") == 0, n.persons(n.beside_contact(F.col("_name_lines"))))),
        ("name", n.best(F.coalesce("_name_beside", "_name_found"))),
    ]
    out = texts
    for column, value in steps:
        out = out.withColumn(column, value)
    return out.drop("_name_text", "_name_lines", "_name_raws", "_name_found", "_name_beside")


def resolved_names(candidates: DataFrame) -> DataFrame:
    """The rows of candidates (with text and email) with name and name_source: by the text, else by the address, else unknown and empty."""
    both = names_in_text(candidates).withColumnRenamed("name", "_name_said").withColumn("_name_sent", n.from_address(F.col("email")))
    said, sent = F.col("_name_said") != "", F.col("_name_sent") != ""
    source = F.when(said, "resume").when(sent, "email").otherwise("unknown")
    return both.withColumn("name", F.when(said, F.col("_name_said")).otherwise(F.col("_name_sent"))).withColumn("name_source", source).drop("_name_said", "_name_sent")
