"""Who wrote each line, out of exported blame, and what part of each declaration is whose.

An export is the text that ``git blame --line-porcelain`` gives for a file, as a row (path, value). A
block for each line begins with the commit and the line's number and ends with the line itself;
a block without the line (a cut-off export) gives nothing. Lines meet declarations by blocks of
``WIDTH`` lines, so a long file is many small groups rather than one.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def lines(exported: DataFrame) -> DataFrame:
    """(path, line, commit, email) of each line; an address that isn't given is ``unknown``."""
    head = r"^([0-9a-f]{40})\s+\d+\s+(\d+)"
    blocks = exported.select("path", F.explode(F.split("value", r"(?<=\n)(?=[0-9a-f]{40}\s+\d+\s+\d+)")).alias("block"))
    email = F.nullif(F.regexp_extract("block", r"(?m)^author-mail <?(.*?)>?\s*$", 1), F.lit(""))
    rows = blocks.where(F.col("block").rlike(head) & F.col("block").rlike(r"(?m)^\t"))
    return rows.select("path", F.regexp_extract("block", head, 2).cast("int").alias("line"), F.regexp_extract("block", head, 1).alias("commit"), F.coalesce(email, F.lit("unknown")).alias("email"))


def ownership(blamed: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, email, n_lines, share): lines of each declaration (entity, path, start_line, end_line) by the addresses, in lower case, that wrote them."""
    block = lambda c: F.floor(F.col(c) / WIDTH)
    spans = entities.where("end_line >= start_line").withColumn("block", F.explode(F.sequence(block("start_line"), block("end_line"))))
    met = blamed.withColumn("block", block("line")).join(spans, ["path", "block"]).where("line between start_line and end_line")
    counted = met.groupBy("entity", F.lower("email").alias("email")).agg(F.count(F.lit(1)).alias("n_lines"))
    whole = counted.groupBy("entity").agg(F.sum("n_lines").alias("whole"))
    return counted.join(whole, "entity").select("entity", "email", "n_lines", (F.col("n_lines") / F.col("whole")).alias("share"))
