"""Names of files and folders that must not meet: the least free number, renaming in order, folders that merge.

A loop that asks of every file whether its name is taken is one sequence of looks at a folder. Here the first file of each
name has it; the others of a family (folder, stem, suffix) take, in order, the numbers that no file has: the j-th of them gets the
j-th number that is free, which follows from how many taken numbers lie before it. A numbered name belongs to one family alone, so what
comes out is distinct whatever comes in. That is what the loop gives when the first file of each name comes before the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visarium.functions import names


def free_names(rows: DataFrame, by: list[str], stem: Column, suffix: Column, order: list[Column], target: str, width: int = 3, first: int = 1) -> DataFrame:
    """rows with target: stem + suffix for the first row of each such name in a folder (by), stem_number + suffix for the others:
    the least free numbers from first on, with width digits at least, in order. order tells equal names apart."""
    own = rows.withColumns({"_stem": stem, "_suffix": suffix}).withColumn("_name", F.concat("_stem", "_suffix"))
    own = own.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_name").orderBy(*order)))
    family = [*by, "_stem", "_suffix"]
    # Of names present, those that carry a number as it would be given out.
    digits = F.regexp_extract("_stem", r"(?s)^.*_(\d{%d,18})$" % width, 1)
    number = digits.try_cast("long")
    taken = own.filter("_place = 1").withColumn("_digits", digits).withColumn("_n", number)
    taken = taken.filter((F.col("_digits") == F.format_string(f"%0{width}d", "_n")) & (F.col("_n") >= first))
    base = F.expr("substring(_stem, 1, length(_stem) - length(_digits) - 1)")
    i = F.row_number().over(Window.partitionBy(*family).orderBy("_n"))
    # Free numbers before the i-th taken one: so many rows come before it.
    taken = taken.select(*by, base.alias("_stem"), "_suffix", "_n").withColumn("_at", F.col("_n") - first - i + 2).select(*family, "_at", F.lit(0).alias("_asks"))
    asks = own.filter("_place > 1").withColumn("_at", F.row_number().over(Window.partitionBy(*family).orderBy(*order)).cast("long"))
    both = asks.withColumn("_asks", F.lit(1)).unionByName(taken, allowMissingColumns=True)
    before = F.sum(1 - F.col("_asks")).over(Window.partitionBy(*family).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("_number", F.col("_at") + before + first - 1).filter("_asks = 1")
    named = numbered.withColumn(target, F.concat(F.format_string(f"%s_%0{width}d", "_stem", "_number"), "_suffix"))
    columns = [*rows.columns, target]
    return own.filter("_place = 1").withColumn(target, F.col("_name")).select(columns).unionByName(named.select(columns))


def unique_names(files: DataFrame, by: str, order: str, *, name: str = "name") -> DataFrame:
    """files with target: the name, or the name with the least free of _001, _002 ... for those that come later with the same name in
    a folder. Names that carry such a number already keep it."""
    return free_names(files, [by], names.stem(F.col(name)), names.suffix(F.col(name)), [F.col(order)], "target")


def unique_folders(folders: DataFrame, wanted: str, order: str) -> DataFrame:
    """folders with new_folder: the wanted name, then the least free of _0, _1 ... for later ones."""
    return free_names(folders, [], F.col(wanted), F.lit(""), [F.col(order)], "new_folder", 1, 0)


def rename_in_order(files: DataFrame, by: str, base: Column) -> DataFrame:
    """The image files of each folder with new_name: base_001.ext and so on in the order of their names, extensions in lower
    case. Other files are left out: they keep their names."""
    images = files.filter(F.lower("name").rlike(r"\.(jpg|jpeg|png|webp)$"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("name"))
    return images.withColumn("new_name", F.format_string("%s_%03d%s", base, place, F.lower(names.suffix(F.col("name")))))


def merge_folders(files: DataFrame, merges: DataFrame) -> DataFrame:
    """files (cluster, name, ...) after merges (cluster, into): they lie in the folder that theirs was merged into, and target is
    their name there. A folder's own files keep their names; files that move in get the least free numbers, by folder and name."""
    into = merges.toDF("_from", "_into").dropDuplicates(["_from"])
    moved = files.join(into, F.col("cluster") == F.col("_from"), "left").withColumns({"_old": F.col("cluster"), "_came": F.coalesce(F.col("_into") != F.col("cluster"), F.lit(False))})
    moved = moved.withColumn("cluster", F.coalesce("_into", "cluster"))
    out = free_names(moved, ["cluster"], names.stem(F.col("name")), names.suffix(F.col("name")), [F.col("_came"), F.col("_old"), F.col("name")], "target")
    return out.select(*files.columns, "target")
