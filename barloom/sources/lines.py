"""Text lines of many files to records of cells: code page and separator per file, quoted cells over several lines.

Input is (file, ordinal, text, modified), a row per physical line; ``ordinal`` grows within a file and is a struct of ``block`` (a
part of the file that is read in one piece) and ``line``. One aggregate over the lines tells per file everything that
cutting needs; it combines before it shuffles, and is joined back without gathering a file in one task.

**Code page.** A file is read with the first of ``PAGES`` in which each of its bytes means something: UTF-8, then Windows-1258,
Windows-1252 and Latin-1. Bytes are turned into characters one to one and translated by a table, so that no session setting
is needed.

**Records.** A quoted cell may hold line breaks. What a line does to the state (inside a quoted cell or not) is a function of
two values: it keeps it, sets it, or swaps it. Functions compose, so the state at a line follows from the last line before it that
sets the state and the number of swaps since, first inside a block and then over the blocks' summaries. Only files with a line
that may open a cell go that way; others are cut line by line. A file that ends inside a quoted cell has a stray quote;
its lines are records of their own. Breaks inside a cell come out as a newline.

Blank lines between records are no records; a file without any other line has no rows. Repeated ordinals must not
occur. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.perfile import SMALL, least_rows, with_group
from barloom.session import packed, written

# fixed values
SEPARATORS = [",", ";", "\t", "|"]
PAGES = ["utf-8", "cp1258", "cp1252", "latin-1"]
BOM = "﻿"
#: lines of a record that are joined without a shuffle
AT_ONCE = 16
#: what a piece tells beside a line's columns
STATES = ("whole", "starts_out", "starts_in", "after_out", "after_in", "ends")

#: inside of a quoted cell; loops instead of alternatives, which would recurse in Java
QUOTED = '[^"]*+(?:""[^"]*+)*+'


def page_table(page: str) -> tuple[str, str, str]:
    """Of a one-byte page: the Latin-1 characters of bytes that mean something else in it, what they mean, and a
    class of those that mean nothing."""
    source, target, none = [], [], []
    for byte in range(256):
        plain = chr(byte)
        try:
            meant = bytes([byte]).decode(page)
        except UnicodeDecodeError:
            none.append(f"\\x{byte:02X}")
        else:
            if meant != plain:
                source.append(plain)
                target.append(meant)
    return "".join(source), "".join(target), f"[{''.join(none)}]"


def as_latin(text: Column | str) -> Column:
    """A character per byte, whatever the bytes mean."""
    return F.decode((F.col(text) if isinstance(text, str) else text).cast("binary"), "ISO-8859-1")


def decoded(text: Column, page: Column) -> Column:
    out = F.when(page == 0, text)
    for number, name in enumerate(PAGES[1:], start=1):
        source, target, _ = page_table(name)
        one = F.translate(as_latin(text), source, target) if source else as_latin(text)
        out = out.when(page == number, one)
    return out


def first_page(lines_valid: Column, latin: Column) -> Column:
    """Aggregate: the number of the first page that reads every line of the group."""
    page = F.when(F.bool_and(lines_valid), 0)
    for number, name in enumerate(PAGES[1:-1], start=1):
        page = page.when(~F.bool_or(F.when(lines_valid, False).otherwise(latin.rlike(page_table(name)[2]))), number)
    return page.otherwise(len(PAGES) - 1)


# ---- what a line does to a quoted cell -----------------------------------------------------------


def _cells(separator: str) -> str:
    """Whole cells and the separators after them."""
    s = re.escape(separator)
    return f'(?:(?:"{QUOTED}"[^{s}]*+|(?!")[^{s}]*+){s})*+'


def opens(text: Column, separator: str) -> Column:
    """A line that starts outside ends inside a quoted cell."""
    return text.rlike(f'^{_cells(separator)}"{QUOTED}$')


def stays_open(text: Column, separator: str) -> Column:
    """A line that starts inside a quoted cell ends inside one."""
    s = re.escape(separator)
    return text.rlike(f'^{QUOTED}(?:$|"[^{s}]*+{s}{_cells(separator)}"{QUOTED}$)')


def by_separator(number: Column, body) -> Column:
    out = F.lit(None)
    for i, s in enumerate(SEPARATORS):
        out = F.when(number == i, body(s)).otherwise(out)
    return out


def split_cells(text: Column, separator: str) -> Column:
    """All cells of a record; quoted ones may hold separators, line breaks and doubled quotes."""
    s = re.escape(separator)
    found = F.regexp_extract_all(F.concat(F.lit(separator), text), F.lit(f'{s}(?:"{QUOTED}"[^{s}]*|[^{s}]*)'), F.lit(0))

    def cell(match):
        plain = F.substr(match, F.lit(2))
        quoted = F.regexp_extract(plain, f'^"({QUOTED})"', 1)
        return F.when(F.startswith(plain, F.lit('"')) & plain.rlike(f'^"{QUOTED}"'), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(plain)

    any_quote = F.contains(text, F.lit('"'))
    cut = F.when(any_quote, F.transform(found, cell)).otherwise(F.split(text, s))
    return F.transform(cut, lambda c: F.nullif(F.trim(c), F.lit("")))


# ---- files ---------------------------------------------------------------------------------------


def file_profile(lines: DataFrame, small: int = SMALL) -> DataFrame:
    """Per file: number of lines, code page, separator (the one most frequent in the first line that is not blank), and
    whether a line may open a cell that it does not close."""
    latin = as_latin("text")
    quote = F.contains("text", F.lit('"'))
    # what any separator needs: a quote that begins a cell, and after it none but doubled ones
    open_any = latin.rlike(f'(?:^|[{"".join(map(re.escape, SEPARATORS))}])"{QUOTED}$')
    one_of = F.lit(False)
    for s in SEPARATORS:
        one_of = one_of | opens(latin, s)
    open_any = open_any & one_of
    filled = F.trim(latin) != ""
    files = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(filled, F.col("ordinal.block"))).alias("least"),
        first_page(F.is_valid_utf8("text"), latin).alias("page"),
        F.bool_or(F.when(quote, open_any).otherwise(False)).alias("spans"),
    )
    files = written(files, "file-marks")
    first = least_rows(lines, files.select("file", "n", "least"), small=small).where(filled).groupBy("file").agg(
        F.min_by(latin, "ordinal").alias("header"))
    files = files.join(first, "file", "left")
    counts = F.array(*[
        F.struct((F.length("header") - F.length(F.translate("header", s, ""))).alias("n"), F.lit(-i).alias("i"))
        for i, s in enumerate(SEPARATORS)
    ])
    return files.select("file", "n", "page", "spans", (-F.array_max(counts)["i"]).alias("sep"))


def odd(n: Column) -> Column:
    return F.pmod(n, F.lit(2)) == 1


def mark(sets: Column, value: Column, swaps: Column) -> Column:
    """What a function that sets the state leaves to those after it, where ``swaps`` swaps were made up to it; null for the others."""
    return F.when(sets, value != odd(swaps))


def state_after(start: bool, last: Column, swaps: Column) -> Column:
    """Inside a quoted cell or not, after functions with the last ``mark`` and ``swaps`` in all, from ``start``."""
    return F.coalesce(last, F.lit(start)) != odd(swaps)


def pieces(lines: DataFrame) -> DataFrame:
    """Lines (file, ordinal, text, sep, ...) to ``whole`` records under the ordinal of their first line, where their block alone tells
    their bounds and they have at most ``AT_ONCE`` lines. The others stay lines, or ``AT_ONCE`` lines of a record.

    A block is gone through once, for both states it may start in: before its first line it is outside of a quoted cell (``_out``) or
    inside one (``_in``). Where a line begins a record from either start, the start no longer matters. With ``starts_*``, the number of
    records that began in the block up to the row, ``after_*``, the state after it, and ``ends``, whether it is its block's last."""
    quote = F.contains("text", F.lit('"'))
    rest = [c for c in lines.columns if c not in ("file", "ordinal", "text")]
    told = lines.select(
        "file", F.col("ordinal.block"), F.col("ordinal.line"), "text", *rest,
        F.when(quote, by_separator(F.col("sep"), lambda s: opens(F.col("text"), s))).otherwise(False).alias("f_out"),
        F.when(quote, by_separator(F.col("sep"), lambda s: stays_open(F.col("text"), s))).otherwise(True).alias("f_in"),
    )
    sets, swap = F.col("f_out") == F.col("f_in"), (F.col("f_out") & ~F.col("f_in")).cast("int")
    # blocks lead the sort keys: names may begin alike, which makes them slow to sort
    by_line = Window.partitionBy("block", "file").orderBy("line")
    above = by_line.rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(
        "*", F.coalesce(F.sum(swap).over(above), F.lit(0)).alias("swaps"), F.row_number().over(by_line).alias("nth"),
        F.lead(F.lit(1)).over(by_line).isNull().alias("ends"),
    )
    told = told.withColumn("last", F.last(mark(sets, F.col("f_out"), F.col("swaps") + swap), ignorenulls=True).over(above))
    # the state before a line and after it, if the block starts outside, or inside a quoted cell
    inside = {name: state_after(start, F.col("last"), F.col("swaps")) for name, start in (("out", False), ("in", True))}
    told = told.select(
        "file", "block", "line", "text", *rest, "nth", "ends",
        *[(~before).alias(f"begins_{name}") for name, before in inside.items()],
        *[F.when(before, F.col("f_in")).otherwise(F.col("f_out")).alias(f"after_{name}") for name, before in inside.items()],
    )
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("begins_out") & F.col("begins_in")
    told = told.select(
        "*", *[F.sum(F.col(f"begins_{name}").cast("long")).over(so_far).alias(f"starts_{name}") for name in inside],
        F.max(F.when(begins, F.col("nth"))).over(so_far).alias("first"),
    )
    # a window hands each row what it gathers, hence the bound; the first line's row is kept
    head = F.col("nth") - F.pmod(F.col("nth") - F.col("first"), F.lit(AT_ONCE))
    told = told.withColumn("head", F.coalesce(head, F.col("nth")))
    piece = Window.partitionBy("block", "file", "head").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = told.select(
        "file", "block", "line", F.collect_list("text").over(piece).alias("texts"), *rest, "nth", "head", "first", "starts_out", "starts_in",
        # each line of a record but the last leaves a cell open
        *[F.bool_and(f"after_{name}").over(piece).alias(f"after_{name}") for name in inside], F.bool_or("ends").over(piece).alias("ends"),
    ).where("nth = head")
    return told.select(
        "file", "block", "line", F.when(F.size("texts") > 0, F.array_join("texts", "\n")).alias("text"), *rest,
        (F.col("first").eqNullSafe(F.col("head")) & ~F.col("after_out")).alias("whole"), *STATES[1:],
    )


def block_states(told: DataFrame) -> DataFrame:
    """(file, block, start, unclosed, before) of ``pieces``: whether the block starts inside a quoted cell, whether its file ends inside one,
    and the number of records that began before it. A row per block goes through the file."""
    blocks = told.where("ends").select("file", "block", "after_out", "after_in", "starts_out", "starts_in")
    # a block that does not set the state keeps or swaps it
    sets, swap = F.col("after_out") == F.col("after_in"), F.col("after_out") & ~F.col("after_in")
    by_block = Window.partitionBy("file").orderBy("block")
    so_far = by_block.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("swaps", F.sum(swap.cast("int")).over(so_far))
    blocks = blocks.withColumn("last", F.last(mark(sets, F.col("after_out"), F.col("swaps")), ignorenulls=True).over(so_far))
    blocks = blocks.withColumn("after", state_after(False, F.col("last"), F.col("swaps")))
    whole_file = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("start", F.lag("after", 1, False).over(by_block)).withColumn("unclosed", F.last("after").over(whole_file))
    held = F.when(F.col("start"), F.col("starts_in")).otherwise(F.col("starts_out"))
    before = F.sum(held).over(so_far) - held
    return blocks.select("file", "block", "start", "unclosed", before.alias("before"))


def records(told: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pieces`` that are not whole to records, under the ordinal of their first line."""
    rest = [c for c in told.columns if c not in ("file", "block", "line", "text", *STATES)]
    starts = F.when(F.col("start"), F.col("starts_in")).otherwise(F.col("starts_out"))
    grouped = told.join(blocks, ["file", "block"]).groupBy("file", (F.col("before") + starts).alias("record")).agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("parts"), *[F.first(c).alias(c) for c in rest])
    first = F.get("parts", F.lit(0))
    return grouped.select(
        "file", first["block"].alias("block"), first["line"].alias("line"), F.array_join(F.col("parts.text"), "\n").alias("text"), *rest)


def parse_lines(lines: DataFrame, small: int = SMALL) -> DataFrame:
    """(file, ordinal, modified, cells) from lines (file, ordinal, text, modified). ``small``: files whose profiles are broadcast.

    Most records lie in one block and are told by it alone; only the others, at the blocks' borders, meet what the blocks before
    theirs do, so that texts are shuffled once, by block."""
    profile = written(file_profile(lines, small), "files")

    def of_files(files: DataFrame) -> DataFrame:
        told = with_group(lines, files, "file", "ordinal", small=small)
        text = decoded(F.col("text"), F.col("page"))
        return told.withColumn("text", F.when(F.startswith(text, F.lit(BOM)), F.substring(text, 2, 2**31 - 1)).otherwise(text)).drop("page")

    spanning = profile.where("spans")
    told = packed(
        of_files(spanning).drop("spans"), "pieces", ["file", "ordinal.block"], spanning.agg(F.sum("n")).first()[0] or 0, pieces)
    blocks = written(block_states(told), "blocks")
    files = profile.join(blocks.where("unclosed").select("file", "unclosed").distinct(), "file", "left")
    files = files.withColumn("by_line", ~F.col("spans") | F.coalesce("unclosed", F.lit(False))).drop("unclosed")
    files = written(files, "files-told")
    by_line = of_files(files.where("by_line").drop("by_line")).select("*", "ordinal.block", "ordinal.line").drop("ordinal")
    # where cells may span lines, a null block is none that a line could lie in
    by_line = by_line.where("not spans or block is not null").drop("spans")
    in_block = with_group(told.where("block is not null"), files.where("not by_line").select("file", "n"), "file", "line", small=small)
    cut = by_line.unionByName(in_block.where("whole").select(*by_line.columns)).unionByName(records(in_block.where("not whole"), blocks))
    return cut.where(F.trim("text") != "").select(
        "file", F.struct("block", "line").alias("ordinal"), "modified",
        by_separator(F.col("sep"), lambda s: split_cells(F.col("text"), s)).alias("cells"))
