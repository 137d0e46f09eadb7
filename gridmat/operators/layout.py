"""Changing the layout of a matrix: sparse lines, blocks, dense rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmat.functions.coords import block_of, cyclic_group, n_blocks, within_block
from gridmat.functions.text import MISSING, SEPARATOR, plain_number
from gridmat.matrix import BandMatrix, CellMatrix, Matrix, VectorMatrix

# A list of entries covers at most this many index positions, so the group that
# builds it is bounded whatever the skew. Writers put the texts of the lists of
# one row or column together to one line.
LINE_SPAN = 1_000_000
# Rows of at most so many columns are put together as entries, 32 bytes each, before they become text.
GATHERED_COLUMNS = 16_000_000

# Text of one dense line must stay below the 2 GiB limit of a string.
_MAX_LINE_BYTES = 2**31 - 1


def drop_zeros(m: Matrix) -> CellMatrix:
    cells = m.cells()
    return CellMatrix(cells.df.filter(F.col("v") != 0.0), m.n_rows, m.n_cols)


def transpose(m: Matrix) -> CellMatrix:
    return m.cells().T


def block_coords(m: Matrix, row_edge: int, col_edge: int) -> DataFrame:
    """Cells with their block and their place inside it."""
    return m.cells().df.select(
        block_of(F.col("i"), row_edge).alias("bi"),
        block_of(F.col("j"), col_edge).alias("bj"),
        within_block(F.col("i"), row_edge).alias("li"),
        within_block(F.col("j"), col_edge).alias("lj"),
        "v",
    )


def cyclic_rows(m: Matrix, n_groups: int) -> DataFrame:
    """Cells with the round-robin group of their row."""
    return m.cells().df.select(cyclic_group(F.col("i"), n_groups).alias("grp"), "i", "j", "v")


def row_bands(m: Matrix, edge: int) -> DataFrame:
    """Cells with the band of consecutive rows they belong to."""
    return m.cells().df.select(block_of(F.col("i"), edge).alias("band"), "i", "j", "v")


def _collect(cells: DataFrame, line: str, along: str, span: int, ids: DataFrame | None):
    entry = F.struct(F.col(along).alias("idx"), "v")
    grouped = cells.select(
        F.col(line).alias("id"), block_of(F.col(along), span).alias("part"), entry.alias("entry")
    )
    if ids is not None:
        kind = grouped.schema["entry"].dataType
        blank = ids.select(
            F.col("id"), F.lit(0).cast("bigint").alias("part"), F.lit(None).cast(kind).alias("entry")
        )
        grouped = grouped.unionByName(blank)
    # collect_list leaves out the null entries that stand for empty lines.
    return grouped.groupBy("id", "part").agg(
        F.sort_array(F.collect_list("entry")).alias("entries")
    )


def to_csr(m: Matrix, span: int = LINE_SPAN, empty_rows: bool = True) -> DataFrame:
    """Rows as sorted entry lists: ``(id, part, entries)``.

    A row with no cell keeps its (empty) list. ``part`` is 0 as long as the
    matrix has at most ``span`` columns.
    """
    cells = m.cells().df
    ids = cells.sparkSession.range(m.n_rows) if empty_rows else None
    return _collect(cells, "i", "j", span, ids)


def to_csc(m: Matrix, span: int = LINE_SPAN) -> DataFrame:
    """Columns as sorted entry lists; a column with no cell has no list."""
    return _collect(m.cells().df, "j", "i", span, None)


def _entry_text() -> Column:
    texts = F.transform(
        "entries",
        lambda e: F.concat(e["idx"].cast("string"), F.lit(SEPARATOR), plain_number(e["v"]), F.lit(SEPARATOR)),
    )
    return F.array_join(texts, "")


def sparse_lines(collected: DataFrame) -> DataFrame:
    """Text of collected lists: ``(id, part, line)``."""
    line = F.concat(F.col("id").cast("string"), F.lit(SEPARATOR), _entry_text())
    return collected.select("id", "part", line.alias("line"))


def whole_lines(collected: DataFrame, n_along: int, span: int = LINE_SPAN) -> DataFrame:
    """One line for every id, however long: ``(id, line)``.

    The lists become text where they are; only finished texts of one id meet.
    A line that does not fit into one string (2 GiB) fails the job.
    """
    if n_along <= span:
        return sparse_lines(collected).select("id", "line")
    texts = collected.select("id", "part", _entry_text().alias("text"))
    parts = texts.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )
    too_long = F.raise_error(F.concat(F.lit("line too long for one string: id "), F.col("id").cast("string")))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    line = F.when(F.col("bytes") < _MAX_LINE_BYTES - 32, F.concat(F.col("id").cast("string"), F.lit(SEPARATOR), joined))
    return parts.select("id", line.otherwise(too_long.cast("string")).alias("line"))


def from_entries(collected: DataFrame, shape: tuple[int, int], by: str = "row") -> CellMatrix:
    """Cells of collected lines."""
    spread = collected.select("id", F.inline("entries"))
    i, j = ("id", "idx") if by == "row" else ("idx", "id")
    return CellMatrix(spread.select(F.col(i).alias("i"), F.col(j).alias("j"), "v"), *shape)


def to_sparse_pair(a: Matrix, b: Matrix, method: str) -> tuple[DataFrame, DataFrame]:
    """Operands in the layouts a method reads.

    OPB pairs columns of A with rows of B; the others rows of A with columns of B.
    """
    if method == "OPB":
        return to_csc(a), to_csr(b)
    if method in ("IPB", "naive"):
        return to_csr(a), to_csc(b)
    raise ValueError(f"unknown method {method!r}")


def _gap(entry: Column, position: Column, entries: Column) -> Column:
    """Positions left out between an entry and the one before it."""
    before = F.when(position == 0, F.lit(-1).cast("bigint")).otherwise(
        F.get(entries, position - 1)["idx"]
    )
    return (entry["idx"] - before - 1).cast("int")


def densify_rows(m: Matrix, all_rows: bool = False) -> VectorMatrix:
    """Sparse rows as full-width vectors.

    Zeros are put into the gaps between sorted entries, so a row costs its
    width once. Rows without a cell appear only with ``all_rows``.
    """
    rows = to_csr(m, span=max(m.n_cols, 1), empty_rows=all_rows)
    entries = F.col("entries")
    filled = F.flatten(
        F.transform(
            entries,
            lambda e, p: F.concat(
                F.array_repeat(F.lit(0.0), _gap(e, p, entries)), F.array(e["v"])
            ),
        )
    )
    tail = F.greatest(F.lit(0), F.lit(m.n_cols) - F.size(filled))
    vec = F.concat(filled, F.array_repeat(F.lit(0.0), tail))
    dense = rows.select("id", vec.alias("vec"))
    return VectorMatrix(dense, m.n_rows, m.n_cols, complete=all_rows)


def row_lines(m: Matrix, all_rows: bool = False, span: int = LINE_SPAN) -> DataFrame:
    """``rowId v v 0 v `` with missing cells as ``0``: ``(id, line)``.

    Pieces of a row are turned into text first, spread over the cluster; only
    the finished texts of one row meet to form its line. Stretches of missing
    cells stay counts until then: a row costs its text, not its width in
    numbers. A line that does not fit into one string (2 GiB) fails the job.
    """
    pieces = to_csr(m, span, all_rows)
    piece = pieces.select("id", "part", _piece_text(F.col("part"), F.col("entries"), m.n_cols, span).alias("text"))
    if n_blocks(m.n_cols, span) == 1:
        return piece.select("id", _one_piece_line(F.col("text")).alias("line"))
    assembled = piece.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("found"))
    return assembled.select("id", _line_of_pieces(m.n_cols, span).alias("line"))


def lines_in_place(lists: DataFrame, n_cols: int, span: int = LINE_SPAN) -> DataFrame:
    """``row_lines`` of lists that lie, whole rows together, in the partitions of ``_file``: ``(id, line)``, sorted by id there.

    Lists are put together and sorted as entries, and become text last: the text, mostly missing
    cells, is neither sent nor sorted. A row's entries must fit one task, GATHERED_COLUMNS at most.
    """
    if n_blocks(n_cols, span) == 1:
        rows = lists.sortWithinPartitions("id")
        return rows.select("id", _one_piece_line(_piece_text(F.col("part"), F.col("entries"), n_cols, span)).alias("line"))
    rows = lists.groupBy("_file", "id").agg(F.sort_array(F.collect_list(F.struct("part", "entries"))).alias("pieces"))
    text = F.transform("pieces", lambda p: F.struct(p["part"].alias("part"), _piece_text(p["part"], p["entries"], n_cols, span).alias("text")))
    found = rows.sortWithinPartitions("id").select("id", text.alias("found"))
    return found.select("id", _line_of_pieces(n_cols, span).alias("line"))


def _one_piece_line(text: Column) -> Column:
    return F.concat(F.col("id").cast("string"), F.lit(SEPARATOR), text)


def _piece_text(part: Column, entries: Column, n_cols: int, span: int) -> Column:
    """Text of a piece of a row, its missing cells included."""
    gap_text = F.lit(MISSING + SEPARATOR)
    first = part * F.lit(span).cast("bigint")
    before = lambda p: F.when(p == 0, first - 1).otherwise(F.get(entries, p - 1)["idx"])
    written = F.transform(entries, lambda e, p: F.concat(F.repeat(gap_text, (e["idx"] - before(p) - 1).cast("int")), e["v"].cast("string"), F.lit(SEPARATOR)))
    last = F.when(F.size(entries) > 0, F.element_at(entries, -1)["idx"]).otherwise(first - 1)
    tail = first + _part_width(part, n_cols, span) - last - 1
    return F.concat(F.array_join(written, ""), F.repeat(gap_text, tail.cast("int")))


def _line_of_pieces(n_cols: int, span: int) -> Column:
    """The line of the row ``id`` from its pieces ``found``, in order; a piece with no cell at all is filled in from its width alone."""
    size = F.aggregate("found", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["text"]))
    # The pieces found cover their span each; between them, missing cells take two bytes.
    covered = F.aggregate("found", F.lit(0).cast("bigint"), lambda n, p: n + _part_width(p["part"], n_cols, span))
    length = size + (F.lit(n_cols).cast("bigint") - covered) * len(MISSING + SEPARATOR)
    too_long = F.raise_error(F.concat(F.lit("line too long for one string: id "), F.col("id").cast("string")))
    # Each piece with the missing cells before it, and those after the last one.
    texts = F.transform(
        "found",
        lambda p, n: F.concat(_missing_parts(F.when(n == 0, -1).otherwise(F.get(F.col("found"), n - 1)["part"]), p["part"], n_cols, span), p["text"]),
    )
    end = _missing_parts(F.element_at("found", -1)["part"], F.lit(n_blocks(n_cols, span)).cast("bigint"), n_cols, span)
    id_text = F.concat(F.col("id").cast("string"), F.lit(SEPARATOR))
    line = F.array_join(F.concat(F.array(id_text), texts, F.array(end)), "")
    return F.when(length < _MAX_LINE_BYTES - 32, line).otherwise(too_long.cast("string"))


def _part_width(part: Column, n_along: int, span: int) -> Column:
    """Positions of a part; the last one may be shorter."""
    first = part * F.lit(span).cast("bigint")
    return F.least(F.lit(span).cast("bigint"), F.lit(n_along).cast("bigint") - first)


def _missing_parts(after: Column, until: Column, n_along: int, span: int) -> Column:
    """Text of all the missing cells of the parts strictly between two parts."""
    n = F.least(until * F.lit(span).cast("bigint"), F.lit(n_along).cast("bigint")) - (after + 1) * F.lit(span).cast("bigint")
    return F.repeat(F.lit(MISSING + SEPARATOR), n.cast("int"))


def row_runs(m: Matrix, span: int = LINE_SPAN, all_rows: bool = False) -> DataFrame:
    """Rows as runs: ``(id, part, gaps, vals, tail)``.

    ``gaps`` are the missing cells before each value, counted from the value
    before it or the start of the part, ``tail`` those after the last one. A
    part covers ``span`` columns, and only parts with a value are there, so a
    row takes the room of its values however wide it is.
    """
    cells = m.cells().df
    pieces = _collect(cells, "i", "j", span, cells.sparkSession.range(m.n_rows) if all_rows else None)
    first = F.col("part") * F.lit(span).cast("bigint")
    entries = F.col("entries")
    before = lambda p: F.when(p == 0, first - 1).otherwise(F.get(entries, p - 1)["idx"])
    gaps = F.transform(entries, lambda e, p: e["idx"] - before(p) - 1)
    last = F.when(F.size(entries) > 0, F.element_at(entries, -1)["idx"]).otherwise(first - 1)
    tail = first + _part_width(F.col("part"), m.n_cols, span) - last - 1
    return pieces.select("id", "part", gaps.alias("gaps"), F.col("entries.v").alias("vals"), tail.alias("tail"))


def from_runs(runs: DataFrame, shape: tuple[int, int], span: int = LINE_SPAN) -> CellMatrix:
    """Cells of rows kept as runs."""
    spread = runs.select("id", "part", F.posexplode(F.arrays_zip("gaps", "vals")).alias("p", "e"))
    until = Window.partitionBy("id", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("part") * F.lit(span).cast("bigint")
    j = first + F.sum(F.col("e.gaps") + 1).over(until) - 1
    return CellMatrix(spread.select(F.col("id").alias("i"), j.alias("j"), F.col("e.vals").alias("v")), *shape)


def densify_bands(m: Matrix, width: int) -> DataFrame:
    """Rows with a cell in bands of ``width`` columns, dense inside a band: ``(i, band, vec)``.

    A band is made by itself, so a task holds one band of one row, however wide
    the row is. Bands without a value are left out.
    """
    runs = row_runs(m, span=width)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    filled = F.flatten(F.transform("gaps", lambda g, p: F.concat(zeros(g), F.array(F.get(F.col("vals"), p)))))
    vec = F.concat(filled, zeros(F.col("tail")))
    return runs.select(F.col("id").alias("i"), F.col("part").alias("band"), vec.alias("vec"))


def band_regroup(m: BandMatrix) -> VectorMatrix:
    """Finished bands of each row side by side; nothing is summed, and bands that adjoin already are not moved."""
    return m.rows()
