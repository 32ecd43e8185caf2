"""From cells and lines to lists: column election, shape, hash, titles, academic sheets, pasted text.

cells: file_id, sheet_idx, sheet, row, col, text (zero-based rows and columns, texts trimmed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import values as V

MIN_HITS, MIN_DENSITY, MIN_DISTINCT = 2, 0.5, 0.35
#: What the headings of grade and branch columns contain.
CGPA_HINTS = ("cgpa", "gpa", "cg pa", "grade point", "current cgpa")
BRANCH_HINTS = ("brach", "branch", "specialisation", "specialization", "programme", "program")
TITLE_CHARS, TITLES = 120, 3
SHEET = ["file_id", "sheet_idx"]


def column_stats(cells: DataFrame) -> DataFrame:
    """(file_id, sheet_idx, col, filled, neo, reg, name, distinct): hits count once, in that order."""
    t = F.col("text")
    neo, reg = V.neo_id(t).isNotNull(), V.reg_no(t).isNotNull()
    return cells.where(t != "").groupBy(*SHEET, "col").agg(
        F.count("*").alias("filled"),
        F.count_if(neo).alias("neo"),
        F.count_if(~neo & reg).alias("reg"),
        F.count_if(~neo & ~reg & V.looks_like_name(t)).alias("name"),
        F.count_distinct("text").alias("distinct"),
    )


def elect(stats: DataFrame) -> DataFrame:
    """(file_id, sheet_idx, neo_col, reg_col, name_col): identifier columns by most hits, the name column
    beside them by distinctness; the rightmost wins a tie."""
    dense = lambda hits: (F.col(hits) >= MIN_HITS) & (F.col(hits) / F.col("filled") >= MIN_DENSITY)
    best = lambda hits: F.max_by(F.when(dense(hits), F.col("col")), F.when(dense(hits), F.struct(hits, "col")))
    ids = stats.groupBy(*SHEET).agg(best("neo").alias("neo_col"), best("reg").alias("reg_col"))
    share = F.col("distinct") / F.col("filled")
    other = ~F.col("col").eqNullSafe(F.col("neo_col")) & ~F.col("col").eqNullSafe(F.col("reg_col")) & (F.col("neo_col").isNotNull() | F.col("reg_col").isNotNull())
    fit = dense("name") & other & (share >= MIN_DISTINCT)
    names = stats.join(ids, SHEET).groupBy(*SHEET).agg(F.max_by(F.when(fit, F.col("col")), F.when(fit, F.struct(share.alias("s"), F.col("col")))).alias("name_col"))
    return ids.join(names, SHEET)


def extract(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """(file_id, sheet_idx, row, neo_id, reg_no, name) of rows that hold an identifier or a name."""
    met = cells.join(layout, SHEET)
    at = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("text")))
    rows = met.groupBy(*SHEET, "row").agg(at("neo_col").alias("n"), at("reg_col").alias("r"), at("name_col").alias("m"))
    out = rows.select(*SHEET, "row", V.neo_id(F.col("n")).alias("neo_id"), V.reg_no(F.col("r")).alias("reg_no"), F.when(V.looks_like_name(F.col("m")), F.col("m")).alias("name"))
    return out.where("neo_id is not null or reg_no is not null")


def content_hash(neo: Column, reg: Column) -> Column:
    """SHA-256 of two arrays of identifiers: sorted, each followed by 0x1F, the kinds parted by 0x1E."""
    each = lambda xs: F.array_join(F.transform(F.array_sort(F.array_distinct(xs)), lambda x: F.concat(x, F.char(F.lit(31)))), "")
    return F.sha2(F.concat(each(neo), F.char(F.lit(30)), each(reg)), 256)


def files(parsed: DataFrame) -> DataFrame:
    """(file_id, n_neo, n_reg, n_linked, shape, primary_key, student_count, content_hash)."""
    rows = parsed.groupBy("file_id").agg(
        F.collect_set("neo_id").alias("neo"), F.collect_set("reg_no").alias("reg"),
        F.count_if(F.col("neo_id").isNotNull() & F.col("reg_no").isNotNull()).alias("n_linked"),
    )
    a, b = F.size("neo"), F.size("reg")
    shape = F.when(F.col("n_linked") >= 2, "linked").when(a > 0, "neo_id_only").when(b > 0, "reg_no_only").otherwise("unrecognised")
    key = F.when((a >= b) & (a > 0), V.NEO).when(b > 0, V.REG)
    count = F.when(key == V.NEO, a).when(key == V.REG, b).otherwise(0)
    return rows.select("file_id", a.alias("n_neo"), b.alias("n_reg"), "n_linked", shape.alias("shape"), key.alias("primary_key"), count.alias("student_count"), content_hash(F.col("neo"), F.col("reg")).alias("content_hash"))


def members(parsed: DataFrame) -> DataFrame:
    """(file_id, kind, value), distinct: pairs of one row are kept by edges, not here."""
    long = parsed.select("file_id", F.explode(F.array(F.struct(F.lit(V.NEO).alias("kind"), F.col("neo_id").alias("value")), F.struct(F.lit(V.REG).alias("kind"), F.col("reg_no").alias("value")))).alias("x"))
    return long.select("file_id", "x.kind", "x.value").where("value is not null").distinct()


def origins(parsed: DataFrame, layout: DataFrame, cells: DataFrame) -> DataFrame:
    """(file_id, kind, value, sheet_idx, row, column, header): the first sighting of each identifier; rows
    count from 1, columns by letter."""
    seen = parsed.join(layout, SHEET).select(
        "file_id", "sheet_idx", "row",
        F.explode(F.array(F.struct(F.lit(V.NEO).alias("kind"), F.col("neo_id").alias("value"), F.col("neo_col").alias("c")), F.struct(F.lit(V.REG).alias("kind"), F.col("reg_no").alias("value"), F.col("reg_col").alias("c")))).alias("x"),
    ).where("x.value is not null")
    first = seen.groupBy("file_id", "x.kind", "x.value").agg(F.min(F.struct("sheet_idx", "row", "x.c")).alias("at")).select("file_id", "kind", "value", "at.*")
    return first.join(headings(cells, layout), ["file_id", "sheet_idx", "c"], "left").select("file_id", "kind", "value", "sheet_idx", (F.col("row") + 1).alias("row"), V.column_letter(F.col("c")).alias("column"), "header")


def clip(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, TITLE_CHARS)


def first_data(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """(file_id, sheet_idx, first): the first row with an identifier in an elected column."""
    met = cells.join(layout, SHEET)
    hit = ((F.col("col") == F.col("neo_col")) & V.neo_id(F.col("text")).isNotNull()) | ((F.col("col") == F.col("reg_col")) & V.reg_no(F.col("text")).isNotNull())
    return met.where(hit).groupBy(*SHEET).agg(F.min("row").alias("first"))


def headings(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """(file_id, sheet_idx, c, header): the nearest text above the data of each column that is no id."""
    t = F.col("text")
    above = cells.join(first_data(cells, layout), SHEET).where((F.col("row") < F.col("first")) & (t != "") & V.identifier_kind(t).isNull())
    return above.groupBy(*SHEET, F.col("col").alias("c")).agg(clip(F.max_by("text", "row")).alias("header"))


def titles(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """(file_id, sheet_idx, row, title): rows above the headings with one or two cells of words, at most
    three of a sheet. The nearest row with text above the data holds the headings."""
    t = F.col("text")
    above = cells.join(first_data(cells, layout), SHEET).where((F.col("row") < F.col("first")) & (t != ""))
    top = above.groupBy(*SHEET).agg(F.max("row").alias("heads"))
    words = F.length(F.regexp_replace(t, r"[^\p{IsAlphabetic}]", "")) >= 3
    rows = above.join(top, SHEET).where((F.col("row") < F.col("heads")) & words).groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("x"))
    lines = rows.where(F.size("x").between(1, 2)).select(*SHEET, "row", clip(F.array_join(F.transform("x", lambda c: c["text"]), " ")).alias("title"))
    w = Window.partitionBy(*SHEET).orderBy("row")
    return lines.withColumn("k", F.row_number().over(w)).where(F.col("k") <= TITLES).drop("k")


def first_headers(cells: DataFrame, most: int = 8) -> DataFrame:
    """(file_id, sheet_idx, headers): the first row's texts, for sheets in which nothing was elected."""
    top = cells.where((F.col("row") == 0) & (F.col("text") != "")).groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("x"))
    return top.select(*SHEET, F.slice(F.transform("x", lambda c: c["text"]), 1, most).alias("headers"))


def academic_rows(cells: DataFrame) -> DataFrame:
    """(file_id, row, reg_no, name, cgpa, branch): from the first sheet with a grade column. Row 0 holds the
    headings; the secondary-identifier column has the most hits (two or more), names stand in the
    most distinct column of names."""
    t = F.col("text")
    height = cells.groupBy(*SHEET).agg((F.max("row") + 1).alias("height")).where("height >= 2")
    head = cells.where("row = 0").withColumn("h", F.lower("text"))
    hinted = lambda hints: F.min(F.when(F.col("h").rlike("|".join(hints)), F.col("col")))
    cols = head.groupBy(*SHEET).agg(hinted(CGPA_HINTS).alias("cgpa_col"), hinted(BRANCH_HINTS).alias("branch_col"))
    per = cells.where(t != "").groupBy(*SHEET, "col").agg(F.count_if(V.reg_no(t).isNotNull()).alias("regs"), F.count_if(V.looks_like_name(t)).alias("names"), F.count("*").alias("filled"), F.count_distinct("text").alias("distinct"))
    reg = per.groupBy(*SHEET).agg(F.max_by("col", F.struct("regs", "col")).alias("reg_col"), F.max("regs").alias("regs")).where("regs >= 2")
    met = per.join(height, SHEET).join(reg.select(*SHEET, "reg_col"), SHEET).join(cols, SHEET, "left")
    share = F.col("distinct") / F.col("filled")
    fit = (F.col("names") * 2 >= F.col("height")) & (F.col("col") != F.col("reg_col")) & ~F.col("col").eqNullSafe(F.col("branch_col")) & (share >= MIN_DISTINCT)
    layout = met.groupBy(*SHEET, "reg_col", "cgpa_col", "branch_col").agg(F.max_by(F.when(fit, F.col("col")), F.when(fit, F.struct(share.alias("s"), F.col("col")))).alias("name_col")).where("cgpa_col is not null")
    one = layout.groupBy("file_id").agg(F.min_by(F.struct("sheet_idx", "reg_col", "cgpa_col", "branch_col", "name_col"), "sheet_idx").alias("x")).select("file_id", "x.*")
    at = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("text")))
    rows = cells.where("row > 0").join(one, SHEET).groupBy("file_id", "row").agg(at("reg_col").alias("r"), at("name_col").alias("n"), at("cgpa_col").alias("g"), at("branch_col").alias("b"))
    return rows.select("file_id", "row", V.reg_no(F.col("r")).alias("reg_no"), F.when(V.looks_like_name(F.col("n")), F.col("n")).alias("name"), V.sane_cgpa(F.col("g").try_cast("double")).alias("cgpa"), F.when(F.col("b") != "", F.col("b")).alias("branch")).where("reg_no is not null")


def pasted_rows(texts: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(id, line, at, kind, value): every identifier in pasted text, each a row of its own; lines from 1."""
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("k", "line_text"))
    words = lines.select(id_col, (F.col("k") + 1).alias("line"), F.posexplode(F.regexp_extract_all("line_text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("at", "word"))
    w = F.col("word")
    return words.select(id_col, "line", "at", V.identifier_kind(w).alias("kind"), F.coalesce(V.neo_id(w), V.reg_no(w)).alias("value")).where("kind is not null")


def pasted_titles(texts: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(id, unread_lines, titles): lines with three letters or more and no identifier, and the first three."""

    def unread(t):
        found = F.exists(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: V.identifier_kind(w).isNotNull())
        return ~found & (F.length(F.regexp_replace(t, r"[^\p{IsAlphabetic}]", "")) >= 3)

    lines = texts.select(id_col, F.filter(F.split(text_col, "\r?\n"), unread).alias("x")).where(F.size("x") > 0)
    return lines.select(id_col, F.size("x").cast("long").alias("unread_lines"), F.transform(F.slice("x", 1, TITLES), lambda t: F.substring(F.trim(t), 1, TITLE_CHARS)).alias("titles"))


#: Bytes of the longest text that is read as a paste.
MAX_PASTE = 1 << 20


def pasted_errors(texts: DataFrame, id_col: str = "file_id", text_col: str = "text", most: int = MAX_PASTE) -> DataFrame:
    """(id, error): too_large for texts above `most` bytes, no_identifiers for others in which none stands."""
    words = F.regexp_extract_all(text_col, F.lit("[A-Za-z0-9]+"), F.lit(0))
    none = ~F.coalesce(F.exists(words, lambda w: V.identifier_kind(w).isNotNull()), F.lit(False))
    error = F.when(F.octet_length(text_col) > most, "too_large").when(none, "no_identifiers")
    return texts.select(id_col, error.alias("error")).where("error is not null")
