"""CSV files in, CSV or Parquet tables out."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F, types as T

from ..functions.lexicon import NULL_TOKENS
from ..functions.names import col, unique_names
from ..operators.clean import count_per_column, type_counters, whole_type
from ..session import materialize

# Charset names Spark's CSV reader knows, and those that need the Java charset table.
_JAVA_CHARSETS = {"cp949": "MS949", "ms949": "MS949", "euc-kr": "EUC-KR", "euckr": "EUC-KR"}
#: Charsets in which no byte of another character looks like a line break, a comma or a quote.
_BYTE_CHARSETS = {"UTF-8", "US-ASCII", "ISO-8859-1", "MS949", "WINDOWS-1252", "LATIN1"}
_SPARK_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf8": "UTF-8", "ascii": "US-ASCII", "latin-1": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def read_null_tokens(df: DataFrame) -> DataFrame:
    """Turn the texts that stand for a missing cell (``NA``, ``null``, ``NaN`` …) into null."""
    return df.select(*[
        F.when(~col(f.name).isin(NULL_TOKENS), col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name)
        for f in df.schema.fields
    ])


def read_csv_table(
    spark: SparkSession, path: str | Sequence[str], encoding: str | None = None, typed: bool = True, multiline: bool = True,
    source_file: str | None = None, ragged: str | None = None,
) -> DataFrame:
    """Read CSV with a header row: all columns as text, missing-cell texts as null, then typed by content.

    One scan looks at every file's encoding, unless ``encoding`` names it, and for quoted cells that go on in the next
    line. Files without such cells are split over tasks as they are; in the others the lines of a record are put
    together first (:func:`joined_records`), also by many tasks. ``multiline=False`` raises instead of joining lines.
    Columns get a number, boolean or integer type only when every value of them parses; dates stay text.
    ``source_file`` names a further column with the path of the file, ``ragged`` one that marks rows with a filled cell
    beyond the header's last one; missing cells at the end of a row are null.
    """
    files = inspect_files(spark, path)
    kind = F.when(F.col("encoding") == "utf-8-sig", "utf-8").otherwise(F.col("encoding")) if encoding is None else F.lit(encoding)
    found = materialize(files.select("path", kind.alias("kind"), (F.col("open_lines") > 0).alias("joined")), "files")
    groups = [tuple(r) for r in found.groupBy("kind", "joined").count().orderBy("kind", "joined").select("kind", "joined").collect()]  # twelve at most
    if not multiline and any(joined for _, joined in groups):
        raise ValueError(f"quotes that span lines below {path!r}; read with multiline=True")
    parts = []
    for charset, joined in groups or [(encoding or "utf-8", False)]:
        # Spark skips a byte-order mark itself, so only the charset matters.
        paths = path if len(groups) < 2 else [r[0] for r in found.filter((F.col("kind") == charset) & (F.col("joined") == joined)).select("path").collect()]
        parts.append(_read_raw(spark, paths, charset, joined, source_file, ragged))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return infer_types(raw) if typed else raw


def charset_of(spark: SparkSession, encoding: str) -> str:
    """Name of an encoding for Spark's reader; switches the Java charset table on where that is needed."""
    name = encoding.lower()
    if name in _JAVA_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        spark.conf.set("spark.sql.legacy.codingErrorAction", "true")  # unreadable bytes become marks, as in the CSV reader
    return _JAVA_CHARSETS.get(name) or _SPARK_CHARSETS.get(name) or encoding


def _read_raw(
    spark: SparkSession, path: str | Sequence[str], encoding: str, joined: bool, source_file: str | None = None, ragged: str | None = None
) -> DataFrame:
    charset, paths = charset_of(spark, encoding), path if isinstance(path, str) else list(path)
    # Lines can be told apart before decoding only where a line break is the one byte; other charsets are read file by file.
    by_lines = charset.upper().replace("_", "-") in _BYTE_CHARSETS
    # Quotes are doubled inside quoted cells, as spreadsheet programs write them.
    options = {"escape": '"', "nullValue": ""}
    reader = spark.read.options(header=True, encoding=charset, multiLine=joined or not by_lines, **options)
    names = unique_names(reader.csv(paths).columns)
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])  # one more than the header has
    if joined and by_lines:
        records = joined_records(stored_lines(spark, paths, charset))
        read = records.select("path", F.from_csv("record", cells.toDDL(), options).alias("cells")).select("path", "cells.*")
    else:
        read = reader.schema(cells).csv(paths).select(F.col("_metadata.file_path").alias("path"), "*")
    tags = [F.col("path").alias(source_file)] if source_file else []
    tags += [F.col(f"c{len(names)}").isNotNull().alias(ragged)] if ragged else []
    table = read_null_tokens(read.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *tags))
    # Types and cleaning measure the table before they use it; stored, the lines are put together once.
    return materialize(table, "records") if joined and by_lines else table


def _line_states(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell: if it begins outside of one, and if it begins inside of one.

    A cell is quoted if a quote is its first character; a quote that closes it stands before a comma or the line's end;
    doubled quotes are text.
    """
    bare = F.replace(F.regexp_replace(line, "\\A\ufeff|\r\\z", ""), F.lit('""'), F.lit(""))
    opens = lambda text: F.regexp_replace(text, '(^|,)"[^"]*"(?=,|$)', "$1").rlike('(^|,)"')
    closing = '^[^"]*"(?=,|$)'
    inside = ~bare.rlike(closing) | opens(F.regexp_replace(bare, closing, ""))
    quoted = F.contains(line, F.lit('"'))
    return F.when(quoted, opens(bare)).otherwise(F.lit(False)), F.when(quoted, inside).otherwise(F.lit(True))


def stored_lines(spark: SparkSession, path: str | list[str], charset: str = "UTF-8") -> DataFrame:
    """(path, block, place, line, out, in): the lines of some files, stored, as the file system cuts them into blocks.

    ``place`` orders the lines of a block. ``out`` and ``in`` say whether a quoted cell is open behind the line, if none
    or if one is open before it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        (F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)).alias("line"),
    )
    out, in_ = _line_states(F.col("line"))
    return materialize(lines.select("*", out.alias("out"), in_.alias("in")), "lines")


def _running_state(order: WindowSpec, before: Column) -> tuple[Column, Column]:
    """For the rows of a window with (out, in): a column to be named ``turns``, and over it whether a cell is open behind
    the row. That follows from the last row that settles it and the number of turns since."""
    settled = F.when(F.col("out") == F.col("in"), F.col("out"))
    turns = F.sum(F.when(F.col("out") & ~F.col("in"), 1).otherwise(0)).over(order)
    last = F.last(F.when(settled.isNotNull(), F.struct(settled.alias("open"), F.col("turns").alias("turns"))), True).over(order)
    return turns, F.coalesce(last["open"], before) != ((F.col("turns") - F.coalesce(last["turns"], F.lit(0))) % 2 == 1)


def joined_records(lines: DataFrame) -> DataFrame:
    """(path, record): the records of stored lines without each file's first one, the header, and without empty lines.

    Each block sums up what it does to an open cell, and where it would open one. These sums, one row per block, run
    over the blocks of a file, so that every block knows what it begins with; its lines then follow by themselves. Only
    the lines of records that have several are grouped.
    """
    edge = (F.col("out") | ~F.col("in"))
    edges = F.array_sort(F.collect_list(F.when(edge, F.struct("place", "out", "in"))))
    # The state behind a block and the line that opened the cell, for both states before it.
    step = lambda state, at, e: (F.when(state, e["in"]).otherwise(e["out"]), F.when(state, at).otherwise(e["place"]))
    fold = F.aggregate(
        F.col("edges"), F.struct(F.lit(False).alias("out"), F.lit(None).cast("long").alias("out_at"), F.lit(True).alias("in"), F.lit(None).cast("long").alias("in_at")),
        lambda a, e: F.struct(
            step(a["out"], a["out_at"], e)[0].alias("out"), step(a["out"], a["out_at"], e)[1].alias("out_at"),
            step(a["in"], a["in_at"], e)[0].alias("in"), step(a["in"], a["in_at"], e)[1].alias("in_at"),
        ),
    )
    filled = ~F.col("line").isin("", "\r")
    blocks = lines.groupBy("path", "block").agg(edges.alias("edges"), F.min(F.when(filled, F.col("place"))).alias("first")).select("path", "block", "first", fold.alias("f")).select("path", "block", "first", "f.*")
    in_file = Window.partitionBy("path").orderBy("block")  # one row per block
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    turns, state = _running_state(in_file, F.lit(False))
    blocks = blocks.withColumn("turns", turns).withColumn("behind", state)
    blocks = blocks.withColumn("before", F.lag("behind", 1, False).over(in_file))
    opened = F.when(F.col("behind"), F.when(F.col("before"), F.col("in_at")).otherwise(F.col("out_at")))
    blocks = blocks.withColumn("opened", F.when(opened.isNotNull(), F.struct(F.col("block").alias("block"), opened.alias("place"))))
    blocks = blocks.select(
        F.col("path").alias("b_path"), F.col("block").alias("b_block"), "before", F.last("opened", True).over(earlier).alias("from_before"),
        # The header is the first line with anything in it, and the lines that belong to its record.
        (F.count("first").over(earlier) == 0).alias("leading"), "first",
    )
    in_block = Window.partitionBy("path", "block").orderBy("place")
    known = lines.join(blocks, (F.col("path") == F.col("b_path")) & (F.col("block") == F.col("b_block"))).drop("b_path", "b_block")
    turns, state = _running_state(in_block, F.col("before"))
    known = known.withColumn("turns", turns).withColumn("open_behind", state)
    known = known.withColumn("open_before", F.coalesce(F.lag("open_behind").over(in_block), F.col("before")))
    own = F.when(~F.col("open_before"), F.struct("block", "place"))
    known = known.withColumn("start", F.coalesce(F.last(own, True).over(in_block), F.col("from_before")))
    is_header = F.col("leading") & F.coalesce((F.col("start.block") == F.col("block")) & (F.col("start.place") == F.col("first")), F.lit(False))
    known = known.select("path", "block", "place", "line", "start", (F.col("open_before") | F.col("open_behind")).alias("several"), is_header.alias("is_header"))
    single = known.where(~F.col("several") & ~F.col("is_header") & filled).select("path", F.regexp_replace("line", "\r\\z", "").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "line")))
    grouped = known.where("several").groupBy("path", "start").agg(pieces.alias("pieces"), F.bool_or("is_header").alias("is_header"))
    text = F.array_join(F.transform("pieces", lambda p: p["line"]), "\n")
    return single.unionByName(grouped.where(~F.col("is_header")).select("path", F.regexp_replace(text, "\r\\z", "").alias("record")))


def column_types(df: DataFrame) -> dict[str, str]:
    """Type per text column: ``long``, ``double`` or ``boolean`` if every value parses, else ``string``."""
    texts = {f.name: col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    types = {}

    def tests(value: Column, digits: Column) -> dict[str, Column]:
        return {"nonnull": value.isNotNull(), **type_counters(value, digits)}

    for name, counts in count_per_column(df, texts, tests, F.trim).items():
        types[name] = whole_type(counts) or "string"
    return types


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the type all their values have; one aggregate, then a lazy projection."""
    types = column_types(df)
    return df.select(*[
        col(n) if types.get(n, "string") == "string" else F.trim(col(n)).try_cast(types[n]).alias(n) for n in df.columns
    ])


# The bytes of charsets, each byte read as the character of its number. Pairs of cp949 that running
# Korean text is made of (syllables and marks of the national standard), then all its other pairs.
_HIGH = "[\\x80-\\xff]"
_UTF8 = "[\\xc2-\\xdf][\\x80-\\xbf]|[\\xe0-\\xef][\\x80-\\xbf]{2}|[\\xf0-\\xf4][\\x80-\\xbf]{3}"
_CP949_USUAL = "[\\xb0-\\xc8\\xa1-\\xac][\\xa1-\\xfe]"
_CP949_OTHER = "[\\x81-\\xfd][A-Za-z\\x81-\\xfe]"
_LATIN_LETTER = f"(?<!{_HIGH})[\\xa0-\\xff](?!{_HIGH})"
_LATIN_PAIR = f"(?<!{_HIGH})[\\xc0-\\xff]{{2}}(?!{_HIGH})"
#: What a byte of a seldom pair counts against one of a usual pair.
_SELDOM = 0.4


def _removed(text: Column, pattern: str, keep: str = "") -> Column:
    """Number of characters that go when the matches of a pattern are replaced by ``keep``."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, keep))


def short_ascii(text: Column) -> Column:
    """A text whose ASCII runs are cut to their first character and a blank."""
    return F.regexp_replace(text, "([\\x00-\\x7f])[\\x00-\\x7f]+", "$1 ")


def inspect_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, encoding, score, open_lines) per file with content: ``utf-8-sig``, ``utf-8``, ``cp949``, ``latin-1``,
    ``utf-16``, ``utf-16-le`` or ``utf-16-be``; lines that open or close a quoted cell which goes on in another line.

    One scan, whole files, in parallel. The bytes beyond ASCII are counted by the pairs and places they stand in, and
    the score is the share of them that is as usual in the charset; the best charset wins, of equal ones the first
    of utf-8, cp949, latin-1. A file that is ASCII throughout is utf-8 with score 1, and so is one that is valid
    UTF-8. Text of two bytes a character is known by its zero bytes, and its byte order by the mark or by the
    file's first character. Spark skips a byte-order mark of UTF-8, so an uncompressed file with one has fewer bytes in
    its lines than in all.
    """
    out, in_ = _line_states(F.col("value"))
    lines = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        F.is_valid_utf8("value").alias("valid"), (F.octet_length("value") + 1).alias("bytes"), (out | ~in_).cast("long").alias("open"), "value",
        F.when(~F.is_valid_utf8("value"), short_ascii(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))).alias("__bytes"),
    )
    # Valid lines are not looked at byte by byte: their bytes beyond ASCII fit UTF-8 and nothing else.
    # No pattern takes in more than bytes beyond ASCII and one byte behind them, so of longer ASCII runs two are enough.
    single = F.col("__bytes")
    odd = lambda count: F.when(~F.col("valid"), count).otherwise(F.lit(0))
    beyond = F.when(F.col("valid"), F.octet_length("value") - F.char_length("value"))
    usual = _removed(single, f"(?:{_CP949_USUAL})|({_CP949_OTHER})", "$1")
    other = _removed(single, f"({_CP949_USUAL})|(?:{_CP949_OTHER})", "$1")
    letters, pairs = _removed(single, _LATIN_LETTER), _removed(single, _LATIN_PAIR)
    zeros = F.contains("value", F.lit("\0"))
    head = F.substring(F.col("value").cast("binary"), 1, 2)
    files = lines.groupBy("path").agg(
        F.bool_and("valid").alias("valid"), (F.sum("bytes") < F.max("size")).alias("mark"), F.sum("open").alias("open_lines"),
        F.sum(beyond.cast("long")).alias("fits"), F.sum(F.coalesce(beyond, _removed(single, _HIGH)).cast("long")).alias("high"),
        F.sum(odd(_removed(single, _UTF8)).cast("long")).alias("utf8"),
        F.sum(odd(usual + other * F.lit(_SELDOM))).alias("cp949"), F.sum(odd(letters + pairs * F.lit(_SELDOM))).alias("latin"),
        F.avg(zeros.cast("int")).alias("wide"), F.min_by(F.hex(head), "place").alias("head"),
    )
    high = F.greatest("high", F.lit(1))
    share = lambda count: F.round(F.least(count / high, F.lit(1.0)), 4)
    first, second = F.substring("head", 1, 2), F.substring("head", 3, 2)
    syllable = lambda byte: byte.between("AC", "D7")
    wide = (
        F.when(F.col("head").isin("FFFE", "FEFF"), "utf-16")
        .when(first == "00", "utf-16-be").when(second == "00", "utf-16-le")
        .when(syllable(first) & ~syllable(second), "utf-16-be").otherwise("utf-16-le")
    )
    eight = F.when(F.col("valid"), F.lit(1.0)).otherwise(share(F.coalesce("fits", F.lit(0)) + F.col("utf8")))
    # Both names of a score are compared in order, so the first of equal ones stays.
    best = F.array_max(F.array(
        F.struct(eight.alias("score"), F.lit(3).alias("rank"), F.when(F.col("mark") & F.col("valid"), "utf-8-sig").otherwise("utf-8").alias("name")),
        F.struct(share(F.col("cp949")).alias("score"), F.lit(2).alias("rank"), F.lit("cp949").alias("name")),
        F.struct(share(F.col("latin")).alias("score"), F.lit(1).alias("rank"), F.lit("latin-1").alias("name")),
    ))
    # In text of two bytes a character every line break brings a zero byte, so nearly all lines have one.
    found = F.when(F.col("wide") > 0.5, F.struct(F.col("wide").alias("score"), wide.alias("name"))).otherwise(F.struct(best["score"].alias("score"), best["name"].alias("name")))
    return files.select("path", found["name"].alias("encoding"), F.round(found["score"], 4).alias("score"), "open_lines")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, score) per file below ``path``, as :func:`inspect_files` finds them; a score near 1 is a sure one."""
    return inspect_files(spark, path).select("path", "encoding", "score")


def output_path(source: str, suffix: str = "_clean") -> str:
    """Name for a result beside its source: ``a.csv`` → ``a_clean.csv``; unknown extensions become ``.csv``."""
    stem, extension = os.path.splitext(source)
    known = extension.lower() in (".csv", ".txt", ".parquet")
    return f"{stem}{suffix}{extension}" if known else f"{stem}{suffix}{extension}.csv"


def write_table(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite") -> str:
    """Write a table as a folder of part files: CSV with header, or Parquet when the path says so."""
    format = format or ("parquet" if path.lower().endswith(".parquet") else "csv")
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)
    return path
