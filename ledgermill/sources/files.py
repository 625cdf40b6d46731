"""Strict, byte-faithful scans and plain sinks."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """A4: (name, bytes, sha256) of each file, read by Spark."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, raw, quotes, bytes, size): the lines of text files, without their line feed.

    A file is read in splits. Lines are counted within a split and the counts of the splits before it are added, so
    no task sees a whole file. quotes, bytes: quotation marks in front of the line and bytes of the whole file
    as far as lines hold them; size: the file's.
    """
    meta = F.col("_metadata")
    t = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    t = t.withColumn("q", F.length("raw") - F.length(F.replace("raw", F.lit('"'), F.lit(""))))
    w = Window.partitionBy("file", "split").orderBy("at")
    t = t.withColumns({"nth": F.row_number().over(w), "upto": F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    per = t.groupBy("file", "split").agg(F.count("*").alias("n"), F.sum("q").alias("k"), F.sum(F.octet_length("raw") + 1).alias("b"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per = per.select("file", "split", F.coalesce(F.sum("n").over(before), zero).alias("lines"), F.coalesce(F.sum("k").over(before), zero).alias("marks"), F.sum("b").over(Window.partitionBy("file")).alias("bytes"))
    return t.join(per, ["file", "split"]).select(
        "file", "split", F.element_at(F.split("file", "/"), -1).alias("source_file"), (F.col("lines") + F.col("nth")).alias("line_no"), "raw", (F.col("marks") + F.col("upto") - F.col("q")).alias("quotes"), "bytes", "size")


def _had_bom() -> Column:
    """The reader leaves a byte order mark out: the file is then three bytes longer than its lines."""
    return F.col("size") - F.col("bytes") >= 2


def _no_empty_file(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table without rows, whose reading stops where a file has no line at all: readers pass such files over, so the files
    that gave lines are counted."""
    t = spark.read.option("lineSep", "\n").text(path)
    n = len(t.inputFiles())
    seen = t.select(F.col("_metadata")["file_path"].alias("file")).distinct().agg(F.count("*").alias("k"))
    e = seen.select(F.when(F.col("k") < n, F.raise_error(F.lit("no header: an empty file"))).otherwise(F.lit("")).alias("e"))
    return e.where("e <> ''").select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in like.schema])


MAX_RECORD_LINES = 10_000


def _records(lines: DataFrame) -> DataFrame:
    """(source_file, line_no, raw, bom): records; a line that begins inside quotes belongs to the record before it.

    A quote that nothing closes would make one record of the rest of its file: the line after MAX_RECORD_LINES of a
    record stops the read where it is read, before any are put together.
    """
    lines = lines.withColumn("start", F.when(F.col("quotes") % 2 == 0, F.col("line_no")))
    w = Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = lines.groupBy("file", "split").agg(F.max("start").alias("last")).select("file", "split", F.max("last").over(earlier).alias("carried"))
    placed = lines.withColumn("first", F.max("start").over(w)).join(per, ["file", "split"]).withColumn("first", F.coalesce("first", "carried"))
    endless = F.raise_error(F.concat(F.lit(f"a record of more than {MAX_RECORD_LINES} lines at line "), F.col("first").cast("string"), F.lit(" of "), F.col("source_file")))
    placed = placed.withColumn("raw", F.when(F.col("line_no") - F.col("first") >= MAX_RECORD_LINES, endless).otherwise(F.col("raw")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"])
    made = placed.groupBy("file", "source_file", F.col("first").alias("line_no")).agg(F.array_join(listed, "\n").alias("raw"), F.max(_had_bom()).alias("bom"))
    return made.select("source_file", "line_no", F.regexp_replace("raw", "\r$", "").alias("raw"), "bom")


_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'


def _fields(record: Column) -> Column:
    """Fields of a record, unquoted; null where quotation marks stand elsewhere than around a field or doubled in it."""
    whole = record.rlike(f"^{_FIELD}(?:,{_FIELD})*+$")
    raw = F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f"(,{_FIELD})"), F.lit(1)), lambda f: F.substring(f, F.lit(2), F.length(f)))
    return F.when(whole, F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)))


def read_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A1, A5: every column text, untrimmed; line_no (physical, of the record's start), source_file, row_hash.

    The read stops at a header that isn't exactly `header` (a byte order mark makes it another one), a file without
    any, a record with another number of fields (an empty line has one), an open quote, a quote inside a bare field
    or text after a closing quote. Files are read in splits; only a record itself has to fit a task.
    """
    rows = _records(numbered_lines(spark, path)).withColumn("v", _fields(F.col("raw")))
    place = F.concat(F.lit(" at line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("source_file"))
    head = (F.col("line_no") == 1) & (F.col("bom") | ~F.col("v").eqNullSafe(F.array(*map(F.lit, header))))
    v = (
        F.when(head, F.raise_error(F.concat(F.lit("header mismatch"), place))).when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("broken quotes"), place)))
        .when(F.size("v") != len(header), F.raise_error(F.concat(F.lit("field count"), place))).otherwise(F.col("v"))
    )
    # the header goes last, after it was looked at
    rows = rows.withColumn("v", v).where((F.col("line_no") > 1) | (F.size("v") < 0))
    out = rows.select("line_no", "source_file", F.sha2(F.col("raw").cast("binary"), 256).alias("row_hash"), *[F.get("v", F.lit(i)).alias(h) for i, h in enumerate(header)])
    return out.unionByName(_no_empty_file(spark, path, out))


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A5: columns by header name, renamed."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def csv_record(*columns: Column) -> Column:
    """A2: one record with RFC 4180 minimal quoting."""
    one = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *[F.coalesce(one(c.cast("string")), F.lit("")) for c in columns])


def read_jsonl(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A3: string values under exactly these keys; any other line, an empty one included, stops the read."""
    lines = numbered_lines(spark, path).withColumn("raw", F.regexp_replace("raw", "\r$", ""))
    lines = lines.withColumn("v", F.when(~((F.col("line_no") == 1) & _had_bom()), F.try_parse_json("raw")))
    want = "OBJECT<" + ", ".join(f"{k}: STRING" for k in sorted(keys)) + ">"
    bad = F.raise_error(F.concat(F.lit("keys at line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("source_file")))
    ok = F.coalesce(F.schema_of_variant("v") == want, F.lit(False))
    one = lambda k: F.when(ok, F.try_variant_get("v", f"$['{k}']", "string")).otherwise(bad)
    return lines.select("line_no", "source_file", F.sha2(F.col("raw").cast("binary"), 256).alias("row_hash"), *[one(k).alias(k) for k in keys])


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """Per file the likeliest delimiter, byte order mark, line ends, non-ASCII characters."""
    lines = numbered_lines(spark, path)
    first = F.max(F.when(F.col("line_no") == 1, F.col("raw")))
    n = F.count("*")
    ended = n - (F.max("size") - F.max("bytes")).isin(-1, 2).cast("int")  # the last line may lack its line feed
    crlf = F.count_if(F.col("raw").endswith("\r"))
    facts = lines.groupBy(F.col("source_file").alias("name")).agg(
        first.alias("first"), F.max(_had_bom()).alias("bom"), crlf.alias("crlf"), (ended - crlf).alias("lf"), F.sum(F.regexp_count("raw", F.lit(r"[^\x00-\x7F]"))).alias("non_ascii"),
        F.max(~F.is_valid_utf8("raw") | F.contains("raw", F.lit("\ufffd"))).alias("broken_utf8"))
    count = {d: F.regexp_count("first", F.lit(r)) for d, r in ((",", ","), (";", ";"), ("tab", "\t"), ("|", r"\|"))}
    most = F.greatest(*count.values())
    best = F.lit(None).cast("string")
    for d, c in reversed(count.items()):
        best = F.when((c == most) & (most > 0), d).otherwise(best)
    marks = F.col("non_ascii") + F.col("bom").cast("int")
    return facts.select("name", best.alias("delimiter"), "bom", "crlf", "lf", marks.alias("non_ascii"), "broken_utf8")


def ragged(spark: SparkSession, path: str) -> DataFrame:
    """Per file the records, those whose field count isn't the header's (or whose quotes are broken), and fields that
    hold a line feed."""
    rows = _records(numbered_lines(spark, path)).withColumn("v", _fields(F.col("raw")))
    wide = rows.where("line_no = 1").select("source_file", F.size("v").alias("wide"))
    breaks = F.size(F.filter(F.coalesce("v", F.array().cast("array<string>")), lambda x: F.contains(x, F.lit("\n"))))
    return rows.join(wide, "source_file").groupBy(F.col("source_file").alias("name")).agg(
        F.count_if(F.col("line_no") > 1).alias("records"), F.count_if(F.col("v").isNull() | (F.size("v") != F.col("wide"))).alias("ragged"), F.sum(breaks).alias("fields_with_newline"))


def append_new(new: DataFrame, existing: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows whose key is in neither `existing` nor an earlier row of `new`; a key twice in `new` with
    different content stops the write."""
    twice = new.groupBy(*key).agg(F.count("*").alias("n"))
    bad = F.when(F.col("n") > 1, F.raise_error(F.concat_ws(" ", F.lit("key repeated in one run:"), *[F.col(k).cast("string") for k in key])))
    checked = new.join(twice.withColumn("_bad", bad).where("_bad is null").select(*key), key, "left_semi")
    return checked if existing is None else checked.join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The next snapshot; a new row takes the place of the stored one, all columns. A key twice in `new` stops
    the write, as in `append_new`: no order says which row would hold."""
    checked = append_new(new, None, key)
    return existing.join(checked.select(*key), key, "left_anti").select(*existing.columns).unionByName(checked.select(*existing.columns))


def rewrite(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replaced whole, or partition by partition."""
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition) if partition else w).parquet(path)


MAX_REPORT_ROWS = 10_000


def _report(df: DataFrame, order: list[str]) -> list:
    """The rows of a report in a stated order. Reports are small; one that isn't is an error, not cut."""
    rows = df.orderBy(*order).limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError(f"more than {MAX_REPORT_ROWS} rows: write the table instead")
    return rows


def report_lines(df: DataFrame, order: list[str]) -> list[str]:
    """Rows of a small report as JSON, in a stated order."""
    return [json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in _report(df, order)]


def to_markdown(df: DataFrame, order: list[str]) -> str:
    """A small report as a table."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in _report(df, order))]) + "\n"


def to_html(df: DataFrame, order: list[str]) -> str:
    """A small report as an HTML table, every value escaped."""
    cell = lambda tag, x: f"<{tag}>{'' if x is None else html.escape(str(x))}</{tag}>"
    body = ["<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in _report(df, order)]
    return "<table>\n<tr>" + "".join(cell("th", c) for c in df.columns) + "</tr>\n" + "\n".join(body) + "\n</table>\n"
