"""Tab-separated interval sources, read with spark.read.text; .gz is read natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_COORDINATE = 2**31 - 1
MAX_COPIES = 1_000_000
FEW = 4  # operations of a CIGAR that are added up without a loop


class InvalidInput(ValueError):
    """The input's shape rules a result out; `result` holds the report made so far."""

    def __init__(self, message: str, result: dict | None = None):
        super().__init__(message)
        self.result = result or {}


def integer(field: Column) -> Column:
    """A whole-field integer: no plus sign, no blanks, no suffix; null otherwise."""
    digit = lambda at: field.substr(at, 1).between("0", "9")  # noqa: E731  the cast itself lets blanks and a plus sign pass
    return F.when((digit(1) | field.startswith("-")) & digit(-1), field.try_cast("bigint"))


def once(d: DataFrame, /, **columns: Column) -> DataFrame:
    """d with columns worked out once a row.  Filters and projections are not moved below a generator; below a
    projection they are, and then repeat its expressions wherever they use one."""
    return d.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _no_return(value: str) -> Column:
    return F.when(F.col(value).endswith("\r"), F.left(value, F.char_length(value) - 1)).otherwise(F.col(value))


def _lines(spark: SparkSession, path: str, browser: bool = True) -> DataFrame:
    d = spark.read.text(path).select(_no_return("value").alias("line"))
    skip = (F.col("line") == "") | F.col("line").startswith("#") | F.col("line").startswith("track")
    if browser:
        skip = skip | F.col("line").startswith("browser")
    return once(d.filter(~skip), f=F.split("line", "\t"))


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def _bounds(start: Column, stop: Column) -> Column:
    return start.isNotNull() & stop.isNotNull() & (start >= 0) & (stop >= start) & (stop <= MAX_COORDINATE)


def fragment_bed(spark: SparkSession, path: str, with_counts: bool = False) -> DataFrame:
    """contig, start, stop, n, malformed; column 5 is a copy count only on request."""
    d = once(_lines(spark, path), start=integer(_field(1)), stop=integer(_field(2)), n=integer(_field(4)) if with_counts else F.lit(1).cast("bigint"))
    ok = (F.size("f") >= 3) & _bounds(F.col("start"), F.col("stop")) & (F.coalesce("n", F.lit(0)).between(1, MAX_COPIES))
    return d.select(_field(0).alias("contig"), "start", "stop", "n", (~F.coalesce(ok, F.lit(False))).alias("malformed"))


def ordered_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop, rec_idx of a fragment BED in the order of its lines, for strict readers.  A
    file's pieces are read in their order, so the running number follows the lines."""
    d = _lines(spark, path, browser=False)
    return d.select(_field(0).alias("contig"), integer(_field(1)).alias("start"), integer(_field(2)).alias("stop"), F.monotonically_increasing_id().alias("rec_idx"))


def contig_lengths(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """df with the length of each row's contig, -1 where it is unknown."""
    return df.join(contigs.select("contig", "contig_length"), "contig", "left").withColumn("contig_length", F.coalesce("contig_length", F.lit(-1).cast("bigint")))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text file, as read_bam() gives them; lines are read wherever Spark splits them."""
    d = spark.read.text(path).select(_no_return("value").alias("line"), F.monotonically_increasing_id().alias("rec_idx"))
    d = once(d.filter((F.col("line") != "") & ~F.col("line").startswith("@")), f=F.split("line", "\t"))
    d = once(d, flag=integer(_field(1)), pos=integer(_field(3)))
    d = _strict(d, (F.size("f") >= 11) & F.col("flag").between(0, 65535) & F.col("pos").isNotNull() & _field(5).rlike("^([*]|([0-9]+[MIDNSHP=X])+)$"), "SAM").filter(F.col("line").isNotNull())
    known = lambda i: F.when(_field(i) != "*", _field(i))
    # functions over an array's elements are interpreted, at over a microsecond an element: short CIGARs, most of all, do without
    sizes = F.when(_field(5) == "*", F.array().cast("array<int>")).otherwise(F.split(F.left(_field(5), F.char_length(_field(5)) - 1), "[MIDNSHP=X]").cast("array<int>"))
    d = once(d, sizes=sizes, letters=F.translate(_field(5), "0123456789*", ""))
    spans = lambda i, n: F.when(F.substring("letters", i + 1, F.lit(1)).isin(*"MDN=X"), n.cast("bigint")).otherwise(0)
    few = sum((spans(F.lit(i), F.get("sizes", F.lit(i))) for i in range(1, FEW)), spans(F.lit(0), F.get("sizes", F.lit(0))))
    many = F.aggregate(F.transform("sizes", lambda n, i: spans(i, n)), F.lit(0).cast("bigint"), lambda n, x: n + x)
    span = F.when(F.size("sizes") <= FEW, few).otherwise(many)  # with its loop, it would keep a generator from being compiled
    cigar = F.transform("sizes", lambda n, i: F.struct(F.substring("letters", i + 1, F.lit(1)).alias("op"), n.alias("len")))
    start = F.col("pos") - 1
    return d.select(
        F.lit(0).alias("file"), "rec_idx", _field(0).alias("qname"), F.col("flag").cast("int").alias("flag"), known(2).alias("contig"), start.alias("start"), (start + span).alias("stop"),
        integer(_field(4)).cast("int").alias("mapq"), F.when(_field(6) == "=", known(2)).otherwise(known(6)).alias("mate_contig"), (integer(_field(7)) - 1).alias("mate_start"),
        integer(_field(8)).alias("tlen"), cigar.alias("cigar"), known(9).alias("seq"), known(10).alias("qual"),
    )


def bedpe(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop, mapq, reverse, drop_reason: the span of both ends.  '.' is no quality, -1
    an unmapped end."""
    numbers = {"a": 1, "b": 2, "c": 4, "d": 5, "mapq": 7}
    lines = once(_lines(spark, path), **{n: integer(_field(i)) for n, i in numbers.items()})  # of '.', null
    a, b, c, d, mapq = map(F.col, numbers)
    bad = (F.size("f") < 6) | a.isNull() | b.isNull() | c.isNull() | d.isNull() | ((F.size("f") > 7) & (_field(7) != ".") & mapq.isNull())
    unmapped = (a < 0) | (c < 0) | (_field(0) == ".") | (_field(3) == ".")
    reason = F.when(F.coalesce(bad, F.lit(True)), "malformed").when(unmapped, "unmapped").when(_field(0) != _field(3), "other_contig").when(F.greatest(b, d) > MAX_COORDINATE, "malformed").otherwise("kept")
    return lines.select(_field(0).alias("contig"), F.least(a, c).alias("start"), F.greatest(b, d).alias("stop"), mapq.cast("int").alias("mapq"), (_field(8) == "-").alias("reverse"), reason.alias("drop_reason"))


def _strict(d: DataFrame, ok: Column, what: str) -> DataFrame:
    return d.withColumn("line", F.when(F.coalesce(ok, F.lit(False)), F.col("line")).otherwise(F.raise_error(F.concat(F.lit(f"malformed {what} line: "), F.col("line")))))


def peaks_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop; any malformed line and an empty file are errors."""
    d = _lines(spark, path)
    if d.isEmpty():
        raise InvalidInput(f"no peaks in {path}")
    d = once(d, start=integer(_field(1)), stop=integer(_field(2)))
    d = _strict(d, (F.size("f") >= 3) & _bounds(F.col("start"), F.col("stop")), "peak")
    return d.filter(F.col("line").isNotNull()).select(_field(0).alias("contig"), "start", "stop")


def clean_name(name: Column) -> Column:
    """At most 256 characters, control characters shown as '?'."""
    return F.left(F.regexp_replace(name, r"[\x00-\x1f\x7f]", "?"), F.lit(256))


def regions_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop, name, strand; a missing name is made from the place."""
    d, start, stop = once(_lines(spark, path), start=integer(_field(1)), stop=integer(_field(2))), F.col("start"), F.col("stop")
    d = _strict(d, (F.size("f") >= 3) & _bounds(start, stop), "region").filter(F.col("line").isNotNull())
    place = F.concat_ws("", _field(0), F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))
    name = F.when(F.coalesce(_field(3), F.lit(".")).isin(".", ""), place).otherwise(clean_name(_field(3)))
    strand = F.when(_field(5).isin("+", "-"), _field(5)).otherwise(".")
    return d.select(_field(0).alias("contig"), start.alias("start"), stop.alias("stop"), name.alias("name"), strand.alias("strand"))


def gtf(spark: SparkSession, path: str, feature: str = "gene", attribute: str = "gene_name") -> DataFrame:
    """Regions of one feature; coordinates become half open, lines of under 8 fields are skipped."""
    start, stop = integer(_field(3)), integer(_field(4))
    d = _lines(spark, path).filter((F.size("f") >= 8) & (_field(2) == feature))
    found = F.regexp_extract(F.coalesce(_field(8), F.lit("")), f"(?:^|[ ;\\t]){attribute}[ =]+\"?([^\";]*)", 1)
    place = F.concat_ws("", _field(0), F.lit(":"), (start - 1).cast("string"), F.lit("-"), stop.cast("string"))
    strand = F.when(_field(6).isin("+", "-"), _field(6)).otherwise(".")
    return d.select(_field(0).alias("contig"), (start - 1).alias("start"), stop.alias("stop"), F.when(found == "", place).otherwise(clean_name(found)).alias("name"), strand.alias("strand"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    plain = path.removesuffix(".gz").lower()
    return gtf(spark, path) if plain.endswith((".gtf", ".gff", ".gff3")) else regions_bed(spark, path)


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """contig, contig_length; repeated names and lengths that are not positive are errors."""
    d, n = once(_lines(spark, path, browser=False), n=integer(_field(1))), F.col("n")
    d = _strict(d, (F.size("f") >= 2) & n.between(1, MAX_COORDINATE), "contig").filter(F.col("line").isNotNull())
    d = d.select(_field(0).alias("contig"), n.alias("contig_length"))
    if not d.groupBy("contig").count().filter("count > 1").isEmpty():
        raise InvalidInput(f"a contig is listed twice in {path}")
    return d
