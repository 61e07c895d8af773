"""Gene annotations: GFF3, GTF and GenBank feature tables.

Each parser takes a DataFrame of text lines (or records) in ``value``, so the
same code serves files, streams and derived text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helicase.sources.lines import blocks, carried

# Attributes that make up the tag, in the order they appear in it.
TAG_KEYS = ["Name", "Note", "Product", "product"]
GENE_TYPES = ["gene", "CDS", "cds"]


def parse_gff(lines: DataFrame) -> DataFrame:
    """``(chromosome, type, start, stop, strand, tag, id, parent, gene)`` of GFF3 lines.

    Comment lines and whole-chromosome rows (``genome=chromosome``) are dropped.
    """
    f = F.split("value", "\t")
    col = lambda i: F.try_element_at(f, F.lit(i + 1))
    rows = lines.where((F.length("value") > 0) & ~F.startswith("value", F.lit("#"))).select(
        col(0).alias("chromosome"),
        col(2).alias("type"),
        col(3).try_cast("long").alias("start"),
        col(4).try_cast("long").alias("stop"),
        (col(6) == "+").alias("strand"),
        _attributes(F.coalesce(col(8), F.lit(""))).alias("_a"),
    )
    # One-element generator: the map is built once per row, not once per use.
    rows = rows.select(F.inline(F.array(F.struct(*rows.columns))))
    attr = lambda k: F.try_element_at("_a", F.lit(k))
    words = F.concat(*[F.coalesce(F.concat(attr(k), F.lit(" ")), F.lit("")) for k in TAG_KEYS])
    return rows.where(~F.coalesce(attr("genome") == "chromosome", F.lit(False))).select(
        "chromosome", "type", "start", "stop", "strand",
        F.when(words == "", F.col("type")).otherwise(F.concat("type", F.lit(": "), words)).alias("tag"),
        F.coalesce(attr("ID"), F.lit("")).alias("id"),
        F.coalesce(attr("Parent"), F.lit("")).alias("parent"),
        F.col("type").isin(GENE_TYPES).alias("gene"),
    )


def _attributes(text: Column) -> Column:
    """Map of ``key=value`` items; items without '=' are ignored, the last of equal keys wins."""
    items = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(
        items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x)).alias("v"))
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, last(k))))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """``(chromo, source, type, start, stop, sense, gene_name, gene_biotype, transcript_version)``.

    A '#' cuts off the rest of its line. Columns may be separated by blanks or tabs.
    """
    text = F.trim(F.substring_index("value", "#", 1))
    f = F.split(text, r"[ \t]+", 9)
    rest = F.try_element_at(f, F.lit(9))
    attr = lambda k: F.nullif(F.regexp_extract(rest, f'(?:^|[; \t]){k}[ \t]+"([^"]*)"', 1), F.lit(""))
    keep = [c for c in lines.columns if c != "value"]
    return lines.where(F.length(text) > 0).select(
        *keep,
        f[0].alias("chromo"),
        f[1].alias("source"),
        f[2].alias("type"),
        f[3].try_cast("long").alias("start"),
        f[4].try_cast("long").alias("stop"),
        (f[6] == "+").alias("sense"),
        attr("gene_name").alias("gene_name"),
        attr("gene_biotype").alias("gene_biotype"),
        F.coalesce(attr("transcript_version").try_cast("int"), F.lit(-1)).alias("transcript_version"),
    )


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def parse_genbank(records: DataFrame) -> DataFrame:
    """Feature rows of GenBank flat-file records, one record per row of ``value``.

    Of a joined or ordered location the last part's range is kept. ``source``
    features are dropped, translations are left out of the tag.
    """
    table = F.regexp_extract("value", r"(?s)(?:^|\n)FEATURES[^\n]*\n(.*?)(?=\n\S|$)", 1)
    name = F.regexp_extract("value", r"(?:^|\n)LOCUS\s+(\S+)", 1)
    return _features(
        records.select(name.alias("chromosome"), F.explode(F.split(F.concat(F.lit("\n"), table), r"\n {1,20}(?=\S)")).alias("_f")).where(F.trim("_f") != "")
    )


def _features(feature: DataFrame) -> DataFrame:
    """Feature rows of ``(chromosome, _f)``, one feature's text a row."""
    quals = F.split("_f", r"\n\s+/(?=[A-Za-z_])")
    head = F.element_at(quals, 1)
    ranges = F.regexp_extract_all(F.regexp_replace(head, r"\s+", ""), F.lit(r"<?(\d+\.\.>?\d+)"), F.lit(1))
    last = F.regexp_replace(F.try_element_at(ranges, F.lit(-1)), ">", "")
    kind = F.regexp_extract(F.trim(head), r"^([A-Za-z_]+)", 1)
    value = F.transform(
        F.filter(
            F.slice(quals, 2, F.greatest(F.size(quals), F.lit(1))),
            lambda q: ~q.rlike(r"^(translation|transl_except|anticodon)\b"),
        ),
        lambda q: F.concat(
            F.regexp_replace(F.regexp_extract(F.rtrim(q), r'(?s)^[A-Za-z_]+=(?:"(.*)"|-?\d+)$', 1), "\n", r"\\n"),
            F.regexp_extract(q, r"^[A-Za-z_]+=(-?\d+)\s*$", 1),
            F.lit(", "),
        ),
    )
    return feature.select(
        "chromosome",
        kind.alias("type"),
        F.substring_index(last, "..", 1).try_cast("long").alias("start"),
        F.substring_index(last, "..", -1).try_cast("long").alias("stop"),
        (~F.contains(head, F.lit("complement("))).alias("strand"),
        F.array_join(value, "").alias("tag"),
        kind.isin("CDS", "gene").alias("gene"),
    ).where((F.col("type") != "source") & F.col("start").isNotNull())


def genbank_lines(lines: DataFrame) -> DataFrame:
    """Feature rows of GenBank flat files given as lines ``(file, block, mid, value)``.

    Which record and which feature a line belongs to is carried along the lines of each split and over its borders, so a record
    of any length, with its sequence, is never one row; a feature is.
    """
    section = F.rlike("value", F.lit(r"^\S"))
    marked = carried(
        lines,
        chromosome=F.when(section & F.startswith("value", F.lit("LOCUS")), F.regexp_extract("value", r"^LOCUS\s+(\S+)", 1)),
        table=F.when(section, F.startswith("value", F.lit("FEATURES"))),
        feature=F.when(section, F.lit(-1).cast("long")).when(F.rlike("value", F.lit(r"^ {1,20}\S")), F.col("mid")),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "mid", "value"))), lambda x: x["value"]), "\n")
    own = marked.where(F.col("table") & (F.col("feature") >= 0)).groupBy("file", "feature").agg(F.first("chromosome").alias("chromosome"), text.alias("_f"))
    return _features(own.select(F.coalesce("chromosome", F.lit("")).alias("chromosome"), F.ltrim("_f").alias("_f")))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Files or folders of GenBank records, split like any text."""
    return genbank_lines(blocks(spark, path))


def gff_lines(rows: DataFrame) -> DataFrame:
    """GFF3 text of ``(chromosome, source, type, start, stop, score, strand, phase, attributes)``."""
    cols = ["chromosome", "source", "type", "start", "stop", "score", "strand", "phase", "attributes"]
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def shift_gff(lines: DataFrame, after: int, by: int) -> DataFrame:
    """GFF3 lines with start and stop moved where they lie behind a coordinate.

    Comment lines pass through unchanged.
    """
    f = F.split("value", "\t")
    moved = lambda i: F.when(f[i].try_cast("long") > after, (f[i].try_cast("long") + by).cast("string")).otherwise(f[i])
    rebuilt = F.concat_ws("\t", F.slice(f, 1, 3), moved(3), moved(4), F.slice(f, 6, F.greatest(F.size(f) - 5, F.lit(0))))
    return lines.select(
        F.when(F.startswith("value", F.lit("#")) | (F.size(f) < 5), F.col("value")).otherwise(rebuilt).alias("value")
    )
