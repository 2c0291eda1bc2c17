"""Sources and sinks: annotation, counts, junctions, event tables, alignments; text in, typed tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The chromosomes that the reference filter keeps.
CHROMOSOMES = [f"chr{c}" for c in (*range(1, 23), "X", "Y", "M")]
EVENT_TYPES = ("SE", "RI", "A3SS", "A5SS")


def _attribute(name: str) -> Column:
    return F.regexp_extract("attrs", rf'{name} "([^"]*)"', 1)


def _features(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a GTF or GFF file or folder: nine columns, comments left out."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(cells) >= 9))
    names = ("chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attrs")
    out = rows.select(*(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)))
    return out.withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")})


def read_exons(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> DataFrame:
    """exons(gene, tx, chrom, strand, start, end) of a GTF; start and stop codons are no features."""
    rows = _features(spark, path).where("feature = 'exon'").select(_attribute("gene_id").alias("gene"), _attribute("transcript_id").alias("tx"), "chrom", "strand", "start", "end")
    return rows if chromosomes is None else keep_chromosomes(rows, chromosomes)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All features of a GTF with gene, transcript and biotype, without start_codon and stop_codon."""
    rows = _features(spark, path).where("feature not in ('start_codon', 'stop_codon')")
    kind = F.coalesce(F.nullif(_attribute("gene_type"), F.lit("")), F.nullif(_attribute("gene_biotype"), F.lit("")), F.lit("unknown"))
    return rows.select("feature", "chrom", "strand", "start", "end", _attribute("gene_id").alias("gene"), _attribute("transcript_id").alias("tx"), kind.alias("biotype"))


def keep_chromosomes(rows: DataFrame, chromosomes: list[str] = CHROMOSOMES) -> DataFrame:
    return rows.where(F.col("chrom").isin(chromosomes))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """parts(gene, part, chrom, strand, start, end, txs) of a flattened GFF."""
    rows = _features(spark, path).where("feature = 'exonic_part'")
    return rows.select(_attribute("gene_id").alias("gene"), _attribute("exonic_part_number").cast("int").alias("part"), "chrom", "strand", "start", "end", F.split(_attribute("transcripts"), r"\+").alias("txs"))


def gene_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, chrom) from the aggregate_gene lines of a flattened GFF; an error if it has none."""
    rows = _features(spark, path).where("feature = 'aggregate_gene'").select(_attribute("gene_id").alias("gene"), "chrom")
    if rows.isEmpty():
        raise ValueError(f"no aggregate_gene lines in {path}")
    return rows


def write_parts(parts: DataFrame, path: str) -> None:
    """parts (gene, part, chrom, strand, start, end, txs) as a flattened GFF: aggregate_gene lines and exonic_part lines."""
    genes = parts.groupBy("gene", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    line = lambda kind, attrs: F.concat_ws("\t", "chrom", F.lit("forkline"), F.lit(kind), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    whole = genes.select("gene", F.lit(0).alias("k"), line("aggregate_gene", F.format_string('gene_id "%s"', "gene")).alias("value"))
    each = parts.select("gene", F.col("part").alias("k"), line("exonic_part", F.format_string('gene_id "%s"; transcripts "%s"; exonic_part_number "%03d"', F.col("gene"), F.array_join("txs", "+"), F.col("part"))).alias("value"))
    whole.union(each).repartitionByRange("gene").sortWithinPartitions("gene", "k").select("value").write.text(path)


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """counts(gene, part, sample, grp, cnt) of `<root>/<grp>/<name>_counts.txt`, files or folders of them; sample is `<grp>_<name>`, special rows (`_empty`, ...) are left out.

    Folders may be named as partitionBy() names them (`grp=<grp>/name=<name>_counts.txt`).
    """
    rows = spark.read.csv(f"{root}/*/*_counts.txt", sep="\t", schema="id string, cnt long").withColumn("path", F.col("_metadata.file_path"))
    shape = r"/(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)_counts\.txt(?:/[^/]+)?$"
    grp, name = (F.regexp_extract("path", shape, k) for k in (1, 2))
    rows = rows.where(~F.col("id").startswith("_")).select("*", grp.alias("grp"), F.concat_ws("_", grp, name).alias("sample"))
    return rows.select(F.substring_index("id", ":", 1).alias("gene"), F.regexp_replace(F.substring_index("id", ":", -1), "^E", "").cast("int").alias("part"), "sample", "grp", "cnt")


JUNCTION_SCHEMA = "chrom string, start int, end int, strand int, motif int, annotated int, n_uniq long, n_multi long, max_overhang int"


def read_junctions(spark: SparkSession, path: str, suffix: str = "SJ.out.tab") -> DataFrame:
    """junctions(chrom, start, end, strand, ..., n_uniq, n_multi, sample): all junction files under a path; the sample is the file's name without `suffix`."""
    rows = spark.read.csv(path, sep="\t", schema=JUNCTION_SCHEMA, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)$", 1), rf"[._]?{suffix.replace('.', '[.]')}$", "")
    return rows.withColumn("sample", name)


SPLIT_SCHEMA = "gene string, source string, sink string, ref_ex_part string, setdiff1 string, setdiff2 string, transcripts1 string, transcripts2 string, path1 string, path2 string"


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A table of splits in text form; `NA` and blanks are null."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=SPLIT_SCHEMA)
    return rows.select(*(F.when(F.trim(c).isin("", "NA"), None).otherwise(F.col(c)).alias(c) for c in rows.columns))


def read_events(spark: SparkSession, root: str, pattern: str = "fromGTF.{}.txt", types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Event or result tables of several types as one, with etype and event_id (`SE_17`); repeated header lines are left out."""

    def one(kind: str) -> DataFrame:
        rows = spark.read.csv(f"{root}/{pattern.format(kind)}", sep="\t", header=True)
        rows = rows.select(*(F.col(f"`{c}`").alias(c.strip('"')) for c in dict.fromkeys(rows.columns)))
        return rows.where(F.col("ID") != "ID").withColumns({"etype": F.lit(kind), "event_id": F.concat_ws("_", F.lit(kind), "ID")})

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, types))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """aln(read, flag, chrom, pos, mapq, cigar, nh) of SAM text; header lines are left out."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    nh = F.regexp_extract("value", r"\tNH:i:(\d+)", 1)
    # header lines are shorter, and filters on the cells may run before the one on the line
    cell = lambda i: F.get(cells, F.lit(i))
    return rows.select(
        cell(0).alias("read"), cell(1).try_cast("int").alias("flag"), cell(2).alias("chrom"), cell(3).try_cast("int").alias("pos"),
        cell(4).try_cast("int").alias("mapq"), cell(5).alias("cigar"), F.when(nh != "", nh.cast("int")).alias("nh"),
    )


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, text: bool = False, mode: str = "errorifexists") -> None:
    """One dataset instead of a file for each gene: Parquet, or tab-separated text with a header."""
    writer = rows.write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    writer.csv(path, sep="\t", header=True) if text else writer.parquet(path)


def append_summary(rows: DataFrame, path: str) -> None:
    write_table(rows, path, text=True, mode="append")
