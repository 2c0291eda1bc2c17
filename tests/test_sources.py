"""Sources and sinks on small files."""

from __future__ import annotations

from forkline.operators import intervals
from forkline.sources import annotation as s


def test_gtf_to_parts_and_back(spark, tmp_path):
    line = 'chr1\tx\t{}\t{}\t{}\t.\t+\t.\tgene_id "G1.2"; transcript_id "{}"; gene_type "protein_coding";\n'
    (tmp_path / "a.gtf").write_text("#head\n" + line.format("exon", 1, 100, "T1") + line.format("exon", 51, 200, "T2") + line.format("start_codon", 5, 7, "T1") + line.format("exon", 1, 9, "T1").replace("chr1", "chrUn"))
    exons = s.read_exons(spark, str(tmp_path / "a.gtf"), s.CHROMOSOMES)
    assert {tuple(r) for r in exons.collect()} == {("G1.2", "T1", "chr1", "+", 1, 100), ("G1.2", "T2", "chr1", "+", 51, 200)}
    assert s.read_features(spark, str(tmp_path / "a.gtf")).where("biotype = 'protein_coding'").count() == 3
    parts = intervals.number_parts(intervals.aggregate_genes(intervals.exonic_parts(exons)))
    s.write_parts(parts, str(tmp_path / "gff"))
    again = s.read_parts(spark, str(tmp_path / "gff")).orderBy("part").collect()
    assert [(r.part, r.start, r.end, r.txs) for r in again] == [(1, 1, 50, ["T1"]), (2, 51, 100, ["T1", "T2"]), (3, 101, 200, ["T2"])]
    assert [tuple(r) for r in s.gene_chromosomes(spark, str(tmp_path / "gff")).collect()] == [("G1.2", "chr1")]


def test_count_files(spark, tmp_path):
    for grp, name, n in (("ctl", "r1", 3), ("trt", "r1", 5)):
        (tmp_path / grp).mkdir()
        (tmp_path / grp / f"{name}_counts.txt").write_text(f"G1:001\t{n}\nG1:E002\t0\n_empty\t9\n")
    got = {(r.gene, r.part, r["sample"], r.grp, r.cnt) for r in s.read_counts(spark, str(tmp_path)).collect()}
    assert got == {("G1", 1, "ctl_r1", "ctl", 3), ("G1", 2, "ctl_r1", "ctl", 0), ("G1", 1, "trt_r1", "trt", 5), ("G1", 2, "trt_r1", "trt", 0)}


def test_junctions_splits_events_alignments(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "s1.SJ.out.tab").write_text("chr1\t10\t20\t1\t1\t1\t5\t2\t30\n")
    assert [(r.start, r.n_uniq, r["sample"]) for r in s.read_junctions(spark, str(tmp_path / "j")).collect()] == [(10, 5, "s1")]
    (tmp_path / "sp.txt").write_text("gene\tsource\tsink\tref_ex_part\tsetdiff1\tsetdiff2\ttranscripts1\ttranscripts2\tpath1\tpath2\ng\t1\t4\tE001\tNA\t\ta\tb\t1-2\t1-3\n")
    row = s.read_splits(spark, str(tmp_path / "sp.txt")).first()
    assert (row.ref_ex_part, row.setdiff1, row.setdiff2) == ("E001", None, None)
    for kind in ("SE", "RI"):
        (tmp_path / f"fromGTF.{kind}.txt").write_text("ID\tGeneID\n1\tg\nID\tGeneID\n2\tg\n")
    assert {r.event_id for r in s.read_events(spark, str(tmp_path), types=("SE", "RI")).collect()} == {"SE_1", "SE_2", "RI_1", "RI_2"}
    (tmp_path / "a.sam").write_text("@HD\tx\nr1\t0\tchr1\t5\t60\t10M\t*\t0\t0\tA\tI\tNH:i:1\tXX:i:3\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert [tuple(r) for r in s.read_alignments(spark, str(tmp_path / "a.sam")).orderBy("read").collect()] == [("r1", 0, "chr1", 5, 60, "10M", 1), ("r2", 4, "*", 0, 0, "*", None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("g", 1), ("h", 2)], "gene string, n int")
    s.write_table(rows, str(tmp_path / "p"), ["gene"])
    s.append_summary(rows, str(tmp_path / "t"))
    s.append_summary(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 4
