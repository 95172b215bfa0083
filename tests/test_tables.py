import glob

import pytest

from clonoforge.operators import pipeline
from clonoforge.sources import files, tables
from clonoforge.sources.chains import LOCI


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def held(path, pattern="part-*"):
    return [line for name in sorted(glob.glob(f"{path}/{pattern}")) for line in open(name).read().splitlines()]


HEAD = "subject:condition\tCDR3b\tTRBV\tTRBJ\tCDR3a\tcount\n"


def test_chain_files(spark, tmp_path):
    path = write(tmp_path, "c.tsv", HEAD + "S1 : a:b\tcasslf\tTRBV1\t\tCA1\t2\nS2:x\tCA-F\tTRBV2\t\tCAF\t\nS2:x\tCASF\tNA\tTRBJ1\tcaf\tNA\n")
    got = tables.read_chains(spark, path).orderBy("subject").collect()
    assert [tuple(r) for r in got] == [("S1", "a:b", "CASSLF", None, "TRBV1", None, None, None, 2.0), ("S2", "x", "CASF", "CAF", None, "TRBJ1", None, None, 1.0)]
    for text, why in ((HEAD + "S1x\tCASF\t\t\t\t1\n", "chain record"), (HEAD + "S1:\tCASF\t\t\t\t1\n", "chain record"), (HEAD + "S1:x\t\t\t\t\t1\n", "chain record"), (HEAD + "S1:x\tCASF\t\t\t\tmany\n", "chain record"), (HEAD + "S1:x\tCASF\t\t\t\t-1\n", "chain record"), (HEAD, "no chain record"), (HEAD + "S1:x\tCA1\t\t\t\t1\n", "no chain record"), ("CDR3b\tTRBV\nCASF\tx\n", "no column subject:condition")):
        with pytest.raises(Exception, match=why):
            tables.read_chains(spark, write(tmp_path, "bad.tsv", text)).collect()
    assert tables.read_chains(spark, write(tmp_path, "few.tsv", "subject:condition\tCDR3b\nS1:x\tCASF\nS1\tCASF\n"), "drop").count() == 1


def test_hla_files(spark, tmp_path):
    path = write(tmp_path, "h.tsv", "pid\tA\tB\nS1\tDPA1*01\tDPA1*01\tDPB1*1\tDPB1*2\nS2\n")
    assert {r.subject: (r.dpa1, r.dpb1, r.drb1) for r in tables.read_hla(spark, path).collect()} == {"S1": ("DPA1*01", "DPB1*1/DPB1*2", ""), "S2": ("", "", "")}
    for text, why in (("pid\n\tx\n", "empty subject"), ("pid\nS1" + "\tx" * 13 + "\n", "13 columns"), ("pid\nS1\tx\nS1\ty\n", "two rows of subject S1"), ("pid\n", "no HLA record")):
        with pytest.raises(Exception, match=why):
            tables.read_hla(spark, write(tmp_path, "bad.tsv", text)).collect()


def test_reference_files(spark, tmp_path):
    path = write(tmp_path, "g.tsv", "id\torganism\tregion\tcdrs\nV1*01\thuman\tV\tAA;BB;CC;D\nV2*01\thuman\tV\t;BB;CC\nV3*01\thuman\tV\tAA;BB\nJ1*01\thuman\tJ\tA;B;C\nV4*01\tmouse\tV\tA;B;C\n")
    assert [tuple(r) for r in tables.read_germline(spark, path, "human").collect()] == [("V1*01", "AA", "BB", "CC")]
    with pytest.raises(ValueError, match="no V gene of rat"):
        tables.read_germline(spark, path, "rat")
    with pytest.raises(ValueError, match="no column cdrs"):
        tables.read_germline(spark, write(tmp_path, "b.tsv", "id\torganism\tregion\nx\ty\tz\n"), "y")
    path = write(tmp_path, "e.tsv", "trimmed_seq\toriginal_seq\tgroup\tepitopes\torganism\tantigen\nASSF\tCASSFF\tg1\tEPI\thuman\tant\nASSW\tCASSWF\n\n")
    assert [(r.sequence, r.original, r.receptor_group, r.epitope, r.antigen, r.organism) for r in tables.read_epitopes(spark, path).collect()] == [("ASSF", "CASSFF", "g1", "EPI", "ant", "human"), ("ASSW", "CASSWF", "", "", "", "")]
    line = "5\t0.1\tTGT\tCASSF\tTRBV1\t.\tTRBJ1\tTRBC\tc1\t0"
    good = write(tmp_path, "t.tsv", "\t".join(files.TRUST4_HEADER) + f"\n{line}\n{line.replace('TRB', 'TRA')}\n")
    assert [tuple(r) for r in tables.read_trust4(spark, good).collect()] == [(line, "CASSF")]
    with pytest.raises(ValueError, match="ten columns"):
        tables.read_trust4(spark, write(tmp_path, "u.tsv", f"#count\n{line}\n"))
    spark.createDataFrame([("CASSF",)], "s string").write.parquet(f"{tmp_path}/ref/sequences.parquet")
    with pytest.raises(ValueError, match="no genes"):
        tables.read_repertoire(spark, f"{tmp_path}/ref")
    spark.createDataFrame([("TRBV1", 0.5)], "gene string, freq double").write.parquet(f"{tmp_path}/ref/genes.parquet")
    spark.createDataFrame([(125, 1, 0.5), (125, 3, 0.1), (250, 1, 0.4)], "sample_size int, cluster_size int, probability double").write.parquet(f"{tmp_path}/ref/sizes.parquet")
    rep = tables.read_repertoire(spark, f"{tmp_path}/ref")
    assert rep.sizes == {125: [0.5, 1.0, 0.1], 250: [0.4]} and rep.lengths is None and rep.length_table().first().value == 5


def test_cluster_file(spark, tmp_path):
    kinds = {"index": "bigint", "number_subject": "bigint", "number_unique_cdr3": "bigint", "freq": "bigint"} | {c: "double" for c in ("fisher_score", "final_score", "hla_score", "vb_score", "expansion_score", "length_score", "cluster_size_score")}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in pipeline.OUTPUT_COLUMNS)
    row = lambda index, p, alpha, va: tuple({"index": index, "pattern": "SL%Q", "tcrb": "CASSF", "fisher_score": p, "tcra": alpha, "va": va}.get(c, 1 if kinds.get(c) == "bigint" else 0.5 if c in kinds else None) for c in pipeline.OUTPUT_COLUMNS)
    rows = spark.createDataFrame([row(2, 0.5, None, None), row(1, 0.1, "", None), row(1, 0.5, None, None)], schema)
    tables.write_clusters(rows, f"{tmp_path}/beta")
    lines = [x.split("\t") for x in held(f"{tmp_path}/beta")]
    assert len(lines[0]) == 28 and lines[0][4] == "TcRb" and lines[0][-1] == "HLA-DRB5" and lines[0][15] == "type"
    assert [(x[0], x[5]) for x in lines[1:] if x[0] != "index"] == [("1", "0.1"), ("1", "0.5"), ("2", "0.5")] and lines[1][7] == ""
    assert tables.cluster_file_rows(spark.createDataFrame([row(1, 0.1, "CAF", "TRAV1")], schema)).columns[28:] == ["pattern_alpha", "VA", "JA"]
    assert tables.cluster_file_rows(spark.createDataFrame([row(1, 0.1, "CAF", None)], schema)).columns[28:] == ["pattern_alpha"]


def test_match_file_and_reports(spark, tmp_path):
    annotated = spark.createDataFrame([("ASSF", "ASSW", 0.98765449, "g", "e", "a", "o")], "input_sequence string, match_sequence string, score double, receptor_group string, epitope string, antigen string, organism string")
    tables.write_matches(annotated.coalesce(1), f"{tmp_path}/m")
    assert held(f"{tmp_path}/m") == ["trimmed_input_sequence\tmatch_sequence\tscore\treceptor_group\tepitope\tantigen\torganism", "ASSF\tASSW\t0.987654\tg\te\ta\to"]
    assert tables.match_rows(annotated, trimmed=False).columns[0] == "input_sequence"
    names = [f"s{k}_S1_L001_{r}_001.fastq.gz" for k in (2, 1) for r in ("R2", "I1", "R1")] + ["notes.txt"]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for n in names:
        write(tmp_path / "in" / "deep", n, n)
    scanned = files.scan_fastq(spark, f"{tmp_path}/in")
    parsed = files.parse_fastq(scanned)
    tables.write_sample_report(files.files_of(parsed, ["sample_id"]), f"{tmp_path}/samples")
    assert held(f"{tmp_path}/samples")[0] == "# All FastQ Files per Sample" and held(f"{tmp_path}/samples")[2:] == ["", "s1\t" + "\t".join(f"s1_S1_L001_{r}_001.fastq.gz" for r in ("I1", "R1", "R2")), "s2\t" + "\t".join(f"s2_S1_L001_{r}_001.fastq.gz" for r in ("I1", "R1", "R2"))]
    tables.write_paired_report(tables.paired_files(parsed), f"{tmp_path}/pairs")
    assert held(f"{tmp_path}/pairs")[3:] == ["\t".join(f"s{k}_S1_L001_{r}_001.fastq.gz" for r in ("R1", "R2", "I1")) for k in (1, 2)]
    tables.write_md5_report(parsed, f"{tmp_path}/md5")
    lines = held(f"{tmp_path}/md5")
    import hashlib

    assert lines[1] == "# Format: filename\tmd5_hash" and lines[3:] == [f"{n}\t{hashlib.md5(n.encode()).hexdigest()}" for n in sorted(names[:-1])]
    assert len(LOCI) == 8
