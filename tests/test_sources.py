import json

import pytest
from pyspark.sql import functions as F

from cladeframe.config import Settings
from cladeframe.sources import reports as K
from cladeframe.sources import text as T
from cladeframe.sources import tools as X


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(content)
        return str(path)

    return write


def test_fasta(spark, put, tmp_path):
    put("d/a.faa", ">g1 first one\nMKL\nMM\n>g2\tx\nAA>B\r\n\n>g3\n")
    put("d/b.faa", ">g1\nNEW\n")
    put("d/note.txt", ">no\nX\n")
    got = {r.id: r.seq for r in T.fasta_dir(spark, str(tmp_path / "d")).collect()}
    assert got == {"g1": "NEW", "g2": "AA>B", "g3": ""}
    df = spark.createDataFrame([("a", "M" * 165), ("b", "M" * 80)], "id string, seq string")
    K.write_fasta(df, str(tmp_path / "out"))
    back = {r.id: r.seq for r in T.fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {"a": "M" * 165, "b": "M" * 80}
    assert [len(x) for x in K.fasta_lines(df, "id", "seq").first().value.split("\n")] == [2, 80, 80, 5]
    assert {r.id: r.length for r in T.sequence_lengths(spark.createDataFrame([("a", "MK**")], "id string, seq string")).collect()} == {"a": 2}


def test_group_tables(spark, put):
    path = put("Orthogroups.tsv", "Orthogroup\tQalb\tZmon\nOG1\tQalb_a, Qalb_b\tZmon_x\nOG2\t\tZmon_y, Zmon_x\nOG3\t\t\n")
    assert sorted((r.og, r.species, r.gene) for r in T.orthogroups(spark, path).collect()) == [("OG1", "Qalb", "Qalb_a"), ("OG1", "Qalb", "Qalb_b"), ("OG1", "Zmon", "Zmon_x"), ("OG2", "Zmon", "Zmon_y")]
    assert T.orthogroups(spark, path, dedupe=False).where("gene = 'Zmon_x'").count() == 2
    path = put("groups.tsv", "group_id\tgroup_size\tSp1.faa\tSp2.faa\n1\t2\ta,b\t*\n2\t0\t*\t*\n")
    assert sorted((r.group_id, r.species, r.gene) for r in T.ortholog_groups(spark, path).collect()) == [("1", "Sp1", "a"), ("1", "Sp1", "b")]


def test_domains(spark, put):
    row = lambda d, hf, ht, af, at, b: f"g1 - 200 Fam - 100 1e-30 180.5 0.1 {d} 2 1e-9 1e-9 {b} 0.0 {hf} {ht} {af} {at} 1 90 0.9 desc here"
    path = put("x.domtbl", "# header\n" + row(1, 1, 60, 1, 50, 100.5) + "\n" + row(2, 41, 100, 45, 80, 80.0) + "\nbroken row\n")
    (r,) = T.profile_hits(T.domtblout(spark, path)).collect()
    assert (r.profile_cov, r.query_cov, r.nbits, len(r.domains)) == (1.0, 0.4, 1.805, 2)
    path = put("x.tbl", "g1 - F2 - 1e-9\ng1 - F1 - 1e-9\ng1 - F3 - 1e-7\ng2 - F1 - 1\n# [ok]\n")
    assert [(r.gene, r.family) for r in T.tblout(spark, path).collect()] == [("g1", "F2")]
    assert T.complete_chunks(spark, path, 1).count() == 5
    with pytest.raises(ValueError, match="incomplete"):
        T.complete_chunks(spark, put("y.tbl", "g1 - F1 - 1\n"), 1)


def test_hits(spark, put):
    path = put("fs.tsv", "g1\tR1_OG1.pdb\t1e-9\t100\t0.8\ng1\tR1_OG1.cif.gz\t1e-9\t90\t0.82\ng1\tR1_OG2\t1e-9\t50\t0.7\nbad\trow\n")
    assert sorted((r.family, r.tm) for r in T.foldseek(spark, path).collect()) == [("R1_OG1", 0.82), ("R1_OG2", 0.7)]
    line = lambda q, s, b: "\t".join([q, s, "90", "100", "0", "0", "1", "10", "1", "10", "1e-9", str(b)])
    path = put("b6.tsv", "\n".join([line("A", "Zmon_1", 10), line("A", "Zmon_2", 10), line("A", "Vden_1", 15), "short\trow"]) + "\n")
    assert [r.sseqid for r in T.blast_best(spark, path).collect()] == ["Vden_1"]
    per = T.blast_best(spark, path, F.split_part("sseqid", F.lit("_"), F.lit(1)).alias("species"))
    assert sorted((r.species, r.sseqid) for r in per.collect()) == [("Vden", "Vden_1"), ("Zmon", "Zmon_1")]
    line = lambda q, b: "\t".join([q, "AF-B2WQX7-F1-model_v3", "0.9", "10", "1e-9", str(b), "1", "2", "1", "2", "0.9", "x"])
    assert [(r["query"], r.bits) for r in T.structure_best(spark, put("s.tsv", line("G.pdb", 5) + "\n" + line("G.pdb", 9) + "\n")).collect()] == [("G", 9.0)]


def test_annotations(spark, put):
    path = put("e.tsv", "## c\n#query\tEC\tPreferred_name\ng1\t1.1.1.1,2.2.2.2\tN\ng2\t-\t-\n## end\n")
    assert sorted((r.gene, r.ec, r.is_enzyme) for r in T.emapper(spark, path).collect()) == [("g1", "1.1.1.1", True), ("g2", "", False)]
    with pytest.raises(ValueError, match="header"):
        T.emapper(spark, put("bad.tsv", "g1\tx\n"))
    got = {r.gene: (r.ec, r.confidence) for r in T.clean(spark, put("c.csv", "Zmon_many,EC:1.1.1.1/0.3;EC:2.2.2.2/0.9\ng2,EC:3.3.3.3/0.5,EC:4.4.4.4/0.5\n")).collect()}
    assert got == {"Zmon_many": ("2.2.2.2", 0.9), "g2": ("3.3.3.3", 0.5)}
    got = {r.gene: (r.is_enzyme, r.ec, r.confidence) for r in T.enzymes(spark, put("z.csv", "Protein_ID,EC_number,Score\na,1.1.1.1,0.7\nb,,x\n")).collect()}
    assert got == {"a": (True, "1.1.1.1", 0.7), "b": (False, "", 0.0)}
    (r,) = T.localization(spark, put("d.csv", "Protein_ID,Localizations,Signals,Cytoplasm,Plastid,Note\ng1,Plastid,s,0.1,0.9,text\n")).collect()
    assert r.label == "Plastid" and r.probs == {"Cytoplasm": 0.1, "Plastid": 0.9}
    (r,) = T.signal_peptides(spark, put("sp.txt", "# h\ng1 desc\tSP\t0.1\t0.9\n")).collect()
    assert (r.gene, r.prediction, r.sp_prob) == ("g1", "SP", 0.9)
    assert T.isoform_scores(spark, put("glm.tsv", "seq_id\tscore\na\t-1.5\n")).collect()[0].score == -1.5
    assert {r.key: r.value for r in T.two_columns(spark, put("t.tsv", "A.1\tx\nA.2\ty\n"), strip=True).collect()} == {"A": "y"}


def test_selection_results(spark, put):
    doc = {"test results": {"relaxation or intensification parameter": 0.4175, "p-value": 0.01, "LRT": 9.3}}
    (r,) = T.relax(spark, put("r.json", json.dumps(doc))).collect()
    assert (r.k, r.p, r.direction) == (0.4175, 0.01, "relaxed")
    doc = {"MLE": {"headers": [["alpha", "x"], ["p-value", "y"]], "content": {"0": [[1.0, 0.5], [2.0, 0.03]]}}}
    assert [(r.site, r.p) for r in T.meme_sites(spark, put("m.json", json.dumps(doc))).collect()] == [(2, 0.03)]
    doc = {"branch attributes": {"0": {"Hpet_leaf": {"Corrected P-value": 0.01}, "Node1": {"Corrected P-value": 0.5}}}}
    assert [r.branch for r in T.absrel_branches(spark, put("a.json", json.dumps(doc))).collect()] == ["Hpet_leaf"]
    beb = "Naive\n   3 G 0.97\n\nBayes Empirical Bayes (BEB) analysis\nPositive sites for foreground lineages Prob(w>1):\n    12 S 0.613\n    47 D 0.957*\n   388 W 0.999**\n\nThe grid\n 6 V 0.4\nlnL(ntime: 5 np: 9):  -877.25  +0.0\n"
    path = put("beb.txt", beb)
    assert [(r.site, r.aa, r.prob) for r in T.beb_sites(spark, path).collect()] == [(12, "S", 0.613), (47, "D", 0.957), (388, "W", 0.999)]
    assert T.log_likelihood(spark, path).first().lnl == -877.25


def test_placements(spark, put):
    doc = {"version": 3, "tree": "(a{0},b{1}){2};", "fields": ["like_weight_ratio", "edge_num", "likelihood", "pendant_length", "distal_length"], "placements": [{"p": [[0.3, 1, -5, 0.2, 0.1], [0.7, 0, -4, 0.2, 0.1]], "n": ["q1"]}, {"p": [[1.0, 2, -1, 0.5, 0.1]], "nm": [["q2", 1]]}]}
    path = put("x.jplace", json.dumps(doc))
    got = [(r.gene, r.rank, r.edge_num, r.like_weight_ratio) for r in T.jplace(spark, path).orderBy("gene", "rank").collect()]
    assert got == [("q1", 1, 0, 0.7), ("q1", 2, 1, 0.3), ("q2", 1, 2, 1.0)]
    assert T.jplace_tree(spark, path).first().newick == doc["tree"]


def test_structures_and_models(spark, put):
    atom = lambda n, res, b: f"ATOM  {1:>5} {n:<4} ALA A{res:>4}    {0:>8.3f}{0:>8.3f}{0:>8.3f}{1:>6.2f}{b:>6.2f}"
    path = put("p.pdb", "\n".join(["HEADER", atom(" N", 1, 10), atom(" CA", 1, 90), atom(" CA", 2, 30), "HETATM x"]) + "\n")
    assert T.mean_plddt(spark, path).first().plddt == 60.0
    assert {r.residue: r.value for r in T.residue_plddt(spark, path).collect()} == {1: 10.0, 2: 30.0}
    gff = "##gff-version 3\n##STA\tMKL*\nc1\tminiprot\tmRNA\t5\t99\t.\t+\t.\tID=1;Rank=1;Identity=0.98;Target=A1 1 4\nc1\tminiprot\tmRNA\t7\t9\t.\t+\t.\tID=x;Rank=2;Identity=0.5;Target=A1 1 4\n##STA\tMM\nc2\tminiprot\tmRNA\t1\t9\t.\t-\t.\tID=2;Rank=1;Identity=0.9;Target=B2 1 3\n"
    got = sorted((r.contig, r.start, r.identity, r.anchor, r.protein) for r in T.miniprot(spark, put("m.gff", gff)).collect())
    assert got == [("c1", 5, 0.98, "A1", "MKL*"), ("c2", 1, 0.9, "B2", "MM")]
    assert [(r.gene, r.embedding) for r in T.embeddings(spark, put("e.tsv", "g\t1.5,-2.0\n")).collect()] == [("g", [1.5, -2.0])]
    assert [(r.id, r.name) for r in T.working_ids(spark, put("ids.txt", "0_1: Zmon_a desc\n")).collect()] == [("0_1", "Zmon_a")]
    assert sorted(r.gene for r in T.summary_members(spark, put("summary.tsv", "family_id\tround\tgene_list\nR1_OG1\t1\ta,b\n")).collect()) == ["a", "b"]


def test_gene_models_are_read_in_splits(spark, tmp_path):
    """A model is a record: no row holds a file, wherever the file is cut; lines before the first protein are no model."""
    head = "##gff-version 3\nc0\tminiprot\tmRNA\t1\t2\t.\t+\t.\tID=0;Rank=1;Identity=0.5;Target=A 1 4\n"
    one = "##STA\tM{0}*\n##ATN\tx\nc1\tminiprot\tmRNA\t{0}\t{0}\t.\t+\t.\tID={0};Rank=1;Identity=0.98;Target=A{0} 1 4\nc1\tminiprot\tCDS\t1\t2\n##STA\tunused\n##PAF\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.gff").write_text(head + "".join(one.format(i) for i in range(3000)))
    (tmp_path / "m" / "b.gff").write_text("".join(one.format(i) for i in range(3000, 3010)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        found = T.miniprot(spark, str(tmp_path / "m"))
        rows = found.select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.start, r.protein, r.anchor) for r in rows) == [(i, f"M{i}*", f"A{i}") for i in range(3010)]
    assert len({r.task for r in rows}) > 20


def test_newest_file(spark, put, tmp_path):
    import os

    for i, name in enumerate(("r/a/groups.tsv", "r/b/groups.tsv")):
        os.utime(put(name, "x"), (1000 * (i + 1), 1000 * (i + 1)))
    assert T.newest(spark, str(tmp_path / "r"), "groups.tsv").endswith("/b/groups.tsv")


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("1", "B", "b1"), ("1", "A", "a2"), ("1", "A", "a1"), ("2", "Z", "z")], "grp string, sp string, gene string")
    assert [(r.grp, r.A, r.B) for r in K.wide_groups(m, "grp", "sp", "gene", ["A", "B"]).collect()] == [("1", "a1, a2", "b1")]
    every = spark.createDataFrame([(x,) for x in ("a1", "zzzz2", "b1", "k", "zzzz1")], "gene string")
    assert sorted((r.gene, r.group) for r in K.singletons(every, m, "gene").collect()) == [("k", "UNG0000000"), ("zzzz1", "UNG0000001"), ("zzzz2", "UNG0000002")]
    loci = spark.createDataFrame([("l", 1, 6)], "locus string, start long, end long")
    assert K.partitions(loci).first().value == "DNA, l = 1-6"
    K.tsv(m.groupBy("grp").agg(F.sort_array(F.collect_list("gene")).alias("g")), str(tmp_path / "t"))
    assert "a1,a2,b1" in {r.g for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()}
    assert "none" in K.narrative("F", "S", {"verdict": "v", "evidence_for": ["x"], "evidence_against": []})


def test_settings(tmp_path, caplog):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"max_rounds": 3, "nonsense": 1}))
    s = Settings.from_json(str(path))
    assert s.max_rounds == 3 and s.min_orthogroup_size == 4 and "nonsense" in caplog.text
    s.to_json(str(path))
    assert Settings.from_json(str(path)) == s


def test_tools(spark):
    assert X.clustering_command("of", "in", "out", 8) == ["of", "-f", "in", "-o", "out", "-t", "8", "-a", "8", "-og"]
    assert "-f" not in X.clustering_command("of", "in", "out", 8, resume_from="old")
    with pytest.raises(ValueError, match="reserved"):
        X.clustering_command("of", "in", "out", 8, extra=["-o"])
    assert "--auto" in X.align_command("mafft", "strange", "x", 1) and "-nt" in X.tree_command("fasttree", "x", True)
    assert "model = 2" in X.codeml_control("a", "b", "c", branch_site="null").replace("  ", "") and X.phylip({"a": "ATG"}) == " 1 3\na  ATG\n"
    axes = X.plan("my file.fa", "out")
    assert X.missing_inputs(axes) == {"foldseek": "structures"} and "'my file.fa'" in axes[0].command
    assert len(X.plan("f", "o", drop_unavailable=True)) == 4 and X.local_outputs(axes, "here")[0].output.startswith("here/")
    with pytest.raises(ValueError, match="unknown"):
        X.plan("f", "o", axes=["nope"])
    assert [len(c) for c in X.chunked(iter([">a", "x", ">b", ">c"]), ">", 2)] == [3, 1]


def test_a_failed_group_is_reported_and_others_finish(spark):
    import pandas as pd

    df = spark.createDataFrame([("a", "one"), ("b", "boom")], "grp string, v string")
    tool = X.Tool("sh", "/bin/sh -c 'grep -v boom {input} > {output}'")
    out = X.per_group(df, ["grp"], tool, lambda pdf, p: p.write_text("\n".join(pdf.v)), lambda p: pd.DataFrame({"said": p.read_text().split()}), "grp string, said string, error string")
    got = {r.grp: (r.said, r.error) for r in out.collect()}
    assert got["a"] == ("one", None) and got["b"][0] is None and "exit 1" in got["b"][1]
    with pytest.raises(ValueError, match="no command"):
        X.Tool("x").argv()


def test_fields_are_split_once_a_row(spark, put):
    """Filters on fields that fail to parse don't split the line again each."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    line = "g1 - 200 Fam - 100 1e-30 180.5 0.1 1 2 1e-9 1e-9 100.5 0.0 1 60 1 50 1 90 0.9 text\n"
    assert plan(T.domtblout(spark, put("once.domtbl", line))).count("split(") == 1
    assert plan(T.foldseek(spark, put("once.tsv", "g\tR1_OG1\t1\t2\t0.5\n"))).count("split(value") == 1


def test_best_rows_are_dealt_by_bytes_and_ties_go_to_the_first_file(spark, put, monkeypatch):
    """A task's share is bounded however long the table is; of equal hits the first row of the first file wins, whatever the files' names are."""
    monkeypatch.setattr(T, "TASK_BYTES", 1000)
    names = ("part b é.txt", "part a%20.txt", "part c.txt")
    for n in names:
        path = put(f"deal/{n}", "".join(f"g{i} - F{n[5]}{k} - 1e-9\n" for k in (1, 2) for i in range(500)) + f"odd - {n[5]} - 1e-7\n")
    folder = str(path).rsplit("/", 1)[0]
    best = T.tblout(spark, folder)
    per = [r["count"] for r in best.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(per) == 501 and len(per) > 30 and max(per) < 50
    assert {r.family for r in best.collect()} == {"Fa1", "a"}


def test_a_hits_domains_come_in_the_files_order(spark, put, monkeypatch):
    monkeypatch.setattr(T, "TASK_BYTES", 1000)
    row = lambda i, bits, d: f"g{i} - 200 Fam - 100 1e-30 {bits} 0.1 1 2 1e-9 1e-9 {d} 0.0 {d} 60 {d} 50 1 90 0.9 text\n"
    for n, bits, ds in (("b", 20, (1, 4)), ("a", 10, (9, 2))):
        path = put(f"domains/{n}.txt", "".join(row(i, bits, d) for d in ds for i in range(100)))
    out = T.domtblout(spark, str(path).rsplit("/", 1)[0])
    assert {(r.bits, tuple(d.hmm_from for d in r.domains)) for r in out.collect()} == {(10.0, (9, 2, 1, 4))} and out.count() == 100
    assert [f.name for f in out.schema["domains"].dataType.elementType] == ["hmm_from", "hmm_to", "ali_from", "ali_to", "dom_bits"]
    assert out.groupBy(F.spark_partition_id()).count().count() > 20


def test_structure_hits_are_dealt_by_gene_and_family(spark, put, monkeypatch):
    monkeypatch.setattr(T, "TASK_BYTES", 1000)
    best = T.foldseek(spark, put("dealt.tsv", "".join(f"g{i}\tR1_OG{i % 7}.pdb\t1e-9\t{k}\t0.5\n" for k in (1, 2) for i in range(500))))
    per = [r["count"] for r in best.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 500 and len(per) > 20 and {r.bits for r in best.collect()} == {1.0}


def test_best_hits_are_dealt_by_query_and_species(spark, put, monkeypatch):
    monkeypatch.setattr(T, "TASK_BYTES", 1000)
    line = lambda q, s, b: "\t".join([q, s, "90", "100", "0", "0", "1", "10", "1", "10", "1e-9", str(b)]) + "\n"
    path = put("dealt.b6", "".join(line(f"q{i}", f"S{s}_{k}", 50) for k in (1, 2) for i in range(200) for s in range(2)))
    best = T.blast_best(spark, path, F.split_part("sseqid", F.lit("_"), F.lit(1)).alias("species"))
    per = [r["count"] for r in best.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 400 and len(per) > 20 and {r.sseqid for r in best.collect()} == {"S0_1", "S1_1"}
