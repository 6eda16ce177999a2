from cladeframe import cli


def read(spark, path):
    return spark.read.option("sep", "\t").option("header", True).csv(str(path))


def test_jobs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "c").mkdir()
    (tmp_path / "p/a.faa").write_text(">Sp_a\nMK*KL\n>Sp_b\nMKL\n")
    (tmp_path / "c/a.fna").write_text(">Sp_a\nATGAAATAAAAACTG\n>Sp_b\nATGAAACTG\n")
    (tmp_path / "summary.tsv").write_text("family_id\tround\tgene_list\nR1_OG1\t1\tSp_a\n")
    cli.main(["pseudogenes", "--proteins", f"{tmp_path}/p", "--cds", f"{tmp_path}/c", "--summary", f"{tmp_path}/summary.tsv", "--out", f"{tmp_path}/o1"], spark)
    got = {r.gene: (r["class"], r.summary) for r in read(spark, tmp_path / "o1").collect()}
    assert got == {"Sp_a": ("pseudogene_medium", "internal_stops=1"), "Sp_b": ("pseudogene_medium", "orphan")}
    (tmp_path / "t.nwk").write_text("((a,b),(c,d));")
    (tmp_path / "states.tsv").write_text("a\tX\nb\tY\nc\tY\nd\tY\n")
    cli.main(["switches", "--trees", f"{tmp_path}/t.nwk", "--states", f"{tmp_path}/states.tsv", "--out", f"{tmp_path}/o2"], spark)
    assert [(r.parent_state, r.child_state, r.clade_leaves) for r in read(spark, tmp_path / "o2").collect()] == [("Y", "X", "a")]
    cli.main(["plan", "--fasta", "f.fa", "--folder", "o", "--out", f"{tmp_path}/o3"], spark)
    assert read(spark, tmp_path / "o3").count() == 4
    (tmp_path / "f.b6").write_text("\t".join(["Sp_a", "T1", "90", "9", "0", "0", "1", "9", "1", "9", "1e-9", "50"]) + "\n")
    (tmp_path / "r.b6").write_text("\t".join(["T1", "Sp_a", "90", "9", "0", "0", "1", "9", "1", "9", "1e-9", "50"]) + "\n")
    cli.main(["orthology", "--forward", f"{tmp_path}/f.b6", "--reverse", f"{tmp_path}/r.b6", "--out", f"{tmp_path}/o4"], spark)
    assert [r.rbh for r in read(spark, tmp_path / "o4").collect()] == ["yes"]
    cli.main(["lengths", "--proteins", f"{tmp_path}/p", "--out", f"{tmp_path}/o5", "--floor", "4"], spark)
    assert [(r.species, r.n_short) for r in read(spark, tmp_path / "o5").collect()] == [("Sp", "1")]
