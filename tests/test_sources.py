import json

import pytest
from pyspark.sql import functions as F

from novelscape.plans.curate import curate
from novelscape.sources import annotated, genbank, predicted, records, tables


def feature(kind, location, *qualifiers):
    lines = [f"     {kind:<16}{location}"]
    for key, value in qualifiers:
        lines.append(" " * 21 + f'/{key}="{value}"')
    return "\n".join(lines)


def record(name, *features, bases="acgt" * 30):
    text = f"LOCUS       {name}   120 bp    DNA     linear\nDEFINITION  test.\nACCESSION   {name}\nVERSION     {name}.1\n"
    return text + "FEATURES             Location/Qualifiers\n" + "\n".join(features) + f"\nORIGIN\n        1 {bases}\n//\n"


REGION = record(
    "REG1",
    feature("source", "1..120"),
    feature("region", "1..120", ("product", "NRPS"), ("product", "T1PKS")),
    feature("CDS", "complement(join(1..30,61..90))", ("locus_tag", "g1"), ("product", "nonribosomal\n                     peptide synthase"), ("translation", "MKTAYIAKQR\n                     QISF")),
    feature("aSDomain", "70..80", ("domain", "AMP-binding")),
    feature("aSDomain", "10..20", ("domain", "Condensation")),
    feature("CDS", "100..>120", ("gene", "g2"), ("product", "odd"), ("note", "x")),
)
PLAIN = record("PLAIN", feature("CDS", "1..90", ("product", "kinase"), ("gene_functions", "other: halogenase ")))


@pytest.fixture
def gbk(tmp_path):
    folder = tmp_path / "gbk"
    folder.mkdir()
    (folder / "BGC0000001.gbk").write_text(REGION)
    (folder / "BGC0000002.gbk").write_text(PLAIN + REGION)
    return folder


def payload(**extra):
    base = {
        "accession": "BGC0000001.4",
        "biosynthesis": {"classes": [{"class": "NRPS", "subclass": "x"}]},
        "taxonomy": {"name": "Genus species", "ncbiTaxId": 7},
        "compounds": [{"name": "c1"}, "c2", {"compound": "c3"}, {}],
        "genes": {"annotations": [{"id": 1}, {"id": 2}], "to_add": [{}]},
        "changelog": {"releases": [{"date": "2021-06-15", "entries": [{"date": "2019-01-01"}, {"date": "soon"}]}]},
    }
    return {**base, **extra}


def test_curate(spark, tmp_path, gbk):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "BGC0000001.json").write_text(json.dumps(payload()))
    (folder / "BGC0000001_copy.json").write_text(json.dumps(payload(status="later")))
    (folder / "BGC0000003.json").write_text(json.dumps({"biosynthesis": {"classes": ["PKS", "Terpene", ""]}, "taxonomy": "odd", "genes": [1, 2], "changelog": {}}))
    (folder / "BGC0000004.json").write_text("{broken")
    (folder / "other.json").write_text("{}")
    entities, tokens, members = curate(spark, str(folder), str(gbk))
    rows = {r["entity_id"]: r for r in entities.collect()}
    assert set(rows) == {"BGC0000001", "BGC0000002", "BGC0000003"}
    first = rows["BGC0000001"]
    assert (first["biosynth_class"], first["organism"], first["ncbi_tax_id"], first["status"]) == ("NRPS", "Genus species", 7, "")
    assert (first["n_compounds"], first["compounds"], first["n_genes_json"]) == (4, ["c1", "c2", "c3", ""], 3)
    assert (first["date_added"], first["date_latest"]) == ("2019-01-01", "2021-06-15")
    assert (first["n_genes"], first["cluster_nt_length"], first["total_aa_length"], first["mean_aa_length"]) == (2, 120, 14 + 7, 10.5)
    assert first["domain_types"] == ["AMP-binding", "CDS_other", "Condensation", "NRPS_module", "nonribosomal_peptide"]
    third = rows["BGC0000003"]
    assert (third["biosynth_class"], third["organism"], third["n_genes"], third["date_added"]) == ("hybrid", "unknown", 2, None)
    assert third["cluster_nt_length"] is None
    second = rows["BGC0000002"]
    assert (second["biosynth_class"], second["organism"], second["n_genes"], second["total_aa_length"]) == ("other", "unknown", 1, 30)
    listed = tokens.where("entity_id = 'BGC0000001'").orderBy("gene_order", "token_pos").collect()
    assert [(r["feature_type"], r["gene_order"], r["token"]) for r in listed] == [
        ("CDS", 1, ""),
        ("domain", 1, "NRPS_module"),
        ("domain", 1, "nonribosomal_peptide"),
        ("domain", 1, "AMP-binding"),
        ("domain", 1, "Condensation"),
        ("CDS", 2, ""),
        ("domain", 2, "CDS_other"),
    ]
    member = members.where("entity_id = 'BGC0000001'").collect()
    assert [(m["locus_tag"], m["translation"]) for m in member] == [("g1", "MKTAYIAKQRQISF")]
    rejected = records.rejects(records.read_documents(spark, str(folder))).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in rejected] == ["BGC0000004.json"]


def test_predicted_genbank(spark, gbk):
    rows = predicted.load_predicted(spark, str(gbk), "gen").orderBy("bgc_id", "gene_order").collect()
    got = [(r["genome"], r["bgc_id"], r["predicted_class"], r["domain_id"], r["n_genes"]) for r in rows]
    assert got == [
        ("gen", "BGC0000001", "hybrid", "Condensation", 2),
        ("gen", "BGC0000001", "hybrid", "AMP-binding", 2),
        ("gen", "BGC0000002", "other", "kinase", 1),
        ("gen", "BGC0000002", "other", "halogenase", 1),
        ("gen", "BGC0000002_2", "hybrid", "Condensation", 2),
        ("gen", "BGC0000002_2", "hybrid", "AMP-binding", 2),
    ]
    assert rows[0].__fields__ == list(predicted.COLUMNS)


def test_region_files_win(spark, gbk):
    (gbk / "c.region001.gbk").write_text(record("EMPTY", feature("source", "1..120")))
    rows = predicted.load_predicted(spark, str(gbk)).collect()
    assert [(r["genome"], r["bgc_id"], r["domain_id"], r["n_genes"]) for r in rows] == [("gbk", "c.region001", "unknown", 1)]


def test_region_json(spark, tmp_path):
    areas = [
        {"products": ["NRPS", "T1PKS"], "cds": [{"product": "synthase", "domains": ["C", {"name": "A"}]}, {"function": ["f", ""], "pfams": [{"id": "PF1"}]}]},
        {"products": ["terpene"]},
        {"orfs": [{}]},
    ]
    path = tmp_path / "genome1.json"
    path.write_text(json.dumps({"records": [{"name": "contig A", "areas": areas}, {"id": "r2", "regions": [{"products": ["ripp"]}]}]}))
    rows = predicted.load_predicted(spark, str(path)).orderBy("bgc_id", "gene_order").collect()
    got = [(r["genome"], r["bgc_id"], r["predicted_class"], r["domain_id"], r["n_genes"]) for r in rows]
    assert got == [
        ("genome1", "contig_A_r1", "hybrid", t, 2) for t in ("synthase", "C", "A", "f", "PF1")
    ] + [
        ("genome1", "contig_A_r2", "terpene", "terpene", 1),
        ("genome1", "contig_A_r3", "other", "unknown", 1),
        ("genome1", "r2_r1", "RiPP", "ripp", 1),
    ]


def test_dispatch(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("genome,bgc_id,predicted_class,gene_order,domain_id,n_genes,extra\ng,b,PKS,1,KS,4,z\n")
    row = predicted.load_predicted(spark, str(path)).first()
    assert (row["gene_order"], row["n_genes"], row["domain_id"]) == (1, 4, "KS")
    bad = tmp_path / "bad.csv"
    bad.write_text("genome,bgc_id\ng,b\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        predicted.load_predicted(spark, str(bad))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        predicted.load_predicted(spark, str(tmp_path / "none"))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 0.5)], "entity_id int, tags array<string>, x double")
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t")).first()["tags"] == ["a", "b"]
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "entity_id int, tags string, x double").first()["tags"] == "a;b"
    tables.write_audit(df.select(F.struct("x").alias("nested"), F.lit(None).cast("int").alias("n")), str(tmp_path / "a"))
    assert tables.read_audit(spark, str(tmp_path / "a")).first()["nested"]["x"] == 0.5
    assert tables.read_audit(spark, str(tmp_path / "missing")) is None
    for run in ("r1", "r2", "r1"):
        tables.cache_input(df, str(tmp_path / "k"), run)
    assert spark.read.parquet(str(tmp_path / "k")).count() == 2
    tables.append_rows(df, str(tmp_path / "s"))
    tables.append_rows(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    vectors = spark.createDataFrame([("e", [1.0])], "entity_id string, embedding array<float>")
    tables.write_vectors(vectors, str(tmp_path / "v"))
    assert tables.read_vectors(spark, str(tmp_path / "v")).first()["embedding"] == [1.0]


def test_csv_order_breaks_ties(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("genome,bgc_id,predicted_class,gene_order,domain_id,n_genes\n" + "".join(f"g,b,PKS,1,{t},4\n" for t in "zmaqb"))
    rows = predicted.load_predicted(spark, str(path)).orderBy("gene_order", "token_pos").collect()
    assert [r["domain_id"] for r in rows] == list("zmaqb")


def test_line_ends(spark, tmp_path, gbk):
    twin = tmp_path / "twin"
    twin.mkdir()
    for file in gbk.iterdir():
        (twin / file.name).write_bytes(file.read_text().replace("\n", "\r\n").encode())
    columns = list(predicted.COLUMNS)
    tables_ = [sorted(map(tuple, predicted.load_predicted(spark, str(f), "g").select(columns).collect())) for f in (gbk, twin)]
    assert tables_[0] == tables_[1] and len(tables_[0]) == 6


def test_region_json_of_any_size(spark, tmp_path):
    folder = tmp_path / "regions"
    folder.mkdir()
    whole = {"records": [{"id": f"r{i}", "seq": {"data": "acgt" * 10_000_000}, "areas": [{"products": ["NRPS"]}, {"products": ["terpene"]}]} for i in range(4)]}
    (folder / "large.json").write_text(json.dumps(whole))
    (folder / "small.json").write_text(json.dumps({"records": [{"name": {"odd": 1}, "id": "x", "areas": [{"products": ["PKS", {"y": 1}]}]}, "odd", None]}))
    (folder / "broken.json").write_text('{"records": [{"id": "r1"')
    (folder / "list.json").write_text("[1]")
    documents = records.read_documents(spark, str(folder))
    rows = annotated.region_rows(documents).select("bgc_id").collect()
    assert sorted(r["bgc_id"] for r in rows) == sorted([f"r{i}_r{j}" for i in range(4) for j in (1, 2)] + ["x_r1"])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in annotated.region_rejects(documents).collect()) == ["broken.json", "list.json"]
    only = tmp_path / "only.json"
    only.write_text('{"records": []}')
    with pytest.raises(ValueError, match="no regions"):
        predicted.load_predicted(spark, str(only))


def test_odd_scalars(spark, tmp_path):
    (tmp_path / "BGC0000009.json").write_text(json.dumps(payload(accession={"x": 1}, taxonomy={"name": ["q"]}, status=[1], quality=3, biosynthesis={"classes": [" \tPKS\u00a0"]})))
    row = records.read_records(spark, str(tmp_path)).first()
    assert (row["entity_id"], row["organism"], row["status"], row["quality"], row["biosynth_class"]) == ("BGC0000009", "unknown", "", "3", "PKS")


def test_record_numbers(spark, gbk):
    numbered = genbank.read_records(spark, str(gbk)).groupBy("path").agg(F.max("record_no").alias("n")).orderBy("n").collect()
    assert [r["n"] for r in numbered] == [1, 2]


def test_features_are_numbered_within_their_record(spark):
    """Genes are counted in the record's own row; features before the first one have 0, and odd lines are none."""
    odd = "LOCUS x\nFEATURES   Location\n  CDS 1..2\n     CDSlike         1..3\n     CDS             4..9\n     aSDomain        5..6\n     misc_feature    7..8\n     CDS             10..12\n     PFAM_domain     11..12\nCONTIG a\n     CDS             1..2\nORIGIN\n"
    rows = [("a", odd), ("b", "LOCUS y\nORIGIN\n acgt\n//"), ("c", None), ("d", "LOCUS z\nFEATURES only")]
    found = genbank.numbered_features(spark.createDataFrame(rows, "path string, content string"), ["path"])
    got = {(r["path"], r["pos"]): (r["gene_order"], r["type"]) for r in found.collect()}
    kinds = ["CDSlike", "CDS", "aSDomain", "misc_feature", "CDS", "PFAM_domain"]
    assert [got[("a", 1 + i)] for i in range(6)] == list(zip([0, 1, 1, 1, 2, 2], kinds))
    assert sorted((p, n) for p, n in got if n == 0) == [("a", 0), ("b", 0), ("d", 0)] and ("c", None) in got and len(got) == 10
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    plain = genbank.features(spark.createDataFrame(rows, "path string, content string"), ["path"])
    assert sorted((r["pos"], r["type"]) for r in plain.collect()) == list(zip(range(1, 7), kinds))


def test_sections(spark):
    texts = ["A\nORIGIN x\n1 ac\n2 gt\n//\nORIGIN\n9 no\n//", "ORIGIN\nac", "A\nORIGIN", "A\nORIGIN\n//", "A\nORIGIN\n\nab", "é\nORIGIN é\né ü\nWGS x\n//"]
    section = genbank._section(F.col("value"), "ORIGIN", "//", "WGS")
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string").orderBy("i").select(section).collect()]
    assert got == ["1 ac\n2 gt", "", "", "", "\nab", "é ü"]
