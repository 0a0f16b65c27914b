import subprocess
import sys
from itertools import combinations
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from novelscape.llm import queries
from tests.llm import edge
from tests.llm.test_duplicates import plain_lines
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "decontamination", "packing"]
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[1:-1])


def test_quality_drops_junk(spark, stages):
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {d for d, _ in rows_of(stages[1])}
    right = [(d in kept) == (known[d] == 1) for d, _ in rows_of(stages[0]) if known.get(d) is not None]
    assert sum(right) >= 0.95 * len(right)


def test_lines(stages):
    import hashlib

    before, after = rows_of(stages[1]), dict(rows_of(stages[2]))
    wanted = {d: digest for d, _, _, digest in plain_lines([(d, t, None, None) for d, t in before])}
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in after.items()} == wanted


def test_near_copies(stages):
    before, after = rows_of(stages[2]), {d for d, _ in rows_of(stages[3])}
    sets = {}
    for d, t in before:
        w = edge.words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    first = {d: d for d in sets}
    for (a, b), share in alike.items():
        if share >= 0.8 and first[a] != first[b]:
            old, new = max(first[a], first[b]), min(first[a], first[b])
            first = {d: new if x == old else x for d, x in first.items()}
    assert after == set(first.values())


def test_decontamination(spark, stages):
    items = [edge.words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 8]) for w in items for i in range(len(w) - 7)}
    after = {d for d, _ in rows_of(stages[4])}
    for d, t in rows_of(stages[3]):
        w = edge.words(t)
        assert (d in after) == (not any(tuple(w[i : i + 8]) in grams for i in range(len(w) - 7)))


def test_packing(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(d, t, None, None) for d, t in rows_of(stages[4])]
    used, least = check_packing(library, rows, stages[5].collect(), 4096)
    assert used <= least + 1


def test_run_does_all_stages(spark, stages):
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, FOLDER).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1].select(columns).collect()))


def test_stages_bear_odd_rows(spark, tmp_path):
    """Nulls, empty, long and repeated rows and more columns; then no rows at all."""
    for rows in (edge.rows(), []):
        docs = edge.frame(spark, rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{k}")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.isEmpty() == (not rows)


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)


def test_entry_without_this_part(tmp_path):
    for file in ROOT.glob("*.py"):
        if file.name != "corpus_pipeline.py":
            (tmp_path / file.name).write_text(file.read_text())
    package = tmp_path / "novelscape"
    package.mkdir()
    for part in (ROOT / "novelscape").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (package / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; print(sorted(e.queries())[:3], 'pipeline' in e.queries(), len(e.oracle_sql()) > 50)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "False True" in done.stdout, done.stderr
