"""The pipeline's stages against plain versions on a small table, and its registration."""

import random

import corpus_pipeline
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "packing"]


@pytest.mark.parametrize("last", [4])
def test_stages(spark, last):
    from test_text_ops import plain_components, plain_contamination, plain_line_dedup, reference_ids

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = {0: {r.doc_id: r for r in docs.collect()}}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:last]):
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA))
        assert docs.columns == columns
        rows[k + 1] = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 0").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert len(toxic & gone) >= 0.9 * len(toxic) and len(clean & gone) <= 0.02 * len(clean)
    pairs = lambda k: [(i, r.text) for i, r in rows[k].items()]
    assert {i: r.text for i, r in rows[2].items()} == {i: t for i, _, _, t in plain_line_dedup(pairs(1), 10)}
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    assert set(rows[3]) == {i for i, _, _, kept in plain_components(pairs(2)) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(rows[4]) == {x[0] for x in plain_contamination(pairs(3), items, 13) if not x[4]}
    pieces = corpus_pipeline.packing(spark, docs, DATA).collect()
    ids = dict(zip(rows[4], reference_ids([r.text for r in rows[4].values()]), strict=True))
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(x) + 1 for i, x in ids.items()}
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids.values())


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Nulls in all columns, empty and long texts, repeated rows, and columns with clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(n))
    passage, line = text(30), "a line that many share"
    rows = [(k, text(60) + "\n" + line if k < 12 else text(60)) for k in range(30)]
    rows += [(100, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (101, passage), (102, "vile " * 40 + text(20))]
    rows += [(103, None), (104, ""), (None, text(40)), (None, None), (105, text(30_000)), (106, " \n \n")]
    docs = [(i, t, "xx", "s", len(t or ""), 1, "kept?", 0.5) for i, t in rows] + [(None,) * 8]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, sequence_id int, kept string, p_toxic double"
    spark.createDataFrame(docs, kinds).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in range(20)] + [(102, 0, 1), (102, 0, 1), (None, 1, 1), (5, None, None), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = [("b1", passage), ("b2", None), ("b3", ""), (None, text(20))]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_odd_rows(spark, odd_tables):
    pieces = corpus_pipeline.run(spark, odd_tables).collect()
    ids = {p.doc_id for p in pieces}
    assert ids >= {0, 3, 29, 103, 104, 105, 106, None} and not ids & {100, 101}
    assert sum(p.doc_id == 3 for p in pieces) == 1  # three repeats of one row
    assert sum(p.doc_id is None for p in pieces) == 3
    assert {p.doc_tokens for p in pieces if p.doc_id in (103, 104)} == {1}
    seen = {}
    for p in pieces:
        seen.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in seen.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= 1024


def test_stages_of_an_empty_table(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd_tables)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_each_stage_keeps_odd_rows(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    rest = ["lang", "source", "sequence_id", "kept", "p_toxic"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, odd_tables)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert out.filter("doc_id IS NULL").count() == 3
        assert {tuple(r) for r in out.select(*rest).collect()} <= {tuple(r) for r in docs.select(*rest).collect()}
