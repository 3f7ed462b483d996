"""Pipeline stages on the smallest tables, and on columns whose names operators use."""

import hashlib
import struct

import corpus_pipeline
from hirelake.llm.decontamination import MIN_WINDOW, THETA, Index, terms
from hirelake.llm.queries import ORACLE, QUERIES, tokenizer_path
from hirelake.llm.secret_scan import redact, scan
from test_operators import BASE, LONG, NEAR, brute_groups


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out = out.cache()
        if name == "jaccard_join":
            groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, g) in groups.items() if i == g}
        if name == "secret_scans":
            assert out.count() == docs.count()
        docs = out
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() == docs.count() and last.filter("n_tokens = 0").count() == 0


def test_run_rows(spark, sf_dir):
    """run() against plain near duplicates, leaks, redaction and tokens; the quality stage has SQL of its own."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()]
    groups = brute_groups(rows, 5, 80, 100)
    index = Index([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])

    def leaks(text):
        words = terms(text)
        for at in range(0, max(1, len(words) - MIN_WINDOW), MIN_WINDOW):
            part = words[at : at + 2 * MIN_WINDOW]
            here = {n: {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} for n in (1, 2, 3)}
            for weights, parts in zip(index.weights, index.parts):
                if sum(w for t, w in weights.items() if (t,) in here[1]) >= THETA - 1e-9 and all(not g or 2 * len(g & here[n]) >= len(g) for n, g in parts):
                    return True
        return False

    tok, want = Tokenizer.from_file(tokenizer_path()), {}
    for i, t in rows:
        if i == groups[i][1] and not leaks(t):
            ids = tok.encode(redact(t, scan(t)[1]), add_special_tokens=False).ids
            decoded = tok.decode(ids, skip_special_tokens=False)
            want[i] = (len(ids), struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_ids_of_several_texts(spark, sf_dir):
    """A clean text isn't lost for an id it shares; null counts as the smallest id; no order of rows matters."""
    other = LONG[2000:3500]
    rows = [(7, BASE, "b"), (7, other, "x"), (7, BASE, "a"), (9, NEAR, "n"), (9, LONG[5000:6000], "y"), (3, other, "z"), (8, LONG[9000:9900], "c"), (8, LONG[9000:9900], "d"), (None, LONG[12000:13000], "u"), (None, LONG[12000:13000], "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = set()
    for d in (docs, docs.repartition(5, "source"), docs.orderBy(docs.source.desc())):
        got = corpus_pipeline.near_duplicates(spark, d, sf_dir)
        assert got.columns == docs.columns
        kept = sorted(map(tuple, got.collect()), key=str)
        assert sorted((i, t) for i, t, _ in kept if i) == sorted([(7, BASE), (9, rows[4][1]), (3, other), (8, rows[6][1])]) and (*rows[8],) in kept and len(kept) == 5
        seen.add(tuple(kept))
    assert len(seen) == 1


def test_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "'mine' AS kept", "'mine' AS spans", "'mine' AS contaminated", "'mine' AS `_w`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.filter("kept = 'mine' and spans = 'mine' and contaminated = 'mine'").count() == out.count()


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLE) <= set(QUERIES)
