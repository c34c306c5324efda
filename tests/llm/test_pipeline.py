"""The pipeline against a plain version of each stage, and odd rows for the operators on pages and labels."""

import hashlib
import os

import numpy as np
import pytest
import xxhash

from stratalog.llm import bpe, common, htmltext, queries, toxicity, urlfilter

DATA = "/root/testdata/sf0.001"


def _plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_pipeline(docs):
    """Rows of docs (a pandas table) after all stages: pairs of all, a dictionary of all, SQL, the library."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", docs)
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op10_quality_rules']}) WHERE kept").fetchall()}
    docs = docs[docs["doc_id"].isin(good)]
    owner = {}
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        owner[key] = min(owner.get(key, (-len(t), i)), (-len(t), i))
    docs = docs[docs["doc_id"].isin([i for _, i in owner.values()])].sort_values("doc_id")
    fp, ids = [_plain_fingerprint(t) for t in docs["text"]], list(docs["doc_id"])
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    docs = docs[[g == i for i, g in enumerate(group)]]
    con.unregister("documents")
    con.register("documents", docs)
    times = {i: int(taken / size + 0.5) if size else 0 for i, size, _, _, taken in con.sql(queries.ORACLE_SQL["op8_mixing"]).fetchall()}
    library, rows = bpe.codec(bpe.vocabulary_path()).library, []
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        rows += [(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))] * times[i]
    return sorted(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_against_plain_version(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA)
    want = _plain_pipeline(spark.read.parquet(f"{DATA}/documents.parquet").toPandas())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want and len(want) > 50


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, repeats, clashing columns, one identifier with several texts and none with several: no document is lost."""
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20)) + "."
    rows = [(None, text(1), "a"), (None, text(2), "a"), (5, text(3), "a"), (5, text(4), None), (6, text(3), "b"), (7, None, "a"), (8, "", None), (9, text(5), None), (9, text(5), None), (10, text(6) + " " + "tail. " * 3, "b"), (11, " ".join(f"v{i}" for i in range(30_000)) + ".", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, taken long"
    table = spark.createDataFrame([(i, t, "en", s, None, "x", 1, 2) for i, t, s in rows], schema)
    for name, part in (("all", table), ("none", table.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs, columns = common.read(spark, f"{tmp_path}/{name}", "documents"), table.columns
        for stage, f in corpus_pipeline.STAGES[:3]:
            docs = f(spark, docs, "")
            assert docs.columns == columns, stage
        kept = sorted((r.doc_id or 0, r.text[:6]) for r in docs.collect())
        assert kept == ([(0, "w1x0 w"), (0, "w2x0 w"), (5, "w3x0 w"), (5, "w4x0 w"), (9, "w5x0 w"), (10, "w6x0 w"), (11, "v0 v1 ")] if name == "all" else [])
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        ids = {r.doc_id for r in got.collect()}
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (ids >= {None, 5, 9, 10} if name == "all" else not ids)


PAGES = "page_id long, url string, html string, host string, rule string, text string, score double"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a.com/x", "<p>x"), (4, "http://a.com/x", "<p>x"), (4, "http://a.com/x", "<p>x"), (5, "http://b.org/" + "y" * 100_000, "<b>" * 50_000 + "z")]
    pages = spark.createDataFrame([(i, u, h, "clash", "clash", "clash", 1.0) for i, u, h in rows], PAGES)
    for query in (urlfilter.judge, htmltext.extract_pages):
        got = query(pages).collect()
        assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
        assert len({tuple(r) for r in got if r.page_id == 4}) == 1  # repeated rows get equal results
        assert query(pages.limit(0)).count() == 0
    got = {r.page_id: r for r in htmltext.extract_pages(pages).collect()}
    assert got[1].text == got[2].text == "" and got[4].text == "x" and got[5].text == "z"


def test_odd_documents_for_toxicity(spark):
    schema = "doc_id long, text string, toxic int, score double, held_out boolean"
    rows = [(1, None), (2, ""), (None, "no id"), (4, "same"), (4, "same"), (5, "very long " * 40_000)] + [(i, f"text {i} " + "awful " * (i % 2)) for i in range(10, 60)]
    docs = spark.createDataFrame([(i, t, 9, 9.0, True) for i, t in rows], schema)
    labels = spark.createDataFrame([(i, None if i % 9 == 0 else i % 2, "clash") for i in range(10, 60)] + [(10, 0, "repeated"), (None, 1, "x"), (777, 1, "no such document")], "doc_id long, toxic int, text string")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0
