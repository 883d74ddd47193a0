"""The pipeline's stages, on the driver's small tables against a plain chain of them, and on edge cases."""

import hashlib
import os
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns
    left = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert sum((d in left) == bool(q) for d, q in marks.items()) / len(marks) > 0.95
    assert 0 < corpus_pipeline.run(spark, SF).count() <= len(left)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    out = {}
    for i in range(max(1, len(words) - 4)) if words else []:
        key = tuple(words[i : i + 5])
        out[key] = out.get(key, 0) + 1
    return out


def alike(a, b):
    common = sum(min(n, b.get(s, 0)) for s, n in a.items())
    return bool(a) and bool(b) and common >= 0.8 * (sum(a.values()) + sum(b.values()) - common)


def stripped(text, windows, first=True):
    """text without benchmark passages, None if they are most of it."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
    words = [lowered(text[a:z]) for a, z in spans]
    hit = {i + j for i in range(len(words)) for n in {len(w) for w in windows} if tuple(words[i : i + n]) in windows for j in range(n)}
    if not hit:
        return text
    if first and len(hit) > 0.5 * len(words):
        return None
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at : spans[i][0]])
        at = spans[i][1]
    return stripped("".join(out) + text[at:], windows, False)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline_equals_a_plain_chain(spark):
    """Given the scores of the classifier; all else is done again by loops."""
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    from lodestone.llm import bpe, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    accepted = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["score"] >= 0.5}
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in accepted}
    last = {lowered(t): d for d, t in sorted(rows.items())}  # the largest id stays
    rows = {d: rows[d] for d in last.values()}
    bags, root = {d: shingles(t) for d, t in rows.items()}, {d: d for d in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in rows:
        for b in rows:
            if a < b and alike(bags[a], bags[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    empty = [d for d in rows if not bags[d]]
    assert len({rows[d] for d in empty}) == len(empty)
    rows = {d: rows[d] for d in rows if top(d) == d}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r["text"] or ""))
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    clean = {d: stripped(t, windows) for d, t in rows.items()}
    clean = {d: t for d, t in clean.items() if t is not None}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((d, len(ids := lib.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for d, t in clean.items())
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) > 50


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    rows = [(1, "same text here", "en"), (2, "same text here", "en"), (2, "same text here", "en"), (None, None, None), (3, "", None), (4, "x" * 50000, "de"), (None, "lone", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    function = dict(corpus_pipeline.STAGES)[stage]
    for table in (docs, docs.limit(0)):
        out = function(spark, table, SF)
        assert out.count() <= table.count()
        if stage != "tokens":
            assert out.columns == docs.columns
