"""The pipeline on the smallest tables, stage against stage."""

import zlib

import corpus_pipeline
import numpy as np
from inkfold.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        seen.append(len(now))
        ids = now
    assert seen[0] > 150 and seen[3] == seen[2]
    tokenizer, start, want = Tokenizer.from_file(tokenizer_file()), 0, []
    for r in docs.orderBy("doc_id", "text").collect():
        x = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_awkward_rows_and_empty_table(spark, tmp_path):
    """Every stage keeps awkward clean rows and columns whose names operators use inside, and gives nothing for nothing."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, component long, held_out boolean"
    plain = [f"{w} " * 3 + f"row {i} of plain words that nobody else has written {i * 31}" for i, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    rows = [(i, t) for i, t in enumerate(plain)] + [(10, None), (11, ""), (12, " \n\t "), (13, "word " * 60_000 + "end"), (14, plain[0]), (14, plain[0]), (None, plain[1] + " and more of its own kind"), (15, "é ü — 's")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, 1, 2, True) for i, t in rows], kinds).repartition(3)
    empty = docs.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == [c.split()[0] for c in kinds.split(", ")]
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left >= {0, 1, 2, 3, 10, 11, 12, 13, 15, None} and (i == 0 or 14 not in left)
        assert stage(spark, empty, SF).count() == 0
    told = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert told.count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
