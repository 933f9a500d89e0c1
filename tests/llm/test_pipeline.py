import zlib

import numpy as np
import public_tokenizers
import test_line_dedup
import test_near_dedup
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality
from graphloom.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_end_in_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        assert 0 < docs.count() <= rows
        rows = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    got = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces.collect()}
    assert {r[0] for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    run = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == got


def quality_stage(spark, rows, docs, labels):
    net = quality.train(docs, labels)
    return [(i, t) for i, t in rows if net.score([(t or "").encode()])[0] >= 0.3]


def lines_stage(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(test_line_dedup.key(line)) >= 40:
                holders.setdefault(test_line_dedup.key(line), set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(i, t and "\n".join(x for x in t.split("\n") if last.get(test_line_dedup.key(x), i) == i)) for i, t in rows]


def substrings_stage(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if first[raw[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, t and "".join(kept)))
    return out


def test_run_against_brute_force(spark, tmp_path):
    """Every stage by plain Python, over the smallest table with odd rows and clashing columns added."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    base = plain.where("doc_id = 11").first()
    odd = [(900_001, None), (900_002, ""), (900_003, "a lone short text"), (900_004, base.text), (900_005, "ünïcödé wörds ärë hëre " * 900), (900_006, "repeated row of its own"), (900_006, "repeated row of its own")]
    more = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.unionByName(more.select(*(F.col(c).cast(plain.schema[c].dataType).alias(c) for c in plain.columns)))
    docs.withColumns({"id": F.lit(1), "component_id": F.lit("clash"), "n": F.lit(2.0), "ranges": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = quality_stage(spark, [(r.doc_id, r.text) for r in docs.collect()], docs, labels)
    rows = lines_stage(rows)
    kept = test_near_dedup.brute_force(rows, 5, 80)
    rows = substrings_stage([(i, t) for i, t in rows if kept[i][2]])
    lib, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = np.asarray([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[s : s + 4096] for s in range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
