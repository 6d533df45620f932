"""op9: exact round trip; the pipeline, stage by stage."""

import io
import os
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodeworks.llm import common
from lodeworks.llm import token_store as ts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary(spark):
    return ts.vocabulary_path(spark)


@pytest.fixture(scope="module")
def whole(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def expected(rows, whole):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole(t or ""), 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


ROWS = [(5, "Hello  world"), (-3, "a b c\n\nd  e \n f"), (1, None), (2, ""), (7, "<|endoftext|> is text, it's"), (8, "tab\there \u00a0nbsp ünï 漢字 😀"), (9, " lead"), (10, "trail "), (2**62, "big"), (None, "no id"), (11, "word " * 40_000), (12, "\r\n x\ty ")]


def test_round_trip(spark, vocabulary, whole):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, tie string, start int")
    manifest, path = ts.write_tokens(df, vocabulary, shard_bytes=1000)
    got = sorted((tuple(r) for r in ts.read_tokens(manifest, path).collect()), key=lambda r: r[1])
    assert got == expected(ROWS, whole)
    for i, t in ROWS:
        (ids,) = ts.lookup(manifest, path, i)
        assert list(ids) == [*whole(t or ""), 0]
    assert ts.lookup(manifest, path, 12345) == []
    assert ts.token_output(df.limit(0), vocabulary).count() == 0


def test_repeated_ids_stay(spark, vocabulary, whole):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (0, "c")], "doc_id long, text string")
    got = ts.token_output(df, vocabulary).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 1, 1] and max(r["start"] + r["n_tokens"] for r in got) == sum(len(whole(t)) + 1 for t in "abac")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab .,'\n\t\u00a0é1#s<|>"), max_size=30), min_size=1, max_size=4))
def test_encoder_equals_the_library(vocabulary, whole, texts):
    got = [list(np.frombuffer(x, "<u2")) for x in ts.Encoder(vocabulary, most=3).encode(texts)]
    assert got == [whole(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bé", "a,\n", "c\u00a0", "'s", "1", "<|endoftext|>", "\u0120x", ""]), max_size=12).map(" ".join), max_size=9), st.integers(1, 40), st.integers(0, 4))
def test_encoder_equals_the_library_part_by_part(vocabulary, texts, part, most):
    """Texts in several parts, with words that are remembered and let go."""
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(vocabulary), ts.Encoder(vocabulary, most=most, special=True)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ts, "PART_BYTES", part)
        for _ in range(2):
            assert [list(np.frombuffer(x, "<u2")) for x in own.encode(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.words) == len(own.ids) <= most


def test_few_calls_of_the_library(vocabulary):
    """Words of a part are encoded together: 5,000 texts with 20,000 words in some 80 calls for first words and 5 for the others."""
    enc, calls = ts.Encoder(vocabulary, special=True), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return self.model.encode_batch_fast(texts, **options)

    enc.model = Counted(enc.model)
    assert sum(1 for _ in enc.encode([" ".join(f"x{4 * i + k}" for k in range(5)) for i in range(5000)])) == 5000
    assert len(calls) <= 90


_HELD = """
import sys, pyarrow as pa
from lodeworks.llm import common, token_store as ts
held = lambda: next(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) >> 10
enc = ts.Encoder(sys.argv[1], special=True)
run = lambda rows: (b for t in rows for b in [sum(map(len, enc.encode(t)))])
start = held()
texts = [[" ".join(f"w{i * 5000 + k}x{k}" for k in range(5000)) for i in range(j, j + 10)] for j in range(0, 100, 10)]
given = held() - start
done = sum(common.lean(run)(texts)) if hasattr(common, "lean") else sum(run(texts))
print(done, held() - start - given)
"""


def test_a_waiting_worker_holds_little(vocabulary):
    """After 500,000 different words, MB besides the texts: two workers for each executor share its memory with the JVM."""
    root = str(Path(ts.__file__).parents[2])
    done, held = subprocess.run([sys.executable, "-c", _HELD, vocabulary], cwd=root, check=True, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": root, "TOKENIZERS_PARALLELISM": "false"}).stdout.split()
    assert int(done) > 0 and int(held) < 40


@pytest.mark.parametrize("module", ["quality", "near_dedup", "token_store"])
def test_arrow_steps_of_the_pipeline_give_memory_back(module):
    steps = re.findall(r"mapInArrow\((\w+)", (Path(ts.__file__).parent / f"{module}.py").read_text())
    assert steps and set(steps) == {"lean"}


def test_lean_trims_once_also_when_cut_short(monkeypatch):
    done = []
    monkeypatch.setattr(common, "trim", lambda: done.append(1))
    assert list(common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and done == [1]
    cut = common.lean(lambda batches: batches)(iter([1, 2]))
    next(cut)
    cut.close()
    assert done == [1, 1]


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_file():
    out = io.BytesIO()
    w = ts.ShardWriter(out, width=4, block_bytes=64)
    docs = [(i * 3 - 50, np.arange(i % 7, dtype="<u4")) for i in range(100)] + [(400, np.array([1], "<u4"))] * 30
    for i, ids in docs:
        w.add(ts.key_of(i), ids.tobytes())
    w.close()
    r = ts.ShardReader(Bytes(out.getvalue()))
    assert (r.documents, r.tokens) == (130, sum(len(x) for _, x in docs)) and len(r.blocks) > 10
    assert [(ts.id_of(k), v) for k, v in r] == [(i, x.tobytes()) for i, x in docs]
    assert [list(x) for x in r.get(400)] == [[1]] * 30 and list(r.get(-47)[0]) == [0] and r.get(-48) == []
    wrong = sum(r.may_have(ts.key_of(i)) for i in range(10_000, 12_000))
    assert wrong < 60
    broken = bytearray(out.getvalue())
    broken[10] ^= 1
    with pytest.raises((ValueError, pa.ArrowException)):
        list(ts.ShardReader(Bytes(bytes(broken))))


def test_keys_sort_as_numbers():
    ids = [None, -(2**63), -1, 0, 1, 255, 256, 2**63 - 1]
    keys = [ts.key_of(i) for i in ids]
    assert keys == sorted(keys) and [ts.id_of(k) for k in keys] == ids


def test_pipeline_stages(spark, whole):
    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs
    results = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.materialize(stage(spark, before, SF), "test-stage")
        results[name] = out
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert out.join(before, "doc_id", "left_anti").count() == 0
            out = common.materialize(out.select("*"), "test-copy")
        before = out
        docs_left = out.count()
        assert docs_left > 0
    from test_dedup import brute_classes
    from test_native import brute_contamination

    kept = [(r["doc_id"], r["text"]) for r in results["quality"].collect()]
    reps = {min(kept[i][0] for i in c) for c in brute_classes(kept)}
    assert {r["doc_id"] for r in results["near_duplicates"].collect()} == reps
    left = [(r["doc_id"], r["text"], "") for r in results["near_duplicates"].collect()]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in brute_contamination(left, items) if not r[5]}
    assert {r["doc_id"] for r in results["decontamination"].collect()} == clean
    mixed = [(r["doc_id"], r["text"]) for r in results["mixing"].collect()]
    got = results["token_ids"].groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_tokens").alias("t")).collect()
    assert sum(r["n"] for r in got) == len(mixed)
    texts = dict(mixed)
    assert all(r["t"] == len(whole(texts[r["doc_id"]] or "")) + 1 for r in got)


def test_pipeline_takes_odd_rows(spark, vocabulary, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, columns with the operators' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, k1 string, class_id long, hash long, tid long, start long"
    some = [r["text"] for r in common.table(spark, SF, "documents").limit(30).collect()]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(some)]
    rows += [(100, None, None, None), (None, some[0], None, "s1"), (None, None, None, None), (101, "", "en", "s0"), (102, " ".join(f"{t} {i}" for i in range(200) for t in some[:3]), "en", "s2"), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1, "k", "a", 2, 3, 4, 5) for r in rows], schema)
    for docs in (df, df.limit(0)):
        before = docs
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = common.materialize(stage(spark, before, SF), "test-odd")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                assert out.select("doc_id", "text").subtract(before.select("doc_id", "text")).count() == 0
            before = out
        assert (before.count() > 0) == (docs is df)


def test_pipeline_runs_as_a_query(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() > 0
    common.release(spark)
    assert common.written() == []


def test_two_pipelines_in_one_process(spark):
    """Neither deletes what the other one still reads."""
    a, b = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert a.count() == b.count() > 0


def test_queries_read_special_tokens_as_the_library_does(spark, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    from lodeworks.llm.queries import QUERIES

    model = Tokenizer.from_file(vocabulary)
    default = lambda text: model.encode(text, add_special_tokens=False).ids
    rows = [(1, "a <|endoftext|> b"), (2, "plain words here"), (3, "<|endoftext|>"), (4, "x<|endoftext|><|endoftext|> y <|endoftext"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (QUERIES["op9_token_store"](spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["token_ids"](spark, docs, str(tmp_path))):
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == expected(rows, default)
