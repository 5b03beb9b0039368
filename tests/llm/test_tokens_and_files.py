"""Token ids and their files against the unchanged library, on small tables with nulls, ties, repeats and long texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corrob.llm import queries, token_files, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "a", "bc", "é", "　", "\xa0", "'s", "1", "😀", "<|endoftext|>", "<|end", "|>", ".", "\x1c", "\x85", "​", "ﬀ", "٣", "\r", "'", "'ll", "(", "×", "÷", "ǅ", "Ünï"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text, *end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], "<u4")


def test_parts_have_the_ids_of_whole_texts(library):
    rng, encode = random.Random(2), tokens.encoder(FILE)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        assert "".join(tokens.parts(text)) == text
        assert encode(text) == ids_of(library, text).tobytes(), text


def test_kept_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PARTS", 5)
    ids = tokens.Ids(str.encode)
    for i in range(100):
        assert ids[f"{i % 7}"] == b"%d" % (i % 7) and len(ids) <= 5 and len(ids.before) <= 5
    assert ids["x" * 100] == b"x" * 100 and "x" * 100 not in ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(name):
    at = public_tokenizers.path(name)
    assert not tokens.cuts_plainly(at)
    text = "It's  Ünï 12, <|endoftext|>x"
    assert tokens.encoder(at)(text) == ids_of(Tokenizer.from_file(at), text).tobytes()


def table(spark, rows):
    """Columns of the operator's own names beside those it reads."""
    schema = "doc_id long, text string, at string, part string, ids string, n_tokens double, start string, file string, tie int"
    return spark.createDataFrame([(i, t, "a", "b", "c", 0.5, "d", "e", 1) for i, t in rows], schema)


def rows_by_hand(library, rows):
    """(doc_id, start, n_tokens, crc) in ascending order; equal ids in any order of their texts."""
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(library, t, 0)
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("row_ids", [7, 4096])
def test_files_hold_all_ids_in_order(spark, library, tmp_path, row_ids):
    rng = random.Random(row_ids)
    rows = [(i * 3 % 101, " ".join(rng.choice(PIECES) * 2 for _ in range(rng.randrange(60)))) for i in range(101)]
    rows += [(200, None), (-5, ""), (201, " \n "), (-9, "word " * 30_000), (202, "😀" * 5000), (203, "x" * 100_000)]
    path = f"{tmp_path}/ids"
    token_files.write(table(spark, rows).repartition(5), path, FILE, token_files.FileParams(row_ids=row_ids))
    got = [tuple(r) for r in token_files.digest(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == rows_by_hand(library, rows)
    known = token_files.files(spark, path).orderBy("start").collect()
    assert sum(r["docs"] for r in known) == len(rows) and all(a["most"] < b["least"] and a["start"] + a["ids"] == b["start"] for a, b in zip(known, known[1:]))
    found = {r["doc_id"]: r["ids"] for r in token_files.lookup(spark, path, [-9, 200, 7, 999]).collect()}
    assert set(found) == {-9, 200, 7} and all(found[i] == ids_of(library, dict(rows)[i], 0).tolist() for i in found)
    assert token_files.lookup(spark, path, [10_000]).count() == 0


def test_ties_nulls_and_repeats_are_separate_documents(spark, library, tmp_path):
    rows = [(None, "no id"), (None, None), (4, "twice"), (4, "twice"), (4, "other"), (1, "one")]
    path = f"{tmp_path}/ids"
    token_files.write(table(spark, rows), path, FILE)
    got = token_files.digest(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 4, 4, 4]
    assert sorted(r["ids_crc32"] for r in got) == sorted(x[3] for x in rows_by_hand(library, rows))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.lookup(spark, path, [4]).count() == 3


def test_files_of_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/ids"
    token_files.write(table(spark, [(1, "a")]).limit(0), path, FILE)
    assert token_files.digest(spark, path).count() == 0 and token_files.files(spark, path).count() == 0
    assert token_files.lookup(spark, path, [1]).count() == 0


def test_crcs_join():
    rng = random.Random(1)
    for _ in range(50):
        parts = [rng.randbytes(rng.randrange(0, 50)) for _ in range(rng.randrange(6))]
        assert token_files.joined_crc([(zlib.crc32(x), len(x)) for x in parts]) == zlib.crc32(b"".join(parts))


def test_stripes_indexes_and_bloom_filters_prune(spark, tmp_path):
    """A search reads few rows, and of many stripes only those whose index and Bloom filter allow it."""
    from pathlib import Path

    path, n = f"{tmp_path}/ids", 60_000
    docs = spark.range(n).selectExpr("2 * id as doc_id", "concat_ws(' ', sequence(0, id % 60)) as text").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write(docs, path, FILE, token_files.FileParams(stripe_bytes=64 << 10))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    jvm, files = spark._jvm, [str(f) for f in Path(path).glob("part-*.orc")]
    at = jvm.org.apache.hadoop.fs.Path(files[0])
    reader = jvm.org.apache.orc.OrcFile.createReader(at, jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    assert len(files) == 1 and reader.getStripes().size() > 3 and reader.getRowIndexStride() == 1000
    kinds = {s.getKind().toString() for s in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds

    def scanned(wanted):
        found = spark.read.orc(path).where(wanted)
        rows = found.count()
        plan = found.groupBy().count()
        plan.collect()
        leaves = plan._jdf.queryExecution().executedPlan()
        while not leaves.children().isEmpty() or leaves.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            leaves = leaves.executedPlan() if leaves.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else leaves.children().head()
            if leaves.getClass().getSimpleName().endswith("QueryStageExec"):
                leaves = leaves.plan()
        return rows, leaves.metrics().apply("numOutputRows").value()

    assert scanned("doc_id >= 0")[1] == n
    rows, read = scanned("doc_id = 60000")
    assert rows == 1 and read <= 2000  # a row group or two by the row index
    rows, read = scanned("doc_id = 60001")
    assert rows == 0 and read <= 1000  # an odd id lies in a row group's range, but not in its Bloom filter
    assert token_files.lookup(spark, path, [60_000]).count() == 1


def test_query_writes_and_reads_its_own_files(spark, library):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = [tuple(r) for r in queries.op11_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == rows_by_hand(library, rows)
