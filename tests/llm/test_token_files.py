import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tf.Encoder(PATH)
TEXTS = ["", None, "Hello  world", "a <|endoftext|> b", "  \n\n x\t1234'll won't ÄÖ 漢字 \U0001f600", " " * 9, "it's", "x" * 5000, "a\x1cb\x85c\xa0d ²½ ª_ __x' 'S 'll\n", "é Ā×÷ŉ ĸ\t \r\n  end"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


PLAIN = st.text(st.characters(max_codepoint=0x17F))


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(), PLAIN, st.text("'sdlmtvre1_ \n\té.,", max_size=20)))
def test_words_encode_as_the_whole_text(text):
    assert [a.tolist() for a in ENCODER.encode_all(pa.array([text, None, text + " "]))] == [ids_of(text), [0], ids_of(text + " ")]


def test_special_tokens_and_neighbours():
    texts = ["x <|endoftext|>", "<|endoftext|>", "y 's", "<|endof", "text|> z", "<|endoftext|><|endoftext|> \u4e2d"]
    assert [a.tolist() for a in ENCODER.encode_all(pa.array(texts))] == [ids_of(t) for t in texts]


def test_long_texts_are_cut_where_words_end(monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_BYTES", 50)
    texts = ["ab  'll c\n\n  don't " * 40, "x" * 500, " " * 300 + "y" + " \t\n" * 100, "é漢  字 " * 90, "a <|endoftext|> b " * 30]
    assert [a.tolist() for a in ENCODER.encode_all(pa.array(texts))] == [ids_of(t) for t in texts]


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr(tf, "CACHE_BITS", 4)
    monkeypatch.setattr(tf, "CACHE_WORDS", 5)
    encoder = tf.Encoder(PATH)
    for text in ("a b c", "d e f g", " ".join(map(str, range(300))), "a b c d"):
        assert encoder.encode_all(pa.array([text]))[0].tolist() == ids_of(text)


def test_a_text_beyond_a_batch(spark, tmp_path):
    long = "".join(f"wörd {i} it's\n" for i in range(400_000))
    docs = spark.createDataFrame([(1, "a"), (2, long), (3, "b")], "doc_id long, text string")
    got = {r.doc_id: r for r in tf.encoded(docs, PATH).collect()}
    ids = np.array(ids_of(long), "<u4")
    assert (got[2].n_tokens, got[2].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and got[3].start == got[2].start + len(ids)


def test_reading_back_takes_many_tasks(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    manifest = tf.write_shards(docs, PATH, f"file://{tmp_path}", shard_ids=100)
    read = tf.read_shards(manifest)
    assert read.rdd.getNumPartitions() == -(-manifest.count() // tf.FILES_A_TASK) > 5


@given(st.lists(st.integers(0, 2**64 - 1)), st.integers(0, 5))
def test_elias_fano_round_trip(values, repeat):
    values = sorted(values + values[:1] * repeat)
    ef = tf.EliasFano(memoryview(tf.ef_encode(np.array(values, np.uint64))))
    assert ef.range(0, len(values)).tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_select_over_many_samples():
    values = np.cumsum(np.arange(5000) % 97).astype(np.uint64)
    data = tf.ef_encode(values)
    ef = tf.EliasFano(memoryview(data))
    assert ef.bytes == len(data) and len(data) < 5000 * 2
    for first, last in ((0, 1), (255, 257), (1000, 3333), (4999, 5000)):
        assert ef.range(first, last).tolist() == values[first:last].tolist()


def test_files_round_trip(spark, tmp_path):
    rows = [(i - 3, t, "x") for i, t in enumerate(TEXTS * 3)] + [(2, "tie", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = tf.write_shards(docs, PATH, f"file://{tmp_path}", shard_ids=40)
    assert manifest.count() > 2
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tf.read_shards(manifest).collect())
    start, expected = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(ids_of(t), "<u4")
        expected.append((start, d, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert tf.encoded(docs.where("false"), PATH).count() == 0


def test_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tf, "CACHE_WORDS", 10)
    encoder = tf.Encoder(PATH)
    for _ in range(3):
        assert [x.tolist() for x in encoder.encode_all(pa.array(TEXTS))] == [ids_of(t) for t in TEXTS]
        assert [x.tolist() for x in encoder.encode_all(pa.array(["a b c", "b"]))] == [ids_of("a b c"), ids_of("b")]
