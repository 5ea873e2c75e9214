import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity as tx
from tidemark.llm import words

INSULTS = ["clown", "trash", "idiot"]


def sample(n=60, seed=1):
    draw = np.random.default_rng(seed)
    letters = np.random.default_rng(0)
    plain = ["".join(letters.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts, label = [], np.arange(n) % 2
    for y in label:
        t = list(draw.choice(plain, draw.integers(3, 150)))
        if y:
            t.insert(int(draw.integers(0, len(t))), str(draw.choice(INSULTS)))
        texts.append(" ".join(t))
    return texts, label.astype(np.float32)


def test_windows_cover_all_words_and_overlap():
    piece = np.repeat([0, 1, 2, 3], [1, tx.WINDOW, tx.WINDOW + 1, 500])
    start, length, of = tx.windows(piece)
    seen = np.zeros(len(piece), int)
    for s, n, p in zip(start, length, of):
        assert (piece[s : s + n] == p).all() and n <= tx.WINDOW
        seen[s : s + n] += 1
    assert seen.min() == 1 and (np.bincount(of) == [1, 1, 2, 21]).all()


def test_gradients_as_differences():
    texts, label = sample(6)
    s = tx.sample_windows(pa.array(texts), label)
    net = tx.Network({k: v.astype(np.float64) for k, v in tx.Network.new().w.items()})
    target = label[s.doc]

    def loss():
        z = net.run(s.inputs, s.start, s.length).astype(np.float64)
        return (np.logaddexp(0, z) - target * z).sum()

    logit, held = net.run(s.inputs, s.start, s.length, keep=True)
    g = net.gradients(s.inputs, held, 1 / (1 + np.exp(-logit)) - target)
    for name in net.w:
        at = (int(s.inputs[0, 0]), 1) if name == "e" else tuple(n // 3 for n in net.w[name].shape)
        old, step = net.w[name][at], 1e-2
        net.w[name][at] = old + step
        high = loss()
        net.w[name][at] = old - step
        low = loss()
        net.w[name][at] = old
        assert (high - low) / (2 * step) == pytest.approx(g[name][at], rel=0.02, abs=2e-3)


def test_long_text_in_parts_finds_its_window(monkeypatch):
    texts, label = sample(600)
    net = tx.train(tx.sample_windows(pa.array(texts), label), np.ones(len(texts)))
    fresh, y = sample(100, seed=2)
    assert ((tx.doc_logits(net, pa.array(fresh)) > 0) == y).mean() > 0.9
    alone = tx.doc_logits(net, pa.array(fresh[:1] + [None, ""]))
    assert alone[1] == alone[2]
    monkeypatch.setattr(tx, "SEGMENT", 300)
    long = fresh[0] + " " + "abcde fghab " * 5000 + "trash clown idiot " + "abcde " * 5000
    assert tx.doc_logits(net, pa.array([long]))[0] > 0


def test_held_out_accuracy_and_kept(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "toxic as label")
    rows = tx.scored(docs, labels).toPandas().set_index("doc_id")
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.index]
    known = labels.toPandas().set_index("doc_id").label
    held = rows.loc[known.index][rows.loc[known.index].held_out]
    hit = held.predicted == known[held.index]
    assert hit.mean() > 0.95
    assert hit[known[held.index] == 1].mean() > 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "w " * 300_000, 5), (3, "w", 5)], "doc_id long, text string, row int")
    labels = spark.createDataFrame([(1, None), (9, 1), (None, 0)], "doc_id long, label int")
    assert {r.score for r in tx.scored(docs, labels).collect()} == {0.5}
    assert tx.scored(docs.where("false"), labels).count() == 0
    assert tx.kept(docs, None).count() == 5
    net = tx.Network.new()
    net.w["k"][:] = -20
    out = tx.kept(docs, net)
    assert out.columns == docs.columns and sorted(r.row for r in out.collect()) == [5] * 5
    net.w["k"][:] = 20
    assert tx.kept(docs, net).count() == 0


def test_word_inputs_share_prefixes():
    [segment] = words.segments(pa.array(["Achlich achlau"]))
    inputs, _ = tx.word_inputs(segment)
    same = inputs[0] == inputs[1]
    assert same[2:5].all() and not same[0] and not same[5]  # the first 2 to 4 bytes, but not 5


def test_every_character_of_a_run_is_read():
    def grams(text):
        [segment] = words.segments(pa.array([text]))
        inputs, _ = tx.word_inputs(segment)
        return [int(x) for x in inputs[:, tx.TABLES + 1 :].ravel() if x != tx.NO_GRAM]

    term = grams("clown")[:3]  # clo, low, own
    assert any(grams("abcdefgclownhijklmnopq")[i : i + 3] == term for i in range(20))
    run = "".join(chr(0x4E00 + i) for i in range(2000))
    assert len(grams(run)) == 2000 and len(grams("a " + run + " b")) == 2002
    for at in (0, 14, 15, 16, 1000, 1999):  # also across the cuts of a run
        changed = run[:at] + "\u9fa0" + run[at + 1 :]
        assert [i for i, (a, b) in enumerate(zip(grams(run), grams(changed))) if a != b] == list(range(max(0, at - 2), at + 1))
    [segment] = words.segments(pa.array([run]))
    assert len(tx.word_inputs(segment)[0]) == -(-2000 // tx.LONGEST)
    [segment] = words.segments(pa.array([" \n "]))
    assert len(tx.word_inputs(segment)[0]) == 0


def test_all_windows_of_a_document_are_learned_from(monkeypatch):
    s = tx.sample_windows(pa.array(["w " * 4800, "v"]), np.array([1, 0], np.float32))
    seen = np.zeros(len(s.inputs), int)
    for a, n in zip(s.start, s.length):
        seen[a : a + n] += 1
    assert len(seen) == 4801 and seen.min() == 1 and s.doc.max() == 1
    monkeypatch.setattr(tx, "TRAIN_TEXT", {1: 5, 0: 3})
    kept = tx.within_bound(pa.array(["aaaa", "bb", "cccc", None, "d", "ee"]), np.array([1, 0, 1, 0, 1, 0]))
    assert kept.tolist() == [True, True, True, True, False, True]
