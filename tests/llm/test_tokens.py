"""Cached ids against the tokenizer itself; files there and back; packing against its limits."""

import io
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from gantry.llm import packing, token_files, tokens
from tokenizers import Tokenizer

PIECES = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "22", ".", "'s", "'", "don't", "<|endoftext|>", " ", "　", "x y", "!!", "日本",
          "\x1c", "\x85", "\r\n", "   ", "<|", "😀", "x" * 60]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_cached_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(3)
    encoder = tokens.Encoder(tokens.vocabulary_path(), most_parts=40)  # forgets all the time
    for k in range(1500):
        pieces = PIECES if k % 2 else PIECES[:12]
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3)]
        ids, sizes = encoder.encode(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(tokenizer, t) for t in texts], texts
    assert encoder.encode([])[0].size == 0
    assert encoder.encode(["a b"], end=None)[0].tolist() == ids_of(tokenizer, "a b")[:-1]


def test_ids_that_no_part_needs_are_forgotten(tokenizer):
    # Long parts and texts with special tokens are not kept, so they are few parts with many ids.
    encoder = tokens.Encoder(tokens.vocabulary_path(), most_ids=2000)
    texts = ["a b", "日本" * 100, "a <|endoftext|> " + "b" * 300]
    for k in range(60):
        ids, sizes = encoder.encode([*texts, str(k)])
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(tokenizer, t) for t in [*texts, str(k)]]
        assert encoder.used <= 2000 + len(ids) and len(encoder.ids) <= 1 << 14
    assert "b" in encoder.spaced


def test_a_worker_encodes_on_one_core():
    code = """if True:
        import os
        from gantry.llm import tokens
        encoder = tokens.encoder(tokens.vocabulary_path())
        before = len(os.listdir("/proc/self/task"))
        encoder.encode([" ".join(f"w{i}x{k}" for i in range(9000)) for k in range(4)])
        print(len(os.listdir("/proc/self/task")) - before, encoder.most_parts)
    """
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    more, parts = map(int, said.stdout.split())
    assert more == 0 and parts <= 600_000, said.stderr


@pytest.mark.parametrize("segment", [7, 512, 513, 1 << 20])
def test_a_file_gives_back_every_id(monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    texts = [rng.choice([0, 5, 255, 256, 50256, 65535, 65536, 2**32 - 1], n).astype(np.uint32) for n in (1, 0, 600, 3, 1500)]
    ids = [3, None, 5, 5, -9]
    out = io.BytesIO()
    out.close = lambda: None
    writer = token_files.Writer(out)
    for d, t in zip(ids, texts):
        writer.add(d, t)
    writer.close()
    reader = token_files.Reader(pa.BufferReader(out.getvalue()))
    whole = np.concatenate(texts)
    assert reader.n_tokens == len(whole) and reader.n_docs == 5
    assert np.concatenate([reader.segment(k) for k in range(reader.n_segments)]).tolist() == whole.tolist()
    for i in {0, len(whole) - 1, *rng.integers(0, len(whole), 60).tolist()}:
        assert reader.token(i) == whole[i]
    with pytest.raises(IndexError):
        reader.token(len(whole))
    starts = np.cumsum([0] + [len(t) for t in texts])
    assert list(reader.documents()) == [(d, s, len(t), tokens.crc32(t)) for d, s, t in zip(ids, starts.tolist(), texts)]


def test_not_a_token_file():
    with pytest.raises(ValueError):
        token_files.Reader(pa.BufferReader(b"0" * 64))


ROWS = [(5, "five words are in here"), (1, None), (3, ""), (2, "don't stop\n\n  now"), (5, "again"), (5, "again"), (None, "nobody"), (9, "w " * 30_000), (-4, "é" * 5000)]


def test_files_have_all_documents_in_order(spark, docs, tokenizer):
    frame = docs(ROWS, ["1 AS start", "'x' AS part"]).repartition(3)
    found = token_files.round_trip(frame).collect()
    rows = sorted(found, key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    expected = sorted(str((d, len(ids_of(tokenizer, t)), tokens.crc32(np.array(ids_of(tokenizer, t), np.uint32)))) for d, t, *_ in ROWS)
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in rows) == expected
    assert token_files.round_trip(docs([])).count() == 0


def test_a_file_on_disk_is_addressed_by_token(spark, docs, tokenizer, tmp_path):
    files = token_files.write(docs(ROWS), f"file://{tmp_path}/out").orderBy("part").collect()
    place, path = token_files.store(files[-1]["file"])
    with place.open_input_file(path) as source:
        reader = token_files.Reader(source)
        assert reader.n_tokens == files[-1]["n_tokens"] and reader.doc_ids()[-1] == 9
        ids = ids_of(tokenizer, "w " * 30_000)
        assert [reader.token(int(reader.starts()[-2]) + i) for i in (0, 1, 777, len(ids) - 1)] == [ids[i] for i in (0, 1, 777, len(ids) - 1)]
    assert not list((tmp_path / "out").glob(".*dac*"))


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 3000)])
def test_every_capacity_holds(rule, capacity):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 55, 400)
    bins, offsets = packing.pack_lengths(lengths, capacity, rule=rule)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        assert lengths[own].sum() <= capacity[0] and len(own) <= capacity[1] and (lengths[own] ** 2).sum() <= capacity[2]
        order = own[np.argsort(offsets[own])]
        assert offsets[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()
    least = max(lengths.sum() / capacity[0], len(lengths) / capacity[1], (lengths**2).sum() / capacity[2])
    assert len(np.unique(bins)) <= 1.1 * least + 1  # a heuristic: near the bound that no packing can beat


def test_packing_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        packing.pack_lengths(np.array([5, 101]), (100, 100, 10**6))
    with pytest.raises(ValueError):
        packing.pack_lengths(np.array([5]), (100, 100, 10**6), rule="first")
    assert packing.pack_lengths(np.zeros(0, np.int64), (100, 100, 10**6))[0].size == 0


def test_cut_leaves_the_first_piece_shorter():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_sequences_have_each_piece_once(spark, docs, tokenizer):
    frame = docs(ROWS, ["1 AS length", "'x' AS sequence_id"])
    found = packing.pieces(frame, tokens=2048, with_ids=True)
    packed = packing.pack(found.cache(), 2048, group=4)
    rows = packed.collect()
    expected = []
    for d, t, *_ in ROWS:
        ids = np.array(ids_of(tokenizer, t), np.uint32)
        expected += [str((d, k, a, n, tokens.crc32(ids[a:a + n]))) for k, (a, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == sorted(expected)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert sum(len(r["ids"]) // 4 for r in whole.values()) == sum(r["length"] for r in rows)
    for r in rows:
        own = np.frombuffer(whole[r["sequence_id"]]["ids"], "<u4")
        assert len(own) <= 2048 and tokens.crc32(own[r["offset"]:r["offset"] + r["length"]]) == r["ids_crc32"]
    assert packing.best_fit(docs([])).count() == 0
