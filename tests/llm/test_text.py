"""Flat text arrays, tokenizers, token files and packing against plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe, packing, textkit as tk, tokenfiles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB é.\t\n'  #1ß İ́日,s"), max_size=40), st.text(max_size=30).filter(lambda s: "\ud800" not in s)), max_size=8)


def words(t):
    return WORD.findall((t or "").translate(LOW))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    data, offs = tk.flat(pa.array(texts, pa.string()))
    w, bounds = tk.words(data, offs)
    got = [x.decode() for x in w.to_pylist()]
    assert [got[a:b] for a, b in zip(bounds[:-1], bounds[1:])] == [words(t) for t in texts]
    sh, so = tk.shingles(tk.hashes(w), bounds, 3)
    plain = [[tuple(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [tuple(ws)] if ws else [] for ws in map(words, texts)]
    assert np.diff(so).tolist() == [len(p) for p in plain]
    code = {}
    for h, s in zip(sh.tolist(), [s for p in plain for s in p]):
        assert code.setdefault(s, h) == h
    assert len(set(code.values())) == len(code)
    s, o = tk.distinct_sets(sh, so)
    assert np.diff(o).tolist() == [len(set(p)) for p in plain]


@pytest.mark.parametrize(("name", "lower"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_encode_as_whole_texts(name, lower):
    enc = bpe.encoder(public_tokenizers.path(name), lower)

    @settings(max_examples=150, deadline=None)
    @given(TEXTS)
    def check(texts):
        got = []
        for lo, ids, counts in enc.encode(pa.array(texts, pa.string())):
            assert lo == len(got)
            ends = np.cumsum(counts)
            got += [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]
        assert got == [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]

    check()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700), max_size=6))
def test_token_files_round_trip(docs):
    ids = np.array([i for d in docs for i in d], "<u4")
    data = tokenfiles.to_bytes([None if i == 2 else i for i in range(len(docs))], ids, [len(d) for d in docs])
    got = [(n, ids[a - first[0] : b - first[0]].tolist()) for names, first, ids in tokenfiles.documents(data) for n, a, b in zip(names, first[:-1], first[1:])]
    assert got == [(None if i == 2 else i, d) for i, d in enumerate(docs)]


def test_frames_are_split_and_small():
    ids = np.random.default_rng(1).zipf(1.3, 3 * tokenfiles.BLOCK + 7) % 50_000
    frame = tokenfiles.encode_frame(ids.astype("<u4"))
    assert tokenfiles.decode_frame(frame).tolist() == ids.tolist() and len(frame) < 4 * len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.sampled_from([8, 16, 32]))
def test_every_id_is_in_one_piece(lengths, size):
    pieces = packing.assign(np.array(lengths, np.int64), size, 1.0, 1 / size)
    for d, n in enumerate(lengths):
        own = sorted((s, m) for e, s, m, _, _ in pieces if e == d)
        assert [s for s, _ in own] == [0, *np.cumsum([m for _, m in own])[:-1].tolist()] and sum(m for _, m in own) == n
    fill = {}
    for _, _, m, q, at in pieces:
        fill.setdefault(q, []).append((at, m))
    for parts in fill.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([m for _, m in parts])[:-1].tolist()] and sum(m for _, m in parts) <= size
    assert len(fill) <= -(-sum(lengths) // size) + 1


def test_costs_are_balanced():
    r = random.Random(3)
    lengths = np.array([r.randint(5, 900) for _ in range(3000)])
    cost = {}
    for _, _, m, q, _ in packing.assign(lengths, 2048, 1.0, 1 / 2048):
        cost[q] = cost.get(q, 0) + m + m * m / 2048
    assert max(cost.values()) < 1.5 * sorted(cost.values())[len(cost) // 2]


def test_pack_and_files_in_spark(spark, tmp_path):
    from eventloom.llm.packing import pack

    rows = [(3, "one two"), (1, None), (2, ""), (None, "x " * 5000), (3, "one two")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, length string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = bpe.encoder(path)
    want = {i: enc.tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got = pack(df, path).collect()
    assert sum(r.length for r in got) == sum(len(want[i]) for i, _ in rows)
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert pack(df.limit(0), path).count() == 0

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = bpe.encoder(path, lower=True)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t in order:
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tokenfiles.round_trip(df, path).orderBy("start").collect()]
    assert got == want
    assert tokenfiles.round_trip(df.limit(0), path).count() == 0
    here = f"file://{tmp_path}/files"
    m = tokenfiles.write(df, here, path)
    assert tokenfiles.read(spark, here, m, with_ids=True).orderBy("start").first().ids[-1] == 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    many = tokenfiles.write(df, f"{here}-small", path, file_ids=10)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert many.count() > m.count()
    assert [tuple(r) for r in tokenfiles.read(spark, f"{here}-small", many).orderBy("start").collect()] == want
