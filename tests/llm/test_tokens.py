from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from fixtures import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from mapforge.llm import idfiles, packing, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CODECS = {(p, long): tokens.Codec(p, long, max(4, long // 4)) for p in (WORD, BYTE) for long in (2048, 12)}
LIBRARY = {p: tokens.load(p) for p in (WORD, BYTE)}


@pytest.mark.parametrize("path, long", CODECS)
@settings(max_examples=60, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abtheTHEé1 \n\t'.,-\u00a0\u2028ßΣ"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_the_librarys(path, long, text):
    ids, sizes = CODECS[path, long].encode([text, "", text + " x"])
    want = [LIBRARY[path].encode(t, add_special_tokens=False).ids for t in (text, "", text + " x")]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("long, leaf", [(8, 3), (30, 10), (100, 64)])
def test_tree_concatenation_is_exact(path, long, leaf):
    rnd = random.Random(long)
    codec = tokens.Codec(path, long, leaf)
    for parts in (["tion", "the", "ing", "an", "er", "é"], ["a", "b"], ["ab"], ["<|endoftext|>", "x"], ["'s", "''", "1"]):
        for _ in range(12):
            text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 400)))
            assert codec.encode([text])[0].tolist() == LIBRARY[path].encode(text, add_special_tokens=False).ids


def test_the_cache_can_start_afresh():
    codec = tokens.Codec(WORD, cache=3)
    for text in ("one two three four five", "six seven one", "one two"):
        assert codec.encode([text])[0].tolist() == LIBRARY[WORD].encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in tokens.round_trip(documents(spark), WORD).collect())
    lib = LIBRARY[WORD]
    want = collections.Counter()
    for i, t, *_ in rows():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    encoded = tokens.encode_column(documents(spark), WORD)
    assert {(r.doc_id, r.decoded) for r in tokens.decode_column(encoded, WORD).collect()} == {(i, d) for i, _, d in want}
    assert tokens.round_trip(empty(spark), WORD).count() == 0


def ids_of(text, path, end):
    return [*LIBRARY[path].encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("length, most", [(1024, 256), (64, 2), (16, 4)])
def test_packing_places_every_id_once(spark, length, most):
    got = packing.pack(documents(spark), BYTE, length=length, most=most).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) <= length
    want = collections.Counter()
    for i, t, *_ in rows():
        ids = ids_of(t, BYTE, 0)
        want[i] += len(ids)
    assert {i: sum(r.length for r in rs) for i, rs in pieces.items()} == want
    for i, t in ((5, rows()[5][1]), (60, next(r[1] for r in rows() if r[0] == 60)), (50, None)):
        assert sum((r.ids for r in sorted(pieces[i], key=lambda r: r.start)), []) == ids_of(t, BYTE, 0)
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    assert len(sequences) <= 1.35 * math.ceil(sum(want.values()) / length) + 1


def test_every_piece_has_its_documents_ids(spark):
    """Checksums, starts and sizes of all pieces, by the library's ids of every document."""
    want = collections.defaultdict(list)
    for i, t, *_ in rows():
        want[i].append(ids_of(t, BYTE, 0))
    got = packing.pack(documents(spark).repartition(5), BYTE, length=48, most=3, payload="ids_crc32").collect()
    covered = collections.Counter()
    for r in got:
        sums = {zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids in want[r.doc_id] if len(ids) == r.doc_tokens}
        assert r.ids_crc32 in sums and 0 < r.length <= 48 and r.start + r.length <= r.doc_tokens
        covered[r.doc_id] += r.length
    assert covered == {i: sum(map(len, each)) for i, each in want.items()}


def test_packing_merges_over_many_partitions(spark):
    docs = documents(spark).repartition(40)
    whole = packing.pack(docs, BYTE, payload="ids_crc32")
    n, tokens_ = whole.select("sequence_id").distinct().count(), whole.groupBy().sum("length").first()[0]
    assert tokens_ / 1024 / n > 0.85
    r = whole.filter("doc_id = 5").first()
    assert r.ids_crc32 == zlib.crc32(np.array(ids_of(rows()[5][1], BYTE, 0), "<u4").tobytes())
    assert packing.pack(empty(spark), BYTE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=80), min_size=1, max_size=8))
def test_id_files(docs):
    flat = np.array(sum(docs, []), np.uint32)
    file = idfiles.IdFile.from_bytes(idfiles.IdFile.of(flat, np.arange(len(docs)), np.array([len(d) for d in docs])).to_bytes())
    assert len(file) == len(flat) and file.run(0, len(flat)).tolist() == flat.tolist()
    assert file.get(np.arange(len(flat))[::-1]).tolist() == flat[::-1].tolist()
    assert all(file[i] == flat[i] for i in range(0, len(flat), 7))
    for start, n, d in zip(file.starts, file.sizes, docs):
        assert file.run(int(start), int(start + n)).tolist() == d


def test_a_cut_file_is_noticed():
    data = idfiles.IdFile.of(np.arange(9, dtype=np.uint32), np.array([1]), np.array([9])).to_bytes()
    with pytest.raises(ValueError):
        idfiles.IdFile.from_bytes(data[:-5])


def test_files_are_read_in_the_order_of_their_numbers(spark, monkeypatch):
    """More than ten thousand files of one part: file 10,000 comes after file 9,999."""
    read = []
    manifest = spark.createDataFrame([(0, n, f"ids-{0:06d}-{n:04d}.mfdac", 1, 2) for n in range(10_050)], "part long, n long, file string, docs long, ids long")
    monkeypatch.setattr(idfiles, "in_batches", lambda df, run, schema: read.append(df) or df)
    idfiles.read_ids(manifest, "nowhere")
    assert {r.file: r.base for r in read[0].collect()} == {f"ids-000000-{n:04d}.mfdac": 2 * n for n in range(10_050)}


def test_one_doc_id_goes_to_several_tasks(spark):
    df = spark.createDataFrame([(None, f"text number {i}") for i in range(400)] + [(None, "the same")] * 400, "doc_id long, text string")
    got = idfiles.with_crc32(idfiles.written_and_read(df, WORD)).collect()
    assert len(got) == 800 and len({r.start for r in got}) == 800


def test_written_and_read(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_IDS", 500)
    got = idfiles.with_crc32(idfiles.written_and_read(documents(spark), WORD)).collect()
    order = sorted(((i is not None, i if i is not None else 0, t or "", t is not None) for i, t, *_ in rows()))
    start = 0
    byplace = sorted(got, key=lambda r: r.start)
    assert len(byplace) == len(order)
    for r, (has, i, t, _) in zip(byplace, order):
        ids = ids_of(t, WORD, 1)
        assert r.doc_id == (i if has else None) and r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert idfiles.written_and_read(empty(spark), WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_texts_are_joined_from_halves(path):
    """Documents of the driver's tables go up the tree, and every id is the library's."""
    docs = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    plain, halved = tokens.Codec(path, 10**9), tokens.Codec(path)
    ids, sizes = halved.encode(docs)
    assert halved.joins >= len([d for d in docs if len(d) > tokens.LONG]) > 0 and not plain.joins
    want = [LIBRARY[path].encode(d, add_special_tokens=False).ids for d in docs]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    small = tokens.Codec(path, 7, 5)
    texts = ["x" * 90 + " tail of it", "ab cd<|endoftext|>ef gh", " \n" * 20 + "end", "one" + " " * 30, "don't can't I'll " * 5]
    got = small.encode(texts)[0].tolist()
    assert got == sum((LIBRARY[path].encode(d, add_special_tokens=False).ids for d in texts), [])
    assert small.joins and small.grown


def test_a_task_forgets_its_cuts():
    with tokens.borrowed(WORD) as own:
        own.encode(["one two three"])
        assert own.known
    assert not own.known
