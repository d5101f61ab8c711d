import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import packing, token_archive, tokens
from corpuslens.llm.common import bounded_batches
from corpuslens.llm.files import reading

DOCS = "doc_id long, text string, start long, length string"
ODD = ["", None, "a", "  two  spaces", " lead", "trail ", "x\n y", "x \ny", "x \n z", "x\n\n z", "it's we'll  'tis", "Á b̈ ̈c", "<|endoftext|> x", "İ ΣΑΣ ΑΣ.", "\n", " ", "naïve,.!_ 12 1a ’s", "ée ﬁ", "tab\tx \t y", "word " * 5000, "x" * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    bounded_batches(spark)
    rows = [(i, t, i, "clash") for i, t in enumerate(ODD)] + [(None, "no id", 0, None), (3, "repeated row", 0, None), (3, "repeated row", 0, None), (2**62, "a", 1, ""), (-(2**63), "least id", 1, "")]
    return spark.createDataFrame(rows, DOCS)


def expected_ids(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_plain_call(name):
    rng = np.random.default_rng(11)
    parts = ["the", "Ünï", "e\u0301", "\u0345", "İ", "ﬁ", "漢字", "한글", "हिन्दी", "12", "3.5", "don't", "'ll", "’s", "<|endoftext|>", "<|ENDoftext|>", "<|startoftext|>", "<|end", "oftext|>", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u0085", "\x1c", "\x00", "\ufeff", "\u200d", "👩\u200d💻", "!?", "--", "_", "`", "{}", "é", "ß", "ǅ", "Σ", "ς"]
    texts = ["".join(parts[i] + (" " if rng.random() < 0.5 else "") for i in rng.integers(0, len(parts), rng.integers(1, 12))) for _ in range(20000)]
    ids, at = tokens.encoder(public_tokenizers.path(name)).encode(pa.array(texts))
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for i, e in enumerate(plain.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]


def test_packing_holds_every_id_once(docs):
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = []
    for r in docs.collect():
        ids = expected_ids("word_bpe_49k.json", r.text)
        want += [(r.doc_id, p, c, min(2048, len(ids) - c), zlib.crc32(ids[c : c + 2048].tobytes())) for p, c in enumerate(range(0, len(ids), 2048))]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted([tuple(r)[:5] for r in out], key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    counts = np.bincount([r.length for r in out], minlength=2049)
    assert len(by) == packing.lower_bound(counts, 2048)


def brute_bins(sizes, capacity):
    """The fewest bins, by trying all ways."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= sizes[i]}):
            new = list(rooms)
            new.remove(r)
            place(i + 1, [*new, r - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def held(made, capacity):
    assert all(sum(n * k for n, k in p) <= capacity and list(p) == sorted(p, reverse=True) for p, _ in made)
    out = np.zeros(capacity + 1, np.int64)
    for p, times in made:
        for n, k in p:
            out[n] += k * times
    return out.tolist()


def test_plan_needs_as_few_bins_as_an_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(120):
        sizes = rng.integers(rng.integers(1, 8), 21, rng.integers(1, 9)).tolist()
        counts = np.bincount(sizes, minlength=21)
        best = brute_bins(sizes, 20)
        assert packing.lower_bound(counts, 20) <= best
        for limits in ({}, {"branches": None, "width": None, "passed": None}):
            made = packing.plan(counts, 20, **limits)
            assert held(made, 20) == counts.tolist()
            assert sum(k for _, k in made) == best


def test_fillings_are_the_undominated_ones():
    """Against Martello and Toth's rule, by all partitions of the members of one filling over those of another."""
    import itertools

    def dominates(a, b):
        return any(all(sum(x for x, at in zip(b, way) if at == i) <= a[i] for i in range(len(a))) for way in itertools.product(range(len(a)), repeat=len(b)))

    rng = np.random.default_rng(2)
    for _ in range(60):
        items = rng.integers(1, 10, 6).tolist()
        room = int(rng.integers(3, 16))
        counts = np.bincount(items, minlength=21)
        sets = {tuple(sorted(c)) for k in range(7) for c in itertools.combinations(items, k) if sum(c) <= room}
        want = {s for s in sets if not any(t != s and dominates(t, s) for t in sets)}
        got = [tuple(sorted(n for n, k in f for _ in range(k))) for f in packing.fillings(counts, room)]
        assert len(got) == len(set(got)) and set(got) <= sets
        assert [sum(g) for g in got] == sorted((sum(g) for g in got), reverse=True)
        # one way of exchanges is enough to bring any filling to one of those that are listed
        assert want <= set(got)
        assert all(any(dominates(g, s) for g in got) for s in sets)


@pytest.mark.parametrize("sizes", [[1] * 5000, [2] * 5000, [2048] * 30, [1025] * 50 + [1] * 3, [683] * 100 + [682] * 100 + [1025] * 100 + [1023] * 50, [700] * 33 + [1] * 5000, []])
def test_plans_of_equal_and_short_lengths(sizes):
    counts = np.bincount(sizes, minlength=2049)
    made = packing.plan(counts, 2048)
    assert held(made, 2048) == counts.tolist()
    used = sum(k for _, k in made)
    assert packing.lower_bound(counts, 2048) <= used <= sum(k for _, k in packing.best_fit(counts, 2048))


def test_many_empty_texts(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "if(id % 2 = 0, '', null) text")
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert out.count() == 5000 and out.select("sequence_id").distinct().count() == 3


def test_a_hot_key_is_placed_without_overlap(spark):
    pieces = spark.range(6000).selectExpr("7 doc_id", "0 piece", "cast(100 as bigint) length", "'x' sequence_id", "1 _part")
    out = packing.pack(pieces.drop("_part", "sequence_id"))
    assert out.select("sequence_id", "offset").distinct().count() == 6000 and out.select("sequence_id").distinct().count() == 300


def test_packing_of_nothing(spark, docs):
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_archive_gives_every_document_back(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_archive.archive_documents(docs, path).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    got = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    key = lambda t: tuple((x is None, x) for x in t)
    want = [(r.doc_id, len(i := expected_ids("byte_bpe_50k.json", r.text)), zlib.crc32(i.tobytes())) for r in rows]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    assert token_archive.archive_documents(docs.limit(0), path).count() == 0


def test_reader_opens_only_the_frames_it_needs(tmp_path):
    with open(tmp_path / "a.zst", "wb") as f:
        w = token_archive.ArchiveWriter(f, frame_ids=100)
        for d in range(50):
            w.add(d, np.full(30, d, "<u4"))
        w.close()
    with reading(str(tmp_path), "a.zst") as f:
        r = token_archive.ArchiveReader(f)
        assert [(d, i.tolist()) for d, i in r.documents({7})] == [(7, [7] * 30)]
        assert r.read == 1 and len(r.table) > 10
    import zstandard

    raw = (tmp_path / "a.zst").read_bytes()
    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) == sum(t[1] for t in r.table)  # any reader can
    bad = bytearray(raw)
    bad[-9 - 12 * len(r.table) + 8] ^= 1  # a checksum in the table
    (tmp_path / "b.zst").write_bytes(bad)
    with reading(str(tmp_path), "b.zst") as f, pytest.raises(ValueError):
        list(token_archive.ArchiveReader(f).documents())
