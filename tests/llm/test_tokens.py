"""Token operators against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quire.llm import byte_bpe, common, mph, packing, token_counts, token_shards, tokenizers_

WORD, BYTE, RANKS = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
V = byte_bpe.Vocabulary(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


texts = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t<|>'sSΣéÉ\x1c\x85　"), max_size=60)


@given(texts)
@settings(max_examples=400, deadline=None)
def test_counts_are_the_librarys(text):
    assert token_counts.counter(WORD).count(text) == len(_word().encode(text, add_special_tokens=False).ids)


@given(texts)
@settings(max_examples=400, deadline=None)
def test_chunk_ids_are_the_librarys(text):
    e = token_shards.encoder(WORD, True)
    assert np.frombuffer(e(text), e.kind).tolist() == _word().encode(text, add_special_tokens=False).ids


@given(texts)
@settings(max_examples=400, deadline=None)
def test_ranks_give_the_librarys_ids(text):
    if tokenizers_.unsettled().search(text):
        return
    enc = packing.encoder(RANKS, P.PATTERN, (("<|endoftext|>", 50256),))
    assert enc.encode_to_numpy(text, allowed_special="all").tolist() == _byte().encode(text, add_special_tokens=False).ids


@given(texts)
@settings(max_examples=300, deadline=None)
def test_split_is_the_librarys(text):
    """Pre-tokens encoded one by one are the text encoded."""
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokenizers_.ranks(RANKS), special_tokens={})
    for pattern in (tokenizers_.explicit(P.PATTERN), *([regex.compile(P.PATTERN)] if not tokenizers_.unsettled().search(text) else [])):
        found = pattern.findall(text)
        assert "".join(found) == text and [i for w in found for i in enc._core_bpe.encode_single_piece(w.encode())] == enc.encode_ordinary(text)


def _word(held=[]):  # noqa: B006
    held or held.append(Tokenizer.from_file(WORD))
    return held[0]


def _byte(held=[]):  # noqa: B006
    held or held.append(Tokenizer.from_file(BYTE))
    return held[0]


def test_vocabulary_is_rebuilt_by_its_merges():
    assert token_shards.rebuilt(WORD)


def test_token_counts(docs, rows, nothing, word):
    got = sorted(map(str, docs.transform(token_counts.counts, WORD, 2048).collect()))
    want = [(i, len((t or "").encode()), n := len(word.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows]
    assert got == sorted(f"Row(doc_id={a}, n_bytes={b}, n_tokens={c}, over_limit={d})" for a, b, c, d in want)
    assert token_counts.counts(nothing, WORD, 2048).count() == 0


@pytest.mark.parametrize("block", [1_000, byte_bpe.BLOCK_CHARS])
def test_byte_bpe_round_trip(spark, docs, rows, nothing, block, monkeypatch):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokenizers_.ranks(RANKS), special_tokens={})
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", block)
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in byte_bpe.encoded(spark, docs, V).collect()]
    want = [(i, enc.encode_ordinary(t or "")) for i, t, *_ in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    table = tokenizers_.byte_tokens(RANKS)
    assert sorted(byte_bpe.decoded(np.array(x, np.uint32), table) for _, x in got) == sorted((t or "").encode() for _, t, *_ in rows)
    assert byte_bpe.encoded(spark, nothing, V).count() == 0


def test_byte_bpe_query(spark, sf):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokenizers_.ranks(RANKS), special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in byte_bpe.query(spark, sf).collect()} == want


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        sizes, levels = mph.build(keys)
        assert sorted(mph.slots(keys, sizes, [x.__getitem__ for x in levels]).tolist()) == list(range(len(keys)))


def test_shards(spark, docs, rows, nothing, word):
    folder = common.fresh_dir(spark, "test")
    shards = token_shards.write(spark, docs, WORD, 2, folder)
    back = sorted((tuple(r) for r in token_shards.read_back(spark, docs, shards, folder).collect()), key=lambda r: r[1])
    ids = [(i, word.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows]
    assert [r[0] for r in back] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in back:
        assert r[1] == at
        at += r[2]
    digest = lambda i, x: (i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted(map(str, ((r[0], r[2], r[3]) for r in back))) == sorted(map(str, (digest(*x) for x in ids)))
    some = spark.createDataFrame([(4,), (7,), (10**9,)], "doc_id long")
    assert sorted(map(tuple, token_shards.read_back(spark, some, shards, folder).collect())) == sorted(r for r in back if r[0] in (4, 7))
    folder = common.fresh_dir(spark, "none")
    assert token_shards.read_back(spark, nothing, token_shards.write(spark, nothing, WORD, 2, folder), folder).count() == 0


def test_keyed_access(spark):
    """One key at a time reads records, not the index; strangers are told by fingerprint; a hot row is spread over shards."""
    docs = spark.createDataFrame([(7 * i - 4000, f"word {i} and more") for i in range(3000)] + [(5, "hot")] * 3000, "doc_id long, text string").repartition(5)
    folder = common.fresh_dir(spark, "keyed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = token_shards.write(spark, docs, WORD, 2, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(s[5] <= 5 <= s[6] for s in shards) > 1
    strangers = found = 0
    for number, n, _, _, _, lo, hi in shards:
        shard = token_shards.Shard(folder, number)
        for i in range(0, 3000, 97):
            row, times = shard.find(np.array([7 * i - 4000]))
            if times[0]:
                found += 1
                assert lo <= 7 * i - 4000 <= hi and next(shard.read(row))[2].tolist() == [*_word().encode(f"word {i} and more", add_special_tokens=False).ids, 2]
        assert all(x.whole is None for x in (*shard.levels, shard.held, shard.ends))
        strangers += int((shard.find(np.arange(10**6, 10**6 + 5000))[0] >= 0).sum())
    assert found == len(range(0, 3000, 97)) and strangers <= 1
    assert token_shards.read_back(spark, docs, shards, folder).count() == 6000


def test_files_are_put_once(tmp_path, monkeypatch):
    """A second attempt finds the file there and leaves no other; Hadoop's names of stores are understood."""
    from pyarrow import fs

    for attempt in (1, 2):
        monkeypatch.setattr(token_shards.TaskContext, "get", lambda a=attempt: type("T", (), {"taskAttemptId": lambda self: a})())
        token_shards._put(fs.LocalFileSystem(), f"{tmp_path}/x", [b"a", b"b"])
    assert [p.name for p in tmp_path.iterdir()] == ["x"] and (tmp_path / "x").read_bytes() == b"ab"
    assert token_shards._place("dbfs:/tmp/x")[1] == "/dbfs/tmp/x"


def _check_packing(packed, rows, byte, capacity):
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    pieces = []
    for i, t, *_ in rows:
        ids = byte.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        pieces += [(i, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed))) == sorted(map(str, pieces))
    return len(by), [p[3] for p in pieces]


def test_packing(spark, docs, rows, nothing, byte):
    packed = packing.pack(spark, docs).collect()
    n, lengths = _check_packing(packed, rows, byte, 1024)
    assert n <= packing.lower_bound(np.bincount(lengths, minlength=1025), 1024) + 1
    assert packing.pack(spark, nothing).count() == 0


def test_packing_in_rounds(spark, sf, byte):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    packed = packing.pack(spark, docs, packing.Setup(group=16)).collect()
    n, lengths = _check_packing(packed, rows, byte, 1024)
    assert n <= len(packing.best_fit(np.array(lengths), 1024)[2]) * 1.1 + 1


def test_certificate(spark, nothing):
    """Over a whole table: near the bound of all pieces, and never below it."""
    packed = common.keep(spark, packing.pack(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), packing.Setup(group=256)), "packed")
    got = packing.certificate(packed).first()
    lengths = [r["length"] for r in packed.select("length").collect()]
    assert got["sequences"] == len({r["sequence_id"] for r in packed.select("sequence_id").collect()}) and got["bound"] >= -(-sum(lengths) // 1024)
    assert 0 <= got["gap"] <= 0.02 * got["sequences"] + 1
    assert tuple(packing.certificate(packing.pack(spark, nothing)).first()) == (0, 0, 0)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_bounds_hold(sizes):
    """The bound never exceeds the fewest bins, found by trying all."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= 20:
                bins[b] += sizes[k]
                place(k + 1, bins)
                bins[b] -= sizes[k]
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= best[0]
    bins, where, held = packing.best_fit(np.array(sizes), 20)
    assert held.max() <= 20 and held.sum() == sum(sizes) and len(held) >= best[0]


def test_keys_that_are_no_integers_are_refused(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for refused in (lambda: byte_bpe.encoded(spark, docs, V), lambda: token_shards.write(spark, docs, WORD, 2, common.fresh_dir(spark, "no"))):
        with pytest.raises(ValueError):
            refused()


def test_tables_start_anew(word):
    """Texts of more chunks than a table holds, and tables that fill up under way, give the library's ids."""
    e = token_shards.ChunkEncoder(WORD, True)
    for most in (400, 3000, 20_000):
        e.chunks, e.words = common.Table(most), common.Table(most)
        for text in (" ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)):
            assert np.frombuffer(e(text), e.kind).tolist() == word.encode(text, add_special_tokens=False).ids
            assert 0 <= e.chunks.room <= most


def test_texts_together_look_each_chunk_up_once():
    """What a batch's texts share costs one look-up and one merging, whatever the table holds."""

    class Counted(common.Table):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    for most in (0, 1 << 20):
        e = token_shards.ChunkEncoder(WORD, True)
        e.chunks = Counted(most)
        ids, ends = e.encoded(pa.array([f"the same {i % 10} words, again" for i in range(1000)]))
        assert e.chunks.asked <= 14 and len(ends) == 1000 and ends[-1] == len(ids)


odd = st.lists(st.none() | texts | st.sampled_from(["", " ", "\n", "\x1c", " a\x1cb  c\u3000d ", "<|endoftext|>x <| y", "e\u0301 \u0301e", "it's 12 ΑΣ İ"]), max_size=12)


@given(odd, st.booleans(), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_texts_together_are_the_librarys(some, by_rank, skipped):
    """Nulls, empty texts, all white space, slices and vocabularies that only the library encodes."""
    e = token_shards.encoder(WORD, by_rank)
    ids, ends = e.encoded(pa.array(some, pa.string()).slice(skipped))
    got = [x.tolist() for x in np.split(ids, ends)]
    assert got == [*(_word().encode(t or "", add_special_tokens=False).ids for t in some[skipped:]), []]


def test_slices_by_bytes():
    """Rows go on in order, as many as fit; one of more bytes goes by itself."""
    texts = ["aa", None, "bbb", "", "c" * 50, "é", "d"]
    batches = [pa.record_batch([pa.array(range(7)), pa.array(texts)], ["k", "t"]).slice(a, n) for a, n in ((0, 7), (2, 5), (0, 0))]
    got = [b.column(1).to_pylist() for b in common.weighed(iter(batches), 1, 5)]
    assert got == [["aa", None, "bbb", ""], ["c" * 50], ["é", "d"], ["bbb", ""], ["c" * 50], ["é", "d"]]
