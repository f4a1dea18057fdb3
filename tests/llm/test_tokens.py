"""Token counts, token files and packing against plain encoding of whole texts."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowset.llm import packing, token_counts, token_files
from sparrowset.llm.tokenizing import Encoder, default_tokenizer

TEXTS = [None, "", " ", "\n\n", "a", "Don't  stop\n\n  now. ", "same words " * 700, "x" * 9000, "naïve café été \x1f! 日本語のテキスト", "<|endoftext|> as text", "one <|endoftext|> two<|endoftext|>", "in<|endoftext|>side \n<|endoftext|>", "same words " * 700, "tab\tand\r\nline end ퟿"]
SCHEMA = "doc_id long, text string, length string, rank string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def enc():
    return Encoder(default_tokenizer(), near_pieces=20, far_pieces=60)


def docs(spark):
    rows = [(k, t, "clash", None) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, "\n\n", None, None), (3, "another text of 3", None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("\0 \n\tabcé.'s1\x1f  日<|>"))), max_size=6))
def test_memo_encodes_like_the_library(plain, enc, texts):
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.ids([*texts, None])]
        assert got == [plain(t)[:-1] for t in [*texts, None]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", " ", "\n", "word", "é", "<", "|>"]), max_size=7).map("".join), max_size=5))
def test_added_tokens_follow_the_library(plain, enc, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == [plain(t)[:-1] for t in texts]


def test_added_tokens_as_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    texts = ["one <|endoftext|> two", "<|endoftext|>"]
    got = Encoder(default_tokenizer(), added_as_text=True).ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_another_kind_of_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), Encoder(path)
    assert not enc.cuttable
    texts = ["Upper  and lower", "two\nlines <|endoftext|> and more", "", "it's"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files_round_trip(spark, plain, tmp_path):
    df, rows = docs(spark)
    manifest = token_files.write_tokens(df, str(tmp_path / "t"), partitions=3)
    got = [r for p in manifest["parts"] for r in token_files.documents_of(str(tmp_path / "t"), p, manifest["bits"])]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert Counter((d, tuple(i.tolist())) for d, _, i in got) == Counter((d, tuple(plain(t))) for d, t, *_ in rows)
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids)
    index = sorted(token_files.read_index(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in index] == [(d, s, len(i), zlib.crc32(i.astype("<u4").tobytes())) for d, s, i in got]


def test_token_files_of_no_rows(spark, tmp_path):
    df, _ = docs(spark)
    assert token_files.write_tokens(df.limit(0), str(tmp_path / "e"))["tokens"] == 0
    assert token_files.read_index(spark, str(tmp_path / "e")).count() == 0


def test_length_table(spark, plain):
    df, rows = docs(spark)
    lengths = [len(plain(t)) for _, t, *_ in rows]
    table = token_counts.length_table(token_counts.encoded_lengths(df))
    got = {r["length"]: r for r in table.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["n_tokens"] == n * lengths.count(n)
        assert r["docs_from"] == sum(x >= n for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["rank_from"] == sum(x < n for x in lengths)
        assert r["truncated"] == sum(min(x, n) for x in lengths)
    for limit in (0, 1, 5, 1000, 10**6):
        assert token_counts.truncated_total(table, limit).first()[0] == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(table, q).first()[0] == sorted(lengths)[int(np.ceil(q * len(lengths))) - 1]
    empty = token_counts.length_table(token_counts.encoded_lengths(df.limit(0)))
    assert empty.count() == 0 and token_counts.truncated_total(empty, 9).first()[0] == 0


def least_sequences(lengths, capacity):
    """A lower bound: pieces over capacity - k need a sequence each, where none of k or more fits beside; those from k
    to capacity - k fill what is left of the sequences of pieces over half, and more."""
    n = np.bincount(np.array([x for d in lengths for _, x in packing.cut_pieces(d, capacity)], int), minlength=capacity + 1)
    best, size = 0, np.arange(capacity + 1)
    for k in range(capacity // 2 + 1):
        large, mid, small = size > capacity - k, (size > capacity // 2) & (size <= capacity - k), (size <= capacity // 2) & (size >= k)
        free = n[mid].sum() * capacity - (n * size)[mid].sum()
        best = max(best, int(n[large].sum() + n[mid].sum() + max(0, -(-((n * size)[small].sum() - free) // capacity))))
    return best


def check_packing(rows, documents, capacity):
    """Every id of every document once, sequences gapless from 0 and not over capacity."""
    want = Counter()
    for d, ids in documents:
        for j, (s, n) in enumerate(packing.cut_pieces(len(ids), capacity)):
            want[d, j, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(x <= capacity for x in ends.values())
    return len(ends)


def test_packing(spark, plain):
    df, rows = docs(spark)
    documents = [(d, plain(t)) for d, t, *_ in rows]
    used = check_packing(packing.pack(df, shard_pieces=2).collect(), documents, 1024)
    assert used == -(-sum(len(i) for _, i in documents) // 1024)
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_of_a_table(spark, plain):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents = [(r["doc_id"], plain(r["text"])) for r in table.collect()]
    used = check_packing(packing.pack(table).collect(), documents, 1024)
    assert used <= 1.005 * least_sequences([len(i) for _, i in documents], 1024) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=300))
def test_runs_hold_each_piece_once(lengths):
    hist = np.bincount(np.array(lengths, int), minlength=33)
    runs = packing.plan_runs(hist, 32)
    total = int((hist * np.arange(33)).sum())
    assert runs.sequences <= np.ceil(total / 32 * 1.25) + 1
    for n in range(33):
        own = runs.length == n
        firsts = runs.first[own]
        assert (firsts[:1] == 0).all() and (np.diff(firsts) > 0).all()
        assert (hist[n] > firsts.max(initial=-1)) == bool(hist[n]) if hist[n] else not len(firsts)


def test_many_pieces_fill_sequences():
    hist = np.bincount(np.random.default_rng(0).integers(1, 1025, 100_000), minlength=1025)
    runs = packing.plan_runs(hist)
    assert runs.sequences <= 1.002 * least_sequences(np.repeat(np.arange(1025), hist), 1024)
