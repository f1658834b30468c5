"""Tokenizer-based operators against the tokenizers library: packing, token files, token counts."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dimweave.llm import dac, tokens
from dimweave.llm.common import scratch_path
from dimweave.llm.packing import best_fit_decreasing, lower_bound, pack_documents, place_pieces
from dimweave.llm.token_counts import count_tokens
from dimweave.llm.token_files import read_token_files, write_token_files
from helpers import DOCS, frame, odd_rows, odd_texts, prose

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CODERS = {p: tokens.UnitEncoder(p) for p in (BYTES, WORDS)}
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def _ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_units_give_the_librarys_ids(path):
    texts = [t or "" for t in odd_texts()]
    got = [np.frombuffer(b, "<u4").tolist() for b in CODERS[path].encode(texts)]
    assert got == [_ids(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcAZ0 19.,!'\n\t\r\u00a0\u2003\u3000\x1c\x85éßΣİǅ́中😀<|>_-%") | st.characters(codec="utf-8"), max_size=40))
def test_units_give_the_librarys_ids_on_any_text(path, text):
    assert np.frombuffer(next(CODERS[path].encode([text])), "<u4").tolist() == _ids(path, text)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_every_letter_the_model_is_given_alone(path):
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    texts = ["İstanbul", "DİYARBAKIR'da İzmir, İ.", *(f"{c} a{c}b {c}n{c}, O{c}{c}" for c in letters)]
    assert [np.frombuffer(b, "<u4").tolist() for b in CODERS[path].encode(texts)] == [_ids(path, t) for t in texts]
    if path == WORDS:
        assert _ids(path, "İstanbul") == [328, 16384, 11231]


SPECIAL = ["<|endoftext|>", "<|startoftext|>"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_special_strings_are_split_off_first(path):
    texts = ["end.\n\n<|endoftext|>next", "a  <|endoftext|>  b", "<|endoftext|>\n\n<|endoftext|>", " <|endoftext|> \t", "x<|endoftext|><|startoftext|>y's", "<|endoftext", "<<|endoftext|>>\n\n|>"]
    texts += ["".join(t) for t in itertools.product(["a", "b,", " "], ["\n\n", "\u3000 ", "", " "], SPECIAL, ["", " ", "\n\n", "É"], ["c", "<|", " "])]
    assert [np.frombuffer(b, "<u4").tolist() for b in CODERS[path].encode(texts)] == [_ids(path, t) for t in texts]
    if path == BYTES:
        assert _ids(path, texts[0]) == [437, 13, 628, 50256, 19545]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*SPECIAL, "\n", " ", "\n\n", "\u00a0", "ab", "'s", "É", "<|", "|>", "7"]), max_size=12).map("".join))
def test_special_strings_in_any_text(path, text):
    assert np.frombuffer(next(CODERS[path].encode([text])), "<u4").tolist() == _ids(path, text)


def test_token_counts_of_special_strings(spark):
    texts = ["end.\n\n<|endoftext|>next", "a  <|endoftext|>  b", "plain\n\nwords"]
    for head in (0, 400_000):
        out = count_tokens(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), BYTES, keep=["doc_id"], head=head)
        assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(_ids(BYTES, t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("head", [0, 6, 400_000])
def test_a_long_pre_token_of_many_documents_needs_no_join(spark, head):
    url = " https://example.org/" + "path-" * 20 + "é"
    rows = [(i, f"{url} word{i}" + url * (i % 3), "en", "s", 1) for i in range(60)] + [(99, "x" * 100, "en", "s", 1)]
    out = count_tokens(frame(spark, rows).repartition(3), BYTES, keep=["doc_id"], head=head)
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {r[0]: len(_ids(BYTES, r[1])) for r in rows}


def test_a_pre_token_without_a_count_is_an_error(spark, monkeypatch):
    from dimweave.llm import token_counts

    whole = token_counts.vocabulary
    monkeypatch.setattr(token_counts, "vocabulary", lambda *a: whole(*a).where("pretoken <> ' lost'"))
    docs = frame(spark, [(1, "a lost word", "en", "s", 1)])
    with pytest.raises(Exception, match="without a piece count"):
        count_tokens(docs, BYTES, head=0).collect()


def test_long_texts_and_full_memory_change_no_id(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 200)
    monkeypatch.setattr(tokens, "MAX_UNITS", 50)
    coder = tokens.UnitEncoder(BYTES)
    texts = [prose(i, 300) for i in range(6)] + ["x" * 3000]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == [_ids(BYTES, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**63)), max_size=1500), st.data())
def test_dac_reads_any_value_and_range(values, data):
    codes = dac.DAC(dac.encode(np.array(values, dtype="u8")))
    assert len(codes) == len(values)
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert codes[i] == values[i]
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert codes.between(a, b).tolist() == values[a:b]


def test_token_files_round_trip(spark):
    path = scratch_path(spark, "test-files")
    rows = odd_rows() + odd_rows()[:3]
    write_token_files(frame(spark, rows).repartition(5), path, BYTES, end_id=2, chunk_tokens=100)
    got = sorted((r["start"], r["doc_id"], r["ids"]) for r in read_token_files(spark, path).collect())
    want, at = [], 0
    for key, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(_ids(BYTES, text) + [2], dtype="<u4")
        want.append((at, key, ids.tobytes()))
        at += len(ids)
    assert [g[1] for g in got] == [w[1] for w in want]
    assert [(g[0], bytes(g[2])) for g in got] == [(w[0], w[2]) for w in want]


def test_token_files_of_an_empty_table(spark):
    path = scratch_path(spark, "test-files")
    write_token_files(frame(spark, []), path, BYTES, end_id=2)
    assert read_token_files(spark, path).collect() == []


@pytest.mark.parametrize("head", [5, 400_000])
def test_token_counts_match_the_library(spark, head):
    rows = odd_rows() + odd_rows()[:5]
    docs = frame(spark, rows).withColumnRenamed("n_chars", "n_tokens")  # a name of the result
    out = count_tokens(docs.repartition(4), BYTES, keep=["doc_id", "lang", "n_tokens"], head=head)
    assert out.columns == ["doc_id", "lang", "n_bytes", "n_tokens"]
    key = lambda r: tuple(map(str, r))
    want = [(r[0], r[2], len((r[1] or "").encode()), len(_ids(BYTES, r[1]))) for r in rows]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert count_tokens(frame(spark, []), BYTES, keep=["doc_id"]).collect() == []


def test_bounds_and_best_fit():
    draw = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        for high in (20, 60, 100):
            lengths = draw.integers(1, high + 1, n)
            bins, offsets, room = best_fit_decreasing(lengths, 100)
            assert lower_bound(lengths, 100) <= len(room)
            for b in range(len(room)):
                own = sorted(zip(offsets[bins == b], lengths[bins == b]))
                assert [o for o, _ in own] == [0, *np.cumsum([w for _, w in own])[:-1]]  # gapless
                assert sum(w for _, w in own) == 100 - room[b]
    assert lower_bound(np.array([51] * 7), 100) == 7  # the volume alone says 4
    assert lower_bound(np.array([34] * 7), 100) == 4  # two fit a bin; the volume alone says 3
    assert lower_bound(np.array([], dtype=int), 100) == 0


def _check(placed, capacity):
    """placed: (sequence, offset, length); the number of sequences."""
    by = {}
    for s, o, n in placed:
        by.setdefault(s, []).append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_whole_texts(spark):
    rows = odd_rows() + odd_rows()[:4]
    packed = pack_documents(frame(spark, rows).repartition(3), WORDS, end_id=1, capacity=64, keep=["doc_id", "lang"], per_part=40)
    out = packed.sequences().collect()
    whole = {}
    for r in sorted(out, key=lambda r: (r["row"], r["piece"])):
        assert r["length"] * 4 == len(r["ids"]) and r["length"] <= 64
        data = whole.setdefault(r["row"], [r["doc_id"], b""])
        assert r["start"] * 4 == len(data[1])
        data[1] += bytes(r["ids"])
    want = sorted((str(r[0]), np.array(_ids(WORDS, r[1]) + [1], dtype="<u4").tobytes()) for r in rows)
    assert sorted((str(k), d) for k, d in whole.values()) == want
    bins = _check([(r["sequence_id"], r["offset"], r["length"]) for r in out], 64)
    assert bins <= -(-sum(r["length"] for r in out) // 64) + 1
    empty = pack_documents(frame(spark, []), WORDS, end_id=1, keep=["doc_id"])
    assert empty.sequences().collect() == []


def test_exchange_closes_the_gaps_of_partitions(spark):
    draw = np.random.default_rng(5)
    lengths = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(draw.integers(1, 60, 3000))], "row long, piece int, length long")
    places, certificates = place_pieces(lengths, 100, per_part=100)
    rows = places.join(lengths, ["row", "piece"]).collect()
    assert len(rows) == 3000
    bins = _check([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 100)
    first = certificates.collect()
    assert len(first) == 30 and all(r["bins"] >= r["bound"] for r in first)
    volume = -(-sum(r["length"] for r in rows) // 100)
    assert volume <= bins < sum(r["bins"] for r in first) and bins <= volume + 4
    assert DOCS
