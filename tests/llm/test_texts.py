"""Hashing, token counts, packing and chat formatting against direct computations."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from finlake.llm import chat, hashing, packing, token_counts
from finlake.llm.base import load_tokenizer, vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ALPHABET = [" ", "\n", "a", "b", "É", "é", "  ", " \n", "1", "'s", "!", "<|endoftext|>", "日", "🙂", "Σ", "\x1c", " I'll",
            "\xa0", "\t", "<|endo", "é", "ẞ", "İ", "ß. ", "Abc.. ", "x!!)", "_", "ª", "²", "\u2003 ", "\x00"]
awkward = st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    words = WORD.findall(lower(text))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(awkward, max_size=5))
def test_shingles(texts):
    sets = hashing.shingle_sets(texts, 3)
    exact = [shingles(t, 3) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in exact]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(exact[i] & exact[j])


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = ["word " * 300 + "x" * 500 + " end", "", "short one", "y" * 400]
    whole = hashing.word_hashes(texts)
    monkeypatch.setattr(hashing, "CHUNK_BYTES", 64)
    parts = hashing.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, parts))


@settings(max_examples=150, deadline=None)
@given(awkward)
def test_counts_and_splices_equal_the_library(text):
    t = load_tokenizer(BYTES)
    want = len(t.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_batch([text], t, token_counts._Led(t))[0] == want
    for chunk, overlap in ((80, 70), (200, 90)):
        assert token_counts.splice_count(t, text * 5, chunk, overlap) == len(t.encode(text * 5, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ALPHABET, "^", " ^", "^ ", "2", "x"]), max_size=30).map("".join), max_size=4))
def test_counts_of_carets_equal_the_library(texts):
    t = load_tokenizer(BYTES)
    texts = ["x ^2", "^ ^", "a ^_^ ^", "^2 2", "2 ^2", " ^", "\n ^x", *texts]
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert token_counts.count_batch(texts, t, token_counts._Led(t)).tolist() == want


def test_overlap_is_widened():
    t = load_tokenizer(BYTES)
    for text in ("a" * 5000, "ab " + "-" * 3000 + " " * 2000 + "end", " " * 4000, "<|endoftext|>" * 300, "👩‍👩" * 900):
        assert token_counts.splice_count(t, text, 200, 70) == len(t.encode(text, add_special_tokens=False).ids)


def test_token_counts_query(spark):
    rows = [(1, "one two", "x", 9), (None, "abc", None, 0), (2, None, "y", 1), (2, "", "y", 1), (1, "one two", "x", 9),
            (3, "word é " * 20_000, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, limit int")
    got = token_counts.token_counts(docs, BYTES, limit=1024).collect()
    t = load_tokenizer(BYTES)
    want = sorted(((r[0] or -1, len((r[1] or "").encode()), len(t.encode(r[1] or "").ids)) for r in rows))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert [r.doc_id for r in got if r.over_limit] == [3]
    assert token_counts.token_counts(docs.limit(0), BYTES, 5).count() == 0


@settings(max_examples=150, deadline=None)
@given(awkward)
def test_ids_by_word_equal_the_library(text):
    t = load_tokenizer(WORDS)
    assert packing.text_ids(text, packing.WordIds(t)).tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_steps(monkeypatch):
    monkeypatch.setattr(packing, "STEP_CHARS", 50)
    t = load_tokenizer(WORDS)
    text = "Some words here. " * 30 + "x" * 200 + " and more\nof them"
    assert packing.text_ids(text, packing.WordIds(t)).tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_bins(totals):
    pieces = [p for n in totals for p in packing.cuts(n, 2048, 32)]
    for n in totals:
        cut = packing.cuts(n, 2048, 32)
        assert [s for s, _ in cut] == [0, *np.cumsum([x for _, x in cut])[:-1].tolist()] and sum(x for _, x in cut) == n
    lengths = np.array([n for _, n in pieces], dtype=np.int64)
    bins, offsets = packing.fill_bins(lengths, 2048)
    for b in np.unique(bins):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert (offsets[mine] == np.r_[0, np.cumsum(lengths[mine])[:-1]]).all() and lengths[mine].sum() <= 2048
    used = np.bincount(bins, weights=lengths).astype(int) if len(bins) else []
    assert sum(2048 - u for u in used if u & (u - 1)) <= 2048 + 31 * len(used)


def test_packing_query(spark):
    texts = ["", None, "a b c", "word " * 5000, "a b c"]
    rows = [(i if i else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    pieces = packing.tokenized_pieces(docs, WORDS, end_id=1)
    got = packing.harmonic_pack(pieces).collect()
    t = load_tokenizer(WORDS)
    for r in got:
        ids = t.encode(texts[r.doc_id or 0] or "", add_special_tokens=False).ids + [1]
        assert r.ids == ids[r.start:r.start + r.length] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert sum(r.length for r in got) == sum(len(t.encode(x or "").ids) + 1 for x in texts)
    assert packing.harmonic_pack(packing.tokenized_pieces(docs.limit(0), WORDS, 1)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["\\", "### ", "Assistant", ": ", "</turn>", "\n", "a", "é", "🙂", "<|endoftext|>"]), max_size=20).map("".join),
       st.sampled_from(["assistant", "user", "", "x: y", "### ", "\\"]))
def test_turns_round_trip(text, role):
    t = load_tokenizer(BYTES, True)
    first = t.get_vocab_size(with_added_tokens=True)
    assert chat.unescape(chat.escape(text)) == text
    ((ids, mask),) = chat.assemble([role], [text], t, first, ("assistant",))
    got = chat.read_back(ids, mask, t, first)
    assert got[:3] == (role, text, text if role == "assistant" else "")
    assert got[3].endswith("</turn>\n") and len(re.findall(r"(?<!\\)</turn>", got[3].replace("\\\\", ""))) == 1


def test_chat_query(spark):
    rng = random.Random(6)
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, 5, "assistant", "t"), (2, 5, "assistant", "t"),
            *[(3, i, rng.choice(["user", "assistant"]), f"{i} \\</turn>") for i in range(300)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    formatted = chat.format_turns(turns, BYTES)
    got = {r.conv_id: r for r in chat.digests(formatted, BYTES).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    turns_of = sorted((r.first_token, len(r.ids)) for r in formatted.where("conv_id = 3").collect())
    assert [a for a, _ in turns_of] == [0, *np.cumsum([n for _, n in turns_of])[:-1].tolist()]
    assert chat.digests(chat.format_turns(turns.limit(0), BYTES), BYTES).count() == 0


@pytest.mark.parametrize("name", ["op3_token_counts", "op10_harmonic_packing", "op8_chat_format"])
def test_queries_cover_the_tables(spark, con, name):
    from finlake.llm.queries import QUERIES
    from tests.oracle import SF_DIR

    key, table = ("conv_id", "conversations") if "chat" in name else ("doc_id", "documents")
    got = QUERIES[name](spark, SF_DIR).select(key).distinct().count()
    ((want,),) = con.sql(f"SELECT count(DISTINCT {key}) FROM {table}").fetchall()
    assert got == want + ("chat" in name)
