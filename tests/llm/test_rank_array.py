import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rippletrace.llm import rank_array

from .cases import TEXTS, documents, noise, none, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
OTHER = Tokenizer.from_file(PATH)
OWN = rank_array.Vocabulary.read(PATH)
MARK = "<|endoftext|>"
SPECIAL = [MARK, f" {MARK} ", f"a{MARK}b {MARK}  c", f"<|endoftext{MARK}|>", f"{MARK}{MARK}\n {MARK}", f"  {MARK}  x \0 y"]


def _other(text):
    ids = OTHER.encode(text or "", add_special_tokens=False).ids
    return ids, OTHER.decode(ids, skip_special_tokens=False)


def _own(texts):
    ids, counts = rank_array.Encoder(OWN).encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at:at + n].tolist())
        at += n
    return out


def test_ids_equal_a_library_on_odd_and_real_texts():
    texts = ([t or "" for t in TEXTS] + SPECIAL + noise(1, 500, "ab cde \n\t'sl19éß\U0001f600\x1c\x85 　")
             + noise(2, 200, "  tha\n") + [t or "" for _, t, _ in documents(80)])
    assert _own(texts) == [_other(t)[0] for t in texts]
    # each alone too, so that blocks have no part in it
    assert [_own([t])[0] for t in texts[:60]] == [_other(t)[0] for t in texts[:60]]


def test_words_are_parted_as_the_library_parts_them_at_every_character():
    coder = rank_array.Encoder(OWN)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 7), *range(0x323A0, 0x323C0), *range(0x10930, 0x10960)]):
        text = f"a{c}1{c} {c}?"
        assert coder._split(text) == [text[a:b] for _, (a, b) in coder._library.pre_tokenize_str(text)]


def test_scan_and_heap_agree():
    draw = random.Random(3)
    for _ in range(300):
        word = bytes(draw.choice(b"theinaros ") for _ in range(draw.randint(1, 200)))
        assert rank_array.merge_short(word, OWN.ranks) == rank_array.merge_long(word, OWN.ranks)


def test_words_merged_side_by_side_are_those_merged_alone():
    draw = random.Random(4)
    words = [bytes(draw.choice(b"theinaros \xc3\xa9") for _ in range(draw.randint(1, rank_array.SHORT))) for _ in range(400)]
    ids, counts = rank_array.merge_batch(words, rank_array.RankTable(OWN.ids, OWN.ranks))
    bounds = [rank_array.merge_short(w, OWN.ranks) for w in words]
    assert counts.tolist() == [len(b) - 1 for b in bounds]
    assert ids.tolist() == [OWN.ids[w[a:z]] for w, b in zip(words, bounds, strict=True) for a, z in zip(b, b[1:])]


def test_one_word_of_a_million_letters():
    text = "ha" * 500_000
    assert _own([text])[0] == _other(text)[0]


def test_round_trip_with_nulls_clashes_and_no_rows(spark):
    df = odd(spark)
    coded = rank_array.encode(df, OWN, packed_col="packed", decoded_col="again")
    got = rank_array.decode(coded, OWN).select("text", "ids", "packed", "decoded", "again", "score").collect()
    assert len(got) == df.count()
    for row in got:
        ids, text = _other(row.text)
        assert list(row.ids) == ids and row.decoded == row.again == text == (row.text or "") and row.score == "mine"
        assert bytes(row.packed) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert rank_array.encode(none(spark), OWN).count() == 0


def test_cut_characters_and_unknown_ids(spark):
    ids = OTHER.encode("\U0001f600é", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [10**6, 64, -1]), (4, [64, None])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in rank_array.decode(rows, OWN).collect()}
    assert got == {1: OTHER.decode(ids[:1], skip_special_tokens=False), 2: "", 3: "a", 4: "a"}


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="plain byte-level BPE"):
        rank_array.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
