import public_tokenizers
import tiktoken

from rippletrace.llm import bpe

from .cases import TEXTS, documents, noise, none, odd

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def _ids(texts):
    ids, counts = bpe.Encoder(bpe.Vocabulary.of(RANKS), public_tokenizers.PATTERN).encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at:at + n].tolist())
        at += n
    return out


def test_replay_equals_a_library_on_odd_and_real_texts():
    texts = ([t or "" for t in TEXTS] + noise(1, 400, "ab cde \n\t'sl19éß\U0001f600\x1c\x85 ") + noise(2, 100, "tha ")
             + [t for _, t, _ in documents(60)])
    assert _ids(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_lower_ranked_merges_that_a_merge_makes_possible_come_first():
    base = {bytes([b]): b for b in range(256)}
    ranks = base | {b"ab": 300, b"abc": 260, b"bc": 400, b"abab": 299, b"aa": 310, b"aab": 305}
    own = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = noise(3, 500, "abc ")
    coder = bpe.Encoder(bpe.Vocabulary.of(ranks), r"\S+|\s+")
    ids, counts = coder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in own.encode_ordinary(t)]
    assert counts.tolist() == [len(own.encode_ordinary(t)) for t in texts]


def test_round_trip_with_nulls_clashes_and_no_rows(spark):
    df = odd(spark)
    coded = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(coded.columns) == sorted(df.columns)
    got = coded.select("text", "ids", "decoded", "score").collect()
    assert len(got) == df.count()
    for row in got:
        assert bytes(row.decoded) == (row.text or "").encode() and row.score == "mine"
        assert row.ids == OTHER.encode_ordinary(row.text or "")
    assert bpe.decode(bpe.encode(none(spark), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
