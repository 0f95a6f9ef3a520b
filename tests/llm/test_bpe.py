import hashlib
from collections import Counter

import public_tokenizers as P
import tiktoken
from fixtures import documents, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import bpe
from lakeloom.llm.queries import RANKS, op1_byte_bpe


def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.tokenizer(RANKS, P.PATTERN).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_as_the_library(text):
    own = bpe.tokenizer(RANKS, P.PATTERN)
    ids = own.encode(text)
    assert ids == encoding().encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_very_long_pretokens():
    text = "ab" * 20_000 + " " * 10_000 + "é" * 10_000 + "a" * 30_000
    assert bpe.tokenizer(RANKS, P.PATTERN).encode(text) == encoding().encode_ordinary(text)


def test_text_of_many_megabytes():
    """Worked through in runs: the same ids, and digests, as of the whole."""
    own, line = bpe.tokenizer(RANKS, P.PATTERN), "Some prose, and näïve 日本語 numbers 1234!\n  "
    text = line * (12_000_000 // len(line))
    ids = own.encode(text)
    part = encoding().encode_ordinary(line * 3)
    assert ids[: len(part) - 1] == part[:-1] and len(list(own.tokens(text))) > 10
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert own.digests(["a b", "", text, "c"])[0] == [2, 0, len(ids), 1]
    assert [x[2] for x in own.digests(["a b", "", text, "c"])] == [len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode())]


def test_memory_is_bounded():
    made = []
    memory = bpe._Memory(lambda k: made.append(k) or k.upper())
    for k in range(3 * bpe.CACHE_ENTRIES):
        assert memory[str(k)] == str(k) and len(memory) <= bpe.CACHE_ENTRIES and len(memory.old) <= bpe.CACHE_ENTRIES
    assert memory["x" * 100] == "X" * 100 and "x" * 100 not in memory


def test_queue_order():
    queue = bpe.RankQueue(70_000)
    for entry in [(69_999, 1), (3, 9), (3, 2), (3, 5), (255, 0), (256, 0)]:
        queue.push(*entry)
    assert [queue.pop() for _ in range(7)] == [(3, 2), (3, 5), (3, 9), (255, 0), (256, 0), (69_999, 1), None]


def test_digests_and_round_trip(spark):
    docs = documents(spark)
    lib, sha = encoding(), lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, text, _ in plain(docs):
        ids = lib.encode_ordinary(text)
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode())] += 1
    assert Counter(map(tuple, bpe.digests(docs, RANKS, P.PATTERN).collect())) == want
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((i, t.encode()) for i, t, _ in plain(docs))


def test_query_and_empty(spark, sf_dir):
    assert op1_byte_bpe(spark, sf_dir).count() == 200
    assert bpe.digests(documents(spark).limit(0), RANKS, P.PATTERN).count() == 0
