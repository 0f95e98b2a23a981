"""The encoder against the public libraries, on whole texts and on random ones."""

import random

import pytest
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from plumbline.llm import pretokenize, tokenizer
from tests.conftest import MIDDLE

CODER = tokenizer.Encoder(tokenizer.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


def ids_of(texts):
    ids, sizes, _ = CODER.encode(texts)
    out, at = [], 0
    for n in sizes.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_documents_equal_library(library):
    texts = [t or "" for t in pq.read_table(f"{MIDDLE}/documents.parquet").column("text").to_pylist()]
    assert ids_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_library(library):
    rng = random.Random(7)
    parts = ["'", "'s", "'re", "'ll", "'v", "''", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\xa0", "　", "​", "a", "Zz", "é", "日本", "1", "²", "٣", "!", "?!", "🚨", "é", "<|endoftext|>", "\x85", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += ["'s" * 500, "''s" * 300, "a'" * 300, "'" * 999 + "s", "", " ", "\n\n", "x" * 20_000, "日本" * 5000, " " * 10_000, "'ll's"]
    assert ids_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_has_the_class_of_the_library(library):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000 and p % 3 == 0 or p < 0x3100]
    points = [p for p in points if not 0xD800 <= ord(p) < 0xE000]
    texts = [f"a{p}1{p}!{p} {p}" for p in points]
    ours, theirs = ids_of(texts), [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [hex(ord(p)) for p, a, b in zip(points, ours, theirs, strict=True) if a != b]
    assert len(wrong) <= 0.002 * len(points), wrong[:50]
    assert not [w for w in wrong if int(w, 16) < 0x3100 and int(w, 16) not in (0x1C89, 0x1C8A)], wrong[:50]


def test_long_pieces_merge_alike():
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeeti nrs") for _ in range(rng.randint(2, 120)))
        assert CODER._merge_long(piece) == CODER._merge_short(piece)


def test_scan_equals_loop():
    rng = random.Random(4)
    functions = [pretokenize._F_TEXT, pretokenize._F_SYMBOL, pretokenize._F_ONE, pretokenize._F_TWO, pretokenize._F_END]
    import numpy as np

    for _ in range(200):
        row = [rng.choice(functions) for _ in range(rng.randint(0, 70))]
        state, want = 0, []
        for f in row:
            state = f >> (2 * state) & 3
            want.append(state)
        assert pretokenize.scan_states(np.array(row, np.uint8)).tolist() == want


def test_ids_offsets_and_round_trip(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "It's  über\n\n日本 <|endoftext|>", "x"), (3, "It's  über\n\n日本 <|endoftext|>", "x"), (4, "y" * 300_000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    out = tokenizer.encode_texts(df, ["doc_id"], offsets=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["ids"] == [] == got[2]["ids"] and out.count() == 5
    assert got[3]["offsets"][0] == 0 and len(got[3]["offsets"]) == len(got[3]["ids"]) and sorted(got[3]["offsets"]) == got[3]["offsets"]
    back = {r["doc_id"]: r["text"] for r in tokenizer.decode_ids(out, ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t, _ in data}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenizer.encode_texts(df, ["doc_id"], count_only=True).collect()}
    assert counts == {k: len(r["ids"]) for k, r in got.items()}
    assert tokenizer.encode_texts(df.limit(0), ["doc_id"]).count() == 0
