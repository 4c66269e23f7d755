"""Token counts and token files against the library's own encoding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarterglass.llm.chunks import Memo, Pieces, chunks_of, packed
from quarterglass.llm.token_counts import count_tokens
from quarterglass.llm.token_store import Reader, Writer, pack, read_tokens, unpack, width_of, write_tokens

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "a b", "  a b", "a  b", "a\n b", "a\nb c ", " ", "", "\n", "a\0b \0c", "\0", "x \n y", "it's I'll DON'T 12 3.4", "a\x85b\xa0c",
    "<|endoftext|> a <|endoftext|>b <|startoftext|>", "a\x1cb !\x1c c", "Ünïcode ÉCOLE straße", "é ́x", "日本 語", "İ ǅ", "½ ²3 Ⅷ", "ΑΣ ΣΑΣ,", "ªº µ",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_encode_as_the_whole_text(path):
    pieces = Pieces(path)
    known = Memo(lambda p: packed(pieces.ids(p)), 50)
    memo = Memo(lambda c: pieces.encode(c, known), 50)
    rng = np.random.default_rng(3)
    letters = [*"ab A'1.,<|>\n\té\xa0\x1c\x85́日", "<|endoftext|>", " ", "  "]
    for text in ODD + ["".join(rng.choice(letters, 30)) for _ in range(3000)]:
        assert "".join(chunks_of(text)) == text
        ids = np.frombuffer(b"".join([memo[c] for c in chunks_of(text)]), "<u4").tolist()
        assert ids == pieces.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing_is_a_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype("<u4")
    data = pack(ids, width)
    assert len(data) == -(-1001 * width // 8) and (unpack(data, 1001, width) == ids).all()
    assert width_of(2**width) == width and width_of(2**width + 1) == width + 1


def test_file_gives_any_run_of_ids(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype("<u4") for n in (3, 0, 700, 1, 256)]
    with open(tmp_path / "f", "wb") as out:
        writer = Writer(out, width_of(5000), block_ids=64)
        for k, ids in enumerate(docs):
            writer.add(None if k == 1 else k, ids)
        writer.close()
    reader, whole = Reader(str(tmp_path / "f")), np.concatenate(docs)
    assert (reader.ids(0, len(whole)) == whole).all() and (reader.ids(60, 131) == whole[60:131]).all() and not len(reader.ids(5, 5))
    starts = np.cumsum([0, *map(len, docs)])
    expected = [(None if k == 1 else k, int(starts[k]), len(d), zlib.crc32(d.tobytes())) for k, d in enumerate(docs)]
    assert list(reader.documents()) == expected


def test_counts_equal_the_library(odd, documents):
    library = Tokenizer.from_file(BYTES)
    for docs, head in ((odd, 5), (documents, 1000)):
        rows = sorted(((r.doc_id or -1, r.text or "") for r in docs.select("doc_id", "text").collect()))
        expected = sorted((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in rows)
        found = count_tokens(docs, BYTES, head_size=head).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected


def test_files_equal_the_library(odd, documents):
    library = Tokenizer.from_file(WORDS)
    for docs in (odd, documents):
        rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.select("doc_id", "text").collect()))
        start, expected = 0, []
        for i, t in rows:
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
            expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        found = read_tokens(write_tokens(docs, WORDS)).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in found) == sorted(expected)


def test_empty_tables(nothing):
    assert not count_tokens(nothing, BYTES).collect() and not read_tokens(write_tokens(nothing, WORDS)).collect()


def test_no_document_row_is_broadcast(spark, documents):
    found = read_tokens(write_tokens(documents, WORDS))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    built = plan.split("BroadcastExchange", 1)[1]
    assert "BuildRight" in plan and "MapInArrow" not in built and "Window" in built
