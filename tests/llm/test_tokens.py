from __future__ import annotations

import random

import pytest

from panewright.llm import tokens as t

PATH = t.tokenizer_path()
ALPHABET = "ab'sdlrevm 019 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　éß日本😀́<|endoftext|>!-_"
TEXTS = [None, "", " ", "\n\n  x", "<|endoftext|>", "it's we'll 12a", "日本語 😀", "\x1cA", "a" * 70_000, "ab " * 50_000]


def _plain(texts):  # noqa: ANN001, ANN202
    return [e.ids for e in t.load(PATH).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_memo_equals_the_library(monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4_000)]
    for memo, at_once in ((16_000_000, 2_000_000), (50, 100)):
        monkeypatch.setattr(t, "_MEMO_CHARS", memo)
        monkeypatch.setattr(t, "CHARS_AT_ONCE", at_once)
        flat, offsets = t.encode_batch(texts, PATH)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == _plain(texts)


def test_offsets_and_decoding() -> None:
    rng = random.Random(9)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(1_500)]
    for text, e in zip(texts, t.load(PATH).encode_batch(texts, add_special_tokens=False), strict=True):
        starts, ends = t.character_offsets(text, e.ids, PATH)
        assert list(zip(starts, ends, strict=True)) == list(e.offsets)
        assert t.decode(e.ids, PATH) == text
    split = t.load(PATH).encode("😀", add_special_tokens=False).ids
    assert len(split) > 1 and t.decode(split[:1], PATH) == "�"


def test_byte_table_is_complete() -> None:
    assert sorted(t.byte_of_char().values()) == list(range(256))
    assert {len(b) for b in t.token_bytes(PATH)[:256]} == {1}


def test_tables(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in t.encode(df).collect()}
    assert got == dict(enumerate(_plain(TEXTS)))
    spans = t.encode_with_offsets(df).where("doc_id = 5").first()
    assert spans["starts"][0] == 0 and spans["ends"][-1] == len(TEXTS[5])
    assert {r["doc_id"]: r["n_tokens"] for r in t.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    again = t.decoded(t.encode(df).drop("text"), text="text").orderBy("doc_id").collect()
    assert [r["text"] for r in again] == [x or "" for x in TEXTS]
    assert t.encode(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="already"):
        t.encode(df.withColumnRenamed("doc_id", "IDS"))


def test_other_tokenizers_get_texts_whole(spark) -> None:  # noqa: ANN001
    """One that normalises and splits otherwise: ids are the library's, offsets are refused."""
    path = t.tokenizer_path("word_bpe_49k.json")
    assert t.byte_level(t.tokenizer_path()) and not t.byte_level(path)
    texts = ["Hello  WORLD\n\tit's e\u0301 42", "", None, "naïve  café"]
    flat, offsets = t.encode_batch(texts, path)
    got = [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == [t.load(path).encode(x or "", add_special_tokens=False).ids for x in texts]
    with pytest.raises(ValueError, match="byte-level"):
        t.encode_with_offsets(spark.createDataFrame([("a",)], "text string"), path=path)
