"""Encoding against the model's own library, decoding, and packing round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import packing, pieces
from tidegauge.llm.batches import ready
from tidegauge.llm.queries.packing import vocabulary
from tidegauge.llm.queries.pieces import model_path

TEXTS = [None, "", " ", "   ", "a", "The cat sat.\nOn  the mat!", "日本語 and ελληνικά", "😀😀 x", "▁▁ ▁", "tab\there", "a" * 5000, " lead", "trail ", "<s> <0x0A> </s>",
         "é" * 300, " ".join(["word"] * 4000), "\x00\x01", "1234567890 3.14", "same", "same"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def codec():
    with open(model_path(), "rb") as f:
        return pieces.codec_of(f.read())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en", "s", 1, "clash") for i, t in enumerate(TEXTS)]
    return ready(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, piece_ids string").repartition(3)


def test_ids_and_texts_equal_the_library(codec, library):
    random.seed(5)
    parts = ["a", " ", "  ", "the", "\n", "é", "1", "日本", "😀", "ing", "tion", "▁", ".", "((", "Ω"] + random.sample(sorted(codec.ids), 300)
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(0, 30))) for _ in range(3000)] + [t or "" for t in TEXTS]
    flat, bounds = codec.encode(texts)
    decoded = codec.decode(flat, bounds)
    for i, text in enumerate(texts):
        ids = flat[bounds[i]:bounds[i + 1]].tolist()
        assert ids == library.encode(text), repr(text)
        assert decoded[i].decode() == library.decode(ids), repr(text)


def test_forgetting_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    for text in ("some plain words here", "other plain words there"):
        flat, bounds = codec.encode([text, text])
        assert flat[:bounds[1]].tolist() == flat[bounds[1]:].tolist() == library.encode(text)


def test_digests_of_all_rows(docs, library):
    got = {(r.doc_id, r.ids_sha256): r for r in pieces.digests(docs, model_path()).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "")
        row = got[None if i == 3 else i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert len(got) == len(TEXTS)


def test_encode_then_decode_keeps_columns(docs):
    out = pieces.decode(pieces.encode(docs, model_path()), model_path())
    assert set(out.columns) == set(docs.columns) | {"decoded"}
    rows = out.where("text is null or not contains(text, '▁')").collect()
    assert len(rows) == len(TEXTS) - 1
    assert all(r.decoded == (r.text or "") for r in rows)
    assert pieces.encode(docs.limit(0), model_path()).count() == 0


def test_fits_like_a_plain_search():
    random.seed(1)
    for _ in range(200):
        row = random.randrange(1, 40)
        lengths = sorted((random.randrange(1, row + 1) for _ in range(random.randrange(80))), reverse=True)
        used: dict[int, int] = {}
        left: list[int] = []
        for n, at in zip(lengths, packing.fitted(lengths, row)):
            room = row - used.get(at, 0)
            assert room == min((x for x in left if x >= n), default=row)
            if at in used:
                left.remove(room)
            left.append(room - n)
            used[at] = used.get(at, 0) + n
            assert used[at] <= row


def test_packed_rows_hold_every_document(docs):
    with open(vocabulary()[0], "rb") as f:
        encode = packing.encoder_of(f.read(), vocabulary()[1]).encode_ordinary
    packed = packing.packed(docs, *vocabulary(), row=64, fill=7, group=2000).cache()
    rows = packed.collect()
    for r in rows:
        lens = [b - a for a, b in zip(r.cu_lens[:-1], r.cu_lens[1:])]
        assert r.cu_lens[0] == 0 and r.cu_lens[-1] == r.n_ids <= 64 and len(r.ids) == 128
        assert r.positions == [k for n in lens for k in range(n)]
        assert len(lens) == len(r.doc_ids) == len(r.parts)
        assert r.ids[2 * r.n_ids:] == b"\x07\x00" * (64 - r.n_ids)
    back: dict = {}
    for r in packing.unpacked(packed).collect():
        back.setdefault(r.doc_id, []).append((r.part, r.ids))
    for i, text in enumerate(TEXTS):
        ids = [x for _, part in sorted(back.get(None if i == 3 else i, [])) for x in part]
        assert ids == encode(text or "")
    assert packing.packed(docs.limit(0), *vocabulary()).count() == 0
    again = packing.packed(docs.repartition(5), *vocabulary(), row=64, fill=7, group=2000)
    key = ["pack_group", "pack_row", F.hex("ids").alias("ids"), "cu_lens", "doc_ids", "parts"]
    assert sorted(map(str, again.select(*key).collect())) == sorted(map(str, packed.select(*key).collect()))


def test_written_rows_are_read_again(docs, tmp_path, spark):
    packing.write(docs, *vocabulary(), str(tmp_path / "rows"), row=128)
    assert spark.read.parquet(str(tmp_path / "rows")).agg(F.sum("n_ids")).first()[0] == packing.pieces(docs, *vocabulary()).agg(F.sum(F.size("ids"))).first()[0]


def test_no_id_or_text_makes_a_group_large(spark):
    """A third of the rows without an id, a third with one id, and a third equal throughout are spread over all groups."""
    rows = [(None, f"text number {i} of many") for i in range(400)] + [(7, f"words of row {i}") for i in range(400)] + [(8, "the same words again")] * 400
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.packed(docs, *vocabulary(), row=64, group=400)
    sums = [r["sum(n_ids)"] for r in packed.groupBy("pack_group").sum("n_ids").collect()]
    assert len(sums) >= 8 and max(sums) < 3 * 400
    assert packing.unpacked(packed).groupBy("doc_id").count().orderBy("doc_id").collect() == [(None, 400), (7, 400), (8, 400)]
