import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece

from scoreloom.llm import media, mixing
from scoreloom.llm import sentencepiece_codec as codec
from tests import parity

ODD = ["", " ", "  a b", "a  b ", "\n\na\tb", "▁x", "a▁b", "a ▁ b", "é\u0000x", "<s>hi</s>", "x" * 5000, "naïve 東京 🙂", None, "same", "same"]
DOCS = "doc_id long, text string, size string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "clash", None if k % 4 == 0 else f"s{k % 3}") for k, t in enumerate(ODD)], DOCS)


def test_codec_is_the_library(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.default_model_path())
    for r in codec.encode_decode(odd, codec.default_model_path()).collect():
        want = sp.encode(r.text or "")
        assert list(r.piece_ids) == want and r.decoded == sp.decode(want) and r.size == "clash"


@pytest.mark.parametrize("corpus", [False, True])
@pytest.mark.parametrize("size", [1, 200, 8_000_000])
def test_codec_of_a_table_is_the_library(spark, sf, monkeypatch, size, corpus):
    monkeypatch.setattr(codec, "BLOCK_BYTES", size)
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.default_model_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40 if size == 1 else 1000)
    extra = spark.createDataFrame([(-1, "a " * 300_000), (-2, " lead"), (-3, "trail "), (-4, "two  blanks"), (-5, "line\n"), (-6, "line\n "), (-7, None), (-7, None), (-8, "x\ty\u00a0z ▁ ")], "doc_id long, text string")
    both = docs.union(extra)
    texts = sorted((r.doc_id, r.text or "") for r in both.collect())
    got = sorted(tuple(r) for r in codec.digests(codec.encode_decode(both, codec.default_model_path(), keep_text=False, corpus_table=corpus)).collect())
    want = []
    for i, t in texts:
        ids = sp.encode(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_codec_table_is_bounded(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.default_model_path())
    monkeypatch.setattr(codec, "TABLE_ENTRIES", 3)
    with open(codec.default_model_path(), "rb") as f:
        by = codec.Segmenter(f.read())
    for words in (["a", "b", "c"], ["c", "d"], ["e", "f", "g", "h"], ["h"]):
        assert [np.frombuffer(x, np.int32).tolist() for x, _ in by.known(words)] == [sp.encode(w) for w in words] and len(by.table) <= 4


def test_codec_by_whole_texts(spark, odd, monkeypatch):
    monkeypatch.setattr(codec, "separable", lambda *_: False)
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.default_model_path())
    for r in codec.encode_decode(odd, codec.default_model_path()).collect():
        assert list(r.piece_ids) == sp.encode(r.text or "") and r.decoded == sp.decode(sp.encode(r.text or ""))


def test_codec_and_mixing_of_nothing(spark, odd):
    none = odd.limit(0)
    assert codec.encode_decode(none, codec.default_model_path()).count() == 0
    assert mixing.mix(none).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(k, "w " * (1 + k % 7), "x", "big" if k % 3 else "small") for k in range(3000)] + [(k, "w w", "x", None) for k in range(3000, 3050)] + [(None, None, "x", "empty")]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs)
    got = out.groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    total = sum(r["max(source_size)"] for r in got)
    assert abs(sum(r["max(target)"] for r in got) - total) < 1e-6
    for r in got:
        assert r["max(target)"] <= 3 * r["max(source_size)"] + 1e-9 and abs(r["sum(taken)"] - r["max(target)"]) <= 8
    assert out.where("taken > 3 * size").isEmpty()
    assert {r.doc_id: r.taken for r in out.collect()} == {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}


def test_mixing_of_ties_and_clashing_columns(spark):
    rows = [(1, "w " * 9, "x", "é"), (1, "w " * 9, "x", "é"), (1, "w " * 9, "x", "é"), (2, "", "x", "z"), (3, "w" * 100_000, "x", "𝄞"), (4, "w " * 30_000, "x", "日")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _total", "2 as _h", "3 as _target", "4 as _source", "5 as times", "6 as below", "7 as source_size")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and all((r._total, r._h, r._target, r._source, r.times, r.below) == (1, 2, 3, 4, 5, 6) for r in got)
    assert len({(r.taken, r.target) for r in got if r.doc_id == 1}) == 1 and {r.source: r.source_size for r in got} == {"é": 27, "z": 0, "𝄞": 1, "日": 30_000}
    order = [r.source for r in mixing.targets(spark.createDataFrame([("é", 1), ("𝄞", 1), ("日", 1), (None, 1), ("a", 1)], "source string, source_size long")).collect() if r.weight == 5]
    assert set(order) == {"a", "𝄞"}


def test_mixing_sql(spark, sf):
    parity.same(mixing.op2_mixing(spark, sf), parity.connect(sf), mixing.mixing_sql())


def test_media_round_trip(spark, odd):
    kinds = set()
    more = spark.createDataFrame([(100 + k, f"text {k} " * k, "x", "y") for k in range(40)], DOCS)
    for r in media.read_back(media.inspect(media.stored(odd.union(more)))).collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(r.payload) == payload and r.n_bytes == len(raw) and r.payload_mean == np.frombuffer(payload, np.uint8).mean() and r.size in ("clash", "x")
        assert [e.kind for e in r.embedded] == (["audio/wav"] if r.detected == "application/zip" else [])
        kinds.add((r.detected, r.corrected))
    assert kinds == {(k, c) for k, _ in media.FORMS for c in (True, False)}
    assert media.read_back(media.inspect(media.stored(odd.limit(0)))).count() == 0


def test_media_are_those_of_other_libraries():
    import io
    import wave
    import zipfile

    payload = bytes(range(192)) * 3
    with wave.open(io.BytesIO(media.wav_of(payload))) as w:
        assert w.readframes(10**6) == payload and w.getsampwidth() == 1
    with zipfile.ZipFile(io.BytesIO(media.zip_of(b"abc"))) as z:
        assert z.testzip() is None and z.read("sound.wav") == b"abc"


def test_media_of_many_magic_numbers():
    import time

    found, began = media.automaton(), time.process_time()
    for value in (b"PK\x03\x04" * 20_000 + b"PK\x05\x06" * 20_000, b"%PDF-1.4\n" * 15_000 + b"startxref\n9\n%%EOF\n" * 15_000, b"RIFF" * 50_000, b"BM" * 50_000, b"%PDF-1.4 1 0 obj" * 9_000):
        media.sniff(found, value)
    assert time.process_time() - began < 25


def _png() -> bytes:
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def test_media_sniffs_corrects_and_carves(spark):
    png, gif, wav = _png(), b"GIF89a" + bytes(7) + b";", media.wav_of(b"RIFF" * 3)
    broken = png[:-1] + b"\0"
    values = {"png": png, "wav": wav, "mixed": b"junk BM RIFF" + png + b"xx" + gif, "broken": broken, "empty": b"", "none": None}
    df = spark.createDataFrame([(k, v, "image/png") for k, v in values.items()], "k string, content binary, declared string")
    got = {r.k: r for r in media.inspect(df).collect()}
    assert (got["png"].detected, got["png"].corrected) == ("image/png", False)
    assert (got["wav"].detected, got["wav"].corrected, got["wav"].embedded) == ("audio/wav", True, [])
    assert [(e.kind, e.offset, bytes(e.bytes)) for e in got["mixed"].embedded] == [("image/png", 12, png), ("image/gif", 14 + len(png), gif)]
    assert got["broken"].detected == media.UNKNOWN and got["empty"].detected == media.UNKNOWN and got["none"].detected is None


def _pdf(body: bytes = b"", sound: bool = True) -> bytes:
    head = b"%PDF-1.4\n1 0 obj\n" + body + b"\nendobj\n"
    return head + b"xref\n0 1\ntrailer <<>>\nstartxref\n" + (str(len(head)) if sound else "0").encode() + b"\n%%EOF"


def _ogg() -> bytes:
    return b"".join(b"OggS\0" + bytes([flags]) + bytes(8) + b"abcd" + bytes(8) + b"\1\4data" for flags in (2, 0, 4))


def test_media_within_media(spark):
    import io
    import zipfile

    png, ogg = _png(), _ogg()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.png", png)
        z.writestr("b.ogg", ogg)
    packed = held.getvalue()
    update = lambda p: p + b"\n2 0 obj\nendobj\n" + b"xref\nstartxref\n" + str(len(p) + 16).encode() + b"\n%%EOF"
    two = update(_pdf(png))
    values = {"zip": packed, "pdf": _pdf(png), "row": two + png + _pdf(), "loose": _pdf(sound=False) + png + _pdf(sound=False), "nest": _pdf(_pdf(png, False), False), "ogg": ogg, "wav": media.wav_of(packed)}
    got = {r.k: r for r in media.inspect(spark.createDataFrame([(k, v, "x") for k, v in values.items()], "k string, content binary, declared string")).collect()}
    said = lambda k: [(e.kind.split("/")[1], e.depth, len(e.bytes)) for e in got[k].embedded]
    assert got["zip"].detected == "application/zip" and said("zip") == [("png", 1, len(png)), ("ogg", 1, len(ogg))]
    assert got["pdf"].detected == "application/pdf" and said("pdf") == [("png", 1, len(png))]
    assert said("row") == [("pdf", 0, len(two)), ("png", 1, len(png)), ("png", 0, len(png)), ("pdf", 0, len(_pdf()))]
    assert said("loose") == [("pdf", 0, len(_pdf(sound=False))), ("png", 0, len(png)), ("pdf", 0, len(_pdf(sound=False)))]
    assert got["nest"].detected == "application/pdf" and said("nest") == [("pdf", 1, len(_pdf(png, False))), ("png", 2, len(png))]
    assert got["ogg"].detected == "audio/ogg" and said("ogg") == []
    assert said("wav") == [("zip", 1, len(packed)), ("png", 2, len(png)), ("ogg", 2, len(ogg))]


def test_media_read_back_is_looked_through(spark):
    text = _pdf(b"RIFF").decode()
    wav = media.wav_of(text.encode())
    (r,) = media.read_back(media.inspect(spark.createDataFrame([(wav, "x")], "content binary, declared string"))).collect()
    assert r.detected == "audio/wav" and [(e.kind, e.depth) for e in r.embedded] == [("application/pdf", 1)] and r.payload_detected == "application/pdf" and r.payload_embedded == []


def test_media_digests(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in media.op6_media(spark, sf).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:]) and r.payload_bytes == len(payload)
        form = media.FORMS[zlib.crc32(payload) % 4]
        assert r.media_sha256 == hashlib.sha256(form[1](payload)).hexdigest() and r.media_bytes == len(form[1](payload)) and r.feature.startswith(form[0] + ";") and r.feature.endswith(f"mean={np.frombuffer(payload, np.uint8).mean():.3f}")


def full_of_gifs(n):
    return b"GIF89a" + bytes(7) + b"".join(b"\x21\xff\x0bGIF89a\x01\x02\x03\x04\x05\x00" for _ in range(n)) + b";"


@pytest.mark.parametrize("value", [full_of_gifs, lambda n: b"%PDF-1.4\nx\n%%EOF\n" * n, lambda n: b"%PDF-1.4\nstartxref\n0\n%%EOF\n" * n, lambda n: b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF\n" * n, lambda n: b"%PDF-1.4\n" * n + b"startxref\n%%EOF\n" * n])
def test_media_time_grows_with_the_value(value):
    import time

    found = media.automaton()

    def seconds(n):
        best = 1e9
        for k in range(3):
            v = value(n) + bytes([k])  # nothing is known of it before
            began = time.perf_counter()
            media.looked(found, v)
            best = min(best, time.perf_counter() - began)
        return best

    seconds(100)
    assert seconds(40_000) < 2.5 * seconds(20_000) + 0.3
    assert seconds(20_000) < 1.5


def test_media_of_nested_gifs_and_pdfs():
    found = media.automaton()
    gif = full_of_gifs(3)
    assert media.sniff(found, gif) == [(0, len(gif), "image/gif", 0)]
    one, two = b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF", b"%PDF-1.7\nstartxref\n99\n%%EOF"
    assert [x[:3] for x in media.sniff(found, two + b"--" + two)] == [(0, len(two), "application/pdf"), (len(two) + 2, len(two), "application/pdf")]
    inner = b"%PDF-1.7\n" + two + b"\nstartxref\n77\n%%EOF"
    assert [x for x in media.sniff(found, inner)] == [(0, len(inner), "application/pdf", 0), (9, len(two), "application/pdf", 1)]
    assert media.sniff(found, one)[0][:2] == (0, len(one))
    deep = media.looked(found, b"%PDF-1.4\n" * 40 + b"startxref\n%%EOF\n" * 40)[1]
    assert [x["depth"] for x in deep] == list(range(40)) and [x["bytes"] is None for x in deep] == [d >= media.CARVED_DEPTH for d in range(40)]
