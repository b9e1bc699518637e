"""SentencePiece encoding and decoding with a distinct-chunk table.

The model's pieces never hold a character after which a white-space marker follows, so a segmentation cannot cross the
start of a marked word (a run of markers and the characters up to the next run). So texts are cut into marked words, the distinct ones are
segmented and decoded once by the library, and the texts' ids are joined back by position. There are two tables to choose from:

* ``corpus_table=False``: every task keeps a table of the words that it has met. Blocks of about ``BLOCK_BYTES`` of text are dictionary-encoded, and ids
  gathered by the places of the words in the block's list. No word moves; a word is segmented once per task. The table is emptied when it
  reaches ``TABLE_ENTRIES`` words or ``TABLE_CHARS`` characters.
* ``corpus_table=True``: one table for the corpus. The blocks' lists of distinct words, not the texts, are shuffled; every distinct word of all lists is
  segmented once; lists and segments meet by word, and a block's segments then meet its documents. It takes less time and more disk. A word of many blocks
  is a row per block, and such joins are split by Spark where they are skewed.

Memory is that of a block, or of one text if that is longer, and the table. A model with pieces that do cross a marker, or whose normaliser does more than
add a leading marker, is segmented by whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import spare, table, written

MARK = "▁"
BLOCK_BYTES = 2_000_000
TABLE_ENTRIES = 200_000
TABLE_CHARS = 16_000_000
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def separable(processor, model: bytes) -> bool:
    """Whether marked words can be segmented one by one under this model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(model)
    norm = spec.normalizer_spec
    plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap
    return bool(
        plain
        and spec.trainer_spec.model_type == pb.TrainerSpec.BPE
        and not spec.trainer_spec.treat_whitespace_as_suffix
        and not spec.denormalizer_spec.precompiled_charsmap
        and not any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces)
        and not any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))
    )


def chunks_of(text: str) -> list[str]:
    """The marked words of a text, each without the first marker that the library adds itself."""
    if not text:
        return []
    words = (text.replace(MARK, " ") if MARK in text else text).split(" ")
    if "" not in words:
        return words
    return [c[1:].replace(MARK, " ") for c in _CHUNKS.findall(MARK + MARK.join(words))]


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """The marked words of texts, as lists; those whose words a plain split gives come first. Also the order in which the texts stand."""
    plain = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring_regex(texts, f"^ |  | $|{MARK}|\n $")))
    plain = plain.to_numpy(zero_copy_only=False)
    first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
    lists = [pc.split_pattern(texts.take(pa.array(first)), " "), pa.array([chunks_of(t) for t in texts.take(pa.array(rest)).to_pylist()], pa.list_(pa.string()))]
    return np.concatenate([first, rest]), pa.concat_arrays([x.cast(pa.list_(pa.string())) for x in lists])


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_BYTES in all, one at least."""
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES, side="right")))
        yield at, n
        at += n


def blocked(docs: DataFrame, text: str, keep_text: bool, block: str, places: str, words: str) -> DataFrame:
    """Two kinds of rows: documents with their columns, their block and the places of their words in its list; and per block, with null columns, that list."""
    others = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in others], T.StructField(block, T.LongType()), T.StructField(places, T.ArrayType(T.IntegerType())), T.StructField(words, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            texts = pc.fill_null(whole.column(text).cast(pa.string()), "")
            for at, n in _blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                order, lists = _cut(texts.slice(at, n))
                coded = lists.flatten().dictionary_encode()
                own = pa.ListArray.from_arrays(lists.offsets, coded.indices.cast(pa.int32()))
                b = whole.slice(at, n).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], pa.array(np.full(n, number)), own, pa.nulls(n, pa.list_(pa.string()))], names=schema.names)
                listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, b.column(f.name).type) for f in others], pa.array([number]), pa.nulls(1, pa.list_(pa.int32())), listed], names=schema.names)
                number += 1

    return docs.mapInArrow(run, schema)


class Segmenter:
    """Segments and decodes distinct marked words; made in a task, from the model's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: A marker alone, as at the end of a text; the library has no ids for an empty text.
        self.alone = self.processor.encode("a ")[len(self.processor.encode("a")) :]
        self.table: dict[str, tuple[bytes, str]] = {}
        self.chars = 0

    def segment(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Per word its ids, as bytes of int32, and what they decode to."""
        ids = self.processor.encode(words, num_threads=1)
        said = self.processor.decode(ids, num_threads=1)
        return [(np.asarray(x if w else self.alone, np.int32).tobytes(), t) for w, x, t in zip(words, ids, said, strict=True)]

    def known(self, words: list[str]) -> list[tuple[bytes, str]]:
        """The same by the task's table."""
        new = [w for w in words if w not in self.table]
        if len(self.table) + len(new) > TABLE_ENTRIES or self.chars > TABLE_CHARS:
            self.table, self.chars, new = {}, 0, words
        self.table.update(zip(new, self.segment(new), strict=True))
        self.chars += sum(map(len, new))
        return [self.table[w] for w in words]


def segmented(words: DataFrame, model: bytes) -> DataFrame:
    """(word, ids, said) of a table's distinct marked words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Segmenter(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                own = whole.slice(at, 5000).column("word")
                ids, said = zip(*by.segment(own.to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.binary()), pa.array(said, pa.string())], names=["word", "ids", "said"])

    return words.mapInArrow(run, "word string, ids binary, said string")


def gathered(places: pa.ListArray, blobs: list[bytes], said: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """Ids and decoded text of documents from the places of their words in a list of segments."""
    w, ends = places.flatten().to_numpy(zero_copy_only=False), places.offsets.to_numpy() - places.offsets[0].as_py()
    flat, size = np.frombuffer(b"".join(blobs), np.int32), np.array([len(x) // 4 for x in blobs], np.int64)
    begin = np.cumsum(size) - size
    n = size[w] if len(w) else np.empty(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(begin[w] - upto[:-1], n) + np.arange(upto[-1])] if len(w) else flat[:0]
    texts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), said.take(pa.array(w)))
    return pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(ids, pa.int32())), pc.binary_join(texts, " ")


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded", keep_text: bool = True, corpus_table: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int, no begin or end ids) and ``decoded`` to every row; a null text is an empty one.

    The columns of that name that ``docs`` may have are replaced; all others stay, but for the text if it is not to be kept. Texts of any length are
    encoded whole. Repeated rows give repeated rows, an empty table an empty one.
    """
    import sentencepiece

    with open(model_path, "rb") as f:
        model = f.read()  # a fixed file of about 0.5 MB; shipped with the task
    keep = docs.drop(ids, decoded)
    if not separable(sentencepiece.SentencePieceProcessor(model_proto=model), model):
        return _by_whole_texts(keep, model, text, ids, decoded)
    if not corpus_table:
        return _by_task(keep, model, text, ids, decoded, keep_text)
    block, places, words = spare(keep, "block", "places", "words")
    cut = written(blocked(keep, text, keep_text, block, places, words))
    lists = cut.where(F.col(words).isNotNull()).select(F.col(block).alias("block"), F.posexplode(words).alias("at", "word"))
    table_ = written(segmented(lists.select("word").distinct(), model))
    segments = lists.join(table_, "word").select("block", "at", "ids", "said")
    own = cut.where(F.col(words).isNull()).drop(words)
    others = [f for f in own.schema.fields if f.name not in (block, places)]
    schema = T.StructType([*others, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(right.column("at").to_numpy()))
        blobs, said = right.column("ids").take(order).to_pylist(), pa.array(right.column("said").take(order).to_pylist(), pa.string())
        back = [gathered(x, blobs, said) for x in left.column(places).chunks]
        cols = [pa.chunked_array([x for x, _ in back], pa.list_(pa.int32())), pa.chunked_array([y for _, y in back], pa.string())]
        return pa.table([*[left.column(f.name) for f in others], *cols], names=schema.names)

    return own.groupBy(block).cogroup(segments.groupBy("block")).applyInArrow(put_back, schema)


def _by_task(keep: DataFrame, model: bytes, text: str, ids: str, decoded: str, keep_text: bool) -> DataFrame:
    others = [f for f in keep.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*others, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Segmenter(model)
        for whole in batches:
            texts = pc.fill_null(whole.column(text).cast(pa.string()), "")
            for at, n in _blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                order, lists = _cut(texts.slice(at, n))
                coded = lists.flatten().dictionary_encode()
                rows = by.known(coded.dictionary.to_pylist())
                own = pa.ListArray.from_arrays(lists.offsets, coded.indices.cast(pa.int32()))
                back = gathered(own, [x for x, _ in rows], pa.array([t for _, t in rows], pa.string()))
                b = whole.slice(at, n).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], *back], names=schema.names)

    return keep.mapInArrow(run, schema)


def _by_whole_texts(keep: DataFrame, model: bytes, text: str, ids: str, decoded: str) -> DataFrame:
    schema = T.StructType([*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for whole in batches:
            for at, n in _blocks(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False)):
                b = whole.slice(at, n)
                own = processor.encode([x or "" for x in b.column(text).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.int32())), pa.array(processor.decode(own, num_threads=1), pa.string())], names=schema.names)

    return keep.mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, default_model_path(), keep_text=False))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
