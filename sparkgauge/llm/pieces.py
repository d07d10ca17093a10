"""SentencePiece encoding and decoding with a table of distinct chunks.

A byte-pair model merges within a text, but where none of its pieces holds a white-space marker behind another character, no merge can
cross from a word to the next marker. So a text falls into chunks, each a run of markers with what follows up to the next marker, that
can be segmented one by one (``separable`` reads the model for this; other models segment texts whole).

1. The distinct-chunk table: Arrow batches give their distinct chunks with counts, which are summed over all texts.
2. Each distinct chunk is segmented once, by the library. Chunks of at most ``CHUNK_CHARS`` characters go to all tasks, as many as
   ``TABLE_ROWS`` by count: the least count is taken from a histogram over powers of two. That bounds what is broadcast.
3. Texts are cut again, and a batch's distinct chunks are joined to the table; a batch segments those the table left out (rare or
   long ones) once each. The ids of all places are gathered by position.

No text leaves its task; only distinct chunks are shuffled. Ids equal the library's own, with the end id at the end.

Defined cases: null texts count as empty; an empty text has the end id alone; equal rows get equal ids; texts and words of any length are
encoded whole, in memory that follows a batch; an empty table gives an empty table; other columns pass in a struct ``d``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, table, whole, written

MARK = "▁"
TABLE_ROWS = 1 << 18
CHUNK_CHARS = 48
#: Bytes of texts that are encoded at once, and ids that are decoded at once.
SLICE, ID_SLICE = 1 << 22, 1 << 18
_chunks = re.compile(" +[^ ]*").findall


def _fields(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer: numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = number() if size is None else size
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


def separable(model: bytes) -> bool:
    """Whether texts may be cut before markers: a byte-pair model that changes no character, puts a marker first, and has no piece
    with a marker behind another character."""
    top = _fields(model)
    trainer, rules = _fields(b"".join(top.get(2, []))), _fields(b"".join(top.get(3, [])))
    plain = trainer.get(3, [1])[-1] == 2 and not rules.get(2, [b""])[-1] and rules.get(3, [1])[-1] == 1 and rules.get(4, [1])[-1] == 0 and rules.get(5, [1])[-1] == 1
    pieces = [_fields(p)[1][0].decode() for p in top.get(1, [])]
    return plain and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)


class Encoder:
    """A model on one worker, with the ids of the chunks it was given. ``cuts`` says whether texts may be cut."""

    def __init__(self, model: bytes, cuts: bool, known: bytes | None = None):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cuts = cuts
        self.mark = [self.library.piece_to_id(MARK)]
        rows = pa.ipc.open_stream(known).read_all() if known else pa.table({"chunk": pa.array([], pa.string()), "ids": pa.array([], IDS)})
        self.ids = pa.concat_arrays([*rows["ids"].chunks, pa.array([], IDS)])
        self.known = dict(zip(chain.from_iterable(map(_strings, rows["chunk"].chunks)), range(rows.num_rows), strict=True))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Rows in the order in which their chunks come, numbers of chunks, and the chunks, without the first marker of each."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return np.arange(len(texts)), np.ones(len(texts), dtype=np.int64), texts
        texts = pc.replace_substring(texts, MARK, " ")
        odd = pc.or_(pc.match_substring_regex(texts, "^ |  | $"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        even = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        lists = [[c[1:] for c in _chunks(" " + t)] if t else [] for t in _strings(texts.filter(pa.array(odd)))]
        sizes = np.concatenate([pc.list_value_length(even).to_numpy(zero_copy_only=False), np.array([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
        flat = pa.concat_arrays([even.flatten(), pa.array([c for x in lists for c in x], texts.type)])
        return np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), sizes, flat

    def segment(self, chunks: list[str]) -> pa.Array:
        """Ids of chunks that stand behind their first marker. An empty chunk is a marker alone, where texts are cut."""
        found = self.library.encode(chunks, num_threads=1) if chunks else []
        if self.cuts:
            found = [ids if c else self.mark for c, ids in zip(chunks, found, strict=True)]
        return _lists(chain.from_iterable(found), [len(ids) for ids in found])

    def encode(self, texts: pa.Array, end: bool = True) -> pa.Array:
        order, per_text, flat = self.cut(texts)
        places = flat.dictionary_encode()
        distinct = _strings(places.dictionary)
        # The batch's distinct chunks joined to the table; those that it lacks are segmented here and stand behind it, then the end id.
        row = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        lost = np.flatnonzero(row < 0)
        row[lost] = len(self.ids) + np.arange(len(lost))
        ids = pa.concat_arrays([self.ids, self.segment([distinct[i] for i in lost]), pa.array([[self.library.eos_id()]], IDS)])
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        # Ids by position, and the ends of the texts among them.
        rows, ends = row[places.indices.to_numpy(zero_copy_only=False)], np.cumsum(per_text)
        if end:
            rows, ends = np.insert(rows, ends, len(ids) - 1), ends + np.arange(1, len(ends) + 1)
        upto = np.concatenate([[0], np.cumsum(sizes[rows])])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto[ends]]), pa.int32()), ids.take(pa.array(rows)).flatten())
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return lists.take(pa.array(back))


IDS = pa.list_(pa.int32())


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _lists(values: Iterable[int], sizes: list[int]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(values, dtype=np.int32, count=int(ends[-1]))))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about ``SLICE`` bytes of texts, or ``ID_SLICE`` ids; a longer one is a run of its own."""
    values = batch.column(column)
    is_list = pa.types.is_list(values.type)
    sizes = pc.fill_null((pc.list_value_length if is_list else pc.binary_length)(values), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > (ID_SLICE if is_list else SLICE):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)


def _counted(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model, True)
    for batch in batches:
        for part in _slices(batch, "text"):
            found = pc.value_counts(encoder.cut(part.column("text"))[2])
            chunks, counts = found.field("values"), found.field("counts")
            fits = pc.less_equal(pc.utf8_length(chunks), CHUNK_CHARS)
            yield pa.RecordBatch.from_arrays([chunks.filter(fits), counts.filter(fits)], names=["chunk", "n"])


def _segmented(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model, True)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), encoder.segment(_strings(batch.column("chunk")))], names=["chunk", "ids"])


def distinct_chunks(texts: DataFrame, model: bytes, most: int = TABLE_ROWS) -> DataFrame:
    """(chunk, ids) of at most ``most`` distinct chunks of ``text``, the most frequent ones by powers of two of their counts;
    for models that may be cut."""
    counts = written(texts.select("text").mapInArrow(partial(_counted, model=model), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")))
    power = F.floor(F.log2("n")).cast("int")
    classes = {r.p: r.rows for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("rows")).collect()}
    least, rows = 64, 0
    while least > 0 and rows + classes.get(least - 1, 0) <= most:
        least -= 1
        rows += classes.get(least, 0)
    out = written(counts.where(power >= least).select("chunk").mapInArrow(partial(_segmented, model=model), "chunk string, ids array<int>"))
    released(counts)
    return out


def _encoded(batches: Iterable[pa.RecordBatch], model: bytes, known, end: bool, back: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model, known is not None, known.value if known else None)
    for batch in batches:
        for part in _slices(batch, "text"):
            out = pa.RecordBatch.from_arrays([part.column("d"), encoder.encode(part.column("text"), end)], names=["d", "ids"])
            for rows in _slices(out, "ids") if back else ():
                yield rows.append_column("text", _texts_of(encoder.library, rows.column("ids")))
            if not back:
                yield out


def _texts_of(library, lists: pa.Array) -> pa.Array:
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return pa.array(library.decode([flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)], num_threads=1), pa.string())


def encoded(docs: DataFrame, model: bytes, text: str = "text", end: bool = True, most: int = TABLE_ROWS, back: bool = False) -> DataFrame:
    """A struct ``d`` of the input's columns but ``text``, and ``ids``; with ``back`` also ``text``, which is decoded from the ids."""
    rest = docs.drop(text)
    texts = docs.select(whole(rest).alias("d") if rest.columns else F.struct(F.lit(None).cast("int").alias("none")).alias("d"), F.col(f"`{text}`").alias("text"))
    known = None
    if separable(model):
        rows = distinct_chunks(texts, model, most).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        known = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    fields = [texts.schema["d"], T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("text", T.StringType())] * back]
    return texts.mapInArrow(partial(_encoded, model=model, known=known, end=end, back=back), T.StructType(fields))


def _decoded(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for batch in batches:
        for part in _slices(batch, "ids"):
            names = [n for n in part.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], _texts_of(library, part.column("ids"))], names=[*names, "text"])


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """``rows`` with ``text`` in place of its ``ids``; null ids give an empty text."""
    rest = [f for f in rows.schema.fields if f.name != "ids"]
    return rows.mapInArrow(partial(_decoded, model=model), T.StructType([*rest, T.StructField("text", T.StringType())]))


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model, back=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("d.doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
