"""BPE encoding and decoding with a distinct-word table.

Texts are split at white space in Spark tasks. Each piece of the input (a few
MB of documents) asks once for each of its distinct words; the requests meet in
a table dealt by word hash, where each distinct word is encoded once, by the
tokenizer library itself. The ids go back to the piece, in the order in which
it asked, and are joined to the documents by word position.

Ids become text by a join with the id-to-piece table, by position: ids of a batch
are laid end to end, each is looked up in the table, and the pieces are put
together again where documents begin and end. The table has as many entries as
the vocabulary, whatever the input, so each task holds it whole; decode() does
this for any column of ids, and encode() for the ids that it has made.

White space never joins tokens of this kind of tokenizer (its pre-tokenizer
drops it), so encoding word by word gives the ids of the whole text.

A frequent word is asked for once a piece, so it makes no hot key. Should a
piece be cut differently when a lost task is run again, words without an
answer are encoded where they stand, and the result is the same.

Defined results: a null or empty text has no tokens and decodes to an empty
text; repeated rows are encoded one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import small_batches

#: Bytes of text in a piece.
PIECE = 16 << 20
#: Distinct words that a task of the word table holds at once.
HELD = 2_000_000


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """The library's tokenizer, word by word."""

    _of: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pieces = {i: p for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.pieces = pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.string())

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian unsigned 32-bit."""
        out = []
        for k in range(0, len(words), 20_000):
            batch = [w.decode("utf-8", "replace") for w in words[k : k + 20_000]]
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return out

    def decode(self, ids: pa.BinaryArray) -> pa.StringArray:
        """Texts of ids (little-endian unsigned 32-bit), pieces joined as the library joins them where a tokenizer names no decoder. Null gives null; ids that the vocabulary lacks are left out, as the library does."""
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0])
        bounds = (offsets - offsets[0]) // 4
        if len(flat):
            here = flat < len(self.pieces)
            here[here] = np.array(self.pieces.is_valid())[flat[here]]
            if not here.all():
                bounds = np.concatenate([[0], np.cumsum(here)])[bounds]
                flat = flat[here]
        pieces = self.pieces.take(pa.array(flat))
        out = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces), " ")
        return pa.compute.if_else(ids.is_valid(), out, pa.scalar(None, pa.string())) if ids.null_count else out


def _pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows in pieces of about PIECE bytes of text, and each piece's number."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number, held, size = (context.partitionId() if context else 0) << 24, [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0))
        at = 0
        while at < len(lengths):
            upto = np.cumsum(lengths[at:], dtype=np.int64)
            n = int(np.searchsorted(upto, PIECE - size)) + 1
            part = batch.slice(at, n)
            held.append(part)
            size += int(upto[min(n, len(upto)) - 1])
            at += n
            if size >= PIECE:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def _texts(batches: list[pa.RecordBatch], text: str) -> list[bytes]:
    out = []
    for b in batches:
        out += [x or b"" for x in b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
    return out


def _asked(texts: list[bytes], buckets: int) -> list[list[bytes]]:
    """The distinct words of texts by bucket, each list in order."""
    words: set[bytes] = set()
    for t in texts:
        words.update(t.split())
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in words:
        out[zlib.crc32(w) % buckets].append(w)
    for x in out:
        x.sort()
    return out


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def encode(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """(carried columns, n_tokens long, ids binary: little-endian unsigned 32-bit, decoded string) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or public_path()
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("t"))

    def ask(batches):
        for number, held in _pieces(batches, "t"):
            lists = _asked(_texts(held, "t"), buckets)
            full = [b for b in range(buckets) if lists[b]]
            for k in range(0, len(full), 64):
                some = full[k : k + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([_pack(b"\n".join(lists[b])) for b in some], pa.binary())],
                    ["piece", "bucket", "words"],
                )

    def answer(batches):
        codec, known = Codec.at(path), {}
        for batch in batches:
            for piece, bucket, packed in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words = _unpack(packed).split(b"\n")
                new = [w for w in words if w not in known]
                if len(known) + len(new) > HELD:
                    known, new = {}, words
                known.update(zip(new, codec.encode(new), strict=True))
                ids = [known[w] for w in words]
                body = np.array([len(x) // 4 for x in ids], "<u4").tobytes() + b"".join(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece], pa.int64()), pa.array([bucket], pa.int32()), pa.array([len(words)], pa.int32()), pa.array([zlib.crc32(packed)], pa.int64()), pa.array([_pack(body)], pa.binary())],
                    ["piece", "bucket", "n", "sum", "ids"],
                )

    def hold(batches):
        for number, held in _pieces(batches, "t"):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for b in held:
                    out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece", "rows"])

    fields = [rows.schema[f"c{i}"] for i in range(len(carry))]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def join(left: Iterator[pa.RecordBatch] | pa.Table, right: pa.Table) -> pa.Table:
        codec = Codec.at(path)
        answers = {b: (n, s, x) for b, n, s, x in zip(*[right.column(c).to_pylist() for c in ("bucket", "n", "sum", "ids")], strict=True)}
        tables = []
        for blob in left.column("rows"):
            held = pa.ipc.open_stream(pa.BufferReader(blob.as_buffer())).read_all().to_batches()
            texts = _texts(held, "t")
            ids_of: dict[bytes, bytes] = {}
            for bucket, words in enumerate(_asked(texts, buckets)):
                if not words:
                    continue
                n, check, packed = answers.get(bucket, (-1, 0, b""))
                if n == len(words) and check == zlib.crc32(_pack(b"\n".join(words))):
                    body = _unpack(packed)
                    ends = np.cumsum(np.frombuffer(body, "<u4", n), dtype=np.int64) * 4 + 4 * n
                    starts = [4 * n, *ends[:-1].tolist()]
                    ids_of.update(zip(words, [body[a:b] for a, b in zip(starts, ends.tolist(), strict=True)], strict=True))
                else:
                    ids_of.update(zip(words, codec.encode(words), strict=True))
            del texts
            for batch in held:  # one batch's results as Python objects at a time
                texts = _texts([batch], "t")
                ids = pa.array([b"".join(map(ids_of.__getitem__, t.split())) for t in texts], pa.binary())
                decoded = codec.decode(ids)
                counts = pa.compute.divide(pa.compute.binary_length(ids), 4).cast(pa.int64())
                kept = pa.Table.from_batches([batch]).drop_columns(["t"])
                tables.append(kept.append_column("n_tokens", counts).append_column("ids", ids).append_column("decoded", decoded))
        return pa.concat_tables(tables) if tables else _empty(right)

    def _empty(right):
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema).empty_table()

    asked = rows.select("t").mapInArrow(ask, "piece long, bucket int, words binary")
    answered = asked.repartition(buckets, "bucket").mapInArrow(answer, "piece long, bucket int, n int, sum long, ids binary")
    held = rows.mapInArrow(hold, "piece long, rows binary")
    out = held.groupBy("piece").cogroup(answered.groupBy("piece")).applyInArrow(join, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens", "ids", "decoded")


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the texts of its ids (binary: little-endian unsigned 32-bit) as column to; one of that name gives way. Null gives null, no ids give an empty text; rows stay where they lie."""
    small_batches(df.sparkSession)
    path = path or public_path()
    rows = df.drop(to).withColumn(to, F.col(f"`{ids}`"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(to, T.StringType())])

    def run(batches):
        codec = Codec.at(path)
        for batch in batches:
            *kept, last = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, codec.decode(last)], batch.schema.names)

    return rows.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
