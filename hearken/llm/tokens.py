"""Token-id files with Elias-Fano document boundaries (operator 9).

``write_ids`` range-sorts documents by id, or by the columns it is told, and streams each partition into two files of the
shared folder: ``shard-N.ids``, the concatenated ids as little-endian unsigned integers of 2 or 4 bytes, and ``shard-N.idx``,
the document boundaries, Elias-Fano coded, and the document ids, so coded too if they ascend, else plain.  A file is written under a name of its attempt and then
renamed, so a task that is run again, or twice at a time, leaves one whole file.  ``read_ids`` reads the files.

Nulls and odd input: a null text is the empty text (one end id); a null doc_id sorts first; rows with one doc_id are kept
each, in the order of their text's hash; an empty table gives no shard and no row.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import open_fs, scratch, small_batches, table
from hearken.llm.elias_fano import EliasFano

END_ID = 2
#: Pieces whose ids a worker remembers in each of two generations, characters of texts handled at a time, and stretches put
#: together at a time.  They bound memory only.
CACHE, SLICE, BLOCK = 350_000, 1 << 22, 1 << 18
#: How the vocabulary writes a space.
_SPACE = "\u0120"
#: White space of Unicode; a text is irregular where it stands at an end or side by side.
_WHITE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IRREGULAR = rf"\A{_WHITE}|{_WHITE}\z|{_WHITE}{_WHITE}"
#: Characters whose kind all libraries agree on: Latin, Greek, Cyrillic, dashes and quotes; line ends alone inside a stretch.
_TRUSTED = r"[!-~\x{a1}-\x{ac}\x{ae}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3c9}\x{400}-\x{481}\x{48a}-\x{52f}\x{2010}-\x{2027}]"
_PLAIN = rf"\A(?:{_TRUSTED}+\n)*{_TRUSTED}+\z"
#: The tokenizer's pattern of pieces, for text whose white space stands alone; fixed.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \n\p{L}\p{N}]+|\n"
_MARK = "\x01"
_MAGIC = b"EFID0002"
_IDX_HEAD = "<8sB?QQQ"
_ENCODERS: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(values: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches `which` of values, stretch i being lens[i] values from starts[i] on, one after the other."""
    out = []
    for a in range(0, len(which), BLOCK):
        w = which[a : a + BLOCK]
        n = lens[w]
        end = np.cumsum(n)
        out.append(values[np.arange(end[-1]) - np.repeat(end - n - starts[w], n)])
    return np.concatenate(out) if out else values[:0]


class WordEncoder:
    """Byte-level BPE through the tokenizers library, each distinct piece of text once.

    Such a tokenizer first cuts a text into pieces and merges inside a piece only.  A piece begins at a single space
    between two characters that aren't white space.  So a text's ids are those of its stretches between such spaces, and
    those of a stretch of trusted characters are those of its pieces, found by the tokenizer's own pattern.  Texts are cut and
    numbered by Arrow's functions; the library's model sees each piece of a slice that the worker doesn't remember, as
    the characters that stand for its bytes.  The first stretch of a text, and one of other characters or of white space that doesn't
    stand alone, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        if sys.byteorder != "little":
            raise OSError("ids are written by machines of little-endian order")
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code, self.width = ("H", 2) if self.kind == "<u2" else ("I", 4)
        # bytes that are printable in Latin-1 stand for themselves, the others for the characters from 256 on, in order
        others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.signs = {b: chr(256 + i) for i, b in enumerate(others)}
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or piece == "\n":
            piece = piece.encode().decode("latin-1").translate(self.signs)
        elif piece[0] == " ":
            piece = _SPACE + piece[1:]
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _table(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one part after the other, and how many each part has."""
        return np.frombuffer(b"".join(parts), self.kind), np.fromiter(map(len, parts), np.int64, len(parts)) // self.width

    def _of_pieces(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(stretches, pattern=_PIECE, replacement="\\0" + _MARK)
        lists = pc.split_pattern(pc.utf8_rtrim(marked, characters=_MARK), _MARK)
        numbered = lists.flatten().dictionary_encode()
        pieces, known, before = numbered.dictionary.to_pylist(), self.pieces, self.before
        ids = list(map(known.get, pieces))
        for i, x in enumerate(ids):
            if x is None:
                p = pieces[i]
                ids[i] = known[p] = before.get(p) or self._piece(p)
        if len(known) > CACHE:  # what was not met since the last time is forgotten
            self.pieces, self.before = {}, known
        values, lens = self._table(ids)
        which, offsets = numbered.indices.to_numpy(), lists.offsets.to_numpy()
        return gathered(values, np.cumsum(lens) - lens, lens, which), np.add.reduceat(lens[which], offsets[:-1] - offsets[0])

    def _of_stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each stretch, a space before it, start and how many they are."""
        plain = np.asarray(pc.match_substring_regex(stretches, _PLAIN))
        spaced = pc.binary_join_element_wise(" ", stretches, "")
        values, n = self._of_pieces(spaced.filter(pa.array(plain))) if plain.any() else self._table([])
        rest, m = self._table(self._whole(spaced.filter(pa.array(~plain)).to_pylist()))
        starts, lens = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
        lens[plain], lens[~plain] = n, m
        starts[plain], starts[~plain] = np.cumsum(n) - n, len(values) + np.cumsum(m) - m
        return np.concatenate([values, rest]), starts, lens

    def _of_lists(self, lists: pa.Array) -> list[np.ndarray]:
        offsets = lists.offsets.to_numpy()
        first, flat = offsets[:-1] - offsets[0], lists.flatten()
        numbered = flat.dictionary_encode()
        values, starts, lens = self._of_stretches(numbered.dictionary)
        heads, n = self._table(self._whole(flat.take(pa.array(first)).to_pylist()))
        which = numbered.indices.to_numpy().astype(np.int64)
        which[first] = len(lens) + np.arange(len(first))
        starts, lens = np.append(starts, len(values) + np.cumsum(n) - n), np.append(lens, n)
        of_text = np.add.reduceat(lens[which], first)
        return np.split(gathered(np.concatenate([values, heads]), starts, lens, which), np.cumsum(of_text)[:-1])

    @staticmethod
    def cut(text: str) -> list[str]:
        """Stretches between single spaces that have no white space beside them."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if not p or not out[-1] or p[0].isspace() or out[-1][-1].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        column = pa.array(texts, pa.string())
        odd = np.asarray(pc.match_substring_regex(column, _IRREGULAR))
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        for some, lists in ((~odd, lambda: pc.split_pattern(column.filter(pa.array(~odd)), " ")), (odd, lambda: pa.array([self.cut(texts[i]) for i in np.flatnonzero(odd)], pa.list_(pa.string())))):
            if some.any():
                for i, ids in zip(np.flatnonzero(some).tolist(), self._of_lists(lists()), strict=True):
                    out[i] = ids
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of about `most` characters, a longer text alone."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def _writer(folder: str, path: str, end_id: int, by_id: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        name, own = f"{root}/shard-{shard:06d}", f"{root}/.{uuid.uuid4().hex}"
        encoder, out = None, None
        ids: list[pa.Array] = []
        sizes: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root)
                encoder, out = _encoder(path), fs.open_output_stream(own + ".ids")
                end = np.array([end_id], encoder.kind)
            ids.append(batch.column(0))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                for got in encoder.encode(texts[a:b]):
                    out.write(got.tobytes() + end.tobytes())
                    sizes.append(len(got) + 1)
        if out is None:
            return
        out.close()
        bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        n_ids, all_ids = int(bounds[-1]), pa.chunked_array(ids)
        with fs.open_output_stream(own + ".idx") as f:
            f.write(struct.pack(_IDX_HEAD, _MAGIC, encoder.width, by_id, len(sizes), n_ids, all_ids.null_count))
            f.write(EliasFano.encode(bounds).to_bytes())
            if by_id:
                f.write(EliasFano.encode(all_ids.drop_null().to_numpy()).to_bytes())
            else:
                f.write(pc.fill_null(all_ids, 0).to_numpy().astype("<i8").tobytes())
                f.write(np.asarray(all_ids.is_null()).tobytes())
        for kind in (".ids", ".idx"):
            fs.move(own + kind, name + kind)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(sizes)], "n_ids": [n_ids]})

    return write


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, order: list[str] | None = None) -> list[tuple[int, int, int]]:
    """Write documents' ids in ascending doc_id order, or in that of the columns `order`; returns (shard, documents, ids) of each
    shard in order.

    The list, also written as manifest.json, has one short entry for each shard, whatever the documents' number.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"by_{i}") for i, c in enumerate(order or ())])
    keys = [f"by_{i}" for i in range(len(order))] if order else ["doc_id", "tie"]
    rows = (rows if order else rows.withColumn("tie", F.xxhash64("text"))).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    with small_batches(docs.sparkSession):
        done = rows.mapInArrow(_writer(folder, path, end_id, not order), "shard long, n_docs long, n_ids long").collect()
    manifest = sorted((r.shard, r.n_docs, r.n_ids) for r in done)
    fs, root = open_fs(folder)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"tokenizer": os.path.basename(path), "end_id": end_id, "shards": manifest}).encode())
    return manifest


class Shard:
    """One shard's files: boundaries by select, ids by seek."""

    def __init__(self, folder: str, shard: int):
        self.fs, root = open_fs(folder)
        self.name = f"{root}/shard-{shard:06d}"
        with self.fs.open_input_stream(self.name + ".idx") as f:
            data = f.read()
        magic, width, by_id, self.n_docs, self.n_ids, n_null = struct.unpack_from(_IDX_HEAD, data)
        if magic != _MAGIC:
            raise ValueError(f"{self.name}.idx isn't an index of token ids")
        self.kind = f"<u{width}"
        self.bounds, at = EliasFano.from_bytes(data, struct.calcsize(_IDX_HEAD))
        if by_id:
            self.doc_ids = pa.concat_arrays([pa.nulls(n_null, pa.int64()), pa.array(EliasFano.from_bytes(data, at)[0].decode(), pa.int64())])
        else:
            nulls = np.frombuffer(data, bool, self.n_docs, at + 8 * self.n_docs)
            self.doc_ids = pa.array(np.frombuffer(data, "<i8", self.n_docs, at), pa.int64(), mask=nulls)

    def ids(self, i: int) -> np.ndarray:
        """The ids of document i of the shard."""
        a, b, width = self.bounds.select(i), self.bounds.select(i + 1), int(self.kind[2])
        with self.fs.open_input_file(self.name + ".ids") as f:
            f.seek(a * width)
            return np.frombuffer(f.read((b - a) * width), self.kind)


def _reader(folder: str, starts: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                s = Shard(folder, shard)
                bounds = s.bounds.decode()
                sizes = np.diff(bounds)
                with s.fs.open_input_stream(s.name + ".ids") as f:
                    for a in range(0, s.n_docs, 4096):
                        part = sizes[a : a + 4096]
                        crcs = [zlib.crc32(np.frombuffer(f.read(int(n) * int(s.kind[2])), s.kind).astype("<u4").tobytes()) for n in part]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": s.doc_ids.slice(a, len(part)),
                            "start": bounds[a : a + len(part)] + starts[shard],
                            "n_tokens": part,
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        })

    return read


def read_ids(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start among all ids, n_tokens, ids_crc32."""
    starts, at = {}, 0
    for shard, _, n_ids in manifest:
        starts[shard] = at
        at += n_ids
    shards = spark.createDataFrame([(s,) for s in starts] or [], "shard long").repartition(max(1, len(starts)), "shard")
    return shards.mapInArrow(_reader(folder, starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Encode, write, read back: the files stay in the shared folder."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-ids")
    return read_ids(spark, folder, write_ids(docs, folder, path, order=order))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
