"""Token ids in patched frame-of-reference blocks.

A *segment* is a self-contained byte image of whole documents; a table of segments is the token file. Parquet is the
container, so that Spark's own writer commits the files in any store the cluster can reach and a lost executor's
output is written again. Layout of a segment, little-endian:

    magic "PFR1" | u32 documents | u64 ids | u32 blocks
    i64 doc_id, u8 has_id, u32 length          for each document
    u64 start of each block in the block area  (the block index), and one for the end
    block: u32 minimum | u8 width | u16 exceptions | u8 position, u32 value for each exception | packed words

A block holds 256 ids less their minimum, packed at the width that fits a chosen percentile of them; ids that need more
bits keep their low bits in place and stand in full in the exception list.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare, stored
from .batches import REMEMBERED, by_bytes, doc_columns, kept, map_batches
from .token_counts import byte_letters

BLOCK = 256
#: Bytes of a block before its exceptions: minimum, width, number of exceptions.
HEAD = 7
PERCENTILE = 0.92
#: Ids after which a segment is closed; a longer document makes a longer segment.
SEGMENT_IDS = 32_768
SEGMENTS = "part int, seg int, n_ids long, image binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 values as rows of 4 x width 64-bit words; 64 values fill width words exactly."""
    groups = np.ascontiguousarray(rows.reshape(-1, 64).T)
    words = np.zeros((width, groups.shape[1]), np.uint64)
    for i in range(64):
        k, s = divmod(i * width, 64)
        words[k] |= groups[i] << np.uint64(s)
        if s + width > 64:
            words[k + 1] |= groups[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(words.T).reshape(len(rows), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, words.shape[1]), np.uint64)
    for i in range(64):
        k, s = divmod(i * width, 64)
        out[i] = words[k] >> np.uint64(s)
        if s + width > 64:
            out[i] |= words[k + 1] << np.uint64(64 - s)
    return np.ascontiguousarray((out & np.uint64((1 << width) - 1)).T).reshape(-1, BLOCK)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """The block index and the block area of an array of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n, BLOCK)
    low = rows.min(axis=1, initial=np.iinfo(np.uint32).max)
    rest = (rows - low[:, None]).astype(np.uint64)
    width = _bits(np.partition(rest, at := min(BLOCK - 1, int(BLOCK * percentile)), axis=1)[:, at] if n else np.zeros(0))
    fits = (np.uint64(1) << width.astype(np.uint64))[:, None]
    block, place = np.nonzero(rest >= fits)
    odd = np.bincount(block, minlength=n)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(HEAD + 5 * odd + BLOCK // 8 * width.astype(np.int64), out=starts[1:])
    area = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    area[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    area[at + 4] = width
    area[at[:, None] + np.arange(5, HEAD)] = odd.astype("<u2").view(np.uint8).reshape(n, 2)
    nth = np.arange(len(block)) - (np.cumsum(odd) - odd)[block]
    area[at[block] + HEAD + nth] = place
    area[(at + HEAD + odd)[block][:, None] + 4 * nth[:, None] + np.arange(4)] = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    for w in map(int, np.unique(width[width > 0])):
        which = np.flatnonzero(width == w)
        packed = _pack(rest[which] & np.uint64((1 << w) - 1), w)
        area[(at + HEAD + 5 * odd)[which][:, None] + np.arange(BLOCK // 8 * w)] = packed.view(np.uint8)
    return starts.astype(np.uint64), area.tobytes()


def unpack_blocks(starts: np.ndarray, area: bytes, n_ids: int) -> np.ndarray:
    n = len(starts) - 1
    raw = np.frombuffer(area, np.uint8)
    at = starts[:-1].astype(np.int64)
    low = raw[at[:, None] + np.arange(4)].copy().view(np.uint32).reshape(n) if n else np.zeros(0, np.uint32)
    width = raw[at + 4]
    odd = raw[at[:, None] + np.arange(5, 7)].copy().view(np.uint16).reshape(n).astype(np.int64) if n else np.zeros(0, np.int64)
    rows = np.zeros((n, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        size = BLOCK // 8 * int(w)
        words = raw[(at[which] + HEAD + 5 * odd[which])[:, None] + np.arange(size)].copy().view(np.uint64)
        rows[which] = _unpack(words, int(w))
    block = np.repeat(np.arange(n), odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
    value = raw[(at + HEAD + odd)[block][:, None] + 4 * nth[:, None] + np.arange(4)].copy().view(np.uint32).reshape(-1)
    rows[block, raw[at[block] + HEAD + nth]] = value
    return (rows + low[:, None].astype(np.uint64)).astype(np.uint32).reshape(-1)[:n_ids]


def segment_image(doc_ids: list[int | None], encoded: list[bytes]) -> bytes:
    """A segment of documents from their ids as little-endian bytes."""
    ids = np.frombuffer(b"".join(encoded), np.uint32)
    starts, area = pack_blocks(ids)
    head = b"PFR1" + np.uint32(len(doc_ids)).tobytes() + np.uint64(len(ids)).tobytes() + np.uint32(len(starts) - 1).tobytes()
    about = np.array([x or 0 for x in doc_ids], np.int64).tobytes() + bytes(x is not None for x in doc_ids) + np.array([len(x) // 4 for x in encoded], np.uint32).tobytes()
    return head + about + starts.tobytes() + area


def read_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a segment."""
    if image[:4] != b"PFR1":
        raise ValueError("not a token segment")
    n, n_ids, blocks = int.from_bytes(image[4:8], "little"), int.from_bytes(image[8:16], "little"), int.from_bytes(image[16:20], "little")
    own, has, length = 20, 20 + 8 * n, 20 + 9 * n
    doc_ids = [int(x) if h else None for x, h in zip(np.frombuffer(image, np.int64, n, own), image[has : has + n], strict=True)]
    index = length + 4 * n
    starts = np.frombuffer(image[index : index + 8 * (blocks + 1)], np.uint64)
    return doc_ids, np.frombuffer(image[length:index], np.uint32), unpack_blocks(starts, image[index + 8 * (blocks + 1) :], n_ids)


#: A run of Latin-1 letters, and ASCII signs, but none that begin a contraction or a special string.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_LETTERS = {b: c for b, c in enumerate(byte_letters()) if chr(b) != c}

# The normaliser and the splitter for which words can be encoded each for itself.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def parts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer makes one space of white space, drops it when it splits, parts letters from signs and knows no
    special string that white space or a sign of ``_WORD`` could be in. Then no chunk's ids depend on its neighbours."""
    special = [x["content"] for x in spec["added_tokens"]]
    return (
        spec["normalizer"] == _NORMALISER
        and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        and spec["model"]["type"] == "BPE"
        and not spec["model"]["dropout"]
        and all(x.startswith("<") and not re.search(r"\s", x) for x in special)
    )


class _Encoder:
    """The library's ids of texts, as bytes.

    Texts are cut at spaces and line ends; each distinct chunk of a batch is looked up once, and the ids of the texts are
    gathered from those of their chunks. Most chunks are a word and perhaps signs. On Latin-1 letters the normaliser only
    lowers them, and the splitter parts letters from signs, so such a chunk is the word's ids, from the library's model,
    and the signs' ids. Any other chunk goes through the whole library, and so does every text where a tokenizer is not
    ``parts_at_spaces``. Chunks and words of the last generation or two are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.by_chunk = parts_at_spaces(json.loads(self.library.to_str()))
        self.image = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(True))]
        self.chunks, self.old_chunks = {}, {}
        self.words, self.old_words = {}, {}

    def texts(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """The ids of each text, and those in ``end``."""
        if not self.by_chunk:
            return [x + end for x in self.whole(texts.to_pylist())]
        if len(self.chunks) > 3 * REMEMBERED:
            self.chunks, self.old_chunks = {}, self.chunks
        if len(self.words) > 2 * REMEMBERED:
            self.words, self.old_words = {}, self.words
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        own = parts.flatten().dictionary_encode()
        distinct = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.chunks.get, distinct))
        if missing := [k for k, ids in enumerate(known) if ids is None]:
            self.learn([distinct[k] for k in missing])
            for k in missing:
                known[k] = self.chunks[distinct[k]]
        known.append(end)
        pool = np.frombuffer(b"".join(known), np.uint32)
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(length) - length
        which = np.insert(own.indices.to_numpy(), stops := np.cumsum(parts.value_lengths().to_numpy()), len(distinct))  # an end after each text
        n = length[which]
        after = np.cumsum(n)
        ids = pool[np.repeat(first[which] - after + n, n) + np.arange(n.sum())]
        edges = [0, *after[stops + np.arange(len(stops))].tolist()]
        return [ids[a:b].tobytes() for a, b in pairwise(edges)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> None:
        """Find the ids of chunks."""
        old, words, chunks, word = self.old_chunks, self.words, self.chunks, self.word
        other = []
        for chunk in missing:
            if (ids := old.get(chunk)) is not None:
                chunks[chunk] = ids
            elif found := _WORD.fullmatch(chunk):
                letters, sign = found.groups()
                letters = letters.lower()
                ids = words.get(letters)
                if ids is None:
                    ids = words[letters] = word(letters)
                if sign:
                    if sign not in chunks:
                        chunks[sign] = self.whole([sign])[0]
                    ids += chunks[sign]
                chunks[chunk] = ids
            else:
                other.append(chunk)
        if other:
            chunks.update(zip(other, self.whole(other), strict=True))

    def word(self, word: str) -> bytes:
        ids = self.old_words.get(word)
        if ids is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            ids = b"".join([self.image[t.id] for t in self.tokenize(letters)])
        return ids


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode whole texts and store them as a table of segments in ascending doc_id order.

    Rows are dealt by ranges of doc_id and sorted inside them, so (part, seg) is the order of the file. A null text
    counts as empty; null ids come first; rows with one id are ordered by their text.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seg = kept(("token_blocks", tokenizer), lambda: _Encoder(tokenizer)), TaskContext.get().partitionId(), 0
        end = np.uint32(end_id).tobytes()
        own: list[int | None] = []
        encoded: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal own, encoded, held, seg
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([held], pa.int64()), pa.array([segment_image(own, encoded)], pa.binary())], names=["part", "seg", "n_ids", "image"])
            own, encoded, held, seg = [], [], 0, seg + 1
            return row

        for batch in batches:
            for some in by_bytes(batch):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode.texts(some.column("text"), end), strict=True):
                    own.append(doc_id)
                    encoded.append(ids)
                    held += len(ids) // 4
                    if held >= SEGMENT_IDS:
                        yield closed()
        if own:
            yield closed()

    ordered = doc_columns(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, SEGMENTS), "token-segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document, from the stored segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only sums move: ids of a segment before this one within its part, and of parts before this one. The parts are as
    many as the range partitions, so their one window is small whatever the corpus.
    """

    def decode() -> object:
        def convert(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"part": [], "seg": [], "doc_id": [], "within": [], "n_tokens": [], "ids_crc32": []}
            for part, seg, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seg", "image")), strict=True):
                doc_ids, lengths, ids = read_segment(image)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.tobytes()
                out["part"] += [part] * len(doc_ids)
                out["seg"] += [seg] * len(doc_ids)
                out["doc_id"] += doc_ids
                out["within"] += (ends - lengths).tolist()
                out["n_tokens"] += lengths.tolist()
                out["ids_crc32"] += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            return {k: pa.array(v, pa.int32() if k in ("part", "seg") else pa.int64()) for k, v in out.items()}

        return convert

    docs = map_batches(segments.select("part", "seg", "image"), decode, "part int, seg int, doc_id long, within long, n_tokens long, ids_crc32 long")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("part", "seg", "n_ids")
    in_part = sizes.withColumn("seg_start", F.coalesce(F.sum("n_ids").over(before("part", "seg")), F.lit(0))).drop("n_ids")
    of_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn("part_start", F.coalesce(F.sum("n_ids").over(before("part")), F.lit(0))).drop("n_ids")
    starts = in_part.join(of_part, "part")
    return docs.join(starts, ["part", "seg"]).select("doc_id", (F.col("part_start") + F.col("seg_start") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every whole text, from the stored segments: write and read back.

    A null or empty text has the end id alone. Rows with a null doc_id come first and keep it; rows with one id are
    ordered by text, and repeated rows are encoded each for itself. A long text makes a longer segment. Further columns
    are not read. An empty table gives an empty result.
    """
    return read_segments(write_segments(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id))
