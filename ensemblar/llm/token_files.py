"""Token ids in word-aligned binary files.

Texts are encoded with a public tokenizer and packed with Simple-8b: a 64-bit word
holds a 4-bit selector and as many ids as fit in 60 bits.  Ids of 60 bits or more
are escapes: the word holds 0 and the id stands in an escape table.  A shard is

    magic "E8B1"; uint32 documents, blocks, escapes; uint64 ids
    int64 document ids; int64 ids of each document
    uint64 first word of each block, and the number of words
    uint64 place and uint64 value of each escape
    uint64 words

in little-endian order, with BLOCK ids to a block, so that a reader can start at
any block.  Shards are the binary column of a Parquet table in the order of part
and seq, which is the order of the document ids: Spark commits and reads them
wherever the table lies, and a lost executor only repeats its own task.

The encoder cuts texts where the tokenizer's rules cut them anyhow and encodes each
different piece once, so the ids are those of the whole text.  It knows the rules of one
kind of file; with any other it encodes whole texts.

Defined cases: a null or empty text has the end id only; null ids come first;
repeated rows are written each; further columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import bound_batches
from .textnum import NOT_SPACE, Text, texts_of

END_ID = 2
BLOCK = 4096
#: Ids after which a shard is closed; a longer document is a shard of its own.
SHARD_IDS = 1 << 18
#: Bytes of pieces and ids that an encoder remembers before it starts anew.
CACHE_BYTES = 24 << 20
#: Fixed values of the format: ids in a word, and bits of each, by selector.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
# The rules that pre_tokens cuts by, as a tokenizer file states them.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIIIQ")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, places and values of the escapes."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    over = np.flatnonzero(ids >> np.uint64(60))
    escaped = ids[over]
    ids = ids.copy()
    ids[over] = 0
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n))
    count, which = np.zeros(n, np.int64), np.zeros(n, np.int8)
    for s, (c, bits) in enumerate(SELECTORS):
        wide = np.zeros(n + 1, np.int32)
        np.cumsum(ids >= np.uint64(1 << bits), out=wide[1:])
        if wide[-1] == n:
            continue
        fits = (count == 0) & (left >= c)
        fits[: max(0, n - c + 1)] &= wide[c:] == wide[: n + 1 - c] if n >= c else False
        count[fits], which[fits] = c, s
    # no word crosses a block, so all blocks are walked at once
    is_word = np.zeros(n, bool)
    p = np.arange(0, n, BLOCK)
    while len(p):
        is_word[p] = True
        p = p + count[p]
        p = p[(p % BLOCK != 0) & (p < n)]
    at = np.flatnonzero(is_word)
    kind = which[at]
    words = kind.astype(np.uint64) << np.uint64(60)
    for s, (c, bits) in enumerate(SELECTORS):
        here = np.flatnonzero(kind == s)
        if len(here) and bits:
            shifts = (np.arange(c) * bits).astype(np.uint64)
            words[here] |= np.bitwise_or.reduce(ids[at[here][:, None] + np.arange(c)] << shifts, axis=1)
    blocks = np.searchsorted(at, np.arange(0, n, BLOCK)).astype(np.uint64)
    return words, np.append(blocks, np.uint64(len(words))), over.astype(np.uint64), escaped


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of some words, escapes as 0."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([c for c, _ in SELECTORS])[kind]
    at = np.cumsum(count) - count
    ids = np.zeros(n, np.uint64)
    for s, (c, bits) in enumerate(SELECTORS):
        here = np.flatnonzero(kind == s)
        if len(here) and bits:
            shifts = (np.arange(c) * bits).astype(np.uint64)
            ids[at[here][:, None] + np.arange(c)] = (words[here][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return ids


def to_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, blocks, places, values = pack(ids)
    head = _HEAD.pack(b"E8B1", len(doc_ids), len(blocks) - 1, len(places), len(ids))
    parts = (doc_ids.astype("<i8"), lengths.astype("<i8"), blocks.astype("<u8"), places.astype("<u8"), values.astype("<u8"), words.astype("<u8"))
    return head + b"".join(x.tobytes() for x in parts)


def from_shard(data: bytes, first_block: int = 0, end_block: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their lengths, and the ids of the blocks asked for (all, by default)."""
    magic, n_docs, n_blocks, n_over, n = _HEAD.unpack_from(data)
    if magic != b"E8B1":
        raise ValueError("not a token shard")
    at, parts = _HEAD.size, []
    for size, kind in ((n_docs, "<i8"), (n_docs, "<i8"), (n_blocks + 1, "<u8"), (n_over, "<u8"), (n_over, "<u8")):
        parts.append(np.frombuffer(data, kind, size, at))
        at += 8 * size
    doc_ids, lengths, blocks, places, values = parts
    end_block = n_blocks if end_block is None else end_block
    words = np.frombuffer(data, "<u8", int(blocks[end_block] - blocks[first_block]), at + 8 * int(blocks[first_block]))
    low = first_block * BLOCK
    ids = unpack(words, max(0, min(n, end_block * BLOCK) - low))
    inside = (places >= low) & (places < low + len(ids))
    ids[(places[inside] - np.uint64(low)).astype(np.int64)] = values[inside]
    return doc_ids, lengths, ids


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ASCII = np.arange(256) < 0x80


def pre_tokens(t: Text, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of pieces that the tokenizer never joins, and whether each is one pre-token.

    Its rules cut at white space and at changes between letters, digits and other signs, but
    for an apostrophe with letters after it.  So a letter (a-z, A-Z, U+00C0 to U+027F but the
    two signs in between and U+0130, lowered to a letter and a mark) ends a piece before an ASCII sign or digit, a digit before ASCII, and
    an ASCII sign other than the apostrophe before such a letter or a digit.  What stays
    together goes to the tokenizer as it is, and so does white-space text with a special token.
    """
    d = t.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    lead = (d >= 0xC3) & (d <= 0xC9)
    lead[:-1] &= ~((d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))) & ~((d[:-1] == 0xC4) & (d[1:] == 0xB0))
    letter = _LETTER[d]
    ends_letter = letter.copy()
    ends_letter[1:] |= lead[:-1]
    hit, digit, ascii_ = NOT_SPACE[d], _DIGIT[d], _ASCII[d]
    sign = ascii_ & ~letter & ~digit & hit
    cut = np.zeros(len(d) + 1, bool)
    cut[1:-1] = (ends_letter[:-1] & (sign | digit)[1:]) | (digit[:-1] & ascii_[1:]) | (sign[:-1] & (digit | ((letter | lead) & (d != 0)))[1:] & (d[:-1] != 0x27))
    edges = np.zeros(len(d) + 1, bool)
    edges[t.offsets] = True
    edges[1:-1] |= hit[1:] != hit[:-1]
    raw = d.tobytes() if specials else b""
    if any(x in raw for x in specials):
        outer = np.flatnonzero(edges)
        for m in re.finditer(b"|".join(map(re.escape, specials)), raw):
            k = int(np.searchsorted(outer, m.start(), "right"))
            cut[outer[k - 1] : outer[k] if k < len(outer) else len(d)] = False
    cut |= edges
    edge = np.flatnonzero(cut)
    if edge[-1] != len(d):
        edge = np.append(edge, len(d))
    start, end = edge[:-1], edge[1:]
    held = hit[start]
    start, end = start[held], end[held]
    # one kind of sign all through, and no letter after an apostrophe
    known = np.cumsum(np.append(0, ends_letter | lead))
    signs, length = np.cumsum(np.append(0, sign)), end - start
    letters = known[end] - known[start]
    return start, end, (letters == length) | (signs[end] - signs[start] == length) | ((length == 1) & digit[start])


class Encoder:
    """Ids of many texts; each different piece is encoded once, and known by its 64-bit hash."""

    def __init__(self, tokenizer_json: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        said = json.loads(tokenizer_json)
        self.cuts = all(said.get(k) == v for k, v in _RULES.items()) and said["model"].get("type") == "BPE" and said["model"].get("end_of_word_suffix") == "</w>" and not said["model"].get("dropout")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.specials = tuple(x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        """Empties the store: hashes in order with the place and number of their ids, in a large and a small part."""
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in range(2)]
        self.flat, self.n_flat = np.zeros(1 << 16, np.int32), 0

    def _find(self, different: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each hash, and whether it is known."""
        place, size, known = np.zeros(len(different), np.int32), np.zeros(len(different), np.int32), np.zeros(len(different), bool)
        for hashes, at, n in self.parts:
            if len(hashes):
                k = np.minimum(np.searchsorted(hashes, different), len(hashes) - 1)
                hit = hashes[k] == different
                place[hit], size[hit] = at[k[hit]], n[k[hit]]
                known |= hit
        return place, size, known

    def _keep(self, hashes: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Adds pieces, in the order of their hashes, to the small part; it joins the large one when it has an eighth of its size."""
        need = self.n_flat + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n_flat], np.zeros(max(need, need * 5 // 4) - self.n_flat, np.int32)])
        self.flat[self.n_flat : need] = ids
        join = lambda a, b: (lambda k: tuple(np.insert(x, k, y) for x, y in zip(a, b, strict=True)))(np.searchsorted(a[0], b[0]))
        self.parts[1] = join(self.parts[1], (hashes, (at + self.n_flat).astype(np.int32), size.astype(np.int32)))
        self.n_flat = need
        if 8 * len(self.parts[1][0]) > len(self.parts[0][0]):
            self.parts = [join(*self.parts), tuple(x[:0] for x in self.parts[1])]

    def _bytes(self) -> int:
        return self.flat.nbytes + sum(x.nbytes for part in self.parts for x in part)

    def _encoded(self, pieces: list[str], single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in some order, and where those of each piece are.

        Single pre-tokens go to the tokenizer many at once and are told apart by their last ids.
        """
        lone, rest = np.flatnonzero(single).tolist(), np.flatnonzero(~single).tolist()
        blocks = [lone[k : k + 512] for k in range(0, len(lone), 512)]
        order, sizes, flat = [], [], []
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in b]) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(block) and last[-1] == len(ids) - 1:
                order.append(block)
                sizes.append(np.diff(last, prepend=-1))
                flat.append(ids)
            else:
                rest.extend(block)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        order = np.concatenate([*order, rest]).astype(np.int64)
        sizes = np.concatenate([*sizes, [len(x) for x in others]]).astype(np.int64)
        flat = np.concatenate([*flat, *others]).astype(np.int64)
        at, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        at[order], size[order] = np.cumsum(sizes) - sizes, sizes
        return flat, at, size

    def __call__(self, t: Text) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        if not self.cuts:
            raw = t.data.tobytes()
            each = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)], add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        start, end, single = pre_tokens(t, self.specials)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(t.n, np.int64)
        different, first, where = np.unique(t.hashes(start, end), return_index=True, return_inverse=True)
        if self._bytes() > CACHE_BYTES:
            self.forget()
        place, size, known = self._find(different)
        new = np.flatnonzero(~known)
        if len(new):
            raw = t.data.tobytes()
            flat, at, n = self._encoded([raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)], single[first[new]])
            place[new], size[new] = at + self.n_flat, n
            self._keep(different[new], at, n, flat)
        each = size[where].astype(np.int64)
        before = np.cumsum(each) - each
        ids = self.flat[np.repeat(place[where] - before, each) + np.arange(int(each.sum()))].astype(np.int64)
        total = np.append(before, len(ids))
        at = np.searchsorted(start, t.offsets)
        return ids, total[at[1:]] - total[at[:-1]]


_encoders: dict[int, Encoder] = {}


def encoder_of(tokenizer_json: bytes) -> Encoder:
    """This worker's encoder; it outlives a task, and with it what it knows."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def broadcast_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file, of a few MB whatever the corpus, for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes all texts' ids in ascending order of the document ids."""
    bound_batches(docs.sparkSession)
    tokenizer = broadcast_tokenizer(docs.sparkSession, tokenizer_path)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder_of(tokenizer.value), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            own, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[part], [seq], [len(own)], [len(ids)], [to_shard(own, lengths, ids)]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_ids", "shard"])

        for batch in batches:
            for i, j, t in texts_of(batch, "text"):
                ids, lengths = _with_end(*encode(t), end_id)
                own = batch.column(0).slice(i, j - i).fill_null(_NULL_ID).to_numpy()
                held.append((own, lengths, ids))
                if sum(len(x[2]) for x in held) >= shard_ids:
                    yield flush()
                    seq += 1
        if held:
            yield flush()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(shards, "part int, seq long, n_docs long, n_ids long, shard binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            own, lengths, ids = from_shard(batch.column(2)[k].as_py())
            at = np.concatenate([[0], np.cumsum(lengths)])
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0)[k].as_py(), n), pa.int32()), pa.array(np.repeat(batch.column(1)[k].as_py(), n), pa.int64()), pa.array(own, pa.int64(), mask=own == _NULL_ID), pa.array(at[:-1]), pa.array(lengths), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: where its ids start in the whole sequence, their number and checksum."""
    files = spark.read.schema("part int, seq long, n_docs long, n_ids long, shard binary").parquet(path)
    docs = files.select("part", "seq", "shard").mapInArrow(_read, "part int, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # shards before this one: first by part, of which there are as many as write tasks, then inside the part
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sizes.select(F.col("part").alias("p_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p_before"))
    inside = files.select(F.col("part").alias("s_part"), F.col("seq").alias("s_seq"), (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("s_before"))
    starts = inside.join(parts, F.col("s_part") == F.col("p_part")).select("s_part", "s_seq", (F.col("s_before") + F.col("p_before")).alias("before"))
    out = docs.join(starts, (F.col("part") == F.col("s_part")) & (F.col("seq") == F.col("s_seq")))
    return out.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
