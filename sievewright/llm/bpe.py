"""Byte-pair encoding with content-defined chunks that texts share.

A rolling hash over the last 32 bytes cuts texts into chunks of some 500 bytes, at the same places wherever
the same passage stands. Chunks that stand in more than one place are encoded once: of all places one, the
owner, sends its bytes, and the ids go to every text that has the chunk. All other chunks are encoded where
their text is. Chunks are encoded by themselves, so their joins are repaired: between the last safe
place of one chunk and the first of the next the text is encoded again. A place is safe between an ASCII
letter or digit and a space, where the vocabulary's splitter always parts and never looks across; a chunk's
ids count only if their bytes add up to its safe places exactly, else the repair takes in the whole chunk
and its neighbours until they do. A text without spaces is one repair. The special token's string parts
a text before anything else, as it does in the tokenizer.

Equal texts are one text until the end: they meet by their SHA-256, each compressed by itself. Only digests, bytes of shared chunks
and their ids travel besides the texts, once each; bitmaps of fixed size spare chunks that stand in one place
and places that own nothing.

Defined results: a null text is empty and has no ids; repeated rows have equal results; extra columns are
not carried; ids beyond the vocabulary decode to nothing, bytes that are no UTF-8 to U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, raw_texts

MEAN_BITS = 9  # of the hash that are zero at a cut: chunks of 512 bytes
BITMAP = 1 << 27  # bits
BATCH = 1 << 18  # bytes that are encoded at a time
PACKED_ROWS = 500
MEMO, LONGEST_PART = 800_000, 64  # parts of words that a worker keeps, and their bytes at most
_PLAIN = frozenset(range(33, 127))
#: Between a mark or letter and a space or line end, and between a letter or digit and a mark that ends clauses, the
#: splitter always parts, whatever stands further away. A part is a character and all up to the next such place.
_PARTS = re.compile(rb"(?s).(?:[^ \n.,;:!?]++|(?<![!-~])[ \n]|(?<![A-Za-z0-9])[.,;:!?])*+").findall

_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
_WORD = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def cuts(raw: bytes) -> list[int]:
    """Where chunks end: where the hash of the last 32 bytes has zeros, moved on to the next character."""
    data = np.frombuffer(raw, np.uint8)
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        before = rolled[:-step] << np.uint32(step)
        rolled = rolled.copy()
        rolled[step:] += before
    ends = np.flatnonzero(rolled >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends = ends[ends < len(data)]
    while (inside := (data[ends] & 0xC0) == 0x80).any():
        ends = ends + inside
        ends = ends[ends < len(data)]
    return [*np.unique(ends).tolist(), *[len(data)] * (len(data) > 0)]


class Vocabulary:
    """A byte-level tokenizer of the tokenizers library: its ids, their bytes, and its special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        byte = {c: b for b, c in _byte_letters().items()}
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[number] = token.encode() if token in special else bytes(byte[c] for c in token)
        self.memo: dict[bytes, bytes] = {}
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start, self.joined = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(self.bytes), np.uint8)
        self.special = {t.encode(): i for t, i in special.items()}
        self.parting = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if special else None

    def segments(self, raw: bytes) -> list[bytes]:
        """Ordinary texts and special tokens in turn, an ordinary one first and last."""
        return self.parting.split(raw) if self.parting else [raw]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of ordinary texts. What stands between two places where the splitter always parts is encoded once for all texts of a worker,
        as long as MEMO keeps it."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            parted = [_PARTS(t) for t in texts[at:end]]
            if len(self.memo) > MEMO:
                self.memo = {}
            known = self.memo
            new = set(chain.from_iterable(parted)).difference(known)
            spaced = [p for p in new if p[0] == 32 and p[-1] in _PLAIN]  # these part wherever they stand in a row
            alone = [p for p in new if not (p[0] == 32 and p[-1] in _PLAIN)]
            known.update(zip(spaced, self._in_a_row(spaced)))
            known.update(zip(alone, (array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False))))
            out += [np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32) for parts in parted]
            for p in new:
                if len(p) > LONGEST_PART:
                    del known[p]
            at = end
        return out

    def _in_a_row(self, parts: list[bytes]) -> list[bytes]:
        """The ids of parts that begin with a space and end with a visible character, encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(parts).decode()], add_special_tokens=False)[0].ids, np.int32)
        at = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(p) for p in parts]))
        raw, ends = ids.tobytes(), (4 * (at + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.bytes))]
        return b"".join(self._said(ids[at : at + BATCH // 4]) for at in range(0, len(ids), BATCH // 4)).decode("utf-8", "replace")

    def _said(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.joined[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + size, size)].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves,
    the others in turn from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


def _safe(chunk: bytes) -> tuple[int, int] | None:
    """The first and the last place inside a chunk that parts words."""
    data = np.frombuffer(chunk, np.uint8)
    places = np.flatnonzero((data[1:] == 32) & _WORD[data[:-1]]) + 1
    return (int(places[0]), int(places[-1])) if len(places) else None


class _Text:
    """A segment's chunks, what is known of them and the repairs between them."""

    def __init__(self, chunks: list[bytes], known: list[np.ndarray], length: np.ndarray):
        self.pieces: list[np.ndarray | None] = []
        self.repairs: list[bytes] = []
        open_: list[bytes] = []  # text that is not settled yet
        for k, (chunk, ids) in enumerate(zip(chunks, known)):
            first, last = k == 0, k == len(chunks) - 1
            safe = _safe(chunk)
            begin, end = (0 if first else safe[0], len(chunk) if last else safe[1]) if safe or (first and last) else (None, None)
            if begin is not None:
                reach = np.concatenate(([0], np.cumsum(length[ids])))
                at = np.searchsorted(reach, [begin, end])
                if reach[at[0]] != begin or reach[at[1]] != end:  # no agreement: the repair takes in the chunk
                    begin = None
            if begin is None:
                open_.append(chunk)
                continue
            self._repair([*open_, chunk[:begin]])
            self.pieces.append(ids[at[0] : at[1]])
            open_ = [chunk[end:]]
        self._repair(open_)

    def _repair(self, parts: list[bytes]) -> None:
        if text := b"".join(parts):
            self.pieces.append(None)
            self.repairs.append(text)

    def ids(self, repaired: list[np.ndarray]) -> np.ndarray:
        mended = iter(repaired)
        return np.concatenate([np.zeros(0, np.int32), *(next(mended) if p is None else p for p in self.pieces)])


def encode_text(raw: bytes, shared: dict[int, np.ndarray], words: Vocabulary) -> np.ndarray:
    """The ids of a text of which some chunks, by their number in the text, are known."""
    out, number = [], 0
    for k, segment in enumerate(words.segments(raw)):
        if k % 2:
            out.append(np.array([words.special[segment]], np.int32))
            continue
        ends = cuts(segment)
        chunks = [segment[a:b] for a, b in zip([0, *ends], ends)]
        known = [shared.get(number + x) for x in range(len(chunks))]
        own = iter(words.encode([c for c, ids in zip(chunks, known) if ids is None]))
        text = _Text(chunks, [next(own) if ids is None else ids for ids in known], words.length)
        out.append(text.ids(words.encode(text.repairs)))
        number += len(chunks)
    return np.concatenate(out)


def encode_plain(raws: list[bytes], words: Vocabulary) -> list[np.ndarray]:
    """The ids of texts of which no chunk is known."""
    parted = [words.segments(raw) for raw in raws]
    found = iter(words.encode([s for segments in parted for s in segments[::2] if s]))
    none = np.zeros(0, np.int32)
    out = []
    for segments in parted:
        ids = [np.array([words.special[s]], np.int32) if k % 2 else next(found) if s else none for k, s in enumerate(segments)]
        out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
    return out


def _chunks(raw: bytes, words: Vocabulary):
    """(number, bytes) of a text's chunks."""
    number = 0
    for segment in words.segments(raw)[::2]:
        at = 0
        for end in cuts(segment):
            yield number, segment[at:end]
            number, at = number + 1, end


def _place(key: bytes, number: int) -> int:
    return xxhash.xxh3_64_intdigest(key + number.to_bytes(8, "little")) - (1 << 63)


def _listed(path: str):
    """Rows (digest, place) of chunks."""

    def emit(batches):
        words = vocabulary(path)
        for batch in batches:
            digests, places = [], []
            for key, raw in zip(batch.column("key").to_pylist(), raw_texts(batch.column("text"))):
                for number, chunk in _chunks(raw, words):
                    digests.append(xxhash.xxh3_128_digest(chunk))
                    places.append(_place(key, number))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(places, pa.int64())], names=["digest", "place"])

    return emit


def _known(bits, value: int) -> bool:
    bit = value % BITMAP
    return bool(int(bits[bit >> 6]) >> (bit & 63) & 1)


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:7], "big")


def _shared(path: str, digests, owners):
    """Rows (key, number, place, digest, bytes) of chunks whose digest the one bitmap knows; bytes of those whose place
    the other knows as an owner's."""

    def emit(batches):
        words = vocabulary(path)
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column("key").to_pylist(), raw_texts(batch.column("text"))):
                for number, chunk in _chunks(raw, words):
                    if _known(digests.value, _number(digest := xxhash.xxh3_128_digest(chunk))):
                        place = _place(key, number)
                        rows.append((key, number, place, digest, chunk if _known(owners.value, place) else None))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["key", "number", "place", "digest", "bytes"])

    return emit


def _encode_chunks(path: str):
    def encode(batches):
        words = vocabulary(path)
        for batch in batches:
            found = words.encode(batch.column("bytes").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([ids.tobytes() for ids in found], pa.binary())], names=["digest", "ids"])

    return encode


def _packed(batches):
    """Rows (key, packed) of texts, made small before they are shuffled."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        column = batch.column("text")
        for at in range(0, len(column), PACKED_ROWS):
            raws = raw_texts(column.slice(at, PACKED_ROWS))
            keys = [hashlib.sha256(raw).digest() for raw in raws]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(map(pack, raws), pa.binary())], names=["key", "packed"])


def _assemble(path: str, decoded: bool):
    def assemble(batches):
        words, unpack = vocabulary(path), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                raw = unpack(batch.column("packed")[k].as_py())
                shared = {s["number"]: np.frombuffer(s["ids"], np.int32) for s in batch.column("shared")[k].as_py() or ()}
                rows.append((batch.column("key")[k].as_py(), raw, shared))
                size += len(raw)
                if size > BATCH or k == batch.num_rows - 1:
                    yield _encoded(rows, words, decoded)
                    rows, size = [], 0

    return assemble


def _encoded(rows: list[tuple[bytes, bytes, dict]], words: Vocabulary, decoded: bool) -> pa.RecordBatch:
    plain = iter(encode_plain([raw for _, raw, shared in rows if not shared], words))
    out = [encode_text(raw, shared, words) if shared else next(plain) for _, raw, shared in rows]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
    columns = {"key": pa.array([key for key, _, _ in rows], pa.binary()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))}
    columns |= {"said": pa.array(map(words.decode, out), pa.string())} if decoded else {}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def text_key(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _bitmap(rows: DataFrame, value) -> np.ndarray:
    """The bits of a column's values, in an array of BITMAP bits whatever their number."""
    bit = F.pmod(value, F.lit(BITMAP))
    masks = rows.select(F.shiftright(bit, 6).alias("at"), (bit % 64).cast("int").alias("k")).groupBy("at").agg(F.expr("bit_or(shiftleft(1L, k))").alias("bits")).toArrow()
    out = np.zeros(BITMAP >> 6, np.int64)
    out[masks.column("at").to_numpy()] = masks.column("bits").to_numpy()
    return out


def encode_distinct(docs: DataFrame, path: str, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids) of every distinct text of docs that is not empty; key is text_key, ids an array of int. If ``decoded``,
    also ``said``, what the ids decode to, made in the same task."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    texts = docs.where(F.octet_length(text) > 0).select(text_key(text).alias("key"), F.col(text).alias("text"))
    # equal texts have equal places, so a chunk of two places stands in two texts or twice in one
    counted = texts.mapInArrow(_listed(path), "digest binary, place long").groupBy("digest").agg(F.min("place").alias("place"), F.max("place").alias("last"))
    owners = scratch.save(counted.where("place <> last").select("digest", "place"), "owners")
    digest_bits = _bitmap(owners, F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"))
    bits = [spark.sparkContext.broadcast(x) for x in (digest_bits, _bitmap(owners, F.col("place")))]
    met = scratch.save(texts.mapInArrow(_shared(path, *bits), "key binary, number int, place long, digest binary, bytes binary"), "met")
    sent = met.where("bytes is not null").select("place", "digest", "bytes").join(owners, ["place", "digest"])
    encoded = scratch.save(sent.groupBy("digest").agg(F.first("bytes").alias("bytes")).mapInArrow(_encode_chunks(path), "digest binary, ids binary"), "encoded")
    places = met.select("key", "number", "digest").distinct()
    shared = places.join(encoded, "digest").groupBy("key").agg(F.collect_list(F.struct("number", "ids")).alias("shared"))
    once = texts.select("text").mapInArrow(_packed, "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))
    return once.join(shared, "key", "left").select("key", "packed", "shared").mapInArrow(_assemble(path, decoded), "key binary, ids array<int>" + ", said string" * decoded)


def encode_texts(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """docs with ``ids``, the text's tokens; a column of that name is replaced."""
    (key,) = fresh(docs, "text_key")
    ids = encode_distinct(docs, path, text=text).withColumnRenamed("key", key)
    out = docs.drop("ids").withColumn(key, text_key(text)).join(ids, key, "left").drop(key)
    return out.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def decode_ids(encoded: DataFrame, path: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """encoded with the text that its ids say; a column of that name is replaced. Null ids give a null text."""
    kept = encoded.drop(into)
    schema = kept.withColumn(into, F.lit(None).cast("string")).schema

    def decode(batches):
        words = vocabulary(path)
        for batch in batches:
            said = [None if x is None else words.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, into])

    return kept.mapInArrow(decode, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The query's columns, made once for each distinct text and joined to its documents."""
    read = encode_distinct(docs, path, decoded=True)
    told = read.select("key", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("a"), F.sha2("said", 256).alias("b"))
    empty = F.sha2(F.lit(""), 256)
    out = docs.select("doc_id", text_key("text").alias("key")).join(told, "key", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_tokens"), F.coalesce("a", empty).alias("ids_sha256"), F.coalesce("b", empty).alias("decoded_sha256"))
