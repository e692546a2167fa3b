"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A shard is two files. `<name>.rec` holds one record per document:

    uint64 n | uint32 masked(crc32(those 8 bytes)) | n bytes | uint32 masked(crc32(the n bytes))

all little-endian, the payload being token ids, uint16 where the vocabulary has at most 65,536 of them, else uint32. `<name>.idx` holds per record
(uint64 offset in .rec, int64 doc_id, uint8 doc_id is null, uint64 ids in the shard before it), so that a reader can fetch records in
any order without scanning. A checksum c is masked as rotate_right(c, 15) + 0xA282EAD8 (mod 2^32), so that a checksum of
bytes that hold checksums stays useful. `_manifest.json` is written last, by the driver: its shards, in order of doc_id,
with the number of ids before each. Files that it doesn't name (of failed or repeated tasks) are not part of the output.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import ready, shuffle_partitions, table, work_path

MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("null_id", "u1"), ("before", "<u8")])
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
#: Words whose ids a worker remembers, in Arrow arrays of about 20 bytes a word, and the bytes of the longest of them.
STORE_WORDS, STORE_BYTES = 300_000, 64
#: Bytes of text that are encoded together; a longer text comes alone.
BATCH_BYTES = 6_000_000
#: Words that go to the tokenizer as one string.
JOINED = 1000
#: White space in the widest sense: a space between two characters that are none of these is always a word's start.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Letters, and marks that the pre-tokenizer cuts from letters before them.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
MARKS = string.punctuation
TEXT = pa.large_string()


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def id_type(vocabulary_size: int, end_id: int) -> str:
    return "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, TAIL.pack(masked(zlib.crc32(n))), payload, TAIL.pack(masked(zlib.crc32(payload)))))


def unframe(data: bytes | memoryview, offset: int) -> bytes:
    """The payload of the record at offset; ValueError if a checksum or length is wrong."""
    n, check = HEAD.unpack_from(data, offset)
    if masked(zlib.crc32(data[offset : offset + 8])) != check or offset + 16 + n > len(data):
        raise ValueError(f"damaged length at {offset}")
    payload = bytes(data[offset + 12 : offset + 12 + n])
    if TAIL.unpack_from(data, offset + 12 + n)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"damaged payload at {offset}")
    return payload


def _glued(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, TEXT) if isinstance(p, str) else p for p in parts), pa.scalar("", TEXT))


class WordEncoder:
    """Ids of texts, equal to the tokenizer's for the whole text.

    A byte-level pre-tokenizer always cuts before a single space, and around a single line feed, that stands between two characters that are no white
    space. So a text is cut there, and of the words of many texts only the distinct ones are encoded. A word stands for itself after a space, or, if it
    begins with a line feed, for the line feed's id and the ids of the rest; a text's first word gets such a line feed, whose id is dropped. All of it is done in
    Arrow arrays; the words used most stay in a store of STORE_WORDS. A tokenizer of another kind encodes texts whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made_of = json.loads(self.tokenizer.to_str())
        cutter = made_of["pre_tokenizer"] or {}
        self.by_words = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space", True) and cutter.get("use_regex", True) and not made_of["normalizer"] and not any(set(t["content"]) & set(SPACES) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made_of["added_tokens"])
        self.added = [t["content"] for t in made_of["added_tokens"]]
        self.kind = pa.uint32()
        self.words, self.ids, self.uses = pa.array([], TEXT), pa.array([], pa.large_list(self.kind)), np.zeros(0)
        if self.by_words:
            self.newline = self.encoded(["\n"])[0][0]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """A few texts at once, as the tokenizer's own results are many times as large as the ids."""
        few = (texts[i : i + 32] for i in range(0, len(texts), 32))
        return [np.array(x.ids, dtype=np.uint32) for part in few for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def lists(self, texts: list[str]) -> pa.LargeListArray:
        ids = self.encoded(texts)
        ends = np.cumsum([0, *map(len, ids)])
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(ids) if ids else [], self.kind))

    def cut(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all texts, and where each text's begin. Texts in which white space meets white space are cut by Python, one by one."""
        odd = pc.match_substring_regex(texts, f"[{SPACES}][{SPACES}]|^[{SPACES}]|[{SPACES}]$")
        plain = pc.split_pattern(_glued("\n", pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n")), " ")
        words, lengths = [plain.flatten()], np.zeros(len(texts), np.int64)
        odd = np.asarray(odd)
        lengths[~odd] = np.diff(np.asarray(plain.offsets))
        if not odd.any():
            return words[0], np.cumsum(np.append(0, lengths))
        pieces = [["\n" + first, *rest] for first, *rest in (re.split(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)", x) for x in texts.filter(pa.array(odd)).to_pylist())]
        lengths[odd] = [*map(len, pieces)]
        words.append(pa.array([w for p in pieces for w in p], TEXT))
        # texts keep their order: the pieces of both kinds are put where they belong
        begin = np.cumsum(np.append(0, lengths))
        of_odd = np.repeat(odd, lengths)
        order = np.empty(begin[-1], np.int64)
        order[~of_odd], order[of_odd] = np.arange(len(words[0])), len(words[0]) + np.arange(len(words[1]))
        return pa.concat_arrays(words).take(pa.array(order)), begin

    def of_words(self, words: pa.LargeStringArray, uses: np.ndarray) -> pa.LargeListArray:
        """Ids of distinct words that are used so often. Letters with marks behind are two parts; first parts are looked up in the store, and encoded if
        they aren't there."""
        tail = pc.utf8_ltrim(words, characters=LETTERS + "\n")
        special = np.zeros(len(words), bool)
        for content in self.added:
            special |= np.asarray(pc.match_substring(words, content))
        letters = pc.utf8_rtrim(words, characters=MARKS)
        cut = np.asarray(pc.equal(pc.utf8_rtrim(tail, characters=MARKS), "")) & np.asarray(pc.greater(pc.binary_length(tail), 0)) & np.asarray(pc.match_substring_regex(letters, f"[{LETTERS}]$")) & ~special
        heads = pc.if_else(pa.array(cut), letters, words).dictionary_encode()
        tails = tail.filter(pa.array(cut)).dictionary_encode()
        known = np.asarray(pc.fill_null(pc.index_in(heads.dictionary, value_set=self.words), -1)).astype(np.int64)
        new = known < 0
        missing = heads.dictionary.filter(pa.array(new))
        n = len(self.words) + len(missing)
        known[new] = np.arange(len(self.words), n)
        pool = pa.concat_arrays([self.ids, self.parts(missing), self.lists([*tails.dictionary.to_pylist(), ""])])
        order = np.full((len(words), 2), len(pool) - 1)
        order[:, 0] = known[np.asarray(heads.indices)]
        order[cut, 1] = n + np.asarray(tails.indices)
        self.remember(pa.concat_arrays([self.words, missing]), pool, np.append(self.uses / 2, np.zeros(len(missing))) + np.bincount(order[:, 0], uses, n))
        both = pool.take(pa.array(order.ravel()))
        return pa.LargeListArray.from_arrays(pa.array(np.asarray(both.offsets)[::2]), both.values)

    def parts(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        """Ids of words: side by side, parted by line feeds, if no white space or added token is in them, else alone."""
        fed = np.asarray(pc.starts_with(words, "\n"))
        rest = pc.if_else(pa.array(fed), pc.utf8_slice_codeunits(words, 1), words)
        alone = np.asarray(pc.or_(pc.equal(rest, ""), pc.match_substring_regex(rest, f"[{SPACES}]")))
        for content in self.added:
            alone |= np.asarray(pc.match_substring(rest, content))
        said = pc.if_else(pa.array(fed), rest, _glued(" ", rest))
        few = said.filter(pa.array(~alone))
        groups = pa.LargeListArray.from_arrays(pa.array(np.append(np.arange(0, len(few), JOINED), len(few)), pa.int64()), few)
        joined = self.encoded([g + "\n" for g in pc.binary_join(groups, pa.scalar("\n", TEXT)).to_pylist()]) if len(few) else []
        flat = np.concatenate(joined) if joined else np.zeros(0, np.uint32)
        feeds = flat == self.newline
        ends = np.cumsum(~feeds)[feeds]
        if len(ends) != len(few):
            raise ValueError("a word holds the id of a line feed")
        side = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), pa.array(flat[~feeds], self.kind))
        pool = pa.concat_arrays([side, self.lists(said.filter(pa.array(alone)).to_pylist()), pa.array([[self.newline], []], side.type)])
        order = np.empty((len(words), 2), np.int64)
        order[:, 0] = np.where(fed, len(pool) - 2, len(pool) - 1)
        order[~alone, 1], order[alone, 1] = np.arange(len(few)), len(few) + np.arange(alone.sum())
        both = pool.take(pa.array(order.ravel()))
        return pa.LargeListArray.from_arrays(pa.array(np.asarray(both.offsets)[::2]), both.values)

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end); texts without nulls."""
        if not self.by_words or not len(texts):
            whole = self.lists(texts.to_pylist())
            return np.asarray(whole.values), np.asarray(whole.offsets)
        words, begin = self.cut(texts)
        coded = words.dictionary_encode()
        at = np.asarray(coded.indices)
        parts = self.of_words(coded.dictionary, np.bincount(at, minlength=len(coded.dictionary))).take(coded.indices)
        flat, starts = np.asarray(parts.values), np.asarray(parts.offsets)[begin]
        keep = np.ones(len(flat), bool)
        keep[starts[:-1]] = False  # the line feed put before each text
        return flat[keep], starts - np.arange(len(starts))

    def remember(self, words: pa.LargeStringArray, ids: pa.LargeListArray, uses: np.ndarray) -> None:
        """Keep the words used most, of which earlier batches count half as much as the next."""
        kept = np.flatnonzero(np.asarray(pc.less_equal(pc.binary_length(words), STORE_BYTES)))
        if len(kept) > STORE_WORDS:
            kept = np.sort(kept[np.argpartition(-uses[kept], STORE_WORDS)[:STORE_WORDS]])
        self.words, self.ids, self.uses = words.take(pa.array(kept)), ids.take(pa.array(kept)), uses[kept]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's, whose store is bounded, so that it can stay from one partition to the next."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list, pa.LargeStringArray]]:
    """(doc_ids, texts without nulls) of BATCH_BYTES each; a longer text comes alone."""
    most = most or BATCH_BYTES
    ids, texts, total = [], [], 0
    for batch in batches:
        column = pc.fill_null(batch.column(1).cast(TEXT), "")
        ends = np.cumsum(np.append(0, np.asarray(pc.binary_length(column)).astype(np.int64)))
        at = 0
        while at < len(column):
            to = int(np.searchsorted(ends, ends[at] + most - total, side="right")) - 1
            to = max(to, at if texts else at + 1)
            if to > at:
                ids += batch.column(0).slice(at, to - at).to_pylist()
                texts.append(column.slice(at, to - at))
                total, at = total + int(ends[to] - ends[at]), to
            if at < len(column):
                yield ids, pa.concat_arrays(texts)
                ids, texts, total = [], [], 0
    if texts:
        yield ids, pa.concat_arrays(texts)


def _writer(path: str, vocabulary: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        kind = id_type(encode.tokenizer.get_vocab_size(), end_id)
        end = np.array([end_id], dtype=kind).tobytes()
        name, offset, before, n = f"{part:06d}-{uuid.uuid4().hex}", 0, 0, 0
        rec = idx = None
        for ids, texts in _slices(batches):
            if rec is None:
                rec, idx = store.open_output_stream(f"{root}/{name}.rec"), store.open_output_stream(f"{root}/{name}.idx")
            rows, (tokens, starts) = np.zeros(len(ids), INDEX), encode(texts)
            tokens, starts = tokens.astype(kind), starts.tolist()
            for i, doc_id in enumerate(ids):
                framed = frame(tokens[starts[i] : starts[i + 1]].tobytes() + end)
                rows[i] = (offset, 0 if doc_id is None else doc_id, doc_id is None, before)
                rec.write(framed)
                offset += len(framed)
                before += starts[i + 1] - starts[i] + 1
            idx.write(rows.tobytes())
            n += len(ids)
        if rec is not None:
            rec.close()
            idx.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [n], "ids": [before], "bytes": [offset], "kind": [kind]})

    return write


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shards: int | None = None) -> dict:
    """Encode text and write shards in ascending order of doc_id (null first; equal doc_ids by the hash of their text) to the folder path, a URI that all executors share.

    One sort by range on (doc_id, hash of text), so that one repeated doc_id doesn't fill one shard; what comes to the driver is one row per
    shard. Null and empty texts give the end id alone; an empty table, a manifest without shards. Other columns are ignored.
    Returns the manifest.
    """
    spark = docs.sparkSession
    ready(spark)
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards or max(1, shuffle_partitions(spark)), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    written = ordered.mapInArrow(_writer(path, vocabulary, end_id), "part long, name string, docs long, ids long, bytes long, kind string").collect()
    manifest, before = {"end_id": end_id, "shards": []}, 0
    for r in sorted(written, key=lambda r: r.part):
        manifest["shards"].append({"name": r.name, "docs": r.docs, "ids": r.ids, "bytes": r.bytes, "before": before, "kind": r.kind})
        before += r.ids
    with store.open_output_stream(f"{root}/_manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> dict:
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/_manifest.json") as f:
        return json.loads(f.read())


def _index(store: fs.FileSystem, file: str) -> np.ndarray:
    with store.open_input_stream(file) as f:
        return np.frombuffer(f.read(), INDEX)


def _reader(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for shard in batch.to_pylist():
                index = _index(store, f"{root}/{shard['name']}.idx")
                with store.open_input_file(f"{root}/{shard['name']}.rec") as f:
                    at = 0
                    while at < len(index):
                        low = int(index["offset"][at])
                        to = max(at + 1, int(np.searchsorted(index["offset"], low + 8_000_000)))
                        high = int(index["offset"][to]) if to < len(index) else shard["bytes"]
                        f.seek(low)
                        data, rows = f.read(high - low), index[at:to]
                        payloads = [np.frombuffer(unframe(data, int(o) - low), shard["kind"]).astype("<u4").tobytes() for o in rows["offset"]]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(rows["doc_id"].astype(np.int64), mask=rows["null_id"].astype(bool)),
                                pa.array(rows["before"].astype(np.int64) + shard["before"]),
                                pa.array(payloads, pa.binary()),
                            ],
                            names=["doc_id", "start", "ids"],
                        )
                        at = to

    return read


def _shard_rows(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(s["name"], s["before"], s["bytes"], s["kind"]) for s in manifest["shards"]]
    df = spark.createDataFrame(rows, "name string, before long, bytes long, kind string")
    return df.repartition(max(1, len(rows))) if rows else df


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids: binary of little-endian uint32) from the files, each record's checksums verified; one task a shard."""
    ready(spark)
    return _shard_rows(spark, read_manifest(path)).mapInArrow(_reader(path), "doc_id long, start long, ids binary")


def shuffled_records(path: str, seed: int = 0) -> Iterator[tuple[int | None, np.ndarray]]:
    """For a training loop: the records of all shards in a seeded random order, each by one seek through the index."""
    store, root = fs.FileSystem.from_uri(path)
    shards = read_manifest(path)["shards"]
    places = np.concatenate([np.stack([np.full(s["docs"], i), np.arange(s["docs"])], 1) for i, s in enumerate(shards)]) if shards else np.zeros((0, 2), int)
    np.random.default_rng(seed).shuffle(places)
    opened: dict[int, tuple] = {}
    for i, k in places.tolist():
        if i not in opened:
            opened[i] = (_index(store, f"{root}/{shards[i]['name']}.idx"), store.open_input_file(f"{root}/{shards[i]['name']}.rec"))
        index, f = opened[i]
        low, high = int(index["offset"][k]), int(index["offset"][k + 1]) if k + 1 < len(index) else shards[i]["bytes"]
        f.seek(low)
        yield (None if index["null_id"][k] else int(index["doc_id"][k])), np.frombuffer(unframe(f.read(high - low), 0), dtype=shards[i]["kind"]).astype("<u4")


def token_digests(records: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read records."""
    return records.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """op9: all of `documents` written as token shards and read back."""
    return encode_and_read(table(spark, sf_dir, "documents"), vocabulary)


def encode_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    path = work_path(docs.sparkSession, "tokens")
    write_token_shards(docs, path, vocabulary or vocabulary_path())
    return token_digests(read_token_shards(docs.sparkSession, path))
