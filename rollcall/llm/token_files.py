"""Token ids as fixed-width bit-packed shards, with numpy unpacking and random access.

A shard is a table of chunks written by Spark (so it commits whole on any store). A chunk holds
the ids of consecutive documents: a header, the byte offset of every block, then blocks of
BLOCK ids, each id in as few bits as the vocabulary needs, lowest bits first, each block from a
full byte on. Documents are in ascending order of id across the whole dataset.

Defined results: a null text is empty and holds the end id alone; a null doc_id sorts first;
documents repeated in full are written as often as they come, equal ids in order of text.
An empty table gives no chunks.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.common import stored

END_ID = 0
BLOCK = 1024
HEADER = "<4sBxxxIQ"  # magic, bits, ids a block, ids
MAGIC = b"BPK1"
# Ids after which a chunk is closed; a longer document makes a longer chunk.
CHUNK_IDS = 1 << 18
# A worker's memo of encoded words is emptied at this size; only speed depends on it.
MEMO_WORDS, MEMO_CHARS = 800_000, 64
RANGE_CHARS = 24  # of a text that Spark's sample of the ranges holds
GROUP_CHARS = 4_000_000  # texts that are encoded together; a longer text alone
SPACE = "\u0120"  # how byte-level vocabularies write a space
WORD_AND_TAIL = re.compile(r"([^\W\d_]+)((?:[.,;:!?)]+\n?|\n)[^\W\d_]*)")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}  # widths that numpy stores as they are


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    n = len(ids)
    lanes = np.zeros((-(-n // 8), 8), dtype=np.uint64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((len(lanes), bits), dtype=np.uint8)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        moved = lanes[:, j] << np.uint64(shift)
        for k in range(first, (j * bits + bits - 1) // 8 + 1):
            out[:, k] |= (moved >> np.uint64(8 * (k - first))).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack_block(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], n).astype(np.uint32)
    rows = -(-n // 8)
    raw = np.zeros(rows * bits, dtype=np.uint8)
    raw[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    raw = raw.reshape(rows, bits).astype(np.uint64)
    out = np.zeros((rows, 8), dtype=np.uint64)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        for k in range(first, (j * bits + bits - 1) // 8 + 1):
            out[:, j] |= raw[:, k] << np.uint64(8 * (k - first))
        out[:, j] >>= np.uint64(shift)
    return (out.reshape(-1)[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


def pack_ids(ids: np.ndarray, vocabulary: int) -> bytes:
    """One chunk: header, block offsets, blocks."""
    bits, n = bits_for(vocabulary), len(ids)
    count, whole = -(-n // BLOCK), BLOCK * bits // 8
    offsets = np.arange(count, dtype="<u8") * whole + (struct.calcsize(HEADER) + 8 * count)
    # BLOCK is a multiple of eight, so full blocks end on a byte and are packed in one go.
    return struct.pack(HEADER, MAGIC, bits, BLOCK, n) + offsets.tobytes() + pack_block(ids, bits)


def unpack_ids(chunk: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """Ids [start, end) of a chunk; reads the blocks they are in, and no others."""
    magic, bits, per, n = struct.unpack_from(HEADER, chunk)
    if magic != MAGIC:
        raise ValueError("not a chunk of packed ids")
    end = n if end is None else min(end, n)
    if end <= start:
        return np.zeros(0, dtype=np.uint32)
    count, first, last = -(-n // per), start // per, (end - 1) // per
    offsets = np.frombuffer(chunk, "<u8", count, struct.calcsize(HEADER))
    stop = len(chunk) if last + 1 == count else int(offsets[last + 1])
    ids = unpack_block(chunk[int(offsets[first]) : stop], min(n, (last + 1) * per) - first * per, bits)
    return ids[start - first * per : end - first * per]


def _encoder(path: str) -> dict:
    """The tokenizer of a file, which ids start with a space, its added tokens, and the memos of words and of what follows them; one per worker process."""
    held = sys.modules.setdefault("_token_files_state", types.ModuleType("_token_files_state")).__dict__
    if path not in held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spaced = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=bool)
        spaced[[i for t, i in tokenizer.get_vocab().items() if t.startswith(SPACE)]] = True
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        held[path] = {"tokenizer": tokenizer, "spaced": spaced, "added": added, "memo": {}, "tails": {}}
    return held[path]


def encode_words(words: list[str], state: dict) -> list[bytes]:
    """The ids of each word behind a space, in one call: every id that starts with a space starts a word."""
    ids = np.array(state["tokenizer"].encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
    at = np.flatnonzero(state["spaced"][ids]) * 4
    data = ids.tobytes()
    return list(map(data.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), len(data)])))


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each whole text as little-endian unsigned 32-bit integers.

    A single space between two characters that are not white space always starts a new
    token, and so does the end of a run of letters before a mark or a line break. There a
    text is cut, and each piece is encoded once and looked up after that. Texts with a
    space beside other white space are encoded in one piece, and so are texts that hold the string of an added token.
    """
    state = _encoder(path)
    encode, memo, tails = state["tokenizer"].encode_batch_fast, state["memo"], state["tails"]

    def ids_of(strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encode(strings, add_special_tokens=False)]

    if len(memo) + len(tails) > MEMO_WORDS:
        memo.clear()
        tails.clear()
    # After the first, words stand behind a space; the memo's keys leave it out. Each word of all texts is looked up once.
    cut = [t.split(" ") for t in texts]
    heads = [ws.pop(0) for ws in cut]
    place: dict[str, int] = defaultdict()
    place.default_factory = place.__len__
    counts = np.array([len(ws) for ws in cut], dtype=np.int64)
    said = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
    words = list(place)
    parts = list(map(memo.get, words))
    new = set(compress(words, map(is_, parts, repeat(None))))
    odd = [w for w in new if not w.isalpha()]
    beside = {w for w in odd if not w or w[0].isspace() or w[-1].isspace()}
    ended = [m.groups() for m in map(WORD_AND_TAIL.fullmatch, odd) if m and m.group() not in beside]
    new.difference_update(beside)
    new.difference_update([a + b for a, b in ended])
    new.update([a for a, _ in ended if a not in memo])
    tail_new = list({b for _, b in ended}.difference(tails))
    tails.update(zip(tail_new, ids_of(tail_new)))
    marked = {i for i, t in enumerate(texts) if any(a in t for a in state["added"])}
    # A word with the string of an added token stands in texts that are encoded whole, and is no word of its own.
    plain = [w for w in new if not any(a in w for a in state["added"])] if marked else list(new)
    if plain:
        memo.update(zip(plain, encode_words(plain, state)))
    memo.update([(a + b, memo[a] + tails[b]) for a, b in ended])
    whole = {i for i, h in enumerate(heads) if (not h and cut[i]) or h[-1:].isspace()} | marked
    if beside:
        in_text, odd_one = np.repeat(np.arange(len(texts)), counts), np.fromiter((w in beside for w in words), bool, len(words))
        whole.update(in_text[odd_one[said]].tolist())
    direct, first = dict(zip(sorted(whole), ids_of([texts[i] for i in sorted(whole)]))), ids_of(heads)
    # The ids of all words in a row, then those of every word that is said.
    parts = [memo.get(w, b"") if x is None else x for w, x in zip(words, parts)]
    flat, sizes = np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts, each = (np.cumsum(sizes) - sizes)[said], sizes[said]
    ends = np.cumsum(each)
    data = flat[np.repeat(starts - (ends - each), each) + np.arange(int(each.sum()))].tobytes()
    cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))] * 4
    for w in plain:
        if len(w) > MEMO_CHARS:
            del memo[w]
    return [direct[i] if i in whole else first[i] + data[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]


def vocabulary_size(path: str) -> int:
    return _encoder(path)["tokenizer"].get_vocab_size()


def write(docs: DataFrame, path: str, name: str = "tokens") -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the chunks in order of doc_id, and return the written table.

    Columns: part and base (which place the chunk), doc_ids, counts, data.
    """
    vocabulary = vocabulary_size(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, base, ids, docs = TaskContext.get().partitionId(), 0, [], []
        held = 0

        def chunk() -> pd.DataFrame:
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            return pd.DataFrame(
                {"part": [part], "base": [base], "doc_ids": [list(docs)], "counts": [[len(x) // 4 for x in ids]], "data": [pack_ids(flat, vocabulary)]}
            )

        end = struct.pack("<I", END_ID)
        for batch in batches:
            texts = batch["text"].tolist()
            # Small groups, so that what is held beside the batch stays small too.
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and chars < GROUP_CHARS:
                    chars += len(texts[to])
                    to += 1
                for doc_id, got in zip(batch["doc_id"].iloc[at:to], encode_texts(texts[at:to], path)):
                    ids.append(got + end)
                    docs.append(None if pd.isna(doc_id) else int(doc_id))
                    held += len(got) // 4 + 1
                    if held >= CHUNK_IDS:
                        yield chunk()
                        base, ids, docs, held = base + held, [], [], 0
                at = to
        if ids:
            yield chunk()

    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        # By the text's beginning too, so that rows that share an id, or have none, do not all go to one task.
        .repartitionByRange("doc_id", F.left("text", F.lit(RANGE_CHARS)))
        .sortWithinPartitions("doc_id", "text")
    )
    return stored(ordered.mapInPandas(run, "part int, base long, doc_ids array<long>, counts array<int>, data binary"), name)


def read(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in written chunks, in no order."""
    # One row per written part; a part is a task's share, so this is bounded by the number of tasks.
    totals = chunks.groupBy("part").agg(F.max(F.col("base") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        before[part] = at
        at += n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, base, doc_ids, counts, data in batch.itertuples(index=False):
                counts = np.asarray(counts, dtype=np.int64)
                ends = np.cumsum(counts)
                ids = unpack_ids(data).astype("<u4")
                crc = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts, ends)]
                yield pd.DataFrame(
                    {"doc_id": pd.array(list(doc_ids), dtype="Int64"), "start": before[part] + base + ends - counts, "n_tokens": counts, "ids_crc32": crc}
                )

    return chunks.select("part", "base", "doc_ids", "counts", "data").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
