"""Token ids of a corpus in binary files, coded by a static range asymmetric numeral system.

Texts are encoded by a public tokenizer, an end id follows each document, and the ids of all documents, in ascending id order, are one long
stream. Its files are two Parquet tables in one folder, so that Spark's own commit makes them survive a lost executor and any task may read
any part of them:

- ``table``: ``symbol, frequency``, the one frequency table that all blocks share, counted over all ids and scaled to a power of two;
- ``blocks``: a row for each run of at most ``BLOCK`` ids of a shard (a range of documents). ``shard, block, first`` (the place of the first
  id in its shard) are the checkpoint from which it is found and decoded without any other; ``payload`` holds the final states of ``LANES``
  interleaved coders, then the 32-bit words that they gave off, in the order in which a decoder wants them back; ``crc`` is the checksum of its
  ids; ``table_crc`` that of the table; ``segments`` says which parts of which documents its ids are.

A coder's state has 64 bits: with scale ``M = 2^bits`` a symbol of frequency ``f`` and range start ``c`` takes state ``x`` to ``(x // f) M + x % f + c``,
after giving off its low 32 bits where it would outgrow 63. Id ``p`` of a block belongs to lane ``p % LANES``, so numpy codes a step of all lanes
of many blocks at once. Blocks do not know documents: a short one costs nothing extra and a long one spans many blocks; its checksum is put
together from its segments' (CRC-32 is linear), in any order.

Tokenizers that drop white space and never join over it may encode each distinct word once (``by_word``); every task compares a first text with a
plain call of the tokenizer, whole and word by word, and fails where they differ.

Results for odd rows: null and empty texts have only the end id. Rows with one id follow each other in the order of their text hashes; rows that
repeat are documents of their own; null ids come last. An empty table gives empty files. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import pin
from .tokens import slices

BLOCK = 1 << 14
LANES = 64
GROUP = 64
SHARD_IDS = 1 << 23
BITS = 20
# Distinct words whose ids a task keeps, words that are encoded together, and bytes of text in hand.
KNOWN_WORDS = 600_000
WORDS_AT_ONCE = 1 << 14
SLICE_TEXT = 1 << 23

_LETTERS, _TAIL = "abcdefghijklmnopqrstuvwxyz", ".,;:!?"
_LOW = 1 << 31
_BLOCKS = (
    "shard int, block int, first long, n int, payload binary, crc long, table_crc long, "
    "segments array<struct<ordinal:long,doc_id:long,skip:long,length:int,total:long>>"
)


# Tokenizing


class _Words:
    """Ids of words, each encoded once.

    Words that are not known yet are encoded together, as a text of words between blanks. Where the tokenizer is seen to cut full stops,
    commas and the like off the letters before them, they are encoded by themselves. Words of ASCII letters are spared the steps before the
    tokenizer's model where those are seen to do nothing but lower-case such letters and leave them whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.plain = False
        if tokenizer.normalizer and tokenizer.pre_tokenizer and tokenizer.normalizer.normalize_str(_LETTERS.upper()) == _LETTERS:
            whole = tokenizer.pre_tokenizer.pre_tokenize_str(_LETTERS) == [(_LETTERS, (0, len(_LETTERS)))]
            self.plain = whole and all(encode(_LETTERS + t) == [k.id for k in tokenizer.model.tokenize(_LETTERS)] + encode(t) for t in (*_TAIL, _TAIL))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha() and w.isascii() and w.islower()] if self.plain else []
        model = self.tokenizer.model
        ids = [[k.id for k in model.tokenize(w)] for w in letters]
        flats, lengths = [self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)], [self.length, np.fromiter(map(len, ids), np.int32, len(ids))]
        known = set(letters)
        others = [w for w in words if w not in known]
        for at in range(0, len(others), WORDS_AT_ONCE):
            part = others[at : at + WORDS_AT_ONCE]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            of = np.searchsorted(begins, np.array([a for a, _ in found.offsets], np.int64), side="right") - 1
            flats.append(np.array(found.ids, np.uint32))
            lengths.append(np.bincount(of, minlength=len(part)).astype(np.int32))
        self.place.update(zip(letters + others, range(len(self.length), len(self.length) + len(words))))
        self.flat, self.length = np.concatenate(flats), np.concatenate(lengths)
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each of the words are, which are learnt if need be."""
        names = words.to_pylist()
        self._learn([w for w in dict.fromkeys(names) if w not in self.place])
        return np.fromiter(map(self.place.__getitem__, names), np.int32, len(names))

    def _taken(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places end to end, and how many there are of each."""
        counts = self.length[place]
        before = np.cumsum(counts, dtype=np.int32) - counts
        return self.flat[np.repeat(self.start[place] - before, counts) + np.arange(counts.sum(), dtype=np.int32)], counts

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and how many each text has."""
        lists = pc.ascii_split_whitespace(column)
        word = lists.flatten().dictionary_encode()
        codes, names = word.indices.to_numpy(zero_copy_only=False), word.dictionary
        if len(self.place) > KNOWN_WORDS:
            self.forget()
        if self.plain:
            core = pc.utf8_rtrim(names, characters=_TAIL)
            cut = pc.and_(pc.utf8_is_alpha(core), pc.less(pc.binary_length(core), pc.binary_length(names)))
            core = pc.if_else(pc.utf8_is_alpha(core), core, names)
            tail = pc.replace_substring_regex(names.filter(cut), rf"^.*?([{_TAIL}]+)$", r"\1")
            core = pc.if_else(pc.ascii_is_alpha(core), pc.ascii_lower(core), core)
            core, tail = core.dictionary_encode(), tail.dictionary_encode()
            place = self._places(core.dictionary)[core.indices.to_numpy(zero_copy_only=False)]
            tails = self._places(tail.dictionary)[tail.indices.to_numpy(zero_copy_only=False)]
            cut = np.asarray(cut)
            # a word's ids are those of its core, then those of its tail: two places, the second of an empty word where there is none
            both = np.full((len(names), 2), self._places(pa.array([""]))[0], np.int32)
            both[:, 0] = place
            both[cut, 1] = tails
            flat, length = self._taken(both.ravel())
            length = length.reshape(-1, 2).sum(axis=1, dtype=np.int32)
        else:
            flat, length = self._taken(self._places(names))
        start = np.cumsum(length, dtype=np.int32) - length
        counts = length[codes]
        before = np.append(0, np.cumsum(counts, dtype=np.int64))
        ids = flat[np.repeat(start[codes] - before[:-1].astype(np.int32), counts) + np.arange(before[-1], dtype=np.int32)]
        bounds = lists.offsets.to_numpy().astype(np.int64)
        return ids, np.diff(before[bounds - bounds[0]])


def _by_word(tokenizer, text: str, ids: list[int]) -> bool:
    """Whether a text had words to compare; fails where the tokenizer encodes it differently, whole or word by word."""
    words = text.split()[:100]
    alone = sum((e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)), [])
    if tokenizer.encode(text, add_special_tokens=False).ids != ids or tokenizer.encode(" ".join(words), add_special_tokens=False).ids != alone:
        raise ValueError("this tokenizer does not encode word by word: use by_word=False")
    return len(words) > 1


def _text_ids(column: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
    found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
    return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)


def id_type(tokenizer_path: str, end_id: int) -> str:
    """The narrowest type, as numpy names it, that holds every id of the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _encoder(tokenizer_path: str, end_id: int, by_word: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        words = _Words(tokenizer)
        compared = not by_word
        counts = np.zeros(0, np.int64)
        names = ["doc_id", "text_hash", "ids", "symbol", "count"]
        for whole in batches:
            for batch in slices(whole, "text", SLICE_TEXT):
                text = pc.fill_null(batch.column("text"), "")
                ids, length = words.ids(text) if by_word else _text_ids(text, tokenizer)
                if not compared:
                    compared = _by_word(tokenizer, text[0].as_py(), ids[: length[0]].tolist())
                n = batch.num_rows
                at = np.arange(len(ids)) + np.repeat(np.arange(n), length)
                out = np.full(len(ids) + n, end_id, kind)
                out[at] = ids
                found = np.bincount(out)
                counts = np.pad(counts, (0, max(0, len(found) - len(counts))))
                counts[: len(found)] += found
                ends = np.append(0, np.cumsum(length + 1)) * out.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), packed, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
        seen = np.flatnonzero(counts)
        n = len(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=names)

    return run


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, ids`` of every document (ids as little-endian numbers of ``id_type``); then, per task, rows of ``symbol, count``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_encoder(tokenizer_path, end_id, by_word, id_type(tokenizer_path, end_id)), "doc_id long, text_hash long, ids binary, symbol int, count long")
    return pin(out.withColumn("salt", F.monotonically_increasing_id()), "ids", compression="zstd")


# The code


def scaled(counts: dict[int, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols ascending, their frequencies (each at least 1, together ``2^bits``), and ``bits``, more where many symbols need it."""
    symbols = np.array(sorted(counts), np.int64)
    bits = max(bits, int(len(symbols)).bit_length() + 2)
    total, goal = max(1, sum(counts.values())), 1 << bits
    f = np.array([max(1, counts[s] * goal // total) for s in symbols.tolist()], np.int64)
    for i in np.argsort(-f, kind="stable").tolist():
        over = int(f.sum()) - goal
        if over < 0:
            f[i] -= over
        if over <= 0:
            break
        f[i] -= min(over, int(f[i]) // 2)
    return symbols, f, bits


def table_crc(symbols: np.ndarray, f: np.ndarray) -> int:
    return zlib.crc32(np.stack([symbols, f]).astype("<i8").tobytes())


def compress(rank: np.ndarray, n: np.ndarray, f: np.ndarray, bits: int) -> list[bytes]:
    """Payloads of blocks: ``rank[b, p]`` is the place in the table of id ``p`` of block ``b``, which has ``n[b]`` of them."""
    blocks, least = len(rank), int(n.min())
    steps = -(-int(n.max()) // LANES)
    rank = np.pad(rank[:, : steps * LANES], ((0, 0), (0, max(0, steps * LANES - rank.shape[1])))).reshape(blocks, steps, LANES)
    f = f.astype(np.uint64)
    c = np.cumsum(f) - f
    x = np.full((blocks, LANES), _LOW, np.uint64)
    words, gave = np.zeros((blocks, steps, LANES), np.uint32), np.zeros((blocks, steps, LANES), bool)
    place, shift, room, scale = np.arange(LANES), np.uint64(32), np.uint64(63 - bits), np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = rank[:, t]
        fs = f[s]
        out = x >> room >= fs
        whole = (t + 1) * LANES <= least  # every lane of every block has an id
        if not whole:
            here = t * LANES + place < n[:, None]
            out &= here
        gave[:, t] = out
        words[:, t] = x  # its low 32 bits
        y = np.where(out, x >> shift, x)
        q = y // fs
        after = (q << scale) + (y - q * fs) + c[s]
        x = after if whole else np.where(here, after, y)
    return [x[b].astype("<u8").tobytes() + words[b][gave[b]].astype("<u4").tobytes() for b in range(blocks)]


def decompress(payloads: list[bytes], n: np.ndarray, f: np.ndarray, bits: int) -> np.ndarray:
    """The ranks that ``compress`` was given; places beyond a block's ``n`` are 0."""
    blocks, steps, least = len(payloads), -(-int(n.max()) // LANES), int(n.min())
    head = LANES * 8
    x = np.stack([np.frombuffer(p, "<u8", LANES) for p in payloads]).astype(np.uint64)
    words = np.concatenate([*(np.frombuffer(p, "<u4", offset=head) for p in payloads), np.zeros(1, "<u4")]).astype(np.uint64)
    size = np.array([(len(p) - head) // 4 for p in payloads], np.int64)
    at = np.cumsum(size) - size
    rank_of = np.repeat(np.arange(len(f), dtype=np.int32), f)
    f = f.astype(np.uint64)
    c = np.cumsum(f) - f
    out = np.zeros((blocks, steps, LANES), np.int32)
    place, mask, shift = np.arange(LANES), np.uint64((1 << bits) - 1), np.uint64(bits)
    for t in range(steps):
        slot = x & mask
        s = rank_of[slot]
        after = f[s] * (x >> shift) + (slot - c[s])
        if (t + 1) * LANES <= least:  # every lane of every block has an id
            x, low = after, after < np.uint64(_LOW)
        else:
            here = t * LANES + place < n[:, None]
            s, x = np.where(here, s, 0), np.where(here, after, x)
            low = here & (x < np.uint64(_LOW))
        out[:, t] = s
        order = np.cumsum(low, axis=1)
        x = np.where(low, (x << np.uint64(32)) | words[np.minimum(at[:, None] + order - 1, len(words) - 1)], x)
        at = at + order[:, -1]
    return out.reshape(blocks, steps * LANES)


# Checksums of documents from those of their parts

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo CRC-32's, lowest power in the highest bit."""
    product = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            product ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return product


# x to the power 2^k: one for each bit of a number of bits.
_POWERS = [1 << 30]
while len(_POWERS) < 72:
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def moved(crc: int, after: int) -> int:
    """The share of a part's checksum in that of the whole, when ``after`` bytes follow; the shares of all parts, xor-ed, are the whole's."""
    bits, k = 8 * after, 0
    while bits:
        if bits & 1:
            crc = _times(_POWERS[k], crc)
        bits, k = bits >> 1, k + 1
    return crc


# Files


def _writer(table, bits: int, block: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, f = table.value
        rank_of = np.zeros(int(symbols.max(initial=0)) + 1, np.int32)
        rank_of[symbols] = np.arange(len(symbols))
        size = np.dtype(kind).itemsize
        shard, check = TaskContext.get().partitionId(), table_crc(symbols, f)
        width = block * GROUP
        state = {"number": 0, "at": 0, "ordinal": 0}
        held, docs = np.zeros(0, kind), np.zeros((0, 3), np.int64)  # documents: ordinal, first id in the shard, ids
        doc_ids: list[int | None] = []

        def out(ids: np.ndarray) -> pa.RecordBatch:
            count = -(-len(ids) // block)
            n = np.minimum(block, len(ids) - block * np.arange(count))
            rank = np.zeros(count * block, np.int32)
            rank[: len(ids)] = rank_of[ids]
            payload = compress(rank.reshape(count, block), n, f, bits)
            first = state["at"] + block * np.arange(count)
            begin, end = docs[:, 1], docs[:, 1] + docs[:, 2]
            cuts = np.unique(np.concatenate([first, np.clip(begin[begin < state["at"] + len(ids)], state["at"], None)]))
            of_doc, of_block = np.searchsorted(begin, cuts, side="right") - 1, (cuts - state["at"]) // block
            length = np.diff(np.append(cuts, state["at"] + len(ids)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of_block, np.arange(count + 1)).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array(docs[of_doc, 0]), pa.array(doc_ids, pa.int64()).take(pa.array(of_doc)), pa.array(cuts - begin[of_doc]), pa.array(length.astype(np.int32)), pa.array(docs[of_doc, 2])],
                    names=["ordinal", "doc_id", "skip", "length", "total"],
                ),
            )
            number = np.arange(state["number"], state["number"] + count, dtype=np.int32)
            ids = ids.astype("<u4")
            crcs = [zlib.crc32(ids[i * block : i * block + k]) for i, k in enumerate(n.tolist())]
            state["number"] += count
            state["at"] += len(ids)
            keep = np.searchsorted(end, state["at"], side="right")
            del doc_ids[:keep]
            docs_left.append(docs[keep:])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(count, shard, np.int32)), pa.array(number), pa.array(first), pa.array(n.astype(np.int32)), pa.array(payload, pa.binary()),
                    pa.array(np.array(crcs, np.int64)), pa.array(np.full(count, check, np.int64)), lists,
                ],
                names=["shard", "block", "first", "n", "payload", "crc", "table_crc", "segments"],
            )

        docs_left: list[np.ndarray] = []
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary())
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // size
            # rows in pieces of a bounded number of ids, or one row where that has more
            begin = 0
            total = np.append(0, np.cumsum(sizes))
            while begin < len(sizes):
                stop = max(begin + 1, int(np.searchsorted(total, total[begin] + width, side="right")) - 1)
                part = column.slice(begin, stop - begin)
                bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                ids = np.frombuffer(part.buffers()[2], kind, int(bounds[-1] - bounds[0]) // size, int(bounds[0]))
                k = stop - begin
                firsts = state["at"] + len(held) + np.cumsum(sizes[begin:stop]) - sizes[begin:stop]
                docs = np.concatenate([docs, np.stack([state["ordinal"] + np.arange(k), firsts, sizes[begin:stop]], axis=1)])
                doc_ids.extend(batch.column("doc_id").slice(begin, k).to_pylist())
                state["ordinal"] += k
                held = np.concatenate([held, ids])
                while len(held) >= width:
                    yield out(held[:width])
                    held, docs = held[width:], docs_left.pop()
                begin = stop
        if len(held):
            yield out(held)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, by_word: bool = True, block: int = BLOCK, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of all documents into the new folder ``path``; about ``shard_ids`` ids to a shard."""
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer_path, end_id, by_word, id_col, text_col)
    counts = {r.symbol: r.n for r in rows.where("symbol IS NOT NULL").groupBy("symbol").agg(F.sum("count").alias("n")).collect()}
    symbols, f, bits = scaled(counts)
    spark.createDataFrame(list(zip(symbols.tolist(), f.tolist())), "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shards = max(1, -(-sum(counts.values()) // shard_ids))
    order = [F.col("doc_id").asc_nulls_last(), "text_hash", "salt"]
    dealt = rows.where("symbol IS NULL").select("doc_id", "text_hash", "salt", "ids").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    table = spark.sparkContext.broadcast((symbols, f))
    dealt.select("doc_id", "ids").mapInArrow(_writer(table, bits, block, id_type(tokenizer_path, end_id)), _BLOCKS).write.parquet(f"{path}/blocks")


def _reader(table, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, f = table.value
        check, bits = table_crc(symbols, f), int(f.sum()).bit_length() - 1
        symbols32 = symbols.astype("<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP):
                batch = whole.slice(at, GROUP)
                n = batch.column("n").to_numpy().astype(np.int64)
                if set(batch.column("table_crc").to_pylist()) != {check}:
                    raise ValueError("blocks of another frequency table")
                rank = decompress(batch.column("payload").to_pylist(), n, f, bits)
                ids = symbols32[rank]
                for b, crc in enumerate(batch.column("crc").to_pylist()):
                    if zlib.crc32(ids[b, : n[b]]) != crc:
                        raise ValueError(f"checksum of block {batch.column('block')[b]} of shard {batch.column('shard')[b]} differs")
                stream = ids.ravel() if len(n) == 1 or (n[:-1] == ids.shape[1]).all() else np.concatenate([ids[b, :k] for b, k in enumerate(n.tolist())])
                lists = batch.column("segments")
                bounds = lists.offsets.to_numpy()
                part = lists.flatten()
                length, skip, total = (part.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "skip", "total"))
                ends = np.cumsum(length)
                crc = [zlib.crc32(stream[e - k : e]) for e, k in zip(ends.tolist(), length.tolist())]
                rest = total - skip - length
                for i in np.flatnonzero(rest).tolist():
                    crc[i] = moved(crc[i], 4 * int(rest[i]))
                of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
                first = batch.column("first").to_numpy()[np.repeat(np.arange(batch.num_rows), np.diff(bounds))]
                begins = np.cumsum(n) - n
                inside = ends - length - np.repeat(begins, np.diff(bounds))
                columns = [batch.column("shard").take(of), part.field("ordinal"), part.field("doc_id"), pa.array(first + inside - skip), pa.array(skip), pa.array(length), pa.array(total), pa.array(crc, pa.int64())]
                names = ["shard", "ordinal", "doc_id", "begin", "skip", "length", "total", "crc"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(stream[: int(ends[-1]) if len(ends) else 0].astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_segments(spark: SparkSession, path: str, blocks: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """Decode the blocks (all, or those given), each by itself: ``shard, ordinal, doc_id, begin, skip, length, total, crc`` and ``ids`` of
    every part of a document. ``begin`` is the document's first id in its shard, ``crc`` the part's share in the document's checksum."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks") if blocks is None else blocks
    pairs = sorted((r.symbol, r.frequency) for r in spark.read.parquet(f"{path}/table").collect())
    table = spark.sparkContext.broadcast((np.array([s for s, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64)))
    kind = "shard int, ordinal long, doc_id long, begin long, skip long, length long, total long, crc long" + (", ids array<long>" if with_ids else "")
    return blocks.mapInArrow(_reader(table, with_ids), kind)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, offset``: how many ids all shards before it hold, from the checkpoints alone. One row a shard."""
    totals = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """``place, id`` of the ids from ``start`` to before ``end`` of the whole stream; only blocks that hold some of them are decoded."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    offsets = shard_starts(spark, path)
    at = F.col("offset") + F.col("first")
    wanted = blocks.join(offsets, "shard").where((at < end) & (at + F.col("n") > start)).select(*blocks.columns)
    parts = read_segments(spark, path, wanted).join(offsets, "shard").withColumn("at", F.col("offset") + F.col("begin") + F.col("skip"))
    return parts.select("at", F.posexplode("ids").alias("i", "id")).select((F.col("at") + F.col("i")).alias("place"), "id").where((F.col("place") >= start) & (F.col("place") < end))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``. Only documents of several blocks are grouped."""
    parts = pin(read_segments(spark, path, with_ids=False), "segments")
    whole = parts.where("length = total").select("shard", "doc_id", "begin", "total", "crc")
    several = parts.where("length < total").groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("begin").alias("begin"), F.first("total").alias("total"), F.bit_xor("crc").alias("crc"), F.sum("length").alias("held"))
    several = several.select("shard", "doc_id", "begin", "total", F.when(F.col("held") == F.col("total"), F.col("crc")).otherwise(F.raise_error(F.lit("a part of a document is missing")).cast("long")).alias("crc"))
    found = whole.unionByName(several).join(shard_starts(spark, path), "shard")
    return found.select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), F.col("total").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
