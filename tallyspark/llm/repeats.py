"""Repeated byte strings across documents by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. Sorting every suffix of the corpus is
not needed for that; buckets are refined only where they can still matter:

1. Texts are packed, compressed, into batches of a few MB. In each, the smallest of the ``q``-grams of every ``length``-byte string
   is its anchor, so equal strings have equal anchors. Anchors with equal q-grams form the initial buckets.
2. Buckets that only one document enters are dropped. Of the rest, every distinct context of an anchor (the bytes from which strings
   over it can be cut) goes on once per batch, for the smallest id that has it; its other holders are settled on the spot.
3. Buckets are refined: contexts are ranked by their 8-byte pieces, and the rank of a longer piece comes from the pair of ranks of
   its halves, the second read at the later offset, up to the whole string. In each final bucket all but the smallest id repeat.
4. The settled ranges return to their batches and are cut out.

What travels for one bucket is bounded by the number of batches, not of documents: a passage that a third of all documents share is
first combined inside each batch. The ranks of step 3 are exact. Initial buckets and equal contexts inside one bucket are told apart by
64-bit hashes.

Results for odd rows: null texts are empty; texts shorter than ``length`` lose nothing; rows that repeat an id are no smaller than each
other, so neither removes from the other; a row with a null id neither loses bytes nor makes others lose them. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import pin
from .tokens import SLICE_BYTES, odd_constants, slices, splitmix, utf8

LENGTH = 50
Q = 20
# Text whose anchors one task of the refinement gets, about.
PART_BYTES = 1 << 22

_PACKED = "batch string, n_bytes long, ids binary, offsets binary, texts binary"


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, np.uint8, n, at + 8).view(kind))
        at += 8 + n
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as batches; a flag tells which ids are known."""
    from uuid import uuid4

    for whole in batches:
        for batch in slices(whole, "text", 2 * SLICE_BYTES):
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid4().hex]), pa.array([len(data)], pa.int64()), pa.array([pack(numbers, known.astype(np.uint8))], pa.binary()),
                    pa.array([pack(offsets.astype(np.int64))], pa.binary()), pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary()),
                ],
                names=["batch", "n_bytes", "ids", "offsets", "texts"],
            )


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids and whether each id is known."""
    ids, known = unpack(row["ids"], np.int64, np.uint8)
    (offsets,) = unpack(row["offsets"], np.int64)
    return np.frombuffer(zstandard.decompress(row["texts"]), np.uint8), offsets, ids, known.astype(bool)


def anchors(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Anchors of all ``length``-byte strings that stay inside one text with a known id: place, hash of the q-gram there, and how many bytes
    before and after it the strings reach whose anchor it is."""
    none = np.zeros(0, np.int64)
    n = len(data) - q + 1
    if len(data) < length:
        return none, none.view(np.uint64), none, none
    factors = odd_constants(8, 23)
    grams, size, k = odd_constants(256, 29)[data], 1, 0
    while 2 * size <= q:  # the hash of a longer piece from those of its halves
        grams = grams[: len(grams) - size] * factors[k] + grams[size:]
        size, k = 2 * size, k + 1
    if size < q:
        rest = q - size
        grams = grams[: len(grams) - rest] * factors[k] + grams[rest:]
    grams = splitmix(grams)
    # the smallest hash of every window of q-grams, leftmost of equals: hash above, place below
    bits = np.uint64(31)
    least = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
    width, size = length - q + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < width:
        rest = width - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
    ends = np.zeros(len(data) + 1, np.int32)
    np.add.at(ends, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(ends, offsets[1:], -1)
    inside = np.cumsum(ends[:-1]) == 0
    if not known.all():
        inside &= np.repeat(known, np.diff(offsets))
    start = np.flatnonzero(inside[: len(least)])
    if not len(start):
        return none, none.view(np.uint64), none, none
    chosen = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.append(True, np.diff(chosen) != 0))
    places, last = chosen[head], np.append(head[1:], len(start)) - 1
    return places, grams[places], places - start[head], start[last] + length - places - q


def _requests(length: int, q: int, parts: int, bits: int):
    """Of each batch the distinct q-grams of its anchors, cut to so many bits and dealt to parts; a flag where several ids have one.

    Two q-grams that fall together are kept when neither repeats; that costs work and changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                data, offsets, ids, known = _opened(row)
                places, grams, _, _ = anchors(data, offsets, known, length, q)
                grams = grams >> np.uint64(64 - bits)
                holders = ids[np.searchsorted(offsets, places, side="right") - 1]
                order = np.argsort(grams, kind="stable")
                grams, holders = grams[order], holders[order]
                head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
                several = np.maximum.reduceat(holders, head) != np.minimum.reduceat(holders, head) if len(head) else np.zeros(0, bool)
                grams = grams[head]
                for part, at in _dealt(grams, parts):
                    yield _row(part, row["batch"], pack(_steps(grams[at] // np.uint64(parts)), several[at].astype(np.uint8)))

    return run


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, byte planes apart: what they share packs away."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)


def _summed(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _dealt(grams: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    part = (grams % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(bounds, np.append(bounds[1:], len(order))):
        yield int(part[order[a]]), order[a:b]


def _row(part: int, batch: str, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([batch]), pa.array([blob], pa.binary())], names=["part", "batch", "blob"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str, bytes]]]:
    """The rows of one part after another; the input is sorted by part."""
    held, at = [], None
    for whole in batches:
        for row in whole.to_pylist():
            if at is not None and row["part"] != at:
                yield held
                held = []
            at = row["part"]
            held.append((row["part"], row["batch"], row["blob"]))
    if held:
        yield held


def _repeated(parts: int):
    """Back to each batch: those of its q-grams that another batch has too, or several of its own ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            each = [unpack(blob, np.uint8, np.uint8) for _, _, blob in held]
            grams = [_summed(x[0]) for x in each]
            every = np.sort(np.concatenate(grams))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            several = np.unique(np.concatenate([g[x[1] > 0] for g, x in zip(grams, each)]))
            many = np.union1d(twice, several)
            for (part, batch, _), own in zip(held, grams):
                found = own[_among(own, many)]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([pack(np.array([part]), _steps(found))], pa.binary())], names=["batch", "blob"])

    return run


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """A batch of texts with all answers to it; the input is sorted so that the answers come first."""
    answers: list[bytes] = []
    at = None
    for whole in batches:
        for row in whole.to_pylist():
            if row["batch"] != at:
                answers, at = [], row["batch"]
            if row["texts"] is None:
                answers.append(row["blob"])
            else:
                yield row, answers
                answers = []


def _contexts(length: int, q: int, parts: int, bits: int):
    """Of the anchors in repeated buckets every distinct context, for the smallest id; other holders' ranges are settled.

    A context is what the strings of an anchor hold before and after its q-gram, which all of the bucket share.
    """
    side = length - q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in _joined(batches):
            if not answers:
                continue
            data, offsets, ids, known = _opened(row)
            found = []
            for a in answers:
                part, planes = unpack(a, np.int64, np.uint8)
                found.append(_summed(planes) * np.uint64(parts) + np.uint64(part[0]))
            places, grams, left, right = anchors(data, offsets, known, length, q)
            pick = _among(grams >> np.uint64(64 - bits), np.sort(np.concatenate(found)))
            places, grams, left, right = places[pick], grams[pick], left[pick], right[pick]
            doc = np.searchsorted(offsets, places, side="right") - 1
            around = np.concatenate([np.arange(-side, 0), np.arange(q, length)])
            index = places[:, None] + around
            inside = (around >= -left[:, None]) & (around < (q + right)[:, None])
            text = np.where(inside, data[np.clip(index, 0, len(data) - 1)], 0).astype(np.uint8)
            full = np.concatenate([text, np.stack([left, right], axis=1).astype(np.uint8)], axis=1)
            key = splitmix(_fingerprints(full) ^ grams)
            holder = ids[doc]
            order = np.lexsort((holder, key))
            head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(order)])
            least = np.repeat(holder[order][head], np.diff(np.append(head, len(order)))) if len(head) else np.zeros(0, np.int64)
            settled = order[holder[order] > least]
            low = places - offsets[doc]
            if len(settled):
                yield _row(-1 - int(row["batch"][:6], 16) % parts, row["batch"], _ranges(doc[settled], (low - left)[settled], (low + q + right)[settled]))
            still = order[holder[order] == least]
            still = still[np.argsort(grams[still], kind="stable")]
            for part, pick in _dealt(grams[still], parts):
                pick = still[pick]
                docs, which = np.unique(doc[pick], return_inverse=True)
                yield _row(part, row["batch"], pack(_steps(grams[pick]), docs.astype(np.int32), ids[docs], which.astype(np.int32), low[pick].astype(np.int32), full[pick, -2:], text[pick][inside[pick]]))

    return run


def _ranges(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    order = np.lexsort((begin, doc))
    return pack(doc[order].astype(np.int32), begin[order].astype(np.int64), end[order].astype(np.int64))


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(values.shape).astype(np.uint64)


def refined(text: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of all ``length``-byte strings in the rows of ``text``: equal numbers, equal strings.

    Pieces of 1, 2, 4 and 8 bytes are their own numbers; the rank of a longer piece is that of the pair of its first part's rank here
    and its second part's rank at the later offset.
    """
    pieces = {1: text.astype(np.uint64)}
    size = 1
    while 2 * size <= length:
        here = pieces[size]
        bits = np.uint64(8 * size if size <= 4 else 32)
        pair = here[:, : here.shape[1] - size] << bits | here[:, size:]
        pieces[2 * size] = pair if size < 4 else _ranks(pair)
        size *= 2
    total, done = pieces[size], size
    while done < length:
        size = 1 << ((length - done).bit_length() - 1)
        width = text.shape[1] - done - size + 1
        total = _ranks(total[:, :width] << np.uint64(32) | pieces[size][:, done : done + width])
        done += size
    return total


def _fingerprints(rows: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    parts = splitmix(padded.view(np.uint64).ravel()).reshape(len(rows), -1)
    return splitmix((parts * odd_constants(parts.shape[1], 31)).sum(axis=1, dtype=np.uint64))


def _settle(length: int, q: int):
    """Refines the buckets of a part; ranges that a smaller id has too go back to their batches."""
    side = length - q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for held in _passing(batches, passed):
            yield from passed
            passed.clear()
            each = [unpack(blob, np.uint8, np.int32, np.int64, np.int32, np.int32, np.uint8, np.uint8) for _, _, blob in held]
            grams = np.concatenate([_summed(x[0]) for x in each])
            doc = np.concatenate([x[1][x[3]] for x in each])
            holder = np.concatenate([x[2][x[3]] for x in each])
            place = np.concatenate([x[4] for x in each]).astype(np.int64)
            reach = np.concatenate([x[5].reshape(-1, 2) for x in each])
            left, right = reach[:, 0].astype(np.int64), reach[:, 1].astype(np.int64)
            full = np.zeros((len(grams), 2 * side + 2), np.uint8)
            full[:, -2:] = reach
            column = np.arange(2 * side)
            full[:, :-2][(column >= side - left[:, None]) & (column < side + right[:, None])] = np.concatenate([x[6] for x in each])
            source = np.repeat(np.arange(len(each)), [len(x[3]) for x in each])
            key = _fingerprints(full)
            order = np.lexsort((holder, key, grams))
            first = np.append(True, (grams[order][1:] != grams[order][:-1]) | (key[order][1:] != key[order][:-1]))
            head = np.flatnonzero(first)
            context = np.empty(len(grams), np.int64)
            context[order] = np.cumsum(first) - 1
            owner = holder[order[head]]  # of each distinct context the smallest id
            whole = holder > owner[context]
            low = np.where(whole, place - left, 0)
            high = np.where(whole, place + q + right, 0)
            bucket = np.cumsum(np.append(True, grams[order[head]][1:] != grams[order[head]][:-1])) - 1
            begin = np.full(len(head), -1, np.int64)
            end = np.full(len(head), -1, np.int64)
            for pick in _blocks(np.flatnonzero(np.bincount(bucket)[bucket] > 1), bucket, 1 << 14):
                rep = order[head[pick]]
                hit, at = _hits(full[rep, :-2], left[rep], right[rep], bucket[pick], owner[pick], side)
                start = np.full(len(pick), 1 << 30, np.int64)
                stop = np.full(len(pick), -1, np.int64)
                np.minimum.at(start, hit, at)
                np.maximum.at(stop, hit, at)
                some = stop >= 0
                begin[pick[some]], end[pick[some]] = start[some] - side, stop[some] - side + length
            part = ~whole & (end[context] > 0)
            low[part], high[part] = (place + begin[context])[part], (place + end[context])[part]
            found = np.flatnonzero(high > low)
            bounds = np.searchsorted(source[found], np.arange(len(held) + 1))
            for i, (_, batch, _) in enumerate(held):
                pick = found[bounds[i] : bounds[i + 1]]
                if len(pick):
                    yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([_ranges(doc[pick], low[pick], high[pick])], pa.binary())], names=["batch", "blob"])
        yield from passed

    return run


def _hits(text: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: np.ndarray, owner: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and offsets of the strings that a smaller id of the same bucket has too; all hits of one context overlap."""
    ranks = refined(text, side)
    offset = np.arange(side + 1)
    rows, cols = np.nonzero((offset >= side - left[:, None]) & (offset <= right[:, None]))
    number = ranks[rows, cols] << np.uint64(16) | cols.astype(np.uint64)
    inside, who = bucket[rows], owner[rows]
    order = np.lexsort((who, number, inside))
    new = np.append(True, (number[order][1:] != number[order][:-1]) | (inside[order][1:] != inside[order][:-1]))[: len(order)]
    head = np.flatnonzero(new)
    least = np.repeat(who[order][head], np.diff(np.append(head, len(order)))) if len(head) else np.zeros(0, np.int64)
    hit = order[who[order] > least]
    return rows[hit], cols[hit]


def _passing(batches: Iterator[pa.RecordBatch], passed: list) -> Iterator[list[tuple[int, str, bytes]]]:
    """Parts of the refinement; rows that are settled already are put aside to be handed on."""

    def rest() -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = whole.to_pylist()
            for r in rows:
                if r["part"] < 0:
                    passed.append(pa.RecordBatch.from_arrays([pa.array([r["batch"]]), pa.array([r["blob"]], pa.binary())], names=["batch", "blob"]))
            yield pa.RecordBatch.from_pylist([r for r in rows if r["part"] >= 0], schema=whole.schema)

    yield from _by_part(rest())


def _blocks(chosen: np.ndarray, bucket: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Runs of whole buckets, of about ``size`` contexts."""
    begin = 0
    while begin < len(chosen):
        end = min(begin + size, len(chosen))
        end = int(np.searchsorted(bucket[chosen], bucket[chosen[end - 1]], side="right"))
        yield chosen[begin:end]
        begin = end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, answers in _joined(batches):
        data, offsets, ids, known = _opened(row)
        change = np.zeros(len(data) + 1, np.int32)
        for a in answers:
            doc, begin, end = unpack(a, np.int32, np.int64, np.int64)
            np.add.at(change, offsets[doc] + begin, 1)
            np.add.at(change, offsets[doc] + end, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
            kept.append(data[a:b][~g].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=~known), pa.array(np.diff(offsets), pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "removed", "kept"],
        )


def without_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, removed`` (array of byte ranges, end exclusive), ``kept`` (the remaining bytes)."""
    if not q < length < q + 200:
        raise ValueError("length must be above q and below q + 200")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = pin(rows.mapInArrow(_packed, _PACKED), "texts")
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(8, -(-total // part_bytes))
    bits = min(64, max(32, total.bit_length() + 6))  # enough that few q-grams fall together by chance
    blank = [F.lit(None).cast("binary").alias(c) for c in ("ids", "offsets", "texts")]

    def with_answers(answers: DataFrame) -> DataFrame:
        answers = answers.select("batch", *blank, "blob")
        both = answers.unionByName(texts.select("batch", "ids", "offsets", "texts", F.lit(None).cast("binary").alias("blob")))
        return both.repartition("batch").sortWithinPartitions("batch", F.col("texts").isNotNull())

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition("part").sortWithinPartitions("part")

    dealt = "part long, batch string, blob binary"
    repeated = by_part(texts.mapInArrow(_requests(length, q, parts, bits), dealt)).mapInArrow(_repeated(parts), "batch string, blob binary")
    contexts = with_answers(repeated).mapInArrow(_contexts(length, q, parts, bits), dealt)
    settled = by_part(contexts).mapInArrow(_settle(length, q), "batch string, blob binary")
    return with_answers(settled).mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
