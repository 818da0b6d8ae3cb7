"""Token-id output: ids of all documents in id order, written as coded blocks, and read back.

Documents are dealt to tasks by ranges of their ids and sorted there; each task turns texts into ids and
fills blocks (`coder`), which end with a document. A file holds the rows (part, block, start, doc_ids,
lengths, payload, checksum): the range's number, the block's number in it, the ids before the block in the range, the
documents with their lengths, and the coded block, and a CRC-32 over all of these, which is compared when a block is read, as is
the sum of lengths with the number of decoded ids. Spark's writer commits the files, so a lost task
leaves nothing behind.

Texts are encoded by the `tokenizers` library. A worker keeps the ids of pieces that it met (at most
`MEMO` of them, by a 64-bit hash): pieces end only between a character that is no white space and a single
space that such a character follows, or between a letter and a mark, or around a single line end, where the byte-level pre-tokenizer
always cuts, so pieces encode alone as they do in their text. Texts with other white space next to a space, or with pieces of more than `LONGEST`
bytes, go to the library whole.

Nulls: a null text is empty and holds its end id only; null ids come first; rows of equal id are ordered by
text. An empty table has no blocks. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bytehash import ranges, sums
from millrace.llm.coder import decode, encode
from millrace.llm.common import documents, materialize, small_batches, texts

END, BLOCK, MEMO, LONGEST = 0, 2**21, 2_000_000, 200
RECENT, ROW = 100_000, 4096

#: White space that isn't ASCII, or that only some count as such.
_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Between a letter (ASCII, or of two bytes from U+00C0) and an ASCII mark but ' and | (of <|endoftext|>) the pre-tokenizer always cuts, too.
_MARK, _LETTER, _SECOND = (
    np.isin(np.arange(256), x) for x in ([*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), 123, 125, 126], [*range(65, 91), *range(97, 123)], [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)])
)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_state: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, with a bounded memory of pieces; one a worker.

    A batch's pieces are found, hashed and looked up as arrays; only pieces not met before go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        names = sorted(self.library.get_vocab().items(), key=lambda x: x[1])
        self.bytes = np.zeros(names[-1][1] + 1, np.int64)  # each character of a byte-level name is one byte
        self.bytes[[i for _, i in names]] = [len(n) for n, _ in names]
        self._forget()

    def _forget(self) -> None:
        """Two sorted tables of (hash, where its ids start, how many), a large and a recent one, and all ids."""
        self.large = self.recent = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _state:
            _state[path] = cls(path)
        return _state[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of each hash; -1 for one not met yet."""
        start, count = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for keys, at, n in (self.large, self.recent):
            if len(keys):
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                on = keys[k] == h
                start[on], count[on] = at[k[on]], n[k[on]]
        return start, count

    def _add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.int32)))
        self.ids[self.used : self.used + len(ids)] = ids
        new = (h, self.used + np.cumsum(count) - count, count)
        self.used += len(ids)

        def both(x: tuple, y: tuple) -> tuple:
            at = np.searchsorted(x[0], y[0])  # both are sorted
            return tuple(np.insert(p, at, q) for p, q in zip(x, y, strict=True))

        self.recent = both(self.recent, new)
        if len(self.recent[0]) > RECENT:
            self.large, self.recent = both(self.large, self.recent), tuple(x[:0] for x in self.recent)

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Pieces that open with a space are encoded in rows, and told apart again by the bytes of their ids."""
        alone = np.array([p[0] != 32 or p[-1] < 33 for p in pieces])
        single = np.flatnonzero(alone)
        if len(single):
            each = [e.ids for e in self.library.encode_batch_fast([pieces[i].decode("utf-8", "surrogatepass") for i in single], add_special_tokens=False)]
            self._add(h[single], np.array(sum(each, []), np.int32), np.array([len(x) for x in each]))
        rest = np.flatnonzero(~alone)
        for r in range(0, len(rest), ROW):
            row = rest[r : r + ROW]
            own = [pieces[i] for i in row]
            ids = np.array(self.library.encode_batch_fast([b"".join(own).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, np.int32)
            ends, size = np.cumsum([len(p) for p in own]), np.cumsum(self.bytes[ids])
            stop = np.searchsorted(size, ends) + 1
            if len(size) < len(own) or not (size[np.minimum(stop, len(size)) - 1] == ends).all():  # ids that aren't spelled by bytes
                each = [self.whole(p.decode("utf-8", "surrogatepass")) for p in own]
                self._add(h[row], np.concatenate(each), np.array([len(x) for x in each]))
            else:
                self._add(h[row], ids, np.diff(stop, prepend=0))

    def __call__(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.int32)
            elif not t.isascii() and _EXOTIC.search(t):
                out[i] = self.whole(t)
            else:
                plain.append(i)
        if not plain:
            return out
        raws = [texts[i].encode("utf-8", "surrogatepass") for i in plain]
        joined = b"\n".join([*raws, b""])
        raw = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raws]) - 1  # of the texts, where a line end stands
        space, white = raw == 32, _WHITE[raw]
        # A space beside white space, or at an end of its text (beside a separator): the text goes to the library whole.
        beside = np.flatnonzero(space & (np.concatenate(([True], white[:-1])) | np.concatenate((white[1:], [True]))))
        awkward = np.zeros(len(plain), bool)
        awkward[np.searchsorted(ends, beside)] = True
        heads = np.concatenate(([0], ends[:-1] + 1))
        cut = space.copy()
        cut[heads] = True
        marks = _MARK[raw]
        cut[1:] |= marks[1:] & _LETTER[raw[:-1]]
        cut[2:] |= marks[2:] & _SECOND[raw[1:-1]] & (raw[:-2] == 0xC3)
        alone = raw == 10  # a line end between two characters that are no white space is a piece of its own
        alone[ends] = False
        alone[1:-1] &= ~white[:-2] & ~white[2:]
        alone[[0, -1]] = False
        cut |= alone
        cut[1:] |= alone[:-1]
        start = np.flatnonzero(cut)
        of = np.searchsorted(ends, start)
        stop = np.append(start[1:], len(raw))
        last = np.append(of[1:] != of[:-1], True)
        stop[last] -= 1
        on = ~awkward[of] & (stop - start <= LONGEST)
        long = np.unique(of[~on & ~awkward[of]])
        awkward[long] = True
        on &= ~awkward[of]
        start, stop, of = start[on], stop[on], of[on]
        h, first, back = np.unique(ranges(sums(raw), start, stop), return_index=True, return_inverse=True)
        if len(self.large[0]) + len(self.recent[0]) + len(h) > MEMO:
            self._forget()
        begin, count = self._known(h)
        new = np.flatnonzero(begin < 0)
        if len(new):
            self._learn(h[new], [joined[a:b] for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
            begin, count = self._known(h)
        begin, count = begin[back], count[back]
        upto = np.cumsum(count)
        flat = self.ids[np.repeat(begin - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate(([0], upto))[np.searchsorted(of, np.arange(len(plain) + 1))]
        for k, i in enumerate(plain):
            out[i] = self.whole(texts[i]) if awkward[k] else flat[bounds[k] : bounds[k + 1]]
        return out


BLOCKS = "part int, block int, start long, doc_ids array<bigint>, lengths array<bigint>, payload binary, checksum long"


def checksum(part: int, number: int, start: int, ids: list, lengths: list, payload: bytes) -> int:
    """CRC-32 of a block's place, documents, lengths and payload; a null id is told from every number."""
    known = np.array([i is not None for i in ids], np.uint8)
    columns = np.array([part, number, start, len(ids), *[i or 0 for i in ids], *lengths], "<i8")
    return zlib.crc32(payload, zlib.crc32(known.tobytes(), zlib.crc32(columns.tobytes())))


def blocks(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """The rows of the token files, one for each block."""
    small_batches(docs.sparkSession, 256)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        ids, parts, size, number, start = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            lengths, payload = [len(p) for p in parts], encode(np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                    pa.array([checksum(part, number, start, ids, lengths, payload)], pa.int64()),
                ],
                ["part", "block", "start", "doc_ids", "lengths", "payload", "checksum"],
            )

        for b in batches:
            for i, own in zip(b.column("doc_id").to_pylist(), encoder.batch([t or "" for t in b.column("text").to_pylist()]), strict=True):
                own = np.append(own, np.int32(END))
                ids.append(i), parts.append(own)
                size += len(own)
                if size >= block:
                    yield flush()
                    ids, parts, start, number, size = [], [], start + size, number + 1, 0
        if parts:
            yield flush()

    return texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(coded, BLOCKS)


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    per_part = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("held"))
    # One row for each range of the write: as many as there are shuffle partitions.
    base = per_part.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, start, ids, lengths, payload, crc in zip(*(b.column(c).to_pylist() for c in ("part", "block", "start", "doc_ids", "lengths", "payload", "checksum")), strict=True):
                if crc != checksum(part, number, start, ids, lengths, payload):
                    raise ValueError(f"token file: block {number} of part {part} was damaged")
                raw = decode(payload).astype("<u4")
                if len(raw) != sum(lengths) or len(ids) != len(lengths):
                    raise ValueError(f"token file: block {number} of part {part} holds {len(raw)} ids, its documents {sum(lengths)}")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(start + ends - np.array(lengths), pa.int64()), pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)], pa.int64()),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(parsed, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    files = materialize(docs.sparkSession, blocks(docs, tokenizer or default_tokenizer(), block), "tokens")
    return read_back(files)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the mixed documents as token files, and what stands in them."""
    return write_and_read(docs)


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    return write_and_read(documents(spark, sf_dir))
