"""Vector bin packing of tokenised examples into sequences of bounded tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_schema, give_back, plain, slices

END = 1
#: Bytes of a cache entry beside its two texts; of text that is tokenised at a time; of ids that wait for output.
ENTRY, SLICE, READY = 180, 2 << 20, 4 << 20


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most. ``loss`` counts the tokens that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


# The form of the vocabulary whose texts ``ChunkTokenizer`` cuts itself.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
)


class ChunkTokenizer:
    """Token ids of whole texts as little-endian bytes; pieces encoded before are looked up in ``kept`` bytes of cache.

    The vocabulary never merges across a space or a line end, so a text's ids are those of its chunks in order,
    and a chunk's ids are those of the pieces that the vocabulary's own pattern cuts. Chunks of characters below
    U+0180, where lower-casing and normal form are plain, are cut here and go to the model piece by piece; any
    other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, *, kept: int = 64 << 20, longest: int = 64) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        marked = all("<|" in token["content"] for token in form["added_tokens"])
        #: Whether texts can be cut here; a vocabulary of any other form goes through its own tokenizer whole.
        self.cuts = marked and (form["normalizer"], form["pre_tokenizer"], form["post_processor"]) == FORM
        self.tokenizer, self.kept, self.longest = Tokenizer.from_file(path), kept, longest
        self.model = self.tokenizer.model
        self.cut = regex.compile(PATTERN).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        # Two generations: when the young one is full it becomes the old one, and what is still used moves over.
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        #: Whole chunks beside them, dropped all at once.
        self.chunks: dict[str, bytes] = {}
        self.seen = 0

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is not None:
                self._keep(piece, got)
                return got
            shown = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode()))
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(piece) <= self.longest:
                self._keep(piece, got)
        return got

    def _keep(self, piece: str, got: bytes) -> None:
        self.pieces[piece] = got
        self.held += ENTRY + len(piece) + len(got)
        if self.held > self.kept // 2:
            self.old, self.pieces, self.held = self.pieces, {}, 0

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < "\u0180" and "\u0130" not in chunk:
            low = chunk.lower()
            if low.isalpha():
                return self._piece(low)
            core = low.rstrip(".,;:!?$%&*#")
            if core.isalpha() and "'" not in low:
                return self._piece(core) + self._piece(low[len(core) :])
            if low.isprintable() and "<|" not in low:
                return b"".join(map(self._piece, self.cut(low)))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _folded(text: str) -> str:
        """Lower case at once where that cannot differ from what the tokenizer does."""
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def forget(self) -> None:
        """Give the cached pieces back, so that an idle worker process holds the vocabulary only."""
        self.pieces, self.old, self.chunks, self.held, self.seen = {}, {}, {}, 0, 0

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        split = [self._folded(t).replace("\n", " ").split(" ") for t in texts]
        known = self.chunks
        new = set(chain.from_iterable(split)).difference(known)
        known.update(zip(new, map(self._chunk, new)))
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") for own in split]
        self.seen += sum(map(len, new)) + ENTRY * len(new)
        if self.seen > self.kept // 2:
            self.chunks, self.seen = {}, 0
        return out


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each worker process, kept across tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Fills one sequence after another from a bounded pool of waiting pieces.

    The next piece is the fitting one with the largest dot product of its demand and what the sequence has
    left, both as shares of the limits. When none fits whole, the best one is cut to what is left. A sequence
    that cannot be filled is given out as runs whose lengths are powers of two, which need no padding.
    """

    def __init__(self, limits: Limits, pool: int = 512) -> None:
        self.limits, self.pool, self.sequences = limits, pool, 0
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.items: list[tuple] = []
        self.demand = np.zeros((0, 3))

    def cut(self, ids: np.ndarray, free: int, tokens: int, loss: int) -> int:
        """Length of the longest prefix within ``tokens`` and ``loss``; the first ``free`` ids bear no loss."""
        return min(len(ids), tokens, free + loss)

    def add(self, doc: object, ids: np.ndarray, free: int) -> Iterator[tuple]:
        """Rows (doc, start, ids, loss, doc_tokens, sequence, offset) that are final after this example."""
        at, total = 0, len(ids)
        while total - at >= self.limits.tokens or total - at - max(0, free - at) > self.limits.loss:
            n = self.cut(ids[at:], max(0, free - at), self.limits.tokens, self.limits.loss)
            yield from self.close([(doc, at, ids[at : at + n], max(0, free - at), total)])
            at += n
        if at < total:
            self.items.append((doc, at, ids[at:], max(0, free - at), total))
            if len(self.items) >= 2 * self.pool:
                yield from self.drain(self.pool)

    def drain(self, keep: int = 0) -> Iterator[tuple]:
        """Build sequences until ``keep`` pieces wait."""
        items = self.items
        need = np.array([[len(i[2]), 1, max(0, len(i[2]) - i[3])] for i in items], float).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        left = len(items)
        while left > keep:
            room, held = self.cap.copy(), []
            while room[0] > 0 and room[1] > 0 and left:
                score = np.where(alive, (need / self.cap) @ (room / self.cap), -1.0)
                fits = (need <= room).all(axis=1)
                whole = np.where(fits, score, -1.0)
                best = int(whole.argmax())
                if whole[best] < 0:
                    best = int(score.argmax())
                    doc, at, ids, free, total = items[best]
                    n = self.cut(ids, free, int(room[0]), int(room[2]))
                    if n <= 0:
                        break
                    held.append((doc, at, ids[:n], free, total))
                    items[best] = (doc, at + n, ids[n:], max(0, free - n), total)
                    used = max(0, n - free)
                    need[best] = [len(ids) - n, 1, max(0, len(ids) - n - max(0, free - n))]
                    room -= [n, 1, used]
                else:
                    held.append(items[best])
                    room -= need[best]
                    alive[best], left = False, left - 1
            yield from self.close(held)
        self.items = [i for i, a in zip(items, alive) if a]

    def close(self, held: list[tuple]) -> Iterator[tuple]:
        """Number a sequence; one that is not full is split at powers of two."""
        total = sum(len(i[2]) for i in held)
        sizes = [total] if total == self.limits.tokens else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        held, size = held[::-1], 0
        for size in sizes:
            offset = 0
            while offset < size:
                doc, at, ids, free, n = held.pop()
                k = min(len(ids), size - offset)
                if k < len(ids):
                    held.append((doc, at + k, ids[k:], max(0, free - k), n))
                yield doc, at, ids[:k], max(0, k - free), n, self.sequences, offset
                offset += k
            self.sequences += 1


def pack_documents(
    docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), *, id_col: str = "doc_id", text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), loss_tokens, doc_tokens,
    sequence_id, offset.

    An example is its prompt's ids (which bear no loss), its text's ids and the end id. Every task packs the rows
    it reads, so nothing is shuffled and no limit depends on other tasks; the number of a sequence starts with the
    number of its task. A null or empty text is the end id alone. Repeated rows are packed as often as they come;
    an empty table gives no rows; columns not named are ignored.
    """
    rows = plain(docs, id_col, text_col, **({"prompt": prompt_col} if prompt_col else {}))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start bigint, length bigint, ids binary, loss_tokens bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        packer, encode = Packer(limits), tokenizer(tokenizer_path)

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            doc, at, ids, loss, total, sequence, offset = zip(*pieces)
            columns = [doc, at, [len(i) for i in ids], [i.tobytes() for i in ids], loss, total, [first + s for s in sequence], offset]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        ready: list[tuple] = []
        size = 0
        for part in slices(batches, limit=SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            prompts = encode.ids([p or "" for p in part.column("prompt").to_pylist()]) if prompt_col else None
            for k, (doc, ids) in enumerate(zip(part.column("id").to_pylist(), encode.ids(texts))):
                before = prompts[k] if prompts else ids[:0]
                for piece in packer.add(doc, np.concatenate([before, ids, np.array([END], "<u4")]), len(before)):
                    ready.append(piece)
                    size += ENTRY + piece[2].nbytes
                    if size > READY:
                        yield batch(ready)
                        ready, size = [], 0
        encode.forget()
        ready += packer.drain()
        if ready:
            yield batch(ready)
        del ready, packer
        give_back()

    return rows.mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in the place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )
