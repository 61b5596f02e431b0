"""Alignment of two tokenizers over a corpus, one distinct segment at a time.

Texts are cut before runs of white space wherever neither vocabulary can merge across the cut, which
is read from the vocabularies (``can_split``). The ids of a text are then the ids of its segments in a
row, and groups, links and counts of links are sums over its segments. Every distinct segment of the
corpus is encoded and aligned once; documents travel as codes into the dictionary of their block.

Defined results: a null or empty text has no tokens (zeros, empty digest), and neither has one whose
joined tokens of either side differ from space + text (U+2581 in a text does that). Ids may be null
or repeat; every row counts as a document and comes out once. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.textnp import Powers, chunks, give_back, lean, strings, word_hashes
from quantloom.llm.tokens import _ODD, _rank_encoder
from quantloom.llm.workspace import Workspace

#: Bytes of text that share a dictionary; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: Dictionary entries of one task that aligns, and those of a block that are unpacked at a time.
ENTRIES_PER_TASK, UNPACKED = 400_000, 50_000
#: A table of id pairs up to this many rows is broadcast; a larger one is joined with salted keys.
BROADCAST_PAIRS = 2_000_000
SALTS = 16
_BLANK = "▁"


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _crosses(token: bytes) -> bool:
    """Whether a token holds a blank right after something that is not white space."""
    for m in re.finditer(rb"(?<=.) ", token, re.S):
        before = token[: m.start()]
        tail = next((before[-n:].decode(errors="ignore") for n in (1, 2, 3, 4) if before[-n:].decode(errors="ignore")), "x")
        if not tail[-1].isspace():
            return True
    return False


def id_type(*sizes: int) -> str:
    return "<u2" if max(sizes) <= 1 << 16 else "<u4"


class Pair:
    """A byte-level BPE file (A, with a blank before the text) and a sentencepiece file (B, which adds it)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            self.spec = json.load(f)
        letters, vocab = _byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.size_a, self.size_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.kind = id_type(len(self.bytes_a), len(self.bytes_b))
        self.splits = self.can_split()
        self.quick = _rank_encoder(self.spec, path_a)  # for segments without unusual white space
        del self.spec

    def can_split(self) -> bool:
        """Whether no token of either side can reach from a character that is not white space to a blank
        after it, and both sides take the characters as they are: A cuts the text by its byte-level
        pattern, in which such a place always ends a piece, and B does not normalise (probed with
        characters that normal forms or a trim would change)."""
        pre = self.spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not self.spec.get("normalizer")
        probe = "  ﬁ ½　é İ  x \t "
        kept = b"".join(self.bytes_b[i] for i in self.b.encode(probe)) == f" {probe}".encode()
        return bool(plain and kept and not any(map(_crosses, self.bytes_a)) and not any(map(_crosses, self.bytes_b)))

    def _ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        odd = [i for i, s in enumerate(segments) if _ODD.search(s)] if self.quick else range(len(segments))
        a = [self.quick(s) for s in segments] if self.quick else [[]] * len(segments)
        for i, x in zip(odd, self.a.encode_batch_fast([segments[i] for i in odd], add_special_tokens=False)):
            a[i] = x.ids
        return a, self.b.encode([s[1:] for s in segments], num_threads=1)

    def align(self, segments: list[str]) -> list[bytes]:
        """The alignment of each segment (its first blank included), packed: the ids group by group, A
        before B, then a bit per id that says B. Empty where the joined tokens do not give the segment back."""
        a, b = self._ids(segments)
        raw = [s.encode() for s in segments]
        good = [b"".join([self.bytes_a[i] for i in x]) == r == b"".join([self.bytes_b[i] for i in y]) for x, y, r in zip(a, b, raw)]
        if not all(good):
            some = iter(self.align([s for s, g in zip(segments, good) if g]))
            return [next(some) if g else b"" for g in good]
        if not segments:
            return []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter((i for x in y for i in x), np.int64) for y in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        shut_a, shut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)  # no token is empty, so ends differ
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(flat_a)) + (np.cumsum(many_b) - many_b)[group_a]
        at_b = np.arange(len(flat_b)) + np.cumsum(many_a)[group_b]
        ids, side = np.empty(len(at_a) + len(at_b), self.kind), np.zeros(len(at_a) + len(at_b), np.uint8)
        ids[at_a], ids[at_b], side[at_b] = flat_a, flat_b, 1
        edge = np.append(0, np.cumsum(n_a + n_b))
        n = np.diff(edge)
        room = np.append(0, np.cumsum(-(-n // 8) * 8))
        bits = np.zeros(room[-1], np.uint8)
        bits[np.arange(len(side)) + np.repeat(room[:-1] - edge[:-1], n)] = side
        left, right, w = ids.tobytes(), np.packbits(bits, bitorder="little").tobytes(), ids.itemsize
        return [left[x * w : y * w] + right[p // 8 : q // 8] for x, y, p, q in zip(edge.tolist(), edge[1:].tolist(), room.tolist(), room[1:].tolist())]


def pair(path_a: str, path_b: str) -> Pair:
    """The worker's pair of encoders; it outlives the task that loads it."""
    stash = sys.modules.setdefault("_quantloom_stash", types.ModuleType("_quantloom_stash"))
    made = stash.__dict__.setdefault("pairs", {})
    if (path_a, path_b) not in made:
        made[path_a, path_b] = Pair(path_a, path_b)
        give_back()
    return made[path_a, path_b]


def _starts(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where segments begin: at every text, and at blanks after a character that is no white space for
    either side (nor U+2581), unless the blank ends its text: alone it would vanish from B."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:] == 32) + 1
    p1, p2, p3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    three = p3.astype(np.int64) << 16 | p2.astype(np.int64) << 8 | p1
    odd = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    odd |= np.isin(three, [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, 0xE29681])
    good = ((p1 > 0x20) & (p1 < 0x7F) | (p1 >= 0x80) & ~odd) & ~np.isin(at + 1, off)
    return np.union1d(at[good], off[:-1])


def packed(codes: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """The codes edge[i] to edge[i + 1] of every document, seven bits a byte, the lowest first."""
    size = np.ones(len(codes), np.int8)
    for k in range(1, 5):
        size += codes >= 1 << 7 * k
    upto = np.append(0, np.cumsum(size, dtype=np.int64))
    out = np.zeros(upto[-1], np.uint8)
    for k in range(5):
        some = size > k
        out[upto[:-1][some] + k] = (codes[some] >> 7 * k & 127) | ((size[some] > k + 1) << 7)
    raw, at = out.tobytes(), upto[edge].tolist()
    return [raw[x:y] for x, y in zip(at, at[1:])]


def unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all documents in a row, where each begins and the total)."""
    codes, many = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    size = np.append(0, np.cumsum([len(p) for p in parts]))
    at = 0
    while at < len(parts):  # about a megabyte at a time
        end = max(at + 1, int(np.searchsorted(size, size[at] + (1 << 20), "right")) - 1)
        data = np.frombuffer(b"".join(parts[at:end]), np.uint8)
        last = data < 128
        number = np.cumsum(last) - last
        begin = np.append(0, np.flatnonzero(last) + 1)[: int(last.sum())]
        own, within = np.zeros(len(begin), np.int32), np.arange(len(data)) - begin[number]
        for k in range(int(within.max(initial=0)) + 1):
            some = within == k
            own[number[some]] |= (data[some] & 127).astype(np.int32) << 7 * k
        codes.append(own)
        sums = np.append(0, np.cumsum(last))
        many.append(np.diff(sums[size[at : end + 1] - size[at]]))
        at = end
    return np.concatenate(codes), np.cumsum(np.concatenate(many))


_CUT = "ref long, doc_id long, codes binary, segment string"
#: Entries of a block have numbers below this; a ``ref`` is the block times it plus the number.
ROOM = 1 << 28


def _cut(splits: bool):
    """Documents as codes into block dictionaries: rows with ``codes`` are documents, rows with a
    ``segment`` are dictionary entries, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        block, size = TaskContext.get().partitionId() << 14, 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            if held:
                h, g = (np.concatenate([x[i] for x in held]) for i in (3, 4))
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                if (g[first][inverse] != g).any():  # the first hash does not tell all segments apart
                    _, first, inverse = np.unique(np.stack([h, g], 1), axis=0, return_index=True, return_inverse=True)
                del h, g
                inverse = np.split(inverse.ravel().astype(np.int32), np.cumsum([len(x[3]) for x in held])[:-1])
                many = np.zeros(len(first), np.int64)
                for x, own in zip(held, inverse):
                    many += np.bincount(own[x[2]], minlength=len(first))
                order = np.argsort(-many, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                segments = pa.concat_arrays([x[5] for x in held]).take(pa.array(first[order]))
                n = 0
                for (ids, edge, code, *_), own in zip(held, inverse):
                    yield pa.RecordBatch.from_arrays([pa.array(block * ROOM + n + np.arange(len(ids))), ids, pa.array(packed(place[own[code]], edge), pa.binary()), pa.nulls(len(ids), pa.string())], names=["ref", "doc_id", "codes", "segment"])
                    n += len(ids)
                held.clear()
                for at in range(0, len(order), 50_000):
                    some = segments.slice(at, 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(block * ROOM + np.arange(at, at + len(some))), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), some], names=["ref", "doc_id", "codes", "segment"])
            held.clear()
            block, size = block + 1, 0

        for b in chunks(batches, "text", 2 << 20):
            plain, raw = strings(b.column("text"))
            length = np.diff(plain)
            off = plain + np.append(0, np.cumsum(length > 0))  # a blank before every text that has characters
            data = np.full(off[-1], 32, np.uint8)
            data[np.arange(len(raw)) + np.repeat(np.cumsum(length > 0), length)] = raw
            begin = _starts(off[np.append(length > 0, True)], data) if splits else np.unique(off[:-1][length > 0])
            end = np.append(begin[1:], len(data))[: len(begin)]
            h, g = (word_hashes(data, begin, end, pows, False, other) for other in (False, True))
            _, first, code = np.unique(h, return_index=True, return_inverse=True)
            if (g[first][code] != g).any():
                _, first, code = np.unique(np.stack([h, g], 1), axis=0, return_index=True, return_inverse=True)
            s, width = begin[first], (end - begin)[first]
            edge = np.append(0, np.cumsum(width))
            take = np.repeat(s - edge[:-1], width) + np.arange(edge[-1])
            texts = pa.StringArray.from_buffers(len(s), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data[take].tobytes()))
            held.append((b.column("doc_id"), np.searchsorted(begin, off), code.ravel().astype(np.int32), h[first], g[first], texts))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from flush()
        yield from flush()

    return run


def _aligner(path_a: str, path_b: str):
    """Aligns segments; their places (``refs``) go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(path_a, path_b)
        for b in chunks(batches, "segment", 1 << 20, 20_000):
            yield pa.RecordBatch.from_arrays([b.column("refs"), pa.array(p.align(b.column("segment").to_pylist()), pa.binary())], names=["refs", "aligned"])

    return run


class Alignments:
    """Packed alignments as flat arrays: ids and sides of all tokens, groups and links by entry."""

    def __init__(self, column: pa.Array, kind: str):
        off, data = strings(column.cast(pa.large_binary()))
        w = np.dtype(kind).itemsize
        n = np.diff(off) * 8 // (8 * w + 1)
        self.ok = n > 0
        self.edge = np.append(0, np.cumsum(n))
        within = np.arange(self.edge[-1]) - np.repeat(self.edge[:-1], n)
        at = np.repeat(off[:-1], n)
        self.ids = sum(data[at + w * within + k].astype(np.int64) << 8 * k for k in range(w)) if len(data) else np.zeros(0, np.int64)
        self.side = (data[at + np.repeat(w * n, n) + within // 8] >> (within % 8) & 1).astype(bool) if len(data) else np.zeros(0, bool)
        self.n, self.n_b = n, self._sums(self.side)
        opens = ~self.side
        opens[1:] &= self.side[:-1]
        self.group = np.cumsum(opens) - 1
        self.n_groups = self._sums(opens)
        at_group = np.flatnonzero(opens)
        many = np.diff(np.append(at_group, len(self.ids)))
        self.many_b = np.bincount(self.group, self.side).astype(np.int64) if len(self.group) else np.zeros(0, np.int64)
        self.first_b = at_group + many - self.many_b
        links = np.where(self.side, 0, self.many_b[self.group]) if len(self.group) else np.zeros(0, np.int64)
        self.links = links
        self.n_links = self._sums(links)
        self.last = np.append(opens[1:], True)[: len(opens)]

    def _sums(self, x: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(x, dtype=np.int64))
        return upto[self.edge[1:]] - upto[self.edge[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(A id << 32 | B id of every link, where the links of each entry begin and the total)."""
        upto = np.append(0, np.cumsum(self.links))
        token = np.repeat(np.arange(len(self.ids)), self.links)
        b = self.first_b[self.group[token]] + np.arange(upto[-1]) - upto[token] if len(token) else token
        return self.ids[token] << 32 | self.ids[b], upto[self.edge]

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every entry."""
        mark = np.where(self.last, 3, np.where(np.append(self.side[1:], False)[: len(self.side)] & ~self.side, 2, 1))  # ; | ,
        known, which = np.unique(self.ids << 2 | mark, return_inverse=True)
        table = [b"%d%s" % (k >> 2, b" ,|;"[k & 3 : (k & 3) + 1]) for k in known.tolist()]
        edge = self.edge.tolist()
        parts = [table[i] for i in which.tolist()]
        return [b"".join(parts[x:y])[:-1] for x, y in zip(edge, edge[1:])]


def _entries(entries: pa.Table, names: list[str]) -> list[pa.Array]:
    """Columns of a block's dictionary in the order of its numbers."""
    entries = entries.take(pc.sort_indices(entries.column("entry")))
    return [entries.column(n).combine_chunks() for n in names]


def _summed(codes: np.ndarray, edge: np.ndarray, values: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(values[codes]))
    return upto[edge[1:]] - upto[edge[:-1]]


_FIRST = "ref long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs long"


def _compose(kind: str):
    """The rows of a block's documents, as far as the block knows them, and how many of its documents
    hold each id pair (rows with ``pair``)."""

    def run(docs: pa.Table, entries: pa.Table) -> pa.Table:
        n = docs.num_rows
        numbers = {x: np.zeros(n, np.int64) for x in ("n_a", "n_b", "n_groups", "n_links")}
        digest, pairs, held = [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n and entries.num_rows:
            codes, edge = unpacked(docs.column("codes").to_pylist())
            column = _entries(entries, ["aligned"])[0]
            m = len(column)
            ok, text, own, links, off = np.zeros(m, bool), [], [], [], [np.zeros(1, np.int64)]
            counts = {x: np.zeros(m, np.int64) for x in numbers}
            for at in range(0, m, UNPACKED):  # a part of the dictionary at a time, so that arrays stay small
                al = Alignments(column.slice(at, UNPACKED), kind)
                some = slice(at, at + UNPACKED)
                ok[some] = al.ok
                for x, v in (("n_a", al.n - al.n_b), ("n_b", al.n_b), ("n_groups", al.n_groups), ("n_links", al.n_links)):
                    counts[x][some] = v
                held_pairs, edges = al.pairs()
                held_pairs, index = np.unique(held_pairs, return_inverse=True)
                own.append(held_pairs)
                links.append(index.astype(np.int32))
                off.append(edges[1:] + off[-1][-1])
                text.extend(al.texts())
            del al, column
            pairs = np.unique(np.concatenate(own))
            links = np.concatenate([np.searchsorted(pairs, x).astype(np.int32)[i] for x, i in zip(own, links)])
            good = (_summed(codes, edge, ~ok) == 0) & (edge[1:] > edge[:-1])
            for x, v in counts.items():
                numbers[x] = np.where(good, _summed(codes, edge, v), 0)
            held = _holders(codes, edge, good, links, np.concatenate(off), len(pairs))
            for i in np.flatnonzero(good).tolist():
                h = hashlib.sha256()
                for at in range(edge[i], edge[i + 1], 100_000):
                    h.update((b";" if at > edge[i] else b"") + b";".join([text[c] for c in codes[at : min(at + 100_000, edge[i + 1])].tolist()]))
                digest[i] = h.hexdigest()
        some = held > 0
        m = int(some.sum())
        left = [docs.column("ref").combine_chunks(), docs.column("doc_id").combine_chunks(), *map(pa.array, numbers.values()), pa.array(digest, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        right = [*[pa.nulls(m, pa.int64())] * 6, pa.nulls(m, pa.string()), pa.array(pairs[some]), pa.array(held[some])]
        names = [f.split()[0] for f in _FIRST.split(", ")]
        return pa.concat_tables([pa.table(dict(zip(names, left))), pa.table(dict(zip(names, right)))])

    return run


def _holders(codes: np.ndarray, edge: np.ndarray, good: np.ndarray, links: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """In how many good documents each of the n pairs is, some documents at a time."""
    total, at = np.zeros(n, np.int64), 0
    while at < len(good):
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + 250_000, "right")) - 1)
        doc = np.repeat(np.arange(end - at), np.diff(edge[at : end + 1]))
        seen = np.unique(doc[good[at:end][doc]] * len(off) + codes[edge[at] : edge[end]][good[at:end][doc]])  # a segment counts once in a document
        doc, c = seen // len(off), seen % len(off)
        width = off[c + 1] - off[c]
        upto = np.append(0, np.cumsum(width))
        here = links[np.repeat(off[c] - upto[:-1], width) + np.arange(upto[-1])]
        total += np.bincount(np.unique(np.repeat(doc, width) * n + here) % n, minlength=n) if len(here) else 0
        at = end
    return total


def _count(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """ref, n_best and count_sum of a block's documents."""
    sums = {x: np.zeros(docs.num_rows, np.int64) for x in ("n_best", "count_sum")}
    if docs.num_rows and entries.num_rows:
        codes, edge = unpacked(docs.column("codes").to_pylist())
        for x, v in zip(sums, _entries(entries, list(sums))):
            sums[x] = _summed(codes, edge, v.to_numpy(zero_copy_only=False))
    return pa.table({"ref": docs.column("ref"), **{x: pa.array(v) for x, v in sums.items()}})


def _links(kind: str):
    """(sid, pair) of every link of aligned segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "aligned", 1 << 20, 20_000):
            pairs, off = Alignments(b.column("aligned"), kind).pairs()
            at = np.repeat(np.arange(b.num_rows), np.diff(off))
            yield pa.RecordBatch.from_arrays([b.column("sid").take(pa.array(at)), pa.array(pairs)], names=["sid", "pair"])

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per document, the table of linked id pairs with their document counts).

    Shuffles carry block dictionaries, not words: one row per distinct segment of some megabytes of
    text. A block is one group of bounded size, whatever the corpus repeats. The first table has
    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the second has a, b, docs
    and best (no other pair of its A id is in more documents).
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "alignment")
    p = pair(path_a, path_b)
    kind = p.kind
    cut = ws.save(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(_cut(p.splits)), _CUT), "blocks")
    held = cut.where("codes IS NOT NULL").select(F.shiftright("ref", 28).alias("block"), "ref", "doc_id", "codes")
    entries = cut.where("segment IS NOT NULL").select("ref", "segment")
    tasks = max(spark.sparkContext.defaultParallelism, -(-entries.count() // ENTRIES_PER_TASK))
    # a segment comes once a block, so its list has one number for every 32 MB of the corpus at most
    grouped = entries.repartition(tasks, "segment").groupBy("segment").agg(F.collect_list("ref").alias("refs"))
    made = grouped.mapInArrow(lean(_aligner(path_a, path_b)), "refs array<long>, aligned binary")
    made = ws.save(made.withColumn("sid", F.monotonically_increasing_id()), "aligned")

    def per_block(wanted: DataFrame, each, schema: str) -> DataFrame:
        at = wanted.withColumn("ref", F.explode("refs")).drop("refs")
        at = at.withColumns({"of": F.shiftright("ref", 28), "entry": F.col("ref").bitwiseAND(ROOM - 1).cast("int")}).drop("ref")
        return held.groupBy("block").cogroup(at.groupBy("of")).applyInArrow(lambda a, b: each(a, b), schema)

    first = ws.save(per_block(made.select("refs", "aligned"), _compose(kind), _FIRST), "composed")
    counts = first.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    counts = ws.save(counts, "counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    table = ws.save(counts.join(most, "a").select("pair", "a", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")
    links = made.mapInArrow(lean(_links(kind)), "sid long, pair long")
    small = table.select("pair", "docs", "best")
    if table.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(small), "pair")
    else:
        small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", F.pmod(F.col("sid"), F.lit(SALTS)).cast("int")).join(small, ["pair", "salt"])
    sums = met.groupBy("sid").agg(F.sum("docs").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best"))
    sums = made.select("sid", "refs").join(sums, "sid", "left").select("refs", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_best", "count_sum")])
    second = per_block(sums, _count, "ref long, n_best long, count_sum long")
    rows = first.where("ref IS NOT NULL").drop("pair", "docs")
    mine = lambda x: F.when(F.col("n_a") > 0, F.col(x)).otherwise(F.lit(0).cast("long")).alias(x)
    out = rows.join(second, "ref").select("doc_id", "n_a", "n_b", "n_groups", "n_links", mine("n_best"), mine("count_sum"), "groups_sha256")
    return out, table.drop("pair")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
