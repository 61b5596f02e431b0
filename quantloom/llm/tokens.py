"""Token counts through a digest cache, and the token ids that packing needs.

Counts and ids are those of the named library. For byte-level BPE files texts are cut at ASCII
white space first: that pattern never lets a token cross from a word to the white space after it,
so the ids of a text are the ids of its pieces in a row, and equal pieces are encoded once per
worker. Texts with other white space or a special token's string go to the library whole.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.textnp import Powers, chunks, give_back, lean, strings, word_hashes, words
from quantloom.llm.workspace import Workspace

#: Pieces remembered by one Python worker; beyond it the memory is emptied and filled anew.
PIECES = 60_000
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_LEADS = np.zeros(256, bool)  # first bytes of those characters
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _rank_encoder(spec: dict, path: str):
    """An encoder for single pieces that shares the .json file's vocabulary, or None.

    tiktoken merges by rank; that is the merge order of the .json file exactly if its i-th merge
    makes the i-th id after the single bytes, which is checked here together with every rank.
    """
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return None
    import base64

    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: these bytes stand for themselves,
    letters = dict(zip(map(chr, visible), visible))
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}  # the others for 256 and on
    vocab = spec["model"]["vocab"]
    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {x["content"] for x in spec.get("added_tokens", [])}
    own = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    if own != ranks or any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
        return None
    import public_tokenizers

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of texts, as tokenizers (.json) or sentencepiece (.model) gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        self.pieces: dict[bytes, bytes] = {}
        self.pows = Powers()
        self.special: list[str] = []
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1, add_bos=False, add_eos=False)
            return
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        self.whole = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        one = _rank_encoder(spec, path) if self.by_piece else None
        self.some = (lambda texts: [one(t) for t in texts]) if one else self.whole

    def _odd(self, column: pa.Array, off: np.ndarray, data: np.ndarray) -> list[int]:
        """Texts that must go to the library whole."""
        which = np.zeros(len(off) - 1, bool)
        at = np.flatnonzero(_LEADS[data])
        for i in np.unique(np.searchsorted(off, at, "right") - 1):
            which[i] = bool(_ODD.search(data[off[i] : off[i + 1]].tobytes().decode()))
        for t in self.special:
            which |= pc.fill_null(pc.match_substring(column, t), False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(which).tolist()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin and the total); null as empty."""
        off, data = strings(column)
        n = len(off) - 1
        if not self.by_piece:
            got = self.whole([t or "" for t in column.to_pylist()]) if n else []
            return np.array([i for x in got for i in x], "<u4"), np.cumsum([0, *map(len, got)])
        begin, end, first = words(off, data)
        # a word takes one blank before it; what is left of the white space before it is one piece if its last
        # character went with the word, else two; white space at the end of a text is one piece
        doc = np.searchsorted(off, begin, "right") - 1
        gap = np.maximum(off[doc], np.append(0, end[:-1])) if len(begin) else begin
        blank = (begin > gap) & (data[np.maximum(begin - 1, 0)] == 32) if len(begin) else np.zeros(0, bool)
        more = begin - gap >= 2
        alone = (begin > gap) & ~blank
        has = first[1:] > first[:-1]
        tail = off[:-1].copy()
        tail[has] = end[first[1:][has] - 1]
        open_end = tail < off[1:]
        s = np.concatenate([begin - blank, gap[more], begin[alone] - 1, tail[open_end]])
        e = np.concatenate([end, begin[more] - 1, begin[alone], off[1:][open_end]])
        order = np.argsort(s)
        s, e = s[order], e[order]
        h = word_hashes(data, s, e, self.pows, False)
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(s[index].tolist(), e[index].tolist())]
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        known = self.pieces
        new = [p for p in distinct if p not in known]
        known.update(zip(new, (np.array(x, "<u4").tobytes() for x in self.some([p.decode() for p in new]))))
        ids = [known[p] for p in distinct]
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        count = size[inverse]
        total = np.append(0, np.cumsum(count))
        take = np.repeat(start[inverse] - total[:-1], count) + np.arange(total[-1])
        out, edge = pool[take], total[np.searchsorted(s, off)]
        if odd := self._odd(column, off, data):
            parts = [out[edge[i] : edge[i + 1]] for i in range(n)]
            for i, x in zip(odd, self.whole([column[i].as_py() for i in odd])):
                parts[i] = np.array(x, "<u4")
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return out, edge


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it outlives the task that loads it."""
    stash = sys.modules.setdefault("_quantloom_stash", types.ModuleType("_quantloom_stash"))
    made = stash.__dict__.setdefault("encoders", {})
    if path not in made:
        made[path] = Encoder(path)
        give_back()  # reading the file takes more memory than its encoder
    return made[path]


def version_digest(path: str) -> str:
    """Names a tokenizer file and its library: a change of either starts new cache entries."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library}=={importlib.metadata.version(library)};special=default;add_special=False\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def normalised(text):
    """Content as the cache sees it: null counts as empty; nothing else may change, since byte-level
    tokenizers tell apart every other pair of texts."""
    return F.coalesce(text, F.lit(""))


def count_tokens(docs: DataFrame, tokenizer: str, cache_dir: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; new contents are appended to the cache.

    ``cache_dir`` is a Parquet folder of (version, digest, n_tokens) on shared storage. One text per
    distinct digest that the cache lacks is encoded. Repeated rows share an entry; null text counts
    as empty (0 tokens); an entry written twice by parallel runs counts once. A lost executor
    repeats only its own encoding tasks, and an append that failed leaves no entries.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer)
    body = normalised(F.col(text))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("digest"))
    schema = "digest binary, n_tokens long, version string"

    def stored() -> DataFrame | None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(cache_dir)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return spark.read.schema(schema).parquet(cache_dir).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in chunks(batches, "text"):
            _, edge = enc.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(np.diff(edge))], names=["digest", "n_tokens"])

    known = stored()
    missing = keyed.select("digest", "text")
    if known is not None:
        missing = missing.join(known.select("digest"), "digest", "left_anti")
    missing = missing.groupBy("digest").agg(F.first("text").alias("text"))
    missing.mapInArrow(lean(encode), "digest binary, n_tokens long").withColumn("version", F.lit(version)).write.mode("append").parquet(cache_dir)
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(stored(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every call does the whole work."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, default_tokenizer(), f"{Workspace(spark, 'tokens').path}/cache")
