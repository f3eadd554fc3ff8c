"""Token counts by a digest cache: a text that was counted before isn't encoded again.

The cache is a table (content, tokenizer, n_tokens, run). content is the SHA-256 of the
normalised text, tokenizer that of the tokenizer's file, its library and the library's version, so
another version of either shares nothing. A run digests the texts in the JVM, groups the
digests, anti-joins them with the cache, encodes each distinct miss once, appends the
counts, and joins all rows with the counts. Normalising makes null the empty text and
no more: byte-level counts depend on every byte, and libraries apply normalisers of their own.

The misses' texts are grouped by digest before they are shuffled, so a text with many copies
moves once a task. The last join meets such a text's digest in many rows: digests of more
than a thousandth of all rows, which are fewer than a thousand, are joined by
broadcast, the others by a shuffle.

What a run appends appears when it is complete; a run that fails leaves the cache as it
was. Two runs at once may append the same content; its counts are equal and one is read.

Byte-level BPE without a normaliser encodes pre-tokens apart from each other, and so does a
sentencepiece BPE without one for spaces and what follows up to the next space, if no piece has a
space behind another character. There a task asks the library for each distinct such word of
some megabytes and adds up. Words that begin with their only space are asked for end to end, those
without white space line by line: the tokens that begin with the space, or are the line feed, tell
them apart. Pre-tokens are cut by the character classes that the library itself tells. Texts that hold
an added token's string (sentencepiece: the mark that stands for a space), and all texts of other
tokenizers, go to the library whole.

Edge cases: null is the empty text, which has no tokens; texts are counted whole; repeated rows
give repeated results; rows without a doc_id are counted like others; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.llm import common as C
from tarnkit.llm.byte_bpe import LETTER, NUMBER, SPACE, code_points, pre_tokens

FEW_MISSES = 1 << 18  # digests that are sent along (8 MB)
HOT_PART, HOT_ROWS = 1000, 1000
KNOWN_WORDS = 1 << 20  # that a process remembers
CELL, GROUP, ASKED = 1 << 18, 8 << 20, 1 << 13  # bytes whose words are told apart at once, are encoded once, are asked for as one text
MARK = "▁".encode()  # what sentencepiece has for a space


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer's file (.json: tokenizers, .model: sentencepiece) and the digest of its version."""

    library: str
    body: bytes
    version: str
    classes: bytes | None = None  # classes of characters, compressed, where pre-tokens can be encoded apart
    added: tuple[bytes, ...] = ()
    spaced: bytes | None = None  # by id, whether a token begins with a space, where words can be encoded apart
    line: int = -1  # the id of the line feed


def load_tokenizer(path: str) -> TokenizerFile:
    with open(path, "rb") as file:
        body = file.read()
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    module = __import__(library)
    version = hashlib.sha256(b"\0".join([library.encode(), module.__version__.encode(), body])).hexdigest()
    if library == "sentencepiece":
        return TokenizerFile(library, body, version, added=(MARK,), spaced=_spaced_pieces(body))
    spec = json.loads(body)
    cut, vocab = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab", {})
    apart = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec["model"].get("type") == "BPE" and "Ġ" in vocab and "Ċ" in vocab
    plain = not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    added = tuple(t["content"].encode() for t in spec.get("added_tokens", []))
    if not (apart and plain) or any(white in token for token in added for white in (b" ", b"\n")):
        return TokenizerFile(library, body, version, added=added)
    classes = pa.compress(character_classes().tobytes(), codec="zstd", asbytes=True)
    ids = [*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]
    return TokenizerFile(library, body, version, classes, added, _flags((i for t, i in vocab.items() if t[:1] == "Ġ"), max(ids) + 1), vocab["Ċ"])


def _flags(ids: Iterable[int], n: int) -> bytes:
    out = np.zeros(n, bool)
    out[list(ids)] = True
    return out.tobytes()


def _spaced_pieces(body: bytes) -> bytes | None:
    """The pieces that begin with a space, if words that begin with spaces are encoded apart."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # it needs a library that sentencepiece itself does without
        return None
    model = sentencepiece_model_pb2.ModelProto.FromString(body)
    train, norm, kinds = model.trainer_spec, model.normalizer_spec, model.SentencePiece
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    apart = train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix
    mark = MARK.decode()
    usual = [p.piece if p.type == kinds.NORMAL else "" for p in model.pieces]
    others = all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in model.pieces)
    if not (plain and apart and others and mark in usual) or any(mark in p.lstrip(mark) for p in usual):
        return None
    return _flags((i for i, p in enumerate(usual) if p.startswith(mark)), len(usual))


def character_classes() -> np.ndarray:
    """The class of each code point by the library's own pattern engine."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def runs(pattern: str, text: str) -> list[tuple[str, tuple[int, int]]]:
        return Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)

    kinds = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))
    found = runs("|".join(f"{p}+" for _, p in kinds), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    firsts = "".join(piece[0] for piece, _ in found)  # a run has one class
    of = {c: value for value, p in kinds for piece, _ in runs(p, firsts) for c in piece}
    table = np.zeros(0x110000, np.uint8)
    for piece, _ in found:
        table[[ord(c) for c in piece]] = of[piece[0]]
    return table


def _encoder(tokenizer: TokenizerFile) -> Callable[[list[str]], list[list[int]]]:
    """A function that asks the library for the ids of whole texts."""
    if tokenizer.library == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=tokenizer.body)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it has
    made = Tokenizer.from_buffer(tokenizer.body)
    made.no_truncation()
    made.no_padding()
    return lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]


class TokenCounter:
    """Token counts of texts, in the process that made it."""

    def __init__(self, tokenizer: TokenizerFile) -> None:
        self.encode, self.added, self.line = _encoder(tokenizer), tokenizer.added, tokenizer.line
        self.classes = np.frombuffer(pa.decompress(tokenizer.classes, decompressed_size=0x110000, codec="zstd", asbytes=True), np.uint8) if tokenizer.classes else None
        self.spaced = np.frombuffer(tokenizer.spaced, bool) if tokenizer.spaced else None
        self.leads = tokenizer.library == "sentencepiece"  # it puts a space before every text
        self.known, self.known_counts = pa.array([], pa.binary()), np.empty(0, np.int64)

    def _ids(self, texts: Iterable[str]) -> np.ndarray:
        """The ids of texts in one array; few at a time, as what the library returns is many times larger."""
        some = [np.array(ids, np.int32) for few in batched(texts, 8) for ids in self.encode(list(few))]
        return np.concatenate([np.empty(0, np.int32), *some])

    def whole(self, texts: Iterable[str]) -> list[int]:
        return [len(ids) for few in batched(texts, 8) for ids in self.encode(list(few))]

    def _joined(self, words: pa.Array) -> np.ndarray:
        """Ids of words end to end, asked for as texts of whole words."""
        data, at = C.column_bytes(words)
        return self._ids(data[at[i] + self.leads : at[j]].tobytes().decode() for i, j in C.runs(at, ASKED))

    def _alone(self, word: bytes) -> int:
        """One word by itself, or the difference that it makes behind another."""
        if not self.leads:
            return self.whole([word.decode()])[0]
        more, less = self.whole(["a" + word.decode(), "a"])
        return more - less

    def _each(self, words: pa.Array) -> np.ndarray:
        """Tokens of each distinct word."""
        data, at = C.column_bytes(words)
        first, longer = data[at[:-1]], np.diff(at) > 1
        if self.classes is None:
            white, second = first == 32, data[np.minimum(at[:-1] + 1, len(data) - 1)] == 32
        else:
            place, point = code_points(data)
            space = self.classes[point] == SPACE
            k = np.searchsorted(place, at[:-1])
            white, second = space[k], space[np.minimum(k + 1, len(space) - 1)]
        usual = np.ones(len(words), bool)
        for token in self.added:
            usual &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        begins, solid = usual & (first == 32) & longer & ~second, usual & ~white & (self.line >= 0)
        out = np.zeros(len(words), np.int64)
        ids = self._joined(words.filter(pa.array(begins)))
        out[begins] = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        ids = self._joined(pc.binary_join_element_wise(words.filter(pa.array(solid)), b"", b"\n"))
        out[solid] = np.diff(np.flatnonzero(ids == self.line), prepend=-1) - 1
        for k in np.flatnonzero(~(begins | solid)):
            out[k] = self._alone(words[k].as_py())
        return out

    def _known(self, words: pa.Array) -> np.ndarray:
        """Tokens of each distinct word; words that were asked for before aren't again."""
        at = pc.index_in(words, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        out = np.empty(len(words), np.int64)
        out[~new] = self.known_counts[at.drop_null().to_numpy()]
        asked = words.filter(pa.array(new))
        out[new] = self._each(asked)
        if len(self.known) + len(asked) <= KNOWN_WORDS:
            self.known, self.known_counts = pa.concat_arrays([self.known, asked]), np.append(self.known_counts, out[new])
        else:
            self.known, self.known_counts = words[:KNOWN_WORDS], out[:KNOWN_WORDS]
        return out

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of texts, and how many lie before each text's end."""
        if self.classes is not None:
            start = pre_tokens(data, at, self.classes)
        else:
            data, at = np.insert(data, at[:-1], 32), at + np.arange(len(at))
            new = data == 32
            new[1:] &= data[:-1] != 32
            new[at[:-1]] = True
            start = np.flatnonzero(new)
        edges = np.append(start, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        return words.dictionary_encode(), np.searchsorted(start, at)

    def _by_words(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums over words, which are told apart in pieces of whole texts, as these keep the arrays in cache."""
        cells = [self._cut(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in C.runs(at, CELL)]
        words = pa.chunked_array([w for w, _ in cells]).unify_dictionaries()
        each, out = self._known(words.chunk(0).dictionary), []
        for chunk, (_, place) in zip(words.chunks, cells, strict=True):
            sums = np.concatenate([[0], np.cumsum(each[chunk.indices.to_numpy()])])
            out.append(np.diff(sums[place]))
        return np.concatenate(out)

    def counts(self, column: pa.Array) -> np.ndarray:
        column = column.fill_null("")
        if self.spaced is None:
            return np.array(self.whole(x.as_py() for x in column), np.int64)
        data, at = C.column_bytes(column)
        out = np.zeros(len(column), np.int64)
        for i, j in C.runs(at, GROUP):
            out[i:j] = self._by_words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        out[np.diff(at) == 0] = 0
        odd = np.zeros(len(column), bool)
        for token in self.added:
            odd |= pc.match_substring(column, token.decode()).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(odd):
            out[k] = self.whole([column[k].as_py()])[0]
        return out


_MADE: dict[str, TokenCounter] = {}


def counter_of(tokenizer: TokenizerFile) -> TokenCounter:
    """The counter of this process, which serves its later tasks too."""
    if tokenizer.version not in _MADE:
        _MADE.clear()
        _MADE[tokenizer.version] = TokenCounter(tokenizer)
    return _MADE[tokenizer.version]


def encode_misses(distinct: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    """(content, text) to (content, n_tokens)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(batch.column(1)), pa.int64())], ["content", "n_tokens"])

    return distinct.mapInArrow(work, "content binary, n_tokens long")


def content() -> Column:
    """The digest of a row's normalised text."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content")


class CountCache:
    """Stored counts of all tokenizers, by content."""

    SCHEMA = "content binary, n_tokens long, tokenizer string, run string"

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or f"{C.shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"

    def rows(self, tokenizer: TokenizerFile) -> DataFrame | None:
        """The counts by this tokenizer, or None before its first run.

        The folders of runs are named one by one: a plan that reads the cache before and
        after an append mustn't take the two for the same table."""
        read = self.spark.read.schema(self.SCHEMA).option("basePath", self.folder)
        try:
            files = read.parquet(self.folder).inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        runs = sorted({f.rsplit("/", 1)[0] for f in files if f"/tokenizer={tokenizer.version}/" in f})
        return read.parquet(*runs) if runs else None

    def append(self, docs: DataFrame, contents: DataFrame, tokenizer: TokenizerFile) -> tuple[int, int]:
        """Encode and store those of contents that aren't stored; how many there were, and how many were stored before."""
        stored = self.rows(tokenizer)
        missing = contents.select("content")
        n_all = contents.count()
        n_missing = n_all
        if stored is not None:
            missing = C.staged(missing.join(stored, "content", "left_anti"), "misses")
            n_missing = missing.count()
        if n_missing:
            texts = docs.select(content(), F.coalesce("text", F.lit("")).alias("text"))
            if n_missing < n_all and n_missing <= FEW_MISSES:
                texts = texts.join(F.broadcast(missing), "content", "left_semi")
            distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
            if n_missing < n_all and n_missing > FEW_MISSES:
                distinct = distinct.join(missing, "content", "left_semi")
            new = encode_misses(distinct, tokenizer).withColumns({"tokenizer": F.lit(tokenizer.version), "run": F.lit(uuid.uuid4().hex)})
            new.write.mode("append").partitionBy("tokenizer", "run").parquet(self.folder)
        return n_all, n_all - n_missing


def count_tokens(docs: DataFrame, tokenizer: TokenizerFile, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of docs (doc_id, text).

    folder: of a cache that earlier runs may have filled; one of its own by default."""
    return counted(docs, tokenizer, CountCache(docs.sparkSession, folder))[0]


def counted(docs: DataFrame, tokenizer: TokenizerFile, cache: CountCache) -> tuple[DataFrame, int, int]:
    """The counts; also how many distinct texts there were, and how many of them were stored before."""
    keys = C.staged(docs.select("doc_id", content(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "keys")
    contents = C.staged(keys.groupBy("content").agg(F.count("*").alias("n")), "contents")
    n_texts, n_stored = cache.append(docs, contents, tokenizer)
    stored = cache.rows(tokenizer)
    if stored is None:
        return keys.select("doc_id", "n_bytes", F.lit(None).cast("long").alias("n_tokens")), n_texts, n_stored  # no rows, so none was encoded
    counts = stored.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    least = max(HOT_ROWS, (contents.agg(F.sum("n")).first()[0] or 0) // HOT_PART)
    hot = contents.where(F.col("n") > least).select("content")  # fewer than HOT_PART
    common = hot.count()
    if not common:
        return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens"), n_texts, n_stored
    of_hot = C.staged(stored.join(F.broadcast(hot), "content", "left_semi").groupBy("content").agg(F.min("n_tokens").alias("n_tokens")), "frequent")
    rest = keys.join(F.broadcast(hot), "content", "left_anti").join(counts, "content")
    both = keys.join(F.broadcast(of_hot), "content").select("doc_id", "n_bytes", "n_tokens").unionByName(rest.select("doc_id", "n_bytes", "n_tokens"))
    return both, n_texts, n_stored


def judge_length(docs: DataFrame, tokenizer: TokenizerFile, limit: int = 512, folder: str | None = None) -> DataFrame:
    """count_tokens, and whether a text has more than limit tokens."""
    return count_tokens(docs, tokenizer, folder).withColumn("over_limit", F.col("n_tokens") > limit)
