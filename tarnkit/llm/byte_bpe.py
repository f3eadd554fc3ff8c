"""Byte-level BPE: every distinct pre-token is encoded once for the whole corpus.

Texts are cut into pre-tokens in blocks of whole documents (BLOCK_BYTES, or one longer
document). A block keeps its distinct pre-tokens once and each document as places in
that list, compressed. The blocks are written to a table bucketed by block. The
distinct pre-tokens of all blocks are shuffled by their bytes, each is encoded once,
and the ids travel back to the blocks in packets; there the documents are put together
again by position. The bucketed table meets the packets without moving the documents
again. Decoding looks ids up in the token-byte table, which is as large as the
vocabulary and sent along with the plan.

Pre-tokens are told apart by their bytes. A frequent one gives one row a block, whatever
its count: on a large corpus these rows meet in one task, which passes over them sorted,
holds one word at a time and sends packets on.

The pattern OWN_PATTERN is cut in numpy by character classes, which are asked of the
tokenizer library's own pattern engine, so they agree with it in every Unicode version;
any other pattern is cut by the regex library. Ids are bytes: unsigned 32-bit little-endian.

Edge cases: null and empty texts have no ids and decode to nothing; texts are encoded
whole; repeated rows give repeated results; an empty table gives an empty result;
further columns are ignored, whatever their names; a doc_id that isn't an integer is
refused with a TypeError.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C

BLOCK_BYTES = 32 << 20
PIECE_BYTES = 1 << 17
PACKET_ROWS = 400_000
ONE, TWO = 192, 192 + 48 * 256  # the first values that take two, three and five bytes
THREE = TWO + 15 * 65536
OTHER, LETTER, NUMBER, SPACE = range(4)
# The pattern that pre_tokens cuts by, and its contractions.
OWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def character_classes() -> np.ndarray:
    """The class of each code point by the tokenizer library's pattern engine."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[[ord(c) for c in bytes(probe.encode_ordinary(every)).decode()]] = value
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each character in UTF-8 data, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    value = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        pick = np.flatnonzero(lead >= low)
        if not len(pick):
            break
        value[pick] = lead[pick] & mask
        for k in range(1, size):
            value[pick] = value[pick] << 6 | (data[np.minimum(at[pick] + k, len(data) - 1)] & 0x3F)
    return at, value


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte places at which the pre-tokens of each text start; they tile the texts.

    Runs of one class are pre-tokens. A space before a run of another class joins
    it; earlier white space stays together. An apostrophe that is a run by itself and
    joined by no space takes a contraction's suffix along."""
    if not len(data):
        return np.empty(0, np.int64)
    at, point = code_points(data)
    kind = classes[point]
    n = len(at)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    new[0] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    start = new.copy()
    white = kind[begin] == SPACE
    inner = ~edge[end]  # another run of the same text follows
    last = end[white & inner] - 1
    start[last] = True
    joins = last[point[last] == 32]
    start[joins + 1] = False
    quote = begin[(end - begin == 1) & (point[begin] == 39) & inner]
    quote = quote[start[quote]]
    if len(quote):
        done = np.zeros(len(quote), bool)
        run_end = end[np.searchsorted(begin, quote + 1)]
        for suffix in SUFFIXES:
            fits = ~done & (run_end - quote - 1 >= len(suffix)) & (kind[quote + 1] == LETTER)
            for k, c in enumerate(suffix):
                fits &= point[np.minimum(quote + 1 + k, n - 1)] == ord(c)
            q = quote[fits]
            start[q + 1] = False
            after = q + 1 + len(suffix)
            start[after[after < n]] = True
            done |= fits
    return at[start]


def matches(data: np.ndarray, offsets: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte places of the matches of any pattern in each text; what no match holds has no token."""
    import regex

    found, spans = regex.compile(pattern), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text = bytes(data[a:b]).decode()
        at = a + np.append(code_points(data[a:b])[0], b - a)
        ends = [m.span() for m in found.finditer(text) if m.end() > m.start()]
        spans.append(at[np.array(ends, np.int64).reshape(-1, 2)])
    both = np.concatenate([np.empty((0, 2), np.int64), *spans])
    return both[:, 0], both[:, 1]


def pack(*parts: np.ndarray) -> bytes:
    return pack_all(parts)


def pack_all(parts: Iterable[np.ndarray]) -> bytes:
    """Compressed unsigned values below 2**32, small ones in fewer bytes: the first bytes
    of all values, which tell the sizes, then all second bytes, and so on."""
    streams: list[list[bytes]] = [[] for _ in range(5)]
    for part in parts:
        v = part.astype(np.int64)
        size = 1 + (v >= ONE) + (v >= TWO) + (v >= THREE)
        first = np.select([size == 1, size == 2, size == 3], [v, ONE + (v - ONE >> 8), 240 + (v - TWO >> 16)], 255)
        two, three, raw = v[size == 2] - ONE, v[size == 3] - TWO, v[size == 4]
        for stream, x in zip(streams, (first, two & 255, three >> 8 & 255, three & 255), strict=False):
            stream.append(x.astype(np.uint8).tobytes())
        streams[4].append(raw.astype("<u4").tobytes())
    flat = b"".join(x for stream in streams for x in stream)
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def unpack(body: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    first = data[:n]
    two, three, raw = (first >= ONE) & (first < 240), (first >= 240) & (first < 255), first == 255
    n_two, n_three, n_raw = (int(x.sum()) for x in (two, three, raw))
    cut = np.cumsum([n, n_two, n_three, n_three])
    out = first.astype(np.uint32)
    out[two] = ONE + (out[two] - ONE << 8) + data[cut[0] : cut[1]]
    out[three] = TWO + (out[three] - 240 << 16) + (data[cut[1] : cut[2]].astype(np.uint32) << 8) + data[cut[2] : cut[3]]
    out[raw] = data[cut[3] : cut[3] + 4 * n_raw].copy().view("<u4")
    return out


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at[i]:at[i]+size[i]] for all i, end to end."""
    if not len(size):
        return flat[:0]
    cut = [0, *np.searchsorted(total := np.cumsum(size, dtype=np.int64), np.arange(PIECE_BYTES, total[-1], PIECE_BYTES)), len(size)]
    return np.concatenate([_gather(flat, at[i:j], size[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True) if j > i])


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size, dtype=np.int64)
    shift = np.repeat(at.astype(np.int64) - np.concatenate([[0], total[:-1]]), size)
    shift += np.arange(len(shift))
    return flat[shift]


def _blocks(docs: DataFrame, pattern: str) -> DataFrame:
    own = pattern == OWN_PATTERN
    classes = pa.compress(character_classes().tobytes(), codec="zstd", asbytes=True) if own else b""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(pa.decompress(classes, decompressed_size=0x110000, codec="zstd", asbytes=True), np.uint8) if own else None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = C.column_bytes(batch.column(1))
            for i, j in C.runs(offsets, BLOCK_BYTES):
                body, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, tokens = [], [], []
                for a, b in C.runs(at, PIECE_BYTES):
                    part, rows = body[at[a] : at[b]], at[a : b + 1] - at[a]
                    if own:
                        start = pre_tokens(part, rows, table)
                    else:
                        start, end = matches(part, rows, pattern)
                    starts.append((start + at[a]).astype(np.int32))
                    if not own:
                        ends.append((end + at[a]).astype(np.int32))
                    tokens.append(np.diff(np.searchsorted(start, rows)))
                if own:  # pre-tokens tile the block, so their starts are the offsets of a column
                    starts.append(np.array([len(body)], np.int32))
                    edges, starts, ends = np.concatenate(starts), None, None
                    coded = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(body)]).dictionary_encode()
                    place, words = coded.indices.to_numpy(), coded.dictionary
                    edges = coded = None
                else:
                    place, words = C.span_codes(body, np.concatenate(starts), np.concatenate(ends))
                    starts = ends = None
                count = np.bincount(place, minlength=len(words))
                order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]  # what lies between matches has no count
                rank = np.zeros(len(words), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                body_of = pack_all(rank[place[c : c + PIECE_BYTES]] for c in range(0, len(place), PIECE_BYTES))
                words = words.take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([np.concatenate(tokens)], pa.list_(pa.int64())), pa.array([body_of], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)],
                    ["block", "doc_ids", "counts", "body", "words"],
                )
                number += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "block long, doc_ids array<long>, counts array<long>, body binary, words array<binary>")


def _encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(block, place, word) sorted by word, to packets (block, n, places, sizes, ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        last, ids = None, []
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def packets() -> Iterator[pa.RecordBatch]:
            block, place = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            size = np.array([len(x) for h in held for x in h[2]], np.int64)
            flat = np.fromiter((t for h in held for x in h[2] for t in x), np.int64, int(size.sum()))
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            order = np.argsort(block, kind="stable")
            block, place, size, start = block[order], place[order], size[order], start[order]
            cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            rows = [(int(block[a]), int(b - a), pack(place[a:b]), pack(size[a:b]), pack(gather(flat, start[a:b], size[a:b]))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "n", "places", "sizes", "ids"])

        for batch in batches:
            found = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, encode(word)
                found.append(ids)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), found))
            if sum(len(h[2]) for h in held) >= PACKET_ROWS:
                yield from packets()
                held = []
        if any(h[2] for h in held):
            yield from packets()

    return words.mapInArrow(work, "block long, n long, places binary, sizes binary, ids binary")


def _assemble(joined: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """Documents from their blocks; with ranks, decoded again in the same worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, counts, body, packets = (batch.column(k)[r] for k in range(4))
                counts = np.array(counts.as_py(), np.int64)
                packets = packets.as_py() or []
                size = np.zeros(sum(p["n"] for p in packets), np.int64)
                start = np.zeros(len(size), np.int64)
                flats, base = [], 0
                for p in packets:
                    place, sizes = unpack(p["places"], p["n"]), unpack(p["sizes"], p["n"]).astype(np.int64)
                    size[place] = sizes
                    start[place] = base + np.cumsum(sizes) - sizes
                    flats.append(unpack(p["ids"], int(sizes.sum())))
                    base += len(flats[-1])
                flat = np.concatenate(flats) if flats else np.empty(0, "<u4")
                word = unpack(body.as_py(), int(counts.sum()))
                packets = body = None
                to = np.concatenate([[0], np.cumsum(counts)])
                for a, b in C.runs(to, 200_000):
                    part = word[to[a] : to[b]]
                    ids = gather(flat, start[part], size[part]).astype("<u4")
                    total = np.concatenate([[0], np.cumsum(size[part])])
                    cut = total[to[a : b + 1] - to[a]]
                    out = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(4 * cut), pa.py_buffer(ids)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids.values[a:b]), pa.array(np.diff(cut), pa.int64()), out], ["doc_id", "n_tokens", "ids"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(work(batches), ranks, 2)

    schema = "doc_id long, n_tokens long, ids binary"
    return joined.mapInArrow(work, schema) if ranks is None else joined.mapInArrow(both, f"{schema}, decoded binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, and_decode: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of each whole text; also decoded, as decode gives it, if asked.

    The blocks are a table in the shared folder, which the result reads when it runs."""
    C.integer_ids(docs)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"byte_bpe_blocks_{uuid.uuid4().hex}"
    _blocks(docs, pattern).write.bucketBy(parts, "block").option("compression", "zstd").option("path", f"{C.shared_dir(spark).rstrip('/')}/{name}").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    words = blocks.select("block", F.posexplode("words").alias("place", "word")).select("block", F.col("place").cast("long").alias("place"), "word")
    packets = _encode_words(words.repartition("word").sortWithinPartitions("word"), ranks, pattern)
    by_block = packets.groupBy("block").agg(F.collect_list(F.struct("n", "places", "sizes", "ids")).alias("packets"))
    joined = blocks.select("block", "doc_ids", "counts", "body").hint("merge").join(by_block, "block", "left")
    return _assemble(joined.select("doc_ids", "counts", "body", "packets"), ranks if and_decode else None)


def _decoded(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], place: int) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of the ids in column place, joined from the token-byte table."""
    n = max(ranks.values()) + 1
    size = np.zeros(n, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint8)
    for token, rank in ranks.items():
        flat[start[rank] : start[rank] + len(token)] = np.frombuffer(token, np.uint8)
    for batch in batches:
        data, offsets = C.column_bytes(batch.column(place).cast(pa.large_binary()))
        for i, j in C.runs(offsets):
            ids = data[offsets[i] : offsets[j]].view("<u4") if len(data) else np.empty(0, np.uint32)
            total = np.concatenate([[0], np.cumsum(size[ids])])
            cut = total[(offsets[i : j + 1] - offsets[i]) // 4]
            out = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cut), pa.py_buffer(gather(flat, start[ids], size[ids]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, out], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, ranks: dict[bytes, int], column: str = "ids") -> DataFrame:
    """encoded with a column decoded: the bytes of the ids by the token-byte table."""
    place = encoded.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(batches, ranks, place)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(work, f"{schema}, decoded binary")


def encode_digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    both = encode(docs, ranks, pattern, and_decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
