"""Packing tokens into sequences by deficit round-robin over source queues.

In every round each source's deficit counter grows by its quantum, its target share of one sequence, and the
source sends the packets its counter covers; what is left over stays in the counter. A packet that ends at
the source's cumulative token c is therefore sent in round ceil(c / quantum), whatever came before, so
rounds are computed for all packets at once and no counter has to be handed from window to window or from
task to task. The packets in round order are one token stream, cut into sequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablewright.llm.common import WHITE, Scratch, col, whole_text
from tablewright.llm.curriculum import running_words

# Words of these characters are lower-cased and cut by the pattern below as by the tokenizer itself.
PLAIN = re.compile("[!-~\xa1\xab\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
# The pieces and the closing mark of the tokenizer's file, the pieces on the characters above.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")
CLOSING = "</w>"
END_ID = 2
SEQUENCE, PACKET = 4096, 1024
# Rounds whose packets one task adds up: about four million tokens.
BLOCK_ROUNDS = 1024
# Words known at a time, and as many again that were known before them.
CACHED_WORDS = 400_000
# Text whose words one call counts together.
TEXT_BYTES = 8_000_000


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit integers.

    Where the tokenizer drops white space and never joins what it parts, a text's ids are its words' ids, and the distinct
    words of many texts are encoded once per worker, as far as the cache goes: plain ones as the pieces into which the
    tokenizer cuts them, many pieces in one call, others each alone. Any other tokenizer reads whole texts.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end], "<u4").tobytes()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith(CLOSING)]] = True
        self.by_word = self.cuts_as_stated()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [code.ids for code in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts_as_stated(self) -> bool:
        """Whether white space is dropped and words are cut as by ``PIECES``, tried on all pairs of plain characters."""
        plain = [c for c in map(chr, range(256)) if PLAIN.fullmatch(c)]
        words = [a + b for a in plain for b in plain] + [a + mark + a for a in "aB1.\xe9" for mark in ("'s", "'T", "'re", "'ve", "'m", "'ll", "'d", "''")]
        parts = [PIECES.findall(w.lower()) for w in words]
        pieces = sorted({p for some in parts for p in some})
        of = dict(zip(pieces, self.ids(pieces), strict=True))
        if any(whole != [i for p in some for i in of[p]] for whole, some in zip(self.ids(words), parts, strict=True)):
            return False
        if any(not self.closing[of[p][-1:]].all() or self.closing[of[p][:-1]].any() for p in pieces):
            return False
        apart = self.ids(["ab", "ba"])
        return all(found == apart[0] + apart[1] for found in self.ids([x + "ab" + c + x + "ba" + x for c in WHITE for x in ("", *WHITE)]))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of texts and their numbers; words end at blanks, tabs, line breaks, vertical tabs and form feeds."""
        if not self.by_word:
            whole = [t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
            found = [np.array(ids, "<u4").tobytes() + self.end for ids in self.ids(whole)]
            return pa.array(found, pa.binary()), np.array([len(b) // 4 for b in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        codes = [*self.codes(words.dictionary.to_pylist()), self.end]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        table, firsts = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(sizes) - sizes
        # The end id follows the last word of each text as a word of its own.
        ends = np.diff(split.offsets.to_numpy()).cumsum()
        order = np.insert(words.indices.to_numpy(), ends, len(codes) - 1)
        lengths = sizes[order]
        stops = np.cumsum(lengths)
        ids = table[np.repeat(firsts[order] - stops + lengths, lengths) + np.arange(stops[-1])]
        offsets = np.concatenate([[0], stops[ends + np.arange(len(ends))]])
        found = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids)])
        return found, np.diff(offsets)

    def codes(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, an empty one included."""
        if len(self.known) > CACHED_WORDS:
            self.before, self.known = self.known, {}
        known = self.known
        cut: dict[bytes, list[bytes]] = {}
        pieces: set[bytes] = set()
        alone: list[bytes] = []
        for word in self.unknown(words):
            if word.isalpha():  # of bytes: ASCII letters only, one piece
                cut[word] = [word.lower()]
            elif PLAIN.fullmatch(text := word.decode("utf-8", "replace")) and "<|" not in text:
                cut[word] = [p.encode() for p in PIECES.findall(text.lower())]
            else:
                alone.append(word)
                continue
            pieces.update(cut[word])
        for i in range(0, len(alone), 10_000):
            some = alone[i : i + 10_000]
            for word, ids in zip(some, self.ids([w.decode("utf-8", "replace") for w in some]), strict=True):
                known[word] = np.array(ids, "<u4").tobytes()
        self.encode_pieces(self.unknown(pieces))
        for word, parts in cut.items():
            known[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        return [known[w] for w in words]

    def unknown(self, words: Iterable[bytes]) -> list[bytes]:
        """Those that have to be encoded. What was last met before the cache was full comes along into the new one."""
        missing = [w for w in words if w not in self.known]
        self.known.update((w, code) for w in missing if (code := self.before.get(w)) is not None)
        return [w for w in missing if w not in self.known]

    def encode_pieces(self, pieces: list[bytes]) -> None:
        """Encodes pieces as one text; each ends with a token that closes a piece, and no other of its tokens does."""
        for i in range(0, len(pieces), 1000):
            some = pieces[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.closing[ids]) + 1) * 4
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not close each piece with a token of its own")
            codes, start = ids.tobytes(), 0
            for piece, stop in zip(some, stops.tolist(), strict=True):
                self.known[piece] = codes[start:stop]
                start = stop


@lru_cache(1)
def worker_encoder(path: str, end: int) -> Encoder:
    """One encoder, with its bounded cache, for all tasks that a Python worker runs one after another."""
    return Encoder(path, end)


def encode_documents(docs: DataFrame, key: str, text: str, source: str, path: str | None, end: int) -> DataFrame:
    """``doc_id, source, size, ids`` per document, with the end id; the path is resolved where the task runs."""
    rows = docs.select(col(key).alias("doc_id"), col(source).cast("string").alias("source"), whole_text(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(path or word_bpe_path(), end)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            # Some megabytes of text at a time: the ids of a batch of very long texts need not be held together.
            group = (np.cumsum(sizes, dtype=np.int64) - sizes) // TEXT_BYTES
            borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(borders, borders[1:]):
                if start == stop:
                    continue
                # A copy of its own: Arrow's split looks at all of a slice's buffer.
                ids, counts = encoder.encode(pa.concat_arrays([texts.slice(start, stop - start)]))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(counts, pa.int64()), ids], ["doc_id", "source", "size", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, source string, size long, ids binary")


def pack(docs: DataFrame, weights: dict[str, float] | None = None, path: str | None = None, end: int = END_ID, sequence: int = SEQUENCE, packet: int = PACKET,
         key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    All tokens of all documents are packed, each once. Sources have token shares by ``weights`` (default: by
    their own tokens, so that all queues last to the end); a source without a weight has weight 1, null is a
    source. When a queue is empty the others go on, so late sequences hold what is left. A document is
    sent in packets of at most ``packet`` tokens, in order, and a packet is cut only where a sequence is
    full. Only the last sequence is padded. Null and empty texts are one piece, the end id. Rows that
    repeat an id are documents of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    encoded = encode_documents(docs, key, text, source, path, end).withColumn("row", F.monotonically_increasing_id())
    encoded = scratch.put("ids", encoded)
    sized = scratch.put("sized", encoded.select("row", "doc_id", "source", "size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("tokens"))
    weight = F.col("tokens").cast("double")
    if weights is not None:
        weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(1.0))
    share = weight / F.sum(weight).over(Window.partitionBy(F.lit(1)))
    quanta = totals.select("source", (share * sequence).alias("quantum"))
    running = running_words(sized, sized.count(), "row").alias("r")
    queued = running.join(quanta.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source"))).select("r.*", "quantum")
    packets = queued.select("row", "doc_id", "source", "size", "before", "quantum", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(packet))).alias("start"))
    packets = packets.withColumn("length", F.least(F.lit(packet), F.col("size") - F.col("start")))
    packets = packets.withColumn("round", F.ceil((F.col("before") + F.col("start") + F.col("length")) / F.col("quantum")))
    packets = packets.withColumn("block", F.floor(F.col("round") / BLOCK_ROUNDS))
    blocks = packets.groupBy("block").agg(F.sum("length").alias("tokens"))
    offsets = blocks.select("block", F.coalesce(F.sum("tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("round", "source", F.col("before") + F.col("start")).rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("inner", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(offsets, "block").withColumn("at", F.col("base") + F.col("inner"))
    # A packet lies in one sequence or in two.
    room = F.lit(sequence) - F.pmod("at", F.lit(sequence))
    first, rest = F.least("length", room), F.greatest(F.lit(0), F.col("length") - room)
    piece = lambda start, length, at: F.struct(start.alias("start"), length.cast("long").alias("length"), F.floor(at / sequence).alias("sequence_id"), F.pmod(at, F.lit(sequence)).alias("offset"))
    both = F.array(piece(F.col("start"), first, F.col("at")), piece(F.col("start") + room, rest, F.col("at") + room))
    pieces = placed.select("row", F.inline(both)).where("length > 0")
    ids = encoded.select("row", "doc_id", F.col("size").alias("doc_tokens"), "ids")
    own = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.join(ids, "row").select("doc_id", "start", "length", F.crc32(own).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    return pack(table(spark, folder, "documents"))
