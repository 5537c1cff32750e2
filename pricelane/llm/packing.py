"""Packing documents into sequences by bounded-space online best fit.

Pieces of documents are dealt to streams by a hash and arrive the longest first. A stream keeps a fixed
number of open bins in a bitset keyed by free space: the lowest set bit at or above a piece's length is
the best fit, found with a shift. If no bin fits, a new one opens; if too many are open, the fullest
closes first. A stream has tokens for about as many bins as may be open, so few close before short
pieces have filled them. Streams are packed in parallel, and their number grows with the input.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from pricelane.llm.work import written

SLICE = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHED_WORDS = 400_000


#: Words of printable ASCII and of Latin letters with one code point each, which no normal form changes.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u024f]+")


class Store:
    """Lists of ids under the numbers of the keys that have them."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New keys, with all their ids in a row and the number of ids of each."""
        count = len(self.known)
        used = self.ends[count]
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while count + len(keys) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used:used + len(ids)] = ids
        self.ends[count + 1:count + 1 + len(keys)] = used + np.cumsum(sizes)
        self.known.update(zip(keys, range(count, count + len(keys))))

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter((self.known[k] for k in keys), np.int64, len(keys))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the keys in a row, and the bounds of the keys."""
        first = self.ends[numbers]
        after = np.r_[0, np.cumsum(self.ends[numbers + 1] - first)]
        place = np.repeat(first - after[:-1], np.diff(after)) + np.arange(after[-1])
        return self.flat[place], after


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across ASCII white space. Texts consist of few
    words often, so each distinct word is encoded once and remembered.

    Most of the time of an encoding goes into normalising and cutting a word while keeping track of
    offsets. If the tokenizer cuts words by a pattern into pieces that end with a marked token, plain
    words are cut with that pattern here, and distinct pieces are encoded many at a time: the marked
    tokens show where each ends. All other words go through the whole tokenizer one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.pieces_of = self._pattern(json.loads(self.encoder.to_str()))
        if self.pieces_of:
            self.model = Tokenizer(self.encoder.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            last = [i for token, i in self.encoder.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]
            self.last = np.zeros(max(last) + 1, bool)
            self.last[last] = True
        self.words, self.parts = Store(), Store()

    @staticmethod
    def _pattern(parts: dict):
        """How words are cut, or None if the tokenizer does it in a way not known here."""
        kinds = [n.get("type") for n in (parts["normalizer"] or {}).get("normalizers", [])]
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]
                or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True) or steps[1]["use_regex"]
                or steps[1]["add_prefix_space"] or parts["model"].get("end_of_word_suffix") != "</w>"):
            return None
        return regex.compile(steps[0]["pattern"]["Regex"]).findall

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.pieces_of and PLAIN.fullmatch(w)]
        cut = [self.pieces_of(w.lower()) for w in plain]
        new = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.parts.known]
        if new:
            codes = self.model.encode_batch_fast([" ".join(new[i:i + 500]) for i in range(0, len(new), 500)],
                                                 add_special_tokens=False)
            ids = np.concatenate([np.array(c.ids, np.uint32) for c in codes])
            ends = np.flatnonzero(self.last[ids]) + 1
            self.parts.add(new, ids, np.diff(np.r_[0, ends]))
        if plain:
            ids, after = self.parts.ids(self.parts.numbers(list(chain.from_iterable(cut))))
            ends = after[np.cumsum([len(c) for c in cut])]
            self.words.add(plain, ids, np.diff(np.r_[0, ends]))
        odd = [w for w in words if w not in self.words.known]
        if odd:
            found = [c.ids for c in self.encoder.encode_batch_fast(odd, add_special_tokens=False)]
            self.words.add(odd, np.fromiter(chain.from_iterable(found), np.uint32),
                           np.array([len(f) for f in found], np.int64))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers under which the ids of distinct words are remembered."""
        new = [w for w in words if w not in self.words.known]
        if len(self.words.known) + len(new) > CACHED_WORDS and self.words.known:
            self.words, self.parts, new = Store(), Store(), words
        self._learn(new)
        return self.words.numbers(words)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by `end_id`, and the bounds of the texts."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        number = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)] \
            if len(words) else np.zeros(0, np.int64)
        found, after = self.words.ids(number)
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        ends = after[offsets] + np.arange(len(texts) + 1)
        ids = np.full(ends[-1], end_id, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[ends[1:] - 1] = False
        ids[inside] = found
        return ids, ends


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text each; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield at, to
        at = to


def pieces(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32, and the ids if asked for. Only documents of more than `limit` ids are cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(tokenizer)
        for batch in batches:
            owner, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for low, high in slices(texts):
                ids, ends = encode(texts.slice(low, high - low), end_id)
                size = np.diff(ends)
                cuts = -(-size // limit)
                doc = np.repeat(np.arange(high - low), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * limit
                length = np.minimum(limit, size[doc] - start)
                first = ends[doc] + start
                crc = [zlib.crc32(ids[a:a + n].astype("<u4", copy=False)) for a, n in zip(first, length)]
                columns = [owner.take(pa.array(doc + low)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:a + n].astype(np.int32) for a, n in zip(first, length)],
                                            pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + ", ids array<int>" * with_ids
    names = [field.split()[0] for field in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class OpenBins:
    """A stream's open bins. `free` is a bitset of the free spaces that open bins have."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.free, self.bins = 0, [[] for _ in range(limit + 1)]
        self.opened = self.open = 0

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.limit, self.opened
            self.opened += 1
        if left := space - length:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.limit - space


def pack(rows: DataFrame, limit: int = 4096, open_bins: int = 4096,
         stream_bins: int = 4096) -> DataFrame:
    """`rows` (the columns of pieces()) with sequence_id and offset. No piece is cut or dropped; a
    sequence holds `limit` ids at most, its pieces follow each other without gaps."""
    tokens = rows.agg(F.sum("length")).first()[0] or 0
    streams = max(1, -(-tokens // (limit * stream_bins)))
    parts = min(streams, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = rows.select("*", order.alias("tie")) \
        .withColumn("stream", F.pmod(F.shiftrightunsigned("tie", 20), F.lit(streams)))
    dealt = dealt.repartition(parts, "stream").sortWithinPartitions(
        "stream", F.desc("length"), "tie", *(c for c in rows.columns if c not in ("ids", "length")))
    at, size = dealt.columns.index("stream"), dealt.columns.index("length")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for stream, length in zip(batch.column(at).to_pylist(), batch.column(size).to_pylist()):
                if stream != now:
                    now, bins = stream, OpenBins(limit, open_bins)
                number, place = bins.put(length)
                sequence.append(stream << 32 | number)
                offset.append(place)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """The pieces of all rows of `docs` (doc_id, text; other columns are ignored) with their places.

    A null or empty text is the end id alone. Repeated rows and rows without a doc_id are documents of
    their own. An empty table gives no rows.
    """
    return pack(written(pieces(docs, tokenizer, limit), "pieces"), limit)


def sequences(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """sequence_id, ids and documents (doc_id, piece, offset, length) of every packed sequence."""
    placed = pack(written(pieces(docs, tokenizer, limit, with_ids=True), "pieces"), limit)
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    # a sequence has at most `limit` ids
    return placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"]))
        .alias("documents"))
