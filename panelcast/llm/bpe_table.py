"""BPE encoding and decoding through a table of distinct words.

Texts are cut into the tokenizer's words once, on the executors.  The documents that a task
cuts one after another form a chunk: its distinct words, numbered, and every document's
words as their numbers, in order.  A grouped count over the chunks' words gives the table of
distinct words; the tokenizer encodes each of them once.  Ids come back to the chunks by
word: the commonest words (a table of at most ``HOT_WORDS`` rows) travel to every task, all
others come through a join on the word.  A cogroup by chunk puts the ids in the words'
places, by number.  Decoding takes every id's piece from an array of the vocabulary's pieces
in the task; that is not a DataFrame join.

Words of plain texts (ASCII and most letters of European languages) are found by an
equivalent regular expression; a text with any other character goes through the
tokenizer's own normaliser and splitter.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialize, materialize_by, shuffle_partitions

#: The most common words that are sent to every task (about 60 MB there).
HOT_WORDS = 400_000
#: A chunk ends with the document that brings it to so many distinct words, or words in all.
HELD_WORDS = 300_000
CHUNK_WORDS = 3 << 20
#: Rare words of a task that are asked for, or whose ids are handed on, at once.
ASKED_WORDS = 100_000
#: Words that are handed to the tokenizer library as one text.
RUN_WORDS = 2_000
#: Words of an output batch (more only where one document has more).
BATCH_WORDS = 1 << 18
#: Fixed values of the tokenizer file's splitting pattern: endings that are words of their own.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACES = "\t\n\r "


def _plain_characters(limit: int = 0x250) -> str:
    """Characters below ``limit`` that every Unicode version treats alike here: printable,
    composed, and with a lower case of one such character."""
    def fine(c: str) -> bool:
        return c in _SPACES or (unicodedata.category(c)[0] in "LNPS" and unicodedata.normalize("NFC", c) == c)

    chars = [chr(i) for i in range(limit) if fine(chr(i))]
    return "".join(c for c in chars if len(c.lower()) == 1 and c.lower() in chars)


class Words:
    """Cuts texts into the words of a tokenizer file; made anew in each Python worker."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends: np.ndarray | None = None
        special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        plain = _plain_characters()
        self.odd = re.compile(f"[^{re.escape(plain)}]")

        def group(kind: str) -> str:
            return re.escape("".join(c for c in plain if unicodedata.category(c)[0] == kind))

        self.pattern = re.compile(f"{ENDINGS}|[{group('L')}]+|[{group('N')}]|[^{_SPACES}{group('L')}{group('N')}]+")

    def _cut(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.pattern.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def cut(self, text: str | None) -> list[str]:
        text = text or ""
        if self.special is None or "<|" not in text:
            return self._cut(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self._cut(part)
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers.  Words go to the library
        as texts of many, separated by spaces, which are cut again after every piece that
        ends a word; a text whose ends do not match its words is encoded word by word."""
        if self.ends is None:
            pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
            self.ends = np.array([p.endswith("</w>") or bool(self.special and self.special.fullmatch(p)) for p in pieces])
        runs = [words[k:k + RUN_WORDS] for k in range(0, len(words), RUN_WORDS)]
        out: list[bytes] = []
        for run, made in zip(runs, self.tokenizer.encode_batch([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(run) and (not len(ids) or last[-1] == len(ids)):
                out += [part.tobytes() for part in np.split(ids, last[:-1])]
            else:
                alone = self.tokenizer.encode_batch(run, add_special_tokens=False)
                out += [np.array(e.ids, dtype="<u4").tobytes() for e in alone]
        return out


_MADE: dict[int, Words] = {}


def _words(spec: str) -> Words:
    key = hash(spec)
    if key not in _MADE:
        _MADE[key] = Words(spec)
    return _MADE[key]


def read_spec(path: str) -> str:
    """The tokenizer file's text (read on the driver; tasks get it with their code)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed byte by byte of all of them (the high ones are mostly zero)."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())


def _expand(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "u1").reshape(4, -1).T).view("<u4").ravel()


def _word_list(packed: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass").split(" ")


def chunks(docs: DataFrame, spec) -> DataFrame:
    """Documents, cut into words, in chunks.  A chunk has one row of documents (bucket is null):
    ``doc_ids``, the ``sizes`` of the documents in words, all their words in order as
    ``numbers``, and the ``counts`` of its distinct words.  Its other rows hold these words,
    each once, dealt to buckets by hash: ``words``, their ``counts`` and the ``place`` of the
    first in the chunk's counts.  A word's number is its rank by count (equal ones: by place)."""

    buckets = 4 * shuffle_partitions(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze = _words(spec.value), zstandard.ZstdCompressor(level=3)
        name, held = TaskContext.get().partitionId() << 32, 0
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        doc_ids: list[pa.Array] = []
        runs: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            seen = np.concatenate(runs)
            dealt: dict[int, list[str]] = {}
            for w in sorted(number):
                dealt.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
            placed = np.fromiter((number[w] for own in dealt.values() for w in own), "i8", len(number))
            counts = np.bincount(seen, minlength=len(number))[placed]
            rank = np.empty(len(number), "<u4")
            rank[placed[np.argsort(-counts, kind="stable")]] = np.arange(len(number))
            ends = np.cumsum([len(own) for own in dealt.values()], dtype="i8")
            starts = [0, *ends.tolist()][:len(dealt)]
            ids, rest = pa.concat_arrays(doc_ids), len(dealt)
            one = [0] * (rest + 1) + [len(runs)]
            return pa.RecordBatch.from_arrays([
                pa.array([name] * (rest + 1), pa.int64()),
                pa.array([*dealt, None], pa.int32()),
                pa.array([*(squeeze.compress(" ".join(own).encode("utf-8", "surrogatepass")) for own in dealt.values()), None], pa.binary()),
                pa.array([*(_squeeze(counts[a:b]) for a, b in zip(starts, ends, strict=True)), _squeeze(counts)], pa.binary()),
                pa.array([*starts, None], pa.int32()),
                pa.array([None] * rest + [_squeeze(rank[seen])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.array([len(r) for r in runs], pa.int64())),
                pa.ListArray.from_arrays(pa.array(one, pa.int32()), ids),
            ], names=["chunk", "bucket", "words", "counts", "place", "numbers", "sizes", "doc_ids"])

        for batch in batches:
            first = 0
            for k, text in enumerate(batch.column(1)):
                own = words.cut(text.as_py())
                runs.append(np.fromiter(map(number.__getitem__, own), "<u4", len(own)))
                held += len(own)
                if len(number) >= HELD_WORDS or held >= CHUNK_WORDS:
                    doc_ids.append(batch.column(0).slice(first, k + 1 - first))
                    yield out()
                    number.clear()
                    doc_ids.clear()
                    runs.clear()
                    name, held, first = name + 1, 0, k + 1
            if first < len(batch):
                doc_ids.append(batch.column(0).slice(first))
        if runs:
            yield out()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        cut, f"chunk long, bucket int, words binary, counts binary, place int, numbers binary, sizes array<long>, doc_ids array<{kind}>")


def word_table(chunks: DataFrame, spec) -> DataFrame:
    """(word, n, ids): every distinct word of the chunks, how often it occurs, and its ids,
    encoded once."""

    def merge(table: pa.Table) -> pa.Table:
        total = Counter()
        for packed, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total.update(dict(zip(_word_list(packed), _expand(counts).tolist(), strict=True)))
        own = list(total)
        return pa.table({"word": pa.array(own, pa.string()), "n": pa.array(list(total.values()), pa.int64()),
                         "ids": pa.array(_words(spec.value).encode(own), pa.binary())})

    packed = chunks.where("bucket IS NOT NULL").select("bucket", "words", "counts")
    return packed.groupBy("bucket").applyInArrow(merge, "word string, n long, ids binary")


def _hot_count(table: DataFrame, most: int) -> int:
    """The least count of a common word, such that at most ``most`` words are common."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["b"], r["k"]) for r in table.groupBy(step.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None  # at most 16 rows for each power of two that a count can have
    for b, k in sizes:
        if total + k > most:
            break
        total, least = total + k, b
    return 1 << 62 if least is None else int(np.ceil(2 ** (least / 16) - 1e-9))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text.  The key is a hash of id and text, so that what meets under it is
    one document's own distinct words however often the id occurs.  (Two texts with one hash
    would get both their words' ids, which changes no result.)"""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


def encode(docs: DataFrame, path: str, hot_words: int = HOT_WORDS, decode: bool = True) -> DataFrame:
    """``doc_id``, n_tokens, ids (binary: little-endian unsigned 32-bit) and, with ``decode``,
    decoded: the text that the ids give back, special tokens included.

    Same ids as the tokenizers library gives for the file at ``path`` without added special
    tokens, truncation or padding.

    Defined cases: null and empty texts have no tokens and decode to the empty text; special
    tokens written in a text are their own ids; rows that share an id are encoded each by
    its own text; a null id is kept; an empty table gives no rows; other columns are not
    read.  ``docs`` is read once.
    """
    spark = docs.sparkSession
    text = read_spec(path)
    spec = spark.sparkContext.broadcast(text)  # one tokenizer file: a fixed size
    size = max(json.loads(text)["model"]["vocab"].values()) + 1
    kind = dict(docs.dtypes)["doc_id"]
    cut = materialize_by(chunks(docs, spec), "chunk")
    table = materialize(word_table(cut, spec))
    least = _hot_count(table, hot_words)
    found = table.where(F.col("n") >= least).select("word", "ids").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)))
    del found

    answer = "chunk long, steps binary, lengths binary, ids binary"

    def answers_of(rows: list[tuple]) -> pa.RecordBatch:
        """Rows of (chunk, places in rising order, ids of each): the ids of some of a chunk's words."""
        squeeze = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([
            pa.array([chunk for chunk, _, _ in rows], pa.int64()),
            pa.array([_squeeze(np.diff(places, prepend=0)) for _, places, _ in rows], pa.binary()),
            pa.array([_squeeze(np.array([len(i) // 4 for i in ids])) for _, _, ids in rows], pa.binary()),
            pa.array([squeeze.compress(b"".join(ids)) for _, _, ids in rows], pa.binary()),
        ], names=["chunk", "steps", "lengths", "ids"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            found: list[tuple] = []
            for chunk, packed, place in zip(*batch.columns, strict=True):
                ids = [known.get(w) for w in _word_list(packed.as_py())]
                here = np.flatnonzero([i is not None for i in ids])
                if len(here):
                    found.append((chunk.as_py(), place.as_py() + here, [i for i in ids if i is not None]))
            yield answers_of(found)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other word of a chunk."""
        known = hot.value
        names: list[int] = []
        places: list[int] = []
        asked: list[str] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(places, pa.int32()), pa.array(asked, pa.string())],
                                              names=["chunk", "place", "word"])

        for batch in batches:
            for chunk, packed, place in zip(*batch.columns, strict=True):
                found = [(n, w) for n, w in enumerate(_word_list(packed.as_py()), place.as_py()) if w not in known]
                names += [chunk.as_py()] * len(found)
                places += [n for n, _ in found]
                asked += [w for _, w in found]
                if len(asked) >= ASKED_WORDS:
                    yield out()
                    names, places, asked = [], [], []
        yield out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers to rare words, those of one chunk together."""
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by([("chunk", "ascending"), ("place", "ascending")])
            chunk, place, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_pylist()
            ends = [*(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            return answers_of([(int(chunk[a]), place[a:b], ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)])

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= ASKED_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    words = cut.where("bucket IS NOT NULL").select("chunk", "words", "place")
    others = table.where(F.col("n") < least).select("word", "ids")
    asked = words.mapInArrow(rare, "chunk long, place int, word string")
    answers = (asked.join(others, "word").select("chunk", "place", "ids").mapInArrow(gather, answer)
               .unionByName(words.mapInArrow(common, answer)))

    def assemble(own: pa.Table, answers: pa.Table) -> pa.Table:
        """The documents of a chunk, each word's ids put in its places."""
        words, expand = _words(spec.value), zstandard.ZstdDecompressor()
        last = max(size, words.tokenizer.get_vocab_size(with_added_tokens=True))
        piece = pa.array([words.tokenizer.id_to_token(i) or "" for i in range(last)], pa.string())
        flat = np.frombuffer(b"".join(map(expand.decompress, answers.column("ids").to_pylist())), "<u4")
        none = np.empty(0, "i8")
        place = np.concatenate([none, *(np.cumsum(_expand(x)) for x in answers.column("steps").to_pylist())]).astype("i8")
        length = np.concatenate([none, *map(_expand, answers.column("lengths").to_pylist())]).astype("i8")
        if not np.array_equal(np.sort(place), np.arange(len(place))):
            raise ValueError("a chunk's words were not each answered once")
        start_at, length_at = np.empty_like(place), np.empty_like(place)
        start_at[place], length_at[place] = np.cumsum(length) - length, length
        schema = pa.schema([("doc_id", own.schema.field("doc_ids").type.value_type), ("n_tokens", pa.int64()), ("ids", pa.binary())]
                           + [("decoded", pa.string())] * decode)
        out = []
        for row in range(len(own)):
            doc_ids, sizes = own.column("doc_ids")[row].values, own.column("sizes")[row].values.to_numpy()
            seen = _expand(own.column("numbers")[row].as_py())
            order = np.argsort(-_expand(own.column("counts")[row].as_py()).astype("i8"), kind="stable")
            start_of, length_of = start_at[order], length_at[order]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + BATCH_WORDS, "right")) - 1)
                part = seen[ends[a]:ends[b]]
                n = length_of[part]
                to = np.concatenate([[0], np.cumsum(n)])
                ids = flat[np.repeat(start_of[part] - to[:-1], n) + np.arange(to[-1])]
                bounds = to[ends[a:b + 1] - ends[a]]  # of the documents, in ids
                columns = [doc_ids.slice(a, b - a), pa.array(np.diff(bounds)),
                           pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * bounds).astype("<i4")), pa.py_buffer(ids)])]
                if decode:
                    columns.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), piece.take(pa.array(ids))), " "))
                out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
                a = b
        return pa.Table.from_batches(out, schema)

    rows = cut.where("bucket IS NULL").select("chunk", "counts", "numbers", "sizes", "doc_ids")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        assemble, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decode)
