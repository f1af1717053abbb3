"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

The corpus is counted once; its most frequent words (white-space runs cut by the tokenizer's own
pre-tokenizer) and the whole words of the vocabulary are compiled, sorted, into a minimal acyclic automaton
whose states are shared by equal suffixes. Each transition stores how many words precede it, so the path of a
word adds up to its number, and the number's slice of a table holds the word's ids. The automaton is one
buffer of bounded size, broadcast, written once by each worker and memory-mapped. Words outside it
are merged exactly, lowest rank first; long ones by a heap, so that a word of any length takes little more than its length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import spread
from .store import Tables

#: So many of the corpus's most frequent words go into the automaton; it bounds the broadcast and has no effect on results.
FREQUENT = 50_000
#: Words counted before counts are passed on, words kept ready by a worker, and the longest kept, in bytes: they bound what is held.
COUNTED = 300_000
READY, READY_BYTES = 500_000, 64
#: Bytes from which a word is merged by a heap.
LONG = 48
#: Letters besides a-z that need no normalizing once lower-cased: one code point each, composed, in every Unicode version.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+\Z")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_MAGIC = b"MATL1\0\0\0"


class Transducer:
    """Words to id lists, read from a buffer made by ``compile_words``."""

    def __init__(self, buffer) -> None:
        view = memoryview(buffer)
        sizes = view[8:32].cast("I")
        at, parts = 32, []
        for n in sizes[:6]:
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.label, self.target, self.skip, self.ids_at, self.ids = parts
        self.root = sizes[0] - 2

    def get(self, word: bytes):
        """The ids of a word, or None if it isn't among the compiled ones."""
        first, label, target, skip = self.first, self.label, self.target, self.skip
        state, number = self.root, 0
        for b in word:
            end = first[state + 1] & 0x7FFFFFFF
            low = bisect_left(label, b, first[state] & 0x7FFFFFFF, end)
            if low == end or label[low] != b:
                return None
            number += skip[low]
            state = target[low]
        if not first[state] >> 31:
            return None
        return self.ids[self.ids_at[number] : self.ids_at[number + 1]]


def compile_words(words: dict[bytes, list[int]]) -> bytes:
    """The buffer of a minimal acyclic automaton over sorted words, with id outputs.

    States are made once their words are complete (all later words differ earlier), so an equal state made
    before is found by its transitions and shared.
    """
    order = sorted(words)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    count: list[int] = []

    def close(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, *edges)
        if (at := known.get(key)) is None:
            at = known[key] = len(states)
            states.append((final, edges))
            count.append(final + sum(count[t] for _, t in edges))
        return at

    path: list[list] = [[False, []]]
    before = b""
    for word in order:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        for depth in range(len(before), shared, -1):
            final, edges = path.pop()
            path[-1][1].append((before[depth - 1], close(final, edges)))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        final, edges = path.pop()
        path[-1][1].append((before[depth - 1], close(final, edges)))
    # The root comes last, whether an equal state exists or not.
    states.append((path[0][0], path[0][1]))
    first, label, target, skip = array("I"), array("I"), array("I"), array("I")
    for final, edges in states:
        first.append(len(label) | (0x80000000 if final else 0))
        passed = int(final)
        for b, t in edges:
            label.append(b)
            target.append(t)
            skip.append(passed)
            passed += count[t]
    first.append(len(label))
    ids_at, ids = array("I", [0]), array("I")
    for word in order:
        ids.extend(words[word])
        ids_at.append(len(ids))
    parts = [first, label, target, skip, ids_at, ids]
    return _MAGIC + array("I", [len(p) for p in parts]).tobytes() + b"".join(p.tobytes() for p in parts)


def mapped(buffer: bytes):
    """The buffer as a read-only mapping of a file without a name: it takes no Python memory and goes with the worker."""
    with tempfile.TemporaryFile() as f:
        f.write(buffer)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Encoder:
    """Ids of texts by a tokenizer file of the ``tokenizers`` library: BPE with word ends, without post-processing."""

    def __init__(self, spec: str, transducer: Transducer | None = None) -> None:
        from tokenizers import Tokenizer

        model = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.vocab = model["model"]["vocab"]
        self.suffix = model["model"].get("end_of_word_suffix") or ""
        self.pair: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, m in enumerate(model["model"]["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.pair[self.vocab[x], self.vocab[y]] = k
            self.made.append(self.vocab[x + y])
        # The byte letters of byte-level BPE: printable bytes stand for themselves, the others for 256 and up in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letters = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
        self.inner = [self.vocab[c] for c in self.letters]
        self.last = [self.vocab[c + self.suffix] for c in self.letters]
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.plain_form = self.suffix == "</w>" and (model.get("normalizer") or {}).get("type") == "Sequence" and [n["type"] for n in model["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.known: dict[bytes, bytes] = {}
        self.pieces = {i: p for p, i in self.vocab.items()} | {i: p for p, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.transducer = transducer
        self.ready: dict[bytes, bytes] = {}

    def words(self, chunk: bytes) -> list[bytes | int]:
        """The pre-tokenizer's words of a run without ASCII white space, as bytes; ids for special tokens.

        Runs of plain letters, digits and signs are cut here, all others by the library's normalizer and pre-tokenizer.
        """
        text, out = chunk.decode("utf-8"), []
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif self.plain_form and _PLAIN.match(part):
                out += [w.encode("utf-8") for w in _PLAIN_WORDS.findall(part.lower())]
            elif part:
                byte_of = self.byte_of
                out += [bytes([byte_of[c] for c in w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merges: the pair of lowest rank first, leftmost first."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) >= LONG:
            return self._merge_long(ids)
        rank, none = self.pair.get, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [self.made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap of rank * length + place; places are linked with those before and after them that still hold a piece."""
        n, rank = len(ids), self.pair.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r * n + k for k, p in enumerate(zip(ids, ids[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            best, at = divmod(heapq.heappop(heap), n)
            next_ = after[at]
            # An entry is stale where a piece went or changed since.
            if ids[at] < 0 or next_ >= n or rank((ids[at], ids[next_])) != best:
                continue
            ids[at], ids[next_] = self.made[best], -1
            after[at] = beyond = after[next_]
            if beyond < n:
                before[beyond] = at
                if (r := rank((ids[at], ids[beyond]))) is not None:
                    heapq.heappush(heap, r * n + at)
            if (prior := before[at]) >= 0 and (r := rank((ids[prior], ids[at]))) is not None:
                heapq.heappush(heap, r * n + prior)
        return [i for i in ids if i >= 0]

    def word(self, word: bytes) -> bytes:
        """Ids of one pre-tokenized word; those that don't make up a run by themselves are kept ready too."""
        found = self.transducer.get(word) if self.transducer else None
        return array("I", self.merge(word)).tobytes() if found is None else found.tobytes()

    def _known(self, word: bytes) -> bytes:
        known = self.known
        if len(word) > READY_BYTES:
            return self.word(word)
        if word not in known:
            if len(known) >= READY // 4:
                known.clear()
            known[word] = self.word(word)
        return known[word]

    def chunk(self, chunk: bytes) -> bytes:
        ready = self.ready
        if len(ready) >= READY:
            ready.clear()
        if len(chunk) > READY_BYTES:
            return b"".join([array("I", [w]).tobytes() if isinstance(w, int) else self._known(w) for w in self.words(chunk)])
        # Most runs are one word of small letters, perhaps with a stop behind it.
        bare = chunk[:-1] if chunk[-1:] in (b",", b".") else chunk
        if self.plain_form and bare.isalpha() and bare.islower():
            out = ready.get(bare)
            if out is None:
                out = ready[bare] = self.word(bare)
            if bare is not chunk:
                out = ready[chunk] = out + self._known(chunk[-1:])
            return out
        known = self._known
        out = ready[chunk] = b"".join([array("I", [w]).tobytes() if isinstance(w, int) else known(w) for w in self.words(chunk)])
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. White space of ASCII never reaches a token, so runs between it are encoded one by one."""
        ready, chunk = self.ready, self.chunk
        return b"".join([ready[w] if w in ready else chunk(w) for w in text.encode("utf-8").split()])

    def decode(self, ids: bytes) -> str:
        """As the library decodes without a decoder: the pieces with a blank between."""
        return " ".join(map(self.pieces.__getitem__, array("I", ids)))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of runs of up to 64 bytes; a bounded number of them is held."""
    from collections import Counter

    counts: Counter = Counter()

    def out():
        kept = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.binary()), pa.array([v for _, v in kept], pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            if (t := text.as_py()) is not None:
                counts.update(t.encode("utf-8").split())
                if len(counts) > COUNTED:
                    yield out()
    yield out()


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[bytes]:
    """The runs between white space that are the most frequent over all documents: those of at least the least frequency that at most ``most`` runs reach.

    The bound is found from the number of runs of each frequency, so no task and no stage sends the driver more than the runs it keeps.
    """
    tables = Tables(docs.sparkSession, "words")
    counted = docs.select(F.col(text_col)).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = tables.keep(counted.where((F.length("word") <= 64) & (F.col("n") > 1)))
    # Frequencies by their highest 8 binary digits: a few thousand rows, however large the corpus.
    rough = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 8, 0)), greatest(length(bin(n)) - 8, 0))")
    reached, least = 0, None
    for value, runs in sorted(((r[0], r[1]) for r in counted.groupBy(rough.alias("r")).count().collect()), reverse=True):
        reached += runs
        if reached > most:
            break
        least = value
    found = [] if least is None else [bytes(r[0]) for r in counted.where(F.col("n") >= least).select("word").collect()]
    tables.drop(counted)
    return sorted(found)


def compile_lexicon(spec: str, runs: list[bytes]) -> bytes:
    """The automaton of the words in frequent runs and of the vocabulary's whole words."""
    plain = Encoder(spec)
    own = {p[: -len(plain.suffix)].encode() for p in plain.vocab if plain.suffix and p.endswith(plain.suffix) and p.isascii() and p[: -len(plain.suffix)].isalpha()}
    cut = {w for run in runs for w in plain.words(run) if isinstance(w, bytes)}
    return compile_words({w: plain.merge(w) for w in own | cut})


_workers: dict[str, Encoder] = {}


def _encoder(spec, lexicon) -> Encoder:
    """One encoder for each tokenizer and lexicon in a worker, kept between tasks."""
    key = hashlib.sha256(spec.value.encode() + lexicon.value).hexdigest()
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(spec.value, Transducer(mapped(lexicon.value)))
    return _workers[key]


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids) for each row; with ``digests`` also ids_sha256 and decoded_sha256.

    Null and empty texts have no tokens; texts and words of any length are encoded whole; repeated rows are encoded each; other columns are ignored; no rows give no rows.
    ``tokenizer_file`` is read on the driver only.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_file, encoding="utf-8") as f:
        text = f.read()
    spec, lexicon = sc.broadcast(text), sc.broadcast(compile_lexicon(text, frequent_words(docs, text_col)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(spec, lexicon)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [enc.encode(t.as_py() or "") for t in part.column(1)]
                cols, names = [part.column(0), pa.array([len(x) // 4 for x in found], pa.int64())], ["id", "n_tokens"]
                if ids:
                    at = [0]
                    for x in found:
                        at.append(at[-1] + len(x) // 4)
                    values = pa.Array.from_buffers(pa.int32(), at[-1], [None, pa.py_buffer(b"".join(found))])
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values))
                    names.append("ids")
                if digests:
                    cols += [pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(enc.decode(x).encode("utf-8")).hexdigest() for x in found], pa.string())]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    form = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    form += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    form += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digests else []
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(form)).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null ids give null."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(spec.value)
        for batch in batches:
            out = [None if x.as_py() is None else enc.decode(array("I", x.as_py()).tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    form = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, form).withColumnRenamed("id", id_col)


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return encode_documents(docs, word_bpe_file(), digests=True, ids=False)
