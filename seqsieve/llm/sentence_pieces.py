"""SentencePiece encoding and decoding: each distinct marked word of a task is segmented once, its ids are joined back by position."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, pieces

MARK = "▁"
#: Distinct chunks of a task's table, some 150 MB; a full one is begun anew.
MOST_CHUNKS = 1 << 19
#: Longer chunks are segmented by themselves.
LONG = 64
NONE = float("-inf")


class Model:
    """Pieces of a BPE model file with identity normalisation, markers before words and byte fallback."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(raw)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation and markers before words are read")
        self.dummy_prefix, self.unknown = norm.add_dummy_prefix, train.unk_surface
        self.labels: list[str | None] = []  # None: a byte
        self.bytes: dict[int, int] = {}
        self.byte_ids = [-1] * 256
        self.ranked: dict[str, tuple[float, int]] = {}  # pieces that merges can give, with score and id
        self.unk_id = 0
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[i] = value
                self.byte_ids[value] = i
                self.labels.append(None)
            elif p.type == kinds.NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"piece {i} reaches over a marker, so words can't be segmented by themselves")
                self.ranked[p.piece] = (p.score, i)
                self.labels.append(p.piece.replace(MARK, " "))
            elif p.type == kinds.CONTROL:
                self.labels.append("")
            elif p.type == kinds.UNKNOWN:
                self.unk_id = i
                self.labels.append(self.unknown)
            else:
                raise ValueError(f"piece {i} is of a kind that isn't read")
        self.numbers = [str(i) for i in range(len(self.labels))]
        # for segment_all(): ids of single letters, and sorted pairs of pieces with their join's score and id
        self.letter = np.full(0x110000, -1, np.int32)
        pairs = []
        for p, (score, i) in self.ranked.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
            for at in range(1, len(p)):
                if (a := self.ranked.get(p[:at])) and (b := self.ranked.get(p[at:])):
                    pairs.append((a[1] << 32 | b[1], score, i))
        pairs = sorted(pairs) or [(-1, NONE, -1)]
        self.pair_key, self.pair_score, self.pair_id = (np.array([x[j] for x in pairs], t) for j, t in enumerate((np.int64, np.float64, np.int32)))
        # letters of longer pieces join their neighbours; all others stand alone, so that a chunk ends at them. A chunk starts
        # with all of its markers: no piece has a marker behind another letter, so none reaches over a chunk's end
        joined = "".join(map(re.escape, sorted(set("".join(p for p in self.ranked if len(p) > 1)) - {MARK})))
        self.chunked = re.compile(f"{MARK}+[{joined}]*|[{joined}]+|[^{MARK}{joined}]" if joined else f"{MARK}+|[^{MARK}]").findall

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text, in order; an empty text has none."""
        if not text:
            return []
        return self.chunked((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk: of all neighbours whose join is a piece those of the best score are joined first, the leftmost of
        equals; letters that are no piece become their bytes. Time grows with n log n."""
        ranked, parts, n = self.ranked, list(chunk), len(chunk)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if found := ranked.get(parts[i] + parts[i + 1]):
                heap.append((-found[0], i, len(parts[i]) + len(parts[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two was joined to another since
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranked.get(parts[i] + parts[k]):
                    heapq.heappush(heap, (-found[0], i, len(parts[i]) + len(parts[k])))
            h = before[i]
            if h >= 0 and (found := ranked.get(parts[h] + parts[i])):
                heapq.heappush(heap, (-found[0], h, len(parts[h]) + len(parts[i])))
        out: list[int] = []
        for p in parts:
            if found := ranked.get(p):
                out.append(found[1])
            elif p:
                ids = [self.byte_ids[b] for b in p.encode()]
                out += ids if min(ids) >= 0 else [self.unk_id]
        return out

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the pieces that pairs of ids join to; NONE where they join to none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_key, key).clip(max=len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_score[at], NONE), self.pair_id[at]

    def segment_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many chunks end to end, and how many each has: as segment(), a join in every chunk at a time."""
        alone = {i: self.segment(c) for i, c in enumerate(chunks) if len(c) > LONG}
        lens = np.array([0 if i in alone else len(c) for i, c in enumerate(chunks)], np.int64)
        letters = np.frombuffer("".join(c for i, c in enumerate(chunks) if i not in alone).encode("utf-32-le"), "<u4")
        own, ids = np.repeat(np.arange(len(chunks)), lens), self.letter[letters]
        for i in np.unique(own[ids < 0]).tolist():  # letters that are no piece become bytes
            alone[i] = self.segment(chunks[i])
        keep = ~np.isin(own, list(alone))
        own, ids = own[keep], ids[keep]
        done = [(np.repeat(list(alone), [len(v) for v in alone.values()]).astype(np.int64), np.array([x for v in alone.values() for x in v], np.int32))]
        score, joined = np.full(len(own), NONE), np.zeros(len(own), np.int32)
        inner = np.flatnonzero(own[:-1] == own[1:])
        score[inner], joined[inner] = self._joins(ids[inner], ids[inner + 1])
        while len(own):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.repeat(np.maximum.reduceat(score, starts), np.diff(np.r_[starts, len(own)]))
            ended = best == NONE
            done.append((own[ended], ids[ended]))
            own, ids, score, joined, best = (x[~ended] for x in (own, ids, score, joined, best))
            hit = np.flatnonzero(score == best)
            hit = hit[np.r_[True, own[hit][1:] != own[hit][:-1]]] if len(hit) else hit  # the leftmost of each chunk
            ids[hit] = joined[hit]
            gone = np.zeros(len(own), bool)
            gone[hit + 1] = True
            own, ids, score, joined = (x[~gone] for x in (own, ids, score, joined))
            hit -= np.arange(len(hit))  # one letter went before each later one
            for left in (hit, hit[(hit > 0)] - 1):
                inside = left[left + 1 < len(own)]
                score[left] = NONE
                inside = inside[own[inside] == own[inside + 1]]
                score[inside], joined[inside] = self._joins(ids[inside], ids[inside + 1])
        own, ids = (np.concatenate([d[j] for d in done]) for j in (0, 1))
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(chunks))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: labels joined, runs of bytes read as UTF-8 (each byte that is part of no letter: U+FFFD); of the
        markers at the start one is the prefix that encoding adds, and goes."""
        labels, out, run, seen = self.labels, [], bytearray(), not self.dummy_prefix
        if seen or not ids:
            start = 0
        else:  # the prefix is looked for until something is put out
            start = 0
            while start < len(ids) and labels[ids[start]] == "":
                start += 1
            if start < len(ids) and (first := labels[ids[start]]) is not None and ids[start] != self.unk_id and first.startswith(" "):
                out.append(first[1:])
                start += 1
        try:
            return "".join(out + [labels[i] for i in ids[start:]])
        except TypeError:  # there are bytes
            pass
        for i in ids[start:]:
            if (label := labels[i]) is None:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(utf8(run))
                run.clear()
            out.append(label)
        return "".join([*out, utf8(run)])


def utf8(run: bytearray) -> str:
    """Bytes as text; each byte that no letter can be made of stands for itself as U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, Model] = {}


def _model(shared) -> Model:
    """One per Python worker; shared is a broadcast (digest, file)."""
    digest, raw = shared.value
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Model(raw)
    return _LOADED[digest]


def load(spark: SparkSession, path: str):
    """The model file, read by the driver and broadcast: half a MB, whatever the tables hold."""
    with open(path, "rb") as f:
        raw = f.read()
    Model(raw)  # refuse on the driver what can't be used
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


class Chunks(dict):
    """A table of distinct chunks: their numbers by chunk, and by number where their ids stand and how many they are. A chunk is
    segmented once, when it first occurs."""

    def __init__(self, model: Model):
        self.model, self.flat, self.sizes = model, array("i"), array("i")

    def learn(self, chunks: list[str]) -> None:
        """Takes in chunks that aren't there yet, each once."""
        new = [c for c in dict.fromkeys(chunks) if c not in self]
        if new:
            ids, sizes = self.model.segment_all(new)
            self.flat.frombytes(ids.astype(np.int32).tobytes())
            self.sizes.frombytes(sizes.astype(np.int32).tobytes())
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of chunks given by number, end to end."""
        sizes = np.array(self.sizes, np.int64)
        starts, n = np.cumsum(sizes) - sizes, sizes[slots]
        to = np.cumsum(n)
        return np.array(self.flat, np.int32)[np.repeat(starts[slots] - to + n, n) + np.arange(to[-1] if len(to) else 0)]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of docs but the text and one of the name `out`, then `out`: array of token ids, as the library gives them
    without begin and end. Null and empty texts give an empty array; repeated rows and null keys stay as they are.

    A task's texts become numbers into its table of distinct chunks; each chunk is segmented once for the table, and ids take the
    numbers' places for some MB of text at a time. Nothing is shuffled; the table is of bounded size."""
    shared, keep = load(docs.sparkSession, path), [c for c in docs.columns if c not in (text, out)]

    def run(batches):
        model = _model(shared)
        table = Chunks(model)
        for batch in pieces(batches, text):
            if len(table) >= MOST_CHUNKS:
                table = Chunks(model)
            chunks, counts = [], [0]
            for x in batch.column(text).to_pylist():
                chunks += (own := model.chunks(x or ""))
                counts.append(len(own))
            table.learn(chunks)
            at = np.fromiter(map(table.__getitem__, chunks), np.int32, len(chunks))
            ends = np.concatenate(([0], np.cumsum(np.array(table.sizes, np.int64)[at])))[np.cumsum(counts)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(table.ids(at), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], names=[*keep, out])

    picked = docs.select(*keep, text)
    return picked.mapInArrow(run, T.StructType([*picked.select(*keep).schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decoded(tokens: DataFrame, path: str, ids: str = "ids", finish=None, ddl: str = "text string") -> DataFrame:
    """All other columns, then the text of each row's ids (null: empty). With finish, a function of (model, ids, text) that
    returns a tuple, its values as the columns of ddl take the text's place, so that long texts needn't be returned."""
    shared, keep = load(tokens.sparkSession, path), [c for c in tokens.columns if c != ids]
    more = T.StructType.fromDDL(ddl)
    keep = [c for c in keep if c not in more.names]
    kinds = [to_arrow_type(f.dataType) for f in more]
    finish = finish or (lambda model, ids, text: (text,))

    def run(batches):
        model = _model(shared)
        for batch in batches:
            lists = batch.column(ids)
            for at in range(0, len(lists), 256):
                rows = [finish(model, x or [], model.decode(x or [])) for x in lists.slice(at, 256).to_pylist()]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, 256) for c in keep] + made, names=[*keep, *more.names])

    picked = tokens.select(*keep, ids)
    return picked.mapInArrow(run, T.StructType([*picked.select(*keep).schema, *more]))


def default_model() -> str:
    """The place of the public model file that is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _digests(model: Model, ids: list[int], text: str) -> tuple:
    numbers = model.numbers
    return len(ids), hashlib.sha256(",".join([numbers[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_model()
    ids = encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    return decoded(ids, path, finish=_digests, ddl="n_tokens long, ids_sha256 string, decoded_sha256 string")
