"""BPE encoding and decoding with an automaton that is compiled from the merges."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import KEPT, documents, pieces

WORD_END = "</w>"
INNER, LAST = -1, -2
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton over tokens that accepts just the token sequences that the merges give.

    It starts as one state with an arc for each byte (with and without a word's end). A merge (u, v) -> w of rank r is a
    gadget on the state that u's arcs lead to: a copy of it without the arc v takes over u's arcs, and beside each of those
    arcs stands a new arc w that leads where v led. So a state belongs to the token read last: w's state begins as v's at
    that rank, and an arc w exists where an arc u does. Kept are each token's parts and rank and the arcs cut per token
    (`cut[u][v] = r`); `allows(a, b)` reads off whether b's arc leaves a's state, and remembers it as the transition table.
    """

    #: Entries of the transition table that are kept at a time, about 25 MB.
    MOST_PAIRS = 250_000

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.labels: dict[int, str] = {i: t for t, i in vocabulary.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.cut: dict[int, dict[int, int]] = {}
        self.table: dict[int, bool] = {}
        # arcs by the bytes they spell: a node leads on by byte, and has at INNER and at LAST the token that ends there, inside a
        # word and at its end
        self.spelled: dict[int, dict] = {}
        live = set()
        for letter in letters:
            for t in (letter, letter + WORD_END):
                if t in vocabulary:
                    live.add(vocabulary[t])
                    self._spell(t, vocabulary[t], letters)
        for r, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if u in live and v in live and w not in live and self.allows(u, v, r):
                self.left[w], self.right[w], self.rank[w] = u, v, r
                live.add(w)
                self._spell(a + b, w, letters)
                self.cut.setdefault(u, {})[v] = r

    def _spell(self, token: str, i: int, letters: dict[str, int]) -> None:
        end = token.endswith(WORD_END)
        node = self.spelled
        for c in token[: -len(WORD_END)] if end else token:
            node = node.setdefault(letters[c], {})
        node[LAST if end else INNER] = i

    def allows(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether b's arc leaves a's state, of the automaton after the gadgets of ranks under `before`."""
        y, until_y = a, before
        while True:
            if cut := self.cut.get(y):
                x, until_x = b, before
                while True:
                    r = cut.get(x)
                    if r is not None and r < until_y and r <= until_x and r < before:
                        return False
                    if x not in self.left:
                        break
                    until_x, x = self.rank[x], self.left[x]
            if y not in self.right:
                return True
            until_y, y = self.rank[y], self.right[y]

    def encode(self, word: bytes) -> list[int]:
        """The one path that spells the word: longest arcs first, back where no arc leaves the state. A prefix has one
        path at most, so an end from which there is no way on is tried once."""
        n, at, prev, table, root = len(word), 0, -1, self.table, self.spelled
        out: list[int] = []
        ways: list[list] = []  # for each arc taken the shorter ones that are left to try, and where it began
        dead: set[int] = set()
        arcs: list | None = None
        while at < n:
            if arcs is None:
                arcs, node, j = [], root, at
                while j < n:
                    node = node.get(word[j])
                    if node is None:
                        break
                    j += 1
                    t = node.get(LAST if j == n else INNER)
                    if t is not None:
                        arcs.append((j, t))
            while arcs:
                end, t = arcs.pop()
                if prev >= 0:
                    k = prev << 20 | t
                    ok = table.get(k)
                    if ok is None:
                        if len(table) >= self.MOST_PAIRS:
                            table.clear()
                        ok = table[k] = self.allows(prev, t)
                    if not ok:
                        continue
                if end in dead:
                    continue
                ways.append([at, arcs])
                out.append(t)
                at, prev, arcs = end, t, None
                break
            else:
                dead.add(at)
                at, arcs = ways.pop()  # a word of known bytes has a path, so there is one
                out.pop()
                prev = out[-1] if out else -1
        return out


class _Words(dict):
    """Token ids by word, made when first asked for. Of each `most` words those that are asked for again among the next ones
    stay, so that a worker holds 2 * most of them at a time, however many it has read."""

    def __init__(self, automaton: Automaton, most: int):
        self.automaton, self.most, self.older = automaton, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.automaton.encode(word.encode()))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts of U+0000 to U+00FF, with classes written out: the standard engine is faster with these."""
    letters = [chr(i) for i in range(256)]
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        own = "".join(re.escape(c) for c in letters if regex.fullmatch(name, c) and not (name == r"\s" and "\x1c" <= c <= "\x1f"))
        pattern = pattern.replace(name, own)
    return re.compile(pattern)


class Tokenizer:
    """Normalisation, pre-split, special tokens and labels of a word-end BPE file (the JSON format of the tokenizers library)."""

    MOST_CACHED = 50_000  # and as many older ones: about 30 MB

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.latin_words = latin_pattern(pattern).findall
        self.cache = _Words(self.automaton, self.MOST_CACHED)

    def _plain(self, text: str) -> list[int]:
        try:
            text.encode("latin-1")
            words = self.latin_words(text.lower())  # no such text has a letter to compose
        except UnicodeEncodeError:
            # one letter at a time is lower-cased: no final sigma
            words = self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return list(chain.from_iterable(map(self.cache.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.split_special and any(t in text for t in self.special):
            for part in self.split_special.split(text):
                if part in self.special:
                    out.append(self.special[part])
                else:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by spaces; ids without a label are left out."""
        labels = self.labels
        try:
            return " ".join([labels[i] for i in ids])
        except KeyError:
            return " ".join([labels[i] for i in ids if i in labels])


def _tokenizer(shared) -> Tokenizer:
    """One per Python worker, until another operator has texts there; shared is a broadcast (digest, text) of the vocabulary file."""
    digest, text = shared.value
    if KEPT.get("bpe", (None,))[0] != digest:
        KEPT["bpe"] = digest, Tokenizer(text)
    return KEPT["bpe"][1]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and broadcast: its size is the file's, a few MB, whatever the tables hold."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of docs but the text and one of the name `out`, then `out`: array of token ids; null texts give an empty array."""
    shared, keep = vocabulary(docs.sparkSession, path), [c for c in docs.columns if c not in (text, out)]

    def run(batches):
        tok = _tokenizer(shared)
        for batch in pieces(batches, text, keeps="bpe"):
            ids, ends = [], [0]
            for x in batch.column(text).to_pylist():
                ids.append(np.array(tok.encode(x or ""), np.int32))
                ends.append(ends[-1] + len(ids[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], names=[*keep, out])

    picked = docs.select(*keep, text)
    return picked.mapInArrow(run, T.StructType([*picked.select(*keep).schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decoded(tokens: DataFrame, path: str, ids: str = "ids", finish=None, ddl: str = "text string") -> DataFrame:
    """All other columns, then the text of each row's ids (null: empty). With finish, a function of (ids, text) that returns a
    tuple, its values as the columns of ddl take the text's place, so that long texts needn't be returned."""
    shared, keep = vocabulary(tokens.sparkSession, path), [c for c in tokens.columns if c != ids]
    more = T.StructType.fromDDL(ddl)
    finish = finish or (lambda _, text: (text,))

    def run(batches):
        tok = _tokenizer(shared)
        for batch in batches:
            lists = batch.column(ids)
            for at in range(0, len(lists), 256):
                part = lists.slice(at, 256)
                flat, ends = part.flatten().to_numpy(), np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy())
                rows = [finish(x, tok.decode(x)) for x in (y.tolist() for y in np.split(flat, ends[:-1]))]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, 256) for c in keep] + made, names=[*keep, *more.names])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in more]
    return tokens.mapInArrow(run, T.StructType([*tokens.select(*keep).schema, *more]))


def default_vocabulary() -> str:
    """The place of the public vocabulary file that is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _digests(ids: list[int], text: str) -> tuple:
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()
    ids = encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    return decoded(ids, path, finish=_digests, ddl="n_tokens long, ids_sha256 string, decoded_sha256 string")
