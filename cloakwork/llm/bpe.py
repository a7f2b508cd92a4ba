"""BPE encoding and decoding by tree concatenation.

A long text is cut in halves, down to leaves that are encoded apart (and, for whole
documents, in separate tasks).  Neighbouring results are then concatenated up the
tree.  Around each join a window of tokens is encoded again; the window grows until
its first token equals the left side's token at that place and one of its tokens
beyond the join equals the right side's, by id and by character span.  A BPE result
is right if and only if each pair of neighbouring tokens is, so a window that agrees
on both sides makes the concatenation exact.  A window that swallows both sides is a
plain encoding of the whole, so the result is exact in any case.

Short texts are encoded word by word: this kind of tokenizer never merges across
white space, so distinct words are encoded once per worker and remembered in a
bounded table.  Words longer than a leaf go through the tree.  In the same way a leaf's
middle, between white space near its edges, is settled at once; only its head and tail
keep tokens and spans for the windows.  A leaf without white space there keeps all of
them.  All of this happens in the leaf's own task: joining a document encodes windows only.

Defined results: null text counts as empty; empty text gives no ids and an empty
decoded text; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ASCII_LOWER, small_batches

#: Characters in a leaf of the tree, tokens on each side of the first window, words remembered.
LEAF_CHARS, WINDOW, MEMO_WORDS = 16_384, 24, 120_000
#: Words in one call of the library, and characters of texts whose unseen words are learned together.
LEARN_WORDS, BLOCK_CHARS = 2048, 1 << 18
OUTPUTS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_CODECS: dict[str, Codec] = {}
#: str.split() also cuts at these, which the tokenizer's white space does not include.
_ODD = re.compile("[\x1c-\x1f]")
#: Signs between a letter and white space are a pre-token of their own.
_MARKS = re.compile(rb"([!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-/:-@\[-`{-~]*)(?=[ \n]|\Z)")
#: Words that are one pre-token: no normalisation changes these letters.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Characters at a leaf's edges that keep their tokens, for the windows around joins.
EDGE = 512


class Encoded:
    """Token ids with their character spans in the text they came from."""

    __slots__ = ("end", "ids", "start")

    def __init__(self, ids, start, end):
        self.ids, self.start, self.end = (np.asarray(x, np.int64) for x in (ids, start, end))

    def __len__(self):
        return len(self.ids)

    def packed(self) -> bytes:
        return np.stack([self.ids, self.start, self.end]).astype("<i4").tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Encoded:
        return Encoded(*np.frombuffer(data, "<i4").reshape(3, -1))

    def clean(self, i: int) -> bool:
        """Whether the cut before token i falls between characters."""
        return i <= 0 or i >= len(self) or self.end[i - 1] <= self.start[i]


def _ragged(ids: np.ndarray, cuts: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces numbered ``k`` of an array cut at ``cuts``, one after another, and their sizes."""
    sizes = cuts[k + 1] - cuts[k]
    return ids[np.arange(sizes.sum()) + np.repeat(cuts[k] - (np.cumsum(sizes) - sizes), sizes)], sizes


class WordTable:
    """Ids of known words, in two generations: when the young one is full, it becomes the old one, and what is asked for again is taken over."""

    def __init__(self, size: int):
        self.size, self.old = size, None
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.cuts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(sizes)])

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, one after another, and how many each has."""
        return _ragged(self.ids, self.cuts, k)

    def ids_of(self, words: list[str], learn) -> tuple[np.ndarray, np.ndarray]:
        """As ``take``, of words as they stand; ``learn`` adds those that neither generation has."""
        n = len(words)
        k = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, n)
        missing = np.flatnonzero(k < 0).tolist()
        if not missing:
            return self.take(k)
        new = {words[i] for i in missing}
        if len(self.at) + len(new) > self.size:
            self.old = (self.at, self.ids, self.cuts)
            self._clear()
            missing, new = range(n), set(words)
        if self.old is not None:
            at, ids, cuts = self.old
            again = [w for w in new if w in at]
            self.add(again, *_ragged(ids, cuts, np.fromiter(map(at.__getitem__, again), np.int64, len(again))))
            new.difference_update(again)
        if new:
            learn(sorted(new))
        k[missing] = np.fromiter(map(self.at.__getitem__, (words[i] for i in missing)), np.int64, len(missing))
        return self.take(k)


class Codec:
    def __init__(self, definition: str, leaf_chars: int = LEAF_CHARS, window: int = WINDOW):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf_chars, self.window = leaf_chars, window
        self.table = WordTable(MEMO_WORDS)
        self.by_word = self.library.decoder is None
        names = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.names, self.numbers = pa.array(names, pa.string()), pa.array(map(str, range(len(names))), pa.string())
        mark = json.loads(definition)["model"].get("end_of_word_suffix")
        #: Which tokens end a pre-token, if the tokenizer says so.
        self.ends = np.array([n is not None and n.endswith(mark) for n in names]) if mark else None

    @staticmethod
    def of(definition: str) -> Codec:
        if definition not in _CODECS:
            _CODECS[definition] = Codec(definition)
        return _CODECS[definition]

    def plain(self, text: str, at: int = 0) -> Encoded:
        e = self.library.encode(text, add_special_tokens=False)
        spans = np.asarray(e.offsets, np.int64).reshape(-1, 2) + at
        return Encoded(e.ids, spans[:, 0], spans[:, 1])

    def join(self, text: str, left: Encoded, right: Encoded, a: int, cut: int, b: int) -> Encoded:
        """Concatenate the encodings of text[a:cut] and text[cut:b]."""
        size = self.window
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            while not left.clean(i):
                i -= 1
            while not right.clean(j):
                j += 1
            if i == 0 and j == len(right):
                return self.plain(text[a:b], a)
            w = self.plain(text[left.start[i] if i else a : right.end[j - 1] if j < len(right) else b], left.start[i] if i else a)
            if i == 0 or (len(w) and self._same(w, 0, left, i) and w.end[0] <= cut):
                if j == len(right):
                    p, q = len(w) - 1, j - 1
                else:
                    p, q = self._meet(w, right, cut, j)
                if p is not None:
                    return self._splice(left, i, w, p, right, q)
            size *= 2

    @staticmethod
    def _splice(left: Encoded, i: int, w: Encoded, p: int, right: Encoded, q: int) -> Encoded:
        put = lambda name: np.concatenate([getattr(left, name)[:i], getattr(w, name)[: p + 1], getattr(right, name)[q + 1 :]])
        return Encoded(put("ids"), put("start"), put("end"))

    @staticmethod
    def _same(x: Encoded, i: int, y: Encoded, j: int) -> bool:
        return x.ids[i] == y.ids[j] and x.start[i] == y.start[j] and x.end[i] == y.end[j] and x.clean(i + 1) and y.clean(j + 1)

    def _meet(self, w: Encoded, right: Encoded, cut: int, j: int):
        """Last token beyond the join, before the window's own end, that both sides have."""
        p, q = len(w) - 2, j - 1
        while p >= 0 and q >= 0 and w.start[p] >= cut:
            if w.start[p] == right.start[q] and w.end[p] == right.end[q]:
                if self._same(w, p, right, q) and w.clean(p) and right.clean(q):
                    return p, q
                p, q = p - 1, q - 1
            elif w.start[p] > right.start[q] or (w.start[p] == right.start[q] and w.end[p] > right.end[q]):
                p -= 1
            else:
                q -= 1
        return None, None

    def tree(self, text: str, a: int = 0, b: int | None = None) -> Encoded:
        b = len(text) if b is None else b
        if b - a <= self.leaf_chars:
            return self.plain(text[a:b], a)
        cut = (a + b) // 2
        return self.join(text, self.tree(text, a, cut), self.tree(text, cut, b), a, cut, b)

    def concatenate(self, text: str, leaves: list[tuple[int, int, Encoded]]) -> Encoded:
        """Join encoded leaves (start, end, encoding), pair by pair up the tree."""
        while len(leaves) > 1:
            up = [(x[0], y[1], self.join(text, x[2], y[2], x[0], x[1], y[1])) for x, y in zip(leaves[::2], leaves[1::2], strict=False)]
            leaves = up + ([leaves[-1]] if len(leaves) % 2 else [])
        return leaves[0][2]

    def joined(self, ids: list[np.ndarray], names: pa.Array) -> pa.Array:
        """Per text the names of its ids, joined by spaces."""
        cuts = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(cuts, names.take(pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))), " ")

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """What the library's decode() gives, special tokens kept."""
        if self.library.decoder is None:
            return self.joined(ids, self.names)
        return pa.array([self.library.decode(i.tolist(), skip_special_tokens=False) for i in ids], pa.string())

    def _learn(self, words: list[str]) -> None:
        """Encode unseen words, LEARN_WORDS in a call of the library.

        Words of plain lower-case letters are one pre-token each, and only a pre-token's last
        token ends in the end mark, so many of them can be encoded as one text.
        """
        rest, plain = [], []
        for w in words:
            (plain if self.ends is not None and len(w) <= self.leaf_chars and _PLAIN.fullmatch(w) else rest).append(w)
        for k in range(0, len(plain), LEARN_WORDS):
            part = plain[k : k + LEARN_WORDS]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):
                raise ValueError("a plain word has more than one pre-token")
            self.table.add(part, ids, np.diff(last, prepend=-1))
        for k in range(0, len(rest), LEARN_WORDS):
            part = rest[k : k + LEARN_WORDS]
            short = [w for w in part if len(w) <= self.leaf_chars]
            got = [e.ids for e in self.library.encode_batch_fast(short, add_special_tokens=False)]
            for w in part:
                if len(w) > self.leaf_chars:
                    short.append(w)
                    got.append(self.tree(w).ids.tolist())
            self.table.add(short, np.array(list(chain.from_iterable(got)), np.int32), np.array([len(g) for g in got], np.int64))

    def _words(self, text: str) -> list[str]:
        if "<|" not in text:  # special tokens are told by case; all else is lower-cased anyway
            text = _MARKS.sub(rb" \1", text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER)).decode("utf-8", "surrogatepass")
        return text.split()

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; unseen words are learned for BLOCK_CHARS of texts at once."""
        at = 0
        while at < len(texts):
            end, size, words = at, 0, []
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
                size += len(texts[end])
                words.append(self._words(texts[end]) if self.by_word and not _ODD.search(texts[end]) else None)
                end += 1
            ids, sizes = self.table.ids_of(list(chain.from_iterable(w for w in words if w)), self._learn)
            ends, tokens, k = np.concatenate([[0], np.cumsum(sizes)]), 0, 0
            for text, mine in zip(texts[at:end], words, strict=True):
                if mine is None:
                    yield self.tree(text).ids.astype(np.int32)
                else:
                    k += len(mine)
                    yield ids[tokens : ends[k]]
                    tokens = ends[k]
            at = end

    def edges(self, leaf: str) -> tuple[int, int]:
        """Where a leaf's head ends and its tail starts, at white space; (0, 0) if it has none there."""
        head, tail = leaf.find(" ", EDGE), leaf.rfind(" ", 0, max(0, len(leaf) - EDGE))
        return (head, tail) if self.by_word and 0 < head < tail and not _ODD.search(leaf) else (0, 0)

    def leaf(self, leaf: str) -> tuple[str, Encoded, np.ndarray, str, Encoded]:
        """Head and its encoding, ids of the middle, tail and its encoding; a leaf without white space at its edges is all head."""
        a, b = self.edges(leaf)
        if not a:
            return leaf, self.plain(leaf), np.zeros(0, np.int32), "", self.plain("")
        middle = next(iter(self.batch([leaf[a:b]])))
        return leaf[:a], self.plain(leaf[:a]), middle, leaf[b:], self.plain(leaf[b:])

    def whole(self, leaves: list[tuple[str, Encoded, np.ndarray, str, Encoded]]) -> np.ndarray:
        """Ids of the text whose encoded leaves these are: between two middles stand a tail and heads, joined as a tree."""
        ids: list[np.ndarray] = []
        run: list[tuple[str, Encoded]] = []
        for head, encoded_head, middle, tail, encoded_tail in leaves:
            run.append((head, encoded_head))
            if tail:
                ids += [self._run(run), middle]
                run = [(tail, encoded_tail)]
        return np.concatenate([*ids, self._run(run)]).astype(np.int32)

    def _run(self, pieces: list[tuple[str, Encoded]]) -> np.ndarray:
        """Only windows around the joins are encoded here."""
        text, parts, at = "".join(t for t, _ in pieces), [], 0
        for t, e in pieces:
            parts.append((at, at + len(t), Encoded(e.ids, e.start + at, e.end + at)))
            at += len(t)
        return self.concatenate(text, parts).ids


def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts], pa.string())


def _columns(codec: Codec, ids: list[np.ndarray], outputs: list[str]) -> list[pa.Array]:
    make = {
        "ids": lambda: pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))),
        "decoded": lambda: codec.decode(ids),
        "ids_sha256": lambda: _sha256(codec.joined(ids, codec.numbers)),
        "decoded_sha256": lambda: _sha256(codec.decode(ids)),
    }
    return [pa.array([len(i) for i in ids], pa.int64())] + [make[o]() for o in outputs]


def encode_decode(df: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode and decode every text; returns the id, ``n_tokens`` and the chosen ``outputs``.

    definition: content of a tokenizer file.  Texts of up to two leaves are encoded where
    they are read.  Of longer ones the leaves become rows, encoded in separate tasks and
    joined per document; only these texts are shuffled.
    """
    spark, outs = small_batches(df.sparkSession), list(outputs)
    shipped = spark.sparkContext.broadcast(definition)  # a tokenizer file: its size does not depend on the data
    rows = df.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, n_tokens bigint, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outs)
    long = F.length("text") > 2 * leaf_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shipped.value)
        for batch in batches:
            got = list(codec.batch(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(codec, got, outs)], ["key", "n_tokens", *outs])

    leaves = (
        rows.where(long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "key", F.length("text").alias("size"), F.posexplode(F.expr(f"transform(sequence(0, (length(text) - 1) div {leaf_chars}), i -> substring(text, i * {leaf_chars} + 1, {leaf_chars}))")).alias("leaf", "text"))
        .repartition("row", "leaf")
    )

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shipped.value)
        for batch in batches:
            got = [codec.leaf(t) for t in batch.column("text").to_pylist()]
            kinds = (("head", pa.string(), 0), ("head_ids", pa.binary(), 1), ("middle", pa.binary(), 2), ("tail", pa.string(), 3), ("tail_ids", pa.binary(), 4))
            raw = [[g.packed() if isinstance(g, Encoded) else g.astype("<i4").tobytes() if isinstance(g, np.ndarray) else g for g in x] for x in got]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "leaf")), *(pa.array([r[k] for r in raw], t) for _, t, k in kinds)], ["row", "key", "leaf", *(n for n, _, _ in kinds)])

    encoded = leaves.mapInArrow(encode_leaves, f"row bigint, key {kind}, leaf int, head string, head_ids binary, middle binary, tail string, tail_ids binary")

    def concatenate(group: pa.Table) -> pa.Table:
        codec = Codec.of(shipped.value)
        found = sorted(group.drop_columns(["row", "key"]).to_pylist(), key=lambda r: r["leaf"])
        ids = codec.whole([(r["head"], Encoded.unpacked(r["head_ids"]), np.frombuffer(r["middle"], "<i4"), r["tail"], Encoded.unpacked(r["tail_ids"])) for r in found])
        return pa.Table.from_arrays([group.column("key").slice(0, 1).combine_chunks(), *_columns(codec, [ids], outs)], ["key", "n_tokens", *outs])

    both = rows.where(~long).mapInArrow(whole, schema).unionByName(encoded.groupBy("row").applyInArrow(concatenate, schema))
    return both.withColumnRenamed("key", id_col)
