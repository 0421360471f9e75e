"""Byte-pair encoding by guess and check, and decoding.

A word is first cut greedily into the longest tokens of the vocabulary.  Such a
cut is the encoding exactly if no two neighbours would have been merged across
their border: undoing the merges of both tokens, latest first, lists every pair of
pieces that ever stood at the border together with the rank of the next merge beside
them, and the border holds if no listed pair merges earlier.  The check runs over
all neighbours of a batch of words at once, in numpy.  Words that fail, and words
with a token that does not encode to itself, are merged step by step.

Words come from the pattern of the vocabulary's pre-tokenizer.  Its letter classes
follow an older Unicode version than the regex module; texts with a character that
the two class differently are cut by the pre-tokenizer itself.

A null text counts as empty and has no tokens; repeated rows give equal rows; an
empty table gives no rows; further columns are ignored.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import column_of, prepare, texts

VOCABULARY = "byte_bpe_50k.json"
# Words whose codes a worker keeps; the store starts anew when full.
KEPT_WORDS = 300_000
# Longer words are merged one by one, with a queue.
LONG_WORD = 64
_NEVER = np.int64(1) << 40
_UNUSUAL = regex.compile("[\u0250-\U0010ffff]")


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself if
    printable in Latin-1, else the next free character from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Lookup:
    """A fixed map from numbers to numbers that answers for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.values[slot[take]] = keys[left[take]], values[left[take]]
            left, slot = left[~take], (slot[~take] + ~free[~take]) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(keys), missing, np.int64)
        slot = self._slot(keys)
        here = self.keys[slot]
        hit = here == keys
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (here >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot[left]]
            hit = here == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (here >= 0)]
        return out


class Vocabulary:
    """Tokens by rank: single bytes first, then one per merge, in merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        symbols = byte_symbols()
        ids, merges = data["model"]["vocab"], data["model"]["merges"]
        names = sorted(symbols, key=symbols.get)
        rank = {name: b for b, name in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        for merge in merges:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b not in rank:
                rank[a + b] = len(names)
                names.append(a + b)
                left.append(rank[a])
                right.append(rank[b])
        self.path = path
        self.left, self.right = np.array(left), np.array(right)
        self.token_bytes = [bytes(symbols[c] for c in name) for name in names]
        self.ids = np.array([ids[name] for name in names], "<u4")
        keys = (self.left[256:] << 32) | self.right[256:]
        self.pair_rank = dict(zip(keys.tolist(), range(256, len(names))))
        self.pairs = Lookup(keys, np.arange(256, len(names)))
        # the tree of tokens: steps by (node, byte), and the token that ends at a node
        steps: dict[int, int] = {}
        node_token = [-1]
        for r, token in enumerate(self.token_bytes):
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in steps:
                    steps[key] = len(node_token)
                    node_token.append(-1)
                node = steps[key]
            node_token[node] = r
        self.steps = Lookup(np.array(list(steps)), np.array(list(steps.values())))
        self.node_token = np.array(node_token)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.by_id = {int(i): token for i, token in zip(self.ids.tolist(), self.token_bytes)}
        self.by_id |= {i: content.encode() for content, i in self.special.items()}
        # a token encodes to itself if its two parts do and nothing merges across them earlier
        own = np.arange(len(names))
        whole = self.borders_hold(self.left, self.right, own, own)
        whole[:256] = True
        for r in range(256, len(names)):
            whole[r] &= whole[self.left[r]] and whole[self.right[r]]
        self.whole = whole
        self.pattern = regex.compile(_pattern())
        self.latin = _latin(_pattern())
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.same_class: dict[str, bool] = {}
        self.codes: dict[str, bytes] = {}

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a very large number where there is none."""
        return self.pairs.get((a << 32) | b, _NEVER)

    def borders_hold(self, a: np.ndarray, b: np.ndarray, next_a: np.ndarray | None = None, next_b: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b stand side by side in an encoding, for arrays of pairs.

        ``next_a`` and ``next_b`` are the ranks of the merges that will take the piece
        left and right of the border away; none by default.  Among equal ranks the
        leftmost merge comes first, so the piece on the left gives way to an equal rank."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        after_x = np.full(len(x), _NEVER) if next_a is None else next_a.astype(np.int64)
        after_y = np.full(len(x), _NEVER) if next_b is None else next_b.astype(np.int64)
        holds, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            rank = self.merged(x, y)
            broken = (rank < after_x) & (rank <= after_y) & (rank < _NEVER)
            if next_a is not None:
                broken &= rank < after_y  # the merge of the two parts themselves is the token
            holds[open_[broken]] = False
            go = ~broken & ((x >= 256) | (y >= 256))
            open_, x, y, after_x, after_y = open_[go], x[go], y[go], after_x[go], after_y[go]
            undo_x = x > y
            after_x, after_y = np.where(undo_x, x, after_x), np.where(undo_x, after_y, y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            next_a = None
        return holds

    def guess(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, rank): the longest tokens from left to right, for all words at once.

        All words walk down the tree of tokens together, byte by byte; when none can
        go on, each takes the last token it has passed and starts again behind it."""
        owners, ranks, cursor = [], [], starts.copy()
        active = np.flatnonzero(starts < ends)
        while len(active):
            node, at = np.zeros(len(active), np.int64), cursor[active]
            token, behind = np.full(len(active), -1), at.copy()
            walking = np.arange(len(active))
            while len(walking):
                step = self.steps.get((node[walking] << 8) | flat[at[walking]], -1)
                walking, step = walking[step >= 0], step[step >= 0]
                node[walking] = step
                at[walking] += 1
                here = self.node_token[step]
                passed = here >= 0
                token[walking[passed]] = here[passed]
                behind[walking[passed]] = at[walking[passed]]
                walking = walking[at[walking] < ends[active[walking]]]
            owners.append(active)
            ranks.append(token)
            cursor[active] = behind
            active = active[behind < ends[active]]
        owner = np.concatenate([*owners, np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate([*ranks, np.empty(0, np.int64)])[order]

    def merge_all(self, parts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, rank) after merging step by step: in each round every word merges its
        pair of lowest rank, the leftmost of equals.  Takes the bytes of the words."""
        done_parts, done_owner = [], []
        rank = np.append(np.where(owner[1:] == owner[:-1], self.merged(parts[:-1], parts[1:]), _NEVER), _NEVER)[: len(parts)]
        while len(parts):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(parts)))
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low < _NEVER, sizes)
            done_parts.append(parts[~live])
            done_owner.append(owner[~live])
            low = np.repeat(low, sizes)[live]
            parts, owner, rank = parts[live], owner[live], rank[live]
            at = np.flatnonzero(rank == low)
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])] if len(at) else at
            parts[at] = rank[at]
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one part is gone for each earlier word
            parts, owner, rank = parts[keep], owner[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(parts) - 1)
                inside = (right > left) & (owner[left] == owner[right])
                rank[left] = np.where(inside, self.merged(parts[left], parts[right]), _NEVER)
        none = np.empty(0, np.int64)
        owner = np.concatenate([*done_owner, none])
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate([*done_parts, none])[order]

    def merge(self, word: bytes) -> list[int]:
        """One long word: the same order of merges, with a queue of pairs."""
        parts: list[int] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.pair_rank.get(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian bytes: guessed, checked, merged where needed."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        owner, rank = self.guess(flat, ends - lengths, ends)
        failed = np.zeros(len(raw), bool)
        failed[owner[~self.whole[rank]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        holds = self.borders_hold(rank[inner], rank[inner + 1])
        failed[owner[inner[~holds]]] = True
        fine = ~failed[owner]
        parts = [(owner[fine], rank[fine])]
        short = failed & (lengths <= LONG_WORD)
        of_byte = np.repeat(np.arange(len(raw)), lengths)
        chosen = short[of_byte]
        parts.append(self.merge_all(flat[chosen], of_byte[chosen]))
        for i in np.flatnonzero(failed & ~short):
            merged = np.array(self.merge(raw[i]), np.int64)
            parts.append((np.full(len(merged), i), merged))
        owner, rank = (np.concatenate([p[k] for p in parts]) for k in range(2))
        order = np.argsort(owner, kind="stable")
        ids = self.ids[rank[order]].tobytes()
        cuts = (np.cumsum(np.bincount(owner, minlength=len(raw))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def _classed_alike(self, char: str) -> bool:
        if char not in self.same_class:
            probe = f"a{char}1 {char}x"
            cut = [tuple(span) for _, span in _tokenizer(self.path).pre_tokenizer.pre_tokenize_str(probe)]
            self.same_class[char] = cut == [m.span() for m in self.pattern.finditer(probe)]
        return self.same_class[char]

    def words(self, text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            return self.latin.findall(text)
        if not all(self._classed_alike(c) for c in set(_UNUSUAL.findall(text))):
            return [text[a:b] for _, (a, b) in _tokenizer(self.path).pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text.  Names of special tokens in a text are these tokens."""
        cut: list[list[str | int]] = []
        for text in batch:
            parts: list[str | int] = []
            at = 0
            for m in self.split_special.finditer(text) if self.split_special else ():
                parts += [*self.words(text[at : m.start()]), self.special[m.group()]]
                at = m.end()
            cut.append([*parts, *self.words(text[at:])] if parts else self.words(text[at:] if at else text))
        if len(self.codes) > KEPT_WORDS:
            self.codes = {}
        codes = self.codes
        new = list({w for parts in cut for w in parts if w not in codes})
        named = [w for w in new if isinstance(w, str)]
        codes.update(zip(named, self.encode_words(named)) if named else ())
        codes.update((i, np.uint32(i).astype("<u4").tobytes()) for i in new if not isinstance(i, str))
        return [np.frombuffer(b"".join(map(codes.__getitem__, parts)), "<u4") for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.by_id.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _latin(pattern: str) -> re.Pattern:
    """The same pattern for texts below U+0250, with its classes spelled out: the
    plain matcher is faster but knows no letter classes."""
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        members = "".join(f"\\u{c:04x}" for c in range(0x250) if regex.fullmatch(name, chr(c)))
        pattern = pattern.replace(f"[^\\s\\p{{L}}\\p{{N}}]", "@@") if name == r"\p{L}" else pattern
        pattern = pattern.replace(name, f"[{members}]")
    others = "".join(f"\\u{c:04x}" for c in range(0x250) if regex.fullmatch(r"[^\s\p{L}\p{N}]", chr(c)))
    return re.compile(pattern.replace("@@", f"[{others}]"))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a file; by default the public one installed on each machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Vocabulary(str(path))


def encode_and_decode(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = vocab.encode(list(texts(batch)))
            columns = [
                column_of(batch, "doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(vocab.decode(i).encode()).hexdigest() for i in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [slim.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return slim.mapInArrow(rows, T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]))


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """All columns but the ids, and the text that the ids stand for."""
    prepare(encoded.sparkSession)
    rest = encoded.drop(ids)
    names = rest.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            decoded = [vocab.decode(np.array(i.as_py() or [], np.uint32)) for i in column_of(batch, ids)]
            yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in names], pa.array(decoded, pa.string())], names=[*names, out])

    return encoded.mapInArrow(rows, T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())]))
