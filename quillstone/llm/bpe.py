"""Byte-level BPE encoding with a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillstone.llm.shared import arrow_map

# The byte-level pre-tokeniser's pattern, with White_Space spelled out.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NO_RANK = np.int32(np.iinfo(np.int32).max)
#: White space other than spaces and line ends.
RARE = re.compile(f"[{_S}]".replace(r"\t-\r ", r"\t\x0b-\r"))
#: Bytes, about, of pre-tokens, and of pieces, that a Python worker remembers; beyond it, the memory starts anew. Longer ones
#: than REMEMBERED are encoded each time.
MEMORY, REMEMBERED = 56 << 20, 128
#: Fewer pre-tokens than this of one length are merged one by one: steps of numpy cost more than they share.
FEW = 24


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by rule: printable bytes are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Memory:
    """Encoded strings that a worker keeps, within MEMORY bytes."""

    def __init__(self) -> None:
        self.held: dict[str, str] = {}
        self.size = 0

    def lookup(self, wanted: set[str], encode: Callable[[list[str]], dict[str, str]]) -> Callable[[str], str]:
        """Encodes what isn't known, and gives the function that yields each wanted string's ids."""
        new = encode(list(wanted.difference(self.held)))
        short = {w: v for w, v in new.items() if len(w) <= REMEMBERED}
        cost = sum(4 * len(w) + len(v) + 160 for w, v in short.items())
        kept = self.held
        if self.size + cost > MEMORY:
            self.held, self.size = {}, 0  # what is wanted now is still in ``kept``
        self.held.update(short)
        self.size += cost
        if kept is self.held and len(short) == len(new):
            return kept.__getitem__
        return lambda w: new[w] if w in new else kept[w]


class Vocabulary:
    """Ids, bytes and merge ranks of a tokenizer file, and what encodes and decodes texts by them."""

    def __init__(self, spec: dict) -> None:
        letters, model = byte_letters(), spec["model"]
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_name = {str(i): bytes(letters[c] for c in w) for w, i in ids.items() if w not in self.added}
        self.of_name |= {str(i): w.encode() for w, i in self.added.items()}
        self.names = np.array([str(i) for i in range(max(ids.values()) + 1)], dtype=object)
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known, self.pieces_known = Memory(), Memory()
        self.rank_of = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Words as rows of ids, -1 after the end; the ids after all merges, in place.

        A segment tree per row holds the rank of each adjacent pair, at the position of its left symbol. The root
        yields the lowest rank, the walk down (left child first among equals) its leftmost position; a merge changes
        three leaves, whose paths to the root are computed anew. The rows go in step, each with its own tree.
        """
        rows, width = symbols.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        depth = leaves.bit_length() - 1
        tree = np.full((rows, 2 * leaves), NO_RANK, dtype=np.int32)
        tree[:, leaves : leaves + width - 1] = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        for level in range(depth - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        live = np.flatnonzero(tree[:, 1] != NO_RANK)
        while len(live):
            low, node = tree[live, 1], np.ones(len(live), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + (tree[live, 2 * node] != low)
            at = node - leaves
            right = after[live, at]
            symbols[live, at] = self.merged[low]
            symbols[live, right] = -1
            then = after[live, right]
            after[live, at] = then
            inner = then < width
            before[live[inner], then[inner]] = at[inner]
            ends = np.where(inner, symbols[live, np.minimum(then, width - 1)], -1)
            self._set(tree, live, right, np.full(len(live), NO_RANK, dtype=np.int32), leaves)
            self._set(tree, live, at, self.rank(symbols[live, at], ends), leaves)
            prior = before[live, at]
            some = prior >= 0
            rows_, p = live[some], prior[some]
            self._set(tree, rows_, p, self.rank(symbols[rows_, p], symbols[rows_, at[some]]), leaves)
            live = live[tree[live, 1] != NO_RANK]
        return symbols

    def merge_one(self, symbols: np.ndarray) -> list[int]:
        """The ids of one word after all merges: the same segment tree, walked in plain Python, for long or lone words."""
        n = len(symbols)
        leaves = 1 << max(1, (n - 1).bit_length())
        levels = [np.full(leaves, NO_RANK, dtype=np.int32)]
        levels[0][: n - 1] = self.rank(symbols[:-1], symbols[1:])
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [int(NO_RANK), *np.concatenate(levels[::-1]).tolist()]
        word, after, before, none = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), int(NO_RANK)
        merged, rank_of = self.merged, self.rank_of
        while (low := tree[1]) != none:
            node = 1
            while node < leaves:
                node *= 2
                if tree[node] != low:
                    node += 1
            at = node - leaves
            right = after[at]
            word[at], word[right] = int(merged[low]), -1
            then = after[at] = after[right]
            if then < n:
                before[then] = at
            prior = before[at]
            changes = [(right, none), (at, rank_of.get(word[at] << 32 | word[then], none) if then < n else none)]
            if prior >= 0:
                changes.append((prior, rank_of.get(word[prior] << 32 | word[at], none)))
            for leaf, rank in changes:
                node = leaf + leaves
                tree[node] = rank
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    best = a if a < b else b
                    if tree[node] == best:
                        break
                    tree[node] = best
        return [x for x in word if x >= 0]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, leaves: int) -> None:
        node = at + leaves
        tree[rows, node] = value
        while leaves > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            leaves >>= 1

    def learn(self, new: list[str]) -> dict[str, str]:
        """Encoded pre-tokens; those of like length go together, in blocks of bounded size, few of a length one by one."""
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        sizes, out = np.array([len(c) for c in coded], dtype=np.int64), {}
        for bits in range(int(sizes.max()).bit_length() + 1) if len(sizes) else ():
            group = np.flatnonzero((sizes > (1 << bits >> 1)) & (sizes <= 1 << bits)) if bits else np.flatnonzero(sizes <= 1)
            step = max(1, (1 << 17) >> bits)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                if bits and len(part) < FEW:
                    for i in part.tolist():
                        ids = self.merge_one(self.of_byte[np.frombuffer(coded[i], dtype=np.uint8)])
                        out[new[i]] = ",".join(self.names[ids].tolist())
                    continue
                symbols = np.full((len(part), max(2, 1 << bits)), -1, dtype=np.int64)
                at = np.arange(symbols.shape[1]) < sizes[part][:, None]
                symbols[at] = self.of_byte[np.frombuffer(b"".join([coded[i] for i in part.tolist()]), dtype=np.uint8)]
                self.merge(symbols)
                left = symbols >= 0
                names, ends = self.names[symbols[left]].tolist(), np.cumsum(left.sum(axis=1)).tolist()
                for i, a, b in zip(part.tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[new[i]] = ",".join(names[a:b])
        return out

    def tokens(self, texts: list[str]) -> list[str]:
        """Comma-joined ids of each text, cut into pre-tokens; no added tokens."""
        parts = [self.pattern.findall(t) for t in texts]
        look = self.known.lookup({w for p in parts for w in p}, self.learn)
        return [",".join(map(look, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[str]:
        """Comma-joined ids of each text; added tokens are cut out first.

        Where a text's spaces stand alone, a pre-token ends before each, so the pieces between them are encoded
        (and remembered) with their space; other texts are cut as a whole.
        """
        out: list[str | None] = [None] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            if self.split is not None and self.split.search(t):
                parts = self.split.split(t)
                own = iter(self.tokens(parts[::2]))
                coded = [str(self.added[x]) if k % 2 else next(own) for k, x in enumerate(parts)]
                out[i] = ",".join([x for x in coded if x])
            elif not t or t[0] == " " or t[-1] == " " or "  " in t or " \n" in t or "\n " in t or RARE.search(t):
                whole.append(i)
            else:
                plain.append((i, t.split(" ")))
        for i, s in zip(whole, self.tokens([texts[i] for i in whole]), strict=True):
            out[i] = s
        pieces = {w for _, p in plain for w in p[1:]}
        look = self.pieces_known.lookup(pieces, lambda new: dict(zip(new, self.tokens([" " + w for w in new]), strict=True)))
        first = self.tokens([p[0] for _, p in plain])
        for (i, p), s in zip(plain, first, strict=True):
            out[i] = ",".join([s, *map(look, p[1:])])
        return out

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.of_name.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """From the JSON of a tokenizer file; kept for the life of the Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(json.loads(text))
    return _LOADED[key]


def bpe_encode(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: its id (and the columns ``keep``), n_tokens, ids (comma-joined decimals; "" if none) and decoded text.

    ``tokenizer_path`` is a byte-level BPE file (JSON with model.vocab, model.merges, added_tokens), read on the driver
    and sent with the tasks as one broadcast: its size is the vocabulary's, not the data's. Strings of added tokens in a
    text are their tokens. A null text is encoded as an empty one. Every row is kept, whatever its id; nothing is
    shuffled. Other columns are ignored. An empty table gives no rows.
    """
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    held = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = vocabulary(held.value)
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            ids = v.encode([t or "" for t in part.column("_text").to_pylist()])
            n = [s.count(",") + 1 if s else 0 for s in ids]
            decoded = [v.decode(s) for s in ids]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [*names, "n_tokens", "ids", "decoded"])

    rows = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    more = [StructField("n_tokens", LongType()), StructField("ids", StringType()), StructField("decoded", StringType())]
    return arrow_map(rows, f, StructType([*(rows.schema[c] for c in names), *more]))
