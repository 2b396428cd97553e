"""Token counts that follow edits without encoding a document again.

A document keeps a segment tree. Its leaves are runs of pre-tokens (the pieces the
tokenizer's pattern cuts a text into, each encoded by itself); every node has the sums
of code points and tokens below it. An edit is located by descending the code point
sums. Only the leaves it touches are split and encoded again, from the last leaf start
that lies far enough to the left not to see the edit, to the first old leaf start on the
right that is a piece boundary of the new text too: the pattern looks ahead but never
behind, so from there on nothing can differ. Then the sums above those leaves change.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.shared import plain

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 64
#: A leaf may grow to this many pre-tokens before the tree is laid out anew.
MOST_IN_LEAF = 4 * LEAF
#: A piece's end can depend on the two characters behind it; one more for safety.
CONTEXT = 3
KNOWN_PIECES = 400_000


class PieceCounts(dict):
    """Tokens of each pre-token, encoded once."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n


@lru_cache(maxsize=2)
def piece_counts(path: str | None = None) -> PieceCounts:
    """One per worker process."""
    return PieceCounts(path or public_tokenizers.path(VOCABULARY))


def _heap(leaves: np.ndarray) -> np.ndarray:
    """Sums as a heap: node i has children 2i and 2i + 1, leaves fill the second half."""
    half = 1 << max(0, len(leaves) - 1).bit_length()
    nodes = np.zeros(2 * half, np.int64)
    nodes[half: half + len(leaves)] = leaves
    at = half
    while at > 1:
        nodes[at // 2: at] = nodes[at: 2 * at: 2] + nodes[at + 1: 2 * at: 2]
        at //= 2
    return nodes


def _leaf_sums(pieces: Sequence[str], counts: PieceCounts, per_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    if not pieces:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    starts = np.arange(0, len(pieces), per_leaf)
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tokens = np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))
    return np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)


@dataclass
class Tree:
    """Sums of code points and tokens, as heaps of one shape."""

    chars: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, text: str, counts: PieceCounts) -> Tree:
        return cls(*map(_heap, _leaf_sums(counts.pattern.findall(text), counts, LEAF)))

    @property
    def half(self) -> int:
        return len(self.chars) // 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and where it starts."""
        node, start = 1, 0
        while node < self.half:
            node *= 2
            if position - start >= self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.half, start

    def change(self, first: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """New leaf sums from leaf ``first`` on; only the nodes above them are added up again."""
        for nodes, leaves in ((self.chars, chars), (self.tokens, tokens)):
            low, high = self.half + first, self.half + first + len(leaves)
            nodes[low:high] = leaves
            while low > 1:
                low, high = low // 2, (high + 1) // 2
                nodes[low:high] = nodes[2 * low: 2 * high: 2] + nodes[2 * low + 1: 2 * high: 2]


def edit(text: str, tree: Tree, at: int, deleted: int, inserted: str, counts: PieceCounts) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many code points were encoded again.

    Positions outside the text are moved to its ends.
    """
    at = min(max(at, 0), len(text))
    deleted = min(max(deleted, 0), len(text) - at)
    changed = text[:at] + inserted + text[at + deleted:]
    moved = len(inserted) - deleted
    first, start = tree.leaf_at(max(0, at - CONTEXT))
    leaves = tree.chars[tree.half:]
    # Old leaf starts behind the edit, where the new pieces may join the old ones again.
    last, old_end = first + 1, start + int(leaves[first])
    while last < len(leaves) and old_end < at + deleted:
        old_end += int(leaves[last])
        last += 1
    pieces: list[str] = []
    end = start
    for found in counts.pattern.finditer(changed, start):
        while last < len(leaves) and (old_end + moved < end or old_end < at + deleted):
            old_end += int(leaves[last])
            last += 1
        if end >= at + len(inserted) and end == old_end + moved:
            break
        pieces.append(found[0])
        end = found.end()
    else:
        last = len(leaves)
    span = last - first
    if len(pieces) <= span * MOST_IN_LEAF:
        chars, tokens = _leaf_sums(pieces, counts, max(1, -(-len(pieces) // span)))
        empty = np.zeros(span - len(chars), np.int64)
        tree = Tree(tree.chars.copy(), tree.tokens.copy())
        tree.change(first, np.concatenate([chars, empty]), np.concatenate([tokens, empty]))
    else:
        chars, tokens = _leaf_sums(pieces, counts, LEAF)
        tree = Tree(*(
            _heap(np.concatenate([old[:first], new, old[last:]]))
            for old, new in ((leaves, chars), (tree.tokens[tree.half:], tokens))
        ))
    return changed, tree, end - start


TREES = "doc_id long, text string, n_tokens long, chars array<long>, tokens array<long>"


def with_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text, n_tokens`` and the tree (``chars``, ``tokens``) of every whole text.

    Null is the empty text, with no tokens. Repeated rows get a tree each. The table can be
    saved; :func:`after_edits` reads it as it is. An empty table gives no rows.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for batch in batches:
            trees = [Tree.of(text, counts) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.total for t in trees], pa.int64()),
                 pa.array([t.chars for t in trees], pa.list_(pa.int64())),
                 pa.array([t.tokens for t in trees], pa.list_(pa.int64()))],
                names=["doc_id", "text", "n_tokens", "chars", "tokens"])

    return plain(docs, id_col, text_col).mapInArrow(build, TREES)


def after_edits(trees: DataFrame, edits: Column, vocabulary: str | None = None) -> DataFrame:
    """Trees after edits, with ``edited_tokens`` and ``encoded_chars``, the code points encoded again.

    ``edits`` is an array of (at, deleted, inserted) per row: positions in code points of the
    text as the edits before have left it. Null edits and null fields change nothing.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for batch in batches:
            texts, trees, encoded = [], [], []
            for text, chars, tokens, changes in zip(*(c.to_pylist() for c in batch.columns[1:2] + batch.columns[3:])):
                tree, total = Tree(np.array(chars, np.int64), np.array(tokens, np.int64)), 0
                for change in changes or []:
                    text, tree, n = edit(text, tree, change["at"] or 0, change["deleted"] or 0,
                                         change["inserted"] or "", counts)
                    total += n
                texts.append(text)
                trees.append(tree)
                encoded.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(2),
                 pa.array([t.chars for t in trees], pa.list_(pa.int64())),
                 pa.array([t.tokens for t in trees], pa.list_(pa.int64())),
                 pa.array([t.total for t in trees], pa.int64()), pa.array(encoded, pa.int64())],
                names=["doc_id", "text", "n_tokens", "chars", "tokens", "edited_tokens", "encoded_chars"])

    kind = "array<struct<at:int,deleted:int,inserted:string>>"
    return trees.select(
        "doc_id", "text", "n_tokens", "chars", "tokens", edits.cast(kind).alias("edits")
    ).mapInArrow(apply, TREES + ", edited_tokens long, encoded_chars long")


def touch_ups(text: Column) -> Column:
    """Three edits of a text: its first 30 code points again at a third, 20 deleted at a half, 5 replaced at the end."""
    n = F.char_length(text)

    def one(at: Column, deleted: int, inserted: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))

    return F.array(
        one(F.floor(n / 3), 0, F.substring(text, 1, 30)),
        one(F.floor(n / 2), 20, F.lit("")),
        one(F.greatest(n - 5, F.lit(0)), 5, F.lit("'re done. ")),
    )
