"""Token counts by a transducer compiled from a vocabulary of scored pieces (byte-pair merges with byte fallback).

Merging is not a left-to-right process, but its result can be read from left to right: the last token of a
prefix is the one piece that ends there, that merging would keep whole, and that merging would keep apart from
the last token before it.  So a state holds, for each place where a piece may still be growing, the node of
the piece tree, the last token before that place, and how many tokens lie between there and here; a
transition says by how many tokens the encoding of the prefix grows or shrinks.  States and transitions are
compiled when text first needs them and kept: equal contents are one state.

1. The driver reads the vocabulary, merges every piece by itself once, and ships the tables.
2. A text is a run through the transducer.  A space after another character leads to one state from every state.
3. Texts are cut into chunks.  A chunk's state map runs the part before its first such space from whatever
   state comes in; what follows is one known state and count.  Maps compose associatively, so they are
   combined as a prefix scan, pair by pair, and the whole text's map is applied to the first state.

The counts are those of the library for the whole text: a space before it, spaces kept, no special tokens,
characters outside the vocabulary as one token for each of their bytes.

Null and empty texts have no tokens.  Rows are independent: repeated rows and null ids give rows of their own,
other columns don't matter, an empty table gives no rows.  Texts may be of any length; the memory of a text
is its own size, and states are forgotten when there are too many, which changes no result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vozlake.llm.common import bounded_batches, only

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 16
MOST_STATES = 250_000
SPACE = "▁"
LOWEST = float("-inf")
BOUNDARY = re.compile(f"[^{SPACE}]{SPACE}")


class Vocabulary:
    """Scores of pieces, how each is merged, and the tree of their characters."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.parts = {p: merged for p in scores if (merged := self._last_merge(p)) is not None}
        self.tree: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.parts:
            at = 0
            for ch in p:
                if ch not in self.tree[at]:
                    self.tree[at][ch] = len(self.tree)
                    self.tree.append({})
                    self.piece.append(None)
                at = self.tree[at][ch]
            self.piece[at] = p
        self.longest_run = max((len(p) for p in scores if set(p) == {SPACE}), default=1)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda k: model.IsUnknown(k) or model.IsControl(k) or model.IsByte(k)
        return cls({model.IdToPiece(k): model.GetScore(k) for k in range(model.GetPieceSize()) if not special(k)})

    def merge(self, text: str) -> list[tuple[str, tuple[str, str] | None]]:
        """Tokens of ``text``, each with the two parts of its last merge."""
        token, before, after = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        parts: list[tuple[str, str] | None] = [None] * len(text)
        heap: list[tuple[float, int, str]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                both = token[at] + token[after[at]]
                if both in self.scores:
                    heapq.heappush(heap, (-self.scores[both], at, both))

        for at in range(len(text)):
            offer(at)
        while heap:
            _, at, both = heapq.heappop(heap)
            right = after[at]
            if token[at] and right >= 0 and token[at] + token[right] == both:
                parts[at] = (token[at], token[right])
                token[at], token[right], after[at] = both, "", after[right]
                if after[at] >= 0:
                    before[after[at]] = at
                offer(before[at])
                offer(at)
        return [(t, p) for t, p in zip(token, parts, strict=True) if t]

    def _last_merge(self, piece: str) -> tuple[str, str] | tuple[()] | None:
        """The parts a piece is made of, nothing for a character, None for a piece that merging never gives."""
        done = self.merge(piece)
        return (done[0][1] or ()) if len(done) == 1 else None

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one edge of a piece while it is merged, with the score of the merge that ends it."""
        out, end = [], LOWEST
        while True:
            out.append((piece, end))
            if not self.parts[piece]:
                return out[::-1]
            piece, end = self.parts[piece][side], self.scores[piece]


class State(dict):
    """Transitions by character: (next state, tokens more).  Missing ones are compiled."""

    __slots__ = ("machine", "growing", "last", "run")

    def __init__(self, machine: Transducer, growing: tuple, last: str | None, run: tuple[int, ...] = ()):
        super().__init__()
        self.machine, self.growing, self.last, self.run = machine, growing, last, run

    def __missing__(self, ch: str) -> tuple[State, int]:
        self[ch] = found = self.machine.transition(self, ch)
        return found


class Transducer:
    def __init__(self, vocabulary: Vocabulary, most_states: int = MOST_STATES):
        self.words, self.most = vocabulary, most_states
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}  # two for each piece at most
        self.forget()

    def forget(self) -> None:
        """Drop all compiled states; runs that are under way keep theirs."""
        self.states: dict[tuple, State] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.empty = self.state((), None)
        self.space = self.after_spaces((1,), 1)

    def state(self, growing: tuple, last: str | None, run: tuple[int, ...] = ()) -> State:
        key = (growing, last, run)
        if key not in self.states:
            self.states[key] = State(self, growing, last, run)
        return self.states[key]

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        if (piece, side) not in self.edges:
            self.edges[piece, side] = self.words.edge(piece, side)
        return self.edges[piece, side]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives these two tokens: no merge across comes before those inside."""
        if (left, right) not in self.apart:
            a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
            scores = self.words.scores
            while True:
                (x, ends_x), (y, ends_y) = a[i], b[j]
                across = scores.get(x + y, LOWEST)
                # Of equal scores the leftmost pair merges first.
                if across > ends_x and across >= ends_y and across > LOWEST:
                    self.apart[left, right] = False
                    break
                if ends_x == LOWEST and ends_y == LOWEST:
                    self.apart[left, right] = True
                    break
                if ends_x >= ends_y:
                    i += 1
                else:
                    j += 1
        return self.apart[left, right]

    def after_spaces(self, run: tuple[int, ...], grown: int) -> State:
        """After spaces merged to ``run``, the last of which made the count grow by ``grown``; it may still begin a word."""
        node = self.words.tree[0].get(SPACE)
        return self.state(((node, None, -grown),) if node else (), SPACE if node else None, run)

    def more_spaces(self, run: tuple[int, ...]) -> tuple[State, int]:
        """One more space: runs merge among themselves, leftmost first, after everything else."""
        blocks, scores = [*run, 1], self.words.scores
        at = 0
        while at + 1 < len(blocks):
            if SPACE * (blocks[at] + blocks[at + 1]) in scores:
                blocks[at : at + 2] = [blocks[at] + blocks[at + 1]]
                at = 0
            else:
                at += 1
        grown = len(blocks) - len(run)
        while len(blocks) > 1 and blocks[0] >= self.words.longest_run:
            del blocks[0]  # full: it can't change any more
        return self.after_spaces(tuple(blocks), grown), grown

    def transition(self, state: State, ch: str) -> tuple[State, int]:
        if ch == SPACE:
            return self.more_spaces(state.run) if state.run else (self.space, 1)
        tree, piece = self.words.tree, self.words.piece
        first = tree[0].get(ch)
        if first is None:
            return self.empty, len(ch.encode("utf-8", "replace"))
        if len(self.states) > self.most:
            self.forget()
        growing = [(tree[node][ch], left, back) for node, left, back in state.growing if ch in tree[node]]
        growing.append((first, state.last, 0))
        for node, left, back in growing:  # the longest first
            last = piece[node]
            if last is not None and (left is None or self.stay_apart(left, last)):
                break
        grown = back + 1
        # What can't grow any more needs no place in the state.
        return self.state(tuple((node, left, back - grown) for node, left, back in growing if tree[node]), last), grown

    # --- chunks ----------------------------------------------------------------------------------

    def go(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for ch in text:
            state, grown = state[ch]
            total += grown
        return state, total

    def chunk_map(self, chunk: str) -> tuple[str, State | None, int]:
        """(head, state, count): run the head from any state; if there is a state, it and its count follow."""
        cut = BOUNDARY.search(chunk)
        if cut is None:
            return chunk, None, 0
        state, count = self.go(self.space, chunk[cut.end() :])
        return chunk[: cut.end() - 1], state, count + 1

    def compose(self, one: tuple, two: tuple) -> tuple:
        (head, state, count), (next_head, next_state, next_count) = one, two
        if state is None:
            return head + next_head, next_state, next_count
        state, grown = self.go(state, next_head)
        return head, state if next_state is None else next_state, count + grown + next_count

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        line = text.replace(" ", SPACE)
        if len(line) <= chunk:
            return 1 + self.go(self.space, line)[1]
        maps = [self.chunk_map(line[at : at + chunk]) for at in range(0, len(line), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return 1 + self.compose(("", self.space, 0), maps[0])[2]


def with_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """Add the number of tokens of each text; ``vocabulary`` is read on the driver."""
    bounded_batches(df.sparkSession)
    # A worker's tasks share the states that its copy of the vocabulary has compiled.
    shipped = df.sparkSession.sparkContext.broadcast({"scores": Vocabulary.read(vocabulary).scores})

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = shipped.value
        if "machine" not in kept:
            kept["machine"] = Transducer(Vocabulary(kept["scores"]))
        for texts in batches:
            yield pd.Series([kept["machine"].count(x, chunk) for x in texts], dtype="int64")

    return df.withColumn(out, counted(F.col(f"`{text}`")))


def digest(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    own = only(docs, "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return with_counts(own).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
