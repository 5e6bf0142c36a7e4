"""Token counts by a unigram model, with dynamic programming shared in a trie of the distinct pre-tokens.

The vocabulary is a public one; the probabilities of its tokens are learnt from the corpus in one counting pass: the pre-tokens of
all texts are cut into tokens, each time the longest that fits, these are counted over all documents, and the counts, one more
each, give the probabilities. They are a table of one row a token.

A segmentation of a pre-token costs the sum of -log2 of its tokens' probabilities, in units of 2 ** -20; the cheapest counts, on a
tie the one of fewer tokens. Every node of the trie holds the best (cost, tokens) of its prefix, computed once from the nodes above it and
the tokens that an automaton finds to end there, and the automaton's state, from which the nodes below go on; a pre-token's count is
read at its last node. The trie of a Python worker is emptied when it reaches a bound, and holds the first DEPTH bytes of a pre-token
at most, so memory does not grow with the corpus; the counts of short pre-tokens and stretches are remembered up to a bound.

Defined cases: a null or empty text has no tokens; a very long text is a slab of its own, and a pre-token of any length is counted
whole; an empty table gives an empty result; repeated rows count alike; other columns are ignored.
"""

from __future__ import annotations

import collections
import math
import operator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import documents, map_rows, parts, written
from quarry.llm.pretokens import Memory, Splitter, public_path, public_pattern, read_ranks, stretches

NODES, DEPTH = 600_000, 128
REMEMBERED = 400_000
UNIT = 1 << 20
#: More than the tokens of any pre-token.
MANY = 1 << 32
#: Stands between pre-tokens; a byte is a character below it.
APART = "\u0100"


def learnt_costs(ranks: dict[bytes, int], times: dict[int, int]) -> dict[bytes, int]:
    """times: how often each rank occurs."""
    whole = math.log2(sum(times.values()) + len(ranks))
    return {t: round((whole - math.log2(times.get(r, 0) + 1)) * UNIT) for t, r in ranks.items()}


class Automaton:
    """Aho-Corasick over the tokens, state by state, so that a trie's node can hold its state and go on from there."""

    def __init__(self, costs: dict[bytes, int]) -> None:
        self.goto: dict[int, int] = {}  # state << 8 | byte
        own: list[tuple[tuple[int, int], ...]] = [()]
        for token, cost in costs.items():
            state = 0
            for b in token:
                after = self.goto.get(state << 8 | b)
                if after is None:
                    self.goto[state << 8 | b] = after = len(own)
                    own.append(())
                state = after
            own[state] = ((len(token), cost * MANY + 1),)
        below: dict[int, list[int]] = collections.defaultdict(list)
        for key in self.goto:
            below[key >> 8].append(key)
        self.fail, self.ends = [0] * len(own), own  # ends: (bytes, MANY * cost + 1) of each token that ends in a state
        level = [0]
        while level:
            deeper = []
            for key in (k for state in level for k in below.get(state, ())):
                after = self.goto[key]
                if key >> 8:
                    self.fail[after] = self.step(self.fail[key >> 8], key & 255)
                    own[after] += own[self.fail[after]]
                deeper.append(after)
            level = deeper

    def step(self, state: int, b: int) -> int:
        goto, fail = self.goto, self.fail
        while (after := goto.get(state << 8 | b)) is None:  # the first state has a way on for every byte
            state = fail[state]
        return after


class Trie:
    """costs: an integer cost for each token; every single byte must be one."""

    def __init__(self, costs: dict[bytes, int], bound: int = NODES) -> None:
        self.bound = bound
        self.tokens = Automaton(costs)
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [0]  # of each node's prefix: MANY * cost + tokens
        self.state = [0]  # the automaton's, after each node's prefix

    def count(self, word: bytes) -> int:
        """Tokens of the cheapest segmentation; adds the nodes that the trie lacks."""
        if len(self.best) > self.bound:
            self.reset()
        child, best, state_of = self.child, self.best, self.state
        at, path = 0, [0]
        for b in word[:DEPTH]:
            node = child.get(at << 8 | b)
            if node is None:
                break
            at = node
            path.append(best[at])
        depth = len(path) - 1
        if depth < len(word):
            step, ends, state = self.tokens.step, self.tokens.ends, state_of[at]
            for b in word[depth:]:
                state = step(state, b)
                path.append(min([path[-size] + own for size, own in ends[state]]))
                if len(path) <= DEPTH + 1:
                    child[at << 8 | b] = at = len(best)
                    best.append(path[-1])
                    state_of.append(state)
        return path[-1] % MANY


class Pieces(Memory):
    """Tokens of each pre-token."""

    def __init__(self, trie: Trie, bound: int) -> None:
        super().__init__(bound)
        self.trie = trie

    def __missing__(self, piece: str) -> int:
        n = self.trie.count(piece.encode())
        if len(piece) <= DEPTH:
            self[piece] = n
        return n


class Stretches(Memory):
    """Of each stretch its pre-tokens << 40 | tokens."""

    def __init__(self, pieces: Pieces, split: Splitter, bound: int) -> None:
        super().__init__(bound)
        self.pieces, self.split = pieces, split

    def __missing__(self, stretch: str) -> int:
        found = self.split(stretch)
        both = len(found) << 40 | sum(map(self.pieces.__getitem__, found))
        if len(stretch) <= DEPTH:
            self[stretch] = both
        return both


class Counter:
    def __init__(self, costs: dict[bytes, int], pattern: str) -> None:
        self.pieces = Pieces(Trie(costs), REMEMBERED)
        self.stretches = Stretches(self.pieces, Splitter(pattern), REMEMBERED)

    def counts(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        self.stretches.room()
        self.pieces.room()
        both = sum(map(self.stretches.__getitem__, stretches(text)))
        return both >> 40, both & (1 << 40) - 1


def cut_longest(pieces: dict[str, int], ranks: dict[bytes, int], longest: ahocorasick.Automaton) -> collections.Counter:
    """Pre-tokens and how often each occurs -> how often each rank is cut off them, the longest token first.

    Pre-tokens that occur equally often are cut in one run, with a character that no token holds between them.
    """
    times: collections.Counter = collections.Counter()
    alike = collections.defaultdict(list)
    for piece, n in pieces.items():
        raw = piece.encode()
        if raw in ranks:
            times[ranks[raw]] += n
        else:
            alike[n].append(raw.decode("latin-1"))
    for n, some in alike.items():
        for rank, k in collections.Counter(map(operator.itemgetter(1), longest.iter_long(APART.join(some)))).items():
            times[rank] += n * k
    return times


def token_times(docs: DataFrame, text_col: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(rank, times): how often each token is cut off all texts' pre-tokens, the longest first; a row for each token that occurs."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        ranks_, pattern_ = shared.value
        split, longest = Splitter(pattern_), ahocorasick.Automaton()
        for token, rank in ranks_.items():
            longest.add_word(token.decode("latin-1"), rank)
        longest.make_automaton()
        times: collections.Counter = collections.Counter()
        seen: collections.Counter = collections.Counter()

        def settle() -> None:
            pieces: dict[str, int] = collections.defaultdict(int)
            for s, n in seen.items():
                for piece in split(s):
                    pieces[piece] += n
            seen.clear()
            times.update(cut_longest(pieces, ranks_, longest))

        for batch in batches:
            for part in parts(batch, 512):
                for t in part.column(0).to_pylist():
                    seen.update(stretches(t or ""))
                if len(seen) > REMEMBERED:
                    settle()
        settle()
        yield pa.RecordBatch.from_pydict({"rank": pa.array(times.keys(), pa.int32()), "times": pa.array(times.values(), pa.int64())})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "rank int, times long")
    return written(rows.groupBy("rank").agg(F.sum("times").alias("times")), "unigrams")


_COUNTERS: dict[str, Counter] = {}


def counted(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None, times: DataFrame | None = None) -> DataFrame:
    """(id, n_pretokens, n_tokens) of every whole text. path: a rank file, read on the driver; its size bounds what is broadcast and collected.

    times: (rank, times), the table that the probabilities come from; without one it is made of docs.
    """
    path, pattern = path or public_path("byte_bpe_multi_50k.tiktoken"), pattern or public_pattern()
    ranks = read_ranks(path)
    learnt = (times or token_times(docs, text_col, ranks, pattern)).groupBy("rank").agg(F.sum("times").alias("times"))
    found = {r["rank"]: r["times"] for r in learnt.toLocalIterator()}  # a row for each token of the vocabulary at most
    shared = docs.sparkSession.sparkContext.broadcast((learnt_costs(ranks, found), pattern, f"{path} {pattern} {hash(frozenset(found.items()))}"))

    def make():
        costs, split, key = shared.value
        if key not in _COUNTERS:  # a worker serves many tasks
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(costs, split)
        counter = _COUNTERS[key]

        def of(ids: pa.Array, texts: pa.Array) -> list:
            found = [counter.counts(t or "") for t in texts.to_pylist()]
            return [ids, [a for a, _ in found], [b for _, b in found]]

        return of

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id long, n_pretokens long, n_tokens long", make)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: pre-tokens and tokens."""
    return counted(documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES = {}
