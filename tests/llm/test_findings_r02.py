"""What the findings of the second round asked for."""

import random
from collections import Counter

import ahocorasick

from quarry.llm import token_counts
from quarry.llm.pretokens import STRETCH, public_path, public_pattern, read_ranks, stretches


def test_a_pretoken_is_counted_once_whatever_stands_beside_it(monkeypatch):
    costs = token_counts.learnt_costs(read_ranks(public_path("byte_bpe_multi_50k.tiktoken")), {0: 1})
    counter, asked, count = token_counts.Counter(costs, public_pattern()), Counter(), token_counts.Trie.count
    monkeypatch.setattr(token_counts.Trie, "count", lambda self, word: asked.update([word]) or count(self, word))
    found = [counter.counts(t) for t in ("a forest, a forest. a forest", "the forest; no forest!", "a forest")]
    assert [n for n, _ in found] == [8, 6, 2]
    assert asked[b" forest"] == 1 and max(asked.values()) == 1


def test_the_automaton_takes_one_step_a_node():
    costs = token_counts.learnt_costs(read_ranks(public_path("byte_bpe_multi_50k.tiktoken")), {0: 1})
    trie, steps = token_counts.Trie(costs), []
    step = trie.tokens.step
    trie.tokens.step = lambda state, b: steps.append(b) or step(state, b)
    for word in (b" international", b" internationally", b" internal", b" international"):
        trie.count(word)
    assert len(steps) == len(trie.best) - 1 == len(b" international") + 2 + 1


def test_stretches_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb c", "a\n\nb", "a\tb  c", "a\x00b c", "a\x1cb c", "a\u3000b", "a \nb", "a\n b"]
    texts += ["".join(rng.choice("ab \n\t\x00\x1c\x85\u2003é.") for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert [stretches(t) for t in texts] == [STRETCH.findall(t) for t in texts]


def test_pretokens_cut_together_are_cut_as_alone():
    rng, ranks = random.Random(4), read_ranks(public_path("byte_bpe_multi_50k.tiktoken"))
    longest = ahocorasick.Automaton()
    for token, rank in ranks.items():
        longest.add_word(token.decode("latin-1"), rank)
    longest.make_automaton()
    pieces = {"".join(rng.choice("etaoinshr éñ日🎉.") for _ in range(rng.randint(1, 14))): rng.randint(1, 3) for _ in range(3000)}
    want = Counter()
    for piece, n in pieces.items():
        raw, at = piece.encode(), 0
        while at < len(raw):
            end = next(e for e in range(min(len(raw), at + 130), at, -1) if raw[at:e] in ranks)
            want[ranks[raw[at:end]]] += n
            at = end
    assert token_counts.cut_longest(pieces, ranks, longest) == want
