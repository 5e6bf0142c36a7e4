"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule votes good (2), bad (1) or abstains (0) on counts taken from the whole text. The model: a document is good with an unknown
prior probability, and each rule gives each of its votes, abstention included, with unknown probabilities under either class,
independently of the other rules. Expectation-maximisation estimates the prior and all of these (and so each rule's accuracy)
from how often each combination of votes occurs over all documents; the same likelihood serves both steps. As the classes have
no names of their own, a weak prior says which is which: WEIGHT times the corpus again, in which a rule's votes are right with
probability BELIEF; it is a share of the corpus, so that it weighs alike at every size. There are 3 ** 9 combinations at most, so that table,
and what is broadcast back, is bounded whatever the corpus. A document stays when its posterior probability of being good is at
least one half (at exactly one half it stays).

Defined cases: a null or empty text has counts of zero and fails; a very long text is counted whole, in a slab of its own; an empty table
gives an empty result; repeated rows are judged alike; other columns, whatever their names, are ignored and kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import WordHash, documents, unused, window_hashes, with_columns, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
WINDOW = 8
GOOD, BAD = 2, 1
#: The weak prior: how likely a vote, or an unseen document, is taken to be right, or good; and its weight against the corpus.
BELIEF, WEIGHT = 0.9, 0.2

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_capitals", "n_marked", "n_lettered")


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """How many words lie in windows of `width` words that occur twice or more."""
    if len(hashes) < 2 * 1 + width - 1:
        return 0
    found = window_hashes(hashes, width)
    _, place, times = np.unique(found, return_inverse=True, return_counts=True)
    twice = times[place] > 1
    if not twice.any():
        return 0
    ends = np.zeros(len(hashes) + 1, np.int32)
    ends[: len(found)] += twice
    ends[width:] -= twice
    return int((np.cumsum(ends[:-1]) > 0).sum())


def words_with(raw: bytes, some: bytes) -> int:
    """How many words hold one of these bytes."""
    return len(raw.translate(None, bytes(set(range(256)) - set(some) - set(SPACES))).split())


def _counter():
    hashes = WordHash()

    def of(texts: pa.Array) -> list:
        rows = []
        for text in texts.to_pylist():
            text = text or ""
            raw = text.encode()
            found = raw.split()
            h = hashes.of(found)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            spaces = len(raw) - len(raw.translate(None, SPACES))
            capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            small = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
            rows.append((
                len(found), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                repeated_words(h), len(lines), len(np.unique(h)), capitals + small, capitals, words_with(raw, SYMBOLS), words_with(raw, LETTERS),
            ))
        return [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]

    return of


def _vote(bad: Column, good: Column | None = None) -> Column:
    found = F.when(bad, BAD)
    return (found if good is None else found.when(good, GOOD)).otherwise(0)


def votes(c: Callable[[str], Column]) -> dict[str, Column]:
    """The rules on the counts c(name): fixed limits, as documented in the README. Rules of a fault abstain where they do not see it."""
    n = F.greatest(c("n_words"), F.lit(1))
    return {
        "length": _vote(c("n_words") < 20, c("n_words") >= 40),
        "word_length": _vote((c("word_chars") < 2 * n) | (c("word_chars") > 15 * n), (c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n)),
        "symbols": _vote(c("n_symbols") * 10 > 3 * n),
        "lines": _vote(c("n_dup_lines") * 2 > F.greatest(c("n_lines"), F.lit(1))),
        "repeats": _vote(c("n_repeat_words") * 100 > 30 * n),
        "capitals": _vote(c("n_capitals") * 2 > c("n_letters")),
        "variety": _vote(c("n_distinct") * 10 < n, c("n_distinct") * 4 >= n),
        "marked": _vote(c("n_marked") * 20 > n, c("n_marked") * 50 <= n),
        "lettered": _vote(c("n_lettered") * 10 < 8 * n, c("n_lettered") * 10 >= 9 * n),
    }


RULES = 9


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float]:
    """patterns (rows of 0, 1, 2) and how often each occurs -> P(vote | class), shape (rules, 2, 3), class 1 good; and P(good)."""
    total = weights.sum()
    right = np.array([[1 - BELIEF, BELIEF], [BELIEF, 1 - BELIEF], [1 - BELIEF, BELIEF]])  # of each vote: its share of bad and good documents
    hit = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # (patterns, rules, votes)
    seen = np.einsum("p,pjv->jv", weights, hit)
    given = WEIGHT * (seen + total / 1000 + 1e-9)[:, None, :] * right.T
    table, prior = given / given.sum(axis=2, keepdims=True), BELIEF
    for _ in range(rounds):
        good = posterior(patterns, table, prior)
        before = table
        table = given + np.einsum("pc,pjv->jcv", np.stack([weights * (1 - good), weights * good], axis=1), hit)
        table /= table.sum(axis=2, keepdims=True)
        prior = float((weights @ good + WEIGHT * total * BELIEF) / (total * (1 + WEIGHT))) if total else BELIEF
        if np.abs(table - before).max(initial=0) < 1e-9:
            break
    return table, prior


def posterior(patterns: np.ndarray, table: np.ndarray, prior: float) -> np.ndarray:
    """P(good | votes) of each pattern."""
    rules = np.arange(patterns.shape[1])
    bad, good = (np.log(table[rules, k, patterns]).sum(axis=1) for k in (0, 1))
    return 1 / (1 + np.exp(np.clip(bad + np.log(1 - prior) - good - np.log(prior), -500, 500)))


def judged(docs: DataFrame, text_col: str, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """Every row of docs with its counts, posterior, base_failed and kept; and the names of these columns, none of which docs has.

    The counted rows are written once; the votes' model is fitted to the table of their codes and brought back by a broadcast.
    """
    spark = docs.sparkSession
    names = (*COUNTS, "code", "posterior", "base_failed", "kept")
    name = dict(zip(names, unused(docs, *(f"__{c}" for c in names)), strict=True))
    c = lambda x: F.col(name[x])
    code = sum((v * 3**j for j, v in enumerate(votes(c).values())), F.lit(0)).cast("int")
    rows = with_columns(docs, [text_col], ", ".join(f"{name[x]} long" for x in COUNTS), _counter).withColumn(name["code"], code)
    table = written(rows if keep_text else rows.drop(text_col), "signals")
    counted = table.groupBy(name["code"]).agg(F.count("*")).collect()  # 3 ** RULES rows at most
    codes, weights = (np.array([r[i] for r in counted], np.int64) for i in (0, 1))
    patterns = codes[:, None] // 3 ** np.arange(RULES) % 3 if len(codes) else np.zeros((0, RULES), np.int64)
    good = posterior(patterns, *fit(patterns, weights.astype(float)))
    verdicts = spark.createDataFrame([(int(x), float(g)) for x, g in zip(codes, good, strict=True)], f"{name['code']} int, {name['posterior']} double")
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    found = table.join(F.broadcast(verdicts), name["code"]).withColumn(name["base_failed"], failed)
    return found.withColumn(name["kept"], ~c("base_failed") & (c("posterior") >= 0.5)), name


def accepted(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    found, name = judged(docs, text_col)
    return found.where(name["kept"]).select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its counts, the base verdict, the method's posterior and whether it stays."""
    # Only counts are kept of a text here, so the table that is written is small.
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, name = judged(docs, "text", keep_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return found.select("doc_id", *(F.col(name[c]).alias(c) for c in names))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {}
