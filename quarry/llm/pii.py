"""Personal data in whole texts: fixed patterns, and spans that a character-level BiLSTM-CRF adds.

The tagger (tagger.py) is trained here, in numpy, from labelled spans. It reads overlapping windows over every whole text.
Where windows overlap, each character takes its label from the window in which it is farther from a cut, and runs of labels go on
from one window into the next, so that a span is whole whatever the cut. A tagged span is added if it has the marks of its kind (an address and a dot, as signs, in brackets or
spelled out; 9 to 15 digits; 13 to 19 digits passing Luhn; four parts) and meets no other span.

Defined cases: a null or empty text has no spans; a very long text is a slab of its own, held with a byte for each character and
label; an empty table gives an empty result; repeated rows are judged alike; of
overlapping base spans of different kinds all stay; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import documents, map_rows, parts
from quarry.llm.tagger import KINDS, Tagger, classes, examples, train

#: The base patterns. A run of digits is not entered in its middle: its tail would fail as the whole did.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Forms of the marks that a tagged span can have.
_SIGN = r" ?(?:{sign}|[\[({{<] ?(?:{sign}|{word}) ?[\])}}>]) ?"
_DOT = _SIGN.format(sign=r"\.", word="dot")
_SAID = rf"(?:{_DOT}| +dot +)"
ADDRESS = re.compile(rf"[a-z0-9._%+-]+(?:{_SIGN.format(sign='@', word='at')}[a-z0-9-]+(?:{_SAID}[a-z0-9-]+)+| +at +[a-z0-9-]+(?: +dot +[a-z0-9-]+)+)", re.IGNORECASE | re.ASCII)
PARTS = re.compile(rf"([0-9]+){_SAID}([0-9]+){_SAID}([0-9]+){_SAID}([0-9]+)", re.IGNORECASE | re.ASCII)
#: Windows of READ characters are decoded; neighbours share OVERLAP. A text's last window is padded to a multiple of PAD.
READ, OVERLAP, PAD = 256, 48, 32
BATCH = 512

Span = tuple[int, int, str]


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([c for c in number if "0" <= c <= "9"])):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def n_digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def octet(digits: str) -> bool:
    """Whether digits, however many, are 255 at most."""
    return len(digits.lstrip("0")) <= 3 and int(digits[-3:]) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass, by kind and place."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(octet, m.groups()))]
        found += [(*m.span(), "card") for m in CARD.finditer(text) if 13 <= n_digits(m[0]) <= 19 and luhn(m[0])]
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= n_digits(m[0]) <= 15]
    return found


def windows(n: int) -> list[int]:
    """Where the windows over a text of n characters begin."""
    return [0] if n <= READ else list(range(0, n - OVERLAP, READ - OVERLAP))


def owned(n: int, begins: list[int]) -> list[tuple[int, int]]:
    """Of each window the part of the text that takes its labels: each character is read where it is farthest from a cut."""
    cuts = [0, *(b + OVERLAP // 2 for b in begins[1:]), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def labels(texts: list[str], tagger: Tagger) -> list[np.ndarray | None]:
    """A label for each character of each text; None where all are outside. Windows of equal classes are decoded once."""
    joined = classes("".join(texts))
    begin, length, place = [], [], []  # of each window: where it begins in all texts, its characters, and what it owns
    at = 0
    for t in texts:
        if t:
            begins = windows(len(t))
            begin += [at + b for b in begins]
            length += [min(READ, len(t) - b) for b in begins]
            place += [(at + a, at + b) for a, b in owned(len(t), begins)]
        at += len(t)
    out, any_ = np.zeros(len(joined), np.int8), np.zeros(len(joined) + 1, bool)
    begin_, length_ = np.array(begin, np.int64), np.array(length, np.int64)
    padded = np.concatenate([joined, np.zeros(READ, np.uint8)])
    steps = -(-length_ // PAD) * PAD
    for n in np.unique(steps).tolist():
        here = np.flatnonzero(steps == n)
        x = padded[begin_[here][:, None] + np.arange(n)]
        x[np.arange(n) >= length_[here][:, None]] = 0
        distinct, of = np.unique(x.view(np.dtype((np.void, n))).ravel(), return_inverse=True)
        rows = distinct.view(np.uint8).reshape(-1, n)
        found = np.concatenate([tagger.decode(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)])
        tagged = found.any(axis=1)
        for w, row in zip(here[tagged[of]].tolist(), found[of[tagged[of]]], strict=True):
            a, b = place[w]
            out[a:b] = row[a - begin[w] : b - begin[w]]
            any_[a] = True
    ends = np.cumsum([len(t) for t in texts]).tolist()
    return [out[a:b] if any_[a:b].any() else None for a, b in zip([0, *ends], ends, strict=False)]


def labelled_runs(row: np.ndarray) -> list[Span]:
    found: list[list] = []
    for i in np.flatnonzero(row).tolist():
        label = int(row[i])
        kind = KINDS[(label - 1) // 2]
        if found and found[-1][1] == i and found[-1][2] == kind and label % 2 == 0:
            found[-1][1] += 1
        else:
            found.append([i, i + 1, kind])
    return [(a, b, k) for a, b, k in found]


def has_marks(text: str, kind: str) -> bool:
    """Whether a tagged span can be of its kind at all."""
    n = n_digits(text)
    if kind == "email":
        return bool(ADDRESS.fullmatch(text))
    if kind == "card":
        return 13 <= n <= 19 and luhn(text) and bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", text))
    if kind == "phone":
        return 9 <= n <= 15 and bool(re.fullmatch(r"\+?\(?[0-9]{1,4}\)?(?:[ .-]{1,2}\(?[0-9]{2,4}\)?){2,5}", text))
    found = PARTS.fullmatch(text)
    return bool(found) and all(map(octet, found.groups()))


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Of each text its base spans, and those that the tagger adds."""
    found = []
    for t, row in zip(texts, labels(texts, tagger), strict=True):
        base, added = base_spans(t), []
        taken = sorted((a, b) for a, b, _ in base)
        starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
        for start, end, kind in labelled_runs(row) if row is not None else []:
            if kind == "email" and (match := ADDRESS.search(t, start, end)):  # a run can hold words before or after
                start, end = match.span()
            whole = (start == 0 or not (t[start - 1].isalnum() and t[start].isalnum())) and (end == len(t) or not (t[end].isalnum() and t[end - 1].isalnum()))
            before = bisect.bisect_left(starts, end)  # base spans that begin before its end
            if whole and has_marks(t[start:end], kind) and (not before or reach[before - 1] <= start):
                added.append((start, end, kind))
        found.append((base, added))
    return found


@functools.lru_cache(maxsize=2)
def trained(steps: int = 1000, batch: int = 48) -> Tagger:
    """The tagger of the labelled examples; the same in every run."""
    return train(examples(), steps, batch)


SPANS = "base array<struct<start:long,end:long,kind:string>>, added array<struct<start:long,end:long,kind:string>>"


def found_in(docs: DataFrame, id_col: str, text_col: str, tagger: Tagger | None = None) -> DataFrame:
    """(id, base, added): spans in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast((tagger or trained()).weights)

    def make():
        tagger_ = Tagger(shared.value)
        rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

        def of(ids: pa.Array, texts: pa.Array) -> list:
            found = all_spans([t or "" for t in texts.to_pylist()], tagger_)
            return [ids, [rows(b) for b, _ in found], [rows(a) for _, a in found]]

        return of

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), f"id long, {SPANS}", make)


def redacted(docs: DataFrame, text_col: str, tagger: Tagger | None = None) -> DataFrame:
    """docs with [KIND] in place of every span, base or added; all columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast((tagger or trained()).weights)
    schema = docs.schema
    place = docs.columns.index(text_col)

    def run(batches):
        tagger_ = Tagger(shared.value)
        for batch in batches:
            for part in parts(batch, 512):
                texts = part.column(place).to_pylist()
                new = [t if t is None else masked(t, b + a) for t, (b, a) in zip(texts, all_spans([t or "" for t in texts], tagger_), strict=True)]
                columns = list(part.columns)
                columns[place] = pa.array(new, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """Overlapping spans are masked as one, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    found = found_in(documents(spark, sf_dir), "doc_id", "text")
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)

    def text_of(spans):
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat("base", "added")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
ORACLES = {}
