"""Text and date-time features as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The default stop words.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "the")


def split_words(x: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once: a lambda's variable is a value, where a Column inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _places(length: Column, n: int) -> Column:
    last = length - n + 1
    return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Runs of n words joined by a space."""
    return _once(tokens, lambda w: F.transform(_places(F.size(w), n), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))


def char_ngrams(x: Column, n: int) -> Column:
    return _once(x, lambda t: F.transform(_places(F.length(t), n), lambda i: F.substring(t, i, F.lit(n))))


def gram_counts(df: DataFrame, grams: Column, least: int = 1) -> DataFrame:
    """(gram, n) over all rows."""
    return df.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_stop_words(x: Column, stop_words: Sequence[str] = STOP_WORDS, case_sensitive: bool = False) -> Column:
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    stops = F.array(*map(F.lit, stop_words))
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(stops, w if case_sensitive else F.lower(w))), " ")


def vocabulary(df: DataFrame, tokens: Column, size: int, least: int = 1) -> DataFrame:
    """(token, n, token_id): the `size` commonest tokens, ties by text, numbered from 1."""
    counts = gram_counts(df, tokens, least).withColumnRenamed("gram", "token")
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    return top.withColumn("token_id", F.row_number().over(W.orderBy(F.desc("n"), "token")))


def tf_idf(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, token, tf, idf, tfidf): tf = count / length, idf = ln(N / (df + 1)) + 1."""
    each = df.select(id_col, F.size(tokens).alias("len"), F.explode(tokens).alias("token"))
    tf = each.groupBy(id_col, "token", "len").agg(F.count("*").alias("c"))
    n = df.count()
    idf = tf.groupBy("token").agg((F.log(F.lit(float(n)) / (F.count("*") + 1)) + 1).alias("idf"))
    return tf.join(idf, "token").select(id_col, "token", (F.col("c") / F.col("len")).alias("tf"), "idf", (F.col("c") / F.col("len") * F.col("idf")).alias("tfidf"))


def find_all(x: Column, pattern: str) -> Column:
    """Every offset from 0 at which a text occurs, overlapping ones too."""
    at = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    return F.transform(F.filter(at, lambda i: F.substring(x, i, F.lit(len(pattern))) == pattern), lambda i: i - 1)


def kmer_cosine(a: Column, b: Column, k: int) -> Column:
    """Cosine of the k-mer counts of two texts."""
    dot = lambda p, q: F.aggregate(F.transform(p, lambda g: F.size(F.filter(q, lambda h: h == g))), F.lit(0), lambda s, v: s + v)
    cosine = lambda x, y: F.when(dot(x, x) * dot(y, y) > 0, dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).otherwise(0.0)
    return _once(char_ngrams(a, k), lambda x: _once(char_ngrams(b, k), lambda y: cosine(x, y)))


# Date-time


def date_parts(ts: Column) -> dict[str, Column]:
    """Monday is 0, weeks are ISO's."""
    return {
        "year": F.year(ts), "quarter": F.quarter(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts).cast("int"),
        "weekday": F.weekday(ts), "day_of_year": F.dayofyear(ts), "week": F.weekofyear(ts), "is_weekend": F.weekday(ts) >= 5,
        "is_month_start": F.dayofmonth(ts) == 1, "is_month_end": F.last_day(ts) == F.to_date(ts), "is_year_start": F.dayofyear(ts) == 1,
    }


def epoch(ts: Column, unit: str = "s") -> Column:
    """Whole units since 1970, rounded down; ts without a time zone counts as UTC."""
    micros = F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), "UTC"))
    per = {"ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}[unit]
    return F.floor(micros / per)


def business_flags(ts: Column, holidays: Sequence[str] = ()) -> dict[str, Column]:
    day = F.to_date(ts)
    off = day.isin(*(F.to_date(F.lit(h)) for h in holidays)) if holidays else F.lit(False)
    work = (F.weekday(ts) < 5) & ~off
    return {"is_business_day": work, "is_holiday": off, "is_monday": F.weekday(ts) == 0, "is_friday": F.weekday(ts) == 4, "is_quarter_end": (F.last_day(ts) == day) & F.month(ts).isin(3, 6, 9, 12), "is_business_hour": work & (F.hour(ts) >= 9) & (F.hour(ts) < 17)}


def to_zone(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts)


#: English suffixes of the steps of Porter's rules, and what they become; the longest that fits counts.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(word: str) -> str:
    """Porter's stem of a lower-case English word."""
    import re

    def shape(x: str) -> str:
        """c and v for the letters: y is a vowel after a consonant."""
        out = ""
        for i, ch in enumerate(x):
            out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
        return out

    def measure(x: str) -> int:
        return len(re.findall("v+c+", shape(x)))

    def ends_double(x: str) -> bool:
        return len(x) > 1 and x[-1] == x[-2] and shape(x)[-1] == "c"

    def ends_cvc(x: str) -> bool:
        return len(x) > 2 and shape(x)[-3:] == "cvc" and x[-1] not in "wxy"

    def longest(x: str, suffixes) -> str | None:
        return max((s for s in suffixes if x.endswith(s)), key=len, default=None)

    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for s in ("ed", "ing"):
            if word.endswith(s) and "v" in shape(word[: -len(s)]):
                word = word[: -len(s)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif ends_double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = longest(word, table)
        if s and measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = longest(word, STEP_4)
    if s and measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not ends_cvc(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(df: DataFrame, id_col: str, tokens: Column, name: str = "stems") -> DataFrame:
    """(id, stems): each row's tokens, in order, as stems. Only distinct tokens are stemmed, and joined back."""
    import pandas as pd

    each = df.select(F.col(id_col), F.posexplode_outer(tokens).alias("p", "w"))
    words = each.select("w").where("w IS NOT NULL").distinct()

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"w": part["w"], "s": [stem(w.lower()) for w in part["w"]]})

    table = words.mapInPandas(run, "w string, s string")
    joined = each.join(table, "w", "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "s")))).alias("x"))
    return joined.select(id_col, F.transform("x", lambda v: v["s"]).alias(name))


def polarity(tokens: Column, scores: dict[str, float], negations: Sequence[str] = ("not", "no", "never")) -> Column:
    """The mean score of the words that have one; after a negation a score's sign turns. 0 where no word has one."""
    table = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))
    lower = F.transform(tokens, lambda w: F.lower(w))

    def of(t: Column) -> Column:
        value = lambda w, i: F.element_at(table, w) * F.when((i > 0) & F.get(t, i - 1).isin(list(negations)), -1.0).otherwise(1.0)
        found = F.filter(F.transform(t, value), lambda v: v.isNotNull())
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, v: a + v) / F.size(found)).otherwise(0.0)

    return _once(lower, of)


#: English endings and what they usually mark.
ENDINGS = (("ing", "VERB"), ("ed", "VERB"), ("ly", "ADV"), ("ous", "ADJ"), ("ful", "ADJ"), ("able", "ADJ"), ("ive", "ADJ"), ("tion", "NOUN"), ("ment", "NOUN"), ("ness", "NOUN"), ("ity", "NOUN"))
CLOSED = {"the": "DET", "a": "DET", "an": "DET", "this": "DET", "that": "DET", "of": "ADP", "in": "ADP", "on": "ADP", "to": "ADP", "with": "ADP", "for": "ADP", "and": "CONJ", "or": "CONJ", "but": "CONJ", "he": "PRON", "she": "PRON", "it": "PRON", "they": "PRON", "we": "PRON", "i": "PRON", "you": "PRON", "is": "VERB", "are": "VERB", "was": "VERB", "were": "VERB", "be": "VERB", "has": "VERB", "have": "VERB"}


def word_class(word: Column) -> Column:
    """A rule tagger: closed classes by a list, numbers by their digits, the rest by ending; NOUN where none fits."""
    w = F.lower(word)
    table = F.create_map(*(F.lit(x) for kv in CLOSED.items() for x in kv))
    out = F.lit("NOUN")
    for ending, tag in reversed(ENDINGS):
        out = F.when(w.endswith(ending) & (F.length(w) > len(ending) + 1), tag).otherwise(out)
    return F.coalesce(F.element_at(table, w), F.when(w.rlike("^[0-9][0-9.,]*$"), "NUM").otherwise(out))


def topics(df: DataFrame, id_col: str, tokens: Column, k: int, words: int = 2000, least: int = 2, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(topic, word, weight) and (id, shares): latent Dirichlet allocation over the commonest words."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    rows = df.select(F.col(id_col), F.coalesce(tokens, F.array().cast("array<string>")).alias("__t"))
    counter = CountVectorizer(inputCol="__t", outputCol="features", vocabSize=words, minDF=float(least)).fit(rows)
    model = LDA(k=k, maxIter=rounds, seed=1, optimizer="online").fit(counter.transform(rows))
    found = model.describeTopics(10).withColumn("x", F.explode(F.arrays_zip("termIndices", "termWeights")))
    names = df.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "termIndices int, word string")
    listed = found.select("topic", F.col("x.termIndices").alias("termIndices"), F.col("x.termWeights").alias("weight")).join(F.broadcast(names), "termIndices").select("topic", "word", "weight")
    return listed, model.transform(counter.transform(rows)).select(id_col, F.col("topicDistribution").alias("shares"))
