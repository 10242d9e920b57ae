"""Problem 4: broken prompt and response pairs.

Each item gets at most one defect, the first that holds of ``empty``, ``copy``,
``refusal``, ``other_language`` and ``truncated``.

Languages are told apart by naive Bayes over hashed character trigrams, trained
on labelled rows and then on rows of the items themselves that it is sure of.
An answer is in another language if the posteriors of question and answer make
it likely that they differ; a class of its own stands for all languages nobody
labelled.  A text of few letters leaves its posterior near the prior.  An answer
declines if all its sentences speak of the question or are courtesies; which
these are, naive Bayes over character n-grams learns from short answers that
deny an answer, against the sentences of long answers.  Truncation is judged by
how likely a text ends after its last words: of all places in all answers where
these words stand, the share where a sentence ends.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold_accents, name_words
from ..session import cut

BUCKETS = 1 << 15
#: Trigrams that say as much as one independent one: neighbours overlap and texts repeat themselves.
TRIGRAMS_ALIKE = 8
#: Chance that a text is in none of the labelled languages, before it is read.
OTHER_CHANCE = 0.02
#: Chance that question and answer differ in language from which on they are taken to.
DIFFER = 0.9
#: Likelihood of an end below which a text without closing sign breaks off.
END_LIKELIHOOD = 0.5
#: The same for the last word alone, which is asked besides: phrases cut off often at one place have it low.
WORD_END_LIKELIHOOD = 0.02
#: Times the last words must stand elsewhere before they are trusted; with fewer, one word less is looked at.
LEAST_SEEN = 3

# Fixed values, without accents: what stands for no content, and mere courtesy.
PLACEHOLDERS = ("", "null", "none", "nan", "n a", "na", "nil", "undefined", "khong co", "khong co noi dung", "chua co noi dung", "noi dung dang cap nhat", "dang cap nhat", "dang cap nhap", "chua cap nhat", "tra loi", "cau tra loi", "noi dung tra loi", "khong co du lieu", "chua co du lieu", "xem file dinh kem", "todo", "tbd", "answer", "no content", "no answer", "not available", "updating", "br", "p p", "nbsp", "p nbsp p")
COURTESY = r"^(?:cam on|xin cam on|mong ong|mong quy|rat mong|de nghi ong|kinh chao|chao ong|kinh gui|xin loi|tran trong|xin thong bao|thong cam|tra loi$|ve van de nay|ong ba hoi|thank you|dear|please)|thong cam$|tran trong(?: cam on)?$"
CLOSINGS = r"^(?:xin )?(?:tran trong(?: cam on)?|cam on|kinh thu|kinh chao|thong bao de (?:ong ba|quy vi|ban) (?:duoc )?biet)$"
# Fixed values, without accents: words that deny, and words for asking and answering; a sentence with both is a seed of declining.
DENIALS = r"\b(?:khong|chua|tu choi|ngoai|rat tiec|xin loi|can ?not|can t|unable|not|decline|refuse|sorry)\b"
ANSWERING = r"\b(?:cau hoi|noi dung hoi|van de|tra loi|giai dap|tu van|y kien|yeu cau nay|huong dan|tiep nhan|thong tin|answer|question|request|advice|information)\b"

_TAG = r"<[^<>]*>|&(?:nbsp|#160);"
_ENDS, _AFTER_END = ".!?…。！？", r"\s\"'”’)\]"


def _visible(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _TAG, " ")


# ---------------------------------------------------------------- languages


def trigram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the character trigrams of a text in lower case; digits and signs count as spaces."""
    words = re.sub(r"[\W\d_]+", " ", unicodedata.normalize("NFC", text).lower())
    codes = np.frombuffer(f" {words.strip()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _bare(text: str) -> str:
    loose = unicodedata.normalize("NFD", text)
    return "".join(c for c in loose if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


def _counted(texts: DataFrame, languages: list[str]) -> np.ndarray:
    """Trigram counts by language, at most languages x BUCKETS numbers whatever the size of the texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                # with and without accents: lost accents do not make another language
                found = [trigram_buckets(form) for text in texts for form in (text, _bare(text))]
                sums[languages.index(lang)] += np.bincount(np.concatenate(found), minlength=BUCKETS)
        at = np.nonzero(sums)
        yield pd.DataFrame({"lang_no": at[0], "bucket": at[1], "n": sums[at]})

    rows = texts.mapInPandas(count, "lang_no long, bucket long, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((len(languages), BUCKETS))
    for lang_no, bucket, n in rows:
        out[lang_no, bucket] = n
    return out


class Languages:
    """Naive Bayes over trigram buckets with a class for all languages without labels.

    That class explains a text as well as a language whose trigrams lie three
    quarters of the way between the language itself and its nearest other one.
    """

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.counts = counts
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
        # mean log-likelihood of each language's trigrams under each model
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        mean = share @ self.logs.T
        own = np.diag(mean)
        foreign = np.array([np.max(np.delete(mean[:, i], i)) if len(names) > 1 else own[i] - 4 for i in range(len(names))])
        self.level = own - 0.75 * np.maximum(own - foreign, 1)
        self.prior = np.log(np.array([(1 - OTHER_CHANCE) / len(names)] * len(names) + [OTHER_CHANCE]))

    def posterior(self, text: str) -> np.ndarray:
        """Chance of each language and, last, of another one; the prior where a text has no trigrams."""
        buckets = trigram_buckets(text)
        odds = self.prior.copy()
        if len(buckets):
            odds[:-1] += (self.logs[:, buckets].mean(axis=1) - self.level) * len(buckets) / TRIGRAMS_ALIKE
        odds = np.exp(odds - odds.max())
        return odds / odds.sum()

    def of(self, text: str) -> str:
        """The likeliest language, or "other"."""
        return [*self.names, "other"][int(np.argmax(self.posterior(text)))]

    def differ(self, a: str, b: str) -> float:
        """Chance that two texts are in different languages."""
        return 1.0 - float(self.posterior(a) @ self.posterior(b))


def _drawn(rows: DataFrame, by: str, text: str, most: int) -> DataFrame:
    """``<by>, <text>``: of each value of ``by`` at most ``most`` different texts, drawn by their hash.

    Hashes are counted and drawn before any text is moved, so that copies of a
    text and the number of tasks don't matter.
    """
    hashed = rows.select(by, F.xxhash64(text).alias("_h"), F.col(text))
    each = cut(hashed.select(by, "_h").distinct())
    sizes = {r[0]: r[1] for r in each.groupBy(by).agg(F.count(F.lit(1))).collect()}  # one row per label
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (1.2 * most + 50) / n))]) if sizes else None
    if share is None:
        return rows.select(by, text).limit(0)
    low = F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) < F.element_at(share, F.col(by)) * (1 << 20)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("_h"), "_h"))
    chosen = each.where(low).withColumn("_n", nth).where(F.col("_n") <= most).select(by, "_h")
    # a number of partitions is given, so that a small sample with much work isn't put into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hashed.join(F.broadcast(chosen), [by, "_h"], "left_semi").repartition(parts, by, "_h").groupBy(by, "_h").agg(F.first(text).alias(text)).drop("_h")


def train_languages(labelled: DataFrame, unlabelled: DataFrame | None = None, *, sample_rows: int = 2000, rounds: int = 2) -> Languages:
    """Fit on at most ``sample_rows`` texts (columns ``text, lang``) of each label; labels held by none are left out.

    Texts are drawn by their hash.  After a first fit, rows that another
    language explains better are left out as wrongly labelled, and the fit is
    repeated.  Of ``unlabelled`` (a column ``text``), at most ``sample_rows``
    texts join the language that the fit is sure of, in ``rounds`` passes.
    """
    rows = labelled.where("text is not null and lang is not null and length(text) > 0").select("lang", "text")
    sample = cut(_drawn(rows, "lang", "text", sample_rows))
    names = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not names:
        return Languages(["?"], np.zeros((1, BUCKETS)))
    first = Languages(names, _counted(sample, names))

    def named(model: Languages, sure: float):
        @F.pandas_udf(T.StringType())
        def name(texts: pd.Series) -> pd.Series:
            chances = [model.posterior(t)[:-1] for t in texts]
            return pd.Series([model.names[int(np.argmax(c))] if c.max() > sure else None for c in chances], dtype=object)

        return name("text")

    base = _counted(sample.where(named(first, 0.0) == F.col("lang")), names)
    model = Languages(names, base)
    if unlabelled is not None:
        more = cut(_drawn(unlabelled.where("length(text) > 0").select(F.lit("").alias("_all"), "text"), "_all", "text", sample_rows).select("text"))
        for _ in range(rounds):
            model = Languages(names, base + _counted(more.withColumn("lang", named(model, 0.99)).where("lang is not null"), names))
    return model


# ---------------------------------------------------------------- sentences that decline

#: Buckets of character n-grams, lengths of n-grams, and n-grams that say as much as one independent one.
GRAM_BUCKETS, GRAMS, GRAMS_ALIKE = 1 << 16, (3, 4, 5, 6), 16
#: Share of the pooled n-grams in the likelihood of each class.
POOLED = 3.0
#: Log odds from which on a sentence speaks of the question only.
DECLINE_ODDS = 1.0
#: Characters of an answer that may be a seed, and of one that is taken to hold content.
SHORT, LONG = 250, 400

_DENIES, _ANSWERS, _COURTESY = re.compile(DENIALS), re.compile(ANSWERING), re.compile(COURTESY)
_CAPITAL = "".join(c for c in map(chr, range(0xC0, 0x1F00)) if c.isupper() and unicodedata.name(c, "").startswith("LATIN"))
_NAMES = re.compile(rf"(?<=[^\W\d_,;:)]\s)[A-Z{_CAPITAL}]\w*(?:\s+[A-Z{_CAPITAL}]\w*)*|\b[A-Z{_CAPITAL}]{{2,}}\b")


def sentences_of(text: str | None) -> Iterator[str]:
    """Sentences in lower case without accents and signs, numbers as 9, and names within them as x."""
    for s in re.split(r"(?<=[.!?])\s+|\n+", re.sub(_TAG, " ", text or "")):
        named = s if s.upper() == s else _NAMES.sub("x", s)
        flat = " ".join(re.findall(r"[^\W\d_]+|\d+", re.sub(r"\d[\d.,]*", "9", _bare(named).lower())))
        if flat:
            yield flat


def _gram_buckets(sentence: str) -> np.ndarray:
    codes = np.frombuffer(f" {sentence} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    found = []
    for n in GRAMS:
        if len(codes) >= n:
            h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append((h >> np.uint64(40)) % np.uint64(GRAM_BUCKETS))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, dtype=np.int64)


def _seed(sentence: str) -> bool:
    return bool(_DENIES.search(sentence) and _ANSWERS.search(sentence))


class Declines:
    """Naive Bayes between sentences of answers that decline and sentences with content.

    Features are character n-grams, and whether a sentence denies and names
    asking or answering.  Without counts it falls back on that sign alone.
    """

    def __init__(self, counts: np.ndarray, seeds: np.ndarray, sizes: np.ndarray):
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        pool = share.mean(axis=0) + 0.01 / GRAM_BUCKETS
        likely = np.log(share + POOLED * pool / pool.sum())
        self.odds = likely[0] - likely[1] if sizes.min() else np.zeros(GRAM_BUCKETS)
        rate = (seeds + 1) / (sizes + 2) if sizes.min() else np.array([0.9, 0.01])
        self.sign = (float(np.log((1 - rate[0]) / (1 - rate[1]))), float(np.log(rate[0] / rate[1])))

    def score(self, sentence: str) -> float:
        """Log odds that a sentence holds no content."""
        return float(self.odds[_gram_buckets(sentence)].sum()) / GRAMS_ALIKE + self.sign[_seed(sentence)]

    def answers_nothing(self, text: str | None) -> bool:
        """True if every sentence speaks of the question only or is a courtesy, and not all are courtesies."""
        found = False
        for s in sentences_of(text):
            if self.score(s) > DECLINE_ODDS:
                found = True
            elif not _COURTESY.search(s):
                return False
        return found


def _seeds_only(text: str | None) -> bool:
    parts = list(sentences_of(text)) if len(text or "") <= SHORT else []
    return any(map(_seed, parts)) and all(_seed(s) or _COURTESY.search(s) for s in parts)


def _sentence_counts(sample: DataFrame, model: Declines | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram counts, seeds and number of sentences, first of declining answers and then of those with content."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, seeds, sizes = np.zeros((2, GRAM_BUCKETS), dtype=np.int64), [0, 0], [0, 0]
        for b in batches:
            for kind, text in zip(b["kind"], b["text"]):
                if kind == "short" and not _seeds_only(text) and not (model and model.answers_nothing(text)):
                    continue
                at = int(kind == "long")
                for s in sentences_of(text):
                    sums[at, _gram_buckets(s)] += 1
                    seeds[at] += _seed(s)
                    sizes[at] += 1
        at = np.nonzero(sums)
        totals = [[i, GRAM_BUCKETS + j, n] for i in (0, 1) for j, n in enumerate((seeds[i], sizes[i]))]
        yield pd.DataFrame(np.concatenate([np.stack([*at, sums[at]], axis=1), np.array(totals)]), columns=["kind_no", "bucket", "n"])

    out = np.zeros((2, GRAM_BUCKETS + 2))
    for kind_no, bucket, n in sample.mapInPandas(count, "kind_no long, bucket long, n long").groupBy("kind_no", "bucket").agg(F.sum("n").alias("n")).collect():
        out[kind_no, bucket] = n
    return out[:, :GRAM_BUCKETS], out[:, GRAM_BUCKETS], out[:, GRAM_BUCKETS + 1]


def train_declines(answers: DataFrame, text: str, *, sample_rows: int = 4000, rounds: int = 4) -> Declines:
    """Fit on at most ``sample_rows`` different short and as many long answers.

    Short answers whose sentences deny an answer or are courtesies are the
    first examples; those that the fit finds join them, until it is stable or
    after ``rounds`` passes.
    """
    kind = F.when(F.length(text) > LONG, "long").when(F.length(text) <= LONG, "short")
    rows = answers.select(kind.alias("kind"), F.col(text).alias("text")).where("kind is not null")
    sample = cut(_drawn(rows, "kind", "text", sample_rows))
    model, before = None, None
    for _ in range(rounds):
        counts = _sentence_counts(sample, model)
        model = Declines(*counts)
        if before is not None and np.array_equal(before, counts[0]):
            break
        before = counts[0]
    return model


# ---------------------------------------------------------------- ends of texts


def _ending_words(text: Column) -> Column:
    """Words for end-of-text n-grams: lower case without accents, numbers as 9; the sign "|" marks each sentence end."""
    t = F.lower(fold_accents(_visible(text)))
    t = F.regexp_replace(t, rf"[{_ENDS}]+(?=[{_AFTER_END}]|$)|\n|/\.", " | ")
    t = F.regexp_replace(t, r"\d[\d.,]*", "9")
    t = F.regexp_replace(t, r"([;:])", r" $1 ")
    t = F.regexp_replace(t, r"[^a-z0-9|/;:-]+", " ")
    return F.array_compact(F.transform(F.split(F.trim(t), r"\s+"), lambda w: F.when(w != "", w)))


def _ngram(words: Column, end: Column, n: int) -> Column:
    """The n words up to position ``end`` (from 1), or null where a sentence ends among them or there are fewer."""
    part = F.slice(words, F.greatest(end - n + 1, F.lit(1)), n)
    return F.when((end >= n) & ~F.array_contains(part, "|"), F.array_join(part, " "))


def end_likelihood(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, likelihood, word_likelihood``: for each text without a closing sign, how likely a sentence ends after its last words.

    The last three words are looked up in all different texts, the text itself
    left out at its end; if they are seen fewer than LEAST_SEEN times, two
    words, then one.  Texts with the same words count once, however many rows
    hold them: copies of an answer that breaks off don't prove an end.
    Words that are seen nowhere else have likelihood 0.  n-grams are counted
    with partial aggregation and only where some text ends in them.
    """
    same = ["_h1", "_h2"]
    split = lambda df: df.select(F.col(key), _ending_words(F.col(text)).alias("w")).withColumns({"_h1": F.xxhash64("w"), "_h2": F.hash("w")})
    rows = split(answers.where(~F.col(text).rlike(rf"[{_ENDS}]+[{_AFTER_END}]*$")))  # the others have a closing sign
    words = split(answers).groupBy(*same).agg(F.first("w").alias("w"))
    open_ends = words.where((F.size("w") > 0) & (F.element_at("w", -1) != "|"))
    grams = lambda at: [F.struct(F.lit(n).alias("n"), _ngram(F.col("w"), at, n).alias("g")) for n in (1, 2, 3)]
    wanted = open_ends.select(*same, F.explode(F.array(*grams(F.size("w")))).alias("_g")).select(*same, "_g.n", "_g.g").where("g is not null")
    keys = wanted.select("g").distinct()
    places = words.select("w", F.posexplode("w").alias("i", "last")).where("last <> '|'").withColumn("end", F.col("i") + 1)
    followed = (F.col("end") >= F.size("w")) | (F.try_element_at("w", F.col("end") + 1) == "|")
    bare = F.col("end") >= F.size("w")
    found = places.select(F.explode(F.array(*grams(F.col("end")))).alias("_g"), followed.cast("long").alias("ends"), bare.cast("long").alias("bare")).select("_g.g", "ends", "bare").where("g is not null")
    seen = found.groupBy("g").agg(F.count(F.lit(1)).alias("seen"), F.sum("ends").alias("ends"), F.sum("bare").alias("bare")).join(keys, "g", "left_semi")
    # ends without a closing sign count for whole phrases only: a word cut off is cut off in many texts
    met = wanted.join(seen, "g").withColumn("seen", F.col("seen") - 1).withColumn("any_end", F.col("ends") - 1)
    met = met.withColumn("ended", F.when(F.col("n") == 3, F.col("any_end")).otherwise(F.col("ends") - F.col("bare")))
    best = met.groupBy(*same).agg(
        F.max(F.when(F.col("seen") >= LEAST_SEEN, F.struct("n", "seen", "ended"))).alias("b"),
        F.max(F.when((F.col("n") == 1) & (F.col("seen") > 0), F.struct("seen", "any_end"))).alias("w"),
        F.max((F.col("n") == 1) & (F.col("g") == "9")).alias("number"),
    )
    share = F.coalesce(F.col("b.ended") / F.col("b.seen"), F.lit(0.0))
    judged = best.select(*same, share.alias("likelihood"), F.coalesce(F.when(F.col("number"), 1.0), F.col("w.any_end") / F.col("w.seen"), F.lit(0.0)).alias("word_likelihood"))
    return rows.select(key, *same).join(judged, same).drop(*same)


# ---------------------------------------------------------------- defects


def _open_list(text: Column) -> Column:
    """A text that ends in a sign after which more must follow, or inside a bracket or quotation."""
    t = F.rtrim(_visible(text))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    no_end = ~t.rlike(r"[.!?。！？][\s\"'”’)\]]*$")
    return t.rlike(r"(?:[:,;(\[<“«-]|…|\.\.\.|;\s*[\p{L}]+)$") | (no_end & ((count("(") > count(")")) | (count("“") > count("”")) | (count('"') % 2 == 1)))


def defects(items: DataFrame, languages: Languages, declines: Declines | None = None, *, key: str, question: str, answer: str, version: str) -> DataFrame:
    """``<key>, defect`` for every defective item; sound items give no row.

    Of repeated items the one with the latest ``version`` counts.  A null or
    empty question can be neither copied nor in another language.  A null
    answer is ``empty``.  Rows with a null key are treated as one item.
    ``declines`` is fitted to the answers themselves if it isn't given.
    """
    latest = items.groupBy(F.col(f"`{key}`").alias("_key")).agg(
        F.max_by(F.struct(F.col(f"`{question}`").alias("q"), F.col(f"`{answer}`").alias("a")), F.struct(F.col(f"`{version}`"), F.coalesce(F.col(f"`{answer}`"), F.lit("")))).alias("r")
    )
    rows = latest.select("_key", "r.q", "r.a")
    marked = cut(_early(rows))  # read by the fit, the judgement and the ends
    if declines is None:
        declines = train_declines(marked.where("_early is null"), "a")
    return _judged(marked, languages, declines).select(F.col("_key").alias(key), "defect").where("defect is not null")


def _early(rows: DataFrame) -> DataFrame:
    """Marks empty answers and copies of the question."""
    flat_a, flat_q = name_words(_visible(F.col("a"))), name_words(F.coalesce("q", F.lit("")))
    other_script = _visible(F.col("a")).rlike(r"[^\p{IsLatin}\P{L}]")
    words = lambda c: F.array_compact(F.transform(F.split(c, " "), lambda w: F.when(w != "", w)))
    marked = rows.withColumns({"_fa": flat_a, "_fq": flat_q}).withColumns({"_wa": F.array_distinct(words(F.col("_fa"))), "_wq": F.array_distinct(words(F.col("_fq")))})
    shared = F.size(F.array_intersect("_wa", "_wq"))
    is_empty = F.col("_fa").isin(*PLACEHOLDERS) & ~other_script
    is_copy = (F.size("_wq") > 3) & (shared >= 0.7 * F.size("_wa")) & (shared >= 0.6 * F.size("_wq")) & (F.length("_fa") <= 1.3 * F.length("_fq") + 20)
    return marked.select("_key", "q", "a", F.when(is_empty, "empty").when(is_copy, "copy").alias("_early"))


def _judged(marked: DataFrame, languages: Languages, declines: Declines) -> DataFrame:
    @F.pandas_udf("refusal boolean, differ double")
    def read(q: pd.Series, a: pd.Series, early: pd.Series) -> pd.DataFrame:
        out = []
        for question, text, known in zip(q, a, early):
            if known is not None:
                out.append((False, 0.0))
                continue
            text = re.sub(_TAG, " ", text or "")
            asked = (question or "").strip()
            rest = text.replace(asked, " ") if len(asked) > 20 else text
            out.append((declines.answers_nothing(text), languages.differ(asked, rest) if asked else 0.0))
        return pd.DataFrame(out, columns=["refusal", "differ"])

    read_rows = marked.withColumn("_p", read("q", "a", "_early"))
    ends = end_likelihood(marked.where("a is not null"), "_key", "a")
    ends = ends.withColumnRenamed("_key", "_end_of")
    joined = read_rows.join(ends, F.col("_key").eqNullSafe(F.col("_end_of")), "left")
    other = F.col("_p.differ") > DIFFER
    closing = F.regexp_extract(_visible(F.col("a")), r"(?:^|[.!?…]\s|\n)\s*([^.!?…\n]*)\s*$", 1)
    cut_off = _open_list(F.col("a")) | ~name_words(closing).rlike(CLOSINGS) & ((F.col("likelihood") < END_LIKELIHOOD) | (F.col("word_likelihood") < WORD_END_LIKELIHOOD))
    return joined.withColumn("defect", F.coalesce("_early", F.when(F.col("_p.refusal"), "refusal").when(other, "other_language").when(cut_off, "truncated")))
