"""Problem 2: one consistent form for text that looks the same.

Plain form: precomposed letters, Latin letters and ASCII digits, "-", "/" and
the ordinary space wherever something stored looks the same, nothing invisible.
Signs that look different stay.  Look-alike letters (also the two Latin letters
that look like the Vietnamese D with stroke) are replaced in mixed-script tokens
only, by letters of the token's dominant script or else Latin ones, and only if
every word of the repaired token is in the vocabulary of the corpus.  A token
wholly in another script counts as mixed where all its letters look Latin and
the rest of the value is mostly Latin, or there is no rest but the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

# Signs that look like the hyphen-minus, the slash, and invisible characters outside category Cf.
DASHES = "‐‑⁃˗﹣－"
SLASHES = "⁄∕⧸／"
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"

# Letters of other scripts, and what they look like in Latin.
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    # Armenian
    "Ս": "U", "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "յ": "j", "ց": "g",
    # Latin letters that look like D with stroke
    "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ",
}

_MAP = str.maketrans(LOOK_ALIKES)
_BACK: dict[str, dict[int, str]] = {}
for _other, _latin in LOOK_ALIKES.items():
    if unicodedata.name(_other).split(" ", 1)[0] != "LATIN":
        _BACK.setdefault(unicodedata.name(_other).split(" ", 1)[0], {}).setdefault(ord(_latin), _other)
#: Letters of the scripts that have look-alikes of Latin letters.
_LOOKS = re.compile("[\u0370-\u058f\u1f00-\u1fff" + "".join(LOOK_ALIKES) + "]")
_WORD = re.compile(r"[^\W\d_]+")
_VIETNAMESE = "".join(
    unicodedata.normalize("NFC", base + shape + tone)
    for base, shapes in (("aA", ("", "̆", "̂")), ("eE", ("", "̂")), ("iI", ("",)), ("oO", ("", "̂", "̛")), ("uU", ("", "̛")), ("yY", ("",)))
    for base in base
    for shape in shapes
    for tone in ("", "̀", "̉", "̃", "́", "̣")
)
#: Matches a value that may differ from its plain form: anything but ASCII and precomposed Vietnamese letters.
MAYBE = "[^\\t-\\r -~" + "".join(sorted(set(_VIETNAMESE + "đĐ") - set(map(chr, range(128))))) + "]"


def _folded(ch: str) -> str:
    code = ord(ch)
    if 0xFF01 <= code <= 0xFF5E:
        return chr(code - 0xFEE0)
    if ch in DASHES:
        return "-"
    if ch in SLASHES:
        return "/"
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180F:
        return ""
    if kind == "Zs" and ch != " ":
        return " "
    if kind == "Nd" and code > 127 and "MATHEMATICAL" in unicodedata.name(ch, ""):
        return str(unicodedata.digit(ch))
    return ch


class _Fold(dict):
    """A translation table that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _folded(chr(code))
        return out


_FOLD = _Fold()


def plain_signs(text: str) -> str:
    """The plain form of everything but look-alike letters; these need the corpus."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_FOLD))


def _script(ch: str) -> str:
    return unicodedata.name(ch, "? ").split(" ", 1)[0]


def _scripts(text: str) -> Counter:
    """Letters of each script; the Latin look-alikes of D with stroke are no Vietnamese letters and count apart."""
    return Counter("OTHER LATIN" if c in "ÐƉɖ" else _script(c) for c in text if c.isalpha())


def _into(token: str, script: str) -> str | None:
    """The token with all look-alikes as letters of one script, or None if some letter has no twin there."""
    if script == "LATIN":
        loose = unicodedata.normalize("NFD", token)
        out = unicodedata.normalize("NFC", loose.translate(_MAP)).translate(_MAP)
    else:
        out = token.translate(_BACK.get(script, {}))
    return out if set(_scripts(out)) == {script} else None


def repaired_token(token: str, around: str | None = None) -> str | None:
    """A token of mixed scripts with its look-alikes in one of them, or None if it needs or allows no repair.

    The dominant script of the token is tried first, then the others it holds.
    A token wholly in one other script is mixed only with the text around it:
    it is made Latin if all its letters look Latin and ``around`` is LATIN, the
    dominant script of that text; alone it is a word of its own script.
    """
    if not _LOOKS.search(token):
        return None
    scripts = _scripts(token)
    if len(scripts) == 1 and around != "LATIN":
        return None
    for script in [*sorted(scripts, key=lambda s: (scripts[s], s == "LATIN", s), reverse=True), "LATIN"] if len(scripts) > 1 else ["LATIN"]:
        out = _into(token, script)
        if out is not None:
            return out if out != token else None
    return None


_PARTS = T.StructType(
    [
        T.StructField("plain", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("repaired", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))]))),
        T.StructField("pure", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(_PARTS)
def _parts(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Plain signs, tokens that may be repaired with the words this gives, and the words of tokens in one script."""
    for s in values:
        out = []
        for v in s:
            if v is None:
                out.append((None, None, None))
                continue
            p = plain_signs(v)
            tokens = p.split(" ")
            found, pure = [], []
            whole = _scripts(p) if _LOOKS.search(p) else None
            for i, t in enumerate(tokens):
                own = _scripts(t) if whole else None
                around = None
                if whole and len(own) == 1:
                    rest = whole - own  # a value of one token stands among the values of the corpus, whose script is Latin
                    around = max(rest, key=lambda k: (rest[k], k == "LATIN", k)) if rest else "LATIN"
                if whole and (r := repaired_token(t, around)) is not None:
                    found.append({"pos": i, "token": t, "repaired": r, "words": [w.lower() for w in _WORD.findall(r)]})
                elif not whole or len(own) == 1:
                    pure += [w.lower() for w in _WORD.findall(t)]
            out.append((p, found or None, pure))
        yield pd.DataFrame(out, columns=["plain", "tokens", "pure"])


def words_of(value: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}+)"), F.lit(1))


def plain_forms(values: DataFrame, key: list[str], value: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """The plain form of ``value`` for each row: ``key`` columns, the value and ``plain_form``.

    ``vocabulary`` (a column ``word``, lower case) defaults to the words of all
    values that hold no foreign sign and of all tokens in one script.  Null stays null and an empty text stays
    empty; repeated rows give repeated results; an empty table an empty one.
    The ``key`` columns must identify the value where a value has look-alikes
    (rows with equal keys and values are treated alike).  Other columns are
    dropped, so their names don't matter.
    """
    names = [f"_k{i}" for i in range(len(key))]
    rows = values.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(key, names)], F.col(f"`{value}`").alias("_value"))
    wanted, key_names, key, value = value, key, names, "_value"
    odd = F.col(value).rlike(MAYBE)
    plain_words = rows.where(~odd).select(F.explode(words_of(F.col(value))).alias("word"))
    clean = rows.where(~odd | F.col(value).isNull()).withColumn("plain_form", F.col(value))
    # written once: all that follows reads the few odd values from there
    parts = cut(rows.where(odd).withColumn("_p", _parts(F.col(value))).select(*key, value, F.col("_p.plain").alias("_plain"), F.col("_p.tokens").alias("_tokens"), F.col("_p.pure").alias("_pure")))
    if vocabulary is None:
        vocabulary = plain_words.unionByName(parts.select(F.explode("_pure").alias("word")))
    simple = parts.where(F.col("_tokens").isNull()).select(*key, value, F.col("_plain").alias("plain_form"))
    mixed = parts.where(F.col("_tokens").isNotNull())
    # Each distinct repaired token is judged once: all of its words must be in the corpus.
    # what a token becomes may depend on the text around it, so both are judged together
    judged = mixed.select(F.explode("_tokens").alias("_t")).select(F.struct("_t.token", "_t.repaired").alias("token"), F.col("_t.words").alias("words")).distinct()
    asked = judged.select("token", F.size("words").alias("n"), F.explode_outer("words").alias("word"))
    known = vocabulary.select("word").join(asked.select("word").distinct(), "word", "left_semi").distinct().withColumn("known", F.lit(1))
    good = asked.join(known, "word", "left").groupBy("token").agg(F.count("known").alias("k"), F.count("word").alias("n")).where("k = n").select("token")
    per_token = mixed.select(*key, value, "_plain", F.explode("_tokens").alias("_t")).join(good.withColumn("_ok", F.lit(True)), F.struct("_t.token", "_t.repaired") == F.col("token"), "left")
    fixes = per_token.groupBy(*key, value, "_plain").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("_ok"), F.struct(F.col("_t.pos"), F.col("_t.repaired")))))).alias("_fix"))
    fixed = fixes.select(
        *key, value,
        F.array_join(F.transform(F.split("_plain", " ", -1), lambda t, i: F.coalesce(F.try_element_at("_fix", i), t)), " ").alias("plain_form"),
    )
    out = clean.unionByName(simple).unionByName(fixed)
    return out.select(*[F.col(n).alias(c) for c, n in zip(key_names, names)], F.col("_value").alias(wanted), "plain_form")
