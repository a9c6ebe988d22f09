"""Quality rules: counts of repetition and symbols, and distances from language references (DataFrame functions only).

A document's shares of character classes and of common words are compared with those of every language
by the Jensen-Shannon distance (base 2, 0 to 1); the nearest language judges. A text whose distance is
beyond the limit reads like none of the languages: symbols stuck to words, capitals throughout, lists of
rare words. Short texts have noisy shares, so only texts of ``LEAST_WORDS`` words or more are judged.

References are means over documents, each counting once whatever its length, of the languages that
hold enough of them. A language's common words are its ``COMMON`` most frequent ones. They live in an
array indexed by a word's hash, so that a text is looked up word by word in its own row: the
verdict needs no shuffle, only the references do, and these are summed within each task first.

Repeated five-word windows are found in the row as well: windows are hashed to 64 bits, and only
where two are equal are they sorted, each with its place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.text import narrow
from pulsegrid.session import settle

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# Characters of each class, one class after the other; what is left is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", SPACE, r"[\x21-\x7E]+")
COMMON = 64
# Documents of a language that make a reference, and the least share of all of them: at most 200 languages.
LEAST_DOCS = 20
LEAST_SHARE = 0.005
LEAST_WORDS = 50
SLOTS = 1 << 14
# Square of the largest distance allowed: a constant, and a part that falls with the number of words, as chance does.
CLASS_LIMIT = (0.03, 3.0)
WORD_LIMIT = (0.04, 22.0)


def _words(docs: DataFrame) -> DataFrame:
    """``docs`` with their text's words; a null text is empty."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_trimmed", F.btrim("text", F.lit(SPACES)))
    return docs.withColumn("words", F.when(F.col("_trimmed") != "", F.split("_trimmed", SPACE)).otherwise(
        F.array().cast("array<string>"))).drop("_trimmed")


def _class_counts(rows: DataFrame) -> DataFrame:
    """Adds ``_counts``, the characters of each class in ``text``, and ``_rest``, the text without letters, digits and space.

    Each class is taken out of what the ones before it left, in a step of its own.
    """
    left = "text"
    for i, pattern in enumerate(CLASSES):
        rows = rows.withColumn(f"_left{i}", F.regexp_replace(left, pattern, ""))
        left = f"_left{i}"
    chain = ["text", *[f"_left{i}" for i in range(len(CLASSES))]]
    counts = [F.length(before) - F.length(after) for before, after in zip(chain, chain[1:])] + [F.length(left)]
    rows = rows.withColumn("_counts", F.array(*counts)).withColumn("_rest", F.col(f"_left{CLASSES.index(SPACE)}"))
    return rows.drop(*chain[1:])


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    return F.transform(counts, lambda n: n / F.greatest(total, F.lit(1)))


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``hashes`` of their words."""
    n = F.size("hashes")
    shingle = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get("hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_shingles", shingle)
    placed = F.sort_array(F.transform("_shingles", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_shingles")) < F.size("_shingles"), placed))
    again = F.filter("_sorted", lambda x, j: (x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"]))
    rows = rows.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, own: total + own)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_shingles", "_sorted", "_places")


# ---- references ----

@dataclass(frozen=True)
class References:
    """Languages' shares: of the character classes, and of the common words by code (code 0: all other words).

    ``slots`` has the code of the common word whose hash falls there (0: none), ``hashes`` a code's hash.
    """

    slots: list[int]
    hashes: list[int]
    classes: list[list[float]]
    words: list[list[float]]


def references(docs: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_words: int = LEAST_WORDS,
               common: int = COMMON) -> References:
    """References of the languages in ``docs`` (lang, text); a null lang refers to none.

    What reaches the driver is bounded by 1 / least_share languages and ``common`` words of each. Where
    common words meet in a slot the most frequent one has it; shares below 1e-5 count as none.
    """
    usable = _words(docs.where("lang IS NOT NULL")).withColumn("n", F.size("words")).where(F.col("n") >= least_words)
    shares = _class_counts(usable.select("lang", "text")).select("lang", _shares("_counts").alias("own"))
    classes = [f"c{i}" for i in range(len(CLASSES) + 1)]
    # Each class's mean on its own, so that the sums are plain numbers.
    langs = settle(shares.groupBy("lang").agg(F.count("*").alias("docs"), *[
        F.avg(F.get("own", F.lit(i))).alias(c) for i, c in enumerate(classes)]), "languages")
    langs = langs.where((F.col("docs") >= least_docs) & (F.col("docs") >= least_share * langs.agg(F.sum("docs")).scalar()))
    tokens = usable.select("lang", F.explode("words").alias("word"), (1 / F.col("n")).alias("share"))
    tokens = tokens.groupBy("lang", "word").agg(F.sum("share").alias("share")).join(langs.select("lang", "docs"), "lang")
    tokens = settle(tokens.select("lang", "word", (F.col("share") / F.col("docs")).alias("share")).where("share >= 1e-5"), "word-shares")
    order = Window.partitionBy("lang").orderBy(F.col("share").desc(), "word")
    top = tokens.withColumn("at", F.row_number().over(order)).where(F.col("at") <= common).select("word").distinct()
    rows = tokens.join(top, "word").select("lang", F.xxhash64("word").alias("hash"), "share").collect()
    total: dict[int, float] = {}
    for r in rows:
        total[r.hash] = total.get(r.hash, 0.0) + r.share
    slots, hashes = [0] * SLOTS, [0]
    for h in sorted(total, key=lambda h: (-total[h], h)):
        if not slots[h % SLOTS]:
            slots[h % SLOTS] = len(hashes)
            hashes.append(h)
    own = {r.lang: (list(r)[2:], [0.0] * len(hashes)) for r in langs.select("lang", "docs", *classes).orderBy("lang").collect()}
    for r in rows:
        code = slots[r.hash % SLOTS]
        if hashes[code] == r.hash:
            own[r.lang][1][code] = r.share
    for _, words in own.values():
        words[0] = max(0.0, 1.0 - sum(words))
    return References(slots, hashes, [c for c, _ in own.values()], [w for _, w in own.values()])


def _constant(value: list, kind: str) -> Column:
    """A list as one literal."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


# ---- distances ----

def _term(p: Column, q: Column) -> Column:
    """A bin's part of twice the Jensen-Shannon divergence of shares p and q."""
    def side(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))

    return side(p) + side(q)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _distance(doubled: Column) -> Column:
    return F.sqrt(F.greatest(doubled / 2, F.lit(0.0)))


def _nearest(distances: list[Column]) -> Column:
    return F.array_min(F.array(*distances)) if distances else F.lit(None).cast("double")


def class_distance(own: str, refs: References) -> Column:
    """Distance of shares of character classes from the nearest language's, null without any."""
    return _nearest([_distance(_sum(F.zip_with(own, _constant(q, "array<double>"), _term))) for q in refs.classes])


def _word_bins(rows: DataFrame, refs: References) -> DataFrame:
    """Adds ``_bins``: (code, share) of the common words that the text has."""
    slots, hashes = _constant(refs.slots, "array<int>"), _constant(refs.hashes, "array<bigint>")

    def code(h: Column) -> Column:
        found = F.get(slots, h.bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int"))
        return F.when(F.get(hashes, found) == h, found).otherwise(F.lit(0))

    rows = rows.withColumn("_codes", F.sort_array(F.filter(F.transform("hashes", code), lambda c: c > 0)))
    first = F.filter(F.transform("_codes", lambda c, j: F.when(F.coalesce(F.get("_codes", j - 1), F.lit(0)) != c, j)), lambda j: j.isNotNull())
    rows = rows.withColumn("_first", first)
    bins = F.transform("_first", lambda at, j: F.struct(
        F.get("_codes", at).alias("code"),
        ((F.coalesce(F.get("_first", j + 1), F.size("_codes")) - at) / F.size("hashes")).alias("share")))
    return rows.withColumn("_bins", bins).drop("_codes", "_first")


def word_distance(bins: str, refs: References) -> Column:
    """Distance of shares of common words from the nearest language's shares, null without any.

    A common word that the text lacks adds its whole share, so only those it has are gone through.
    """
    other = F.greatest(1 - _sum(F.transform(bins, lambda b: b["share"])), F.lit(0.0))

    def doubled(shares: list[float]) -> Column:
        q, rest = _constant(shares, "array<double>"), F.lit(shares[0])
        present = _sum(F.transform(bins, lambda b: _term(b["share"], F.get(q, b["code"])) - F.get(q, b["code"])))
        return present + 1 - rest + _term(other, rest)

    return _nearest([_distance(doubled(shares)) for shares in refs.words])


# ---- verdicts ----

def _beyond(distance: str, n: Column, limit: tuple[float, float]) -> Column:
    return F.col(distance) * F.col(distance) > limit[0] + limit[1] / F.greatest(n, F.lit(1))


def judge(docs: DataFrame, refs: References, least_words: int = LEAST_WORDS, class_limit: tuple[float, float] = CLASS_LIMIT,
          word_limit: tuple[float, float] = WORD_LIMIT) -> DataFrame:
    """Counts, distances and verdicts of ``docs`` (doc_id, text) against given references."""
    rows = _class_counts(_words(docs))
    # Of the lines that have a word.
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        (F.length("text") - F.get("_counts", F.lit(CLASSES.index(SPACE)))).cast("long").alias("word_chars"),
        F.regexp_count("_rest", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"), _shares("_counts").alias("_own"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    rows = _word_bins(repeated_words(rows), refs)
    rows = rows.withColumn("class_distance", class_distance("_own", refs)).withColumn("word_distance", word_distance("_bins", refs))
    n, failed = F.col("n_words"), (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (_beyond("class_distance", n, class_limit)) | (_beyond("word_distance", n, word_limit))
    rows = rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & ~((n >= least_words) & F.coalesce(far, F.lit(False))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "class_distance", "word_distance")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and the two distances.

    The references are made of all of ``docs``; ``lang`` serves for them alone, a document is held against every
    language. Null and empty texts have no words and fail the base rules. Rows that repeat a doc_id are judged
    each by itself, a null doc_id stays null. Without any reference (an empty table, no lang) distances are
    null and the base rules decide alone. Further columns are ignored.
    """
    refs = references(narrow(docs, lang=lang_col, text=text_col))
    return judge(narrow(docs, doc_id=id_col, text=text_col), refs, **limits)
