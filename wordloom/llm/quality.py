"""Quality rules by divergence from language references -- DataFrame functions only.

Counted rules first: few words, or most words in three-word windows that repeat in the text.
Then the distribution rule: a document's histogram of character classes and
its histogram of its language's common words are compared with the language's
reference by Jensen-Shannon distance (base 2, so 0 to 1).  A reference is
the mean of the normalised histograms of all documents of a language and of ``prior_documents`` more, which have the
mean characters of all documents and ``PRIOR_COMMON`` of their words on the list: a language of few documents is
smoothed, and none is left out.  Short texts have
noisy histograms: the character test needs ``min_chars`` characters other than white space, the word test
``min_words`` words and a language whose common words are listed.  The word test's limit comes from the reference:
``max_words_share`` of the distance of a text that has none of the listed words, so texts of made-up words or in another
language fail, whatever share of the reference's words is listed.

Repeated windows are found without a shuffle: window hashes are packed
with their places into longs and sorted, which leaves neighbours with equal
leading bits as candidates; only their words are then compared as text, so the
count is exact.

Defined cases.  Null, empty and wordless texts have no words and fail the base rule.  A null or unknown language takes
the reference of all documents.  Repeated rows are judged alike.  An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import common as cm

# The most frequent function words of each language, lower case, in dictionary frequency order.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that it was for on are as with his they at be this".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
}
# Character classes, each counted among what the earlier ones leave.
CLASSES = {
    "lower": "[a-z]+", "space": "[\\x20\\x09-\\x0D]+", "upper": "[A-Z]+", "accented": "[\\p{L}\\p{M}]+", "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+", "mark": "[.,;:!?'\"()-]+", "bracket": "[\\[\\]{}=_/\\\\@~^`+]+",
}
SPACES = " \t\n\x0b\x0c\r"
PRIOR_COMMON = 0.2
PLACE_BITS = 30  # a text has fewer words than 2**30 (2 GB at most, a space between)


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_repeated: int = 50        # per cent of words
    max_chars_distance: float = 0.35
    max_words_share: float = 0.9   # of the distance of a text without common words
    min_chars: int = 200
    min_words: int = 100
    prior_documents: int = 20


def _next_pairs(a: Column, fn) -> Column:
    """``fn(element, next element)`` for every element; the last one's next is null."""
    return F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), fn)


def counted(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """Counts and histograms of every row, in one pass over the texts."""
    d = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACES))
    no_words = F.array().cast("array<string>")
    d = d.withColumn("words", F.when(trimmed == "", no_words).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    n = F.size("words")
    # character classes, by what is left after each
    rest, left, sizes = F.col("text"), F.char_length("text"), {}
    for name, pattern in CLASSES.items():
        d = d.withColumn(f"rest_{name}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"rest_{name}")
        sizes[name], left = (left - F.char_length(rest)), F.char_length(rest)
    sizes["other"] = left
    # lines
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.withColumn("lines", F.when(F.instr("text", "\n") > 0, lines).otherwise(no_words))
    # repeated windows: hash << 30 | place, sorted
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    d = d.withColumn("hashes", hashes)
    d = d.withColumn("pairs", _next_pairs(F.col("hashes"), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("triples", F.slice(F.zip_with("pairs", F.slice("hashes", F.lit(3), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(n - 2, F.lit(0))))
    low = F.lit((1 << PLACE_BITS) - 1)
    d = d.withColumn("packed", F.sort_array(F.transform("triples", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("bigint")))))
    near = lambda a, b: F.when(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.array(a.bitwiseAND(low), b.bitwiseAND(low)))
    d = d.withColumn("near", F.array_distinct(F.flatten(F.filter(_next_pairs(F.col("packed"), near), lambda x: x.isNotNull()))))
    window = lambda i: F.concat_ws(" ", F.slice("words", (i + 1).cast("int"), F.lit(3)))
    d = d.withColumn("near", F.sort_array(F.transform("near", lambda i: F.struct(window(i).alias("w"), i.alias("i")))))
    d = d.withColumn("same", F.flatten(F.filter(_next_pairs(F.col("near"), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())))
    d = d.withColumn("same", F.sort_array(F.array_distinct("same")))
    covered = F.aggregate(_next_pairs(F.col("same"), lambda a, b: F.least(F.lit(3).cast("bigint"), F.coalesce(b - a, F.lit(3).cast("bigint")))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    # the language's common words: kept words joined, and each one's share of the joined length
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    d = d.withColumn("common", F.concat(F.lit(" "), F.array_join(F.filter(F.transform("words", lambda w: cm.ascii_lower(w)), lambda w: w.isin(listed)), "  "), F.lit(" ")))
    times = lambda w: ((F.char_length("common") - F.char_length(F.replace(F.col("common"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double")
    by_lang = F.array().cast("array<double>")
    for name, ws in COMMON_WORDS.items():
        by_lang = F.when(F.col("lang") == name, F.array(*[times(w) for w in ws])).otherwise(by_lang)
    return d.select(
        "id", "lang", n.cast("bigint").alias("n_words"), (F.char_length("text") - sizes["space"]).cast("bigint").alias("word_chars"),
        sizes["symbol"].cast("bigint").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), F.array(*[sizes[c].cast("double") for c in sizes if c != "space"]).alias("chars"), by_lang.alias("common"),
    )


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _histograms(c: DataFrame) -> DataFrame:
    words = F.col("n_words").cast("double")
    seen = F.aggregate("common", F.lit(0.0), lambda s, x: s + x)
    return c.withColumn("p_chars", _shares(F.col("chars"), F.col("word_chars").cast("double"))).withColumn(
        "p_words", F.when(F.size("common") > 0, F.concat(_shares(F.col("common"), words), F.array((words - seen) / F.greatest(words, F.lit(1.0))))))


def references(histograms: DataFrame) -> DataFrame:
    """lang (null: all documents), r_chars, r_words, n_docs: mean shares; bounded by the number of listed languages."""
    n_chars, n_words = len(CLASSES), max(map(len, COMMON_WORDS.values())) + 1
    known = F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang"))
    h = histograms.where("n_words > 0").select(known.alias("lang"), "p_chars", "p_words")
    means = [F.avg(F.get("p_chars", F.lit(i))).alias(f"c{i}") for i in range(n_chars)] + [F.avg(F.get("p_words", F.lit(i))).alias(f"w{i}") for i in range(n_words)]
    both = h.groupBy("lang").agg(*means, F.count(F.lit(1)).alias("n_docs")).where("lang is not null").unionByName(h.agg(*means, F.count(F.lit(1)).alias("n_docs")).withColumn("lang", F.lit(None).cast("string")))
    return both.select("lang", "n_docs", F.array(*[f"c{i}" for i in range(n_chars)]).alias("r_chars"), F.filter(F.array(*[f"w{i}" for i in range(n_words)]), lambda x: x.isNotNull()).alias("r_words"))


def judged(docs: DataFrame, r: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, counts, base_failed, chars_distance, words_distance, kept -- a row per input row."""
    h = _histograms(cm.checkpointed(counted(docs, doc_id, text, lang)))
    found = references(h).collect()  # at most one row of averages for each listed language and one for all
    every = next((x.r_chars for x in found if x.lang is None), None) or [0.0] * len(CLASSES)
    every = [float(v or 0) for v in every]
    array = lambda values: F.array(*[F.lit(v) for v in values])
    smoothed = lambda mean, prior, n: [(n * v + r.prior_documents * q) / (n + r.prior_documents) for v, q in zip(mean, prior, strict=True)]
    r_chars, r_words, limit = array(every), F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    for x in found:
        if x.lang is not None:
            k = len(x.r_words) - 1
            words = smoothed(x.r_words, [PRIOR_COMMON / k] * k + [1 - PRIOR_COMMON], x.n_docs)
            here = F.col("lang") == x.lang
            r_chars = F.when(here, array(smoothed(x.r_chars, every, x.n_docs))).otherwise(r_chars)
            r_words = F.when(here, array(words)).otherwise(r_words)
            limit = F.when(here, distance(array([0.0] * k + [1.0]), array(words)) * r.max_words_share).otherwise(limit)
    rows = h.withColumn("r_chars", r_chars).withColumn("r_words", r_words).withColumn("limit", limit)
    to_chars = F.when((F.col("word_chars") >= r.min_chars), distance(F.col("p_chars"), F.col("r_chars")))
    to_words = F.when((F.col("n_words") >= r.min_words) & F.col("r_words").isNotNull(), distance(F.col("p_words"), F.col("r_words")))
    failed = (F.col("n_words") < r.least_words) | (100 * F.col("n_repeat_words") > r.most_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("chars_distance", to_chars).withColumn("words_distance", to_words)
    near = (F.coalesce("chars_distance", F.lit(0.0)) <= r.max_chars_distance) & F.coalesce(F.col("words_distance") <= F.col("limit"), F.lit(True))
    return rows.select(
        F.col("id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance",
        (~F.col("base_failed") & near).alias("kept"))
